"""Gate, roles, contract, critic on hand-made tables."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwise import config
from tabwise.operators import calc, clean, contract, critic, filters, roles
from tabwise.plans import dashboard, interact


def frame(spark, **cols):
    names = list(cols)
    return spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"`{n}` {_type(cols[n])}" for n in names))


def _type(values):
    v = next((x for x in values if x is not None), "")
    return {bool: "boolean", int: "bigint", float: "double"}.get(type(v), "string")


def cycle(values, n):
    return [values[i % len(values)] for i in range(n)]


def roles_of(df):
    return {r["name"]: r["role"] for r in roles.classify(df).select("name", "role").collect()}


def levels(n, k, name="level"):
    return [f"{name} {'abcdefghij'[i % k % 10]}{'klmnopqrst'[i % k // 10 % 10]}{'uvwxyz'[i % k // 100]}" for i in range(n)]


def test_borders_of_category_rules(spark):
    """Few levels among many rows are a category: under 50 and a fifth, or over 50 and a twentieth."""
    small = frame(spark, under=levels(100, 19), at=levels(100, 20))
    assert roles_of(small) == {"under": "categorical", "at": "text"}
    big = frame(spark, fifty=levels(1200, 50), over=levels(1200, 51), twentieth=levels(1200, 60))
    assert roles_of(big) == {"fifty": "text", "over": "categorical", "twentieth": "text"}


@pytest.mark.parametrize("good,number,date", [(84, "text", "text"), (85, "numeric", "datetime"), (86, "numeric", "datetime")])
def test_borders_of_text_that_parses(spark, good, number, date):
    words = levels(100 - good, 100 - good, "word")
    numbers = [str(3 * (i % 40) + 7) for i in range(good)]
    days = [f"{i % 27 + 1:02d}.03.2021" for i in range(good)]
    got = roles_of(frame(spark, mixed=numbers + words, when_=days + words))
    assert got["mixed"] == number and got["when_"] == date


def test_borders_of_keys(spark):
    """Whole numbers are keys by uniqueness, fractions never, nor numbers with a gap."""
    spread_out = [i * i * 7 + 3 for i in range(200)]
    twice = [spread_out[i // 2] for i in range(200)]
    got = roles_of(frame(spark, amount_a=spread_out, amount_b=spread_out[:180] + spread_out[:20], amount_c=twice, amount_d=[v + 0.5 for v in spread_out], amount_e=[None, *spread_out[1:]]))
    assert got["amount_a"] == "identifier"
    assert [got[f"amount_{x}"] for x in "bcde"] == ["numeric"] * 4


def test_stored_kinds_and_marks(spark):
    import uuid

    marks = [str(uuid.UUID(int=i % 30 + 10**30)) for i in range(100)]
    half = marks[:50] + levels(50, 30, "x")
    got = roles_of(frame(spark, flag=cycle([True, False], 100), mark=marks, half=half))
    assert got["flag"] == "boolean" and got["mark"] == "identifier" and got["half"] != "identifier"
    dated = spark.createDataFrame([(i,) for i in range(50)], "i int").select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("i") % 9).alias("d"))
    assert roles_of(dated) == {"d": "datetime"}


def test_planted_grains(spark):
    """The smallest unique set of columns, the first of its size; columns with gaps never take part."""
    n = 210
    cols = {f"d{i}": levels(n, i + 2) for i in range(12)}
    df = frame(spark, **cols, row=[i // 14 for i in range(n)], seat=[i % 14 for i in range(n)], key=[i * 5 + 1 for i in range(n)], gap=[None, *range(1, n)])
    names = [*cols, "row", "seat"]
    assert contract.detect_grain(df, names) == ("row", "seat")
    assert contract.detect_grain(df, [*names, "gap", "key"]) == ("key",)
    assert contract.detect_grain(df, [*cols, "gap"][:6]) == () and contract.detect_grain(df, []) == ()
    assert contract.detect_grain(df.limit(0), names) == ()
    assert contract.detect_grain(df.union(df.limit(1)), [*names, "key"]) == ()


def test_contract_follows_the_roles(spark):
    """Every field has the lists of its kind; columns in another order make the same contract, under other names another."""
    n = 60
    df = frame(spark, parcel_no=[11 * i * i + 5 for i in range(n)], depot=levels(n, 6), toll_share=[0.015 * (i % 40) for i in range(n)], weight=[(7 * i) % 23 + 0.25 for i in range(n)], sealed=cycle([True, False, False], n))
    gate = clean.run_gate(df)
    spec, _ = contract.compile_contract(gate.df, roles.classify(gate.df), gate)
    for f in spec.fields.values():
        kind = "numeric_additive" if f.role == "numeric" and f.aggregation == "additive" else f.role
        assert (f.allowed_aggregations, f.allowed_charts) == (contract.ALLOWED_AGGREGATIONS[kind], contract.ALLOWED_CHARTS[kind]), f.name
        assert f.can_sum == ("sum" in f.allowed_aggregations and not f.is_ratio)
    assert spec.fields["parcel_no"].is_identifier and spec.fields["toll_share"].is_ratio and spec.grain == ("parcel_no",)

    def mark(d):
        g = clean.run_gate(d)
        return contract.compile_contract(g.df, roles.classify(g.df), g)[0].schema_fingerprint

    assert mark(df.select(*reversed(df.columns))) == spec.schema_fingerprint != mark(df.withColumnRenamed("depot", "yard"))


def test_money_text(spark):
    gate = clean.run_gate(frame(spark, fee=["$7,410.25", "(86)", "512", "$93", "(2,005.5)"]))
    assert sorted(r[0] for r in gate.df.collect()) == [-2005.5, -86.0, 93.0, 512.0, 7410.25]
    assert gate.manifest["coerced_numeric"] == ["fee"]


def test_placeholders_and_empty_rows(spark):
    gate = clean.run_gate(frame(spark, lake=["Traunsee", "null", "Attersee", "?", "--"], depth=[191, 60, 169, 12, 8]))
    assert gate.df.filter("lake is null").count() == 3 and gate.manifest["sentinels_nulled"] == {"lake": 3}
    gate = clean.run_gate(frame(spark, p=[None, 8, None, 5], q=[None, "m", None, "k"]))
    assert gate.manifest["dropped_null_rows"] == 2
    gate = clean.run_gate(frame(spark, p=[None, "#N/A", "nil"], q=["--", "none", None]))
    assert not gate.ok and "placeholder" in gate.reject_reason


def test_personal_data(spark):
    gate = clean.run_gate(frame(spark, contact=["post@mur.example", "office@inn.example"], total=[4, 7]))
    assert "EMAIL_ADDRESS" in gate.pii_columns["contact"] and gate.sensitivity == "sensitive" and gate.pii_blocked


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-10**8, 10**8), min_size=1, max_size=30))
def test_money_round_trip(spark, cents):
    texts = [f"(${abs(c) / 100:,.2f})" if c < 0 else f"${c / 100:,.2f}" for c in cents]
    got = clean.coerce_numeric(frame(spark, m=texts), ["m"]).collect()
    assert sorted(round(r[0] * 100) for r in got) == sorted(cents)


def test_every_sentinel(spark):
    tokens = [t for s in config.SENTINELS for t in (s, s.upper(), f" {s} ")]
    assert clean.null_sentinels(frame(spark, v=[*tokens, "kept"])).filter("v is not null").count() == 1


def test_total_rows(spark):
    df = frame(spark, region=["N", "S", "Total"], revenue=[10, 20, 30])
    assert clean.count_total_rows(df, ["region"]).first()[0] == 1


def test_vetoes(spark):
    df = frame(spark, txn=[float(1000 + 3 * i) for i in range(100)], amt=[1.5] * 100)
    assert [v["column"] for v in critic.critique(df, roles.classify(df))["vetoes"]] == ["txn"]
    ids = frame(spark, score_id=[1.5, 2.7, 3.9, 4.1, 5.5])
    forced = roles.classify(ids).withColumn("role", F.lit("identifier"))
    assert critic.role_vetoes(forced).first()["to_role"] == "numeric"


def test_total_and_share_flags(spark):
    df = frame(spark, a=[float(i % 7 + 1) for i in range(20)], b=[2.0 * (i % 5 + 1) for i in range(20)], total=[float(i % 7 + 1 + 2 * (i % 5 + 1)) for i in range(20)])
    assert critic.total_flag(df, ["a", "b", "total"]) == ["total", "a", "b"]
    shares = frame(spark, share_a=[0.3] * 15, share_b=[0.7] * 15)
    assert critic.share_sums(shares, ["share_a", "share_b"]).filter("target = 1").first()["close_share"] == 1.0


def test_collapse_and_ratio(spark):
    df = frame(spark, region=["N", "N", "S"], revenue=[100.0, 50.0, 30.0], win_rate=[0.4, 0.6, 0.5], k=[1, 2, 3])
    fields = {"region": contract.Field("region", "object", "categorical"), "revenue": contract.Field("revenue", "float", "numeric", aggregation="additive"),
              "win_rate": contract.Field("win_rate", "float", "ratio", aggregation="rate", is_ratio=True), "k": contract.Field("k", "int", "numeric")}
    got = {r["region"]: r for r in calc.collapse_to_grain(df, contract.Contract("", fields=fields), ["region"], "k").collect()}
    assert got["N"]["revenue"] == 150 and got["N"]["win_rate"] == pytest.approx(0.5)
    r = frame(spark, n=[1.0, 99.0], d=[10.0, 100.0])
    assert calc.ratio_of_sums(r, "n", "d").first()[0] == pytest.approx(100 / 110)
    assert calc.ratio_of_sums(frame(spark, n=[1.0], d=[0.0]), "n", "d").first()[0] == 0.0


@pytest.fixture(scope="module")
def table(spark):
    df = frame(spark, region=cycle(list("NSEW"), 36), revenue=cycle(["$100.00", "$250.00", "$320.00", "$90.00"], 36),
               margin_pct=[round(0.1 * (i % 5), 3) for i in range(36)], units=cycle([3, 7, 12, 5], 36))
    gate = clean.run_gate(df)
    spec, _ = contract.compile_contract(gate.df, roles.classify(gate.df), gate)
    return gate.df, spec


def test_interaction(table):
    df, spec = table
    run = lambda **s: interact.run_interaction(df, spec, s)
    out = run(calculation="column_stat", params={"column": "units", "metric": "mean"}, filters=[{"column": "region", "op": "eq", "value": "N"}])
    assert out["status"] == "ok" and out["rows_after"] == 9 and out["result"][0]["value"] == 3
    got = filters.apply_filters(df, [{"column": "units", "op": "between", "value": [6, 13]}])
    assert {r["units"] for r in got.collect()} == {7, 12}
    assert run(calculation="column_stat", params={"column": "margin_pct", "metric": "sum"})["status"] == "error"
    assert run(calculation="column_stat", params={"column": "nope"})["status"] == "error"
    assert run(calculation="magic")["status"] == "error"
    assert run(calculation="column_stat", params={"column": "units"}, filters=[{"column": "region", "op": "eq", "value": "Z"}])["status"] == "empty"
    assert run(calculation="column_stat", params={"column": "units"}, filters=[{"column": "zz", "op": "eq", "value": 1}])["status"] == "error"
    a, b = {"column": "region", "op": "eq", "value": "N"}, {"column": "units", "op": "gt", "value": 1}
    key = interact.InteractionMemo.key
    assert key("f", {"calculation": "x", "filters": [a, b]}) == key("f", {"calculation": "x", "filters": [b, a]})
    memo = interact.InteractionMemo(1)
    spec_ = {"calculation": "filter_count", "params": {"column": "region", "op": "==", "value": "N"}}
    assert not memo.run("f", df, spec, spec_)["cached"] and memo.run("f", df, spec, spec_)["cached"]


def test_questions(spark, table):
    df, spec = table
    asked = ["What is the average units?", "total revenue by region", "how many region rows", "top region", "correlation of units and revenue"]
    q = spark.createDataFrame(list(enumerate(asked)), "id int, text string")
    got = {r["id"]: r for r in interact.answer_questions(df, spec, q, "text").collect()}
    assert got[0]["tool"] == "column_stat" and got[0]["metric"] == "mean" and "6.75" in got[0]["answer"]
    assert got[1]["tool"] == "aggregate" and got[1]["metric"] == "sum" and "E=2,880" in got[1]["answer"]
    assert got[2]["metric"] == "count" and got[3]["tool"] == "top_categories" and got[4]["tool"] == "correlation"
    assert all(r["status"] == "ok" for r in got.values())


def test_dashboard_and_override(spark):
    df = frame(spark, order_id=[f"O{i}" for i in range(60)], region=cycle(list("NSEW"), 60), sales_amount=[float(10 + i % 13) for i in range(60)], cost=[float(20 + 2 * (i % 13)) for i in range(60)])
    out = dashboard.build_dashboard(spark, df=df)
    assert not out.errors and out.quality["status"] == "ok" and out.contract.locked
    assert out.insights and out.insights[0]["strength"] == "strong"
    assert {c["intent"] for c in out.charts} >= {"category_count", "distribution", "scatter"}
    ov = spark.createDataFrame([("cost", "identifier", None, None)], "name string, role string, domain string, sensitivity string")
    new = dashboard.rebuild(out, ov)
    assert new.contract.version == out.contract.version + 1 and new.contract.fields["cost"].is_identifier and not new.insights


def test_contract_is_kept_and_reused(spark, tmp_path):
    from tabwise.sources.stores import ContractStore

    store = ContractStore(spark, str(tmp_path))
    made = lambda n: frame(spark, order_id=[f"O{i}" for i in range(n)], region=cycle(list("NSEW"), n), sales_amount=[float(10 + i % 13) for i in range(n)], cost=[float(20 + 2 * (i % 13)) for i in range(n)])
    df = made(60)
    first = dashboard.build_dashboard(spark, df=df, contracts=store, now=1.0)
    assert not first.quality["reused_contract"] and store.locked(first.contract.schema_fingerprint) == first.contract
    ov = spark.createDataFrame([("cost", "identifier", None, None)], "name string, role string, domain string, sensitivity string")
    store.save(dashboard.rebuild(first, ov).contract, 2.0)
    again = dashboard.build_dashboard(spark, df=made(70), contracts=store, now=3.0)
    assert again.quality["reused_contract"] and again.contract.version == 2 and again.contract.n_rows == 70
    assert again.contract.fields["cost"].is_identifier and not again.insights
    assert all("cost" not in (c.get("x_field"), c.get("y_field")) for c in again.charts)
    first.release()
    assert not first.df.is_cached


def test_arbitration_and_standard_charts(spark):
    df = frame(spark, order_id=[f"O{i}" for i in range(60)], region=cycle(list("NSEW"), 60), amount=[float(i % 13) for i in range(60)])
    said = spark.createDataFrame([("region", "text"), ("order_id", "numeric"), ("amount", "nonsense")], "name string, role string")
    out = dashboard.build_dashboard(spark, df=df, suggestions=said)
    assert out.quality["arbitrated"] == [{"name": "region", "old_role": "categorical", "role": "text"}]
    roles_ = {r["name"]: r["role"] for r in out.profile.collect()}
    assert roles_["region"] == "text" and roles_["order_id"] == "identifier"
    assert out.charts and all("data" in c for c in out.charts)


def test_number_text(spark):
    from tabwise.functions import text as tx

    values = [0.0, 1.0, -2.5, 12345678.9, 1e7, 123456789012345.0, 9007199254740991.0, 1e16, 1.5e22, 0.001, 0.0004, 0.000123456789, 0.00001, 2.5e-9, -3e-5, 1e-320]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(tx.number_text(F.col("x"))).collect()]
    assert got == [str(v) for v in values]
    big = spark.createDataFrame([(12345678.9,), (1.0,)], "x double")
    assert big.filter(filters.predicate(big, {"column": "x", "op": "eq", "value": 12345678.9})).count() == 1


def test_dates_as_text(spark):
    from tabwise.functions import text as tx
    from tabwise.operators import charts

    for layout in ("%Y-%m-%d", "%d/%m/%Y", "%Y-%m-%dT%H:%M:%S"):
        import datetime

        days = [datetime.date(2022, 1, 1) + datetime.timedelta(days=i) for i in range(40)]
        df = spark.createDataFrame([(d.strftime(layout), float(i)) for i, d in enumerate(days)], "day string, sales double")
        series = charts.time_series(df, "day", "sales")
        assert [r["date"].date() for r in series.orderBy("date").collect()] == days
    out = dashboard.build_dashboard(spark, df=df.unionByName(df.withColumn("sales", F.col("sales") * 3 + 1)))
    assert not out.errors and any(c["intent"] == "time_series" for c in out.charts)


def test_failing_chart_stays_alone(spark):
    from tabwise.operators import charts

    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 5.0)], "k string, v double")
    failed = []
    good = charts.build_charts(df, [dict(id=1, intent="time_series", x_field="v", y_field="k"), dict(id=2, intent="category_count", x_field="k")], failed=failed)
    assert [c["id"] for c in good] == [2] and [f["id"] for f in failed] in ([1], [])


def test_wide_profile_and_small_columns(spark):
    from tabwise.operators import profile, stats

    wide = spark.createDataFrame([tuple(range(60)), tuple(range(1, 61))], ", ".join(f"c{i} long" for i in range(60)))
    assert profile.column_counts(wide).count() == 60
    sparse = spark.createDataFrame([(float(i), float(i * i) if i < 12 else None) for i in range(40)], "a double, b double")
    found = {r["name"]: (r["test"], r["normality_p"]) for r in stats.distributions(sparse, ["a", "b"]).collect()}
    assert found["a"][0] == "dagostino_k2" and found["b"][0] == "shapiro" and found["b"][1] is not None


def test_refused_targets_and_boxes(spark):
    from tabwise.operators import charts, supervised

    many = spark.createDataFrame([(i, f"k{i % 15}", float(i % 3), float(i * 7 % 31)) for i in range(300)], "id long, cls string, y double, x double")
    for target, task, reason in (("cls", "classification", "too-many-classes"), ("y", "regression", "degenerate-target")):
        assert supervised.driver_report(many, target, task, ["x"], [], ["id"])["reason"] == reason
    crowd = spark.createDataFrame([(str(i), float(i)) for i in range(10_500)], "k string, v double")
    assert charts.box_summary(crowd, "k", "v").count() == 0
