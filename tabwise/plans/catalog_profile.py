"""Queries: profile, calculations, filters, cleaning."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tabwise.functions import text as tx
from tabwise.operators import calc, charts, clean, contract, filters, ordering, profile, relate
from tabwise.plans import interact
from tabwise.plans.catalog import fields_of, load, query, rounded, sql_union, union_all
from tabwise.sources import readers, stores

LINE_NUMS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


# ---------------------------------------------------------------- profile


@query(
    "a1_profile_numeric",
    sql_union(
        f"""SELECT '{c}' AS name, count({c}) AS count, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25,
        round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75, round(sum({c}::DOUBLE), 2) AS sum, round(var_samp({c}), 2) AS variance FROM lineitem"""
        for c in LINE_NUMS
    ),
)
def a1(spark, d):
    out = profile.numeric_profile(load(spark, d, "lineitem"), LINE_NUMS).drop("int_like")
    return rounded(out, mean=4, std=4, median=4, q25=4, q75=4, sum=2, variance=2)


@query(
    "a2_counts",
    sql_union(
        f"SELECT '{c}' AS name, count(*) - count({c}) AS null_count, count({c}) AS count, count(DISTINCT {c}) AS unique_count FROM events" for c in EVENT_COLS
    ),
)
def a2(spark, d):
    return profile.column_counts(load(spark, d, "events"))


@query(
    "a3_top_values",
    sql_union(
        f"""SELECT '{c}' AS name, value, cnt, rank FROM (SELECT {c}::VARCHAR AS value, count(*) AS cnt,
        row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) AS rank FROM orders WHERE {c} IS NOT NULL GROUP BY 1, {c}) WHERE rank <= 10"""
        for c in ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]
    ),
)
def a3(spark, d):
    return profile.top_values(load(spark, d, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"])


@query("a18_grain", "SELECT 'orders' AS tbl, 'o_orderkey' AS grain WHERE (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) "
       "UNION ALL SELECT 'events', 'event_id' WHERE (SELECT count(*) = count(DISTINCT event_id) FROM events)")
def a18(spark, d):
    found = []
    for table, dims in (("orders", ["o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]), ("events", ["event_id", "ts", "event_type"]),
                        ("lineitem", ["l_returnflag", "l_linestatus", "l_shipdate"])):
        g = contract.detect_grain(load(spark, d, table), dims)
        if g:
            found.append((table, ",".join(g)))
    return spark.createDataFrame(found, "tbl string, grain string")


@query("a18_grain_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a18_dup(spark, d):
    return contract.grain_duplicates(load(spark, d, "lineitem"), ("l_orderkey", "l_linenumber"))


@query(
    "w9_sequence",
    sql_union(
        f"""SELECT '{c}' AS name, count(*) + 1 AS n, count(DISTINCT g) AS distinct_diffs, round(avg(g), 6) AS mean_diff, round(stddev_samp(g), 6) AS std_diff,
        count(*) + 1 > 5 AND count(DISTINCT g) = 1 AND abs(avg(g) - 1) < 0.01 AS step1,
        count(*) + 1 > 5 AND count(DISTINCT g) <= 3 AND stddev_samp(g) < avg(g) * 0.1 AS low_variance
        FROM (SELECT {c}::DOUBLE - lag({c}::DOUBLE) OVER (ORDER BY {c}) AS g FROM {t}) WHERE g IS NOT NULL"""
        for t, c in (("orders", "o_orderkey"), ("orders", "o_custkey"))
    ),
)
def w9(spark, d):
    return rounded(profile.sequence_signal(load(spark, d, "orders"), ["o_orderkey", "o_custkey"]), mean_diff=6, std_diff=6)


@query(
    "w10_average_ranks",
    """SELECT 'l_quantity' AS name, l_quantity AS value, count(*) AS cnt, sum(count(*)) OVER (ORDER BY l_quantity) - count(*) + (count(*) + 1) / 2.0 AS rank
    FROM lineitem GROUP BY l_quantity UNION ALL SELECT 'l_extendedprice', l_extendedprice, count(*), sum(count(*)) OVER (ORDER BY l_extendedprice) - count(*) + (count(*) + 1) / 2.0
    FROM lineitem GROUP BY l_extendedprice""",
)
def w10(spark, d):
    out = ordering.average_ranks(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.withColumn("rank", F.col("rank").cast("double"))


# ---------------------------------------------------------------- calculations


@query(
    "a5_column_stat",
    sql_union(
        f"SELECT '{c}' AS column, '{m}' AS metric, round({e}, 4) AS value, 'L1.{c}.{m}' AS token FROM lineitem"
        for c, m, e in (
            ("l_extendedprice", "mean", "avg(l_extendedprice)"), ("l_extendedprice", "median", "quantile_cont(l_extendedprice, 0.5)"),
            ("l_extendedprice", "min", "min(l_extendedprice)"), ("l_extendedprice", "max", "max(l_extendedprice)"),
            ("l_extendedprice", "std", "stddev_samp(l_extendedprice)"), ("l_returnflag", "count", "count(l_returnflag)::DOUBLE"),
            ("l_quantity", "sum", "sum(l_quantity)"),
        )
    ),
)
def a5(spark, d):
    df, c = load(spark, d, "lineitem"), fields_of(spark, d, "lineitem")
    asked = [("l_extendedprice", m) for m in ("mean", "median", "min", "max", "std")] + [("l_returnflag", "count"), ("l_quantity", "sum")]
    return rounded(union_all(calc.column_stat(df, c, col, m) for col, m in asked), value=4)


@query(
    "a6_aggregate",
    sql_union(
        f"""SELECT * FROM (SELECT l_returnflag AS "group", round({e}, 4) AS value, 'agg.l_returnflag.{m}{p}' AS token FROM lineitem
        WHERE l_shipdate IS NOT NULL AND l_quantity BETWEEN 10 AND 40 AND l_linestatus = 'F' AND l_returnflag IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)"""
        for m, e, p in (
            ("sum", "sum(l_quantity)", "(l_quantity)"), ("mean", "avg(l_quantity)", "(l_quantity)"), ("median", "quantile_cont(l_quantity, 0.5)", "(l_quantity)"),
            ("min", "min(l_quantity)", "(l_quantity)"), ("max", "max(l_quantity)", "(l_quantity)"), ("count", "count(*)::DOUBLE", ""),
        )
    ),
)
def a6(spark, d):
    c = fields_of(spark, d, "lineitem")
    df = filters.apply_filters(load(spark, d, "lineitem"), [{"column": "l_quantity", "op": "between", "value": [10, 40]}, {"column": "l_linestatus", "op": "eq", "value": "F"}])
    return rounded(union_all(calc.aggregate(df, c, "l_returnflag", "l_quantity", m) for m in ("sum", "mean", "median", "min", "max", "count")), value=4)


@query(
    "a6_aggregate_top20",
    """SELECT l_shipdate::DATE::VARCHAR || ' 00:00:00' AS "group", round(sum(l_quantity), 2) AS value, 'agg.l_shipdate.sum(l_quantity)' AS token
    FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def a6_top(spark, d):
    return rounded(calc.aggregate(load(spark, d, "lineitem"), fields_of(spark, d, "lineitem"), "l_shipdate", "l_quantity", "sum"), value=2)


@query("a7_top_categories", "SELECT coalesce(p_name, 'None') AS value, count(*) AS count, 'L1.p_name.top_categories' AS token FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def a7(spark, d):
    return calc.top_categories(load(spark, d, "part"), fields_of(spark, d, "part"), "p_name", 40)


@query("t2_correlation", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 8) AS pearson, count(*) AS n, 'L3.correlation.l_quantity|l_extendedprice' AS token FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def t2(spark, d):
    return rounded(calc.correlation(load(spark, d, "lineitem"), fields_of(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), pearson=8)


_COUNTS = (("l_quantity", ">", 25, "l_quantity > 25"), ("l_quantity", ">=", 25, "l_quantity >= 25"), ("l_discount", "<", 0.05, "l_discount < 0.05"),
           ("l_discount", "<=", 0.05, "l_discount <= 0.05"), ("l_returnflag", "==", "A", "l_returnflag = 'A'"), ("l_returnflag", "!=", "A", "coalesce(l_returnflag, 'None') <> 'A'"))


@query(
    "c10_filter_count",
    sql_union(
        f"SELECT '{c}' AS column, '{o}' AS op, '{float(v) if o in ('>', '>=', '<', '<=') else v}' AS value, count_if({e}) AS count, 'filter.{c}{o}{float(v) if o in ('>', '>=', '<', '<=') else v}' AS token FROM lineitem"
        for c, o, v, e in _COUNTS
    ),
)
def c10(spark, d):
    df, c = load(spark, d, "lineitem"), fields_of(spark, d, "lineitem")
    return union_all(calc.filter_count(df, c, col, op, v) for col, op, v, _ in _COUNTS)


@query(
    "c9_filters_all_ops",
    """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus IN ('O','P') AND o_orderpriority <> '5-LOW' AND o_orderpriority NOT IN ('1-URGENT')
    AND o_totalprice > 100000 AND o_totalprice <= 400000 AND o_custkey >= 100 AND o_custkey < 1400 AND o_orderkey BETWEEN 10 AND 14000 AND o_orderstatus::VARCHAR = 'O'""",
)
def c9(spark, d):
    specs = [
        {"column": "o_orderstatus", "op": "in", "value": ["O", "P"]}, {"column": "o_orderpriority", "op": "neq", "value": "5-LOW"},
        {"column": "o_orderpriority", "op": "nin", "value": ["1-URGENT"]}, {"column": "o_totalprice", "op": "gt", "value": 100000},
        {"column": "o_totalprice", "op": "lte", "value": "400000"}, {"column": "o_custkey", "op": "gte", "value": 100},
        {"column": "o_custkey", "op": "lt", "value": 1400}, {"column": "o_orderkey", "op": "between", "value": [10, 14000]},
        {"column": "o_orderstatus", "op": "eq", "value": "O"},
    ]
    return filters.apply_filters(load(spark, d, "orders"), specs).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("c9_null_as_text", """SELECT count_if(coalesce(v::VARCHAR, 'None') <> 'A') AS neq_rows, count_if(coalesce(v, 'None') NOT IN ('N', 'R')) AS nin_rows, count_if(v = 'A') AS eq_rows
    FROM (SELECT CASE WHEN l_linenumber <> 3 THEN l_returnflag END AS v FROM lineitem)""")
def c9_null(spark, d):
    df = load(spark, d, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("v"))
    p = lambda op, value: F.count_if(filters.predicate(df, {"column": "v", "op": op, "value": value}))
    return df.agg(p("neq", "A").alias("neq_rows"), p("nin", ["N", "R"]).alias("nin_rows"), p("eq", "A").alias("eq_rows"))


@query(
    "k10_interaction",
    """SELECT event_type AS "group", round(avg(value), 6) AS value, 'agg.event_type.mean(value)' AS token,
    'derived:agg.event_type.mean(value)#' || substr(sha256('agg.event_type.mean(value)|' ||
    '{"calculation": "aggregate", "filters": [{"column": "event_type", "op": "neq", "value": "view"}, {"column": "value", "op": "gte", "value": 5}], "params": {"agg": "mean", "group_by": "event_type", "value": "value"}}'), 1, 16) AS derived_token
    FROM events WHERE event_type <> 'view' AND value >= 5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def k10(spark, d):
    spec = {
        "calculation": "aggregate", "params": {"group_by": "event_type", "value": "value", "agg": "mean"},
        "filters": [{"column": "value", "op": "gte", "value": 5}, {"column": "event_type", "op": "neq", "value": "view"}],
    }
    return rounded(interact.plan_interaction(load(spark, d, "events"), fields_of(spark, d, "events"), spec), value=6)


@query("a17_ratio", "SELECT l_returnflag, round(coalesce(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 0), 10) AS ratio FROM lineitem GROUP BY 1")
def a17(spark, d):
    df = load(spark, d, "lineitem").select("l_returnflag", (F.col("l_extendedprice") * F.col("l_discount")).alias("n"), F.col("l_extendedprice").alias("p"))
    return rounded(calc.ratio_of_sums(df, "n", "p", ("l_returnflag",)), ratio=10)


@query(
    "a16_collapse",
    """SELECT l_shipdate, round(avg(l_orderkey), 6) AS l_orderkey, round(avg(l_partkey), 6) AS l_partkey, round(avg(l_suppkey), 6) AS l_suppkey, round(avg(l_linenumber), 6) AS l_linenumber,
    round(sum(l_quantity), 2) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice, round(sum(l_discount), 4) AS l_discount, round(sum(l_tax), 4) AS l_tax,
    arg_min(l_returnflag, l_extendedprice * 1000 + l_orderkey / 100000.0) AS l_returnflag, arg_min(l_linestatus, l_extendedprice * 1000 + l_orderkey / 100000.0) AS l_linestatus
    FROM lineitem GROUP BY l_shipdate""",
)
def a16(spark, d):
    df = load(spark, d, "lineitem").withColumn("_ord", F.col("l_extendedprice") * 1000 + F.col("l_orderkey") / F.lit(100000.0))
    out = calc.collapse_to_grain(df, fields_of(spark, d, "lineitem"), ["l_shipdate"], "_ord").drop("_ord")
    return rounded(out, l_orderkey=6, l_partkey=6, l_suppkey=6, l_linenumber=6, l_quantity=2, l_extendedprice=6, l_discount=4, l_tax=4)


# ---------------------------------------------------------------- cleaning


_STRIP = lambda c: f"regexp_replace(regexp_replace(trim({c}), '^\\((.*)\\)$', '-\\1'), '[^0-9.eE-]', '', 'g')"
_NUMRE = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'"


@query(
    "c2_coerce_rate",
    sql_union(
        f"""SELECT '{c}' AS name, count({c}) AS non_null, count_if(regexp_matches({c}, '[0-9]')) AS with_digit,
        count_if(regexp_matches({_STRIP(c)}, {_NUMRE})) AS "numeric", count_if(regexp_matches({_STRIP(c)}, '^[+-]?[0-9]+$')) AS plain_int,
        count_if(regexp_matches({c}, '[0-9]')) > 0 AND count_if(regexp_matches({_STRIP(c)}, {_NUMRE})) >= 0.95 * count({c}) AS coerced FROM {t}"""
        for t, c in (("part", "p_name"), ("part", "p_brand"), ("part", "p_type"))
    ),
)
def c2(spark, d):
    return clean.coercible(clean.coercion_rates(load(spark, d, "part")))


@query("c2_coerced_values", f"SELECT event_id, try_cast({_STRIP('props')} AS BIGINT) AS props, try_cast({_STRIP('money')} AS DOUBLE) AS money FROM "
       "(SELECT event_id, props, CASE WHEN user_id % 2 = 0 THEN '$' || value ELSE '(' || value || ')' END AS money FROM events)")
def c2_values(spark, d):
    v = F.col("value").cast("string")
    money = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("$"), v)).otherwise(F.concat(F.lit("("), v, F.lit(")")))
    df = load(spark, d, "events").select("event_id", "props", money.alias("money"))
    return clean.coerce_numeric(df, ["props", "money"], ["props"])


_DIRTY = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN ' N/A' WHEN o_orderkey % 11 = 0 THEN 'Unknown' ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE o_orderstatus END AS status FROM orders"""
_SENT = "('na','n/a','nan','null','none','nil','-','--','?','#n/a','#na','#value!','#ref!','unknown','not available')"


def _dirty(spark, d, key=True):
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select(
        *([k] if key else []),
        F.when(k % 7 == 0, " N/A").when(k % 11 == 0, "Unknown").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(k % 5 == 0, "-").otherwise(F.col("o_orderstatus")).alias("status"),
    )


@query("c3_sentinels", f"SELECT o_orderkey, CASE WHEN lower(trim(priority)) NOT IN {_SENT} THEN priority END AS priority, CASE WHEN lower(trim(status)) NOT IN {_SENT} THEN status END AS status FROM ({_DIRTY})")
def c3(spark, d):
    return clean.null_sentinels(_dirty(spark, d))


@query("c4_null_rows", f"SELECT priority, status, count(*) AS n FROM (SELECT CASE WHEN lower(trim(priority)) NOT IN {_SENT} THEN priority END AS priority, CASE WHEN lower(trim(status)) NOT IN {_SENT} THEN status END AS status FROM ({_DIRTY})) WHERE priority IS NOT NULL OR status IS NOT NULL GROUP BY ALL")
def c4(spark, d):
    return clean.drop_null_rows(clean.null_sentinels(_dirty(spark, d, key=False))).groupBy("priority", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c8_manifest",
    f"""SELECT count(*) AS original_rows, count_if(NOT e) AS cleaned_rows, count_if(e) AS dropped_null_rows, 0::BIGINT AS coerced_columns,
    sum(a::INT + b::INT)::BIGINT AS sentinels_nulled FROM (SELECT lower(trim(priority)) IN {_SENT} AS a, lower(trim(status)) IN {_SENT} AS b, a AND b AS e FROM ({_DIRTY}))""",
)
def c8(spark, d):
    return clean.manifest_counts(_dirty(spark, d, key=False))


@query(
    "c8_gate_manifest",
    f"""SELECT count(*) AS original_rows, 2::INT AS original_cols, count_if(NOT e) AS cleaned_rows, 2::INT AS cleaned_cols, 0::INT AS coerced,
    sum(a::INT)::BIGINT AS priority_nulled, sum(b::INT)::BIGINT AS status_nulled, count_if(e) AS dropped_null_rows
    FROM (SELECT lower(trim(priority)) IN {_SENT} AS a, lower(trim(status)) IN {_SENT} AS b, a AND b AS e FROM ({_DIRTY}))""",
)
def c8_gate(spark, d):
    """The manifest that a run of the gate returns."""
    found = clean.manifest_table(spark, clean.run_gate(_dirty(spark, d, key=False)).manifest)
    nulled = [F.col("sentinels_nulled")[c].alias(f"{c}_nulled") for c in ("priority", "status")]
    return found.select("original_rows", "original_cols", "cleaned_rows", "cleaned_cols", F.size("coerced_numeric").alias("coerced"), *nulled, "dropped_null_rows")


# the same patterns; the SQL engine has no look-around, so the phone pattern takes its neighbours along
_PII = {**tx.PII_PATTERNS, "PHONE_NUMBER": r"(?:^|[^0-9])" + tx.PII_PATTERNS["PHONE_NUMBER"].removeprefix(r"(?<!\d)").removesuffix(r"(?!\d)") + r"(?:[^0-9]|$)"}


def _pii_sql(table, col):
    found = ", ".join(f"CASE WHEN bool_or(regexp_matches({col}, '{p}')) THEN '{e}' END" for e, p in _PII.items())
    return f"SELECT '{table}.{col}' AS name, array_to_string(list_sort([x for x in [{found}] if x IS NOT NULL]), ',') AS entities FROM {table}"


@query("c6_pii", f"SELECT * FROM ({sql_union([_pii_sql('documents', 'text'), _pii_sql('documents', 'source'), _pii_sql('conversations', 'text'), _pii_sql('customer', 'c_name')])}) WHERE entities <> ''")
def c6(spark, d):
    parts = []
    for table, cols in (("documents", ["text", "source"]), ("conversations", ["text"]), ("customer", ["c_name"])):
        hits = clean.pii_hits(load(spark, d, table), cols)
        parts.append(hits.select(F.concat(F.lit(f"{table}."), "name").alias("name"), F.array_join("entities", ",").alias("entities")))
    return union_all(parts)


@query(
    "c1_wide_years",
    "SELECT c_nationkey, (1995 + k)::INT AS \"Year\", n AS \"Value\" FROM (SELECT c_nationkey, k, count(o_orderkey) FILTER (WHERE year(o_orderdate) = 1995 + k) AS n FROM customer JOIN orders ON o_custkey = c_custkey, range(7) t(k) GROUP BY ALL)",
)
def c1(spark, d):
    joined = load(spark, d, "customer").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    wide = joined.groupBy("c_nationkey").agg(*[F.count_if(F.year("o_orderdate") == y).alias(f"col_{y}") for y in range(1995, 2002)])
    return clean.reshape_wide_years(wide)


@query("c16_finite", "SELECT event_id, x FROM (SELECT event_id, value / nullif(user_id % 10, 0) AS x FROM events) WHERE x IS NOT NULL")
def c16(spark, d):
    x = F.when(F.col("user_id") % 10 == 0, F.lit(float("inf"))).otherwise(F.col("value") / (F.col("user_id") % 10))
    df = load(spark, d, "events").select("event_id", x.alias("raw"))
    return df.select("event_id", tx.finite(F.col("raw")).alias("x")).filter("x is not null")


@query("c17_null_text", "SELECT v AS category, count(*) AS count FROM (SELECT CASE WHEN o_custkey % 3 = 0 THEN 'nan' WHEN o_custkey % 7 = 0 THEN '<NA>' ELSE o_orderstatus END AS v FROM orders) WHERE v NOT IN ('<NA>','nan','NaN','None') GROUP BY 1")
def c17(spark, d):
    v = F.when(F.col("o_custkey") % 3 == 0, "nan").when(F.col("o_custkey") % 7 == 0, "<NA>").otherwise(F.col("o_orderstatus"))
    df = load(spark, d, "orders").select(tx.null_text_to_null(v).alias("category")).filter("category is not null")
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("count"))


@query("c18_total_rows", r"SELECT count_if(regexp_matches(a, '(?i)^\s*(grand\s+total|sub\s*total|subtotal|total|totals|all|sum|average|avg|mean)\s*$') OR regexp_matches(b, '(?i)^\s*(grand\s+total|sub\s*total|subtotal|total|totals|all|sum|average|avg|mean)\s*$')) AS aggregate_rows FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN ' Grand  Total ' ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 75 = 0 THEN 'AVG' ELSE o_orderpriority END AS b FROM orders)")
def c18(spark, d):
    k = F.col("o_orderkey")
    df = load(spark, d, "orders").select(F.when(k % 50 == 0, " Grand  Total ").otherwise(F.col("o_orderstatus")).alias("a"), F.when(k % 75 == 0, "AVG").otherwise(F.col("o_orderpriority")).alias("b"))
    return clean.count_total_rows(df, ["a", "b"])


@query("c12_exclusions", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def c12(spark, d):
    flagged = load(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return filters.exclude_rows(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), flagged, ["o_custkey"])


@query("c11_client_filter", "SELECT category, count FROM (SELECT p_type AS category, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) WHERE count >= 10 AND category <> 'ECONOMY'")
def c11(spark, d):
    bars = charts.pie(load(spark, d, "part"), "p_type").withColumnRenamed("value", "count")
    return filters.apply_filters(bars, [{"column": "count", "op": "gte", "value": 10}, {"column": "category", "op": "neq", "value": "ECONOMY"}])


@query("c13_highlight", "SELECT l_returnflag AS category, count(*) AS count, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.22 END AS opacity FROM lineitem GROUP BY 1")
def c13(spark, d):
    bars = load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("category")).agg(F.count(F.lit(1)).alias("count"))
    return bars.withColumn("opacity", filters.highlight_opacity(F.col("category"), "R").cast("double"))


@query("j1_alignment", "SELECT l_quantity AS x, l_extendedprice AS y FROM (SELECT CASE WHEN l_linenumber <> 2 THEN l_quantity END AS l_quantity, CASE WHEN l_suppkey % 9 <> 0 THEN l_extendedprice END AS l_extendedprice FROM lineitem) WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def j1(spark, d):
    df = load(spark, d, "lineitem").select(F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("a"), F.when(F.col("l_suppkey") % 9 != 0, F.col("l_extendedprice")).alias("b"))
    return relate.aligned(df, "a", "b")


@query(
    "j6_star_flatten",
    """SELECT n_name, p_brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def j6(spark, d):
    t = lambda n: load(spark, d, n)
    # Spark broadcasts the dimension tables by their measured size and shuffles them when they outgrow it
    flat = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return rounded(flat.groupBy("n_name", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")), quantity=2)


# ---------------------------------------------------------------- sources


@query("s4_parquet_scan", "SELECT * FROM orders")
def s4(spark, d):
    return readers.load_table(spark, f"{d.rstrip('/')}/orders.parquet").df


@query("s8_column_names", "SELECT c_custkey AS \"Cust_Key\", c_name AS c_name_x, c_nationkey AS unnamed_col_0, c_acctbal AS \"acct_bal\", c_mktsegment AS unnamed_col_1 FROM customer")
def s8(spark, d):
    return readers.normalize_columns(load(spark, d, "customer").toDF(" Cust Key", "c-name-x", "Unnamed: 2", "acct bal", "_c4"))


@query("s9_hash_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 500")
def s9(spark, d):
    return readers.hash_sample(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 500)


@query("s10_probe", "SELECT 'lineitem' AS tbl, count(*) AS rows, 11::BIGINT AS columns FROM lineitem UNION ALL SELECT 'documents', count(*), 5 FROM documents")
def s10(spark, d):
    rows = [(t, *(readers.probe(spark, f"{d.rstrip('/')}/{t}.parquet")[k] for k in ("rows", "columns"))) for t in ("lineitem", "documents")]
    return spark.createDataFrame(rows, "tbl string, rows long, columns long")


@query("s11_markup", "SELECT page_id, lower(ltrim(substr(html, 1, 4096), ' \t\n\r')) LIKE '<!doctype%' OR lower(ltrim(substr(html, 1, 4096), ' \t\n\r')) LIKE '<html%' OR ltrim(substr(html, 1, 4096), ' \t\n\r') LIKE '<?xml%' AS is_markup FROM pages "
       "UNION ALL SELECT -1 - doc_id, lower(ltrim(text, ' \t\n\r')) LIKE '<!doctype%' OR lower(ltrim(text, ' \t\n\r')) LIKE '<html%' OR ltrim(text, ' \t\n\r') LIKE '<?xml%' FROM documents")
def s11(spark, d):
    pages = load(spark, d, "pages").select("page_id", F.col("html").alias("body"))
    docs = load(spark, d, "documents").select((-1 - F.col("doc_id")).alias("page_id"), F.col("text").alias("body"))
    return readers.markup_rows(pages.unionByName(docs), "body").select("page_id", "is_markup")


@query("s13_latest_per_key", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def s13(spark, d):
    return stores.latest_per_key(load(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"]).drop("ts")


@query("s13_history", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events WHERE ts + INTERVAL 20 DAY > TIMESTAMP '2024-01-31') WHERE rn <= 50")
def s13_history(spark, d):
    rec = load(spark, d, "events").withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 20 DAYS"))
    alive = stores.live(rec, datetime(2024, 1, 31))
    return stores.newest_per_owner(alive, "user_id", "ts", "event_id").select("user_id", "event_id", "ts")


@query("c14_affected_charts", "SELECT DISTINCT 'ts_' || event_type AS id FROM events UNION ALL SELECT DISTINCT 'bar_' || o_orderstatus FROM orders WHERE false")
def c14(spark, d):
    a = load(spark, d, "events").select(F.concat(F.lit("ts_"), "event_type").alias("id"), F.lit("ts").alias("x_column"), F.lit("value").alias("y_column"), F.lit(None).cast("string").alias("column"))
    b = load(spark, d, "orders").select(F.concat(F.lit("bar_"), "o_orderstatus").alias("id"), F.lit("o_orderstatus").alias("x_column"), F.lit(None).cast("string").alias("y_column"), F.lit(None).cast("string").alias("column"))
    return filters.affected_charts(a.unionByName(b).distinct(), ["value"]).select("id")
