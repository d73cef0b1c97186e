"""Queries: names, roles, contracts, critic, overrides, KPIs, specs, question routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwise.functions import text as tx
from tabwise.operators import calc, clean, contract, critic, eda, filters, forecast, profile, roles, stats, supervised
from tabwise.plans import interact
from tabwise.plans.catalog import fields_of, load, profile_of, query, rounded, sql_union, union_all
from tabwise.plans.dashboard import quality_report

# ---------------------------------------------------------------- the role rules once more, in SQL

_NUMRE = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_TOKENS = r"regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z]+', ' ', 'g')"
_WORD = lambda words: f"regexp_matches({_TOKENS}, '(?i)(^|[^a-zA-Z])({'|'.join(words)})([^a-zA-Z]|$)')"
_IS_RATE = f"({_WORD(tx.RATE_WORDS)} OR regexp_matches(name, '{tx.RATE_SUFFIX}'))"
_IS_ADD = f"({_WORD(tx.ADDITIVE_WORDS)} OR regexp_matches(name, '{tx.ADDITIVE_SUFFIX}'))"
_YEAR_NAME = r"regexp_matches(name, '(?i)(^|[^a-zA-Z])(year|yr|fy|fiscal_year)([^a-zA-Z]|$)')"
_RATIO_NAME = f"regexp_matches(name, '{tx.RATIO_NAME}')"
_ID_HITS = " + ".join(f"(contains(lower(name), '{k}'))::INT" for k in tx.ID_KEYWORDS)
_ID_STRONG = " OR ".join(f"contains(lower(name), '{k}')" for k in tx.ID_STRONG_KEYWORDS)


def signals_sql(src: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, kind) in enumerate(cols):
        num = f"{c}::DOUBLE" if kind in ("int", "float") else (f"({c}::INT)::DOUBLE" if kind == "bool" else "NULL::DOUBLE")
        if kind == "object":
            cleaned = f"regexp_replace(regexp_replace(trim({c}), '{tx.CURRENCY}', '', 'g'), '[%,]', '', 'g')"
            formats = ", ".join(f"count(try_strptime({c}, '{f}'))::DOUBLE / count({c})" for f, _ in tx.DATE_FORMATS)
            extra = (
                f"count_if(regexp_matches({cleaned}, {_NUMRE}))::DOUBLE / count({c}) AS number_rate, bool_or(regexp_matches({c}, '{tx.CURRENCY}')) AS currency, [{formats}] AS dr, "
                f"count_if(regexp_matches({c}, '^[0-9]{{4}}(-|$)') AND try_cast({c} AS TIMESTAMP) IS NOT NULL)::DOUBLE / count({c}) AS iso, "
                f"avg(try_cast({cleaned} AS DOUBLE)) AS tmean, stddev_samp(try_cast({cleaned} AS DOUBLE)) AS tstd, min(try_cast({cleaned} AS DOUBLE)) AS tmin, max(try_cast({cleaned} AS DOUBLE)) AS tmax"
            )
        else:
            extra = "0.0 AS number_rate, false AS currency, NULL::DOUBLE[] AS dr, 0.0 AS iso, NULL::DOUBLE AS tmean, NULL::DOUBLE AS tstd, NULL::DOUBLE AS tmin, NULL::DOUBLE AS tmax"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS name, '{kind}' AS dtype, count(*) AS n, count({c}) AS cnt, count(DISTINCT {c}) AS uniq, min({num}) AS mn, max({num}) AS mx, avg({num}) AS mean, "
            f"stddev_samp({num}) AS std, var_samp({num}) AS variance, bool_and({num} = round({num})) AS whole, {extra} FROM {src}"
        )
    return sql_union(parts)


def roles_ctes(src: str, cols: list[tuple[str, str]]) -> str:
    """CTE chain ending in ``rl`` (position, name, role, conf, id_conf, tags, ...)."""
    return f"""sig AS ({signals_sql(src, cols)}),
    s1 AS (SELECT *, CASE WHEN dtype = 'int' AND cnt < n THEN 'float' ELSE dtype END AS kind, uniq::DOUBLE / n AS ur, uniq::DOUBLE / greatest(cnt, 1) AS cr, coalesce(list_max(dr), 0) AS date_rate FROM sig),
    s2 AS (SELECT *, greatest(CASE WHEN ur > 0.98 THEN least(0.95, ur) * 0.92 WHEN ur > 0.95 THEN least(0.85, ur * 0.9) * 0.85 WHEN ur > 0.90 THEN ur * 0.6 * 0.4 ELSE 0 END,
        CASE WHEN kind = 'int' AND cnt > 5 AND uniq = cnt AND mx - mn = cnt - 1 THEN least(0.95, cnt / greatest(cnt, 10)) * 0.98 ELSE 0 END,
        CASE WHEN ({_ID_HITS}) > 0 THEN least(0.9, ({_ID_HITS}) * 0.2 + CASE WHEN {_ID_STRONG} THEN 0.1 ELSE 0 END) * 0.7 ELSE 0 END) AS id_conf FROM s1),
    s3 AS (SELECT *, CASE WHEN kind = 'bool' THEN 'boolean' WHEN kind = 'datetime' THEN 'datetime' WHEN kind = 'float' THEN 'numeric' WHEN id_conf > 0.65 THEN 'identifier' WHEN kind = 'int' THEN 'numeric'
        WHEN date_rate >= 0.85 OR iso >= 0.9 THEN 'datetime' WHEN number_rate >= 0.85 THEN 'numeric' WHEN uniq < 50 AND cr < 0.2 THEN 'categorical' WHEN uniq > 50 AND cr < 0.05 THEN 'categorical' ELSE 'text' END AS role FROM s2),
    s4 AS (SELECT * REPLACE (CASE WHEN dtype = 'object' AND role = 'numeric' THEN tmin ELSE mn END AS mn, CASE WHEN dtype = 'object' AND role = 'numeric' THEN tmax ELSE mx END AS mx,
        CASE WHEN dtype = 'object' AND role = 'numeric' THEN tmean ELSE mean END AS mean, CASE WHEN dtype = 'object' AND role = 'numeric' THEN tstd ELSE std END AS std) FROM s3),
    s5 AS (SELECT *, CASE WHEN role <> 'numeric' THEN NULL WHEN currency THEN 'additive' WHEN {_IS_RATE} THEN 'rate' WHEN {_IS_ADD} THEN 'additive' WHEN kind = 'float' AND cnt > 10 AND mn >= 0 AND mx <= 1 THEN 'rate' END AS sem FROM s4),
    rl AS (SELECT *, [t for t in [CASE WHEN dtype = 'object' AND role = 'datetime' THEN CASE WHEN date_rate >= 0.85 THEN 'format:' || ['{"','".join(f for f, _ in tx.DATE_FORMATS)}'][list_position(dr, date_rate)] ELSE 'dateutil_high_confidence' END END,
        CASE WHEN role = 'numeric' AND currency THEN 'monetary' END, sem] if t IS NOT NULL] AS tags,
        round(CASE WHEN role = 'identifier' THEN id_conf WHEN role IN ('numeric','boolean','datetime') THEN 0.92 WHEN role = 'categorical' THEN greatest(0.55, least(0.95, 1 - cr)) ELSE 0.6 END, 4) AS conf FROM s5)"""


def contract_ctes(src: str, cols: list[tuple[str, str]]) -> str:
    return roles_ctes(src, cols) + f""",
    k1 AS (SELECT *, coalesce(role = 'numeric' AND whole AND mn >= 1900 AND mx <= 2100 AND {_YEAR_NAME}, false) AS is_year FROM rl),
    k2 AS (SELECT *, coalesce(role = 'numeric' AND NOT is_year AND (list_contains(tags, 'rate') OR (mn >= 0 AND mx <= 1) OR (mn >= 0 AND mx <= 100 AND {_RATIO_NAME}) OR {_RATIO_NAME}), false) AS is_ratio FROM k1),
    k3 AS (SELECT *, CASE WHEN role = 'numeric' AND list_contains(tags, 'additive') THEN 'additive' WHEN is_ratio OR list_contains(tags, 'rate') THEN 'rate' WHEN role = 'boolean' THEN 'additive' ELSE 'none' END AS aggregation FROM k2),
    fc AS (SELECT *, CASE WHEN is_year THEN 'year' WHEN is_ratio THEN 'ratio' ELSE role END AS role_out,
        CASE WHEN is_year THEN 'year' WHEN is_ratio THEN 'ratio' WHEN role = 'numeric' AND aggregation = 'additive' THEN CASE WHEN list_contains(tags, 'monetary') THEN 'monetary' ELSE 'measure' END
        WHEN role IN ('categorical','identifier') THEN 'dimension' ELSE 'generic' END AS domain FROM k3),
    allowed(k, aggs, charts) AS (VALUES ('identifier','count,nunique',''),('year','min,max,range,nunique','line,bar'),('datetime','min,max,range','line,area'),('ratio','mean,median,min,max','line,bar,box'),
        ('numeric_additive','sum,mean,min,max,median','bar,line,histogram,box,scatter'),('numeric','mean,median,min,max','histogram,box,scatter,line'),('categorical','count,nunique','bar,pie'),('boolean','count,sum,mean','bar,pie'),('text','count,nunique',''))"""


TABLES = {
    "part": [("p_partkey", "int"), ("p_name", "object"), ("p_brand", "object"), ("p_type", "object"), ("p_size", "int"), ("p_retailprice", "float")],
    "customer": [("c_custkey", "int"), ("c_name", "object"), ("c_nationkey", "int"), ("c_acctbal", "float"), ("c_mktsegment", "object")],
    "orders": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "object"), ("o_totalprice", "float"), ("o_orderdate", "datetime"), ("o_orderpriority", "object")],
    "lineitem": [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"), ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"),
                 ("l_returnflag", "object"), ("l_linestatus", "object"), ("l_shipdate", "datetime")],
    "events": [("event_id", "int"), ("ts", "datetime"), ("user_id", "int"), ("event_type", "object"), ("value", "float"), ("props", "object")],
}
_MIXED = """(SELECT o_orderkey AS order_no, year(o_orderdate) AS order_year, o_totalprice AS total_amount, (o_custkey % 7) / 7.0::DOUBLE AS win_rate, strftime(o_orderdate, '%d/%m/%Y') AS day_text,
    '$' || (o_custkey % 900) AS price_text, o_orderstatus = 'F' AS is_final, md5(o_orderkey::VARCHAR) AS digest, CASE WHEN o_orderkey % 10 > 0 THEN o_custkey END AS cust_ref, o_custkey % 40 AS margin_pct FROM orders)"""
_MIXED_COLS = [("order_no", "int"), ("order_year", "int"), ("total_amount", "float"), ("win_rate", "float"), ("day_text", "object"), ("price_text", "object"), ("is_final", "bool"), ("digest", "object"), ("cust_ref", "int"), ("margin_pct", "int")]


def mixed(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return load(spark, d, "orders").select(
        k.alias("order_no"), F.year("o_orderdate").alias("order_year"), F.col("o_totalprice").alias("total_amount"), ((c % 7) / 7.0).alias("win_rate"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day_text"), F.concat(F.lit("$"), (c % 900).cast("string")).alias("price_text"), (F.col("o_orderstatus") == "F").alias("is_final"),
        F.md5(k.cast("string")).alias("digest"), F.when(k % 10 > 0, c).alias("cust_ref"), (c % 40).alias("margin_pct"),
    )


def _role_rows(roled):
    alt = F.concat_ws(",", F.transform("alternatives", lambda a: F.concat(a["role"], F.lit("="), F.format_string("%.4f", a["confidence"]))))
    return roled.select("name", "role", "confidence", F.array_join("semantic_tags", ",").alias("tags"), alt.alias("alternatives"))


_ALTS = """CASE WHEN role = 'identifier' THEN CASE WHEN kind IN ('int','float','bool') THEN 'numeric' ELSE 'categorical' END || '=0.3000,text=0.2000'
    WHEN role IN ('numeric','boolean','datetime') THEN CASE WHEN cr > 0.9 THEN 'identifier=0.3500,categorical=0.2000' ELSE 'categorical=0.2000,identifier=0.1000' END
    WHEN role = 'categorical' THEN CASE WHEN round(cr, 4) >= CASE WHEN cr > 0.9 THEN 0.4 ELSE 0.1 END THEN printf('text=%.4f,identifier=%.4f', round(cr, 4), CASE WHEN cr > 0.9 THEN 0.4 ELSE 0.1 END)
        ELSE printf('identifier=%.4f,text=%.4f', CASE WHEN cr > 0.9 THEN 0.4 ELSE 0.1 END, round(cr, 4)) END
    ELSE CASE WHEN round(greatest(0, 0.5 - cr), 4) >= CASE WHEN cr > 0.95 THEN 0.5 ELSE 0.1 END THEN printf('categorical=%.4f,identifier=%.4f', round(greatest(0, 0.5 - cr), 4), CASE WHEN cr > 0.95 THEN 0.5 ELSE 0.1 END)
        ELSE printf('identifier=%.4f,categorical=%.4f', CASE WHEN cr > 0.95 THEN 0.5 ELSE 0.1 END, round(greatest(0, 0.5 - cr), 4)) END END"""
_ROLE_SQL = lambda src, cols: f"WITH {roles_ctes(src, cols)} SELECT name, role, conf AS confidence, array_to_string(tags, ',') AS tags, {_ALTS} AS alternatives FROM rl"


def _register_roles(table):
    @query(f"k1_roles_{table}", _ROLE_SQL(table, TABLES[table]))
    def k1(spark, d):
        return _role_rows(roles.classify(load(spark, d, table)))


for _t in TABLES:
    _register_roles(_t)


@query("k2_confidence_mixed", _ROLE_SQL(_MIXED, _MIXED_COLS))
def k2(spark, d):
    return _role_rows(roles.classify(mixed(spark, d)))


_FIELD_SQL = lambda src, cols: f"""WITH {contract_ctes(src, cols)} SELECT name, role_out AS role, domain, aggregation, role = 'identifier' AS is_identifier, is_year, is_ratio, aggs AS aggregations, charts
    FROM fc JOIN allowed ON k = CASE WHEN role_out = 'numeric' AND aggregation = 'additive' THEN 'numeric_additive' ELSE role_out END"""


def _field_rows(fields):
    return fields.select(
        "name", "role", "domain", "aggregation", "is_identifier", "is_year", "is_ratio", F.array_join("allowed_aggregations", ",").alias("aggregations"), F.array_join("allowed_charts", ",").alias("charts")
    )


@query("k3_fields", _FIELD_SQL("lineitem", TABLES["lineitem"]))
def k3(spark, d):
    return _field_rows(contract.field_contracts(profile_of(spark, d, "lineitem")))


@query("k3_fields_mixed", _FIELD_SQL(_MIXED, _MIXED_COLS))
def k3_mixed(spark, d):
    return _field_rows(contract.field_contracts(roles.classify(mixed(spark, d))))


@query("f11_year_ratio", f"WITH {contract_ctes(_MIXED, _MIXED_COLS)} SELECT name, is_year, is_ratio FROM fc")
def f11(spark, d):
    return roles.with_year_ratio(roles.classify(mixed(spark, d))).select("name", "is_year", "is_ratio")


@query("a23_role_counts", f"WITH {roles_ctes('events', TABLES['events'])} SELECT role, count(*) AS n FROM rl GROUP BY 1")
def a23(spark, d):
    return roles.role_counts(profile_of(spark, d, "events"))


@query("a19_dataset_kind", f"WITH {roles_ctes('events', TABLES['events'])} SELECT CASE WHEN avg((role = 'identifier')::INT) > 0.3 THEN 'entity-level' WHEN bool_or(role = 'datetime') AND bool_or(role = 'numeric') THEN 'event-level' WHEN avg((role = 'numeric')::INT) > 0.4 THEN 'event-level' ELSE 'entity-level' END AS grain_kind FROM rl")
def a19(spark, d):
    return roles.dataset_kind(profile_of(spark, d, "events"))


@query("a22_dispersion", "SELECT 'heavy' AS column, round(abs(stddev_samp(x) / avg(x)), 6) AS ratio FROM (SELECT pow(value, 6) AS x FROM events) HAVING abs(stddev_samp(x) / avg(x)) >= 3")
def a22(spark, d):
    df = load(spark, d, "events").select("value", F.pow("value", F.lit(6.0)).alias("heavy"))
    return rounded(critic.dispersion_flags(roles.classify(df)), ratio=6)


@query("a28_acceptance", f"WITH {roles_ctes('orders', TABLES['orders'])} SELECT round(avg(conf), 4) AS mean_confidence, min(conf) AS min_confidence, avg(conf) >= 0.7 AND min(conf) >= 0.5 AS accepted FROM rl")
def a28(spark, d):
    df = load(spark, d, "orders")
    fields = contract.field_contracts(roles.classify(df))
    return contract.acceptance(fields, bool(contract.detect_grain(df, ["o_orderkey", "o_orderstatus"]))).select("mean_confidence", "min_confidence", "accepted")


@query("a29_quality_report")
def a29(spark, d):

    gate = clean.run_gate(load(spark, d, "orders"))
    roled = roles.classify(gate.df)
    spec, fields = contract.compile_contract(gate.df, roled, gate)
    q = quality_report(spec, fields, gate, critic.critique(gate.df, roled))
    row = (q["status"], ",".join(q["grain"]), q["sensitivity"], float(q["mean_confidence"]), q["cleaning"]["cleaned_shape"][0], len(q["vetoes"]), len(q["flags"]))
    return spark.createDataFrame([row], "status string, grain string, sensitivity string, mean_confidence double, rows long, vetoes int, flags int")


@query("k5_vetoes", """SELECT 'serial' AS column, 'numeric' AS from_role, 'identifier' AS to_role WHERE (SELECT count(DISTINCT x)::DOUBLE / count(*) >= 0.99 AND bool_and(x = round(x)) FROM (SELECT CASE WHEN event_id % 500 <> 0 THEN event_id * 3 END AS x FROM events))""")
def k5(spark, d):
    # a key with a few gaps is stored as a measurement; the critic turns it back into a key
    df = load(spark, d, "events").select(F.when(F.col("event_id") % 500 != 0, F.col("event_id") * 3).alias("serial"), "value", "user_id")
    return critic.role_vetoes(roles.classify(df))


@query("f12_fingerprint", sql_union(
    f"""WITH {roles_ctes(t, TABLES[t])} SELECT '{t}' AS tbl, sha256('[' || string_agg('["' || name || '","' || dtype || '","' || role || '"]', ',' ORDER BY name) || ']') AS fingerprint FROM rl""" for t in ("events",)))
def f12(spark, d):
    fields = profile_of(spark, d, "events").select("name", "dtype", "role")
    return contract.schema_fingerprint(fields).withColumn("tbl", F.lit("events"))


_OV = "(VALUES ('l_linenumber', 'identifier', NULL), ('l_discount', 'numeric', 'measure'), ('l_orderkey', 'identifier', 'dimension')) o(name, r2, d2)"


@query(
    "k7_override",
    f"""WITH {contract_ctes('lineitem', TABLES['lineitem'])}, j AS (SELECT fc.name, coalesce(r2, role_out) AS role, coalesce(d2, domain) AS domain, CASE WHEN r2 = 'identifier' THEN 'none' WHEN r2 = 'ratio' THEN 'rate' ELSE aggregation END AS aggregation,
    CASE WHEN r2 IS NULL THEN fc.role = 'identifier' ELSE r2 = 'identifier' END AS is_identifier, CASE WHEN r2 IS NULL THEN is_year ELSE r2 = 'year' END AS is_year, CASE WHEN r2 IS NULL THEN is_ratio ELSE r2 = 'ratio' END AS is_ratio FROM fc LEFT JOIN {_OV} ON o.name = fc.name)
    SELECT name, role, domain, aggregation, is_identifier, is_year, is_ratio, aggs AS aggregations, charts FROM j JOIN allowed ON k = CASE WHEN role = 'numeric' AND aggregation = 'additive' THEN 'numeric_additive' ELSE role END""",
)
def k7(spark, d):
    fields = contract.field_contracts(profile_of(spark, d, "lineitem"))
    ov = spark.createDataFrame([("l_linenumber", "identifier", None, None), ("l_discount", "numeric", "measure", None), ("l_orderkey", "identifier", "dimension", None)], "name string, role string, domain string, sensitivity string")
    return _field_rows(contract.override_fields(fields, ov))


@query("j2_override_values", "SELECT o_orderkey, coalesce(n_name, o_orderpriority) AS label FROM orders LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1) ON o_custkey = n_nationkey")
def j2(spark, d):
    ov = load(spark, d, "nation").filter("n_regionkey = 1")
    joined = load(spark, d, "orders").join(ov, F.col("o_custkey") == F.col("n_nationkey"), "left")
    return joined.select("o_orderkey", F.coalesce("n_name", "o_orderpriority").alias("label"))


@query("k9_contract_store", "SELECT o_custkey::VARCHAR AS fingerprint, max(o_orderkey)::INT AS version, arg_max(o_orderstatus = 'F', o_orderkey) AS locked FROM orders GROUP BY 1")
def k9(spark, d):
    store = load(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("fingerprint"), F.col("o_orderkey").cast("int").alias("version"), (F.col("o_orderstatus") == "F").alias("locked"), F.col("o_orderdate").alias("saved_at"))
    return contract.latest_contracts(store).select("fingerprint", "version", "locked")


@query("k16_arbitration", f"""WITH {roles_ctes('part', TABLES['part'])} SELECT name, role AS old_role, CASE WHEN name = 'p_partkey' THEN role WHEN name = 'p_size' THEN 'categorical' WHEN name = 'p_type' THEN 'text' ELSE role END AS role, name IN ('p_size', 'p_type') AS changed FROM rl""")
def k16(spark, d):
    wanted = spark.createDataFrame([("p_partkey", "numeric"), ("p_size", " Categorical "), ("p_type", "text"), ("p_retailprice", "magic")], "name string, role string")
    return contract.role_overrides_allowed(profile_of(spark, d, "part"), wanted, contract.KEY_NAME).select("name", "old_role", "role", "changed")


@query("k16_candidates", f"WITH {roles_ctes('part', TABLES['part'])} SELECT name FROM rl WHERE role IN ('identifier','text') OR (role = 'numeric' AND uniq <= 30)")
def k16_candidates(spark, d):
    return contract.role_candidates(profile_of(spark, d, "part")).select("name")


@query("c19_redaction", "SELECT 'c_name' AS name, count(c_name) AS count, NULL::DOUBLE AS max, 0 AS shown, true AS redacted FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), NULL, 5, false FROM customer UNION ALL SELECT 'c_acctbal', count(c_acctbal), max(c_acctbal), 5, false FROM customer")
def c19(spark, d):
    df = load(spark, d, "customer").select("c_name", "c_mktsegment", "c_acctbal")
    roled = roles.classify(df)
    fields = contract.field_contracts(roled, {"c_name": ["PERSON"]})
    out = contract.redact(roled, fields, ["min", "max", "mean", "std"])
    return out.select("name", "count", "max", F.size("top_categories").alias("shown"), "redacted")


@query("f18_top_structs", "SELECT name, array_to_string(list(value || ':' || cnt ORDER BY rk), ' ') AS top FROM (SELECT 'p_type' AS name, p_type AS value, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, p_type) AS rk FROM part GROUP BY 2 UNION ALL SELECT 'p_name', p_name, count(*), row_number() OVER (ORDER BY count(*) DESC, p_name) FROM part GROUP BY 2) WHERE rk <= 10 GROUP BY 1")
def f18(spark, d):
    out = profile.syntactic_profile(load(spark, d, "part").select("p_type", "p_name"))
    return out.select("name", F.concat_ws(" ", F.transform("top_categories", lambda t: F.concat(t["value"], F.lit(":"), t["count"].cast("string")))).alias("top"))


# ---------------------------------------------------------------- names and text signals


_WORDS = """(SELECT DISTINCT lower(w) || 'Rate_' || o_orderstatus AS name FROM (SELECT o_orderstatus, unnest(string_split(o_orderpriority, '-')) AS w FROM orders) UNION SELECT DISTINCT p_name || '_total' FROM part UNION SELECT DISTINCT p_type || 'Key' FROM part UNION SELECT DISTINCT event_type || '_per_user' FROM events UNION SELECT DISTINCT c_mktsegment || ' order age' FROM customer)"""


def _names(spark, d):
    words = load(spark, d, "orders").select("o_orderstatus", F.explode(F.split("o_orderpriority", "-")).alias("w")).distinct()
    return union_all([
        words.select(F.concat(F.lower("w"), F.lit("Rate_"), "o_orderstatus").alias("name")),
        load(spark, d, "part").select(F.concat("p_name", F.lit("_total")).alias("name")), load(spark, d, "part").select(F.concat("p_type", F.lit("Key")).alias("name")),
        load(spark, d, "events").select(F.concat("event_type", F.lit("_per_user")).alias("name")), load(spark, d, "customer").select(F.concat("c_mktsegment", F.lit(" order age")).alias("name")),
    ]).distinct()


@query("f1_name_tokens", f"SELECT name, {_TOKENS} AS tokens FROM {_WORDS}")
def f1(spark, d):
    return _names(spark, d).withColumn("tokens", tx.name_tokens(F.col("name")))


@query("f2_name_semantics", f"SELECT name, {_IS_RATE} AS is_rate, {_IS_ADD} AS is_additive FROM {_WORDS}")
def f2(spark, d):
    return _names(spark, d).withColumn("is_rate", tx.is_rate_name(F.col("name"))).withColumn("is_additive", tx.is_additive_name(F.col("name")))


@query("f9_id_keywords", f"SELECT name, ({_ID_HITS})::INT AS hits, round(CASE WHEN ({_ID_HITS}) > 0 THEN least(0.9, ({_ID_HITS}) * 0.2 + CASE WHEN {_ID_STRONG} THEN 0.1 ELSE 0 END) ELSE 0 END, 6) AS score FROM {_WORDS}")
def f9(spark, d):
    return _names(spark, d).select("name", tx.id_keyword_count(F.col("name")).alias("hits"), F.round(tx.id_keyword_score(F.col("name")), 6).alias("score"))


@query("f16_title_labels", f"SELECT name, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(replace(name, '_', ' '), ' ')], ' ') AS label FROM {_WORDS}")
def f16(spark, d):
    return _names(spark, d).withColumn("label", tx.title_label(F.col("name")))


@query("f3_semantics", f"WITH {roles_ctes(_MIXED, _MIXED_COLS)} SELECT name, sem AS semantics FROM rl")
def f3(spark, d):
    return roles.classify(mixed(spark, d)).select("name", "semantics")


@query("f10_identifier_confidence", f"WITH {roles_ctes('customer', TABLES['customer'])} SELECT name, round(id_conf, 6) AS id_confidence, id_conf > 0.65 AS is_identifier FROM rl")
def f10(spark, d):
    out = profile_of(spark, d, "customer")
    return rounded(out.select("name", "id_confidence", (F.col("id_confidence") > roles.IDENTIFIER_BAR).alias("is_identifier")), id_confidence=6)


_TEXTS = """(SELECT CASE WHEN o_orderkey % 20 = 0 THEN 'n/d' WHEN o_orderkey % 3 = 0 THEN '€' || o_totalprice || '%' ELSE '$1,' || (o_custkey % 900 + 100) END AS money, strftime(o_orderdate, '%Y-%m-%d') AS iso_day, strftime(o_orderdate, '%m.%d.%Y') AS us_day,
    CASE WHEN o_orderkey % 3 > 0 THEN substr(md5(o_orderkey::VARCHAR), 1, 8) || '-' || substr(md5(o_orderkey::VARCHAR), 9, 4) || '-' || substr(md5(o_orderkey::VARCHAR), 13, 4) || '-' || substr(md5(o_orderkey::VARCHAR), 17, 4) || '-' || substr(md5(o_orderkey::VARCHAR), 21, 12) ELSE 'x' END AS token FROM orders)"""


def _texts(spark, d):
    k, m = F.col("o_orderkey"), F.md5(F.col("o_orderkey").cast("string"))
    money = F.when(k % 20 == 0, "n/d").when(k % 3 == 0, F.concat(F.lit("€"), F.col("o_totalprice").cast("string"), F.lit("%"))).otherwise(F.concat(F.lit("$1,"), (F.col("o_custkey") % 900 + 100).cast("string")))
    uuid = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return load(spark, d, "orders").select(money.alias("money"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso_day"), F.date_format("o_orderdate", "MM.dd.yyyy").alias("us_day"), F.when(k % 3 > 0, uuid).otherwise("x").alias("token"))


_TCOLS = ["money", "iso_day", "us_day", "token"]
_CLEAN = lambda c: f"regexp_replace(regexp_replace(trim({c}), '{tx.CURRENCY}', '', 'g'), '[%,]', '', 'g')"


@query("f4_f5_number_text", sql_union(f"SELECT '{c}' AS name, round(count_if(regexp_matches({_CLEAN(c)}, {_NUMRE}))::DOUBLE / count({c}), 8) AS number_rate, bool_or(regexp_matches({c}, '{tx.CURRENCY}')) AS currency FROM {_TEXTS}" for c in _TCOLS))
def f5(spark, d):
    return rounded(profile.text_signals(_texts(spark, d), _TCOLS).select("name", "number_rate", "currency"), number_rate=8)


@query("f6_date_formats", sql_union(f"SELECT '{c}' AS name, '{f}' AS format, round(count(try_strptime({c}, '{f}'))::DOUBLE / count({c}), 8) AS rate FROM {_TEXTS}" for c in ("iso_day", "us_day") for f, _ in tx.DATE_FORMATS))
def f6(spark, d):
    sig = profile.text_signals(_texts(spark, d).select("iso_day", "us_day"), ["iso_day", "us_day"])
    labels = F.array(*[F.lit(f) for f, _ in tx.DATE_FORMATS])
    return rounded(sig.select("name", F.inline(F.arrays_zip(labels.alias("format"), F.col("date_rates").alias("rate")))).toDF("name", "format", "rate"), rate=8)


@query("f7_ambiguous_dates", "SELECT 'day' AS name, round(count_if(d <= 12)::DOUBLE / count(*), 8) AS ambiguous_share FROM (SELECT day(o_orderdate) AS d FROM orders)")
def f7(spark, d):
    df = load(spark, d, "orders").select(F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"))
    return rounded(profile.text_signals(df, ["day"], strict_compat=False).select("name", "ambiguous_share"), ambiguous_share=8)


@query("f7_ambiguous_default", "SELECT 'day' AS name, 0.0::DOUBLE AS ambiguous_share, count(*) AS n FROM orders")
def f7_default(spark, d):
    """As observed: the test of ambiguous days never fires."""
    df = load(spark, d, "orders").select(F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"))
    return profile.text_signals(df, ["day"]).select("name", "ambiguous_share").crossJoin(F.broadcast(df.agg(F.count("day").alias("n"))))  # one row each


@query("f8_uuid", sql_union(f"SELECT '{c}' AS name, round(count_if(regexp_matches({c}, '(?i)^[A-F0-9]{{8}}-[A-F0-9]{{4}}-[A-F0-9]{{4}}-[A-F0-9]{{4}}-[A-F0-9]{{12}}$'))::DOUBLE / count({c}), 8) AS uuid_share FROM {_TEXTS}" for c in ("token", "iso_day")))
def f8(spark, d):
    return rounded(profile.text_signals(_texts(spark, d).select("token", "iso_day"), ["token", "iso_day"]).select("name", "uuid_share"), uuid_share=8)


@query("f13_tokens", "SELECT o_orderkey, 'derived:agg.' || o_orderpriority || '#' || substr(sha256('agg.' || o_orderpriority || '|' || o_orderstatus || ':' || o_custkey), 1, 16) AS token FROM orders")
def f13(spark, d):
    base, spec = F.concat(F.lit("agg."), "o_orderpriority"), F.concat("o_orderstatus", F.lit(":"), F.col("o_custkey").cast("string"))
    return load(spark, d, "orders").select("o_orderkey", tx.derived_token(base, spec).alias("token"))


@query("f14_provenance", "SELECT o_orderkey, 'filter.' || o_orderstatus || '==' || o_orderpriority AS token FROM orders")
def f14(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.format_string("filter.%s==%s", "o_orderstatus", "o_orderpriority").alias("token"))


@query(
    "f14_filter_tokens",
    "SELECT 'o_orderstatus' AS \"column\", '==' AS op, v AS value, (SELECT count(*) FROM orders WHERE o_orderstatus = v) AS count, 'filter.o_orderstatus==' || v AS token FROM (SELECT unnest(['F', 'O', 'P', 'none']) AS v)",
)
def f14_tokens(spark, d):
    """Counts that carry the provenance of their filter, as the guarded calculation gives them."""
    orders, contract = load(spark, d, "orders"), fields_of(spark, d, "orders")
    return union_all([calc.filter_count(orders, contract, "o_orderstatus", "==", v) for v in ("F", "O", "P", "none")])


@query("f17_text_form", "SELECT o_orderkey, CASE WHEN o_custkey % 5 > 0 THEN CASE WHEN o_custkey > 700 THEN 'True' ELSE 'False' END ELSE 'None' END AS flag, CASE WHEN o_custkey % 3 > 0 THEN (o_custkey::DOUBLE)::VARCHAR ELSE 'nan' END AS num FROM orders")
def f17(spark, d):
    c = F.col("o_custkey")
    df = load(spark, d, "orders").select("o_orderkey", F.when(c % 5 > 0, c > 700).alias("flag"), F.when(c % 3 > 0, c.cast("double")).alias("num"))
    return df.select("o_orderkey", tx.as_text(df, "flag").alias("flag"), tx.as_text(df, "num").alias("num"))


@query("f17_large_and_small", "SELECT o_orderkey, (o_totalprice * 1000)::VARCHAR AS big, (o_totalprice / 1e9)::VARCHAR AS small FROM orders")
def f17_sizes(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 1000).alias("big"), (F.col("o_totalprice") / 1e9).alias("small"))
    return df.select("o_orderkey", tx.as_text(df, "big").alias("big"), tx.as_text(df, "small").alias("small"))


@query("c9_large_doubles", "SELECT o_orderkey FROM orders WHERE (o_totalprice * 1000)::VARCHAR IN (SELECT (max(o_totalprice) * 1000)::VARCHAR FROM orders)")
def c9_large(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 1000).alias("big"))
    top = df.agg(F.max("big")).first()[0]
    return df.filter(filters.predicate(df, {"column": "big", "op": "eq", "value": top})).select("o_orderkey")


# ---------------------------------------------------------------- KPIs, specs, merges, routing


_KPI_ID = " OR ".join(f"contains(lower(name), '{w}')" for w in eda.KPI_ID_WORDS)
_KPI = f"""CASE WHEN role = 'identifier' OR coalesce(std, 0) < 0.01 OR (role = 'numeric' AND ({_KPI_ID})) THEN 0 ELSE least(1, CASE WHEN role = 'numeric' THEN 0.3 WHEN role IN ('categorical','datetime') THEN 0.2 ELSE 0 END
    + CASE WHEN list_contains(tags, 'monetary') THEN 0.4 ELSE 0 END + CASE WHEN mean <> 0 AND std <> 0 THEN least(0.3, abs(std / mean)) ELSE 0 END) END"""


@query("w11_kpis", f"WITH {roles_ctes('lineitem', TABLES['lineitem'])}, s AS (SELECT *, {_KPI} AS score FROM rl) SELECT name AS label, printf('%.2f (±%.2f)', mean, std) AS value, role AS type, round(score, 6) AS score FROM s WHERE score > 0.5 ORDER BY s.score DESC, position LIMIT 10")
def w11(spark, d):
    df = load(spark, d, "lineitem")
    none = eda.settle_insights(spark, [])
    return rounded(eda.kpis(roles.classify(df), none), score=6)


@query(
    "w12_chart_specs",
    f"""WITH {roles_ctes('lineitem', TABLES['lineitem'])}, s AS (SELECT *, {_KPI} AS score FROM rl), t AS (SELECT name, row_number() OVER (ORDER BY score DESC, position) AS k, list_contains(tags, 'additive') AS add_ FROM s WHERE role = 'numeric'),
    u AS (SELECT position::DOUBLE AS seq, 'dist_' || name AS id, 'histogram' AS chart_type, 'distribution' AS intent, name AS x_field, NULL AS y_field, NULL AS agg_func, 2 AS priority FROM rl WHERE role = 'numeric'
    UNION ALL SELECT position + 1000, 'count_' || name, 'bar', 'category_count', name, NULL, NULL, 1 FROM rl WHERE role = 'categorical' AND uniq <= 50
    UNION ALL SELECT k + 3000, 'timeseries_l_shipdate_' || name, 'line', 'time_series', 'l_shipdate', name, CASE WHEN add_ THEN 'sum' ELSE 'mean' END, 0 FROM t WHERE k <= 3)
    SELECT id, chart_type, intent, x_field, y_field, agg_func, priority FROM u ORDER BY priority, seq LIMIT 20""",
)
def w12(spark, d):
    return eda.chart_specs(profile_of(spark, d, "lineitem"), eda.settle_insights(spark, [])).drop("seq")


@query("a15_key_indicators", "SELECT 'Average order_total' AS indicator, printf('%.2f', avg(o_totalprice)) AS value, 'average' AS type FROM orders UNION ALL SELECT 'Variability in order_total', printf('%.2f', stddev_samp(o_totalprice)), 'variability' FROM orders "
       "UNION ALL SELECT 'order_year range', min(year(o_orderdate)) || '–' || max(year(o_orderdate)), 'range' FROM orders UNION ALL SELECT 'Dataset Size', count(*) || ' rows × 3 cols', 'dataset_size' FROM orders "
       "UNION ALL (SELECT 'Most Frequent Category', o_orderpriority || ' (' || count(*) || ' times)', 'dominant_category' FROM orders GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)")
def a15(spark, d):
    df = load(spark, d, "orders").select(F.year("o_orderdate").alias("order_year"), F.col("o_totalprice").alias("order_total"), "o_orderpriority")
    return eda.key_indicators(roles.classify(df), df.count()).drop("seq")


@query("k14_use_cases", f"WITH {roles_ctes('orders', TABLES['orders'])} SELECT 'Segmentation Analysis' AS use_case, string_agg(name, ',' ORDER BY name) FILTER (WHERE role IN ('numeric','categorical')) AS key_inputs FROM rl "
       "UNION ALL SELECT 'Time Series Analysis', string_agg(name, ',' ORDER BY name) FILTER (WHERE role IN ('numeric','datetime')) FROM rl UNION ALL SELECT 'Performance Metrics Dashboard', string_agg(name, ',' ORDER BY name) FILTER (WHERE role = 'numeric') FROM rl")
def k14(spark, d):
    return eda.use_cases(profile_of(spark, d, "orders")).withColumn("key_inputs", F.array_join("key_inputs", ","))


@query("k14_recommendations", f"WITH {roles_ctes('orders', TABLES['orders'])} SELECT 'Correlation Analysis' AS title, 'high' AS priority FROM rl HAVING count_if(role = 'numeric') >= 2 UNION ALL SELECT 'Group Comparisons', 'medium' FROM rl HAVING bool_or(role = 'categorical') AND bool_or(role = 'numeric')")
def k14_rec(spark, d):
    return eda.recommendations(profile_of(spark, d, "orders"))


@query("t15_eligible", f"WITH {roles_ctes('lineitem', TABLES['lineitem'])} SELECT name, 'numeric' AS use FROM rl WHERE role <> 'identifier' AND kind IN ('int','float','bool') UNION ALL SELECT name, 'categorical' FROM rl WHERE role IN ('categorical','boolean') AND uniq BETWEEN 2 AND 50")
def t15(spark, d):
    return stats.eligible_columns(profile_of(spark, d, "lineitem"))


@query("t13_driver_target", f"WITH {roles_ctes('lineitem', TABLES['lineitem'])} SELECT name FROM rl WHERE role = 'numeric' AND list_contains(tags, 'additive') AND uniq >= 5 ORDER BY variance DESC LIMIT 1")
def t13_target(spark, d):
    return stats.driver_target(profile_of(spark, d, "lineitem"))


@query("m1_target", f"WITH {roles_ctes('lineitem', TABLES['lineitem'])} SELECT name, 'classification' AS task FROM rl WHERE role IN ('categorical','boolean') AND uniq = 2 ORDER BY role <> 'boolean', position LIMIT 1")
def m1(spark, d):
    return supervised.pick_target(profile_of(spark, d, "lineitem"))


@query("m1_target_regression", f"WITH {roles_ctes('orders', TABLES['orders'])} SELECT name, 'regression' AS task FROM rl WHERE role = 'numeric' AND uniq >= 10 ORDER BY variance DESC LIMIT 1")
def m1_reg(spark, d):
    return supervised.pick_target(profile_of(spark, d, "orders"))


@query("m14_forecast_columns", f"WITH {roles_ctes('events', TABLES['events'])} SELECT (SELECT name FROM rl WHERE role = 'datetime' ORDER BY position LIMIT 1) AS date_column, (SELECT name FROM rl WHERE role = 'numeric' AND kind IN ('int','float') AND uniq >= 5 ORDER BY variance DESC LIMIT 1) AS measure")
def m14(spark, d):
    return forecast.pick_columns(profile_of(spark, d, "events"))


@query("j3_merge_specs", "WITH a AS (SELECT DISTINCT 'scatter' AS intent, p_type AS x_field, p_brand AS y_field FROM part WHERE p_size > 25), b AS (SELECT DISTINCT 'scatter' AS intent, p_type AS x_field, p_brand AS y_field FROM part) SELECT *, 0 AS tier FROM a UNION ALL SELECT *, 1 FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def j3(spark, d):
    spec = load(spark, d, "part").select(F.lit("scatter").alias("intent"), F.col("p_type").alias("x_field"), F.col("p_brand").alias("y_field"), "p_size")
    return eda.merge_specs(spec.filter("p_size > 25").drop("p_size").distinct(), spec.drop("p_size").distinct())


@query("j4_provenance", """WITH i AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'kpi' ELSE 'chart' END AS kind, CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN 'corr:' || o_orderstatus || '|' || o_orderpriority ELSE 'column:' || o_orderpriority END AS source,
    CASE WHEN o_orderkey % 9 = 0 THEN 'radar' ELSE 'scatter' END AS intent, o_orderstatus AS x_field, o_orderpriority AS y_field FROM orders),
    r AS (SELECT *, CASE WHEN kind = 'chart' THEN [x_field, y_field] WHEN source LIKE 'column:%' THEN [source[8:]] WHEN source LIKE 'corr:%' THEN string_split(source[6:], '|') ELSE [] END AS refs FROM i)
    SELECT id, CASE WHEN kind = 'kpi' AND source = '' THEN 'no-provenance' WHEN kind = 'chart' AND intent = 'radar' THEN 'disallowed-intent' ELSE 'unknown-column' END AS reason FROM r
    WHERE (kind = 'kpi' AND source = '') OR (kind = 'chart' AND intent = 'radar') OR NOT list_has_all(['F', 'O', '1-URGENT', '5-LOW', '2-HIGH'], refs)""")
def j4(spark, d):
    k = F.col("o_orderkey")
    src = F.when(k % 10 == 0, "").when(k % 4 == 0, F.concat(F.lit("corr:"), "o_orderstatus", F.lit("|"), "o_orderpriority")).otherwise(F.concat(F.lit("column:"), "o_orderpriority"))
    items = load(spark, d, "orders").select(
        k.alias("id"), F.when(k % 2 == 0, "kpi").otherwise("chart").alias("kind"), src.alias("source"), F.when(k % 9 == 0, "radar").otherwise("scatter").alias("intent"), F.col("o_orderstatus").alias("x_field"), F.col("o_orderpriority").alias("y_field")
    )
    known = spark.createDataFrame([(n,) for n in ("F", "O", "1-URGENT", "5-LOW", "2-HIGH")], "name string")
    return eda.validate_references(items, known)


@query("j5_findings", "SELECT o_custkey::VARCHAR AS column, CASE min(CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderpriority = '5-LOW' THEN 2 WHEN o_totalprice < 50000 THEN 3 END) WHEN 1 THEN 'type-corrected' WHEN 2 THEN 'share_sum' ELSE 'low-certainty' END AS reason FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '5-LOW' OR o_totalprice < 50000 GROUP BY 1")
def j5(spark, d):
    o = load(spark, d, "orders").withColumn("column", F.col("o_custkey").cast("string"))
    flags = o.filter("o_orderpriority = '5-LOW'").select("column", F.lit("share_sum").alias("type"))
    fields = o.select(F.col("column").alias("name"), (F.col("o_totalprice") / 100000).alias("confidence"))
    return critic.review_findings(o.filter("o_orderstatus = 'F'").select("column"), flags, fields, 0.5)


_ROUTE_ROLES = {"event_type": "categorical", "value": "numeric", "user_id": "numeric", "ts": "datetime", "lang": "categorical", "n_chars": "numeric"}
_HAS = lambda n: f"contains(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), '{''.join(c for c in n if c.isalnum())}')"
_HAS_BY = lambda n: f"contains(regexp_replace(regexp_extract(lower(text), '\\bby\\s+([a-z0-9_ ]+)', 1), '[^a-z0-9]+', '', 'g'), '{''.join(c for c in n if c.isalnum())}')"
_LONGEST = sorted(_ROUTE_ROLES, key=len, reverse=True)
_M = lambda ok: "[n for n in [" + ", ".join(f"CASE WHEN {_HAS(n)} THEN '{n}' END" for n in _LONGEST if _ROUTE_ROLES[n] in ok) + "] if n IS NOT NULL]"
_METRIC_CASE = "CASE " + " ".join(f"WHEN contains(q, '{w}') THEN '{m}'" for w, m in interact.METRIC_WORDS) + " END"


@query(
    "k11_routing",
    f"""WITH b AS (SELECT conv_id, turn, lower(text) AS q, regexp_extract(lower(text), '\\bby\\s+([a-z0-9_ ]+)', 1) AS by_, {_M(('numeric', 'ratio', 'year'))} AS nums, {_M(('categorical', 'datetime'))} AS cats, {_M(('numeric', 'categorical', 'datetime'))} AS hits,
    [n for n in [{', '.join(f"CASE WHEN {_HAS_BY(n)} THEN '{n}' END" for n in _LONGEST if _ROUTE_ROLES[n] in ('categorical', 'datetime'))}] if n IS NOT NULL] AS bynames FROM conversations),
    c AS (SELECT *, CASE WHEN len(nums) >= 2 THEN nums ELSE ['value', 'user_id', 'n_chars'] END AS pool, coalesce(CASE WHEN by_ <> '' THEN bynames[1] END, cats[1], 'event_type') AS grp, coalesce(nums[1], 'value') AS val, {_METRIC_CASE} AS met FROM b),
    e AS (SELECT *, CASE WHEN regexp_matches(q, 'correlat|relationship|related|associat') THEN 1 WHEN by_ <> '' OR contains(q, 'breakdown') OR contains(q, 'per ') THEN 2 WHEN met IS NOT NULL THEN 3 WHEN regexp_matches(q, 'how many|count|number of') THEN 4
    WHEN regexp_matches(q, 'top|most common|frequent|distribution') OR len(cats) > 0 THEN 5 ELSE 6 END AS k FROM c)
    SELECT conv_id, turn, CASE k WHEN 1 THEN 'correlation' WHEN 2 THEN 'aggregate' WHEN 5 THEN 'top_categories' ELSE 'column_stat' END AS tool,
    CASE k WHEN 1 THEN pool[1] WHEN 2 THEN grp WHEN 3 THEN val WHEN 4 THEN coalesce(hits[1], 'event_type') WHEN 5 THEN coalesce(cats[1], 'event_type') ELSE val END AS arg_a,
    CASE k WHEN 1 THEN pool[2] WHEN 2 THEN val END AS arg_b, CASE k WHEN 2 THEN CASE WHEN regexp_matches(q, 'total|sum') THEN 'sum' ELSE 'mean' END WHEN 3 THEN met WHEN 4 THEN 'count' WHEN 6 THEN 'mean' END AS metric FROM e""",
)
def k11(spark, d):
    return interact.route_questions(load(spark, d, "conversations").select("conv_id", "turn", "text"), "text", _ROUTE_ROLES).drop("text")


@query("k6_router", f"WITH {contract_ctes('events', TABLES['events'])} SELECT name, role_out = 'numeric' AND NOT is_year AS correlatable, NOT is_year AND NOT is_ratio AND role <> 'identifier' AND contains(',' || aggs || ',', ',sum,') AS can_sum FROM fc JOIN allowed ON k = CASE WHEN role_out = 'numeric' AND aggregation = 'additive' THEN 'numeric_additive' ELSE role_out END")
def k6(spark, d):
    fields = contract.to_fields(contract.field_contracts(profile_of(spark, d, "events")).collect())
    return spark.createDataFrame([(f.name, f.is_correlatable, f.can_sum) for f in fields.values()], "name string, correlatable boolean, can_sum boolean")


@query("f15_kpi_text", "SELECT 'l_quantity' AS name, format('{:,.2f}', avg(l_quantity)) AS mean_text, format('{:,.2f}', sum(l_quantity)) AS sum_text, count(l_quantity)::VARCHAR AS count_text FROM lineitem")
def f15_kpi(spark, d):
    roled = roles.classify(load(spark, d, "lineitem").select("l_quantity"))
    return roled.select("name", eda.kpi_text("mean").alias("mean_text"), eda.kpi_text("sum").alias("sum_text"), eda.kpi_text("count").alias("count_text"))
