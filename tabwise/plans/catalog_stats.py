"""Queries: relations, distributions, trends, EDA rules over the star-schema tables."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tabwise.operators import critic, eda, forecast, information, relate, roles, segments, stats, stl, supervised
from tabwise.operators import matrix as mx
from tabwise.plans.catalog import load, query, rounded, sql_union

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
PAIRS = list(itertools.combinations(NUMS, 2))


# ---------------------------------------------------------------- relations


@query("t1_pearson_pairs", sql_union(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r, count(*) AS n FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL HAVING count(*) >= 20" for a, b in PAIRS))
def t1(spark, d):
    return rounded(relate.pearson_pairs(load(spark, d, "lineitem"), NUMS), r=8)


_DERIVED = "(SELECT l_quantity AS q, l_extendedprice AS p, l_quantity * l_extendedprice AS v, l_quantity * 2 + l_tax AS w, CASE WHEN l_linenumber > 2 THEN l_quantity * l_quantity END AS s FROM lineitem)"
_D = ["q", "p", "v", "w", "s"]


def _derived(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return load(spark, d, "lineitem").select(q.alias("q"), p.alias("p"), (q * p).alias("v"), (q * 2 + F.col("l_tax")).alias("w"), F.when(F.col("l_linenumber") > 2, q * q).alias("s"))


@query(
    "t1_insights",
    "SELECT *, CASE WHEN abs(r) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength FROM ("
    + sql_union(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r, count(*) AS n FROM {_DERIVED} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in itertools.combinations(_D, 2))
    + ") WHERE abs(r) >= 0.5 AND n >= 20",
)
def t1_insights(spark, d):
    df = _derived(spark, d)
    found = eda.settle_insights(spark, relate.insights(df, _D))
    return rounded(relate.insight_table(found), r=8)


@query(
    "a27_correlation_matrix",
    "SELECT a AS name, " + ", ".join(f"max(CASE WHEN b = '{c}' THEN r END) AS {c}" for c in sorted(_D)) + " FROM ("
    + sql_union(f"SELECT '{a}' AS a, '{b}' AS b, {'1.0' if a == b else f'round(corr({a}, {b}), 8)'} AS r FROM {_DERIVED}" for a in _D for b in _D) + ") GROUP BY 1",
)
def a27(spark, d):
    pairs = relate.pearson_pairs(_derived(spark, d), _D)
    return rounded(relate.matrix(pairs, _D), **{c: 8 for c in _D})


@query(
    "t3_moments",
    sql_union(
        f"""SELECT '{c}' AS name, n, round(m3 / pow(m2, 1.5), 6) AS skew, round(m4 / (m2 * m2) - 3, 6) AS kurtosis FROM (SELECT count(x) AS n, avg(pow(x - mu, 2)) AS m2, avg(pow(x - mu, 3)) AS m3, avg(pow(x - mu, 4)) AS m4
        FROM (SELECT {c}::DOUBLE AS x, avg({c}::DOUBLE) OVER () AS mu FROM {t}))"""
        for t, c in [("lineitem", c) for c in NUMS]
    ),
)
def t3(spark, d):
    return rounded(stats.distributions(load(spark, d, "lineitem"), NUMS).select("name", "n", "skew", "kurtosis"), skew=6, kurtosis=6)


@query(
    "t3_normality",
    """WITH m AS (SELECT count(x)::DOUBLE AS n, avg(pow(x - mu, 3)) / pow(avg(pow(x - mu, 2)), 1.5) AS g, avg(pow(x - mu, 4)) / pow(avg(pow(x - mu, 2)), 2) - 3 AS k FROM (SELECT c_acctbal AS x, avg(c_acctbal) OVER () AS mu FROM customer)),
    a AS (SELECT *, g * sqrt((n+1)*(n+3)/(6*(n-2))) AS y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) AS b1, 3*(n-1)/(n+1) AS e, 24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5)) AS v,
    6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS sb FROM m),
    b AS (SELECT *, sqrt(2*(b1-1))-1 AS w2, 6+8/sb*(2/sb+sqrt(1+4/(sb*sb))) AS aa, (k+3-e)/sqrt(v) AS x FROM a),
    c AS (SELECT *, 1/sqrt(0.5*ln(w2))*ln(y/sqrt(2/(w2-1))+sqrt(pow(y/sqrt(2/(w2-1)),2)+1)) AS z1, 1+x*sqrt(2/(aa-4)) AS dd FROM b)
    SELECT 'c_acctbal' AS name, 'dagostino_k2' AS test, round(z1*z1 + pow((1-2/(9*aa)-sign(dd)*cbrt((1-2/aa)/abs(dd)))/sqrt(2/(9*aa)), 2), 4) AS k2,
    round(exp(-(z1*z1 + pow((1-2/(9*aa)-sign(dd)*cbrt((1-2/aa)/abs(dd)))/sqrt(2/(9*aa)), 2))/2), 6) AS normality_p FROM c""",
)
def t3_normality(spark, d):
    out = stats.distributions(load(spark, d, "customer"), ["c_acctbal"]).select("name", "test", "k2", "normality_p")
    return rounded(out, k2=4, normality_p=6)


@query(
    "t4_spearman",
    sql_union(
        f"""SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
        rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM {_DERIVED} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for a, b in itertools.combinations(["q", "p", "v", "s"], 2)
    ),
)
def t4(spark, d):
    return rounded(relate.spearman_pairs(_derived(spark, d), ["q", "p", "v", "s"]), rho=6)


def _cramer_sql(a, b, src):
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(sqrt(sum(CASE WHEN r = 2 AND k = 2 THEN pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e ELSE (o - e) * (o - e) / e END) / (any_value(n) * least(any_value(r), any_value(k)) - any_value(n))), 6) AS cramers_v FROM (
    SELECT coalesce(o, 0) AS o, ru * cv / n::DOUBLE AS e, n, r, k FROM (SELECT {a} AS u, count(*) AS ru FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) x
    CROSS JOIN (SELECT {b} AS v, count(*) AS cv FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) y
    CROSS JOIN (SELECT count(*) AS n, count(DISTINCT {a}) AS r, count(DISTINCT {b}) AS k FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) t
    LEFT JOIN (SELECT {a} AS u, {b} AS v, count(*) AS o FROM {src} GROUP BY ALL) z ON z.u = x.u AND z.v = y.v)"""


_CATSRC = "(SELECT l_returnflag AS f, l_linestatus AS s, (l_quantity > 25)::VARCHAR AS q, CASE WHEN l_linenumber > 3 THEN 'late' WHEN l_returnflag = 'R' THEN NULL ELSE 'early' END AS n FROM lineitem)"


@query("t5_cramers_v", sql_union(_cramer_sql(a, b, _CATSRC) for a, b in itertools.combinations(["f", "s", "q", "n"], 2)))
def t5(spark, d):
    n = F.when(F.col("l_linenumber") > 3, "late").when(F.col("l_returnflag") != "R", "early")
    df = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), (F.col("l_quantity") > 25).cast("string").alias("q"), n.alias("n"))
    return rounded(relate.cramers_v(df, ["f", "s", "q", "n"]), cramers_v=6)


@query(
    "t6_eta",
    sql_union(
        f"SELECT '{c}' AS category, '{x}' AS numeric, round(sqrt(sum(n * pow(m - g, 2)) / any_value(t)), 6) AS eta FROM (SELECT {c}, count(*) AS n, avg({x}) AS m FROM lineitem GROUP BY 1), (SELECT avg({x}) AS g, var_pop({x}) * count(*) AS t FROM lineitem)"
        for c in ("l_returnflag", "l_linestatus") for x in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def t6(spark, d):
    return rounded(relate.correlation_ratio(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount"]), eta=6)


@query(
    "w13_top_associations",
    "SELECT * FROM (" + sql_union(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r, count(*) AS n FROM {_DERIVED} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in itertools.combinations(_D, 2))
    + ") ORDER BY abs(r) DESC, a, b LIMIT 5",
)
def w13(spark, d):
    return relate.top_by_strength(rounded(relate.pearson_pairs(_derived(spark, d), _D), r=8), "r", ["a", "b"], 5)


@query(
    "t14_mutual_information",
    sql_union(
        f"""SELECT '{x}' AS feature, round(sum(w::DOUBLE / n * ln(w::DOUBLE * n / (wx * wy))), 6) AS mi FROM (SELECT w, sum(w) OVER (PARTITION BY bx) AS wx, sum(w) OVER (PARTITION BY by_) AS wy, sum(w) OVER () AS n FROM (
        SELECT len([e for e in qx if e < x]) AS bx, len([e for e in qy if e < y]) AS by_, count(*) AS w FROM (SELECT {x}::DOUBLE AS x, v AS y FROM {_DERIVED}) d,
        (SELECT list_distinct(quantile_cont({x}::DOUBLE, [k / 10.0 for k in range(1, 10)])) AS qx, list_distinct(quantile_cont(v, [k / 10.0 for k in range(1, 10)])) AS qy FROM {_DERIVED}) e GROUP BY ALL))"""
        for x in ("q", "p", "w")
    ),
)
def t14(spark, d):
    return rounded(relate.mutual_information(_derived(spark, d).drop("s"), ["q", "p", "w"], "v"), mi=6)


_SPENDING = "(SELECT c_custkey, ln(any_value(c_acctbal)::DOUBLE + 2000) AS balance, avg(o_totalprice)::DOUBLE AS price, sum(o_totalprice)::DOUBLE AS spend FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"
_PSI = lambda n: f"(ln({n} + 10) - 1 / (2.0 * ({n} + 10)) - 1 / (12 * pow({n} + 10, 2)) + 1 / (120 * pow({n} + 10, 4)) - 1 / (252 * pow({n} + 10, 6)) + 1 / (240 * pow({n} + 10, 8)) - list_sum([1.0 / ({n} + i) for i in range(10)]))"


def _neighbor_sql(x: str) -> str:
    return f"""SELECT '{x}' AS feature, round(greatest(0, any_value({_PSI('m')}) + {_PSI('3')} - avg({_PSI('nx')} + {_PSI('ny')})), 6) AS mi FROM (
        SELECT a.i, any_value(a.m)::DOUBLE AS m, (count(*) FILTER (abs(a.x - b.x) < r))::DOUBLE AS nx, (count(*) FILTER (abs(a.y - b.y) < r))::DOUBLE AS ny FROM
          (SELECT p.i, any_value(p.m) AS m, any_value(p.x) AS x, any_value(p.y) AS y, list_sort(list(greatest(abs(p.x - q.x), abs(p.y - q.y))))[3] AS r FROM s_{x} p JOIN s_{x} q ON p.i <> q.i GROUP BY p.i) a, s_{x} b GROUP BY a.i)"""


@query(
    "t14_neighbor_information",
    "WITH " + ", ".join(f"s_{x} AS (SELECT c_custkey AS i, {x} / stddev_pop({x}) OVER () AS x, spend / stddev_pop(spend) OVER () AS y, count(*) OVER () AS m FROM {_SPENDING})" for x in ("balance", "price"))
    + " " + sql_union(_neighbor_sql(x) for x in ("balance", "price")),
)
def t14_neighbors(spark, d):
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    per = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.log(F.first("c_acctbal") + 2000).alias("balance"), F.avg("o_totalprice").alias("price"), F.sum("o_totalprice").alias("spend"))
    return rounded(information.neighbor_information(per, ["balance", "price"], "spend"), mi=6)


@query("t14_class_information")
def t14_classes(spark, d):
    return information.class_information(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag")


# ---------------------------------------------------------------- trends


@query(
    "t7_mann_kendall",
    """WITH s AS (SELECT l_shipdate AS ts, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1), k AS (SELECT sum(sign(b.y - a.y))::BIGINT AS s, (SELECT count(*) FROM s) AS n FROM s a JOIN s b ON a.ts < b.ts)
    SELECT n, s, round(CASE WHEN s = 0 THEN 0 ELSE (s - sign(s)) / sqrt(n * (n - 1.0) * (2 * n + 5) / 18) END, 6) AS z, round(s / (0.5 * n * (n - 1)), 6) AS tau FROM k""",
)
def t7(spark, d):
    return rounded(stats.mann_kendall(stats.mean_series(load(spark, d, "lineitem"), "l_shipdate", "l_extendedprice")), z=6, tau=6)


_SERIES = "(SELECT l_shipdate AS ts, avg(l_quantity) AS y, row_number() OVER (ORDER BY l_shipdate) - 1 AS idx FROM lineitem GROUP BY 1)"
_PARTS = f"""a AS (SELECT *, CASE WHEN count(*) OVER (ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN (sum(y) OVER (ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(y, 6) OVER (ORDER BY idx) + lead(y, 6) OVER (ORDER BY idx)) / 2) / 12 END AS trend FROM {_SERIES}),
    m AS (SELECT idx % 12 AS ph, avg(y - trend) AS raw FROM a GROUP BY 1), c AS (SELECT ph, raw - (SELECT avg(raw) FROM m) AS seasonal FROM m),
    p AS (SELECT idx, y, trend, seasonal, y - trend - seasonal AS resid FROM a JOIN c ON idx % 12 = ph)"""


@query("t8_decomposition", f"WITH {_PARTS} SELECT idx, round(y, 6) AS y, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(resid, 6) AS resid FROM p")
def t8(spark, d):
    parts = stats.decompose(stats.mean_series(load(spark, d, "lineitem"), "l_shipdate", "l_quantity"))
    return rounded(parts.select("idx", "y", "trend", "seasonal", "resid"), y=6, trend=6, seasonal=6, resid=6)


@query("t8_strength", f"WITH {_PARTS} SELECT round(greatest(0, 1 - var_pop(resid) / var_pop(resid + seasonal)), 6) AS seasonal_strength, round(greatest(0, 1 - var_pop(resid) / var_pop(resid + trend)), 6) AS trend_strength FROM p WHERE resid IS NOT NULL")
def t8_strength(spark, d):
    parts = stats.decompose(stats.mean_series(load(spark, d, "lineitem"), "l_shipdate", "l_quantity"))
    return rounded(stats.component_strength(parts), seasonal_strength=6, trend_strength=6)


@query("t8_stl")
def t8_stl(spark, d):
    series = stats.mean_series(load(spark, d, "lineitem"), "l_shipdate", "l_quantity")
    return stl.stl(series, stats.decomposition_period(series.count()))


@query("g1_series_index", "SELECT l_shipdate AS ts, count(*) AS n, row_number() OVER (ORDER BY l_shipdate) - 1 AS idx FROM lineitem GROUP BY 1")
def g1(spark, d):
    series = load(spark, d, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    return stats.indexed(series)


# ---------------------------------------------------------------- EDA


@query("a13_totals", "SELECT 'total_l_extendedprice' AS name, round(sum(l_extendedprice), 2) AS total FROM lineitem")
def a13(spark, d):
    df = load(spark, d, "lineitem")
    return rounded(eda.critical_totals(df, roles.classify(df.select("l_quantity", "l_extendedprice", "l_discount"))), total=2)


@query(
    "a14_iqr_outliers",
    "SELECT * FROM (" + sql_union(
        f"""SELECT '{c}' AS name, count(*) AS n, count_if(x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers, round(100.0 * count_if(x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) / count(*), 6) AS percent
        FROM (SELECT {e} AS x FROM {t}), (SELECT quantile_cont({e}, 0.25) AS q1, quantile_cont({e}, 0.75) AS q3 FROM {t})"""
        for t, c, e in (("lineitem", "qp", "l_quantity * l_extendedprice"), ("lineitem", "l_quantity", "l_quantity"), ("lineitem", "cubed", "pow(l_quantity, 3)"))
    ) + ") WHERE outliers > 0",
)
def a14(spark, d):
    q = F.col("l_quantity")
    df = load(spark, d, "lineitem").select((q * F.col("l_extendedprice")).alias("qp"), "l_quantity", F.pow(q, F.lit(3.0)).alias("cubed"))
    return rounded(eda.iqr_outliers(df, ["qp", "l_quantity", "cubed"]), percent=6)


@query(
    "a20_total_vs_components",
    "WITH d AS (SELECT l_quantity AS a, l_linenumber::DOUBLE AS b, l_tax AS c, l_quantity + l_linenumber + l_tax AS total FROM lineitem) "
    + sql_union(
        f"SELECT '{t}' AS total, count_if(abs({t}) > 0) AS rows, round(avg(CASE WHEN abs({t}) > 0 THEN abs({' + '.join(o for o in 'abc total'.replace('abc', 'a b c').split() if o != t)} - {t}) / abs({t}) END), 6) AS mean_error FROM d"
        for t in ("a", "b", "c", "total")
    ),
)
def a20(spark, d):
    q, n, t = F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.col("l_tax")
    df = load(spark, d, "lineitem").select(q.alias("a"), n.alias("b"), t.alias("c"), (q + n + t).alias("total"))
    return rounded(critic.total_errors(df, ["a", "b", "c", "total"]), mean_error=6)


@query("a21_share_sum", "SELECT t::DOUBLE AS target, round(avg((abs(s - t) <= 0.02 * t)::INT), 6) AS close_share FROM (SELECT l_discount * 10 + (1 - l_discount * 10) * 0.5 + (1 - l_discount * 10) * (CASE WHEN l_linenumber = 1 THEN 0.4 ELSE 0.5 END) AS s FROM lineitem), (SELECT unnest([1, 100]) AS t) GROUP BY 1")
def a21(spark, d):
    a = F.col("l_discount") * 10
    df = load(spark, d, "lineitem").select(a.alias("share_a"), ((1 - a) * 0.5).alias("share_b"), ((1 - a) * F.when(F.col("l_linenumber") == 1, 0.4).otherwise(0.5)).alias("share_c"))
    return rounded(critic.share_sums(df, ["share_a", "share_b", "share_c"]), close_share=6)


# ---------------------------------------------------------------- inputs of the models


@query("m2_leakage", sql_union(f"SELECT '{c}' AS feature, round(corr({c}, v), 8) AS r, count(*) AS n, abs(corr({c}, v)) >= 0.999 AS dropped FROM (SELECT l_quantity AS q, l_extendedprice AS p, 3 * l_quantity * l_extendedprice + l_tax AS copy, l_quantity * l_extendedprice AS v FROM lineitem)" for c in ("q", "p", "copy")))
def m2(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    df = load(spark, d, "lineitem").select(q.alias("q"), p.alias("p"), (3 * q * p + F.col("l_tax")).alias("copy"), (q * p).alias("v"))
    return rounded(supervised.leakage(df, "v", ["q", "p", "copy"]), r=8)


@query("m5_majority_baseline", "SELECT o_orderstatus AS majority_class, round(count(*)::DOUBLE / sum(count(*)) OVER (), 8) AS accuracy, count(*) OVER () AS n_classes FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def m5_majority(spark, d):
    return rounded(supervised.majority_baseline(load(spark, d, "orders"), "o_orderstatus"), accuracy=8)


@query(
    "m7_direction",
    sql_union(
        f"SELECT '{c}' AS feature, round(corr({c}, y), 8) AS r, CASE WHEN abs(corr({c}, y)) < 0.05 THEN 'flat' WHEN corr({c}, y) > 0 THEN 'positive' ELSE 'negative' END AS direction FROM (SELECT l_quantity, l_extendedprice, -l_quantity AS minus, l_quantity * l_extendedprice AS y FROM lineitem)"
        for c in ("l_quantity", "l_extendedprice", "minus")
    ),
)
def m7(spark, d):
    df = load(spark, d, "lineitem").select("l_quantity", "l_extendedprice", (-F.col("l_quantity")).alias("minus"), (F.col("l_quantity") * F.col("l_extendedprice")).alias("y"))
    return rounded(supervised.effect_directions(df, "y", ["l_quantity", "l_extendedprice", "minus"], "regression"), r=8)


@query(
    "m7_direction_class",
    """WITH t AS (SELECT l_returnflag AS top FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), d AS (SELECT l_quantity, (l_shipdate < TIMESTAMP '1998-01-01')::INT AS early, (l_returnflag = top)::INT AS y FROM lineitem, t) """
    + sql_union(f"SELECT '{c}' AS feature, round(corr({c}, y), 8) AS r, CASE WHEN abs(corr({c}, y)) < 0.05 THEN 'flat' WHEN corr({c}, y) > 0 THEN 'positive' ELSE 'negative' END AS direction FROM d" for c in ("l_quantity", "early")),
)
def m7_class(spark, d):
    df = load(spark, d, "lineitem").withColumn("early", (F.col("l_shipdate") < "1998-01-01").cast("int"))
    return rounded(supervised.effect_directions(df, "l_returnflag", ["l_quantity", "early"], "classification"), r=8)


_Z = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]


@query(
    "m11_distinguishing",
    f"""WITH m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _Z)} FROM lineitem),
    g AS ({sql_union(f"SELECT (l_linenumber + CASE WHEN l_quantity > 25 THEN 10 ELSE 0 END)::BIGINT AS label, '{c}' AS feature, avg(({c} - m_{c}) / s_{c}) AS z FROM lineitem, m GROUP BY 1" for c in _Z)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(z) DESC, feature) AS rn FROM g)
    SELECT label, feature, CASE WHEN z > 0 THEN 'higher' ELSE 'lower' END AS direction, round(z, 3) AS z FROM r WHERE rn <= 3 AND abs(z) >= 0.1""",
)
def m11(spark, d):
    df = load(spark, d, "lineitem").withColumn("segment", (F.col("l_linenumber") + F.when(F.col("l_quantity") > 25, 10).otherwise(0)).cast("bigint"))
    z = segments.z_scores(df, _Z, ["segment"])
    return segments.distinguishing(z, "segment", {f"z_{c}": c for c in _Z})


@query(
    "m3_one_hot",
    "SELECT c_custkey, c_acctbal AS f0, " + ", ".join(f"(c_mktsegment = '{s}')::INT::DOUBLE AS f{i + 1}" for i, s in enumerate(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])) + " FROM customer",
)
def m3(spark, d):


    df = load(spark, d, "customer")
    m = mx.fit_matrix(df, ["c_acctbal"], ["c_mktsegment"])
    return df.select("c_custkey", *m.raw(df)).select("c_custkey", *m.features())


@query("m15_series", "SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, round(avg(value), 6) AS y FROM events GROUP BY 1")
def m15(spark, d):
    df = load(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return rounded(stats.mean_series(df, "hour", "value"), y=6)


@query("m16_band", "SELECT p_partkey AS step, p_retailprice AS yhat, p_size::DOUBLE AS sigma, round(p_retailprice - 1.96 * p_size * sqrt(p_partkey), 6) AS lower, round(p_retailprice + 1.96 * p_size * sqrt(p_partkey), 6) AS upper FROM part")
def m16_band(spark, d):
    points = load(spark, d, "part").select(F.col("p_partkey").alias("step"), F.col("p_retailprice").alias("yhat"), F.col("p_size").cast("double").alias("sigma"))
    return rounded(forecast.band(points), lower=6, upper=6)
