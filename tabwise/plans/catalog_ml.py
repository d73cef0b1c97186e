"""Queries: models, neighbours, segments, forecasts (checked by rows and by the tests; SQL where it can follow)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwise.operators import anomalies, density, forecast, neighbors, segments, stats, supervised
from tabwise.operators import matrix as mx
from tabwise.plans.catalog import load, query, rounded

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _table(spark, rows: list[dict], schema: str):
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


@query("t9_isolation_forest")
def t9(spark, d):
    df = load(spark, d, "lineitem")
    r = anomalies.isolation_summary(df, _LINE, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    return spark.createDataFrame([(r["n_outliers"], r["fraction"])], "n_outliers long, fraction double")


@query("m13_anomalies")
def m13(spark, d):
    summary, top, worst = anomalies.row_anomalies(load(spark, d, "orders"), ["o_custkey", "o_totalprice"], ["o_orderkey"])
    return worst


def _places(spark, d):
    return load(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_nationkey") * 100.0).alias("place"))


_K = 10
_PLACES = "(SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 100.0::DOUBLE AS y FROM customer)"
_LOF = f"""WITH p AS (SELECT id, x, y, min(id) OVER (PARTITION BY x, y) AS pid FROM {_PLACES}),
    pr AS (SELECT a.id, a.pid, b.pid AS nbr, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.id <> b.id),
    nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nbr) AS rn FROM pr QUALIFY rn <= {_K}), kd AS (SELECT pid, max(d) AS kdist FROM nn GROUP BY 1),
    lr AS (SELECT id, any_value(nn.pid) AS pid, 1.0 / (avg(greatest(d, kdist)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.pid = nbr GROUP BY id),
    pl AS (SELECT pid, any_value(lrd) AS lrd, count(*) AS copies FROM lr GROUP BY 1)"""


@query("t10_lof", f"{_LOF} SELECT pl.pid, any_value(pl.copies) AS copies, round(avg(n.lrd) / any_value(pl.lrd), 6) AS lof FROM pl JOIN nn ON nn.id = pl.pid JOIN pl n ON n.pid = nn.nbr GROUP BY pl.pid")
def t10(spark, d):
    return rounded(neighbors.local_outlier_factor(_places(spark, d), ["c_acctbal", "place"], "c_custkey", _K), lof=6)


@query("t10_lof_outliers", f"{_LOF}, l AS (SELECT pl.pid, any_value(pl.copies) AS copies, avg(n.lrd) / any_value(pl.lrd) AS lof FROM pl JOIN nn ON nn.id = pl.pid JOIN pl n ON n.pid = nn.nbr GROUP BY pl.pid) SELECT sum(CASE WHEN lof > 1.5 THEN copies ELSE 0 END)::BIGINT AS n_outliers, sum(copies)::BIGINT AS n_rows, round(sum(CASE WHEN lof > 1.5 THEN copies ELSE 0 END) / sum(copies), 4)::DOUBLE AS fraction FROM l")
def t10_outliers(spark, d):
    return neighbors.lof_summary(neighbors.local_outlier_factor(_places(spark, d), ["c_acctbal", "place"], "c_custkey", _K))


@query("t12_density_groups")
def t12(spark, d):
    return density.density_summary(density.density_clusters(_places(spark, d), ["c_acctbal", "place"], "c_custkey"))


# Prim's algorithm over lists: a step takes the point nearest to the tree and updates the distance of all others.
_TREE = """WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY x, y) AS i, x, y FROM (SELECT DISTINCT c_acctbal AS x, c_nationkey * 100.0::DOUBLE AS y FROM customer)),
    r AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 100.0::DOUBLE AS y FROM customer),
    c AS (SELECT p.i, p.x, p.y, (list_sort(list(sqrt((p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y)))))[10] AS core FROM p, r GROUP BY ALL),
    l AS (SELECT list(x ORDER BY i) AS x, list(y ORDER BY i) AS y, list(core ORDER BY i) AS core, count(*)::BIGINT AS n FROM c),
    prim AS (SELECT 1::BIGINT AS step, 1::BIGINT AS cur, list_transform(x, lambda v: 'inf'::DOUBLE) AS dist, NULL::DOUBLE AS w FROM l
      UNION ALL
      SELECT step + 1, list_position(nd, list_min(nd))::BIGINT, nd, list_min(nd) FROM (
        SELECT step, list_transform(dist, lambda v, i: CASE WHEN v IS NULL OR i = cur THEN NULL ELSE
          least(v, greatest(l.core[i], l.core[cur], sqrt((l.x[i] - l.x[cur]) * (l.x[i] - l.x[cur]) + (l.y[i] - l.y[cur]) * (l.y[i] - l.y[cur])))) END) AS nd
        FROM prim, l WHERE step < l.n)) """


@query("t12_reach_tree", f"{_TREE} SELECT round(w, 6) AS reach, count(*) AS n FROM prim WHERE w IS NOT NULL GROUP BY 1")
def t12_tree(spark, d):
    tree, _ = density.spanning_tree(_places(spark, d), ["c_acctbal", "place"], "c_custkey", 10)
    return tree.groupBy(F.round("w", 6).alias("reach")).agg(F.count(F.lit(1)).alias("n"))


@query("t11_kmeans")
def t11(spark, d):
    r = segments.best_kmeans(load(spark, d, "part"), ["p_size", "p_retailprice"], range(2, 8))
    return spark.createDataFrame([(r["k"], r["silhouette"])], "k int, silhouette double")


@query("m10_segments")
def m10(spark, d):
    labelled, m, k, s = segments.segment(load(spark, d, "customer"), ["c_acctbal", "c_nationkey"], ["c_mktsegment"], ["c_custkey"])
    return segments.sizes(labelled)


@query("m11_segment_features")
def m11_fit(spark, d):
    labelled, m, k, s = segments.segment(load(spark, d, "part"), ["p_size", "p_retailprice"], ["p_type"], ["p_partkey"])
    return segments.distinguishing(labelled, "prediction", {f"f{i}": n for i, n in enumerate(m.names)})


@query("m12_projection")
def m12(spark, d):
    labelled, m, k, s = segments.segment(load(spark, d, "part"), ["p_size", "p_retailprice"], ["p_type"], ["p_partkey"], max_k=3)
    return segments.projection(labelled, ["p_partkey"])


@query("m18_resegment")
def m18(spark, d):
    labelled, m, k, s = segments.resegment(load(spark, d, "part"), ["p_size", "p_retailprice", "p_type"], ["p_partkey"])
    return segments.sizes(labelled)


@query("t13_driver_importances")
def t13(spark, d):
    df = load(spark, d, "part").withColumn("price_total", F.col("p_retailprice") + F.col("p_size") * 20)
    r = supervised.forest_importances(df, "price_total", ["p_size", "p_retailprice", "p_partkey"], trees=40)
    return _table(spark, r["importances"], "feature string, importance double")


def _sales(spark, d):
    """Orders with their customer: a measurable target and mixed inputs."""
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    per = j.groupBy("c_custkey", "c_acctbal", "c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spend"))
    return per


@query("m4_regression")
def m4(spark, d):
    r = supervised.driver_report(_sales(spark, d), "spend", "regression", ["c_acctbal", "n_orders"], ["c_mktsegment"], ["c_custkey"], folds=3, trees=10)
    m = r["metrics"]
    return spark.createDataFrame([(r["n_rows_used"], m["cv_folds"], m["r2_mean"], m["mae_mean"], m["baseline_r2_mean"], r["top_driver"])], "n long, folds int, r2_mean double, mae_mean double, baseline_r2_mean double, top_driver string")


def _labelled(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", "n_chars", (F.length(F.regexp_replace("text", "[^.]", ""))).alias("stops"))
    return docs.join(load(spark, d, "labels"), "doc_id").withColumn("outcome", F.when(F.col("quality") == 1, "good").otherwise("poor"))


@query("m5_classification")
def m5(spark, d):
    r = supervised.driver_report(_labelled(spark, d), "outcome", "classification", ["n_chars", "stops"], ["lang"], ["doc_id"], folds=3, trees=10)
    m = r["metrics"]
    return spark.createDataFrame([(r["n_rows_used"], m["cv_folds"], m["f1_mean"], m["accuracy_mean"], m["baseline_f1_mean"], m["majority_class"])], "n long, folds int, f1_mean double, accuracy_mean double, baseline_f1_mean double, majority_class string")


@query("m6_permutation_importance")
def m6(spark, d):
    r = supervised.driver_report(_sales(spark, d), "spend", "regression", ["c_acctbal", "n_orders"], ["c_mktsegment"], ["c_custkey"], folds=2, trees=10, repeats=3)
    return spark.createDataFrame([(x["feature"], x["importance"], x.get("direction")) for x in r["importances"]], "feature string, importance double, direction string")


@query("m17_what_if")
def m17(spark, d):
    sales = _sales(spark, d)
    r = supervised.driver_report(sales, "spend", "regression", ["c_acctbal", "n_orders"], ["c_mktsegment"], ["c_custkey"], folds=2, trees=10, repeats=1)
    # every customer asked again with ten more orders, a missing balance and an unknown segment
    asked = sales.select("c_custkey", (F.col("n_orders") + 10).alias("n_orders"), F.lit(None).cast("double").alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    return supervised.what_if(asked, r["bundle"], ["c_custkey"])


@query("m16_forecast")
def m16(spark, d):
    df = load(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return forecast.forecast(stats.mean_series(df, "hour", "value", by=("event_type",)), by=("event_type",))


_SMOOTHED = """WITH RECURSIVE s AS (SELECT event_type, avg(value) AS y, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts)) AS n FROM events GROUP BY event_type, date_trunc('hour', ts)),
    r AS (SELECT event_type, 1::BIGINT AS n, y AS level, 0.0::DOUBLE AS trend, 0.0::DOUBLE AS sse FROM s WHERE n = 1
      UNION ALL
      SELECT r.event_type, s.n, 0.3 * y + 0.7 * (level + 0.9 * trend), 0.1 * (0.3 * y + 0.7 * (level + 0.9 * trend) - level) + 0.9 * 0.9 * trend, sse + pow(y - level - 0.9 * trend, 2)
      FROM r JOIN s ON s.event_type = r.event_type AND s.n = r.n + 1)
    SELECT event_type, n, round(level, 6) AS level, round(trend, 6) AS trend, round(sse, 4) AS sse FROM r QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC) = 1"""


@query("m16_smoothing", _SMOOTHED)
def m16_smoothing(spark, d):
    df = load(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    series = stats.mean_series(df, "hour", "value", by=("event_type",))
    return rounded(forecast.smooth(series, 0.3, 0.1, 0.9, by=("event_type",), block_rows=200), level=6, trend=6, sse=4)


@query("c21_median_fill", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 7 = 0 THEN (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem WHERE l_suppkey % 7 <> 0) ELSE l_quantity END AS quantity FROM lineitem")
def c21(spark, d):
    df = load(spark, d, "lineitem").withColumn("quantity", F.when(F.col("l_suppkey") % 7 != 0, F.col("l_quantity")))
    m = mx.fit_matrix(df, ["quantity"])
    return df.select("l_orderkey", "l_linenumber", "l_partkey", *m.raw(df))


@query("m5_stratified_folds", "SELECT o_orderstatus = 'F' AS is_final, (rn - 1) % 5 AS slot, count(*) AS n FROM (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY o_orderkey) AS rn FROM orders) GROUP BY ALL")
def m5_folds(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("double").alias("label"))
    folded = supervised.stratified_folds(df, "label", ["o_orderkey"], 5)
    return folded.groupBy((F.col("label") == 1).alias("is_final"), F.col("fold").cast("bigint").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
