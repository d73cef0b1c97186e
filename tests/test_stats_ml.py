"""Statistics and models on seeded fixtures; distributed code paths forced on small data and checked by brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwise.functions import dist
from tabwise.operators import anomalies, charts, density, forecast, neighbors, ordering, relate, roles, segments, stats, supervised


def table(spark, pdf, parts=4):
    return spark.createDataFrame(pdf).repartition(parts)


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows share one value; the rest are spread out."""
    rng = np.random.default_rng(3)
    v = np.concatenate([np.full(700, 5.0), rng.exponential(4, 1400)]).round(3)
    return pd.DataFrame({"id": np.arange(2100), "v": rng.permutation(v), "u": rng.normal(size=2100).round(2)})


@pytest.mark.parametrize("task_rows", [50, 10**6])
def test_quantiles_equal_a_sort(spark, skewed, task_rows):
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {(r["name"], r["prob"]): r["value"] for r in ordering.exact_quantiles(table(spark, skewed), ["v", "u"], probs, task_rows=task_rows).collect()}
    for c in ("v", "u"):
        for p in probs:
            assert got[c, p] == pytest.approx(skewed[c].quantile(p), abs=1e-12)


@pytest.mark.parametrize("task_rows", [50, 10**6])
def test_grouped_quantiles(spark, skewed, task_rows):
    pdf = skewed.assign(g=np.where(skewed.id % 3 == 0, "hot", (skewed.id % 7).astype(str)))
    got = {r["g"]: r["value"] for r in ordering.exact_quantiles(table(spark, pdf), ["v"], (0.5,), by=("g",), task_rows=task_rows).collect()}
    assert got == pytest.approx(pdf.groupby("g").v.median().to_dict())


@pytest.mark.parametrize("task_rows", [300, 10**6])
def test_group_medians(spark, skewed, task_rows):
    pdf = skewed.assign(g=np.where(skewed.id % 3 == 0, "hot", (skewed.id % 50).astype(str)))
    got = {r["g"]: r["value"] for r in ordering.group_medians(table(spark, pdf), ["g"], "v", task_rows).collect()}
    assert got == pytest.approx(pdf.groupby("g").v.median().to_dict())


@pytest.mark.parametrize("task_rows", [100, 10**6])
@pytest.mark.parametrize("parts", [1, 16])
def test_average_ranks(spark, skewed, task_rows, parts):
    got = {r["value"]: r["rank"] for r in ordering.average_ranks(table(spark, skewed, parts), ["v"], task_rows).collect()}
    want = skewed.assign(r=skewed.v.rank()).groupby("v").r.first().to_dict()
    assert got == pytest.approx(want)


def test_hot_value_join(spark, skewed):
    df = table(spark, skewed).select("id", "v")
    per = df.groupBy("v").agg(F.count(F.lit(1)).alias("cnt"), F.max("id").alias("m"))
    assert ordering.join_on_value(df, per, ["v"], heavy_rows=500, rows=2100).count() == 2100


@pytest.mark.parametrize("cell_rows", [60, 10**6])
def test_mann_kendall_brute_force(spark, cell_rows):
    rng = np.random.default_rng(1)
    y = np.concatenate([np.full(150, 2.0), rng.integers(0, 40, 350).astype(float)])
    y = rng.permutation(y) + np.arange(500) * 0.01 * (rng.random(500) > 0.4)
    s = int(np.sign(y[None, :] - y[:, None])[np.triu_indices(500, 1)].sum())
    df = table(spark, pd.DataFrame({"ts": np.arange(500).astype(float), "y": y}), 7)
    assert stats.mann_kendall_score(df, cell_rows).first()["s"] == s


def test_trend_and_associations(spark):
    rng = np.random.default_rng(0)
    n = 240
    x = rng.normal(size=n)
    y = 3 * x + rng.normal(scale=0.2, size=n)
    region = np.array(["N", "S", "E", "W"])[np.arange(n) % 4]
    score = np.array([10, 50, 90, 130])[np.arange(n) % 4] + rng.normal(size=n)
    pdf = pd.DataFrame({"date": pd.date_range("2021-01-01", periods=n), "trend_val": np.arange(n) + rng.normal(scale=0.5, size=n), "x": x, "y": y, "region": region, "score": score})
    df = table(spark, pdf)
    assert abs(relate.spearman_pairs(df, ["x", "y"]).first()["rho"]) > 0.9
    assert relate.spearman_pairs(df, ["x", "y"]).first()["rho"] == pytest.approx(pdf[["x", "y"]].corr("spearman").iloc[0, 1])
    assert relate.correlation_ratio(df, ["region"], ["score"]).first()["eta"] > 0.9
    assert stats.trend_verdict(stats.mean_series(df, "date", "trend_val"))["trend"] == "increasing"
    found = relate.insights(df, ["x", "y", "score"])
    assert [(i["a"], i["b"], i["strength"]) for i in found] == [("x", "y", "strong")]


def test_decomposition_blocks(spark):
    y = np.sin(np.arange(300) * 2 * math.pi / 12) * 5 + np.arange(300) * 0.1
    df = table(spark, pd.DataFrame({"ts": np.arange(300).astype(float), "y": y}))
    whole = {r["idx"]: r["trend"] for r in stats.decompose(df, 12).collect()}
    cut = {r["idx"]: r["trend"] for r in stats.decompose(df, 12, block=37).collect()}
    assert whole.keys() == cut.keys() and all((a is None) == (cut[k] is None) and (a is None or a == pytest.approx(cut[k])) for k, a in whole.items())
    assert stats.component_strength(stats.decompose(df, 12)).first()["seasonal_strength"] > 0.9


def test_tail_probabilities():
    assert dist.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert dist.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    normal = [-1.5, -1.1, -0.7, -0.4, -0.1, 0.1, 0.4, 0.7, 1.1, 1.5]
    assert dist.shapiro_wilk_p(normal) > 0.5
    assert dist.shapiro_wilk_p([1, 1, 1, 1, 1, 1.1, 1.2, 1.1, 50, 80]) < 0.01


def test_small_sample_distribution(spark):
    df = table(spark, pd.DataFrame({"v": [float(i) for i in range(12)]}))
    r = stats.distributions(df, ["v"]).first()
    assert r["test"] == "shapiro" and r["is_normal"]


def test_isolation_forest_finds_planted_rows(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 3))
    m[:5] = 50
    df = table(spark, pd.DataFrame(m, columns=list("xyz")).assign(id=np.arange(300)))
    r = anomalies.isolation_summary(df, list("xyz"), ["id"])
    assert r["n_outliers"] >= 5 and 0 < r["fraction"] < 1 and r == anomalies.isolation_summary(df.repartition(9), list("xyz"), ["id"])
    summary, top, worst = anomalies.row_anomalies(df, list("xyz"), ["id"])
    assert {x["id"] for x in worst.limit(5).collect()} == {0, 1, 2, 3, 4} and top.count() == 3


@pytest.mark.parametrize("cell_points", [20, 10**6])
def test_neighbours_brute_force(spark, cell_points):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(240, 2)).round(1)
    p[:80] = p[0]  # a third of the rows are copies of one point
    pdf = pd.DataFrame(p, columns=["a", "b"]).assign(id=np.arange(240))
    k = 6
    got = neighbors.nearest_neighbors(table(spark, pdf), ["a", "b"], "id", k, cell_points).toPandas()
    assert (got.groupby("pid").w.sum() == k).all()
    pid = pdf.groupby(["a", "b"]).id.transform("min").to_numpy()
    for i in sorted(set(pid)):
        d = np.sqrt(((p - p[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        want = np.sort(d)[:k]
        mine = got[got.pid == i].sort_values("d")
        assert np.repeat(mine.d.to_numpy(), mine.w.to_numpy()) == pytest.approx(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(200, 201)]
    nodes = sorted({x for e in edges for x in e} | {300})
    e = spark.createDataFrame(edges, "u long, v long")
    got = dict(neighbors.connected_components(e, spark.createDataFrame([(x,) for x in nodes], "pid long")).collect())
    assert got == {x: (0 if x <= 40 else 100 if x < 200 else 200 if x < 300 else 300) for x in nodes}


def test_density_groups(spark):
    rng = np.random.default_rng(2)
    p = np.vstack([rng.normal((0, 0), 0.3, (100, 2)), rng.normal((20, 20), 0.3, (100, 2)), [[9.0, 9.0], [-30.0, 4.0]]])
    df = table(spark, pd.DataFrame(p, columns=["a", "b"]).assign(id=np.arange(202)))
    r = density.density_summary(density.density_clusters(df, ["a", "b"], "id", 8, 8)).first()
    assert r["n_clusters"] == 2 and r["n_noise"] >= 2


def test_segments(spark):
    rng = np.random.default_rng(4)
    c = np.repeat([(0, 0), (20, 20), (40, 0)], 120, axis=0)
    pdf = pd.DataFrame(c + rng.normal(size=(360, 2)), columns=["fa", "fb"]).assign(fc=lambda d: d.fa / 2, id=np.arange(360))
    labelled, m, k, s = segments.segment(table(spark, pdf), ["fa", "fb", "fc"], [], ["id"])
    assert k == 3 and s > 0.4 and sum(r["size"] for r in segments.sizes(labelled).collect()) == 360


@pytest.fixture(scope="module")
def sales(spark):
    rng = np.random.default_rng(7)
    n = 400
    spend, visits, noise = rng.uniform(0, 100, n), rng.uniform(0, 50, n), rng.normal(size=n)
    target = 5 * spend + 2 * visits + rng.normal(0, 5, n)
    return table(spark, pd.DataFrame({"cust_id": np.arange(n), "spend": spend, "visits": visits, "noise": noise, "sales": target, "copy": 2 * target + 1}))


def test_drivers_and_what_if(spark, sales, tmp_path):
    r = supervised.driver_report(sales, "sales", "regression", ["spend", "visits", "noise", "copy"], [], ["cust_id"], folds=3, trees=15, repeats=2)
    assert r["available"] and r["metrics"]["r2_mean"] > 0.8 and r["top_driver"] == "spend" and r["importances"][0]["direction"] == "positive"
    assert r["leaked"] == ["copy"] and r["verdict"]["strength"] == "strong" and r["verdict"]["lift"] > -1
    r["bundle"].save(str(tmp_path / "bundle"))
    bundle = supervised.Bundle.load(spark, str(tmp_path / "bundle"))
    ask = spark.createDataFrame([(1, 80.0, 40.0), (2, 10.0, 5.0), (3, 80.0, None)], "q int, spend double, visits double")
    got = {x["q"]: x for x in supervised.what_if(ask, bundle, ["q"]).collect()}
    assert got[1]["prediction"] > 300 > got[2]["prediction"] and got[1]["lower"] < got[1]["prediction"] < got[1]["upper"]
    assert abs(got[3]["prediction"] - got[1]["prediction"]) < 120


def test_classification(spark):
    rng = np.random.default_rng(8)
    n = 400
    tenure = rng.uniform(0, 60, n)
    churn = np.where(rng.random(n) < 1 / (1 + np.exp(-(3 - 0.1 * tenure))), "yes", "no")
    df = table(spark, pd.DataFrame({"id": np.arange(n), "tenure": tenure, "extra": rng.normal(size=n), "churn": churn}))
    target = supervised.pick_target(roles.classify(df)).first()
    assert (target["name"], target["task"]) == ("churn", "classification")
    r = supervised.driver_report(df, "churn", "classification", ["tenure", "extra"], [], ["id"], folds=2, trees=8, repeats=2)
    assert r["top_driver"] == "tenure" and 0 < r["metrics"]["f1_mean"] <= 1


def test_forecast(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"day": pd.date_range("2022-01-01", periods=90), "revenue": 100 + 2.0 * np.arange(90) + rng.normal(0, 3, 90)})
    df = table(spark, pdf)
    rows = forecast.forecast(stats.mean_series(df, "day", "revenue")).orderBy("step").collect()
    assert len(rows) == 12 and all(r["lower"] <= r["yhat"] <= r["upper"] for r in rows)
    widths = [r["upper"] - r["lower"] for r in rows]
    assert widths == sorted(widths) and rows[0]["yhat"] == pytest.approx(280, abs=15)
    short = forecast.forecast(stats.mean_series(df.filter("day < '2022-01-11'"), "day", "revenue"))
    assert short.count() == 0


def test_chart_rules(spark):
    one = table(spark, pd.DataFrame({"region": ["North"] * 50}))
    assert charts.category_counts(one, "region").count() == 0
    three = table(spark, pd.DataFrame({"region": ["North"] * 30 + ["South"] * 20 + ["East"] * 10}))
    assert {r["category"]: r["count"] for r in charts.category_counts(three, "region").collect()} == {"North": 30, "South": 20, "East": 10}
    assert charts.scatter(table(spark, pd.DataFrame({"a": [1.0] * 9, "b": range(9)})), "a", "b")[0] == "none"
    assert [charts.bin_count(n) for n in (5, 30, 120, 20_000)] == [3, 5, 12, 20]
    mode, bars = charts.histogram(table(spark, pd.DataFrame({"v": np.concatenate([np.arange(60) / 60, [1000.0]] * 1)})), "v")
    assert sum(r["count"] for r in bars.collect()) == 61
