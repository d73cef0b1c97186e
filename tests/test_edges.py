"""Borders of size and rounding: results that hold on small tables must hold on large ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwise.functions import text as tx
from tabwise.operators import charts, information, segments, supervised
from tabwise.plans import catalog_charts  # noqa: F401  (registers the queries)
from tabwise.plans.catalog import QUERIES
from tabwise.session import dealt


def frame(spark, pdf, parts=5):
    return spark.createDataFrame(pdf).repartition(parts)


def test_scatter_with_every_point(spark, tmp_path):
    n = 12_000
    spark.range(n).select(F.col("id").alias("s_suppkey"), F.rand(3).alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    assert [tuple(r) for r in QUERIES["c20_flat_scatter"](spark, str(tmp_path)).collect()] == [("scatter", n)]
    df = spark.read.parquet(f"{tmp_path}/supplier.parquet")
    assert charts.scatter(df, "s_suppkey", "s_acctbal")[0] == "heatmap"


def test_fixed_point_rounds_the_exact_value(spark):
    rng = np.random.default_rng(5)
    ties = [0.125, 0.375, 2.675, 1.005, -2.675, 0.005, 1.115, 8.5, 0.25, 0.35, 0.45, -0.04, 0.0, 999.995, 7.25, 123456789.125, 2.0**50 + 0.25, np.inf]
    values = [*ties, *(rng.integers(0, 10**6, 4000) / 1000 + 0.005), *(rng.random(2000) * 10.0 ** rng.integers(-3, 9, 2000))]
    rows = frame(spark, pd.DataFrame({"v": values})).select("v", tx.fixed_point(F.col("v"), 1).alias("one"), tx.fixed_point(F.col("v"), 2).alias("two")).collect()
    assert not [r for r in rows if np.isfinite(r.v) and (r.one, r.two) != (f"{r.v:.1f}", f"{r.v:.2f}")]


def test_folds_stay_even_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(supervised, "BLOCK_ROWS", 100)
    df = frame(spark, pd.DataFrame({"id": range(2003), "label": [float(i % 3 == 0) for i in range(2003)]}))
    got = supervised.stratified_folds(df, "label", ["id"], 5).groupBy("label", "fold").count().collect()
    for label, rows in ((0.0, 1335), (1.0, 668)):
        sizes = {r["fold"]: r["count"] for r in got if r["label"] == label}
        assert [sizes[i] for i in range(5)] == [rows // 5 + (i < rows % 5) for i in range(5)]


def test_class_information_of_crowded_values(spark, monkeypatch):
    """More rows on a value than the jitter can tell apart in one double."""
    rng = np.random.default_rng(9)
    n = 4000
    c = rng.integers(0, 2, n)
    x = np.where(rng.random(n) < 0.9, c, 1 - c) + 0.0
    p = pd.crosstab(x, c).to_numpy() / n
    plain = (p * np.log(p / p.sum(1, keepdims=True) / p.sum(0, keepdims=True))).sum()
    monkeypatch.setattr(information, "JITTER", 1e-15)
    got = information.class_information(frame(spark, pd.DataFrame({"x": x + 5, "c": c.astype(str)})), ["x"], "c").first()["mi"]
    assert got == pytest.approx(plain, abs=0.03)
    monkeypatch.setattr(information, "JITTER", 0.0)  # six rows of a class on each value, at no distance
    equal = pd.DataFrame({"x": np.repeat(np.arange(1.0, 41.0), 6), "c": np.repeat(np.arange(40) % 2, 6).astype(str)})
    assert np.isfinite(information.class_information(frame(spark, equal), ["x"], "c").first()["mi"])


def test_many_rows_are_dealt_to_bounded_tasks(spark, monkeypatch):
    few, many = spark.range(0, 900, 1, 1), spark.range(0, 250_000, 1, 1)
    assert dealt(few, 900).rdd.getNumPartitions() == 1
    sizes = [r["n"] for r in dealt(many, 250_000, 10_000).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 25 and max(sizes) <= 11_000
    seen = []
    monkeypatch.setattr(segments, "dealt", lambda df, n: seen.append(n) or df)
    monkeypatch.setattr(supervised, "dealt", lambda df, n: seen.append(n) or df)
    df = spark.range(400).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    segments.segment(df, ["a", "b"], max_k=2)
    supervised.forest_importances(df, "a", ["b"], trees=2, depth=2)
    assert seen == [400, 400]


def test_date_layouts_are_tried_once_per_text(spark):
    df = frame(spark, pd.DataFrame({"day": ["3/4/2021", "25/12/2020", None, "25/12/2020", "x"] * 50, "v": range(250)}))
    out = tx.typed_dates(df, ["day", "v"])
    assert out.schema["day"].dataType.typeName().startswith("timestamp")
    assert out.groupBy("day").count().count() == 3
