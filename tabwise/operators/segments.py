"""Segments: k-means by best silhouette, what sets each segment apart, 2-D projection."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwise import config
from tabwise.functions import text as tx
from tabwise.operators import matrix as mx
from tabwise.session import dealt, side_by_side


def _fit_best(vectors: DataFrame, ks, seed: int):
    """(silhouette, k, model) with the highest silhouette; squared-distance silhouette, linear in rows."""
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")

    def attempt(k: int):
        model = KMeans(k=k, seed=seed, maxIter=20, featuresCol="features").fit(vectors)
        labelled = model.transform(vectors)
        if len(model.clusterCenters()) < 2 or labelled.select("prediction").distinct().count() < 2:
            return None
        return judge.evaluate(labelled), -k, model

    tries = [t for t in side_by_side([lambda k=k: attempt(k) for k in ks]) if t]
    if not tries:
        return None
    s, k, model = max(tries, key=lambda t: t[:2])
    return s, -k, model


def best_kmeans(df: DataFrame, cols: list[str], ks=range(2, 8), seed: int = 0) -> dict:
    """{k, silhouette} on the scaled rows complete in ``cols`` (at least 16 rows, 2 columns)."""
    rows = df.select(*[tx.numeric(df, c).alias(c) for c in cols]).na.drop()
    n = rows.count()
    if n < 16 or len(cols) < 2:
        return {}
    m = mx.fit_matrix(rows, cols, scale=True)
    vectors = m.assemble(dealt(rows, n), [], scaled=True).select("features").cache()
    try:
        best = _fit_best(vectors, [k for k in ks if k < n - 1], seed)
    finally:
        vectors.unpersist()
    return {"k": best[1], "silhouette": round(best[0], 4)} if best else {}


def segment(df: DataFrame, numeric: list[str], categorical: list[str] = (), key: list[str] = (), seed: int = 0, max_k: int = config.ML_MAX_SEGMENTS):
    """Labelled rows and the fitted matrix: (labelled with f0.. and prediction, matrix, k, silhouette) or None."""
    if len(numeric) < 2:
        return None
    full = mx.drop_empty_rows(df, [*numeric, *categorical])
    m = mx.fit_matrix(full, numeric, list(categorical), scale=True)
    raw = full.select(*[F.col(c).alias(f"key_{c}") for c in key], *m.raw(full))
    n = raw.count()
    if n < config.ML_MIN_ROWS:
        return None
    vectors = m.assemble(dealt(raw, n), [f"key_{c}" for c in key], scaled=True).cache()
    best = _fit_best(vectors, range(2, max(3, min(max_k + 1, n))), seed)
    labelled = best[2].transform(vectors)
    return labelled, m, best[1], best[0]


def resegment(df: DataFrame, columns: list[str], key: list[str] = (), seed: int = 0):
    """Segments on chosen columns: at least two; numbers by storage, the rest as categories."""
    from tabwise.operators.filters import SpecError

    if len(columns) < 2:
        raise SpecError("Pick at least two columns to segment on.")
    present = [c for c in columns if c in df.columns]
    nums = [c for c in present if df.schema[c].dataType.typeName() not in ("string", "date", "timestamp", "timestamp_ntz")]
    return segment(df, nums, [c for c in present if c not in nums], key, seed)


def sizes(labelled: DataFrame) -> DataFrame:
    """(label, size, share)."""
    n = labelled.agg(F.count(F.lit(1)).alias("n"))
    per = labelled.groupBy("prediction").agg(F.count(F.lit(1)).alias("size"))
    return per.crossJoin(F.broadcast(n)).select(
        F.concat(F.lit("Segment "), (F.col("prediction") + 1).cast("string")).alias("label"), "size", F.round(F.col("size") / F.col("n"), 4).alias("share")
    )


def distinguishing(labelled: DataFrame, label: str, features: dict[str, str], top: int = 3, least: float = 0.1) -> DataFrame:
    """(label, feature, direction, z): the features whose mean z per label is farthest from 0.

    ``features`` maps z-scored columns to the names reported.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.avg(c).alias("z")) for c, n in features.items()])
    means = labelled.groupBy(F.col(label).alias("label")).agg(cells.alias("t")).select("label", F.inline("t"))
    win = Window.partitionBy("label").orderBy(F.desc(F.abs("z")), "feature")  # one row per label and feature
    ranked = means.withColumn("rn", F.row_number().over(win)).filter((F.col("rn") <= top) & (F.abs("z") >= least))
    return ranked.select("label", "feature", F.when(F.col("z") > 0, "higher").otherwise("lower").alias("direction"), F.round("z", 3).alias("z"))


def z_scores(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """(keep..., z_<col>...): values standardised with population moments."""
    num = df.select(*keep, *[tx.numeric(df, c).alias(f"n_{c}") for c in cols])
    r = num.agg(*[a for c in cols for a in (F.avg(f"n_{c}").alias(f"m_{c}"), F.stddev_pop(f"n_{c}").alias(f"s_{c}"))])
    joined = num.crossJoin(F.broadcast(r))  # one row of moments
    return joined.select(*keep, *[((F.col(f"n_{c}") - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}"))).alias(f"z_{c}") for c in cols])


def projection(labelled: DataFrame, key: list[str], max_points: int = config.ML_SCATTER_MAX_POINTS) -> DataFrame:
    """(x, y, group): first two principal components of a hash sample of the rows."""
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(labelled)
    keys = [f"key_{c}" for c in key]
    picked = labelled.orderBy(F.xxhash64(*keys)).limit(max_points)
    xy = vector_to_array(F.col("pc"))
    return model.transform(picked).select(
        F.round(xy[0], 4).alias("x"), F.round(xy[1], 4).alias("y"), F.concat(F.lit("Segment "), (F.col("prediction") + 1).cast("string")).alias("group")
    )
