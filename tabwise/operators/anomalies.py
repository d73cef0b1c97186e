"""Isolation forest: trees grown in parallel on small hash samples, every row scored where it lies."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwise import config
from tabwise.functions import text as tx
from tabwise.operators import matrix as mx
from tabwise.session import spread

TREES, SAMPLE = 100, 256  # fixed values of the method
_EULER = 0.5772156649015329


def path_norm(m: float) -> float:
    """Mean path length of an unsuccessful search among ``m`` points."""
    if m <= 1:
        return 0.0
    if m == 2:
        return 1.0
    return 2.0 * (math.log(m - 1.0) + _EULER) - 2.0 * (m - 1.0) / m


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, depth value); leaves have feature -1."""
    nodes: list[list] = []

    def add(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + path_norm(len(rows))])
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        open_ = np.flatnonzero(hi > lo)
        if depth < limit and len(rows) > 1 and len(open_):
            f = int(rng.choice(open_))
            cut = float(rng.uniform(lo[f], hi[f]))
            left = rows[:, f] <= cut
            nodes[me][:4] = [f, cut, add(rows[left], depth + 1), add(rows[~left], depth + 1)] if 0 < left.sum() < len(rows) else nodes[me][:4]
        return me

    add(x, 0)
    return [tuple(n) for n in nodes]


def fit_forest(df: DataFrame, cols: list[str], key: list[str], seed: int = 0) -> tuple[list, int]:
    """(trees, sample size): a pool of the smallest key hashes feeds 100 trees of up to 256 rows each.

    ``key`` must tell rows apart; copies of one feature row are then sampled like any other rows.
    """
    pool = df.select(*cols, F.xxhash64(F.lit(seed), *key).alias("h")).orderBy("h").limit(TREES * SAMPLE)
    m = min(df.count(), TREES * SAMPLE)
    # each tree looks at a hash share of the pool a little above what it takes: the order is then cheap
    share = min(1.0, 1.4 * SAMPLE / max(m, 1))
    draw = F.pmod(F.xxhash64("tree", "h"), F.lit(1_000_000))
    pool = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).withColumn("draw", draw).filter(F.col("draw") < share * 1_000_000)
    order = Window.partitionBy("tree").orderBy("draw", "h")
    picked = pool.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= SAMPLE).drop("draw")
    schema = "tree int, size int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"

    def grow(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rn")
        x = p[cols].to_numpy(dtype=float)
        t = int(p["tree"].iloc[0])
        nodes = _grow(x, np.random.default_rng([seed, t]), max(1, math.ceil(math.log2(max(len(x), 2)))))
        f, c, a, b, d = (list(v) for v in zip(*nodes))
        return pd.DataFrame({"tree": [t], "size": [len(x)], "feature": [f], "cut": [c], "left": [a], "right": [b], "depth": [d]})

    rows = picked.groupBy("tree").applyInPandas(grow, schema).orderBy("tree").collect()  # 100 small trees
    trees = [tuple(np.array(r[k]) for k in ("feature", "cut", "left", "right", "depth")) for r in rows]
    return trees, (rows[0]["size"] if rows else 0)


def _path_lengths(x: np.ndarray, tree) -> np.ndarray:
    feature, cut, left, right, depth = tree
    at = np.zeros(len(x), dtype=int)
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return depth[at]
        go_left = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
        at = np.where(inner, np.where(go_left, left[at], right[at]), at)


def score(df: DataFrame, cols: list[str], keep: list[str], forest: tuple[list, int]) -> DataFrame:
    """(keep..., cols..., score) with score in (0, 1]; above 0.5 is an outlier."""
    trees, size = forest
    shipped = df.sparkSession.sparkContext.broadcast(trees)  # 100 trees of at most 511 nodes
    norm = path_norm(size) or 1.0
    base = spread(df.select(*dict.fromkeys([*keep, *cols])))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", score double"

    def run(batches):
        for p in batches:
            x = p[cols].to_numpy(dtype=float)
            total = sum((_path_lengths(x, t) for t in shipped.value), np.zeros(len(x)))
            yield p.assign(score=np.power(2.0, -(total / max(len(shipped.value), 1)) / norm))

    return base.mapInPandas(run, schema)


def isolation_summary(df: DataFrame, cols: list[str], key: list[str] | None = None, seed: int = 0) -> dict:
    """{n_outliers, fraction} over rows complete in ``cols``."""
    rows = df.select(*dict.fromkeys(key or []), *[tx.numeric(df, c).alias(c) for c in cols if c not in (key or [])]).na.drop(subset=cols)
    if rows.count() < 16:
        return {}
    scored = score(rows, cols, key or [], fit_forest(rows, cols, key or cols, seed))
    r = scored.agg(F.count_if(F.col("score") > 0.5).alias("k"), F.count(F.lit(1)).alias("n")).first()
    return {"n_outliers": r["k"], "fraction": round(r["k"] / r["n"], 4)}


def row_anomalies(df: DataFrame, numeric: list[str], key: list[str], seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, top features, ten worst rows) on the median-filled, scaled matrix."""
    m = mx.fit_matrix(df, numeric, scale=True)
    full = mx.drop_empty_rows(df, numeric)
    cols = [f"f{i}" for i in range(len(m.names))]
    scaled = full.select(*[F.col(k).alias(f"key_{k}") for k in key], *m.raw(full)).select(*[f"key_{k}" for k in key], *m.features(scaled=True))
    keys = [f"key_{k}" for k in key]
    scored = score(scaled, cols, keys, fit_forest(scaled, cols, keys, seed))
    out = F.col("score") > 0.5
    summary = scored.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(out).alias("n_outliers"), F.round(F.avg(out.cast("double")), 4).alias("fraction")
    )
    means = scored.filter(out).agg(
        F.array(*[F.struct(F.lit(n).alias("feature"), F.abs(F.avg(f"f{i}")).alias("contribution")) for i, n in enumerate(m.names)]).alias("t")
    )
    top = means.select(F.inline("t")).filter("contribution > 0.1").orderBy(F.desc("contribution"), "feature").limit(config.ML_TOP_FEATURES)
    worst = scored.filter(out).orderBy(F.desc("score"), *keys).limit(10).select(*[F.col(f"key_{k}").alias(k) for k in key], "score")
    return summary, top, worst
