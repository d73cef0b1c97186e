"""Vectors as exact integers: blocks of rows, products that never overflow, scores of any size in an order Spark sorts.

A component x counts as floor(256 * x). Blocks hold rows of one vector length; rows with a component beyond ``WIDE``
are kept in blocks of their own, whose products are taken with Python's integers, so that no sound vector is refused.
A score that does not fit a long travels as ``big`` (1 above, -1 below, else 0) and ``far`` (bytes that sort like it);
in results it is null, its rank is right all the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
WIDE = 1 << 22
LONG = 1 << 63
SCORE = "big int, far binary, score bigint"
_FAR_BITS = 2232  # two components of double size multiplied, scaled, and added up


def sound_rows(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **extra: Column) -> DataFrame:
    """(id, v, ...): the rows that take part, with their components as doubles; ``extra`` columns must not be null."""
    infinity = F.lit(float("inf"))
    sound = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinity))
    rows = vectors.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).filter(sound)
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), *[c.alias(n) for n, c in extra.items()])
    for name in extra:
        rows = rows.filter(F.col(name).isNotNull())
    return rows


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of a matrix of doubles: doubles where all are below ``WIDE``, else Python integers."""
    if not x.size or np.abs(x).max() < WIDE / SCALE:
        return np.floor(x * SCALE)
    flat = [int(np.floor(c * SCALE)) if abs(c) < 2.0**52 else int(c) * SCALE for c in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


def is_wide(x: np.ndarray) -> bool:
    return x.dtype == object


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``x`` with ``q``: longs where they are sure to fit, else Python integers."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    if not (is_wide(x) or is_wide(q)):
        bound = x.shape[1] * float(np.abs(x).max()) * float(np.abs(q).max())
        if bound < 2.0**53:
            return (x @ q).astype(np.int64)
        if bound < 2.0**62:
            return x.astype(np.int64) @ q.astype(np.int64)
    whole = [np.array([int(c) for c in m.ravel()], object).reshape(m.shape) for m in (x, q)]
    return whole[0] @ whole[1]


def row_blocks(rows: DataFrame, size: int, keep: list[str], build, ddl: str) -> DataFrame:
    """Blocks of up to ``size`` rows alike in vector length and width: (dim, n, <keep as arrays>, what build() makes of the matrix of doubles)."""
    names = [f.strip().split(" ")[0] for f in ddl.split(",")]
    kinds = {"int": pa.int32(), "bigint": pa.int64()}
    types = {k: kinds[dict(rows.dtypes)[k]] for k in keep}

    def run(batches):
        held: dict[tuple[int, bool], list] = {}

        def ready(key):
            parts = held.pop(key)
            x = np.concatenate([p[0] for p in parts])
            cols = [np.concatenate([p[1][k] for p in parts]) for k in keep]
            arrays = [pa.array([key[0]], pa.int32()), pa.array([len(x)], pa.int32())]
            arrays += [pa.array([c], pa.list_(types[k])) for k, c in zip(keep, cols)]
            return pa.RecordBatch.from_arrays(arrays + [pa.array([b], pa.binary()) for b in build(x)], names=["dim", "n", *keep, *names])

        for batch in batches:
            vectors = batch.column("v")
            offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            kept = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in keep}
            sizes = np.diff(offsets)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = flat[offsets[:-1][at][:, None] + np.arange(dim)]
                wide = np.abs(x).max(1, initial=0.0) >= WIDE / SCALE
                for w in (False, True):
                    own = np.flatnonzero(wide == w)
                    for lo in range(0, len(own), size):
                        part = own[lo : lo + size]
                        parts = held.setdefault((int(dim), w), [])
                        if sum(len(p[0]) for p in parts) + len(part) > size:
                            yield ready((int(dim), w))
                            parts = held.setdefault((int(dim), w), [])
                        parts.append((x[part], {k: kept[k][at[part]] for k in keep}))
        for key in list(held):
            yield ready(key)

    return rows.select("v", *keep).mapInArrow(run, ", ".join(["dim int, n int", *[f"{k} array<{dict(rows.dtypes)[k]}>" for k in keep], ddl]))


def matrix_of(body: bytes, n: int, dim: int) -> np.ndarray:
    return integers(np.frombuffer(body, "<f8").reshape(n, dim))


def score_arrays(scores: list) -> list[pa.Array]:
    """The columns of ``SCORE`` for whole numbers of any size."""
    big = [1 if s >= LONG else -1 if s < -LONG else 0 for s in scores]
    far = [(int(s) + (1 << _FAR_BITS)).to_bytes(_FAR_BITS // 8 + 1, "big") if b else None for s, b in zip(scores, big)]
    return [pa.array(big, pa.int32()), pa.array(far, pa.binary()), pa.array([None if b else int(s) for s, b in zip(scores, big)], pa.int64())]


def score_value(big: int, far: bytes | None, score: int | None) -> int:
    return int.from_bytes(far, "big") - (1 << _FAR_BITS) if big else score


def best_first() -> list[Column]:
    return [F.desc("big"), F.desc("far"), F.desc("score")]
