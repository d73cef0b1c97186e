"""Hard negatives for embedding training, mined with Fagin's threshold algorithm.

Rows are kept in blocks, each with one sorted list of its rows per dimension. For an anchor, a block's lists are read
side by side from the end that the sign of the anchor's component favours (sorted access); every row met is scored at
once by its exact integer product (random access). What the last values read give together is a threshold that no row
still unmet can exceed, and reading stops once it lies strictly below all that is asked for.

Two rounds go over the same index. The first finds an anchor's positives, its best other rows of the same label: a
block stops when the threshold is strictly below its k-th best. A positive's score p opens a window of scores,
``low`` percent of p to ``high`` percent of p, and the second round finds the best rows of other labels in each window:
a block stops when the threshold is strictly below every window's k-th score so far (or, while a window has fewer,
strictly below its lower end). Each block answers with at most k rows per question; the best of all blocks are kept.

The anchors are fixed by the caller; their blocks are sent to every index block once a round.

Defined results: rows with a null id, label or vector, or with null or non-finite components, take no part; vectors
meet only vectors of their own length; "other" rows are those with another id; anchor rows that repeat id, label and
vector are one anchor, as positives and negatives each row counts; ties go to the smaller id; a negative positive
score opens an empty window; scores beyond a long are ranked right and returned as null; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.llm import vectors as V
from tabwise.session import cut_lineage

INDEX_ROWS = 16_384
ANCHOR_ROWS = 32
FIRST_DEPTH = 64
LOW, HIGH = 50, 95  # percent of the positive's score


def index(rows: DataFrame, size: int = INDEX_ROWS) -> DataFrame:
    """Blocks (dim, n, id, label, matrix, lists): rows and, per dimension, their numbers in ascending order."""

    def build(x):
        return x.astype("<f8").tobytes(), np.argsort(x, axis=0, kind="stable").T.astype("<u2").tobytes()

    return V.row_blocks(rows, min(size, 1 << 16), ["id", "label"], build, "matrix binary, lists binary")


def sorted_access(x: np.ndarray, lists: np.ndarray, q: np.ndarray, first: int = FIRST_DEPTH):
    """(rows met for the first time, what no row still unmet can exceed) at growing depths; None once all are met."""
    n = len(x)
    up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
    if not len(up) and not len(down):
        yield np.arange(n), None
        return
    met = np.zeros(n, bool)
    lo, hi = 0, min(first, n)
    while lo < n:
        before = met.copy()
        met[lists[up, n - hi : n - lo].ravel()] = True
        met[lists[down, lo:hi].ravel()] = True
        last = np.concatenate([x[lists[up, n - hi], up], x[lists[down, hi - 1], down]])
        bound = V.products(last[None, :], np.concatenate([q[up], q[down]]))[0] if hi < n else None
        yield np.flatnonzero(met & ~before), bound
        lo, hi = hi, min(2 * hi, n)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(scores) > k:
        cut = np.sort(scores)[-k] if V.is_wide(scores) else np.partition(scores, len(scores) - k)[-k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    order = sorted(near.tolist(), key=lambda i: (-int(scores[i]), int(ids[i])))
    return np.array(order[:k], np.int64)


def best_positives(ids, labels, x, lists, anchor, label, q, k: int, first: int = FIRST_DEPTH):
    """(id, score) of a block's k best rows of the anchor's label."""
    held_ids, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for rows, bound in sorted_access(x, lists, q, first):
        rows = rows[(labels[rows] == label) & (ids[rows] != anchor)]
        held_ids, held = np.concatenate([held_ids, ids[rows]]), np.concatenate([held, V.products(x[rows], q)])
        keep = _best(held, held_ids, k)
        held_ids, held = held_ids[keep], held[keep]
        if bound is not None and len(held) == k and bound < held[-1]:
            break
    return [(int(i), int(s)) for i, s in zip(held_ids, held)]


def window_of(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Lowest and highest whole score s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), high * score // 100


def best_negatives(ids, labels, x, lists, label, q, windows: list[tuple[int, int]], k: int, first: int = FIRST_DEPTH):
    """Per window (lo, hi) the (id, score) of a block's k best rows of other labels with scores in it."""
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    live = [w for w, (lo, hi) in enumerate(windows) if lo <= hi]
    if not live:
        return [[] for _ in windows]
    for rows, bound in sorted_access(x, lists, q, first):
        rows = rows[labels[rows] != label]
        scores = V.products(x[rows], q)
        done = True
        for w in live:
            lo, hi = windows[w]
            fit = (scores >= lo) & (scores <= hi)
            own_ids, own = np.concatenate([held[w][0], ids[rows[fit]]]), np.concatenate([held[w][1], scores[fit]])
            keep = _best(own, own_ids, k)
            held[w] = own_ids[keep], own[keep]
            need = held[w][1][-1] if len(keep) == k else lo
            done = done and bound is not None and bound < need
        if done:
            break
    return [[(int(i), int(s)) for i, s in zip(*h)] for h in held]


def _asked(anchors: DataFrame, size: int) -> DataFrame:
    """(dim, asked): anchors of one vector length in pickled blocks of up to ``size``."""

    def run(batches):
        held: dict[int, list] = {}

        def ready(dim):
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([pickle.dumps(held.pop(dim))], pa.binary())], names=["dim", "asked"])

        for batch in batches:
            for r in batch.to_pylist():
                windows = [(w["p_rank"], w["p_id"], V.score_value(w["big"], w["far"], w["score"])) for w in r["windows"]]
                own = held.setdefault(len(r["v"]), [])
                own.append((r["id"], r["key"], r["label"], r["v"], windows))
                if len(own) >= size:
                    yield ready(len(r["v"]))
        for dim in list(held):
            yield ready(dim)

    return anchors.select("id", "key", "label", "v", "windows").mapInArrow(run, "dim int, asked binary")


def _answers(blocks: DataFrame, places: int, asked: DataFrame, answer, ddl: str) -> DataFrame:
    """Rows of ``answer(ids, labels, x, lists, one anchor)`` for every anchor and index block: (anchor_id, key, id, <ddl>, score columns).

    A place's partition sees its index blocks first and then streams the anchors past them, so a task holds one place's
    blocks and a batch of anchors, however many anchors there are.
    """
    names = [f.split()[0] for f in ddl.split(",") if f]
    own = blocks.select(F.pmod(F.xxhash64("id"), F.lit(places)).alias("at"), F.lit(0).alias("turn"), "dim", "n", "id", "label", "matrix", "lists", F.lit(None).cast("binary").alias("asked"))
    to = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(places - 1).cast("bigint"))).alias("at")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("n", "int"), ("id", "array<bigint>"), ("label", "array<bigint>"), ("matrix", "binary"), ("lists", "binary"))]
    sent = asked.select(to, F.lit(1).alias("turn"), "dim", *empty, "asked")

    def run(batches):
        here, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                at, turn, dim = [batch.column(c)[r].as_py() for c in ("at", "turn", "dim")]
                if at != here:
                    here, held = at, []
                if turn == 0:
                    n = batch.column("n")[r].as_py()
                    x = V.matrix_of(batch.column("matrix")[r].as_py(), n, dim)
                    lists = np.frombuffer(batch.column("lists")[r].as_py(), "<u2").reshape(dim, n)
                    held.append((dim, *[np.array(batch.column(c)[r].values) for c in ("id", "label")], x, lists))
                    continue
                out = []
                for anchor, key, label, v, windows in pickle.loads(batch.column("asked")[r].as_py()):
                    q = V.integers(np.array(v, float)[None, :])[0]
                    for block_dim, *block in held:
                        if block_dim == dim:
                            out += [(anchor, key, *row) for row in answer(*block, anchor, label, q, windows)]
                cols = list(zip(*out)) if out else [[] for _ in range(4 + len(names))]
                fixed = [pa.array(c, pa.int64()) for c in (*cols[:2], cols[-2])] + [pa.array(c, pa.int64()) for c in cols[2:-2]]
                yield pa.RecordBatch.from_arrays(fixed + V.score_arrays(cols[-1]), names=["anchor_id", "key", "id", *names, "big", "far", "score"])

    met = own.unionByName(sent).repartition(places, "at").sortWithinPartitions("at", "turn")
    return met.mapInArrow(run, ", ".join(["anchor_id bigint, key bigint, id bigint", *([ddl] if ddl else []), V.SCORE]))


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", index_rows: int = INDEX_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank): hard negatives of each anchor and positive."""
    rows = V.sound_rows(vectors, id_col, vec_col, label=label.cast("bigint"))
    blocks = cut_lineage(index(rows, index_rows))
    places = max(1, blocks.count())
    anchors = V.sound_rows(vectors.filter(is_anchor), id_col, vec_col, label=label.cast("bigint")).withColumn("key", F.xxhash64("label", "v")).dropDuplicates(["id", "key"])
    anchors = cut_lineage(anchors)

    no_windows = F.array().cast("array<struct<p_rank:int,p_id:bigint,big:int,far:binary,score:bigint>>")

    def same(ids, labels, x, lists, anchor, own, q, windows):
        return best_positives(ids, labels, x, lists, anchor, own, q, positives)

    first = _answers(blocks, places, _asked(anchors.withColumn("windows", no_windows), ANCHOR_ROWS), same, "")
    place = F.row_number().over(Window.partitionBy("anchor_id", "key").orderBy(*V.best_first(), "id"))
    found = cut_lineage(first.withColumn("p_rank", place).filter(F.col("p_rank") <= positives))

    opened = found.groupBy(F.col("anchor_id").alias("id"), "key").agg(F.collect_list(F.struct("p_rank", F.col("id").alias("p_id"), "big", "far", "score")).alias("windows"))

    def other(ids, labels, x, lists, anchor, own, q, windows):
        best = best_negatives(ids, labels, x, lists, own, q, [window_of(p) for _, _, p in windows], negatives)
        return [(rank, p_id, i, s) for (rank, p_id, _), rows in zip(windows, best) for i, s in rows]

    second = _answers(blocks, places, _asked(anchors.join(opened, ["id", "key"]), ANCHOR_ROWS), other, "p_rank bigint, p_id bigint")
    place = F.row_number().over(Window.partitionBy("anchor_id", "key", "p_rank").orderBy(*V.best_first(), "id"))
    ranked = second.withColumn("rank", place).filter(F.col("rank") <= negatives)
    scored = found.select("anchor_id", "key", F.col("p_rank").cast("bigint").alias("p_rank"), F.col("score").alias("positive_score"))
    return ranked.join(scored, ["anchor_id", "key", "p_rank"]).select(
        "anchor_id", F.col("p_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), F.col("p_rank").cast("int").alias("positive_rank")
    )
