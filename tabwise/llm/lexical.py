"""Ranked lexical search over a length-stratified inverted index.

A document's normaliser m depends on its length only, so documents with equal m form a stratum in which a term's
impact, (1e9 * tf) div (1000 * tf + 8 * m), depends on tf alone. The index keeps strata in blocks of at most
``BLOCK_ROWS`` documents (a hot stratum has many) with postings by term and falling tf: impacts are worked out once per
distinct tf of a block, and a term's first posting bounds all it can give there.

Items are asked in two rounds. A pass over the blocks' heads (terms and highest tf, no postings) bounds what a stratum can
score for an item, which orders the visits: the strata with the highest bounds, ``FIRST_STRATA`` of them, are visited
first and give each item a k-th score to beat. Then all other blocks are visited, but where a block's own bound is
strictly below that score the item is passed over; ties are never lost. Only the k best of a block leave it.

Items go in passes of about ``PASS_TERMS`` (item, term) pairs, so that what is broadcast of them is bounded however many
there are (terms over 64 bytes count by a 128-bit hash); documents are read once a pass and only rows of numbers are
shuffled. Statistics (N, L, df) cover all documents.

Defined results: null and termless documents take no part; null and termless items return nothing; rows that repeat
are documents, or items, of their own; a null doc_id comes after all others in a tie; an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabwise.llm.common import add_columns
from tabwise.session import cut_lineage

PASS_TERMS = 500_000
BLOCK_ROWS = 8_192
FIRST_STRATA = 16
LONG_TERM = 64
AT_ONCE = 1_000_000
#: What ends a term (all of ASCII but digits and letters), capitals fold.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def term_key(term: bytes) -> bytes:
    return term if len(term) <= LONG_TERM else b"\xff" + xxhash.xxh3_128_digest(term)  # no UTF-8 text holds that byte


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _counts(rows: DataFrame, text_col: str, vocabulary=None) -> DataFrame:
    """``rows`` without the text, with __n (terms, repeats included) and the counts of the terms in the broadcast
    ``vocabulary``: __terms (their numbers) and __tfs. Without a vocabulary, __keys in place of their numbers."""

    def make():
        known = None if vocabulary is None else {t: i for i, t in enumerate(vocabulary.value)}

        def one(text):
            terms = terms_of(text)
            held = Counter(terms)
            if known is None:
                return len(terms), [term_key(t) for t in held], list(held.values())
            found = [(i, n) for i, n in ((known.get(t if len(t) <= LONG_TERM else term_key(t)), n) for t, n in held.items()) if i is not None]
            return len(terms), [i for i, _ in found], [n for _, n in found]

        return one

    return add_columns(rows, text_col, make, f"__n bigint, {'__keys array<binary>' if vocabulary is None else '__terms array<int>'}, __tfs array<bigint>")


def build_blocks(docs: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """Blocks (m, terms, tops, body) of the index from rows (m, id, terms, tfs) that arrive sorted by m."""

    def run(batches):
        held: list[tuple] = []  # (m, id, terms, tfs)

        def ready():
            terms, tfs = [np.concatenate([h[i] for h in held]) for i in (2, 3)]
            rows = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h[2]) for h in held])
            order = np.lexsort((-tfs, terms))
            terms, tfs, rows = terms[order], tfs[order], rows[order]
            at = np.flatnonzero(np.diff(terms, prepend=-1))
            body = zlib.compress(pickle.dumps(([h[1] for h in held], np.append(at, len(terms)).astype(np.int32), rows, tfs)), 1)
            arrays = [pa.array([held[0][0]], pa.int64()), pa.array([terms[at]], pa.list_(pa.int32())), pa.array([tfs[at]], pa.list_(pa.int64())), pa.array([body], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["m", "terms", "tops", "body"])

        for batch in batches:
            ms, ids = batch.column("m").to_pylist(), batch.column("id").to_pylist()
            parts = []
            for c in ("terms", "tfs"):
                offsets, values = batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()
                parts.append([values[a:b] for a, b in zip(offsets[:-1], offsets[1:])])
            for row in zip(ms, ids, *parts):
                if held and (row[0] != held[0][0] or len(held) >= size):
                    yield ready()
                    held = []
                held.append(row)
        if held:
            yield ready()

    return docs.select("m", "id", "terms", "tfs").mapInArrow(run, "m bigint, terms array<int>, tops array<bigint>, body binary")


class Items:
    """The items of a pass in flat arrays: per item its term numbers and their weights times repeats."""

    def __init__(self, items: list[list[tuple[int, int]]]):
        self.numbers = np.array([j for j, own in enumerate(items) if own], np.int64)  # items without a known term are met by nothing
        own = [items[j] for j in self.numbers]
        self.starts = np.cumsum([0] + [len(o) for o in own])
        self.terms = np.array([t for o in own for t, _ in o], np.int64)
        self.weights = np.array([w for o in own for _, w in o], np.int64)

    def meet(self, terms: np.ndarray, most: np.ndarray):
        """(place of each item term in a block's terms, -1 for none; highest score by item)."""
        if not len(terms) or not len(self.numbers):
            return np.full(len(self.terms), -1), np.zeros(len(self.numbers), np.int64)
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        hit = terms[at] == self.terms
        return np.where(hit, at, -1), np.add.reduceat(np.where(hit, self.weights * most[at], 0), self.starts[:-1])


def block_bounds(m: int, terms: np.ndarray, tops: np.ndarray, items: Items):
    """(item, highest score that a document of the block can have) where that is above 0."""
    _, bounds = items.meet(terms, impact(tops, m))
    return [(int(items.numbers[i]), int(bounds[i])) for i in np.flatnonzero(bounds > 0)]


def block_answers(m: int, terms: np.ndarray, tops: np.ndarray, body: bytes, items: Items, wanted: np.ndarray, limits: np.ndarray, k: int):
    """(item, id, score) of the k best documents of a block, for the ``wanted`` items (a mask) that can reach their limit there."""
    places, bounds = items.meet(terms, impact(tops, m))
    open_ = np.flatnonzero(wanted & (bounds >= np.maximum(limits, 1)))
    if not len(open_):
        return
    ids, posts, rows, tfs = pickle.loads(zlib.decompress(body))
    distinct, back = np.unique(tfs, return_inverse=True)
    gains = impact(distinct, m)[back]  # an impact is worked out once per tf
    n, sizes = len(ids), np.diff(posts)
    for part in _together(open_, items, places, sizes, n):
        pairs = np.concatenate([np.arange(items.starts[i], items.starts[i + 1]) for i in part])
        owner = np.repeat(np.arange(len(part)), items.starts[part + 1] - items.starts[part])
        known = places[pairs] >= 0
        pairs, owner = pairs[known], owner[known]
        length = sizes[places[pairs]]
        at = np.repeat(posts[places[pairs]] - np.cumsum(length) + length, length) + np.arange(length.sum())
        # whole numbers below 2**53: their sums as doubles are exact
        totals = np.bincount(np.repeat(owner, length) * n + rows[at], np.repeat(items.weights[pairs], length) * gains[at], len(part) * n).reshape(len(part), n)
        cuts = np.maximum(limits[part], 1)
        if n > k:
            cuts = np.maximum(cuts, np.partition(totals, n - k, axis=1)[:, n - k])
        for i, total, cut in zip(part.tolist(), totals, cuts):
            near = np.flatnonzero(total >= cut).tolist()
            near.sort(key=lambda r: (-total[r], ids[r] is None, ids[r]))
            for r in near[:k]:
                yield int(items.numbers[i]), ids[r], int(total[r])


def _together(open_: np.ndarray, items: Items, places: np.ndarray, sizes: np.ndarray, n: int):
    """Groups of items whose postings and sums of a block stay within ``AT_ONCE`` numbers, an item at least."""
    each = np.where(places >= 0, sizes[places], 0)
    load = np.maximum(np.add.reduceat(each, items.starts[:-1])[open_], n)
    group = np.cumsum(load) // AT_ONCE
    return np.split(open_, np.flatnonzero(np.diff(group)) + 1)


def _over_blocks(blocks: DataFrame, columns: list[str], answer, ddl: str) -> DataFrame:
    """Rows of ``answer(m, terms, tops, further columns)`` for every block."""
    names = [f.split()[0] for f in ddl.split(",")]

    def run(batches):
        types = None
        for batch in batches:
            for r in range(batch.num_rows):
                m, terms, tops, *more = [batch.column(c)[r] for c in columns]
                rows = list(answer(m.as_py(), np.asarray(terms.values), np.asarray(tops.values), *[c.as_py() for c in more]))
                if rows:
                    types = types or [to_arrow_type(f.dataType) for f in schema.fields]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    from pyspark.sql import types as T

    schema = T.StructType.fromDDL(ddl)
    return blocks.select(*columns).mapInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _one_pass(docs: DataFrame, asked: list, k: int, id_col: str, text_col: str, block_rows: int, first_strata: int) -> DataFrame:
    """(item, doc_id, score, rank) for the items [(keys, counts)] of a pass."""
    spark = docs.sparkSession
    vocabulary = sorted({t for keys, _ in asked for t in keys})
    number = {t: i for i, t in enumerate(vocabulary)}
    told = spark.sparkContext.broadcast(vocabulary)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = cut_lineage(_counts(docs.select(F.col(id_col).alias("id"), text_col).filter(F.col(text_col).isNotNull()), text_col, told).filter("__n > 0"))
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("__n").cast("decimal(38,0)")), F.lit(0))).first()
    held = rows.select(F.explode("__terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()  # as many rows as the pass has terms
    weight = {r["t"]: math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1))) for r in held}
    items = Items([sorted((number[t], c * weight[number[t]]) for t, c in zip(keys, counts) if number[t] in weight) for keys, counts in asked])
    if not n:
        return spark.createDataFrame([], f"item int, doc_id {id_type}, score bigint, rank int")

    normaliser = F.expr(f"cast(25 + (75 * cast(__n as decimal(20,0)) * {n}) div {int(total)} as bigint)")
    placed = rows.filter(F.size("__terms") > 0).select(normaliser.alias("m"), "id", F.col("__terms").alias("terms"), F.col("__tfs").alias("tfs"))
    placed = placed.repartitionByRange("m", F.xxhash64("id", "terms")).sortWithinPartitions("m")
    blocks = cut_lineage(build_blocks(placed, block_rows))
    shared = spark.sparkContext.broadcast(items)

    bounds = _over_blocks(blocks, ["m", "terms", "tops"], lambda m, terms, tops: [(j, m, b) for j, b in block_bounds(m, terms, tops, shared.value)], "item int, m bigint, bound bigint")
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "m")
    strata = bounds.groupBy("item", "m").agg(F.max("bound").alias("bound")).withColumn("turn", F.row_number().over(by_bound)).filter(F.col("turn") <= first_strata)
    visits: dict[int, list] = {}
    for r in strata.select("item", "m").collect():  # items of the pass times first_strata at most
        visits.setdefault(r["m"], []).append(r["item"])
    seen = spark.sparkContext.broadcast(visits)
    ddl, columns = f"item int, doc_id {id_type}, score bigint", ["m", "terms", "tops", "body"]

    def first(m, terms, tops, body):
        own = shared.value
        return block_answers(m, terms, tops, body, own, np.isin(own.numbers, seen.value.get(m, [])), np.zeros(len(own.numbers), np.int64), k)

    near = blocks.join(spark.createDataFrame([(m,) for m in visits], "m bigint"), "m", "left_semi")
    found = cut_lineage(_best(_over_blocks(near, columns, first, ddl), k))
    limits = np.zeros(len(asked), np.int64)
    for r in found.filter(F.col("rank") == k).select("item", "score").collect():
        limits[r["item"]] = r["score"]
    beat = spark.sparkContext.broadcast(limits)

    def rest(m, terms, tops, body):
        own = shared.value
        return block_answers(m, terms, tops, body, own, ~np.isin(own.numbers, seen.value.get(m, [])), beat.value[own.numbers], k)

    return _best(found.drop("rank").unionByName(_over_blocks(blocks, columns, rest, ddl)), k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
           pass_terms: int = PASS_TERMS, block_rows: int = BLOCK_ROWS, first_strata: int = FIRST_STRATA) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    asked = _counts(queries.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")), "text").filter("__n > 0")
    asked = cut_lineage(asked.withColumn("spot", F.xxhash64("item_id", "__keys", F.monotonically_increasing_id())))
    passes = -(-(asked.agg(F.coalesce(F.sum(F.size("__keys")), F.lit(0))).first()[0]) // pass_terms)
    item_field = asked.schema["item_id"]
    out = spark.createDataFrame([], f"item_id {item_field.dataType.simpleString()}, rank int, doc_id {docs.schema[id_col].dataType.simpleString()}, score bigint")
    for p in range(passes):
        rows = asked.filter(F.pmod("spot", F.lit(passes)) == p).collect()  # about pass_terms pairs
        if rows:
            found = _one_pass(docs, [(list(map(bytes, r["__keys"])), r["__tfs"]) for r in rows], k, id_col, text_col, block_rows, first_strata)
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {item_field.dataType.simpleString()}")
            out = out.unionByName(cut_lineage(found.join(names, "item").select("item_id", "rank", "doc_id", "score")))
    return out
