"""Removal of repeated byte strings by a logarithmic family of suffix-array indexes.

What is looked for are strings of ``match_bytes`` (400) bytes that start at two or more places of the corpus. A
suffix array of every byte is not needed for that. In each 400-byte window the 128-byte gram of smallest hash is the
window's anchor, a choice that depends on the window's bytes only, so equal windows have equal anchors at equal
places. Suffixes are kept at anchors (about one in 137 bytes). An entry stands for an anchor's segment, the run of
windows that share the anchor, as two fingerprints: of the 128 bytes at the anchor (``head``, which orders the
array) and of the whole segment (``seg``).

Index: texts come in batches. A batch's entries, sorted by head, are its suffix array; it is merge-scanned by head
against itself and each existing level, and then becomes a level, two levels of equal size being merged into one of
twice the size. A scan reports segments that occur whole on both sides and heads under which different segments
meet. The latter are extended from the anchor to both sides byte by byte to find which windows match; where very many
segments meet under one head, their windows meet by fingerprint instead, which costs one row per window and no pairs.

All removals are judged on the input. Texts are handled by a 128-bit fingerprint, so exact copies are worked out once.

Defined results: null text is empty; texts below 400 bytes keep everything; repeated rows are copies; an empty table
gives no rows; ids play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm.common import merged
from tabwise.session import cut_lineage

MATCH_BYTES = 400
GRAM_BYTES = 128
BATCHES = 4
GROUP_SEGMENTS = 48
CHUNK_BYTES = 1 << 22
SENT_BYTES = 1 << 23
_BASE = 0x9E3779B97F4A7C15 | 1
_WRAP = 1 << 64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    base, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, _WRAP), np.uint64)
    base[0] = inverse[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


class Anchors:
    """Anchors of the windows of texts; one object per task, its tables grow to the longest text met."""

    def __init__(self, match_bytes: int = MATCH_BYTES, gram_bytes: int = GRAM_BYTES):
        self.match, self.gram = match_bytes, gram_bytes
        self.up, self.down = _powers(1024)

    def _ranks(self, text: np.ndarray) -> np.ndarray:
        """A mixed hash of the gram at each place in the upper 40 bits, the place in the lower 24."""
        n = len(text)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(2 * n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.down[:n], out=sums[1:])
        h = (sums[self.gram :] - sums[: n - self.gram + 1]) * self.up[: n - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)

    def segments(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first window, last window) of each run of windows that share an anchor."""
        parts = []
        every = np.frombuffer(text, np.uint8)
        for at in range(0, max(0, len(text) - self.match + 1), CHUNK_BYTES):
            own = every[at : at + CHUNK_BYTES + self.match - 1]
            least = self._ranks(own)
            width, span = self.match - self.gram + 1, 1
            while 2 * span <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if width > span:
                least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
            anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
            parts.append((anchor[first] + at, first + at, last + at))
        if not parts:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*parts))


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _text_key(text: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(text)
    return value >> 64, value & (_WRAP - 1)


def occurrences(docs: DataFrame, text_col: str = "text", match_bytes: int = MATCH_BYTES, gram_bytes: int = GRAM_BYTES) -> DataFrame:
    """(k1, k2, head, seg, lo, left, size): each segment of each text, the anchor being ``left`` bytes into it."""
    columns = ["k1", "k2", "head", "seg", "lo", "left", "size"]

    def run(batches):
        anchors = Anchors(match_bytes, gram_bytes)
        head, seg = xxhash.xxh3_64_intdigest, xxhash.xxh3_64_intdigest
        for batch in batches:
            out, held = [], 0

            def ready():
                joined = [np.concatenate(x) for x in zip(*out)]
                return pa.RecordBatch.from_arrays([pa.array(x) for x in joined], names=columns)

            for text in batch.column(0).to_pylist():
                if text is None or len(text) < match_bytes:
                    continue
                at, lo, hi = anchors.segments(text)
                end = hi + match_bytes
                a, b, c = at.tolist(), lo.tolist(), end.tolist()
                k1, k2 = _signed(_text_key(text))
                heads = _signed([head(text[x : x + gram_bytes]) for x in a])
                segs = _signed([seg(text[x:y], 7) for x, y in zip(b, c)])
                out.append((np.full(len(a), k1), np.full(len(a), k2), heads, segs, lo, at - lo, end - lo))
                held += len(a)
                if held > 100_000:
                    yield ready()
                    out, held = [], 0
            if out:
                yield ready()

    return docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "k1 bigint, k2 bigint, head bigint, seg bigint, lo bigint, left bigint, size bigint")


class SuffixIndex:
    """Levels of suffix arrays, level i being empty or the merge of 2**i batches."""

    def __init__(self):
        self.levels: list[DataFrame | None] = []
        self.whole: list[DataFrame] = []  # (head, seg) met more than once
        self.forks: list[DataFrame] = []  # (head) with different segments

    @staticmethod
    def _sorted(entries: DataFrame) -> DataFrame:
        """A suffix array: entries counted, in the order of their heads within each part."""
        return entries.repartition("head").groupBy("head", "seg").agg(F.sum("n").alias("n")).sortWithinPartitions("head", "seg")

    @staticmethod
    def _heads(array: DataFrame, side: str) -> DataFrame:
        return array.groupBy("head").agg(F.min("seg").alias(f"{side}_min"), F.max("seg").alias(f"{side}_max"))

    def add(self, rows: DataFrame) -> None:
        """Scan a batch (head, seg) against all levels, keep what matched, file the batch."""
        array = cut_lineage(self._sorted(rows.groupBy("head", "seg").agg(F.count(F.lit(1)).alias("n"))))
        self.whole.append(array.filter("n > 1").select("head", "seg"))
        own = self._heads(array, "new")
        self.forks.append(own.filter("new_min != new_max").select("head"))
        for level in self.levels:
            if level is not None:
                self.whole.append(array.join(level.select("head", "seg"), ["head", "seg"]).select("head", "seg"))
                met = own.join(self._heads(level, "old"), "head")
                self.forks.append(met.filter("least(new_min, old_min) != greatest(new_max, old_max)").select("head"))
        i = 0
        while i < len(self.levels) and self.levels[i] is not None:
            array, self.levels[i] = cut_lineage(self._sorted(array.unionByName(self.levels[i]))), None
            i += 1
        if i == len(self.levels):
            self.levels.append(None)
        self.levels[i] = array

    def matches(self) -> tuple[DataFrame, DataFrame]:
        """Distinct (head, seg) that occur more than once; distinct heads with different segments."""
        def union(parts):
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out

        return cut_lineage(union(self.whole).distinct()), cut_lineage(union(self.forks).distinct())


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def _shared(parts: list[bytes]) -> np.ndarray:
    """Length of the common beginning of every two strings, from neighbours in their sorted order."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    step = np.array([_common(parts[a], parts[b]) for a, b in zip(order, order[1:])], np.int64)
    out = np.zeros((len(parts), len(parts)), np.int64)
    for k in range(len(parts) - 1):
        run = np.minimum.accumulate(step[k:])
        out[order[k], order[k + 1 :]] = run
        out[order[k + 1 :], order[k]] = run
    return out


def matching_windows(group: list[tuple[bytes, int, bool]], match_bytes: int) -> list[list[tuple[int, int]]]:
    """For each segment of a head, given as (bytes, place of the anchor, known to match whole), the ranges of windows
    that another segment of the head holds too, counted from the segment's start. Suffixes and reversed prefixes at
    the anchor are compared; a window matches where both sides reach as far as it does."""
    right = _shared([body[left:] for body, left, _ in group])
    leftward = _shared([body[:left][::-1] for body, left, _ in group])
    out = []
    for i, (body, left, done) in enumerate(group):
        lo = np.maximum(match_bytes - right[i], left - (len(body) - match_bytes))
        hi = np.minimum(leftward[i], left)
        good = lo <= hi
        good[i] = False
        spans = [] if done else merged([(left - int(h), left - int(x) + 1) for x, h in zip(lo[good], hi[good])])
        out.append([(a, b - 1) for a, b in spans])
    return out


def _segment_bytes(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(head, seg, left, body) of the wanted segments (k1, k2, head, seg, lo, left, size), read from the texts."""
    per_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("head", "seg", "lo", "left", "size")).alias("want"))
    joined = one_per_text(keyed(docs.select(text_col), text_col)).join(per_text, ["k1", "k2"])

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, held = [], 0

            def ready():
                part = list(zip(*rows))
                return pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.binary())], names=["head", "seg", "left", "body"])

            for i in range(batch.num_rows):
                text = unpack.decompress(batch.column("body")[i].as_py())
                for w in batch.column("want")[i].as_py():
                    rows.append((w["head"], w["seg"], w["left"], text[w["lo"] : w["lo"] + w["size"]]))
                    held += w["size"]
                    if held > SENT_BYTES:
                        yield ready()
                        rows, held = [], 0
            if rows:
                yield ready()

    return joined.select("body", "want").mapInArrow(run, "head bigint, seg bigint, left bigint, body binary")


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the text replaced by its fingerprint (k1, k2), its size and its packed bytes."""
    kept = [f for f in docs.schema.fields if f.name != text_col]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [x or b"" for x in batch.column("__b").to_pylist()]
            keys = [_text_key(x) for x in texts]
            columns = [pa.array(_signed([k[0] for k in keys])), pa.array(_signed([k[1] for k in keys])), pa.array([len(x) for x in texts], pa.int64()), pa.array([squeeze.compress(x) for x in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + columns, names=[f.name for f in kept] + ["k1", "k2", "n_bytes", "body"])

    rows = docs.select(*[f"`{f.name}`" for f in kept], F.col(text_col).cast("binary").alias("__b"))
    return rows.mapInArrow(run, f"{ddl}k1 bigint, k2 bigint, n_bytes bigint, body binary")


def one_per_text(rows: DataFrame) -> DataFrame:
    """One row per distinct text of ``keyed`` rows; copies meet before the shuffle where they can."""
    return rows.groupBy("k1", "k2").agg(F.first("body").alias("body"))


def partial_matches(docs: DataFrame, found: DataFrame, whole: DataFrame, forks: DataFrame, text_col: str, match_bytes: int) -> DataFrame:
    """(head, seg, lo, hi): windows, counted from the segment's start, of segments that occur once which occur again
    in another segment under the same head."""
    rep = F.struct("k1", "k2", "lo", "left", "size")
    distinct = found.join(forks, "head").groupBy("head", "seg").agg(F.min(rep).alias("r")).select("head", "seg", "r.*")
    marked = distinct.join(whole.withColumn("w", F.lit(True)), ["head", "seg"], "left").withColumn("w", F.coalesce("w", F.lit(False)))
    sizes = marked.groupBy("head").agg(F.count(F.lit(1)).alias("members"), F.bool_and("w").alias("done")).filter("not done").drop("done")
    open_ones = cut_lineage(marked.join(sizes, "head"))
    bodies = cut_lineage(_segment_bytes(docs, open_ones, text_col).join(open_ones.select("head", "seg", "w", "members"), ["head", "seg"]))

    def together(batches):
        """Rows come sorted by head; a head's rows may go over from one batch to the next."""
        head, group, out = None, [], []

        def close():
            for (seg, *_), spans in zip(group, matching_windows([g[1:] for g in group], match_bytes)):
                out.extend((head, seg, a, b) for a, b in spans)

        def ready():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["head", "seg", "lo", "hi"])

        for batch in batches:
            for h, *row in zip(*(batch.column(c).to_pylist() for c in ("head", "seg", "body", "left", "w"))):
                if h != head:
                    if len(group) > 1:
                        close()
                    head, group = h, []
                group.append(row)
            if out:
                yield ready()
                out = []
        if len(group) > 1:
            close()
        if out:
            yield ready()

    few = bodies.filter(F.col("members") <= GROUP_SEGMENTS).select("head", "seg", "body", "left", "w")
    near = few.repartition("head").sortWithinPartitions("head").mapInArrow(together, "head bigint, seg bigint, lo bigint, hi bigint")

    def unrolled(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for i in range(batch.num_rows):
                head, seg, left, body = [batch.column(c)[i].as_py() for c in ("head", "seg", "left", "body")]
                at = range(len(body) - match_bytes + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([head] * len(at)), pa.array([seg] * len(at)), pa.array(list(at), pa.int64()), pa.array([left - x for x in at], pa.int64()), pa.array(_signed([digest(body[x : x + match_bytes]) for x in at]))],
                    names=["head", "seg", "lo", "away", "win"],
                )

    many = bodies.filter(F.col("members") > GROUP_SEGMENTS)
    spread = many.select("head", "seg", "left", "body").mapInArrow(unrolled, "head bigint, seg bigint, lo bigint, away bigint, win bigint")
    again = spread.groupBy("head", "away", "win").agg(F.min("seg").alias("a"), F.max("seg").alias("b")).filter("a != b").select("head", "away", "win")
    far = spread.join(again, ["head", "away", "win"]).select("head", "seg", "lo", F.col("lo").alias("hi"))
    return near.unionByName(far)


def repeated_spans(docs: DataFrame, text_col: str = "text", match_bytes: int = MATCH_BYTES, gram_bytes: int = GRAM_BYTES, batches: int = BATCHES) -> DataFrame:
    """(k1, k2, from, to): starts and ends of the byte spans of each text to be removed, sorted; they may overlap."""
    found = cut_lineage(occurrences(docs, text_col, match_bytes, gram_bytes))
    index = SuffixIndex()
    for b in range(batches):
        index.add(found.filter(F.pmod("k1", F.lit(batches)) == b).select("head", "seg"))
    whole, forks = index.matches()
    parts = partial_matches(docs, found, whole, forks, text_col, match_bytes)
    all_of_it = whole.select("head", "seg", F.lit(0).cast("bigint").alias("from"), F.lit(-1).cast("bigint").alias("to"))
    hits = cut_lineage(all_of_it.unionByName(parts.select("head", "seg", F.col("lo").alias("from"), F.col("hi").alias("to"))))
    stop = F.when(F.col("to") < 0, F.col("lo") + F.col("size")).otherwise(F.col("lo") + F.col("to") + match_bytes)
    spans = found.join(hits, ["head", "seg"]).select("k1", "k2", F.struct((F.col("lo") + F.col("from")).alias("a"), stop.alias("b")).alias("s"))
    per_text = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("s")).alias("s"))
    return per_text.select("k1", "k2", F.col("s.a").alias("from"), F.col("s.b").alias("to"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match_bytes: int = MATCH_BYTES, keep_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every document; ``kept`` is what is left, as bytes."""
    spans = repeated_spans(docs.select(text_col), text_col, match_bytes)
    rows = keyed(docs.select(id_col, text_col), text_col).join(spans, ["k1", "k2"], "left")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for body, starts, stops in zip(*(batch.column(c).to_pylist() for c in ("body", "from", "to"))):
                text, gone, at, left = unpack.decompress(body), merged(list(zip(starts or [], stops or []))), 0, []
                for a, b in gone:
                    left.append(text[at:a])
                    at = b
                kept = b"".join([*left, text[at:]])
                out.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()) + ((kept,) if keep_bytes else ()))
            columns = list(zip(*out)) or [[] for _ in names]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col)] + [pa.array(c, t) for c, t in zip(columns, types)], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_bytes
    return rows.select(id_col, "body", "from", "to").mapInArrow(run, ddl)
