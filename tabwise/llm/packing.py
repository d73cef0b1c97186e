"""Sequence packing: shortest pack first over the length histogram.

Documents are cut into pieces of at most ``max_tokens`` ids. Only the histogram of piece lengths (one row per
length, at most ``max_tokens`` rows) reaches the driver. There lengths are placed longest first, each into the
shortest pack that still takes it, by editing counts of packing patterns and never single packs. A pattern's copies
are consecutive sequences; pieces find their place by their rank among the pieces of the same length.

Ranks need no window over a whole length: pieces are numbered within (length, bucket) cells, buckets being hashes of
the piece, and cell offsets come from the cell counts.

Defined results: null text is empty and gives one piece, the end mark; repeated rows are packed once each; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from struct import pack as pack_ints
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwise.llm.common import explode_rows
from tabwise.session import cut_lineage

MAX_TOKENS = 2048
END_ID = 1
BUCKETS = 4096
CACHE_WORDS = 600_000

Pattern = tuple[int, ...]


def little(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit bytes."""
    return pack_ints(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes.

    The vocabulary is lower-case, drops white space and never joins across it, so words are encoded one by one and
    kept in a bounded table. A comma or full stop behind a plain letter is a piece of its own, so the word before it
    is looked up without it. Words of Latin letters are one piece and go to the tokenizer's merges directly, others
    through the whole tokenizer, many at a time and held apart by a piece that no word holds.
    """

    APART = b"\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = Tokenizer.from_file(path)
        self.apart = self.model.encode(self.APART.decode(), add_special_tokens=False).ids
        self.known: dict[bytes, bytes] = {}
        self.split: dict[int, list[bytes]] = {}
        self.merges = self.model.model.tokenize
        # the bytes of letters beyond ASCII as the vocabulary writes them
        self.letters = {b: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][-1] for b in range(0x80, 0xC0)}
        self.letters |= {b: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(bytes([b, 0x80]).decode())[0][0][0] for b in range(0xC3, 0xCA)}

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        return (text.lower() if b"<|" not in text else text).split()  # names of special ids are told by their case

    def prepare(self, texts: list[bytes | None]) -> None:
        """Encode all words of these texts that are not known yet."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        self.split = {id(t): self.words(t) for t in texts if t}
        met = set().union(*self.split.values()).difference(self.known)
        marked = [w for w in met if w[-1:] in (b",", b".") and w[-2:-1].isalpha()]
        met.difference_update(marked)
        if marked:
            met.update([w[:-1] for w in marked], (b",", b"."))
        rest = []
        for w in met.difference(self.known):
            s = w.decode("utf-8", "replace")
            if not s.isalpha():
                plain = None
            elif s.isascii():
                plain = s.lower()
            else:
                s = s.lower()
                plain = s.encode().decode("latin-1").translate(self.letters) if max(s) < "\u0250" and is_normalized("NFC", s) else None
            if plain:
                self.known[w] = little([t.id for t in self.merges(plain)])
            elif self.APART in w or b"<|" in w:
                self.known[w] = little(self.model.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids)
            else:
                rest.append(w)
        for at in range(0, len(rest), 2000):
            self._learn(rest[at : at + 2000])
        for w in marked:
            self.known[w] = self.known[w[:-1]] + self.known[w[-1:]]

    def _learn(self, words: list[bytes]) -> None:
        line = (b" " + self.APART + b" ").join(words).decode("utf-8", "replace")
        ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids + self.apart, "<u4")
        stops = np.flatnonzero(ids == self.apart[0])
        raw, start = ids.tobytes(), 0
        for w, stop in zip(words, stops.tolist(), strict=True):
            self.known[w] = raw[4 * start : 4 * stop]
            start = stop + 1

    def __call__(self, text: bytes) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split.get(id(text)) or self.words(text)))


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, keep_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): the documents' token ids cut from the front."""

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = WordEncoder(path)
        end = np.array([END_ID], "<u4").tobytes()

        def one(text):
            ids = encode(text or b"") + end
            n, out = len(ids) // 4, []
            for a in range(0, n, max_tokens):
                own = ids[4 * a : 4 * (a + max_tokens)]
                row = (a, len(own) // 4, zlib.crc32(own), n)
                out.append((*row, np.frombuffer(own, "<u4")) if keep_ids else row)
            return out

        one.prepare = encode.prepare
        return one

    ddl = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<bigint>" * keep_ids
    return explode_rows(docs.select(id_col, text_col), [id_col], text_col, make, ddl)


def shortest_pack_first(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, Pattern]]:
    """(copies, lengths in pack order) of every packing pattern."""
    room: dict[int, Counter] = {}  # free ids -> copies of each open pattern
    done: Counter = Counter()

    def add(pattern: Pattern, free: int, copies: int) -> None:
        if copies:
            (room.setdefault(free, Counter()) if free else done)[pattern] += copies

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max(room, default=0)
            if most < length:  # no pack takes it: a new one does, and is the shortest until it is full
                per = max_tokens // length
                add((length,) * per, max_tokens - per * length, left // per)
                add((length,) * (left % per), max_tokens - (left % per) * length, int(left % per > 0))
                break
            below = max((r for r in room if r < most), default=0)
            each = min(most // length, max(1, (most - below) // length))  # stays the shortest pack so long
            group = room[most]
            pattern, copies = next(iter(group.items()))
            if left < each:
                each = left
            took = min(copies, left // each)
            add(pattern + (length,) * each, most - each * length, took)
            left -= took * each
            group[pattern] -= took
            if not group[pattern]:
                del group[pattern]
            if not group:
                del room[most]
    for group in room.values():
        done.update(group)
    return [(n, p) for p, n in sorted(done.items(), reverse=True)]


def _places(patterns: list[tuple[int, Pattern]]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank) of the places, with first rank, first sequence and offset of each."""
    rows, taken, sequence = [], Counter(), 0
    for copies, pattern in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += copies
            offset += length
        sequence += copies
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, keep_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id (gapless from 0) and offset (gapless from 0 in each sequence)."""
    spark = docs.sparkSession
    cut = cut_lineage(
        pieces(docs, path, id_col, text_col, max_tokens, keep_ids).withColumn("__bucket", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(BUCKETS)))
    )
    cells = cut.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    places = spark.sparkContext.broadcast(_places(shortest_pack_first(histogram, max_tokens)))

    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("length", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    order = Window.partitionBy("length", "__bucket").orderBy(id_col, "start", "ids_crc32")
    ranked = cut.withColumn("__rank", F.row_number().over(order) - 1).join(base, ["length", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__base"))
    kept = [id_col, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def locate(batches):
        lengths, firsts, sequences, offsets = places.value
        begin = {int(x): int(i) for i, x in zip(*np.unique(lengths, return_index=True)[::-1])}
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                lo = begin[int(x)]
                hi = lo + int(np.searchsorted(lengths[lo:], x, "right"))
                at[own] = lo + np.searchsorted(firsts[lo:hi], rank[own], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(sequences[at] + rank - firsts[at]), pa.array(offsets[at])], names=[*kept, "sequence_id", "offset"]
            )

    slim = ranked.select(*kept, F.col("__rank").cast("bigint").alias("__rank"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*kept).schema.fields)
    return slim.mapInArrow(locate, f"{ddl}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with their ids; a sequence is at most ``max_tokens`` long."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
