"""SimHash near-duplicates: positional-byte index, count filter, verification, linked components.

Two 64-bit fingerprints that differ in at most three bits differ in at most three of their eight bytes, so they
share at least five positional bytes. The index therefore lists fingerprints under sets of four positional bytes;
the fourteen sets used (positions whose numbers xor to zero) meet every way in which three bytes can differ, so
each such pair shares a list. Within a list the shared positional bytes of each pair are tallied, pairs under
five go, the others are verified bit by bit. The index holds distinct fingerprints only: copies, however many,
are one entry.

A list too long to be compared pairwise is linked exactly without pairs: every member names all values within two
flips of its free bits; whoever comes within one flip of such a value and whoever comes within two are at most
three apart, and any pair at most three apart meets at one.

Defined results: null and wordless texts have fingerprint 0 and are linked like any other; repeated rows are
copies; null ids never name a component unless all its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwise.llm.common import add_columns
from tabwise.operators.neighbors import connected_components
from tabwise.session import cut_lineage

SHINGLE_WORDS = 3
MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
PAIRWISE_LIST = 512
CHUNK = 65_536
BYTE_SETS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash over all word shingles, repeats included; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(line, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        part = [digest(line[a:b], 42) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])]
        ones += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fp", width: int = SHINGLE_WORDS, keep_text: bool = False) -> DataFrame:
    """``docs`` with the fingerprint as a signed long in ``name``."""

    def make():
        def one(text):
            value = fingerprint(text, width)
            return (value - (1 << 64) if value >> 63 else value,)

        return one

    return add_columns(docs, text_col, make, f"`{name}` bigint", drop_source=not keep_text)


def _masked(byte_set) -> int:
    value = sum(255 << 8 * p for p in byte_set)
    return value - (1 << 64) if value >> 63 else value


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(u, v): links between the distinct fingerprints in column ``fp`` that join all pairs at most three bits apart."""
    keys = F.array(*[F.struct(F.lit(i).alias("s"), F.col("fp").bitwiseAND(F.lit(_masked(s))).alias("part")) for i, s in enumerate(BYTE_SETS)])
    index = cut_lineage(fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.s", "k.part"))
    sizes = index.groupBy("s", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    listed = cut_lineage(index.join(sizes, ["s", "part"]))

    tally = " + ".join(f"if(((a ^ b) & {_masked([p])}L) = 0, 1, 0)" if p < 7 else "if(shiftrightunsigned(a ^ b, 56) = 0, 1, 0)" for p in range(8))
    pairs = (
        listed.filter(F.col("n") <= PAIRWISE_LIST)
        .groupBy("s", "part")
        .agg(F.collect_list("fp").alias("l"))
        .select(F.expr(f"explode(flatten(transform(l, a -> transform(filter(l, b -> b > a and {tally} >= {MIN_SHARED} and bit_count(a ^ b) <= {MAX_BITS}), b -> struct(a as u, b as v)))))").alias("e"))
        .select("e.u", "e.v")
    )
    return pairs.unionByName(_long_lists(listed.filter(F.col("n") > PAIRWISE_LIST)))


def _long_lists(members: DataFrame) -> DataFrame:
    """Links of lists of any length: members meet at the values within reach of their free bits."""
    flips = []
    for s in BYTE_SETS:
        free = [1 << 8 * p + b for p in range(8) if p not in s for b in range(8)]
        masks = [0, *free, *[x | y for x, y in combinations(free, 2)]]
        flips.append(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks]))
    near = F.lit(None).cast("array<bigint>")
    for i, f in enumerate(flips):
        near = F.when(F.col("s") == i, f).otherwise(near)
    met = members.select("fp", "s", F.explode(near).alias("mask")).select("fp", "s", F.col("fp").bitwiseXOR(F.col("mask")).alias("at"), F.bit_count("mask").alias("away"))
    # at most 1 + 32 + 496 members lie within two flips of a value
    groups = met.groupBy("s", "at").agg(F.min(F.when(F.col("away") <= 1, F.col("fp"))).alias("u"), F.collect_list("fp").alias("l")).filter("u is not null and size(l) > 1")
    return groups.select("u", F.explode("l").alias("v")).filter("u != v")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): one row per document with the smallest id its fingerprint is linked to."""
    rows = cut_lineage(with_fingerprints(docs.select(id_col, text_col), text_col))
    return rows.join(_components(rows.groupBy("fp").agg(F.min(id_col).alias("low"))), "fp")


def _components(distinct: DataFrame) -> DataFrame:
    """(fp, component) of (fp, low): linked fingerprints share the smallest low."""
    distinct = cut_lineage(distinct)
    links = cut_lineage(fingerprint_links(distinct.select("fp")))
    linked = links.select(F.explode(F.array("u", "v")).alias("pid")).distinct()
    labels = connected_components(links, linked).withColumnRenamed("pid", "fp")
    grouped = distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    low = grouped.groupBy("label").agg(F.min("low").alias("component"))
    return grouped.join(low, "label").select("fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each linked group the document with the smallest (id, text)."""
    cols = docs.columns
    marked = with_fingerprints(docs.withColumn("__own", F.xxhash64(id_col, text_col)), text_col, "__fp", keep_text=True)
    slim = cut_lineage(marked.select(id_col, "__own", "__fp"))
    rank = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("__own").alias("o"))
    firsts = slim.groupBy(F.col("__fp").alias("fp")).agg(F.min(rank).alias("low"))
    heads = _components(firsts).select("component").distinct().select(F.col("component.i").alias("__i"), F.col("component.o").alias("__o"))
    # repeated rows are alike in all that ranks them: one of them stays
    own = docs.withColumn("__own", F.xxhash64(id_col, text_col))
    kept = own.join(heads, (own["__own"] == heads["__o"]) & own[id_col].eqNullSafe(heads["__i"]))
    once = Window.partitionBy("__own", id_col).orderBy(F.lit(1))
    return kept.withColumn("__n", F.row_number().over(once)).filter("__n = 1").select(*cols)
