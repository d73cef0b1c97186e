"""Benchmark decontamination: prefix-filtered set join of item windows with whole documents.

A window is ten consecutive words of a benchmark item (an item of fewer words is one window). Words are ordered by
their rarity over all documents; containment must be whole, so the prefix of a window that has to be joined is its
one rarest word. A document joins on that word only; the position of the word in the window bounds where the
window may begin and end in the document, and what fits the bounds is verified word by word.

The joined side is the benchmark. Its windows are counted first; a pass broadcasts at most ``PASS_WINDOWS`` of them,
and a larger benchmark takes several passes with the hits so far written between them.

Defined results: null and wordless texts have no hits; wordless items and null items have no window; items that
repeat an id count as one; repeated documents each get a row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import add_columns, explode_rows, merged
from tabwise.session import cut_lineage

WINDOW_WORDS = 10
PASS_WINDOWS = 400_000
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all bytes beyond ASCII."""
    return (text or b"").translate(_WORD_BYTES).split()


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW_WORDS) -> DataFrame:
    """(win, items): each distinct window, its words joined by spaces, with the ids of its items as strings."""

    def make():
        def one(text):
            w = words(text)
            if not w:
                return []
            return [(b" ".join(w[i : i + width]),) for i in range(max(1, len(w) - width + 1))]

        return one

    rows = explode_rows(benchmark.select(id_col, text_col), [id_col], text_col, make, "win binary")
    return rows.groupBy("win").agg(F.collect_set(F.col(id_col).cast("string")).alias("items"))


def word_counts(docs: DataFrame, vocabulary, text_col: str = "text") -> DataFrame:
    """(word, n): occurrences over all documents of the words in the broadcast ``vocabulary``."""

    def run(batches):
        import pyarrow as pa

        known = vocabulary.value
        total: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in words(text):
                    if w in known:
                        total[w] = total.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    parts = docs.select(F.col(text_col).cast("binary").alias("b")).mapInArrow(run, "word binary, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _prefix_index(windows, counts: dict[bytes, int]) -> dict[bytes, list[tuple]]:
    """Rarest word -> (its place in the window, the window's words, the items)."""
    index: dict[bytes, list[tuple]] = {}
    for row in windows:
        w = bytes(row["win"]).split(b" ")
        rare = min(w, key=lambda x: (counts.get(x, 0), x))
        index.setdefault(rare, []).append((w.index(rare), w, list(row["items"])))
    return index


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WINDOW_WORDS, keep_text: bool = False) -> DataFrame:
    """``docs`` with __words (their number), __spans (hit word ranges as flat pairs) and __items (ids as sorted strings)."""
    spark = docs.sparkSession
    windows = cut_lineage(item_windows(benchmark, width=width))
    n = windows.count()
    passes = max(1, -(-n // PASS_WINDOWS))
    out = docs.withColumns({"__words": F.lit(0).cast("bigint"), "__spans": F.array().cast("array<bigint>"), "__items": F.array().cast("array<string>")})
    for k in range(passes):
        own = windows.filter(F.pmod(F.xxhash64("win"), F.lit(passes)) == k).collect()
        vocabulary = spark.sparkContext.broadcast({w for r in own for w in bytes(r["win"]).split(b" ")})
        counts = {bytes(r["word"]): r["n"] for r in word_counts(docs, vocabulary, text_col).collect()}
        index = spark.sparkContext.broadcast(_prefix_index(own, counts))
        found = add_columns(out, text_col, _finder(index), "__w bigint, __s array<bigint>, __i array<string>", drop_source=not keep_text and k == passes - 1)
        out = found.withColumns(
            {"__words": F.col("__w"), "__spans": F.concat("__spans", "__s"), "__items": F.array_sort(F.array_union("__items", "__i"))}
        ).drop("__w", "__s", "__i")
        if k < passes - 1:
            out = cut_lineage(out)
    return out


def _finder(index):
    def make():
        rare = index.value

        def one(text):
            w = words(text)
            spans, items = [], set()
            for i, x in enumerate(w):
                if x in rare:
                    for place, win, ids in rare[x]:
                        start = i - place
                        if start >= 0 and start + len(win) <= len(w) and w[start : start + len(win)] == win:
                            spans.append((start, start + len(win)))
                            items.update(ids)
            return len(w), [x for s in merged(spans) for x in s], sorted(items)

        return one

    return make


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated), one row per document."""
    found = with_hits(docs.select(id_col, text_col), benchmark, text_col)

    def covered(flat):
        pairs = F.expr("transform(sequence(0, size(__spans) div 2 - 1), i -> struct(__spans[2 * i] as a, __spans[2 * i + 1] as b))")
        swept = F.aggregate(
            F.array_sort(pairs),
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("end")),
            lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(flat) > 0, swept).otherwise(F.lit(0).cast("bigint"))

    hit = found.withColumn("n_hit", covered(F.col("__spans")))
    return hit.select(
        id_col,
        F.col("__words").alias("n_words"),
        "n_hit",
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs."""
    return with_hits(docs, benchmark, text_col, keep_text=True).filter(F.size("__spans") == 0).select(*docs.columns)


def digest(item_ids: list[str]) -> str:
    """What ``items_sha256`` holds for these item ids."""
    return hashlib.sha256(",".join(sorted(set(item_ids))).encode()).hexdigest()
