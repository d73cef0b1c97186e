"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A repeated run is ``run_lines`` or more consecutive lines, or one line of at least ``long_words`` words, that an
earlier document (order of ids) or an earlier place of the same document holds too. Each window of ``run_lines``
lines gives up its smallest line hash as fingerprint (a long line is a window of its own), so whatever two places
share, they share a fingerprint. Fingerprints that occur once end the search there. Where one repeats, its positions
meet in the window's whole hash, the first place stays, the later ones go; windows next to each other join up, which
extends a match both ways to its full run. Places meet in aggregates and in joins with one row per window, never in
pairs, so a line that a third of all documents hold costs one row per occurrence.

Defined results: null and empty texts have no lines and stay as they are; two places of one document count only
where they do not overlap; rows that repeat id and text are one document and get the same result; an empty table
gives no rows; a document all of whose lines went stays with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.session import cut_lineage

RUN_LINES = 2
LONG_WORDS = 50


def _lines(text_col: str):
    return F.when(F.length(text_col) > 0, F.split(F.col(text_col), "\n", -1)).otherwise(F.array().cast("array<string>"))


def _own(id_col: str, text_col: str):
    """128 bits that stand for a row's id and text."""
    return [F.xxhash64(id_col, text_col).alias("__k1"), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("__k2")]


def windows(docs: DataFrame, id_col: str, text_col: str, run_lines: int, long_words: int) -> DataFrame:
    """(id, __k1, __k2, s, n, low, w1, w2): every window with its fingerprint and 128 bits of its lines."""
    lines = docs.select(id_col, *_own(id_col, text_col), _lines(text_col).alias("l"))
    hashed = lines.select(
        id_col, "__k1", "__k2",
        F.transform("l", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("l", lambda x: F.xxhash64(F.lit(1), x)).alias("g"),
        F.transform("l", lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1 >= long_words).alias("long"),
    )

    def window(i, n):
        h, g = F.slice("h", i + 1, n), F.slice("g", i + 1, n)
        return F.struct(i.alias("s"), n.alias("n"), F.array_min(h).alias("low"), F.xxhash64(n, h).alias("w1"), F.xxhash64(n, g).alias("w2"))

    places = F.sequence(F.lit(0), F.size("h") - 1)
    runs = F.when(F.size("h") >= run_lines, F.transform(F.sequence(F.lit(0), F.size("h") - run_lines), lambda i: window(i, F.lit(run_lines))))
    alone = F.when(F.size("h") > 0, F.transform(F.filter(places, lambda i: F.element_at("long", i + 1)), lambda i: window(i, F.lit(1))))
    none = F.array().cast("array<struct<s:int,n:int,low:bigint,w1:bigint,w2:bigint>>")
    every = F.concat(F.coalesce(runs, none), F.coalesce(alone, none))
    return hashed.select(id_col, "__k1", "__k2", F.explode(every).alias("w")).select(id_col, "__k1", "__k2", "w.*")


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_lines: int = RUN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """(__k1, __k2, s, n): the windows of each document that an earlier place holds."""
    every = cut_lineage(windows(docs, id_col, text_col, run_lines, long_words))
    repeated = every.groupBy("low").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("low")
    met = every.join(repeated, "low")
    place = F.struct(F.col(id_col).alias("i"), F.col("__k1").alias("a"), F.col("__k2").alias("b"), F.col("s").alias("s"))
    firsts = met.groupBy("w1", "w2").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    same_doc = (F.col("f.a") == F.col("__k1")) & (F.col("f.b") == F.col("__k2"))
    return met.join(firsts, ["w1", "w2"]).filter(~same_doc | (F.col("s") >= F.col("f.s") + F.col("n"))).select("__k1", "__k2", "s", "n").distinct()


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_lines: int = RUN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with the text that is left, and __lines, __removed, __runs: lines there were, went, in how many runs."""
    later = later_windows(docs, id_col, text_col, run_lines, long_words)
    per_doc = later.groupBy("__k1", "__k2").agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("__later"))
    own = docs.withColumns({"__k1": _own(id_col, text_col)[0], "__k2": _own(id_col, text_col)[1]})
    joined = own.join(per_doc, ["__k1", "__k2"], "left").withColumn("__l", _lines(text_col))
    swept = F.expr(
        """aggregate(__later, struct(-1 as stop, 0 as runs, array(struct(0 as a, 0 as n)) as gaps),
            (t, w) -> struct(greatest(t.stop, w.s + w.n) as stop,
                             t.runs + if(w.s > t.stop, 1, 0) as runs,
                             if(w.s > greatest(t.stop, 0), concat(t.gaps, array(struct(greatest(t.stop, 0) as a, w.s - greatest(t.stop, 0) as n))), t.gaps) as gaps))"""
    )
    cut = joined.withColumn("__t", F.when(F.col("__later").isNotNull(), swept))
    tail = F.expr("struct(__t.stop as a, size(__l) - __t.stop as n)")
    kept = F.flatten(F.transform(F.concat("__t.gaps", F.array(tail)), lambda g: F.slice("__l", g["a"] + 1, g["n"])))
    text = F.when(F.col("__t").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    lines = F.size("__l").cast("bigint")
    return cut.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        lines.alias("__lines"),
        F.when(F.col("__t").isNull(), F.lit(0)).otherwise(lines - F.size(kept)).cast("bigint").alias("__removed"),
        F.coalesce("__t.runs", F.lit(0)).cast("bigint").alias("__runs"),
    )
