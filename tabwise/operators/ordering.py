"""Exact order statistics without a single-task sort: positions, ranks and quantiles.

Values are first counted (``groupBy(value)``, so a value held by a third of the rows is one row from
there on). Ranks put the counted values of all columns in order at once, in blocks whose starts are carried
(``blocks``). Quantiles come from brackets a sketch proposes and exact counts prove.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise import config
from tabwise.operators import blocks
from tabwise.session import cut_lineage, several_passes, spread

INF = float("inf")
RANK_ROWS = 500_000  # rows of a range that are ranked at once


def unpivot_numeric(df: DataFrame, cols: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., name, value) with one row per non-null numeric cell."""
    cells = [e for c in cols for e in (F.lit(c), F.col(c).cast("double"))]
    df = spread(df.select(*dict.fromkeys([*keep, *cols])))
    return df.select(*keep, F.stack(F.lit(len(cols)), *cells).alias("name", "value")).filter(F.col("value").isNotNull())


def value_counts(df: DataFrame, cols: list[str], keep: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    extra = (weight,) if weight else ()
    long = unpivot_numeric(df, cols, (*keep, *extra))
    total = F.sum(weight) if weight else F.count(F.lit(1))
    return long.groupBy(*keep, "name", "value").agg(total.cast("bigint").alias("cnt"))


def _cut_points(df: DataFrame, cols: list[str], ranges: int) -> dict[str, list[float]]:
    """Sketch-based range borders per column: at most ``ranges`` numbers each, one aggregation job."""
    probs = [i / ranges for i in range(1, ranges)]
    accuracy = max(config.SKETCH_ACCURACY, 20 * ranges)
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(c) for c in cols]).first()
    return {c: sorted({v for v in (row[c] or []) if v == v and abs(v) != INF}) for c in cols}


def range_index(value: Column, cuts: list[float]) -> Column:
    """Number of cut points below ``value``, by halving (a balanced CASE tree the JVM compiles)."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(cuts[mid]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(cuts))


def positions(df: DataFrame, cols: list[str], weight: str | None = None, task_rows: int | None = None) -> DataFrame:
    """(name, value, cnt, before): per distinct value its row count and the count of smaller values."""
    task_rows = task_rows or config.TASK_ROWS
    counted = value_counts(df, cols, weight=weight)
    rows = df.count()
    if rows <= task_rows:
        within = Window.partitionBy("name").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        return counted.withColumn("before", F.coalesce(F.sum("cnt").over(within), F.lit(0)))
    # all columns are put in order together; what a block starts from is one number per block
    placed = blocks.in_order(counted, ["name", "value"], task_rows)
    starts = blocks.starts(placed, _start=F.sum("cnt"))
    run = F.coalesce(F.sum("cnt").over(blocks.within().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = placed.withColumn("_run", run).join(F.broadcast(starts), blocks.BLOCK).withColumn("_all", F.col("_start") + F.col("_run"))
    totals = dict(placed.groupBy("name").agg(F.sum("cnt")).collect())  # one row per column
    first, at = {}, 0
    for name in sorted(totals):
        first[name], at = at, at + totals[name]
    offsets = df.sparkSession.createDataFrame(list(first.items()), "name string, _first long")
    return summed.join(F.broadcast(offsets), "name").select("name", "value", "cnt", (F.col("_all") - F.col("_first")).alias("before"))


def average_ranks(df: DataFrame, cols: list[str], task_rows: int | None = None) -> DataFrame:
    """(name, value, cnt, rank): ranks from 1, ties share their average."""
    pos = positions(df, cols, task_rows=task_rows)
    return pos.withColumn("rank", F.col("before") + (F.col("cnt") + 1) / 2).drop("before")


def with_average_rank(df: DataFrame, col: str, name: str, rows: int, task_rows: int | None = None) -> DataFrame:
    """``df`` (no nulls in ``col``, about ``rows`` rows) with ``name``: the rank of ``col`` from 1, ties share their average.

    Rows are dealt by ranges of the value, sorted and ranked where they lie, so no cell is shuffled back. A value may
    go on over several ranges (a hot one is no task's burden): only the first and the last value of a range can, and
    their ranks come from one row per range.
    """
    parts = max(1, -(-rows // min(task_rows or config.TASK_ROWS, RANK_ROWS)))
    keyed = df.withColumn(col, F.col(col).cast("double") + F.lit(0.0)).withColumn("_tie", F.monotonically_increasing_id())  # -0.0 is 0.0
    dealt = keyed.repartitionByRange(parts, col, "_tie").drop("_tie").sortWithinPartitions(col).withColumn("_part", F.spark_partition_id())

    def ranked(batches):
        pieces = list(batches)  # the rows of one range
        if not pieces:
            return
        p = pd.concat(pieces, ignore_index=True)
        v = p[col].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        size = np.diff(np.append(first, len(v)))
        p["_rank"], p["_ties"] = np.repeat(first + (size + 1) / 2, size), np.repeat(size, size)
        yield p

    schema = T.StructType([*dealt.schema.fields, T.StructField("_rank", T.DoubleType()), T.StructField("_ties", T.LongType())])
    placed = cut_lineage(dealt.mapInPandas(ranked, schema))
    value = F.struct(F.col(col), "_ties")
    ends = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()  # one row per range
    before: dict[float, int] = {}
    held: dict[float, int] = {}
    starts, at = [], 0
    for r in sorted(ends, key=lambda r: r["_part"]):
        (lo, n_lo), (hi, n_hi) = r["lo"], r["hi"]
        for v, skipped, n in [(lo, 0, n_lo)] + ([(hi, r["n"] - n_hi, n_hi)] if hi != lo else []):
            before.setdefault(v, at + skipped)
            held[v] = held.get(v, 0) + n
        starts.append((r["_part"], at, lo, hi))
        at += r["n"]
    rank = {v: before[v] + (held[v] + 1) / 2 for v in before}
    table = df.sparkSession.createDataFrame([(p, a, lo, hi, rank[lo], rank[hi]) for p, a, lo, hi in starts], "_part int, _at long, _lo double, _hi double, _first double, _last double")
    own = F.when(F.col(col) == F.col("_lo"), F.col("_first")).when(F.col(col) == F.col("_hi"), F.col("_last")).otherwise(F.col("_at") + F.col("_rank"))
    return placed.join(F.broadcast(table), "_part").select(*df.columns, own.alias(name))


def join_on_value(fact: DataFrame, table: DataFrame, keys: list[str], heavy_rows: int, rows: int) -> DataFrame:
    """Inner join of rows with a per-value table (column ``cnt`` = rows of that value), safe for hot values.

    Values held by at least ``heavy_rows`` rows are few (rows / heavy_rows at most), so they are
    broadcast; what is left has no hot key and is shuffled. Below ``heavy_rows`` rows in all, nothing is hot.
    """
    if rows < heavy_rows:
        return fact.join(table.drop("cnt").hint("merge"), keys)
    hot = table.filter(F.col("cnt") >= heavy_rows).drop("cnt")
    cold = table.filter(F.col("cnt") < heavy_rows).drop("cnt").hint("merge")
    on_hot = fact.join(F.broadcast(hot), keys)
    on_cold = fact.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return on_hot.unionByName(on_cold.select(on_hot.columns))


def exact_quantiles(
    df: DataFrame,
    cols: list[str],
    probs: tuple[float, ...],
    by: tuple[str, ...] = (),
    task_rows: int | None = None,
    max_groups: int = 10_000,
) -> DataFrame:
    """(by..., name, prob, value): linearly interpolated quantiles, equal to a full sort's answer.

    Inputs of at most 4 x ``task_rows`` cells: Spark's exact percentile in one pass. Larger ones: a sketch brackets each quantile, a
    second pass counts the rows below and inside each bracket (shrinking it until it fits one task),
    and only the inside is ordered. ``by`` is for report groups (chart categories, time buckets).
    """
    task_rows = task_rows or config.TASK_ROWS
    keys = list(by)
    if not keys:
        return _whole_columns(df, cols, probs, task_rows)[0]
    sizes = df.groupBy(*keys).agg(*[F.count(c).alias(c) for c in cols]).limit(max_groups + 1).collect()
    if len(sizes) > max_groups:
        raise ValueError(f"quantiles are reported for at most {max_groups} groups")
    if sum(r[c] for r in sizes for c in cols) <= task_rows:
        return _in_one_pass(df, cols, probs, keys)
    return _bracketed(df, cols, probs, keys, sizes, task_rows)


def _whole_columns(df: DataFrame, cols: list[str], probs: tuple[float, ...], task_rows: int, extra: tuple = ()):
    """Quantiles of whole columns: sketch, count around the brackets, order only what lies inside them.

    Three column-pruned scans without a shuffle of the data; brackets are numbers in the expressions.
    Returns (quantile table, row of the ``extra`` aggregates taken along in the first scan).
    """
    with several_passes(df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys(cols)])) as base:
        found, row = _quantile_passes(base, cols, probs, task_rows, extra)
        rows = found.collect()  # columns x probs numbers
    return df.sparkSession.createDataFrame(rows, "name string, prob double, value double"), row


def _quantile_passes(base: DataFrame, cols: list[str], probs: tuple[float, ...], task_rows: int, extra: tuple):
    accuracy = config.SKETCH_ACCURACY if not base.is_cached else config.SKETCH_ACCURACY // 10
    margin = 2.0 / accuracy
    around = [min(1.0, max(0.0, q)) for p in probs for q in (p - margin, p + margin)]
    row = base.agg(
        *[F.count(c).alias(f"n_{c}") for c in cols], *[F.percentile_approx(c, around, accuracy).alias(f"q_{c}") for c in cols], *extra
    ).first()
    n = {c: row[f"n_{c}"] for c in cols}
    if sum(n.values()) <= min(task_rows, 200_000):
        return _in_one_pass(base, cols, probs, []), row
    # (column, prob) -> [lo, hi, rows below lo, rows up to hi]; ``at`` holds brackets whose counts prove them
    at = {(c, p): [-INF, INF, 0, n[c]] for c in cols for p in probs if n[c]}
    tried = {(c, p): [row[f"q_{c}"][2 * i], row[f"q_{c}"][2 * i + 1]] for c in cols for i, p in enumerate(probs) if n[c]}
    slack = dict.fromkeys(at, margin)
    while tried:  # a bracket is tried again only if it got smaller or, after a miss, with four times the margin
        pending = list(tried)
        counts = base.agg(
            *[a for j, k in enumerate(pending) for a in (F.count_if(F.col(k[0]) < tried[k][0]).alias(f"l{j}"), F.count_if(F.col(k[0]) <= tried[k][1]).alias(f"u{j}"))]
        ).first()
        wide = []
        for j, k in enumerate(pending):
            h, (lo, hi), below, upto = k[1] * (n[k[0]] - 1), tried[k], counts[f"l{j}"], counts[f"u{j}"]
            if below > math.floor(h) or upto <= math.ceil(h):
                slack[k] *= 4  # the sketch missed
                if slack[k] < 1:
                    wide.append(k)
            elif upto - below < at[k][3] - at[k][2] or at[k][0] == -INF:
                at[k] = [lo, hi, below, upto]
                if lo < hi and upto - below > task_rows:
                    wide.append(k)
        if not wide:
            break
        again = {}
        for k in wide:
            _, _, below, upto = at[k]
            pos = (k[1] * (n[k[0]] - 1) - below) / max(upto - below - 1, 1)
            again[k] = [min(1.0, max(0.0, pos - slack[k])), min(1.0, max(0.0, pos + slack[k]))]
        inner = base.agg(
            *[F.percentile_approx(F.when(F.col(k[0]).between(at[k][0], at[k][1]), F.col(k[0])), again[k], accuracy).alias(f"r{j}") for j, k in enumerate(wide)]
        ).first()
        tried = {
            k: [at[k][0] if again[k][0] == 0.0 else inner[f"r{j}"][0], at[k][1] if again[k][1] == 1.0 else inner[f"r{j}"][1]] for j, k in enumerate(wide)
        }
    spark = base.sparkSession
    settled = [(c, float(p), float(lo)) for (c, p), (lo, hi, _, _) in at.items() if lo == hi]
    out = spark.createDataFrame(settled, "name string, prob double, value double")
    open_ = {k: v for k, v in at.items() if v[0] < v[1]}
    if not open_:
        return out, row
    inside = {k: F.col(k[0]).between(v[0], v[1]) for k, v in open_.items()}
    cells = [
        F.when(inside[c, p], F.struct(F.lit(c).alias("name"), F.lit(float(p)).alias("prob"), F.lit(v[2]).cast("bigint").alias("below"), F.lit(n[c]).cast("bigint").alias("n"), F.col(c).alias("value")))
        for (c, p), v in open_.items()
    ]
    few = base.filter(reduce(lambda x, y: x | y, inside.values()))  # most rows lie in no bracket
    counted = few.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("name", "prob", "below", "n", "value").agg(F.count(F.lit(1)).alias("cnt"))
    win = Window.partitionBy("name", "prob").orderBy("value")
    return out.unionByName(_interpolate(counted.withColumn("upto", F.sum("cnt").over(win)), [])), row


def _in_one_pass(df: DataFrame, cols: list[str], probs: tuple[float, ...], keys: list[str]) -> DataFrame:
    wanted = [float(p) for p in probs]
    got = df.select(*dict.fromkeys([*keys, *cols])).groupBy(*keys).agg(
        *[F.percentile(F.col(c).cast("double"), wanted).alias(f"q_{i}") for i, c in enumerate(cols)]
    )
    cells = [
        F.struct(F.lit(c).alias("name"), F.lit(p).alias("prob"), F.col(f"q_{i}")[j].alias("value"))
        for i, c in enumerate(cols) for j, p in enumerate(wanted)
    ]
    return got.select(*keys, F.inline(F.array(*cells))).filter(F.col("value").isNotNull())


def _interpolate(placed: DataFrame, keys: list[str]) -> DataFrame:
    """From (.., value, cnt, upto, n, below, prob) pick the two neighbours of each wanted rank."""
    h = F.col("prob") * (F.col("n") - 1)
    first, last = F.col("below") + F.col("upto") - F.col("cnt"), F.col("below") + F.col("upto") - 1
    lo, hi = F.floor(h), F.ceil(h)
    return (
        placed.withColumn("h", h)
        .groupBy(*keys, "name", "prob")
        .agg(
            F.max(F.when((lo >= first) & (lo <= last), F.col("value"))).alias("a"),
            F.max(F.when((hi >= first) & (hi <= last), F.col("value"))).alias("b"),
            F.max(h - F.floor(h)).alias("f"),
        )
        .select(*keys, "name", "prob", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("value"))
    )


def _bracketed(df, cols, probs, keys, sizes, task_rows) -> DataFrame:
    spark = df.sparkSession
    key_of = lambda r: tuple(r[k] for k in keys)
    n_of = {(key_of(r), c): r[c] for r in sizes for c in cols}
    # bracket: [lo, hi] values known to hold both neighbours of the wanted rank; below = rows < lo
    state = {(g, c, p): [-INF, INF, 0, n_of[g, c]] for (g, c), n in n_of.items() if n for p in probs}
    long = unpivot_numeric(df, cols, tuple(keys))
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField("name", T.StringType()), T.StructField("prob", T.DoubleType())]
        + [T.StructField(f, T.DoubleType()) for f in ("lo", "hi")]
        + [T.StructField(f, T.LongType()) for f in ("below", "n")]
    )

    def table(items) -> DataFrame:
        rows = [(*g, c, float(p), s[0], s[1], s[2], n_of[g, c]) for (g, c, p), s in items]
        return F.broadcast(spark.createDataFrame(rows, schema))

    for _ in range(8):
        wide = [(k, s) for k, s in state.items() if s[3] > task_rows and s[0] < s[1]]
        if not wide:
            break
        margin = 2.0 / config.SKETCH_ACCURACY
        inside = long.join(table(wide), [*keys, "name"]).filter(F.col("value").between(F.col("lo"), F.col("hi")))
        sketch = inside.groupBy(*keys, "name", "prob").agg(
            F.percentile_approx("value", [i / 1000 for i in range(1001)], config.SKETCH_ACCURACY).alias("grid")
        ).collect()
        trial = {}
        for r in sketch:
            k = (key_of(r), r["name"], r["prob"])
            lo, hi, below, size = state[k]
            rank = r["prob"] * (n_of[k[0], k[1]] - 1)
            pos = (rank - below) / max(size - 1, 1)
            a, b = math.floor((pos - margin) * 1000) - 1, math.ceil((pos + margin) * 1000) + 1
            trial[k] = [r["grid"][a] if a >= 0 else lo, r["grid"][b] if b <= 1000 else hi, below, size]
        counts = (
            long.join(table(list(trial.items())), [*keys, "name"])
            .groupBy(*keys, "name", "prob")
            .agg(F.count_if(F.col("value") < F.col("lo")).alias("lt"), F.count_if(F.col("value") <= F.col("hi")).alias("le"))
            .collect()
        )
        for r in counts:
            k = (key_of(r), r["name"], r["prob"])
            h = r["prob"] * (n_of[k[0], k[1]] - 1)
            if r["lt"] <= math.floor(h) and r["le"] > math.ceil(h):  # proven to hold both neighbours
                state[k] = [trial[k][0], trial[k][1], r["lt"], r["le"] - r["lt"]]
    brackets = table(list(state.items()))
    counted = (
        long.join(brackets, [*keys, "name"])
        .filter(F.col("value").between(F.col("lo"), F.col("hi")))
        .groupBy(*keys, "name", "prob", "below", "n", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    win = Window.partitionBy(*keys, "name", "prob").orderBy("value")
    return _interpolate(counted.withColumn("upto", F.sum("cnt").over(win)), keys)


def group_medians(rows: DataFrame, keys: list[str], col: str, task_rows: int | None = None) -> DataFrame:
    """(keys..., value): exact median of every group, for any number of groups of any size.

    Groups of at least ``task_rows`` rows are few (rows / task_rows at most) and take the bracketed way;
    the others fit a task each and use Spark's exact percentile.
    """
    task_rows = task_rows or config.TASK_ROWS
    big = rows.groupBy(*keys).agg(F.count(col).alias("_n")).filter(F.col("_n") >= task_rows).drop("_n")
    if not big.head(1):
        return rows.groupBy(*keys).agg(F.percentile(F.col(col).cast("double"), 0.5).alias("value"))
    small = rows.join(F.broadcast(big), keys, "left_anti").groupBy(*keys).agg(F.percentile(F.col(col).cast("double"), 0.5).alias("value"))
    large = exact_quantiles(rows.join(F.broadcast(big), keys, "left_semi"), [col], (0.5,), tuple(keys), task_rows, max_groups=1_000_000)
    return small.unionByName(large.select(*keys, "value"))


def quantiles_and_more(df: DataFrame, cols: list[str], probs: tuple[float, ...], extra: list) -> tuple[DataFrame, object]:
    """Whole-column quantiles plus a row of further aggregates over the same (double) columns, sharing a scan."""
    return _whole_columns(df, cols, probs, config.TASK_ROWS, tuple(extra))


def quantile_map(df: DataFrame, cols: list[str], probs: tuple[float, ...]) -> dict[tuple[str, float], float]:
    """Quantiles of whole columns as a driver dict (columns x probs numbers)."""
    return {(r["name"], r["prob"]): r["value"] for r in exact_quantiles(df, cols, probs).collect()}
