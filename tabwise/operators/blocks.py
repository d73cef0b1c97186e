"""Rows in order, in blocks: what a sorted whole would give (places, running sums, rows before), without a one-task sort.

``in_order`` deals rows by ranges of the order, sorts each range and writes the result down with the block and the
place in the block of every row. What a block needs from those before it is one row per block: totals, last rows or
the state of a recursion, carried over on the driver (``starts``) or, where it is large, composed in tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise import config
from tabwise.session import cut_lineage

BLOCK, SEQ = "_block", "_seq"


def in_order(df: DataFrame, order: list[str], block_rows: int | None = None, rows: int | None = None) -> DataFrame:
    """``df`` with _block and _seq: rows sorted by (_block, _seq) are sorted by ``order`` (nulls first). Equal rows share a block."""
    rows = df.count() if rows is None else rows
    parts = max(1, -(-rows // (block_rows or config.TASK_ROWS)))
    placed = df.repartitionByRange(parts, *order) if parts > 1 else df.coalesce(1)
    mark = F.monotonically_increasing_id()
    marked = placed.sortWithinPartitions(*order).withColumn("_mark", mark)
    shift = F.shiftright("_mark", 33).cast("int")
    return cut_lineage(marked.withColumns({BLOCK: shift, SEQ: F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_mark"))


def starts(df: DataFrame, **totals: Column) -> DataFrame:
    """(_block, ...): for every block the sum of ``totals`` over the blocks before it; one row per block, to be broadcast."""
    per = df.groupBy(BLOCK).agg(*[t.alias(n) for n, t in totals.items()]).orderBy(BLOCK).collect()
    run, out = [0] * len(totals), []
    for r in per:
        out.append((r[BLOCK], *run))
        run = [a + (r[n] or 0) for a, n in zip(run, totals)]
    kinds = {n: "double" if any(isinstance(r[n], float) for r in per) else "long" for n in totals}
    schema = ", ".join([f"{BLOCK} int", *[f"{n} {k}" for n, k in kinds.items()]])
    return df.sparkSession.createDataFrame([tuple(float(v) if k == "double" else v for v, k in zip(row, ["int", *kinds.values()])) for row in out], schema)


def within() -> Window:
    return Window.partitionBy(BLOCK).orderBy(SEQ)


def numbered(placed: DataFrame, name: str = "idx") -> DataFrame:
    """``placed`` with the 0-based place of each row in the whole order."""
    first = starts(placed, _start=F.count(F.lit(1)))
    return placed.join(F.broadcast(first), BLOCK).withColumn(name, F.col("_start") + F.col(SEQ)).drop("_start")


def with_halo(placed: DataFrame, idx: str, reach: int, block_rows: int) -> DataFrame:
    """Rows dealt to blocks of ``block_rows`` places, each with ``reach`` rows of its neighbours on both sides: column
    ``halo`` names the block, ``own`` tells whether the row belongs to it."""
    home = F.floor(F.col(idx) / block_rows)
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col(idx) - reach) / block_rows)), F.floor((F.col(idx) + reach) / block_rows))
    return placed.select("*", F.explode(near).alias("halo")).withColumn("own", F.col("halo") == home)
