"""Mutual information of numeric columns by nearest neighbours (Kraskov, Stoegbauer, Grassberger 2004; Ross 2014 for classes).

For a pair of columns every row's distance to its k-th neighbour (largest of the two differences) is found through
space cells; how many rows lie nearer than that in one column alone are range counts, which are differences of places
in the sorted column: values and both ends of every range go through one ordering in blocks, for all pairs at once.

For classes a column is dealt by ranges of its values, once, and a task works off its range in memory: a row's nearest
of its own class and all rows within that distance. Nothing of a row's size is written down. What a range cannot tell
alone is a few rows for each class: those near the range's ends are put together to find their neighbours, and ranges
that reach beyond are counted in one more pass over the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.functions import text as tx
from tabwise.operators import blocks
from tabwise.operators.neighbors import in_space, neighbors_in_space
from tabwise.session import cut_lineage, side_by_side

NEIGHBORS = 3
JITTER = 1e-10
CELL_POINTS = 1_000
SIDE_ROWS = 500_000  # rows of a column a task holds in order
ASKED_ROWS = 1_000_000  # rows whose ranges are counted in one pass


def digamma(n: Column) -> Column:
    """Digamma of whole numbers from 1, to double precision: shifted up by ten, then the asymptotic series."""
    x = n.cast("double") + 10
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)
    out = series
    for i in range(10):
        out = out - 1 / (n.cast("double") + i)
    return out


def _parts(rows: DataFrame, cols: list[str]) -> dict[str, tuple[Column, Column]]:
    """Per column its value in standard deviations and a jitter far below that, which comes from the row's number."""
    stats = rows.agg(*[f for c in cols for f in (F.stddev_pop(c).alias(f"s_{c}"), F.avg(F.abs(F.col(c))).alias(f"m_{c}"))]).first()
    out = {}
    for c in cols:
        s = stats[f"s_{c}"] or 1.0
        noise = F.xxhash64("pid", F.lit(c)).cast("double") / 2.0**63
        out[c] = F.col(c) / s, noise * (JITTER * max(1.0, (stats[f"m_{c}"] or 0.0) / s))
    return out


def _scaled(rows: DataFrame, cols: list[str]) -> DataFrame:
    """``cols`` over their standard deviation, with a jitter that tells equal values apart."""
    return rows.select("pid", *[(v + noise).alias(c) for c, (v, noise) in _parts(rows, cols).items()])


def _total(a, b, rest=0.0):
    """a + b + ``rest`` (far below them) as two doubles: the nearest to the sum, and what it lacks."""

    def exact(x, y):
        s = x + y
        t = s - x
        return s, (x - (s - t)) + (y - t)

    s, left = exact(a, b)
    return exact(s, left + rest)


def _ends(v, v_lo, r, r_lo, rounding: float):
    """The lowest and the highest value strictly nearer than r to v, each as two doubles; v itself where r is no more than rounding."""
    hi, lo = _total(r, r_lo, -(abs(v) + r) * rounding)
    some = (hi > 0) & (r > 0)
    hi, lo = np.where(some, hi, 0.0), np.where(some, lo, 0.0)
    (a, a_lo), (b, b_lo) = _total(v, -hi, v_lo - lo), _total(v, hi, v_lo + lo)
    return (a + 0.0, a_lo + 0.0), (b + 0.0, b_lo + 0.0)


def _counts(asked: DataFrame, rounding: float = 2.0**-50) -> DataFrame:
    """(name, pid, n): rows of the column ``name`` strictly nearer than r to v, of (name, pid, v, r[, v_lo, r_lo]).

    A row counts itself; where r is no more than ``rounding`` of v and r, the rows of the very same value count.
    """
    if "v_lo" not in asked.columns:
        asked = asked.withColumns({"v_lo": F.lit(0.0), "r_lo": F.lit(0.0)})

    @F.pandas_udf("a double, a_lo double, b double, b_lo double")
    def reach(v: pd.Series, v_lo: pd.Series, r: pd.Series, r_lo: pd.Series) -> pd.DataFrame:
        (a, a_lo), (b, b_lo) = _ends(v, v_lo, r, r_lo, rounding)
        return pd.DataFrame({"a": a, "a_lo": a_lo, "b": b, "b_lo": b_lo})

    asked = asked.select("name", "pid", "v", "v_lo", reach("v", "v_lo", "r", "r_lo").alias("to"))
    ends = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(at).alias("at"), F.col(lo).alias("lo")) for kind, at, lo in ((0, "to.a", "to.a_lo"), (1, "v", "v_lo"), (2, "to.b", "to.b_lo"))])
    rows = asked.select("name", "pid", F.inline(ends))
    placed = blocks.in_order(rows, ["name", "at", "lo", "kind"])
    is_value = (F.col("kind") == 1).cast("bigint")
    before = blocks.starts(placed, _before=F.sum(is_value))
    run = F.sum(is_value).over(blocks.within().rowsBetween(Window.unboundedPreceding, 0))
    place = placed.withColumn("_run", run).filter("kind <> 1").join(F.broadcast(before), blocks.BLOCK).withColumn("_place", F.col("_before") + F.col("_run"))
    return place.groupBy("name", "pid").agg(F.sum(F.when(F.col("kind") == 2, F.col("_place")).otherwise(-F.col("_place"))).alias("n"))


def neighbor_information(df: DataFrame, features: list[str], target: str, k: int = NEIGHBORS, top: int = 15, cell_points: int = CELL_POINTS) -> DataFrame:
    """(feature, mi): mutual information of each numeric feature with the target over the rows complete in all of them."""
    cols = list(dict.fromkeys([*features, target]))
    complete = df.select(*[tx.numeric(df, c).alias(c) for c in cols]).na.drop()
    base = cut_lineage(complete.withColumn("pid", F.monotonically_increasing_id()))
    n = base.count()
    if n <= k:
        return df.sparkSession.createDataFrame([], "feature string, mi double")
    scaled = cut_lineage(_scaled(base, cols))

    def pair(feature: str) -> DataFrame:
        points = scaled.select("pid", F.lit(1).cast("bigint").alias("copies"), F.col(feature).alias("x"), F.col(target).alias("y"))
        placed, space = in_space(cut_lineage(points), ["x", "y"], "pid", max(cell_points, 4 * k))
        near = neighbors_in_space(placed, space, ["x", "y"], k, largest=True)
        radius = near.groupBy("pid").agg(F.max("d").alias("r"))
        both = placed.join(radius, "pid")
        return cut_lineage(both.select(F.lit(feature).alias("feature"), "pid", "x", "y", "r"))

    found = side_by_side([lambda f=f: pair(f) for f in features])
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    sides = F.array(*[F.struct(F.concat_ws("\x00", "feature", F.lit(s)).alias("name"), F.col(s).alias("v")) for s in "xy"])
    asked = every.select("pid", "r", F.inline(sides))
    per = _counts(asked).groupBy("name", "n").agg(F.count(F.lit(1)).alias("rows"))
    mean = per.groupBy(F.split("name", "\x00")[0].alias("feature")).agg((F.sum(F.col("rows") * digamma(F.col("n"))) / n).alias("m"))
    whole = digamma(F.lit(n)) + digamma(F.lit(k))
    return mean.select("feature", F.greatest(F.lit(0.0), whole - F.col("m")).alias("mi")).orderBy(F.desc("mi"), "feature").limit(top)


ROUNDING = 2.0**-96  # of values kept as two doubles


def _pair(hi, lo) -> np.ndarray:
    """Two doubles as a complex number: these sort by the first, then the second, what is missing last."""
    z = np.empty(np.shape(hi), complex)
    z.real, z.imag = hi, lo
    return z


def _radius(which: np.ndarray, x: np.ndarray, before: list[np.ndarray], after: list[np.ndarray]) -> np.ndarray:
    """The ``which``-th distance from x to what lies before and after it in order."""
    gaps = np.empty((len(x), len(before) + len(after)), complex)
    for i, (sign, y) in enumerate([*[(1.0, y) for y in before], *[(-1.0, y) for y in after]]):
        gaps[:, i] = _pair(*_total(sign * x.real, -sign * y.real, sign * (x.imag - y.imag)))
    return np.sort(gaps, axis=1)[np.arange(len(x)), which - 1]


def _range_rows(k: int, alone: bool):
    """Works off a range of a column, rows (cls, v, v_lo), cls being ``k + 1`` times the class's number and the neighbour
    that makes a row's radius. Gives (n, rows): how many rows have n rows within their radius; the ``2 * k`` first and
    last rows of every class, ``open`` where a neighbour may lie in another range; and rows whose radius r reaches
    beyond. ``alone``: there are no other ranges.
    """
    names = ["n", "rows", "cls", "open", "v", "v_lo", "r", "r_lo"]

    def run(batches):
        cols = [(b.column("cls").to_numpy(), b.column("v").to_numpy(), b.column("v_lo").to_numpy()) for b in batches]
        if not cols:
            return
        cls, z = np.concatenate([c[0] for c in cols]), _pair(np.concatenate([c[1] for c in cols]), np.concatenate([c[2] for c in cols]))
        cols.clear()
        order = np.argsort(z, kind="stable")
        z, cls = z[order], cls[order]
        by = np.argsort(cls, kind="stable")
        cls, x, at = cls[by], z[by], np.arange(len(z))
        first = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        size = np.diff(np.append(first, len(x)))
        before = at - np.repeat(first, size)
        after = np.repeat(size, size) - 1 - before
        sure = np.full(len(x), alone) | (before >= k) & (after >= k)
        edge = np.flatnonzero(~np.full(len(x), alone) & ((before < 2 * k) | (after < 2 * k)))
        here = np.flatnonzero(sure)
        beside = lambda there, steps: np.where(there[here] >= abs(steps), x[np.clip(here + steps, 0, len(x) - 1)], complex(np.nan, np.nan))
        r = _radius(cls[here] % (k + 1), x[here], [beside(before, -i) for i in range(1, k + 1)], [beside(after, i) for i in range(1, k + 1)])
        a, b = (_pair(*e) for e in _ends(x.real[here], x.imag[here], r.real, r.imag, ROUNDING))
        low, high = np.searchsorted(z, a, "left"), np.searchsorted(z, b, "right")
        inside = np.full(len(here), alone) | ((low > 0) | (a == z[0])) & ((high < len(z)) | (b == z[-1]))
        n, rows = np.unique((high - low)[inside], return_counts=True)
        yield _batch(names, n=n, rows=rows)
        yield _batch(names, cls=cls[edge], open=~sure[edge], v=x.real[edge], v_lo=x.imag[edge])
        far = here[~inside]
        yield _batch(names, v=x.real[far], v_lo=x.imag[far], r=r.real[~inside], r_lo=r.imag[~inside])

    return run


def _batch(names: list[str], **columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"n": pa.int64(), "rows": pa.int64(), "cls": pa.int64(), "open": pa.bool_()}
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds.get(n, pa.float64())) if n in columns else pa.nulls(size, kinds.get(n, pa.float64())) for n in names], names=names)


def _places(rows: DataFrame, ends: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, list[np.ndarray]]:
    """For each column of ``rows`` (a struct v, v_lo each) how many values are below each of the first of its sorted ``ends``,
    and how many are not above each of the second."""
    told = rows.sparkSession.sparkContext.broadcast(list(ends.items()))

    def run(batches):
        total = {(at, side): np.zeros(len(e) + 1, np.int64) for at, (_, both) in enumerate(told.value) for side, e in enumerate(both)}
        for batch in batches:
            for at, (name, both) in enumerate(told.value):
                z = _pair(*(batch.column(f"{name}{part}").to_numpy() for part in ("", "_lo")))
                for side, e in enumerate(both):
                    total[at, side] += np.bincount(np.searchsorted(e, z, "left" if side else "right"), minlength=len(e) + 1)
        for (at, side), n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), at), pa.int32()), pa.array(np.full(len(some), side), pa.int32()), pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], names=["at", "side", "place", "n"])

    found = rows.mapInArrow(run, "at int, side int, place bigint, n bigint").groupBy("at", "side", "place").agg(F.sum("n").alias("n")).toPandas()
    told.unpersist()
    out = {}
    for at, (name, both) in enumerate(ends.items()):
        own = [found[(found["at"] == at) & (found["side"] == side)] for side in (0, 1)]
        out[name] = [np.cumsum(np.bincount(o["place"].to_numpy(np.int64), weights=o["n"].to_numpy(float), minlength=len(e) + 1).astype(np.int64))[: len(e)] for o, e in zip(own, both)]
    return out


def _far_counts(rows: DataFrame, told: DataFrame, k: int) -> DataFrame:
    """(name, n, rows) of the rows that ``_range_rows`` could not count, by passes over all ``rows``."""
    order = Window.partitionBy("name", "cls").orderBy("v", "v_lo")
    sides = [(f, i) for f in (F.lag, F.lead) for i in range(1, k + 1)]
    edges = told.filter("cls is not null").withColumns({f"_{c}{at}": f(c, i).over(order) for at, (f, i) in enumerate(sides) for c in ("v", "v_lo")}).filter("open")

    @F.pandas_udf("r double, r_lo double")
    def radius(cls: pd.Series, v: pd.Series, v_lo: pd.Series, *others: pd.Series) -> pd.DataFrame:
        y = [_pair(others[2 * at].to_numpy(dtype=float), others[2 * at + 1].to_numpy(dtype=float)) for at in range(2 * k)]
        r = _radius(cls.to_numpy(dtype=int) % (k + 1), _pair(v.to_numpy(dtype=float), v_lo.to_numpy(dtype=float)), y[:k], y[k:])
        return pd.DataFrame({"r": r.real, "r_lo": r.imag})

    found = edges.select("name", "v", "v_lo", radius("cls", "v", "v_lo", *[f"_{c}{at}" for at in range(2 * k) for c in ("v", "v_lo")]).alias("r"))
    asked = cut_lineage(found.select("name", "v", "v_lo", "r.r", "r.r_lo").unionByName(told.filter("r is not null").select("name", "v", "v_lo", "r", "r_lo")))
    passes = max(1, -(-asked.count() // ASKED_ROWS))
    out = []
    for at in range(passes):
        own = asked.filter(F.pmod(F.xxhash64("v", "v_lo"), F.lit(passes)) == at).toPandas()
        ends = {}
        for name, p in own.groupby("name"):
            ends[name] = [_pair(*e) for e in _ends(*(p[c].to_numpy(dtype=float) for c in ("v", "v_lo", "r", "r_lo")), ROUNDING)]
        known = {name: tuple(np.unique(e) for e in both) for name, both in ends.items()}
        places = _places(rows.select(*[c for name in known for c in (F.col(name)["v"].alias(name), F.col(name)["v_lo"].alias(f"{name}_lo"))]), known) if known else {}
        for name, (a, b) in ends.items():
            below, upto = (at_[np.searchsorted(e, x)] for at_, e, x in zip(places[name], known[name], (a, b)))
            n, times = np.unique(upto - below, return_counts=True)
            out += [(name, int(i), int(t)) for i, t in zip(n, times)]
    return rows.sparkSession.createDataFrame(out, "name string, n long, rows long")


def class_information(df: DataFrame, features: list[str], target: str, k: int = NEIGHBORS, top: int = 15) -> DataFrame:
    """(feature, mi): mutual information of each numeric feature with a target of classes.

    A row's radius is the distance to its k-th neighbour of its own class (the last but one row of smaller classes;
    classes of one row take no part); all classes' values within it are counted.
    """
    complete = df.select(*[tx.numeric(df, c).alias(c) for c in features], F.col(target).cast("string").alias("_class")).na.drop()
    base = cut_lineage(complete.withColumn("pid", F.monotonically_increasing_id()))
    sizes = base.groupBy("_class").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    which = F.least(F.lit(k), F.col("_size") - 1)
    sizes = cut_lineage(sizes.withColumn("cls", F.monotonically_increasing_id() * (k + 1) + which))
    least = F.sum(F.col("_size") * (digamma(F.col("_size")) - digamma(which)))
    n, own = sizes.agg(F.sum("_size"), least).first()
    if not n:
        return df.sparkSession.createDataFrame([], "feature string, mi double")
    rows = base.join(sizes.select("_class", "cls"), "_class")  # Spark broadcasts the sizes where it measures few classes
    # value and jitter are kept as two doubles: millions of rows may share a value, and one double has no room to part them
    values = {}
    for c, (v, noise) in _parts(rows, features).items():
        hi, lo = _total(v, noise)
        values[c] = F.struct((hi + 0.0).alias("v"), (lo + 0.0).alias("v_lo"))
    parts = max(1, -(-n // SIDE_ROWS))
    told = None
    for c in features:  # one at a time, so that one column's rows are on the move
        slim = rows.select("cls", values[c].alias("x")).select("cls", "x.v", "x.v_lo")
        dealt = slim.repartitionByRange(parts, "v", "v_lo") if parts > 1 else slim.coalesce(1)
        part = cut_lineage(dealt.mapInArrow(_range_rows(k, parts == 1), "n bigint, rows bigint, cls bigint, open boolean, v double, v_lo double, r double, r_lo double"))
        part = part.withColumn("name", F.lit(c))
        told = part if told is None else told.unionByName(part)
    counted = told.filter("n is not null").select("name", "n", "rows")
    if parts > 1:
        counted = counted.unionByName(_far_counts(rows.select(*[v.alias(c) for c, v in values.items()]), told, k))
    per = counted.groupBy("name", "n").agg(F.sum("rows").alias("rows"))
    m = F.sum(F.col("rows") * digamma(F.col("n"))) / n
    out = per.groupBy(F.col("name").alias("feature")).agg(F.greatest(F.lit(0.0), digamma(F.lit(n)) - F.lit(own / n) - m).alias("mi"))
    return out.orderBy(F.desc("mi"), "feature").limit(top)
