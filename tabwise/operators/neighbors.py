"""Exact nearest neighbours by space cells, and what is built on them: local outlier factor, components.

Equal points are merged first and carry a multiplicity. Cells come from median cuts of a small hash
sample; cells that turn out crowded are cut further. Each point finds a first radius inside its own cell,
then descends the tree of cuts with it and visits only the cells the radius touches, so no cross join,
no table of points by cells and no all-pairs table ever exists.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.operators import ordering
from tabwise.session import cut_lineage

CELL_POINTS = 1_000
PAIR_CELLS = 500_000  # distances a task holds at once
VISITS = 100_000  # visits a task hands on at once


def _median_cuts(x: np.ndarray, leaves: int) -> list[tuple]:
    """Splitting tree as (dim, cut, left, right) rows; leaves as (-1, cell, -1, -1)."""
    nodes: list[tuple] = []
    cells = 0

    def add(rows: np.ndarray, want: int) -> int:
        nonlocal cells
        me = len(nodes)
        nodes.append((-1, 0.0, -1, -1))
        widths = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(x.shape[1])
        dim = int(widths.argmax()) if len(rows) else 0
        if want > 1 and len(rows) >= 4 and widths[dim] > 0:
            cut = float(np.median(rows[:, dim]))
            left = rows[:, dim] <= cut
            if left.all():
                cut = float(np.nextafter(rows[:, dim].max(), -math.inf))
                left = rows[:, dim] <= cut
            a, b = add(rows[left], want // 2), add(rows[~left], want - want // 2)
            nodes[me] = (dim, cut, a, b)
        else:
            nodes[me] = (-1, float(cells), -1, -1)
            cells += 1
        return me

    add(x, leaves)
    return nodes


def _cell_of(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), dtype=int)
    while True:
        dim = nodes[at, 0].astype(int)
        inner = dim >= 0
        if not inner.any():
            return nodes[at, 1].astype(int)
        go = x[np.arange(len(x)), np.maximum(dim, 0)] <= nodes[at, 1]
        at = np.where(inner, np.where(go, nodes[at, 2], nodes[at, 3]).astype(int), at)


@dataclass
class Space:
    """A tree of median cuts: (dim, cut, left, right) rows, leaves as (-1, cell, -1, -1), and the boxes of its nodes' points."""

    nodes: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, nodes: np.ndarray, boxes: dict[int, tuple]) -> Space:
        """``boxes``: cell -> (lowest, highest) coordinates of its points; cells without points have none."""
        width = len(next(iter(boxes.values()))[0]) if boxes else 1
        low, high = np.full((len(nodes), width), np.inf), np.full((len(nodes), width), -np.inf)
        for i in range(len(nodes) - 1, -1, -1):  # children come after their parent
            dim, cell, left, right = nodes[i]
            if dim < 0:
                if int(cell) in boxes:
                    low[i], high[i] = boxes[int(cell)]
            else:
                low[i], high[i] = np.minimum(low[int(left)], low[int(right)]), np.maximum(high[int(left)], high[int(right)])
        return cls(nodes, low, high)

    def plain(self) -> tuple:
        """What ``Space(*...)`` needs in a task: broadcast values must not depend on this package."""
        return self.nodes, self.low, self.high

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _cell_of(x, self.nodes)

    def touched(self, x: np.ndarray, radius: np.ndarray, largest: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
        """(row, cell) of the cells whose box a row's radius reaches, and the number of nodes looked at."""
        rows, at, looked = np.arange(len(x)), np.zeros(len(x), dtype=int), 0
        out_rows, out_cells = [np.zeros(0, dtype=int)], [np.zeros(0, dtype=int)]
        while len(rows):
            looked += len(rows)
            gap = np.maximum(0, np.maximum(self.low[at] - x[rows], x[rows] - self.high[at]))
            near = np.isfinite(self.low[at, 0]) & (_distance(gap, largest) <= radius[rows])
            rows, at = rows[near], at[near]
            leaf = self.nodes[at, 0] < 0
            out_rows.append(rows[leaf])
            out_cells.append(self.nodes[at[leaf], 1].astype(int))
            rows, at = rows[~leaf], at[~leaf]
            at = np.concatenate([self.nodes[at, 2], self.nodes[at, 3]]).astype(int)
            rows = np.concatenate([rows, rows])
        return np.concatenate(out_rows), np.concatenate(out_cells), looked

    def visits(self, x: np.ndarray, radius: np.ndarray, largest: bool = False):
        """``touched`` in pieces of at most ``VISITS``: a wide radius touches every cell."""
        step = max(1, min(2_000, 20 * VISITS // len(self.nodes)))
        for at in range(0, len(x), step):
            rows, cells, _ = self.touched(x[at : at + step], radius[at : at + step], largest)
            for i in range(0, len(rows), VISITS):
                yield at + rows[i : i + VISITS], cells[i : i + VISITS]

    def region_margin(self, x: np.ndarray) -> np.ndarray:
        """How far each row is from the cuts around its cell: no point of another cell is nearer."""
        at, margin = np.zeros(len(x), dtype=int), np.full(len(x), np.inf)
        while True:
            dim = self.nodes[at, 0].astype(int)
            inner = dim >= 0
            if not inner.any():
                return margin
            away = np.abs(x[np.arange(len(x)), np.maximum(dim, 0)] - self.nodes[at, 1])
            margin = np.where(inner, np.minimum(margin, away), margin)
            go = x[np.arange(len(x)), np.maximum(dim, 0)] <= self.nodes[at, 1]
            at = np.where(inner, np.where(go, self.nodes[at, 2], self.nodes[at, 3]).astype(int), at)

    def box_margin(self, x: np.ndarray, cell: int) -> np.ndarray:
        """How far each of a cell's rows is from the boxes of all other cells: no point of another cell is nearer. A cut can
        run through the points of a cell's border, the box beyond it begins where there are points."""
        others = np.flatnonzero((self.nodes[:, 0] < 0) & (self.nodes[:, 1] != cell) & np.isfinite(self.low[:, 0]))
        low, high = self.low[others], self.high[others]
        away = _distance(np.maximum(0, np.maximum(low - x.max(axis=0), x.min(axis=0) - high)), False)
        order, margin = np.argsort(away), np.full(len(x), np.inf)
        for at in range(0, len(order), 32):
            if away[order[at]] >= margin.max():
                break
            part = order[at : at + 32]
            gap = np.maximum(0, np.maximum(low[part] - x[:, None, :], x[:, None, :] - high[part]))
            margin = np.minimum(margin, _distance(gap, False).min(axis=1))
        return margin


def _graft(nodes: list[tuple], cell: int, sub: list[tuple]) -> list[tuple]:
    """The tree with a leaf replaced by a subtree; the leaf's number goes to the first of the new cells, others get new numbers."""
    at = next(i for i, n in enumerate(nodes) if n[0] < 0 and int(n[1]) == cell)
    fresh = sum(n[0] < 0 for n in nodes)
    base, out = len(nodes) - 1, list(nodes)
    number = {0: cell}
    for i, (dim, cut, left, right) in enumerate(sub):
        node = (dim, cut, left + base, right + base) if dim >= 0 else (-1, float(number.setdefault(int(cut), fresh + int(cut) - 1)), -1, -1)
        if i == 0:
            out[at] = node
        else:
            out.append(node)
    return out


def in_space(merged: DataFrame, cols: list[str], key: str, cell_points: int) -> tuple[DataFrame, Space]:
    """``merged`` (distinct points) with its cell, and the space. No cell holds over four times ``cell_points`` points."""
    n = merged.count()
    leaves = max(1, math.ceil(n / cell_points))

    def sampled(rows, size):
        return rows.select(*cols, key).orderBy(F.xxhash64(key)).limit(size).select(*[F.col(c).cast("double") for c in cols]).toPandas().to_numpy(dtype=float)

    nodes = _median_cuts(sampled(merged, min(200_000, max(2_000, 16 * leaves))), leaves)
    while True:
        told = merged.sparkSession.sparkContext.broadcast(np.array(nodes))

        @F.pandas_udf(T.IntegerType())
        def cell(*parts: pd.Series) -> pd.Series:
            return pd.Series(_cell_of(np.column_stack([p.to_numpy(dtype=float) for p in parts]), told.value)).astype("int32")

        placed = cut_lineage(merged.withColumn("cell", cell(*cols)))
        ends = [f for c in cols for f in (F.min(F.col(c).cast("double")).alias(f"lo_{c}"), F.max(F.col(c).cast("double")).alias(f"hi_{c}"))]
        found = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).collect()  # one row per cell
        crowded = {r["cell"]: r["n"] for r in found if r["n"] > 4 * cell_points}
        if not crowded:
            boxes = {r["cell"]: (np.array([r[f"lo_{c}"] for c in cols]), np.array([r[f"hi_{c}"] for c in cols])) for r in found}
            return placed, Space.of(np.array(nodes), boxes)
        x = sampled(placed.filter(F.col("cell").isin(list(crowded)[:1000])), 200_000)
        own, before = _cell_of(x, told.value), len(nodes)
        for number, size in list(crowded.items())[:1000]:
            nodes = _graft(nodes, number, _median_cuts(x[own == number], max(2, math.ceil(size / cell_points))))
        if len(nodes) == before:
            raise ValueError("points that differ only beyond double precision crowd one cell")


def _distance(gap: np.ndarray, largest: bool) -> np.ndarray:
    """Length of the gaps along the last axis: their largest, or as the crow flies."""
    return np.abs(gap).max(axis=-1) if largest else np.sqrt((gap**2).sum(axis=-1))


def _nearest(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, xm: np.ndarray, k: int, largest: bool = False) -> pd.DataFrame:
    """For each query the closest points that together hold k rows: (pid, nbr, d, m)."""
    out = []
    step = max(1, PAIR_CELLS // max(len(x), 1))
    for s in range(0, len(q), step):
        d = _distance(q[s:s + step, None, :] - x[None, :, :], largest)
        d[qid[s:s + step, None] == xid[None, :]] = np.inf  # own copies are added by the caller
        take = min(k, len(x))
        near = np.argpartition(d, take - 1, axis=1)[:, :take] if take else np.zeros((len(d), 0), dtype=int)
        rows = np.repeat(np.arange(len(d)), near.shape[1])
        cols = near.ravel()
        dist = d[rows, cols]
        ok = np.isfinite(dist)
        out.append(pd.DataFrame({"pid": qid[s:s + step][rows[ok]], "nbr": xid[cols[ok]], "d": dist[ok], "m": xm[cols[ok]]}))
    return pd.concat(out) if out else pd.DataFrame({"pid": [], "nbr": [], "d": [], "m": []})


def nearest_neighbors(points: DataFrame, cols: list[str], key: str, k: int, cell_points: int = CELL_POINTS) -> DataFrame:
    """(pid, copies, nbr, d, w): per distinct point its k nearest rows, ``w`` rows of them from ``nbr``.

    ``key`` is a whole-number row id. Copies of a point are its own nearest rows at distance 0.
    """
    merged = points.groupBy(*cols).agg(F.min(key).cast("bigint").alias("pid"), F.count(F.lit(1)).alias("copies"))
    placed, space = in_space(cut_lineage(merged), cols, "pid", max(cell_points, 4 * k))
    return neighbors_in_space(placed, space, cols, k)


def neighbors_in_space(placed: DataFrame, space: Space, cols: list[str], k: int, largest: bool = False) -> DataFrame:
    """``nearest_neighbors`` of points (pid, copies, cell, coordinates) that have their place already; ``largest``: by the
    largest of the coordinates' differences."""
    told = placed.sparkSession.sparkContext.broadcast(space.plain())
    pairs = "pid bigint, nbr bigint, d double, m bigint"

    def in_cell(p: pd.DataFrame) -> pd.DataFrame:
        x, pid = p[cols].to_numpy(dtype=float), p["pid"].to_numpy()
        return _nearest(x, pid, x, pid, p["copies"].to_numpy(), k, largest)

    local = cut_lineage(placed.groupBy("cell").applyInPandas(in_cell, pairs))
    # first radius: where the found rows and the own copies add up to k; unbounded when the cell is too small
    order = Window.partitionBy("pid").orderBy("d", "nbr")
    reach = local.withColumn("upto", F.sum("m").over(order)).groupBy("pid").agg(
        F.collect_list(F.struct("d", "upto")).alias("found")  # at most k entries per point
    )
    asked = placed.join(reach.hint("merge"), "pid", "left").withColumn(
        "radius",
        F.when(F.col("copies") > k, 0.0).otherwise(
            F.coalesce(
                F.array_min(F.transform(F.filter("found", lambda s: s["upto"] + F.col("copies") - 1 >= k), lambda s: s["d"])),
                F.lit(float("inf")),
            )
        ),
    ).drop("found")

    def visits(batches):
        for p in batches:
            x, r, own = p[cols].to_numpy(dtype=float), p["radius"].to_numpy(), p["cell"].to_numpy()
            for rows, cells in Space(*told.value).visits(x, np.where(r > 0, r, -1.0), largest):
                other = cells != own[rows]
                yield p.iloc[rows[other]][["pid", *cols]].assign(visit=cells[other].astype("int32"))

    schema = "pid bigint, " + ", ".join(f"`{c}` double" for c in cols) + ", visit int"
    queries = asked.select("pid", *[F.col(c).cast("double").alias(c) for c in cols], "cell", "radius").mapInPandas(visits, schema)

    def across(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"pid": [], "nbr": [], "d": [], "m": []})
        return _nearest(q[cols].to_numpy(dtype=float), q["pid"].to_numpy(), p[cols].to_numpy(dtype=float), p["pid"].to_numpy(), p["copies"].to_numpy(), k, largest)

    remote = queries.groupBy("visit").cogroup(placed.groupBy("cell")).applyInPandas(across, pairs)
    own = placed.filter("copies > 1").select("pid", F.col("pid").alias("nbr"), F.lit(0.0).alias("d"), (F.col("copies") - 1).alias("m"))
    every = local.unionByName(remote).unionByName(own)
    before = F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = every.withColumn("before", before).filter(F.col("before") < k)
    best = kept.select("pid", "nbr", "d", F.least(F.col("m"), k - F.col("before")).cast("bigint").alias("w"))
    return placed.select("pid", "copies").join(best.hint("merge"), "pid")


def local_outlier_factor(points: DataFrame, cols: list[str], key: str, k: int = 20) -> DataFrame:
    """(pid, copies, lof): how much sparser a point lies than its neighbours; above 1.5 is an outlier."""
    k = min(k, points.count() - 1)
    near = cut_lineage(nearest_neighbors(points, cols, key, k))
    kdist = near.groupBy("pid").agg(F.max("d").alias("kdist"))
    reach = near.join(kdist.select(F.col("pid").alias("nbr"), "kdist"), "nbr")
    density = reach.groupBy("pid", "copies").agg(
        (1.0 / (F.sum(F.col("w") * F.greatest("d", "kdist")) / F.sum("w") + 1e-10)).alias("lrd")
    )
    density = cut_lineage(density)
    joined = near.select("pid", "nbr", "w").join(density.select(F.col("pid").alias("nbr"), F.col("lrd").alias("nlrd")), "nbr")
    mean = joined.groupBy("pid").agg((F.sum(F.col("w") * F.col("nlrd")) / F.sum("w")).alias("mean_lrd"))
    return density.join(mean, "pid").select("pid", "copies", (F.col("mean_lrd") / F.col("lrd")).alias("lof"))


def lof_summary(scores: DataFrame) -> DataFrame:
    out = F.sum(F.when(F.col("lof") > 1.5, F.col("copies")).otherwise(0))
    return scores.agg(out.alias("n_outliers"), F.sum("copies").alias("n_rows")).withColumn(
        "fraction", F.round(F.col("n_outliers") / F.col("n_rows"), 4)
    )


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pid, label): smallest id of each component, by alternating star contraction.

    Every round links a node's neighbours to the smallest one. Hub nodes (the centres of large
    components) are joined by broadcast of the few hot hubs, the others by shuffle.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    e = cut_lineage(e)
    seen = None
    while True:  # every round lowers some label; ends when none changes
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = _star(both, larger_only=True)
        e = cut_lineage(_star(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), larger_only=False))
        mark = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    return nodes.select("pid").join(e.groupBy(F.col("u").alias("pid")).agg(F.min("v").alias("label")).hint("merge"), "pid", "left").withColumn(
        "label", F.coalesce("label", "pid")
    )


def _star(e: DataFrame, larger_only: bool) -> DataFrame:
    """Large star: link larger neighbours to the smallest of the neighbourhood. Small star: link the
    smaller neighbours and the node itself to it."""
    rows = e.count()
    least = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"), F.count(F.lit(1)).alias("cnt"))
    joined = ordering.join_on_value(e, least, ["u"], max(100_000, rows // 1000), rows)
    if larger_only:
        linked = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(joined.select("u", F.col("low").alias("v")))
    return linked.filter("u != v").distinct()
