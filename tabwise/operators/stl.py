"""Seasonal-trend decomposition by locally weighted regression (Cleveland et al. 1990), for series of any length.

All smoothers have windows of fixed width, so a pass over a block of the series needs no more than a halo of its
neighbours' rows. A round exchanges halos, runs the inner passes in every block and takes the median of the absolute
remainders over the whole series, from which the next round's robustness weights come.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.operators import blocks, ordering
from tabwise.session import cut_lineage

SEASONAL_WINDOW = 7
INNER, OUTER = 2, 15
BLOCK_ROWS = 100_000


def _odd_above(x: float) -> int:
    n = math.ceil(x)
    return n if n % 2 else n + 1


def windows(period: int, seasonal: int = SEASONAL_WINDOW) -> tuple[int, int, int]:
    """Widths of the seasonal, trend and low-pass smoothers."""
    return seasonal, _odd_above(1.5 * period / (1 - 1.5 / seasonal)), _odd_above(period + 1)


def loess(y: np.ndarray, width: int, weights: np.ndarray | None = None, at: np.ndarray | None = None, span: int | None = None) -> np.ndarray:
    """Local lines through equally spaced values, at their own places or at places ``at`` (from 0).

    A window that is narrow beside the whole series, of ``span`` values, gives its mean instead of a line.
    """
    n = len(y)
    q = min(width, n)
    places = np.arange(n) if at is None else at
    left = np.clip(places - (q - 1) // 2, 0, n - q).astype(int)
    near = left[:, None] + np.arange(q)
    away = np.abs(near - places[:, None])
    h = np.maximum(places - left, left + q - 1 - places) + ((width - n) // 2 if width > n else 0.0)
    h = h[:, None].astype(float)
    w = np.where(away <= 0.001 * h, 1.0, np.where(away <= 0.999 * h, (1 - (away / np.where(h > 0, h, 1.0)) ** 3) ** 3, 0.0))
    if weights is not None:
        w = w * weights[near]
    total = w.sum(1, keepdims=True)
    sound = total[:, 0] > 0
    w = w / np.where(total > 0, total, 1.0)
    mean = (w * near).sum(1, keepdims=True)
    spread = (w * (near - mean) ** 2).sum(1, keepdims=True)
    slope = np.where((np.sqrt(spread) > 0.001 * ((span or n) - 1)) & (h > 0), (places[:, None] - mean) / np.where(spread > 0, spread, 1.0), 0.0)
    fitted = (w * (1 + slope * (near - mean)) * y[near]).sum(1)
    return np.where(sound, fitted, y[np.clip(places, 0, n - 1).astype(int)])


def _cycles(y: np.ndarray, period: int, width: int, weights: np.ndarray | None, span: int) -> np.ndarray:
    """Each phase smoothed on its own and carried one period beyond both ends."""
    out = np.empty(len(y) + 2 * period)
    for phase in range(period):
        own = y[phase::period]
        w = None if weights is None else weights[phase::period]
        k = len(own)
        out[phase::period][: k + 2] = loess(own, width, w, np.arange(-1, k + 1), (span - phase - 1) // period + 1)
    return out


def _average(x: np.ndarray, width: int) -> np.ndarray:
    run = np.concatenate([[0.0], np.cumsum(x - x.mean())])
    return (run[width:] - run[:-width]) / width + x.mean()


def inner_passes(y: np.ndarray, trend: np.ndarray, period: int, weights: np.ndarray | None, span: int | None = None, passes: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """(seasonal, trend) after some passes from a given trend; ``span``: length of the series that ``y`` is a part of."""
    span = span or len(y)
    ns, nt, nl = windows(period)
    season = np.zeros(len(y))
    for _ in range(passes):
        cycles = _cycles(y - trend, period, ns, weights, span)
        low = loess(_average(_average(_average(cycles, period), period), 3), nl, span=span)
        season = cycles[period : period + len(y)] - low
        trend = loess(y - season, nt, weights, span=span)
    return season, trend


def robustness(r: np.ndarray, median: float) -> np.ndarray:
    h = 6 * median
    if h == 0:
        return np.ones(len(r))
    a = np.abs(r)
    return np.where(a <= 0.001 * h, 1.0, np.where(a <= 0.999 * h, (1 - (a / h) ** 2) ** 2, 0.0))


def decompose_array(y: np.ndarray, period: int, outer: int = OUTER) -> tuple[np.ndarray, np.ndarray]:
    """(seasonal, trend) of a whole series."""
    season, trend, weights = np.zeros(len(y)), np.zeros(len(y)), None
    for turn in range(outer + 1):
        season, trend = inner_passes(y, trend, period, weights)
        r = y - season - trend
        weights = robustness(r, float(np.median(np.abs(r)))) if turn < outer else None
    return season, trend


def reach(period: int) -> int:
    """How far the inner passes of a round can see: at the ends of a series a window lies on one side."""
    ns, nt, nl = windows(period)
    return INNER * (ns * period + 2 * period + nl + nt)


def stl(series: DataFrame, period: int, block_rows: int = BLOCK_ROWS, outer: int = OUTER) -> DataFrame:
    """(idx, y, trend, seasonal, resid) of a (ts, y) series with unique timestamps."""
    rows = series.select("ts", F.col("y").cast("double").alias("y"))
    n = rows.count()
    placed = blocks.numbered(blocks.in_order(rows, ["ts"], rows=n)).select("idx", "y")
    schema = "idx bigint, y double, trend double, seasonal double, resid double"
    if n <= block_rows:

        def whole(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("idx")
            y = p["y"].to_numpy()
            season, trend = decompose_array(y, period, outer)
            return pd.DataFrame({"idx": p["idx"], "y": y, "trend": trend, "seasonal": season, "resid": y - season - trend})

        return placed.groupBy(F.lit(0).alias("g")).applyInPandas(whole, schema)
    far = reach(period)
    block_rows = max(block_rows, 2 * far)
    state = placed.select("idx", "y", F.lit(0.0).alias("trend"), F.lit(0.0).alias("seasonal"), F.lit(0.0).alias("resid"))
    median = None
    for turn in range(outer + 1):

        def block(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("idx")
            y, shift = p["y"].to_numpy(), int(p["idx"].iloc[0]) % period
            weights = None if median is None else robustness(p["resid"].to_numpy(), median)
            # phases count from the start of the series: rows before the first whole period are put aside
            skip = 0 if p["idx"].iloc[0] == 0 else (period - shift) % period
            y, trend, weights = y[skip:], p["trend"].to_numpy()[skip:], None if weights is None else weights[skip:]
            season, trend = inner_passes(y, trend, period, weights, n)
            out = pd.DataFrame({"idx": p["idx"].iloc[skip:], "y": y, "trend": trend, "seasonal": season, "resid": y - season - trend})
            return out[p["own"].to_numpy()[skip:]]

        near = blocks.with_halo(state, "idx", far + period, block_rows)
        state = cut_lineage(near.groupBy("halo").applyInPandas(block, schema))
        if turn < outer:
            median = ordering.exact_quantiles(state.select(F.abs("resid").alias("r")), ["r"], (0.5,)).first()["value"]
    return state
