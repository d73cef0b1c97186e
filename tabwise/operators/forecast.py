"""Short-term forecasts: damped-trend exponential smoothing for many series at once, of any length.

A series that lies in one block is fitted by its task. A longer one is fitted by a parallel prefix scan: for given
weights a point maps the state (level, trend) affinely, so a block of points does too, and the squared error of its
one-step forecasts is a quadratic form of the state it starts from. Tasks work these maps out for all weights of a
grid, neighbouring blocks are composed a level at a time, and the whole series' form gives the best weights and
starting state without anyone having gone through it point by point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise import config
from tabwise.operators import blocks, charts, stats

BLOCK_ROWS = 100_000
#: Points a block's recursion runs through side by side.
STRIDE = 256
#: Blocks composed by one task.
FAN = 64


def pick_columns(roled: DataFrame) -> DataFrame:
    """(date_column, measure): first datetime; widest measure with at least five distinct values."""
    date = F.min_by("name", F.when(F.col("role") == "datetime", F.col("position")))
    ok = F.col("role").isin("numeric", "ratio", "year", "boolean") & F.col("kind").isin("int", "float", "bool") & (F.col("unique_count") >= 5)
    best = F.max_by("name", F.when(ok, F.struct("variance", -F.col("position"))))
    return roled.agg(date.alias("date_column"), best.alias("measure"))


GRIDS = 3


def weights_grid(centre: tuple | None, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alpha, beta, phi) to try: a coarse grid first, then finer ones around the best so far, which is tried again."""

    def grid(*axes):
        return [v.ravel() for v in np.meshgrid(*axes, indexing="ij")]

    if centre is None:
        return grid(np.linspace(0.05, 0.95, 7), np.linspace(0.01, 0.9, 6), np.linspace(0.8, 0.98, 4))
    width = np.array([0.15, 0.18, 0.06]) / 3 ** (turn - 1)
    span = lambda mid, w, lo, hi: np.clip(np.linspace(mid - w, mid + w, 5), lo, hi)
    return grid(span(centre[0], width[0], 0.001, 0.999), span(centre[1], width[1], 0.0, 0.999), span(centre[2], width[2], 0.8, 0.995))


def fit_damped(y: np.ndarray) -> tuple[float, float, float, float, float, np.ndarray]:
    """(alpha, beta, phi, level, trend, residuals) minimising the one-step squared error.

    For fixed smoothing weights the residuals are linear in the starting level and trend, so those two are
    solved exactly; the weights come from a grid refined twice.
    """

    def run(a: np.ndarray, b: np.ndarray, p: np.ndarray):
        # three recursions side by side: the data from a zero start, and unit starts of level and trend
        level = np.zeros((3, len(a)))
        trend = np.zeros((3, len(a)))
        level[1], trend[2] = 1.0, 1.0
        g = np.zeros((len(a), 5))  # sums of pp, pq, qq, pc, qc
        cc = np.zeros(len(a))
        for v in y:
            base = level + p * trend
            c, u, w = v - base[0], -base[1], -base[2]
            g += np.stack([u * u, u * w, w * w, u * c, w * c], axis=1)
            cc += c * c
            obs = np.array([v, 0.0, 0.0])[:, None]
            new = a * obs + (1 - a) * base
            trend = b * (new - level) + (1 - b) * p * trend
            level = new
        det = g[:, 0] * g[:, 2] - g[:, 1] ** 2
        safe = np.where(np.abs(det) > 1e-12, det, 1.0)
        l0 = np.where(np.abs(det) > 1e-12, (-g[:, 3] * g[:, 2] + g[:, 4] * g[:, 1]) / safe, y[0])
        b0 = np.where(np.abs(det) > 1e-12, (-g[:, 4] * g[:, 0] + g[:, 3] * g[:, 1]) / safe, 0.0)
        sse = cc + 2 * (l0 * g[:, 3] + b0 * g[:, 4]) + l0 ** 2 * g[:, 0] + 2 * l0 * b0 * g[:, 1] + b0 ** 2 * g[:, 2]
        return sse, l0, b0

    best = None
    for turn in range(GRIDS):
        a, b, p = weights_grid(best and best[1:4], turn)
        sse, l0, b0 = run(a, b, p)
        i = int(np.nanargmin(sse))
        if best is None or sse[i] < best[0]:
            best = (sse[i], a[i], b[i], p[i], l0[i], b0[i])
    _, alpha, beta, phi, level, trend = best
    resid = np.empty(len(y))
    for t, v in enumerate(y):
        base = level + phi * trend
        resid[t] = v - base
        new = alpha * v + (1 - alpha) * base
        trend = beta * (new - level) + (1 - beta) * phi * trend
        level = new
    return alpha, beta, phi, level, trend, resid


def damped_forecast(y: np.ndarray, horizon: int = config.FORECAST_HORIZON) -> tuple[np.ndarray, np.ndarray]:
    """(yhat, margin): forecasts and 1.96 sigma sqrt(h) half-widths."""
    _, _, phi, level, trend, resid = fit_damped(y)
    steps = np.arange(1, horizon + 1)
    yhat = level + np.cumsum(phi ** steps) * trend
    return yhat, 1.96 * float(np.std(resid)) * np.sqrt(steps)


# ---------------------------------------------------------------- prefix scan of affine maps


def point_maps(y: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
    """What a block does to a starting state s for each weights triple: it ends at m s + z, its errors are g + h s.

    m (k, 2, 2), z (k, 2); sums over the points: hh (k, 2, 2), gh (k, 2), gg (k), h (k, 2), g (k); n.
    """
    lanes = len(y) // STRIDE
    parts = [_lanes(y[: lanes * STRIDE].reshape(lanes, STRIDE), a, b, p)] if lanes else []
    if len(y) % STRIDE:
        parts.append(_lanes(y[lanes * STRIDE :][None, :], a, b, p))
    out = None
    for part in parts:
        for i in range(part["z"].shape[0]):
            one = {k: v[i] if k in ("z", "gh", "gg", "g") else v for k, v in part.items()}
            out = one if out is None else compose(out, one)
    return out


def _lanes(y: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
    """``point_maps`` of several equally long blocks at once; z, gh, gg and g have the blocks in front."""
    k, lanes = len(a), len(y)
    level, trend = np.zeros((lanes, k)), np.zeros((lanes, k))
    unit = np.tile(np.eye(2)[:, :, None], (1, 1, k))  # (level and trend, start, weights)
    hh, gh, gg = np.zeros((k, 2, 2)), np.zeros((lanes, k, 2)), np.zeros((lanes, k))
    h, g = np.zeros((k, 2)), np.zeros((lanes, k))
    for t in range(y.shape[1]):
        base, ubase = level + p * trend, unit[0] + p * unit[1]
        e, w = y[:, t, None] - base, -ubase.T
        gg += e * e
        g += e
        gh += e[:, :, None] * w
        hh += w[:, :, None] * w[:, None, :]
        h += w
        new, unew = base + a * e, (1 - a) * ubase
        trend, unit[1] = b * (new - level) + (1 - b) * p * trend, b * (unew - unit[0]) + (1 - b) * p * unit[1]
        level, unit[0] = new, unew
    return {"m": np.moveaxis(unit, 2, 0).copy(), "z": np.stack([level, trend], axis=2), "hh": hh, "gh": gh, "gg": gg, "h": h, "g": g, "n": np.full(k, float(y.shape[1]))}


def compose(one: dict, two: dict) -> dict:
    """What two blocks do one after the other."""
    m, z = one["m"], one["z"]
    back = np.swapaxes(m, 1, 2)
    hz = np.einsum("kij,kj->ki", two["hh"], z)
    return {
        "m": two["m"] @ m, "z": np.einsum("kij,kj->ki", two["m"], z) + two["z"],
        "hh": one["hh"] + back @ two["hh"] @ m, "gh": one["gh"] + np.einsum("kij,kj->ki", back, two["gh"] + hz),
        "gg": one["gg"] + two["gg"] + 2 * (two["gh"] * z).sum(1) + (hz * z).sum(1),
        "h": one["h"] + np.einsum("kij,kj->ki", back, two["h"]), "g": one["g"] + two["g"] + (two["h"] * z).sum(1), "n": one["n"] + two["n"],
    }


def best_start(maps: dict, first: float) -> tuple[np.ndarray, np.ndarray]:
    """(squared error, start) for each weights triple, from the start that makes the error least."""
    hh, gh = maps["hh"], maps["gh"]
    det = hh[:, 0, 0] * hh[:, 1, 1] - hh[:, 0, 1] ** 2
    sound = np.abs(det) > 1e-12
    safe = np.where(sound, det, 1.0)
    s = np.stack([np.where(sound, (-gh[:, 0] * hh[:, 1, 1] + gh[:, 1] * hh[:, 0, 1]) / safe, first), np.where(sound, (-gh[:, 1] * hh[:, 0, 0] + gh[:, 0] * hh[:, 0, 1]) / safe, 0.0)], axis=1)
    return maps["gg"] + 2 * (gh * s).sum(1) + np.einsum("ki,kij,kj->k", s, hh, s), s


_SHAPES = {"m": (2, 2), "z": (2,), "hh": (2, 2), "gh": (2,), "gg": (), "h": (2,), "g": (), "n": ()}


def _pack(maps: dict) -> list[float]:
    return np.concatenate([maps[k].reshape(len(maps["n"]), -1) for k in _SHAPES], axis=1).ravel().tolist()


def _unpack(flat) -> dict:
    sizes = [int(np.prod(s)) for s in _SHAPES.values()]
    rows = np.asarray(flat, float).reshape(-1, sum(sizes))
    cuts = np.cumsum([0, *sizes])
    return {k: rows[:, i:j].reshape(-1, *s).copy() for (k, s), i, j in zip(_SHAPES.items(), cuts, cuts[1:])}


def scanned(placed: DataFrame, keys: list[str], weights) -> DataFrame:
    """(keys..., first, maps): the composed maps of each series of blocks (_block, _seq, y). ``weights(row of keys)`` gives (alpha, beta, phi) arrays."""
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in placed.schema.fields if f.name in keys)
    own = keys or ["_one"]
    if not keys:
        placed, head = placed.withColumn("_one", F.lit(1)), "_one int, "

    def work(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(blocks.SEQ)
        y = p["y"].to_numpy(dtype=float)
        maps = point_maps(y, *weights(tuple(p[k].iloc[0] for k in keys)))
        return pd.DataFrame({**{k: [p[k].iloc[0]] for k in own}, "at": [p[blocks.BLOCK].iloc[0]], "first": [y[0]], "maps": [_pack(maps)]})

    def joined(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("at")
        out = _unpack(p["maps"].iloc[0])
        for flat in p["maps"].iloc[1:]:
            out = compose(out, _unpack(flat))
        return pd.DataFrame({**{k: [p[k].iloc[0]] for k in own}, "at": [p["at"].iloc[0] // FAN], "first": [p["first"].iloc[0]], "maps": [_pack(out)]})

    schema = f"{head}at int, first double, maps array<double>"
    rows = placed.groupBy(*own, blocks.BLOCK).applyInPandas(work, schema)
    last = placed.agg(F.coalesce(F.max(blocks.BLOCK), F.lit(0))).first()[0]
    while True:
        rows = rows.withColumn("_part", F.floor(F.col("at") / FAN)).groupBy(*own, "_part").applyInPandas(joined, schema)
        last //= FAN
        if last == 0:
            return rows.select(*keys, "first", "maps")


def _long_fits(placed: DataFrame, keys: list[str]) -> list[dict]:
    """Weights, end state and error of each series that spans blocks; such series are fewer than blocks."""
    best: dict[tuple, tuple] = {}
    for turn in range(GRIDS + 1):  # the last turn is for the best weights alone

        def weights(key):
            if turn == GRIDS:
                return [np.array([v]) for v in best[key][1:4]]
            own = weights_grid(best[key][1:4] if turn else None, turn)
            return [np.append(v, best[key][1 + i]) if turn else v for i, v in enumerate(own)]

        def choose(batches):
            for p in batches:
                out = []
                for r in p.to_dict("records"):
                    maps = _unpack(r["maps"])
                    sse, s = best_start(maps, r["first"])
                    i = int(np.nanargmin(sse))
                    a, b, f = [w[i] for w in weights(tuple(r[k] for k in keys))]
                    end, n = maps["m"][i] @ s[i] + maps["z"][i], maps["n"][i]
                    mean = (maps["g"][i] + maps["h"][i] @ s[i]) / n
                    out.append({**{k: r[k] for k in keys}, "sse": sse[i], "alpha": a, "beta": b, "phi": f, "level": end[0], "trend": end[1], "sigma": float(np.sqrt(max(0.0, sse[i] / n - mean**2)))})
                yield pd.DataFrame(out, columns=names)

        names = [*keys, "sse", "alpha", "beta", "phi", "level", "trend", "sigma"]
        head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in placed.schema.fields if f.name in keys)
        rows = scanned(placed, keys, weights).mapInPandas(choose, head + ", ".join(f"{n} double" for n in names[len(keys) :])).collect()
        best = {tuple(r[k] for k in keys): (r["sse"], r["alpha"], r["beta"], r["phi"]) for r in rows}
    return [r.asDict() for r in rows]


def smooth(series: DataFrame, alpha: float, beta: float, phi: float, by: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(by..., n, level, trend, sse): the end state and squared one-step error of each series (ts, y) for given weights,
    from its first value and no trend."""
    keys = list(by)
    placed = blocks.in_order(series.select(*keys, "ts", F.col("y").cast("double").alias("y")), [*keys, "ts"], block_rows)
    one = [np.array([v]) for v in (alpha, beta, phi)]

    def end(batches):
        for p in batches:
            out = []
            for r in p.to_dict("records"):
                maps, s = _unpack(r["maps"]), np.array([r["first"], 0.0])
                z = maps["m"][0] @ s + maps["z"][0]
                out.append({**{k: r[k] for k in keys}, "n": int(maps["n"][0]), "level": z[0], "trend": z[1], "sse": maps["gg"][0] + 2 * maps["gh"][0] @ s + s @ maps["hh"][0] @ s})
            yield pd.DataFrame(out, columns=[*keys, "n", "level", "trend", "sse"])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in placed.schema.fields if f.name in keys)
    return scanned(placed, keys, lambda key: one).mapInPandas(end, f"{head}n bigint, level double, trend double, sse double")


def forecast(series: DataFrame, by: tuple[str, ...] = (), horizon: int = config.FORECAST_HORIZON, min_points: int = config.FORECAST_MIN_POINTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(by..., step, date, yhat, lower, upper): per series of at least ``min_points`` (ts, y) points.

    Dates go on at the last observed step. Series inside a block are fitted by its task, those that span blocks by the
    prefix scan; the search over weights is the same.
    """
    keys = list(by)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema.fields if f.name in keys], "step int, date timestamp_ntz, yhat double, lower double, upper double"])
    names = [*keys, "step", "date", "yhat", "lower", "upper"]

    def ahead(p: pd.DataFrame, yhat, margin) -> pd.DataFrame:
        ts = pd.to_datetime(p["ts"])
        gap = ts.iloc[-1] - ts.iloc[-2]
        out = pd.DataFrame({"step": np.arange(1, horizon + 1), "date": [ts.iloc[-1] + gap * (i + 1) for i in range(horizon)], "yhat": yhat.round(4), "lower": (yhat - margin).round(4), "upper": (yhat + margin).round(4)})
        for k in keys:
            out[k] = p[k].iloc[0]
        return out[names]

    def project(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ts")
        if len(p) < min_points:
            kinds = {"step": "int32", "date": "datetime64[us]", "yhat": "float64", "lower": "float64", "upper": "float64"}
            return pd.DataFrame({n: pd.Series([], dtype=kinds.get(n, "object")) for n in names})
        return ahead(p, *damped_forecast(p["y"].to_numpy(dtype=float), horizon))

    rows = series.select(*keys, F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("y").cast("double").alias("y"))
    placed = blocks.in_order(rows, [*keys, "ts"], block_rows).withColumn("_one", F.lit(1))
    own = keys or ["_one"]
    spans = placed.groupBy(*own).agg(F.min(blocks.BLOCK).alias("a"), F.max(blocks.BLOCK).alias("z")).filter("a < z").select(*own)
    long = [tuple(r) for r in spans.collect()]  # fewer than blocks
    if not long:
        return placed.groupBy(*own).applyInPandas(project, schema)
    named = placed.sparkSession.createDataFrame(long, placed.select(*own).schema)
    short = placed.join(F.broadcast(named), own, "left_anti").groupBy(*own).applyInPandas(project, schema)
    wide = placed.join(F.broadcast(named), own, "left_semi")
    fits = {tuple(r[k] for k in keys): r for r in _long_fits(wide, keys)}
    # the last two points lie in a series' last two blocks that hold any of it
    held = wide.groupBy(*own).agg(F.sort_array(F.collect_set(blocks.BLOCK), asc=False)[1].alias("z"))
    ends = wide.join(F.broadcast(held), own).filter(F.col(blocks.BLOCK) >= F.col("z"))

    def project_long(p: pd.DataFrame) -> pd.DataFrame:
        f = fits[tuple(p[k].iloc[0] for k in keys)]
        steps = np.arange(1, horizon + 1)
        return ahead(p.nlargest(2, "ts").sort_values("ts"), f["level"] + np.cumsum(f["phi"] ** steps) * f["trend"], 1.96 * f["sigma"] * np.sqrt(steps))

    return short.unionByName(ends.groupBy(*own).applyInPandas(project_long, schema))


def band(points: DataFrame) -> DataFrame:
    """Band algebra on (step, yhat, sigma): lower, upper = yhat -+ 1.96 sigma sqrt(step)."""
    half = F.lit(1.96) * F.col("sigma") * F.sqrt("step")
    return points.withColumn("lower", F.col("yhat") - half).withColumn("upper", F.col("yhat") + half)


def outlook(last: float, mean_forecast: float) -> str:
    if last == 0:
        return "changing"
    change = (mean_forecast - last) / abs(last)
    return "rising" if change > 0.02 else "falling" if change < -0.02 else "roughly flat"


def forecast_table(df: DataFrame, roled: DataFrame, horizon: int = config.FORECAST_HORIZON) -> dict:
    cols = pick_columns(roled).first()
    if cols["date_column"] is None or cols["measure"] is None:
        return {"available": False, "reason": "no-datetime" if cols["date_column"] is None else "no-measure"}
    series = stats.mean_series(df, cols["date_column"], cols["measure"])
    n = series.count()
    if n < config.FORECAST_MIN_POINTS:
        return {"available": False, "reason": "too-short-history", "n_points": n, "target": cols["measure"]}
    ahead = [r.asDict() for r in forecast(series, horizon=horizon).orderBy("step").collect()]
    history = [r.asDict() for r in stats.tail(series).orderBy("ts").collect()]
    mean = sum(r["yhat"] for r in ahead) / len(ahead)
    return {"available": True, "target": cols["measure"], "date_column": cols["date_column"], "n_history": n, "history": history, "forecast": ahead, "outlook": outlook(history[-1]["y"], mean)}
