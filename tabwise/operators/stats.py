"""Distribution shape, trend, decomposition and series building."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise import config
from tabwise.functions import dist
from tabwise.functions import text as tx
from tabwise.operators import ordering
from tabwise.session import spread


# ---------------------------------------------------------------- distributions (skew, kurtosis, normality)


def k_squared(n, skew, kurt):
    """D'Agostino-Pearson statistic from n, population skew and excess kurtosis, as Column arithmetic."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2 / (w2 - 1))
    z1 = delta * F.log(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1))
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurt + 3 - e) / F.sqrt(var)
    b = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + F.sqrt(1 + 4 / (b * b)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - F.signum(d) * F.cbrt((1 - 2 / a) / F.abs(d))) / F.sqrt(2 / (9 * a))
    return z1 * z1 + z2 * z2


def distributions(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, n, skew, kurtosis, k2, test, normality_p, is_normal) for columns of 8+ values, 3+ distinct.

    One aggregation for all columns. Samples under 20 values are tested with Shapiro-Wilk on the few
    values themselves.
    """
    num = spread(df.select(*[tx.numeric(df, c).alias(c) for c in cols]))
    ends = num.agg(*[f for c in cols for f in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.count(c).alias(f"n_{c}"))]).first()
    small = [c for c in cols if ends[f"n_{c}"] < 20]  # the values themselves are only gathered for columns of under 20
    # three distinct values: something lies strictly between the smallest and the largest
    between = lambda c: F.count_if((F.col(c) > ends[f"lo_{c}"]) & (F.col(c) < ends[f"hi_{c}"])) if ends[f"lo_{c}"] is not None else F.lit(0)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("name"), F.count(c).alias("n"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurtosis"), between(c).cast("bigint").alias("inner"),
                (F.array_agg(c) if c in small else F.lit(None).cast("array<double>")).alias("sample"),
            )
            for c in cols
        ]
    )
    base = num.agg(cells.alias("p")).select(F.inline("p")).filter("n >= 8 and inner > 0")
    n = F.col("n").cast("double")
    k2 = F.when(F.col("n") >= 20, k_squared(n, F.col("skew"), F.col("kurtosis")))
    out = base.withColumn("k2", k2).withColumn("test", F.when(F.col("n") >= 20, "dagostino_k2").otherwise("shapiro"))
    p = F.exp(-F.col("k2") / 2)
    if small:
        p = F.coalesce(p, _shapiro("sample"))
    return out.withColumn("normality_p", p).withColumn("is_normal", F.col("normality_p") > 0.05).drop("inner", "sample")


@F.pandas_udf(T.DoubleType())
def _shapiro(samples: pd.Series) -> pd.Series:
    return samples.map(lambda s: dist.shapiro_wilk_p([v for v in s if v is not None]) if s is not None else None)


# ---------------------------------------------------------------- series


def mean_series(df: DataFrame, ts: str, measure: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., ts, y): mean of the measure per timestamp, missing values dropped."""
    rows = tx.typed_dates(df, [ts]).select(*by, F.col(ts).alias("ts"), tx.numeric(df, measure).alias("y")).filter("ts is not null and y is not null")
    return rows.groupBy(*by, "ts").agg(F.avg("y").alias("y"))


def indexed(series: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Adds ``idx``, the 0-based place of each (unique) timestamp, without a one-task sort."""
    keyed = series.withColumn("_t", _micros(series))
    pos = ordering.positions(keyed, ["_t"], task_rows=task_rows).select(F.col("value").alias("_t"), F.col("before").alias("idx"))
    return keyed.withColumn("_t", F.col("_t").cast("double")).join(pos, "_t").drop("_t")


def _micros(series: DataFrame):
    """Time as a number that a double holds exactly (microseconds below 2^53)."""
    kind = series.schema["ts"].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col("ts").cast("timestamp"))
    return F.col("ts")


def tail(series: DataFrame, n: int = 120) -> DataFrame:
    return series.orderBy(F.desc("ts")).limit(n)


# ---------------------------------------------------------------- Mann-Kendall


def _local_score(x: np.ndarray) -> int:
    """Sum over i < j of sign(x_j - x_i), by merging sorted halves."""
    n = len(x)
    if n < 2:
        return 0
    if n <= 64:
        return int(np.sign(x[None, :] - x[:, None])[np.triu_indices(n, 1)].sum())
    h = n // 2
    left, right = np.sort(x[:h]), x[h:]
    below = np.searchsorted(left, right, "left").sum()
    above = (h - np.searchsorted(left, right, "right")).sum()
    return _local_score(x[:h]) + _local_score(right) + int(below - above)


def mann_kendall_score(series: DataFrame, cell_rows: int = 200_000) -> DataFrame:
    """(n, s): S = sum over pairs of sign(later - earlier), exact for any length.

    Rows are cut into time blocks and value buckets. Pairs that differ in both come from the block x
    bucket counts; pairs inside a block, and pairs of one bucket across blocks, are scored where they lie.
    Buckets of a single value score nothing and are skipped, so a value held by most rows costs nothing.
    """
    rows = series.select(_micros(series).cast("double").alias("t"), F.col("y").cast("double").alias("y"))
    n = rows.count()
    parts = int(min(512, math.ceil(n / cell_rows)))
    if parts <= 1:
        one = rows.groupBy(F.lit(0).alias("g")).applyInPandas(
            lambda p: pd.DataFrame({"s": [_local_score(p.sort_values("t")["y"].to_numpy())]}), "s long"
        )
        return one.select(F.lit(n).cast("bigint").alias("n"), "s")
    cuts = ordering._cut_points(rows, ["t", "y"], parts)
    # a hot value fills a bucket of its own: borders sit just below and at each cut value
    y_cuts = sorted({b for v in cuts["y"] for b in (float(np.nextafter(v, -math.inf)), v)})
    rows = rows.withColumn("tb", ordering.range_index(F.col("t"), cuts["t"])).withColumn("vb", ordering.range_index(F.col("y"), y_cuts))
    grid = rows.groupBy("tb", "vb").agg(F.count(F.lit(1)).alias("c"))
    # block x bucket matrix: at most 513 x 1025 numbers
    m = np.zeros((len(cuts["t"]) + 1, len(y_cuts) + 1))
    for r in grid.collect():
        m[r["tb"], r["vb"]] = r["c"]
    earlier = np.vstack([np.zeros(m.shape[1]), np.cumsum(m, axis=0)[:-1]])
    lower = np.hstack([np.zeros((m.shape[0], 1)), np.cumsum(earlier, axis=1)[:, :-1]])
    higher = earlier.sum(axis=1, keepdims=True) - lower - earlier
    cross = int((m * (lower - higher)).sum())
    in_block = rows.groupBy("tb").applyInPandas(
        lambda p: pd.DataFrame({"s": [_local_score(p.sort_values("t")["y"].to_numpy())]}), "s long"
    )
    spread_buckets = rows.groupBy("vb").agg((F.min("y") < F.max("y")).alias("varied")).filter("varied").select("vb")

    def across(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("t")
        own = sum(_local_score(g["y"].to_numpy()) for _, g in p.groupby("tb"))
        return pd.DataFrame({"s": [_local_score(p["y"].to_numpy()) - own]})

    varied = rows.join(F.broadcast(spread_buckets), "vb").groupBy("vb").applyInPandas(across, "s long")
    local = in_block.unionByName(varied).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"))
    return local.select(F.lit(n).cast("bigint").alias("n"), (F.col("s") + F.lit(cross)).cast("bigint").alias("s"))


def mann_kendall(series: DataFrame, min_points: int = 8) -> DataFrame:
    """(n, s, z, tau) of a (ts, y) series with unique timestamps; no tie correction."""
    n, s = F.col("n").cast("double"), F.col("s").cast("double")
    var = n * (n - 1) * (2 * n + 5) / 18.0
    z = F.when(s == 0, 0.0).otherwise((s - F.signum(s)) / F.sqrt(var))
    return mann_kendall_score(series).filter(F.col("n") >= min_points).select("n", "s", z.alias("z"), (s / (0.5 * n * (n - 1))).alias("tau"))


def trend_verdict(series: DataFrame) -> dict | None:
    r = mann_kendall(series).first()
    if r is None:
        return None
    p = dist.normal_two_sided(r["z"])
    word = "no-trend" if p >= 0.05 or r["s"] == 0 else ("increasing" if r["s"] > 0 else "decreasing")
    return {"trend": word, "tau": round(r["tau"], 4), "p_value": round(p, 6), "z": round(r["z"], 4)}


# ---------------------------------------------------------------- decomposition


def decomposition_period(n: int) -> int:
    return max(2, min(12, n // 2 - 1))


def decompose(series: DataFrame, period: int | None = None, block: int = 100_000) -> DataFrame:
    """(idx, y, trend, seasonal, resid): classical additive decomposition of a (ts, y) series.

    The centred moving average runs inside blocks of the index; each block also receives the rows of its
    neighbours that its window reaches, so no task holds the whole series.
    """
    placed = indexed(series)
    if period is None:
        period = decomposition_period(series.count())
    half = period // 2
    reach = F.sequence(F.floor((F.col("idx") - half) / block), F.floor((F.col("idx") + half) / block))
    ghost = placed.select("idx", "y", F.explode(reach).alias("block")).filter("block >= 0")
    win = Window.partitionBy("block").orderBy("idx")
    if period % 2:
        total, size = F.sum("y").over(win.rowsBetween(-half, half)), F.count("y").over(win.rowsBetween(-half, half))
        trend = F.when(size == period, total / period)
    else:  # 2 x m average: half weight on both ends
        inner, size = F.sum("y").over(win.rowsBetween(-half + 1, half - 1)), F.count("y").over(win.rowsBetween(-half, half))
        ends = F.lag("y", half).over(win) + F.lead("y", half).over(win)
        trend = F.when(size == period + 1, (inner + ends / 2) / period)
    smooth = ghost.withColumn("trend", trend).filter(F.floor(F.col("idx") / block) == F.col("block")).drop("block")
    phase = smooth.withColumn("phase", F.col("idx") % period)
    means = phase.groupBy("phase").agg(F.avg(F.col("y") - F.col("trend")).alias("raw"))
    centre = means.agg(F.avg("raw").alias("centre"))
    seasonal = means.crossJoin(F.broadcast(centre)).select("phase", (F.col("raw") - F.col("centre")).alias("seasonal"))  # `period` rows
    return phase.join(F.broadcast(seasonal), "phase").withColumn("resid", F.col("y") - F.col("trend") - F.col("seasonal")).drop("phase")


def component_strength(parts: DataFrame) -> DataFrame:
    """(seasonal_strength, trend_strength) = max(0, 1 - var(resid) / var(resid + component))."""
    inside = parts.filter("resid is not null")
    s = inside.agg(
        F.var_pop("resid").alias("v"), F.var_pop(F.col("resid") + F.col("seasonal")).alias("vs"), F.var_pop(F.col("resid") + F.col("trend")).alias("vt")
    )
    strength = lambda c: F.coalesce(F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("v"), F.col(c))), F.lit(0.0))
    return s.select(strength("vs").alias("seasonal_strength"), strength("vt").alias("trend_strength"))


def seasonal_strength(series: DataFrame) -> dict | None:
    """Strengths by robust decomposition, for series of at least two periods and a point."""
    from tabwise.operators import stl

    n = series.count()
    period = decomposition_period(n)
    if n < 2 * period + 1:
        return None
    return {"period": period} | {k: round(v, 4) for k, v in component_strength(stl.stl(series, period)).first().asDict().items()}


# ---------------------------------------------------------------- column selection and report


def eligible_columns(roled: DataFrame) -> DataFrame:
    """(name, use): 'numeric' measures and 'categorical' columns of 2..50 levels, ids excluded."""
    numeric = (F.col("role") != "identifier") & F.col("kind").isin("int", "float", "bool")
    categorical = F.col("role").isin("categorical", "boolean") & F.col("unique_count").between(2, 50)
    a = roled.filter(numeric).orderBy("position").limit(config.STAT_MAX_COLS).select("name", F.lit("numeric").alias("use"))
    b = roled.filter(categorical).orderBy("position").limit(config.STAT_MAX_COLS).select("name", F.lit("categorical").alias("use"))
    return a.unionByName(b)


def driver_target(roled: DataFrame) -> DataFrame:
    """(name): highest-variance additive measure (else any) with at least five distinct values."""
    ok = (F.col("role") != "identifier") & F.col("kind").isin("int", "float", "bool") & (F.col("unique_count") >= 5)
    additive = F.array_contains("semantic_tags", "additive") & (F.col("role") == "numeric")
    n_additive = roled.agg(F.count_if((F.col("role") != "identifier") & F.col("kind").isin("int", "float", "bool") & additive).alias("k"))
    pool = roled.filter(ok).crossJoin(F.broadcast(n_additive)).filter((F.col("k") == 0) | additive)  # one row per column
    return pool.orderBy(F.desc("variance"), "position").limit(1).select("name")


def report(df: DataFrame, roled: DataFrame, key: list[str] | None = None) -> dict:
    """All statistics of a table; a block that fails leaves its section empty and its reason under ``failed``.

    Outlier factors and density groups need a ``key`` of one column that tells rows apart.
    """
    from tabwise.operators import anomalies, information, relate

    use = eligible_columns(roled).collect()
    nums = [r["name"] for r in use if r["use"] == "numeric"]
    cats = [r["name"] for r in use if r["use"] == "categorical"]
    dates = [r["name"] for r in roled.filter("role = 'datetime'").orderBy("position").collect()]
    df = tx.typed_dates(df, dates[:1])
    failed: dict[str, str] = {}

    def guarded(job, empty, name):
        try:
            return job()
        except Exception as e:
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            return empty

    rows = lambda d: [r.asDict() for r in d.collect()]
    out = {"numeric_columns": nums, "categorical_columns": cats}
    out["distributions"] = guarded(lambda: rows(distributions(df, nums)), [], "distributions") if nums else []
    out["spearman"] = guarded(lambda: sorted(relate.with_p(relate.spearman_pairs(df, nums), "rho"), key=lambda d: -abs(d["rho"] or 0))[:25], [], "spearman") if len(nums) > 1 else []
    out["cramers_v"] = guarded(lambda: rows(relate.top_by_strength(relate.cramers_v(df, cats), "cramers_v", ["a", "b"])), [], "cramers_v") if len(cats) > 1 else []
    out["eta"] = guarded(lambda: rows(relate.top_by_strength(relate.correlation_ratio(df, cats, nums), "eta", ["category", "numeric"])), [], "eta") if cats and nums else []
    out["trend"], out["decomposition"] = {}, {}
    if dates:
        for c in nums:
            out["trend"][c] = guarded(lambda: trend_verdict(mean_series(df, dates[0], c)), None, f"trend {c}")
            out["decomposition"][c] = guarded(lambda: seasonal_strength(mean_series(df, dates[0], c)), None, f"decomposition {c}")
    if len(nums) > 1:
        out["anomalies"] = guarded(lambda: anomalies.isolation_summary(df, nums), {}, "anomalies")
        from tabwise.operators import segments

        out["clustering"] = guarded(lambda: segments.best_kmeans(df, nums, range(2, 8)), {}, "clustering")
        target = driver_target(roled).first()
        if target:
            from tabwise.operators import supervised

            feats = [c for c in nums if c != target["name"]]
            out["drivers"] = guarded(lambda: supervised.forest_importances(df, target["name"], feats), {}, "drivers")
            out["mutual_information"] = guarded(lambda: rows(information.neighbor_information(df, feats, target["name"])), [], "mutual_information")
        if key and len(key) == 1:
            from tabwise.operators import density, neighbors

            complete = df.select(*key, *nums).dropna()
            out["outlier_factor"] = guarded(lambda: neighbors.lof_summary(neighbors.local_outlier_factor(complete, nums, key[0])).first().asDict(), {}, "outlier_factor")
            out["density"] = guarded(lambda: density.density_summary(density.density_clusters(complete, nums, key[0])).first().asDict(), {}, "density")
    out["failed"] = failed
    return out
