"""Chart-ready aggregates: category bars, pies, histograms, density grids, boxes, time series, reference lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise import config
from tabwise.functions import text as tx
from tabwise.operators import blocks, ordering

# Resampling rules (least span in seconds, rule) and report limits.
RESAMPLE_RULES = ((3 * 365 * 86400, "W"), (60 * 86400, "D"), (2 * 86400, "H"), (2 * 3600, "5min"), (0, "30s"))
MAX_GROUPS_SHOWN = 20
SECTIONS = {
    "category_count": "Breakdowns", "category_summary": "Breakdowns", "group_comparison": "Breakdowns",
    "histogram": "Distributions", "distribution": "Distributions", "time_series": "Trends", "scatter": "Relationships",
}
AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp, "median": None,
}


@dataclass(frozen=True)
class Clip:
    clipped: bool = False
    lower: float | None = None
    upper: float | None = None

    def apply(self, x: Column) -> Column:
        return F.greatest(F.lit(self.lower), F.least(F.lit(self.upper), x)) if self.clipped else x


def finite_values(df: DataFrame, col: str) -> DataFrame:
    """One column ``x``: finite numbers of ``col``."""
    return df.select(tx.finite(tx.numeric(df, col)).alias("x")).filter("x is not null")


def _clip_rule(n: int, q: dict) -> Clip:
    """Clip to the 1st..99th percentile when the tails would flatten the picture."""
    if n < 50 or q.get(0.5) is None:
        return Clip()
    iqr, span = q[0.75] - q[0.25], q[0.99] - q[0.01]
    if iqr == 0 or span <= 0:
        return Clip()
    extreme = max(abs(q[0.99]), abs(q[0.01])) / max(abs(q[0.5]), 1e-9)
    if span / max(abs(iqr), 1e-9) > 8 or extreme > 25:
        return Clip(True, q[0.01], q[0.99])
    return Clip()


def clip_bounds(rows: DataFrame, cols: list[str]) -> dict[str, Clip]:
    """Winsorising decision per column: one count and one quantile job for all of them."""
    n = rows.agg(*[F.count(c).alias(c) for c in cols]).first()
    q = ordering.quantile_map(rows, cols, (0.01, 0.25, 0.5, 0.75, 0.99))
    return {c: _clip_rule(n[c], {p: v for (name, p), v in q.items() if name == c}) for c in cols}


def clip_report(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(name, clipped, lower, upper) computed without leaving Spark."""
    q = ordering.exact_quantiles(rows, cols, (0.01, 0.25, 0.5, 0.75, 0.99))
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    n = rows.agg(F.array(*[F.struct(F.lit(c).alias("name"), F.count(c).alias("n")) for c in cols]).alias("t")).select(F.inline("t"))
    wide = q.groupBy("name").agg(*[at(p).alias(f"q{int(p * 100):02d}") for p in (0.01, 0.25, 0.5, 0.75, 0.99)]).join(F.broadcast(n), "name")
    iqr, span = F.col("q75") - F.col("q25"), F.col("q99") - F.col("q01")
    extreme = F.greatest(F.abs("q99"), F.abs("q01")) / F.greatest(F.abs("q50"), F.lit(1e-9))
    hit = (F.col("n") >= 50) & (iqr != 0) & (span > 0) & ((span / F.greatest(F.abs(iqr), F.lit(1e-9)) > 8) | (extreme > 25))
    return wide.select("name", hit.alias("clipped"), F.when(hit, F.col("q01")).alias("lower"), F.when(hit, F.col("q99")).alias("upper"))


# ---------------------------------------------------------------- categories


def category_counts(df: DataFrame, col: str, max_categories: int = config.MAX_CATEGORIES) -> DataFrame:
    """(category, count): the largest categories, the rest as 'Others'; empty when only one bar is left."""
    text = tx.null_text_to_null(F.col(col).cast("string"))
    counted = df.select(text.alias("category")).filter("category is not null").groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    total = counted.agg(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("levels"))
    top = counted.orderBy(F.desc("count"), "category").limit(max_categories)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "category")))  # at most max_categories rows
    placed = ranked.crossJoin(F.broadcast(total)).filter((F.col("levels") <= max_categories) | (F.col("rank") < max_categories))
    rest = (
        placed.filter(F.col("levels") > max_categories)
        .agg(F.max("rows").alias("rows"), F.sum("count").alias("shown"))
        .filter(F.col("rows") > F.col("shown"))
        .select(F.lit("Others").alias("category"), (F.col("rows") - F.col("shown")).alias("count"))
    )
    return drop_single_bar(placed.select("category", "count").unionByName(rest))


def drop_single_bar(bars: DataFrame, at_least: int = 2) -> DataFrame:
    """A chart of fewer than two bars compares nothing: no rows come back. Input is chart-sized."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return bars.withColumn("n_bars", n).filter(F.col("n_bars") >= at_least).drop("n_bars")


def pie(df: DataFrame, col: str, max_categories: int = config.MAX_CATEGORIES) -> DataFrame:
    """(category, value): top categories, no rest slice."""
    counted = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("value"))
    return counted.orderBy(F.desc("value"), "category").limit(max_categories)


def category_summary(df: DataFrame, x: str, y: str, agg: str = "mean", clip: Clip | None = None) -> DataFrame:
    """(category, agg_value) of a clipped measure; empty beyond twenty groups."""
    agg = agg.lower() if agg.lower() in AGGREGATES else "mean"
    rows = df.select(F.col(x).cast("string").alias("category"), tx.numeric(df, y).alias("y")).filter("category is not null and y is not null")
    clip = clip_bounds(rows, ["y"])["y"] if clip is None else clip
    rows = rows.withColumn("y", clip.apply(F.col("y")))
    if len(rows.select("category").distinct().limit(MAX_GROUPS_SHOWN + 1).collect()) > MAX_GROUPS_SHOWN:
        return rows.limit(0).select("category", F.col("y").alias("agg_value"))
    if agg == "median":
        return ordering.exact_quantiles(rows, ["y"], (0.5,), by=("category",)).select("category", F.col("value").alias("agg_value"))
    return rows.groupBy("category").agg(AGGREGATES[agg]("y").cast("double").alias("agg_value")).filter("agg_value is not null")


def box_summary(df: DataFrame, x: str, y: str) -> DataFrame:
    """Five numbers, 1.5-IQR whiskers and outlier count per category (2 to 20 categories).

    Stands in for shipping every value of every group to the chart.
    """
    rows = df.select(F.col(x).cast("string").alias("category"), tx.finite(tx.numeric(df, y)).alias("y")).filter("category is not null and y is not null")
    groups = len(rows.select("category").distinct().limit(MAX_GROUPS_SHOWN + 1).collect())
    if not 2 <= groups <= MAX_GROUPS_SHOWN:  # no chart: nothing is worked out for the groups
        rows = rows.limit(0)
    q = ordering.exact_quantiles(rows, ["y"], (0.25, 0.5, 0.75), by=("category",))
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    quart = q.groupBy("category").agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("y").between(lo, hi)
    return (
        rows.join(F.broadcast(quart), "category")  # at most twenty rows
        .groupBy("category", "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("y").alias("min"), F.max("y").alias("max"),
            F.min(F.when(inside, F.col("y"))).alias("whisker_low"), F.max(F.when(inside, F.col("y"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


# ---------------------------------------------------------------- histograms


def bin_count(n: int, bins: int = 20) -> int:
    if n < 10:
        return 3
    if n < 50:
        return 5
    return min(bins, 100) if n > 10_000 else min(bins, n // 10)


def discrete_histogram(values: DataFrame) -> DataFrame:
    return values.groupBy(F.col("x").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def equal_width_histogram(values: DataFrame, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(bin, lower, upper, count): right-closed bins, the lowest takes the minimum, empty bins kept."""
    if lo is None or hi is None:
        r = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
        lo, hi = r["lo"], r["hi"]
    if hi == lo:
        pad = 0.001 * abs(lo) if lo else 0.001
        lo, hi = lo - pad, hi + pad
    w = (hi - lo) / bins
    idx = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col("x") - F.lit(lo)) / F.lit(w)))).cast("int")
    counted = values.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = values.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return (
        spine.join(F.broadcast(counted), "bin", "left")  # at most `bins` rows
        .select(
            "bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(w)).alias("lower"), (F.lit(lo) + F.col("bin") * F.lit(w)).alias("upper"),
            F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
        )
    )


def quantile_histogram(values: DataFrame, bins: int) -> DataFrame:
    """(bin, lower, upper, count): equal-frequency bins with repeated edges dropped."""
    probs = tuple(i / bins for i in range(bins + 1))
    edges = sorted(set(ordering.quantile_map(values, ["x"], probs).values()))
    inner = edges[1:-1]
    idx = (ordering.range_index(F.col("x"), inner) if inner else F.lit(0)) + 1
    counted = values.groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = values.sparkSession.createDataFrame(
        [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, lower double, upper double"
    )
    return spine.join(F.broadcast(counted), "bin", "left").select("bin", "lower", "upper", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))


def corrected_skew(n: int, population_skew: float) -> float:
    return population_skew * (n * (n - 1)) ** 0.5 / (n - 2) if n > 2 else 0.0


def histogram(df: DataFrame, col: str, bins: int = 20) -> tuple[str, DataFrame]:
    """The adaptive histogram: ('discrete'|'quantile'|'width'|'sparse', bars)."""
    values = finite_values(df, col)
    if len(values.distinct().limit(7).collect()) <= 6:
        return "discrete", discrete_histogram(values)
    clip = clip_bounds(values, ["x"])["x"]
    values = values.select(clip.apply(F.col("x")).alias("x"))
    s = values.agg(F.count("x").alias("n"), F.skewness("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    bins = bin_count(s["n"], bins)
    if s["n"] > 2 and s["s"] is not None and abs(corrected_skew(s["n"], s["s"])) > 1:
        mode, bars = "quantile", quantile_histogram(values, bins)
    else:
        mode, bars = "width", equal_width_histogram(values, bins, s["lo"], s["hi"])
    counts = [r["count"] for r in bars.collect()]
    if len(counts) > 10 and sum(c < 2 for c in counts) > 0.6 * len(counts):
        return "sparse", equal_width_histogram(values, max(5, len(counts) // 2), s["lo"], s["hi"])
    return mode, bars


def density_grid(df: DataFrame, x: str, y: str, bins: int = 30, clips: dict | None = None) -> DataFrame:
    """(x_bin, y_bin, count) over a dense grid; bins are left-closed, the last one includes the maximum."""
    rows = df.select(tx.numeric(df, x).alias("x"), tx.numeric(df, y).alias("y")).filter("x is not null and y is not null")
    clips = clip_bounds(rows, ["x", "y"]) if clips is None else clips
    rows = rows.select(clips["x"].apply(F.col("x")).alias("x"), clips["y"].apply(F.col("y")).alias("y"))
    r = rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    cell = lambda v, a, b: F.least(F.lit(bins - 1), F.floor((F.col(v) - F.lit(a)) / F.lit((b - a) / bins if b > a else 1.0))).cast("int")
    counted = rows.groupBy(cell("x", r["x0"], r["x1"]).alias("x_bin"), cell("y", r["y0"], r["y1"]).alias("y_bin")).agg(F.count(F.lit(1)).alias("count"))
    cells = df.sparkSession.range(bins * bins)  # the bins x bins spine
    grid = cells.select((F.col("id") % bins).cast("int").alias("x_bin"), F.floor(F.col("id") / bins).cast("int").alias("y_bin"))
    return grid.join(F.broadcast(counted), ["x_bin", "y_bin"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))


def scatter(df: DataFrame, x: str, y: str, max_points: int | None = config.DENSITY_THRESHOLD) -> tuple[str, DataFrame | None]:
    """('scatter', points), ('heatmap', grid) beyond ``max_points`` points (None: all points), or ('none', None) for flat data."""
    rows = df.select(tx.numeric(df, x).alias("x"), tx.numeric(df, y).alias("y")).filter("x is not null and y is not null")
    clips = clip_bounds(rows, ["x", "y"])
    rows = rows.select(clips["x"].apply(F.col("x")).alias("x"), clips["y"].apply(F.col("y")).alias("y"))
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy")).first()
    if s["n"] < 3 or min(s["sx"] or 0.0, s["sy"] or 0.0) < 0.001:
        return "none", None
    if max_points is not None and s["n"] > max_points:
        return "heatmap", density_grid(df, x, y, clips=clips)
    return "scatter", rows


# ---------------------------------------------------------------- time series


def resample_rule(n: int, span_seconds: float, threshold: int = config.DENSITY_THRESHOLD) -> str | None:
    if n <= threshold:
        return None
    return next(rule for least, rule in RESAMPLE_RULES if span_seconds >= least)


def bucket_start(ts: Column, rule: str) -> Column:
    """Label of the bucket a timestamp falls into; weeks are named by the Sunday that ends them."""
    if rule == "W":
        return F.date_trunc("week", ts) + F.expr("INTERVAL 6 DAYS")
    if rule in ("D", "H"):
        return F.date_trunc("day" if rule == "D" else "hour", ts)
    step = 300 if rule == "5min" else 30
    day = F.date_trunc("day", ts)
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))
    return day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.floor(second / step) * step).cast("decimal(18,6)"))


_STEP = {"W": "INTERVAL 7 DAYS", "D": "INTERVAL 1 DAY", "H": "INTERVAL 1 HOUR", "5min": "INTERVAL 5 MINUTES", "30s": "INTERVAL 30 SECONDS"}


def resample(rows: DataFrame, rule: str, agg: str) -> DataFrame:
    """(date, value): buckets of (ts, y); sums and counts give 0 for empty buckets, the rest skip them."""
    keyed = rows.select(bucket_start(F.col("ts"), rule).alias("date"), "y")
    if agg == "median":
        return ordering.group_medians(keyed, ["date"], "y")
    out = keyed.groupBy("date").agg(AGGREGATES[agg]("y").cast("double").alias("value"))
    if agg not in ("sum", "count"):
        return out.filter("value is not null")
    ends = out.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr(_STEP[rule]))).alias("date"))
    return spine.join(out, "date", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def time_series(df: DataFrame, x: str, y: str, agg: str = "mean", threshold: int = config.DENSITY_THRESHOLD, clip: Clip | None = None) -> DataFrame | None:
    """(date, value), clipped, resampled beyond ``threshold`` points, else grouped by equal timestamps."""
    agg = agg.lower() if agg.lower() in AGGREGATES else "mean"
    rows = tx.typed_dates(df, [x]).select(F.col(x).alias("ts"), tx.numeric(df, y).alias("y")).filter("ts is not null and y is not null")
    clip = clip_bounds(rows, ["y"])["y"] if clip is None else clip
    rows = rows.withColumn("y", clip.apply(F.col("y")))
    s = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"),
        F.unix_timestamp(F.min("ts")).alias("a"), F.unix_timestamp(F.max("ts")).alias("b"),
    ).first()
    if s["n"] < 2 or s["lo"] == s["hi"]:
        return None
    rule = resample_rule(s["n"], s["b"] - s["a"], threshold)
    if rule:
        return resample(rows, rule, agg)
    if rows.select("ts").distinct().count() == s["n"]:
        return rows.select(F.col("ts").alias("date"), F.col("y").alias("value"))
    if agg == "median":
        return ordering.group_medians(rows, ["ts"], "y").withColumnRenamed("ts", "date")
    return rows.groupBy(F.col("ts").alias("date")).agg(AGGREGATES[agg]("y").cast("double").alias("value")).filter("value is not null")


# ---------------------------------------------------------------- overlays on chart-sized tables


def trendline(series: DataFrame, order: str, y: str) -> DataFrame:
    """(slope, intercept) of y over its point index, from five finite points on."""
    idx = blocks.numbered(blocks.in_order(series, [order]), "i").filter(F.col(y).isNotNull())
    return idx.agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, "i").alias("slope"), F.regr_intercept(y, "i").alias("intercept")
    ).filter("n >= 5").select("slope", "intercept")


def mean_line(series: DataFrame, y: str, log_axis: bool = False) -> DataFrame:
    out = series.agg(F.count(y).alias("n"), F.avg(y).alias("mean"))
    return out.filter((F.col("n") >= 3) & F.lit(not log_axis)).select("mean")


def log_scale(series: DataFrame, y: str) -> DataFrame:
    """(log_scale): at least 20 positive values whose largest exceeds 100 times the upper median."""
    pos = series.filter(F.col(y) > 0).select(F.col(y).cast("double").alias("y"))
    ranked = ordering.positions(pos, ["y"])
    n = pos.agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("top"))
    mid = F.floor(F.col("n") / 2)
    holds = (F.col("before") <= mid) & (mid < F.col("before") + F.col("cnt"))
    joined = ranked.crossJoin(F.broadcast(n))
    return joined.agg(
        F.coalesce(F.max(F.when(holds, (F.col("n") >= 20) & (F.col("top") / F.col("value") > 100))), F.lit(False)).alias("log_scale")
    )


def cap_labels(rows: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The ``n`` largest rows, shown in their original order."""
    return rows.orderBy(F.desc(value), order).limit(n).orderBy(order)


def default_charts(df: DataFrame, roled_rows: list) -> list[dict]:
    """Charts chosen without a spec: 5 counts, 3 histograms, 2 series per date, 1 scatter, 3 pies."""
    by = lambda role: [r["name"] for r in roled_rows if r["role"] == role]
    cats, nums, dates = by("categorical"), by("numeric"), by("datetime")
    uniq = {r["name"]: r["unique_count"] for r in roled_rows}
    out = [dict(intent="category_count", x=c, data=category_counts(df, c)) for c in cats[:5]]
    out += [dict(intent="histogram", x=c, data=histogram(df, c)[1]) for c in nums[:3]]
    for d in dates:
        out += [dict(intent="time_series", x=d, y=c, data=time_series(df, d, c)) for c in nums[:2]]
    if len(nums) >= 2:
        out.append(dict(intent="scatter", x=nums[0], y=nums[1], data=scatter(df, nums[0], nums[1])[1]))
    out += [dict(intent="pie", x=c, data=pie(df, c)) for c in cats[:3] if uniq[c] <= 10]
    if not out and nums:
        out = [dict(intent="histogram", x=nums[0], data=histogram(df, nums[0])[1])]
    return [c for c in out if c["data"] is not None]


def chart_data(df: DataFrame, intent: str, x: str, y: str | None, agg: str | None = None) -> DataFrame | None:
    """The data of a chart; None for intents that are not known or have nothing to show."""
    if intent == "category_count":
        return category_counts(df, x)
    if intent in ("histogram", "distribution"):
        return histogram(df, x)[1]
    if intent in ("category_summary", "group_comparison"):
        return category_summary(df, x, y, agg or "mean")
    if intent == "time_series":
        return time_series(df, x, y, agg or "mean")
    if intent == "scatter":
        return scatter(df, x, y)[1]
    return None


def build_charts(df: DataFrame, specs: list[dict], max_charts: int = config.MAX_CHARTS, failed: list | None = None, identifiers: frozenset = frozenset()) -> list[dict]:
    """Chart data per spec: known intents only, unique ids, at most ``max_charts``, tagged with a section. Specs whose
    chart raised are put into ``failed`` with the reason; specs that show an identifier are left out."""
    failed = [] if failed is None else failed
    out, seen = [], set()
    for spec in specs:
        intent, x, y, sid = spec.get("intent"), spec.get("x_field"), spec.get("y_field"), spec.get("id")
        needed = [c for c in (x, y) if c]
        if len(out) >= max_charts or sid in seen or any(c not in df.columns or c in identifiers for c in needed):
            continue
        try:
            data = chart_data(df, intent, x, y, spec.get("agg_func"))
            filled = data is not None and bool(data.head(1))
        except Exception as e:  # one chart that fails takes no other along
            failed.append({**spec, "error": f"{type(e).__name__}: {str(e)[:200]}"})
            continue
        if filled:
            out.append({**spec, "section": SECTIONS.get(intent, "Other"), "data": data})
            seen.add(sid)
    return out
