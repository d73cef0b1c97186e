"""Indicators, totals, outliers, recommendations, KPI scores and chart specs from the profile table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise import config
from tabwise.functions import text as tx
from tabwise.operators import ordering

# ---- Fixed values -------------------------------------------------------------------------------
MONEY_WORDS = ("amount", "revenue", "cost", "price", "fee", "charge", "payment", "income", "expense", "profit")
KPI_ID_WORDS = (
    "id", "key", "code", "no", "number", "index", "account", "user", "customer", "product", "item", "order",
    "zip", "zipcode", "postal", "postcode", "acct", "iban",
)
INTENTS = (
    "category_count", "distribution", "histogram", "category_summary", "group_comparison", "time_series", "scatter",
)
# -------------------------------------------------------------------------------------------------


def profile_view(roled: DataFrame) -> DataFrame:
    """Year / ratio facts as the analysis layers see them: from name and tags, before a contract exists."""
    numeric = F.col("role") == "numeric"
    tags = F.col("semantic_tags")
    ratio = numeric & (F.arrays_overlap(tags, F.array(*[F.lit(t) for t in ("rate", "ratio", "percent", "percentage")])) | F.col("name").rlike(tx.RATIO_NAME))
    view = roled.withColumn("v_year", numeric & F.col("name").rlike(tx.YEAR_NAME)).withColumn("v_ratio", ratio)
    agg = (
        F.when(F.array_contains(tags, "additive") & ~F.col("v_ratio"), "additive")
        .when(F.col("v_ratio") | F.array_contains(tags, "rate"), "rate")
        .when(F.col("role") == "boolean", "additive")
        .otherwise("none")
    )
    return view.withColumn("v_aggregation", agg)


def can_sum() -> Column:
    """Summable before a contract exists: numeric or boolean, no ratio, no year."""
    return ~F.col("v_year") & ~F.col("v_ratio") & F.col("role").isin("numeric", "boolean")


def key_indicators(roled: DataFrame, n_rows: int) -> DataFrame:
    """(seq, indicator, value, type): averages and spreads, year spans, dataset size, dominant category."""
    view = profile_view(roled)
    num = view.filter("role = 'numeric'")
    money = lambda c: tx.fixed_point(c, 2)
    spans = num.filter("v_year and min is not null").select(
        (F.col("position") * 2).alias("seq"), F.concat("name", F.lit(" range")).alias("indicator"),
        F.concat(F.col("min").cast("bigint"), F.lit("–"), F.col("max").cast("bigint")).alias("value"), F.lit("range").alias("type"),
    )
    means = num.filter("not v_year and mean is not null").select(
        (F.col("position") * 2).alias("seq"), F.concat(F.lit("Average "), "name").alias("indicator"), money(F.col("mean")).alias("value"), F.lit("average").alias("type")
    )
    stds = num.filter("not v_year and std > 0").select(
        (F.col("position") * 2 + 1).alias("seq"), F.concat(F.lit("Variability in "), "name").alias("indicator"), money(F.col("std")).alias("value"), F.lit("variability").alias("type")
    )
    size = view.agg(F.count(F.lit(1)).alias("k")).select(
        F.lit(1_000_000).alias("seq"), F.lit("Dataset Size").alias("indicator"),
        F.concat(F.lit(f"{n_rows} rows × "), F.col("k").cast("string"), F.lit(" cols")).alias("value"), F.lit("dataset_size").alias("type"),
    )
    first_cat = view.filter("role = 'categorical' and size(top_categories) > 0").agg(F.min_by("top_categories", "position").alias("t"))
    top = F.col("t")[0]
    common = first_cat.select(
        F.lit(1_000_001).alias("seq"), F.lit("Most Frequent Category").alias("indicator"),
        F.coalesce(F.concat(top["value"], F.lit(" ("), top["count"].cast("string"), F.lit(" times)")), F.lit("N/A")).alias("value"),
        F.lit("dominant_category").alias("type"),
    )
    return spans.unionByName(means).unionByName(stds).unionByName(size).unionByName(common)


def indicator_bars(indicators: DataFrame, n: int = 10) -> DataFrame:
    """(name, value, type) of the first ``n`` indicators."""
    return indicators.orderBy("seq").limit(n).select(F.col("indicator").alias("name"), "value", "type")


def critical_totals(df: DataFrame, roled: DataFrame) -> DataFrame:
    """(name, total) of numeric columns whose name speaks of money and that may be summed."""
    view = profile_view(roled)
    wanted = tx.any_of([F.lower("name").contains(w) for w in MONEY_WORDS])
    cols = [r["name"] for r in view.filter((F.col("role") == "numeric") & wanted & can_sum()).orderBy("position").collect()]
    if not cols:
        return df.sparkSession.createDataFrame([], "name string, total double")
    cells = F.array(*[F.struct(F.lit(f"total_{c}").alias("name"), F.sum(tx.numeric(df, c)).alias("total")) for c in cols])
    return df.agg(cells.alias("t")).select(F.inline("t")).filter("total is not null")


def iqr_outliers(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, n, outliers, percent) by the 1.5-IQR rule for all columns in one pass after the quartiles."""
    num = df.select(*[tx.numeric(df, c).alias(c) for c in cols])
    q = ordering.quantile_map(num, cols, (0.25, 0.75))
    cells = []
    for c in cols:
        if (c, 0.25) not in q:
            continue
        iqr = q[c, 0.75] - q[c, 0.25]
        out = (F.col(c) < q[c, 0.25] - 1.5 * iqr) | (F.col(c) > q[c, 0.75] + 1.5 * iqr)
        cells.append(F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.count_if(out).alias("outliers")))
    flat = num.agg(F.array(*cells).alias("t")).select(F.inline("t"))
    return flat.filter("n > 10 and outliers > 0").withColumn("percent", F.col("outliers") / F.col("n") * 100)


def use_cases(roled: DataFrame) -> DataFrame:
    """(use_case, key_inputs) by which roles are present."""
    pick = lambda *rs: F.array_sort(F.array_compact(F.collect_list(F.when(F.col("role").isin(*rs), F.col("name")))))
    has = lambda r: F.count_if(F.col("role") == r) > 0
    row = roled.agg(
        F.when(has("numeric") & has("categorical"), pick("numeric", "categorical")).alias("Segmentation Analysis"),
        F.when(has("datetime") & has("numeric"), pick("datetime", "numeric")).alias("Time Series Analysis"),
        F.when(has("numeric"), pick("numeric")).alias("Performance Metrics Dashboard"),
    )
    return row.unpivot([], row.columns, "use_case", "key_inputs").filter("key_inputs is not null")


def recommendations(roled: DataFrame, n_correlations: int = 0) -> DataFrame:
    """(title, priority)."""
    nums, cats = F.count_if(F.col("role") == "numeric"), F.count_if(F.col("role") == "categorical")
    option = lambda cond, title, priority: F.when(cond, F.struct(F.lit(title).alias("title"), F.lit(priority).alias("priority")))
    row = roled.agg(
        F.array_compact(
            F.array(
                option(nums >= 2, "Correlation Analysis", "high"),
                option((cats > 0) & (nums > 0), "Group Comparisons", "medium"),
                option(F.lit(n_correlations > 3), "Deep Dive into Relationships", "high"),
            )
        ).alias("r")
    )
    return row.select(F.inline("r"))


# ---------------------------------------------------------------- KPIs and chart specs


def kpi_score():
    """Significance of a column as a headline number, 0..1."""
    tags = F.col("semantic_tags")
    id_like = tx.any_of([F.lower("name").contains(w) for w in KPI_ID_WORDS])
    role = F.col("role")
    spread_ = F.abs(F.try_divide(F.col("std"), F.col("mean")))
    score = (
        F.when(role == "numeric", 0.3).when(role.isin("categorical", "datetime"), 0.2).otherwise(0.0)
        + F.when(F.array_contains(tags, "monetary"), 0.4).otherwise(0.0)
        + F.when((F.col("mean") != 0) & (F.col("std") != 0), F.least(F.lit(0.3), spread_)).otherwise(0.0)
    )
    none = (role == "identifier") | (F.coalesce("std", F.lit(0.0)) < 0.01) | ((role == "numeric") & id_like)
    return F.when(none, 0.0).otherwise(F.least(F.lit(1.0), score))


def kpis(roled: DataFrame, insights: DataFrame, top_k: int = config.KPI_TOP_K) -> DataFrame:
    """(label, value, type, score): columns and correlations scoring above 0.5, best first."""
    scored = roled.withColumn("score", kpi_score()).filter("score > 0.5")
    value = (
        F.when((F.col("role") == "numeric") & F.col("mean").isNotNull(), F.concat(tx.fixed_point(F.col("mean"), 2), F.lit(" (±"), tx.fixed_point(F.col("std"), 2), F.lit(")")))
        .when(F.col("role").isin("categorical", "text") & (F.size("top_categories") > 0), F.concat(F.lit("Top: '"), F.col("top_categories")[0]["value"], F.lit("'")))
        .otherwise("N/A")
    )
    cols = scored.select(F.col("name").alias("label"), value.alias("value"), F.col("role").alias("type"), "score", F.col("position").alias("seq"))
    known = roled.select("name")
    pairs = insights.join(F.broadcast(known.withColumnRenamed("name", "a")), "a", "left_semi").join(F.broadcast(known.withColumnRenamed("name", "b")), "b", "left_semi")
    corr = pairs.filter(F.abs("r") > 0.5).select(
        F.concat(F.lit("Corr: "), "a", F.lit(" & "), "b").alias("label"), tx.fixed_point(F.col("r"), 2).alias("value"),
        F.lit("correlation").alias("type"), F.abs("r").alias("score"), F.lit(1_000_000).alias("seq"),
    )
    return cols.unionByName(corr).orderBy(F.desc("score"), "seq", "label").limit(top_k).drop("seq")


def chart_specs(roled: DataFrame, insights: DataFrame, max_charts: int = config.MAX_CHARTS) -> DataFrame:
    """(seq, id, chart_type, intent, x_field, y_field, agg_func, priority): ranked, without repeats."""
    view = profile_view(roled)
    none = F.lit(None).cast("string")

    def spec(rows, seq, sid, ctype, intent, x, y, agg, priority):
        return rows.select(
            seq.cast("double").alias("seq"), sid.alias("id"), F.lit(ctype).alias("chart_type"), F.lit(intent).alias("intent"),
            x.alias("x_field"), y.alias("y_field"), agg.alias("agg_func"), F.lit(priority).alias("priority"),
        )

    name, pos = F.col("name"), F.col("position")
    nums = view.filter("role = 'numeric'")
    cats = view.filter("role = 'categorical' and unique_count <= 50")
    dist = spec(nums, pos, F.concat(F.lit("dist_"), name), "histogram", "distribution", name, none, none, 2)
    count = spec(cats, pos + 1000, F.concat(F.lit("count_"), name), "bar", "category_count", name, none, none, 1)
    scat = spec(insights, F.dense_rank().over(Window.orderBy("a", "b")) + 2000, F.concat(F.lit("scatter_"), "a", F.lit("_"), "b"), "scatter", "scatter", F.col("a"), F.col("b"), none, 1)
    date = view.filter("role = 'datetime'").agg(F.min_by("name", "position").alias("d")).filter("d is not null")
    best = nums.filter("not v_year").withColumn("score", kpi_score()).orderBy(F.desc("score"), "position").limit(3)
    best = best.withColumn("k", F.row_number().over(Window.orderBy(F.desc("score"), "position")))  # three rows
    agg = F.when(F.col("v_aggregation") == "additive", "sum").otherwise("mean")
    ts = spec(best.crossJoin(F.broadcast(date)), F.col("k") + 3000, F.concat(F.lit("timeseries_"), "d", F.lit("_"), name), "line", "time_series", F.col("d"), name, agg, 0)
    every = dist.unionByName(count).unionByName(scat).unionByName(ts)
    same = Window.partitionBy("x_field", "y_field", "chart_type", "intent").orderBy("seq")  # spec rows only
    once = every.withColumn("rn", F.row_number().over(same)).filter("rn = 1").drop("rn")
    return once.orderBy("priority", "seq").limit(max_charts)


def merge_specs(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary specs in rank order, then every fallback spec whose (intent, x, y) is new."""
    sig = lambda d: d.withColumn("sig", F.concat_ws("|", F.col("intent"), F.coalesce("x_field", F.lit("")), F.coalesce("y_field", F.lit(""))))
    p, f = sig(primary), sig(fallback)
    extra = f.join(p.select("sig"), "sig", "left_anti")
    return p.withColumn("tier", F.lit(0)).unionByName(extra.withColumn("tier", F.lit(1))).drop("sig")


def merge_kpis(primary: DataFrame, fallback: DataFrame, full_set: int = 6) -> DataFrame:
    """(label, source): primary KPIs; the others join only when there are fewer than six primary ones."""
    n = primary.agg(F.count(F.lit(1)).alias("n"))
    extra = fallback.join(primary.select("source"), "source", "left_anti").crossJoin(F.broadcast(n)).filter(F.col("n") < full_set).drop("n")
    return primary.unionByName(extra)


def validate_references(items: DataFrame, columns: DataFrame) -> DataFrame:
    """(id, reason) for items with unknown columns, disallowed intents or no provenance.

    ``items``: (id, kind 'kpi'|'chart', source, intent, x_field, y_field); ``columns``: (name).
    """
    src = F.col("source")
    refs = (
        F.when(F.col("kind") == "chart", F.array("x_field", "y_field"))
        .when(src.startswith("column:"), F.array(F.substring_index(src, ":", -1)))
        .when(src.startswith("corr:"), F.split(F.substring_index(src, ":", -1), r"\|"))
        .otherwise(F.array().cast("array<string>"))
    )
    named = items.withColumn("ref", F.explode_outer(F.filter(refs, lambda r: r.isNotNull() & (r != ""))))
    unknown = named.filter("ref is not null").join(columns.select(F.col("name").alias("ref")), "ref", "left_anti")
    a = unknown.groupBy("id").agg(F.lit("unknown-column").alias("reason"))
    b = items.filter((F.col("kind") == "chart") & ~F.coalesce(F.col("intent").isin(*INTENTS), F.lit(False))).select("id", F.lit("disallowed-intent").alias("reason"))
    c = items.filter((F.col("kind") == "kpi") & (F.coalesce(src, F.lit("")) == "")).select("id", F.lit("no-provenance").alias("reason"))
    return a.join(b.select("id"), "id", "left_anti").unionByName(b).unionByName(c)


def kpi_text(metric: str):
    """Value text of a KPI taken from the profile row: the number never comes from elsewhere."""
    top = F.col("top_categories")[0]
    label = F.when(F.size("top_categories") > 0, F.concat(F.lit("Top: '"), top["value"], F.lit("' ("), top["count"].cast("string"), F.lit(")"))).otherwise("N/A")
    if metric == "top_category":
        return label
    if metric == "count":
        return F.coalesce(F.col("count").cast("string"), F.lit("N/A"))
    known = metric in ("sum", "mean", "median", "min", "max", "std", "variance")
    shown = F.format_number(F.col(metric), 2) if known else F.lit(None).cast("string")
    fallback = F.concat(F.format_number("mean", 2), F.lit(" (±"), F.format_number("std", 2), F.lit(")"))
    return F.when(F.col("role").isin("categorical", "text"), label).otherwise(F.coalesce(shown, fallback, F.lit("N/A")))


def settle_insights(spark, found: list[dict]) -> DataFrame:
    rows = [(i["a"], i["b"], float(i["r"]), int(i["n"])) for i in found]
    return spark.createDataFrame(rows, "a string, b string, r double, n long")

