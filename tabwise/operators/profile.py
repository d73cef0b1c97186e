"""Column profile: counts, distincts, top values, moments and quartiles for all columns at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise import config
from tabwise.functions import text as tx
from tabwise.operators import ordering
from tabwise.session import spread

_KINDS = {
    "boolean": "bool", "string": "object", "date": "datetime", "timestamp": "datetime",
    "timestamp_ntz": "datetime", "double": "float", "float": "float", "decimal": "float",
    "byte": "int", "short": "int", "integer": "int", "long": "int",
}


def kind_of(df: DataFrame, col: str) -> str:
    name = df.schema[col].dataType.typeName()
    return _KINDS.get(name, "other")


def profiled_columns(df: DataFrame, max_cols: int | None = config.MAX_COLS) -> list[str]:
    return df.columns[:max_cols]


def numeric_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """Numeric by storage; booleans count as 0/1 numbers here."""
    return [c for c in (cols or df.columns) if kind_of(df, c) in ("int", "float", "bool")]


def _as_double(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols])


def numeric_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(name, count, min, max, mean, std, sum, variance, int_like, quartiles): one pass plus the quantile job."""
    cols = numeric_columns(df) if cols is None else cols
    num = _as_double(df, cols)
    one_or = lambda c, e: F.when(F.count(c) == 1, 0.0).otherwise(e)
    moments = [
        F.struct(
            F.lit(c).alias("name"),
            F.count(c).alias("count"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
            F.avg(c).alias("mean"),
            one_or(c, F.stddev_samp(c)).alias("std"),
            F.sum(c).alias("sum"),
            one_or(c, F.var_samp(c)).alias("variance"),
            F.bool_and(F.col(c) == F.round(F.col(c))).alias("int_like"),
        ).alias(f"p_{c}")
        for c in cols
    ]
    quart, row = ordering.quantiles_and_more(num, cols, (0.25, 0.5, 0.75), moments)
    schema = "name string, count long, min double, max double, mean double, std double, sum double, variance double, int_like boolean"
    base = df.sparkSession.createDataFrame([tuple(row[f"p_{c}"]) for c in cols], schema)
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    wide = quart.groupBy("name").agg(at(0.25).alias("q25"), at(0.5).alias("median"), at(0.75).alias("q75"))
    return base.join(F.broadcast(wide), "name", "left")  # one row per column


def value_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(name, text, num, cnt): every distinct value of every column with its row count.

    One shuffle of pre-aggregated values serves distinct counts, top values, text signals and the
    sequence test. Whole and fractional numbers travel as numbers (bigint / double), the rest as text.
    """
    cols = profiled_columns(df) if cols is None else cols
    none_s, none_i, none_d = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("double")
    cells = []
    for i, c in enumerate(cols):
        kind = kind_of(df, c)
        cells += [
            F.lit(i),
            none_s if kind in ("int", "float") else _text(df, c),
            F.col(c).cast("bigint") if kind == "int" else none_i,
            F.col(c).cast("double") if kind == "float" else none_d,
        ]
    long = spread(df.select(*cols)).select(F.stack(F.lit(len(cols)), *cells).alias("at", "text", "whole", "num"))
    present = F.coalesce(F.col("text").isNotNull() | F.col("whole").isNotNull() | F.col("num").isNotNull(), F.lit(False))
    counted = long.filter(present).groupBy("at", "text", "whole", "num").agg(F.count(F.lit(1)).alias("cnt"))  # numbers make shorter keys than names
    return counted.select(F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("at") + 1).alias("name"), "text", "whole", "num", "cnt")


def _text(df: DataFrame, c: str) -> Column:
    if kind_of(df, c) == "bool":
        return F.when(F.col(c), "True").when(~F.col(c), "False")
    return F.to_json(F.col(c)) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c).cast("string")


def value_text() -> Column:
    return F.coalesce("text", F.col("whole").cast("string"), F.col("num").cast("string"))


def column_counts(df: DataFrame, cols: list[str] | None = None, table: DataFrame | None = None) -> DataFrame:
    """(name, null_count, count, unique_count); missing values are no distinct value."""
    cols = profiled_columns(df) if cols is None else cols
    table = value_table(df, cols) if table is None else table
    seen = table.groupBy("name").agg(F.sum("cnt").alias("count"), F.count(F.lit(1)).alias("unique_count"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "name string")
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    full = F.broadcast(names).crossJoin(F.broadcast(total)).join(F.broadcast(seen), "name", "left")  # one row per column
    count = F.coalesce("count", F.lit(0).cast("bigint"))
    return full.select(
        "name", (F.col("rows") - count).alias("null_count"), count.alias("count"),
        F.coalesce("unique_count", F.lit(0).cast("bigint")).alias("unique_count"),
    )


def top_values(df: DataFrame, cols: list[str] | None = None, n: int = 10, table: DataFrame | None = None) -> DataFrame:
    """(name, value, cnt, rank): most frequent values per column, ties by value.

    The rank filter lets Spark cut every task to its own best ``n`` before the shuffle by column.
    """
    table = value_table(df, cols) if table is None else table
    win = Window.partitionBy("name").orderBy(F.desc("cnt"), "value")
    return (
        table.select("name", value_text().alias("value"), "cnt")
        .withColumn("rank", F.row_number().over(win)).filter(F.col("rank") <= n)
    )


def syntactic_profile(df: DataFrame, max_cols: int = config.MAX_COLS, table: DataFrame | None = None) -> DataFrame:
    """One row per profiled column; all-null columns are left out, an empty frame gives no rows."""
    cols = profiled_columns(df, max_cols)
    table = value_table(df, cols) if table is None else table
    spark = df.sparkSession
    order = spark.createDataFrame([(i, c, kind_of(df, c)) for i, c in enumerate(cols)], "position int, name string, dtype string")
    counts = column_counts(df, cols, table).filter(F.col("count") > 0)
    tops = (
        top_values(df, cols, table=table)
        .groupBy("name")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "cnt"))).alias("t"))
        .select("name", F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["cnt"].alias("count"))).alias("top_categories"))
    )
    nums = numeric_columns(df, cols)
    out = order.join(F.broadcast(counts), "name").join(F.broadcast(tops), "name", "left")  # one row per column each
    stats = ["min", "max", "mean", "std", "median", "q25", "q75", "sum", "variance"]
    if nums:
        out = out.join(F.broadcast(numeric_profile(df, nums).drop("count")), "name", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(s) for s in stats], F.lit(None).cast("boolean").alias("int_like"))
    return out.select("position", "name", "dtype", "null_count", "unique_count", "count", *stats, "int_like", "top_categories")


def text_signals(df: DataFrame, cols: list[str], strict_compat: bool = True, table: DataFrame | None = None) -> DataFrame:
    """Per text column: uuid share, number-parse rate, currency flag, date-format rates.

    Patterns run once per distinct value, weighted by its count; costly date parsing only where the
    text has a date's shape. The ambiguous day/month test of the observed behaviour never fires; with
    ``strict_compat`` off it marks columns where at least 20 % of the d/m/y-looking values have both
    parts up to 12.
    """
    table = value_table(df, cols) if table is None else table
    v, w = F.col("text"), F.col("cnt")
    shaped = v.rlike(r"^\s*[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}\s*$")
    leading_year = v.rlike(r"^\s*[0-9]{4}(-|$)")
    dmy = r"\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})\b"
    both = F.regexp_extract(v, dmy, 1).try_cast("int").between(1, 12) & F.regexp_extract(v, dmy, 2).try_cast("int").between(1, 12)
    tested = (
        table.withColumn("num", tx.to_number(tx.lenient_number_text(v, strict_compat)))
        .withColumn("dates", F.when(shaped, F.array(*[tx.parses_as_date(v, f) for _, f in tx.DATE_FORMATS])))
        .withColumn("iso", F.when(leading_year, F.try_to_timestamp(v).isNotNull()).otherwise(False))
    )
    n = F.sum(w)
    hits = lambda cond: F.coalesce(F.sum(F.when(cond, w)), F.lit(0))
    share = lambda cond: hits(cond) / n
    x = F.col("num")
    mean = F.sum(x * w) / hits(x.isNotNull())
    dev = F.sum(x * x * w) - hits(x.isNotNull()) * mean * mean
    ambiguous = F.lit(0.0) if strict_compat else F.coalesce(F.try_divide(hits(both), hits(v.rlike(dmy))), F.lit(0.0))
    return tested.groupBy("name").agg(
        share(v.rlike(tx.UUID)).alias("uuid_share"),
        share(x.isNotNull()).alias("number_rate"),
        F.bool_or(tx.has_currency(v)).alias("currency"),
        F.array(*[share(F.col("dates")[i]) for i in range(len(tx.DATE_FORMATS))]).alias("date_rates"),
        share(F.col("iso")).alias("iso_rate"),
        ambiguous.alias("ambiguous_share"),
        F.min(x).alias("t_min"), F.max(x).alias("t_max"), mean.alias("t_mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.try_divide(dev, hits(x.isNotNull()) - 1))).alias("t_std"),
    )


def sequence_signal(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, n, distinct_diffs, mean_diff, std_diff, step1): gaps between neighbouring sorted values.

    Duplicates add zero gaps; gaps between distinct values come from the ranged order, the border gap of
    each range from the previous range's largest value.
    """
    pos = ordering.positions(_as_double(df, cols), cols)
    # the next smaller distinct value ends exactly at `before`: an equi-join, not a global window
    prev = pos.select("name", F.col("value").alias("prev"), (F.col("before") + F.col("cnt")).alias("before"))
    gaps = pos.join(prev, ["name", "before"], "left")
    gap = F.col("value") - F.col("prev")
    zeros = F.sum(F.col("cnt") - 1)
    total, steps = F.sum(F.coalesce(gap, F.lit(0.0))), F.sum("cnt") - 1
    squares = F.sum(F.coalesce(gap * gap, F.lit(0.0)))
    return gaps.groupBy("name").agg(
        F.sum("cnt").alias("n"),
        (F.count_distinct(gap) + F.when(zeros > 0, 1).otherwise(0)).alias("distinct_diffs"),
        (total / steps).alias("mean_diff"),
        F.sqrt(F.greatest(F.lit(0.0), (squares - total * total / steps) / F.greatest(steps - 1, F.lit(1)))).alias("std_diff"),
    ).select(
        "*", ((F.col("n") > 5) & (F.col("distinct_diffs") == 1) & (F.abs(F.col("mean_diff") - 1) < 0.01)).alias("step1"),
        ((F.col("n") > 5) & (F.col("distinct_diffs") <= 3) & (F.col("std_diff") < F.col("mean_diff") * 0.1)).alias("low_variance"),
    )
