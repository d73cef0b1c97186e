"""Checks that veto nonsensical roles or flag traps (totals beside parts, shares, wild spread)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise import config


def role_vetoes(roled: DataFrame) -> DataFrame:
    """(column, from_role, to_role): near-unique whole measures are keys, fractional keys are measures."""
    tags = F.col("semantic_tags")
    unique = F.col("unique_count") / F.col("n_rows")
    whole = F.coalesce(F.col("int_like"), F.lit(False))
    to_id = (
        (F.col("role") == "numeric") & whole & (unique >= config.CRITIC_ID_UNIQUE_RATIO)
        & ~F.array_contains(tags, "additive") & ~F.array_contains(tags, "monetary")
    )
    to_num = (F.col("role") == "identifier") & F.col("int_like").isNotNull() & ~whole
    return (
        roled.withColumn("to_role", F.when(to_id, "identifier").when(to_num, "numeric"))
        .filter(F.col("to_role").isNotNull())
        .select(F.col("name").alias("column"), F.col("role").alias("from_role"), "to_role")
    )


def apply_vetoes(roled: DataFrame, vetoes: DataFrame) -> DataFrame:
    v = vetoes.select(F.col("column").alias("name"), "to_role")
    return roled.join(v, "name", "left").withColumn("role", F.coalesce("to_role", "role")).drop("to_role")


def total_errors(df: DataFrame, cols: list[str]) -> DataFrame:
    """(total, rows, mean_error): how far each column is from the row-wise sum of all the others."""
    num = {c: F.col(c).cast("double") for c in cols}
    parts = []
    for t in cols:
        rest = sum((F.coalesce(num[c], F.lit(0.0)) for c in cols if c != t), F.lit(0.0))
        usable = F.abs(num[t]) > 0
        error = F.when(usable, F.abs(rest - num[t]) / F.abs(num[t]))
        parts.append(F.struct(F.lit(t).alias("total"), F.count_if(usable).alias("rows"), F.avg(error).alias("mean_error")))
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def total_flag(df: DataFrame, cols: list[str]) -> list[str] | None:
    """[total, *parts] for the first column that equals the sum of at least two others, else None."""
    if len(cols) < 3 or df.count() < config.CRITIC_MIN_ROWS:
        return None
    for r in total_errors(df, cols).collect():
        if r["rows"] >= config.CRITIC_MIN_ROWS and r["mean_error"] is not None and r["mean_error"] <= config.CRITIC_TOTAL_TOLERANCE:
            return [r["total"], *[c for c in cols if c != r["total"]]]
    return None


def share_sums(df: DataFrame, cols: list[str]) -> DataFrame:
    """(target, close_share) for targets 1 and 100: rows whose shares add up to the target."""
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    parts = F.array(
        *[
            F.struct(
                F.lit(t).alias("target"),
                F.avg((F.abs(total - t) <= config.CRITIC_SHARE_SUM_TOLERANCE * t).cast("double")).alias("close_share"),
            )
            for t in (1.0, 100.0)
        ]
    )
    return df.agg(parts.alias("p")).select(F.inline("p"))


def dispersion_flags(roled: DataFrame) -> DataFrame:
    """Numeric columns whose spread is at least three times their mean."""
    ratio = F.abs(F.try_divide(F.col("std"), F.col("mean")))
    return roled.filter((F.col("role") == "numeric") & (F.col("mean") != 0) & (ratio >= config.CRITIC_STD_MEAN_RATIO)).select(
        F.col("name").alias("column"), ratio.alias("ratio")
    )


def critique(df: DataFrame, roled: DataFrame) -> dict:
    rows = roled.orderBy("position").select("name", "role", "semantic_tags").collect()
    numeric = [r["name"] for r in rows if r["role"] == "numeric"]
    share_words = ("ratio", "share", "pct")
    shares = [r["name"] for r in rows if r["role"] == "numeric" and ("rate" in r["semantic_tags"] or any(w in r["name"].lower() for w in share_words))]
    flags = []
    stored = [c for c in numeric if df.schema[c].dataType.typeName() != "string"]
    total = total_flag(df, stored)
    if total:
        flags.append({"type": "total_vs_components", "columns": total})
    if len(shares) >= 2 and df.count() >= config.CRITIC_MIN_ROWS:
        hit = [r["target"] for r in share_sums(df, shares).orderBy("target").collect() if (r["close_share"] or 0) >= 0.9]
        if hit:
            flags.append({"type": "share_sum", "columns": shares, "target": hit[0]})
    flags += [{"type": "std_gg_mean", "columns": [r["column"]], "ratio": r["ratio"]} for r in dispersion_flags(roled).collect()]
    return {"vetoes": [r.asDict() for r in role_vetoes(roled).collect()], "flags": flags}


def review_findings(vetoes: DataFrame, flags: DataFrame, fields: DataFrame, low: float) -> DataFrame:
    """(column, reason): vetoes first, then flags, then uncertain types; one reason per column."""
    from pyspark.sql import Window

    found = (
        vetoes.select("column", F.lit(1).alias("source"), F.lit("type-corrected").alias("reason"))
        .unionByName(flags.select("column", F.lit(2).alias("source"), F.col("type").alias("reason")))
        .unionByName(
            fields.filter((F.col("confidence") > 0) & (F.col("confidence") < low)).select(
                F.col("name").alias("column"), F.lit(3).alias("source"), F.lit("low-certainty").alias("reason")
            )
        )
    )
    win = Window.partitionBy("column").orderBy("source", "reason")
    return found.withColumn("rn", F.row_number().over(win)).filter("rn = 1").select("column", "reason")
