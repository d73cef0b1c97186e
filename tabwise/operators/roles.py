"""Semantic roles as expressions over the signal table (one row per column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise import config
from tabwise.functions import text as tx
from tabwise.operators import profile as pf
from tabwise.session import is_small

# Share of each signal that counts as evidence, and the bar an identifier must clear.
UUID_WEIGHT, STEP1_WEIGHT, VERY_HIGH_WEIGHT = 1.0, 0.98, 0.92
HIGH_WEIGHT, NAME_WEIGHT, MODERATE_WEIGHT, IDENTIFIER_BAR = 0.85, 0.70, 0.4, 0.65


def signal_table(df: DataFrame, max_cols: int = config.MAX_COLS, table: DataFrame | None = None) -> DataFrame:
    """Profile joined with every signal the role rules read; a fixed number of jobs for all columns."""
    cols = pf.profiled_columns(df, max_cols)
    table = pf.value_table(df, cols) if table is None else table
    base = pf.syntactic_profile(df, max_cols, table)
    texts = [c for c in cols if pf.kind_of(df, c) == "object"]
    if texts:
        base = base.join(F.broadcast(pf.text_signals(df, texts, table=table)), "name", "left")  # one row per column
    else:
        base = base.select(
            "*", F.lit(0.0).alias("uuid_share"), F.lit(0.0).alias("number_rate"), F.lit(False).alias("currency"),
            F.lit(None).cast("array<double>").alias("date_rates"), F.lit(0.0).alias("iso_rate"),
            F.lit(0.0).alias("ambiguous_share"),
            *[F.lit(None).cast("double").alias(c) for c in ("t_min", "t_max", "t_mean", "t_std")],
        )
    # integers with missing values are measurements: they can never key a row
    kind = F.when((F.col("dtype") == "int") & (F.col("null_count") > 0), "float").otherwise(F.col("dtype"))
    return base.withColumn("kind", kind).withColumn("n_rows", F.col("null_count") + F.col("count"))


def identifier_confidence() -> Column:
    ratio = F.col("unique_count") / F.col("n_rows")
    unique = (
        F.when(ratio > 0.98, F.least(F.lit(0.95), ratio) * VERY_HIGH_WEIGHT)
        .when(ratio > 0.95, F.least(F.lit(0.85), ratio * 0.9) * HIGH_WEIGHT)
        .when(ratio > 0.90, ratio * 0.6 * MODERATE_WEIGHT)
        .otherwise(0.0)
    )
    n = F.col("count")
    span = F.col("max") - F.col("min")
    step1 = (F.col("kind") == "int") & (n > 5) & (F.col("unique_count") == n) & (span == n - 1)
    sequence = F.when(step1, F.least(F.lit(0.95), n / F.greatest(n, F.lit(10))) * STEP1_WEIGHT).otherwise(0.0)
    uuid = F.when((F.col("dtype") == "object") & (F.col("uuid_share") > 0.5), F.col("uuid_share") * UUID_WEIGHT).otherwise(0.0)
    return F.greatest(unique, sequence, uuid, tx.id_keyword_score(F.col("name")) * NAME_WEIGHT)


def best_date_rate() -> Column:
    return F.coalesce(F.array_max("date_rates"), F.lit(0.0))


def best_date_format() -> Column:
    """Label of the first format with the best rate."""
    labels = F.array(*[F.lit(label) for label, _ in tx.DATE_FORMATS])
    return F.element_at(labels, F.array_position("date_rates", F.array_max("date_rates")).cast("int"))


def with_roles(signals: DataFrame) -> DataFrame:
    """Adds role, confidence, alternatives, semantic_tags."""
    ratio = F.col("unique_count") / F.greatest(F.col("count"), F.lit(1))
    is_id = F.col("id_confidence") > IDENTIFIER_BAR
    kind = F.col("kind")
    role = (
        F.when(kind == "bool", "boolean")
        .when(kind == "datetime", "datetime")
        .when(kind == "float", "numeric")
        .when(is_id, "identifier")
        .when(kind == "int", "numeric")
        .when(kind != "object", "text")
        .when(F.col("ambiguous_share") >= 0.2, "text")
        .when((F.col("best_date_rate") >= 0.85) | (F.col("iso_rate") >= 0.9), "datetime")
        .when(F.col("number_rate") >= 0.85, "numeric")
        .when((F.col("unique_count") < 50) & (ratio < 0.2), "categorical")
        .when((F.col("unique_count") > 50) & (ratio < 0.05), "categorical")
        .otherwise("text")
    )
    out = (
        signals.withColumn("id_confidence", identifier_confidence())
        .withColumn("best_date_rate", best_date_rate())
        .withColumn("role", role)
    )
    textual = F.col("dtype") == "object"
    for stat, alt in (("min", "t_min"), ("max", "t_max"), ("mean", "t_mean"), ("std", "t_std")):
        out = out.withColumn(stat, F.when(textual & (F.col("role") == "numeric"), F.col(alt)).otherwise(F.col(stat)))
    out = out.withColumn("semantics", aggregation_semantics())
    monetary = (F.col("role") == "numeric") & F.coalesce(F.col("currency"), F.lit(False))
    date_tag = F.when(
        textual & (F.col("role") == "datetime"),
        F.when(F.col("best_date_rate") >= 0.85, F.concat(F.lit("format:"), best_date_format())).otherwise("dateutil_high_confidence"),
    ).when(textual & (F.col("ambiguous_share") >= 0.2), "ambiguous_date")
    tags = F.array_compact(F.array(date_tag, F.when(monetary, "monetary"), F.col("semantics")))
    return with_confidence(out.withColumn("semantic_tags", tags))


def aggregation_semantics() -> Column:
    """'additive' (sum over time), 'rate' (average) or null, for numeric columns."""
    name = F.col("name")
    bounded = (F.col("kind") == "float") & (F.col("count") > 10) & (F.col("min") >= 0) & (F.col("max") <= 1)
    return F.when(
        F.col("role") == "numeric",
        F.when(F.coalesce(F.col("currency"), F.lit(False)), "additive")
        .when(tx.is_rate_name(name), "rate")
        .when(tx.is_additive_name(name), "additive")
        .when(bounded, "rate"),
    )


def with_confidence(roled: DataFrame) -> DataFrame:
    """Confidence of the chosen role and the two best other roles."""
    ratio = F.col("unique_count") / F.greatest(F.col("count"), F.lit(1))
    role = F.col("role")
    by_storage = F.when(F.col("kind").isin("int", "float", "bool"), "numeric").otherwise("categorical")
    option = lambda r, s: F.struct((r if isinstance(r, Column) else F.lit(r)).alias("role"), s.cast("double").alias("confidence"))
    lit = F.lit
    measured = F.array(option(role, lit(0.92)), option("identifier", F.when(ratio > 0.9, 0.35).otherwise(0.1)), option("categorical", lit(0.2)))
    options = (
        F.when(role == "identifier", F.array(option("identifier", F.col("id_confidence")), option(by_storage, lit(0.3)), option("text", lit(0.2))))
        .when(role.isin("numeric", "boolean", "datetime"), measured)
        .when(
            role == "categorical",
            F.array(
                option("categorical", F.greatest(lit(0.55), F.least(lit(0.95), 1.0 - ratio))),
                option("text", ratio),
                option("identifier", F.when(ratio > 0.9, 0.4).otherwise(0.1)),
            ),
        )
        .otherwise(
            F.array(
                option("text", lit(0.6)),
                option("categorical", F.greatest(lit(0.0), 0.5 - ratio)),
                option("identifier", F.when(ratio > 0.95, 0.5).otherwise(0.1)),
            )
        )
    )
    others = F.filter(F.slice(F.col("options"), 2, 2), lambda o: o["role"] != F.col("role"))
    rounded = F.transform(others, lambda o: F.struct(o["role"].alias("role"), F.round(o["confidence"], 4).alias("confidence")))
    ranked = F.when(
        (F.size(rounded) == 2) & (F.element_at(rounded, 2)["confidence"] > F.element_at(rounded, 1)["confidence"]), F.reverse(rounded)
    ).otherwise(rounded)
    return (
        roled.withColumn("options", options)
        .withColumn("confidence", F.round(F.element_at("options", 1)["confidence"], 4))
        .withColumn("alternatives", ranked)
        .drop("options")
    )


def classify(df: DataFrame, max_cols: int = config.MAX_COLS) -> DataFrame:
    """The roled profile, computed once: at most ``max_cols`` rows, so later stages read a local table.

    The value table of a small input is cached meanwhile; for a large one its readers share the shuffle.
    """
    table = pf.value_table(df, pf.profiled_columns(df, max_cols))
    if not is_small(df):
        return settle(with_roles(signal_table(df, max_cols, table)))
    table.persist()
    try:
        return settle(with_roles(signal_table(df, max_cols, table)))
    finally:
        table.unpersist()


def settle(table: DataFrame) -> DataFrame:
    """Run the jobs behind a one-row-per-column table now and keep its few rows."""
    rows = table.limit(10_000).collect()
    return table.sparkSession.createDataFrame(rows, table.schema)


def with_year_ratio(roled: DataFrame) -> DataFrame:
    """Adds is_year and is_ratio: finer kinds of the numeric role."""
    name, lo, hi = F.col("name"), F.col("min"), F.col("max")
    numeric = F.col("role") == "numeric"
    year_name, ratio_name = name.rlike(tx.YEAR_NAME), name.rlike(tx.RATIO_NAME)
    whole = F.coalesce(F.col("int_like"), F.lit(False))
    is_year = numeric & whole & (lo >= config.MIN_DATE) & (hi <= config.MAX_DATE) & year_name
    bounded = ((lo >= 0) & (hi <= 1)) | ((lo >= 0) & (hi <= 100) & ratio_name)
    rate = F.array_contains("semantic_tags", "rate")
    return roled.withColumn("is_year", F.coalesce(is_year, F.lit(False))).withColumn(
        "is_ratio", F.coalesce(numeric & ~F.col("is_year") & (rate | bounded | ratio_name), F.lit(False))
    )


def role_counts(roled: DataFrame) -> DataFrame:
    return roled.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def dataset_kind(roled: DataFrame) -> DataFrame:
    """event-level or entity-level, from the shares of the roles."""
    total = F.count(F.lit(1))
    ids, nums = F.count_if(F.col("role") == "identifier"), F.count_if(F.col("role") == "numeric")
    dates = F.count_if(F.col("role") == "datetime")
    return roled.agg(
        F.when(total == 0, "unknown")
        .when(ids / total > 0.3, "entity-level")
        .when((dates > 0) & (nums > 0), "event-level")
        .when(nums / total > 0.4, "event-level")
        .otherwise("entity-level").alias("grain_kind")
    )
