"""Ingest gate: numeric coercion, placeholder nulling, empty-row removal, personal-data scan, manifest.

Two passes: one aggregation reads every text column's rates and counts, one projection applies the
verdicts. Coercion is decided before placeholders are nulled, so a column with more than 5 % placeholders
stays text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise import config
from tabwise.functions import text as tx
from tabwise.session import spread


@dataclass
class CleanResult:
    ok: bool
    df: DataFrame | None = None
    reject_reason: str | None = None
    manifest: dict = field(default_factory=dict)
    pii_columns: dict = field(default_factory=dict)
    sensitivity: str = "sensitive"
    pii_blocked: bool = False
    warnings: list = field(default_factory=list)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def reshape_wide_years(df: DataFrame) -> DataFrame:
    """Year-named columns (more than 5 and more than 30 % of all) become rows (Year, Value)."""
    years = [c for c in df.columns if re.match(tx.WIDE_YEAR_NAME, c)]
    ids = [c for c in df.columns if c not in years]
    if len(years) <= 5 or len(years) / len(df.columns) <= 0.3 or not ids:
        return df
    long = df.unpivot(ids, years, "Year", "Value")
    return long.withColumn("Year", F.regexp_replace("Year", "^col_", "").cast("int"))


def coercion_rates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(name, non_null, with_digit, numeric, plain_int): one aggregation over all text columns."""
    cols = text_columns(df) if cols is None else cols
    measures = []
    for c in cols:
        stripped = tx.strip_money(F.col(c))
        measures.append(
            F.struct(
                F.lit(c).alias("name"),
                F.count(c).alias("non_null"),
                F.count_if(F.col(c).rlike("[0-9]")).alias("with_digit"),
                F.count(tx.to_number(stripped)).alias("numeric"),
                F.count_if(stripped.rlike(tx.INTEGER)).alias("plain_int"),
            )
        )
    return spread(df.select(*cols)).agg(F.array(*measures).alias("m")).select(F.inline("m"))


def coercible(rates: DataFrame, fraction: float = config.NUMERIC_COERCE_FRACTION) -> DataFrame:
    return rates.withColumn(
        "coerced", (F.col("with_digit") > 0) & (F.col("numeric") >= F.lit(fraction) * F.col("non_null"))
    )


def coerce_numeric(df: DataFrame, cols: list[str], as_long: list[str] = ()) -> DataFrame:
    """Replace text columns by their numbers (bigint where every value is a plain integer)."""
    change = {}
    for c in cols:
        value = tx.money_to_number(F.col(c))
        change[c] = tx.strip_money(F.col(c)).try_cast("bigint") if c in as_long else value
    return df.withColumns(change) if change else df


def null_sentinels(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = text_columns(df) if cols is None else cols
    return df.withColumns({c: F.when(~tx.is_sentinel(F.col(c)), F.col(c)) for c in cols}) if cols else df


def sentinel_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    hits = F.array(*[F.struct(F.lit(c).alias("name"), F.count_if(tx.is_sentinel(F.col(c))).alias("nulled")) for c in cols])
    return df.agg(hits.alias("m")).select(F.inline("m"))


def null_fraction(df: DataFrame):
    return sum(F.col(c).isNull().cast("int") for c in df.columns) / F.lit(len(df.columns))


def drop_null_rows(df: DataFrame, fraction: float = config.NULL_ROW_FRACTION) -> DataFrame:
    return df.filter(null_fraction(df) < fraction)


def pii_hits(df: DataFrame, cols: list[str] | None = None, sample_rows: int | None = None, key: str | None = None) -> DataFrame:
    """(name, entities): which kinds of personal data each text column shows.

    Whole columns by default, in one aggregation; ``sample_rows`` keeps the sampling variant (the rows
    with the smallest md5 of ``key``).
    """
    cols = text_columns(df) if cols is None else cols
    if sample_rows:
        df = df.orderBy(F.md5(F.col(key).cast("string"))).limit(sample_rows)
    per_col = []
    for c in cols:
        found = [F.when(F.bool_or(F.col(c).rlike(p)), F.lit(e)) for e, p in tx.PII_PATTERNS.items()]
        per_col.append(F.struct(F.lit(c).alias("name"), F.array_sort(F.array_compact(F.array(*found))).alias("entities")))
    return spread(df.select(*cols)).agg(F.array(*per_col).alias("m")).select(F.inline("m")).filter(F.size("entities") > 0)


def count_total_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose cell in any of ``cols`` is a total label ('Grand Total', 'Avg', ...)."""
    test = tx.any_of([F.coalesce(F.col(c).cast("string").rlike(tx.TOTAL_ROW), F.lit(False)) for c in cols])
    return df.agg(F.count_if(test).alias("aggregate_rows"))


def run_gate(df: DataFrame, scan_pii: bool = True) -> CleanResult:
    """The whole gate: decide (one pass), apply (projection), report."""
    if not df.columns:
        return CleanResult(False, reject_reason="Empty dataset (no columns).")
    texts = text_columns(df)
    rates = {r["name"]: r for r in coercible(coercion_rates(df, texts)).collect()} if texts else {}
    to_num = [c for c in texts if rates[c]["coerced"]]
    rows = df.count()
    longs = [c for c in to_num if rates[c]["plain_int"] == rows]
    work = coerce_numeric(df, to_num, longs)
    left = [c for c in texts if c not in to_num]
    nulled = {r["name"]: r["nulled"] for r in sentinel_counts(work, left).collect() if r["nulled"]} if left else {}
    work = null_sentinels(work, list(nulled))
    kept = drop_null_rows(work)
    kept_rows = kept.count()
    manifest = {
        "original_shape": (rows, len(df.columns)),
        "cleaned_shape": (kept_rows, len(df.columns)),
        "coerced_numeric": to_num,
        "sentinels_nulled": nulled,
        "dropped_null_rows": rows - kept_rows,
    }
    if kept_rows == 0:
        return CleanResult(False, reject_reason="Every row was empty or held only placeholder values.", manifest=manifest)
    pii = {r["name"]: list(r["entities"]) for r in pii_hits(kept, left).collect()} if scan_pii and left else {}
    warn = [] if pii or not left else ["Pattern scan only: the dataset is treated as sensitive to be safe."]
    return CleanResult(
        True, kept, None, manifest, pii, "sensitive" if pii or left else "public", bool(pii), warn
    )


def manifest_table(spark: SparkSession, manifest: dict) -> DataFrame:
    """One-row audit table of a gate run."""
    schema = (
        "original_rows long, original_cols int, cleaned_rows long, cleaned_cols int, "
        "coerced_numeric array<string>, sentinels_nulled map<string,long>, dropped_null_rows long"
    )
    o, c = manifest["original_shape"], manifest["cleaned_shape"]
    row = (o[0], o[1], c[0], c[1], manifest["coerced_numeric"], manifest["sentinels_nulled"], manifest["dropped_null_rows"])
    return spark.createDataFrame([row], schema)


def manifest_counts(df: DataFrame) -> DataFrame:
    """The same audit computed lazily in one aggregation (coercion verdicts taken as given by rates)."""
    texts = text_columns(df)
    rates = {r["name"]: r["coerced"] for r in coercible(coercion_rates(df, texts)).collect()}
    left = [c for c in texts if not rates[c]]
    flags = df.select(
        *[tx.is_sentinel(F.col(c)).alias(f"s_{c}") for c in left],
        _empty_row(df, left, [c for c in texts if rates[c]]).alias("empty"),
    )
    return flags.agg(
        F.count(F.lit(1)).alias("original_rows"),
        F.count_if(~F.col("empty")).alias("cleaned_rows"),
        F.count_if("empty").alias("dropped_null_rows"),
        F.lit(len([c for c in texts if rates[c]])).cast("bigint").alias("coerced_columns"),
        sum([F.count_if(f"s_{c}") for c in left], F.lit(0)).cast("bigint").alias("sentinels_nulled"),
    )


def _empty_row(df, left, coerced):
    tests = []
    for c in df.columns:
        if c in left:
            tests.append(F.col(c).isNull() | tx.is_sentinel(F.col(c)))
        elif c in coerced:
            tests.append(tx.money_to_number(F.col(c)).isNull())
        else:
            tests.append(F.col(c).isNull())
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))
