"""Field and dataset contracts: what may be done with each column, grain, acceptance, overrides."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwise import config
from tabwise.operators import roles

# ---- Fixed values: permitted aggregations and charts per kind of field --------------------------
ALLOWED_AGGREGATIONS = {
    "identifier": ("count", "nunique"),
    "year": ("min", "max", "range", "nunique"),
    "datetime": ("min", "max", "range"),
    "ratio": ("mean", "median", "min", "max"),
    "numeric_additive": ("sum", "mean", "min", "max", "median"),
    "numeric": ("mean", "median", "min", "max"),
    "categorical": ("count", "nunique"),
    "boolean": ("count", "sum", "mean"),
    "text": ("count", "nunique"),
}
ALLOWED_CHARTS = {
    "identifier": (),
    "year": ("line", "bar"),
    "datetime": ("line", "area"),
    "ratio": ("line", "bar", "box"),
    "numeric_additive": ("bar", "line", "histogram", "box", "scatter"),
    "numeric": ("histogram", "box", "scatter", "line"),
    "categorical": ("bar", "pie"),
    "boolean": ("bar", "pie"),
    "text": (),
}
# Before a contract exists a numeric column may be summed; the contract is stricter.
PROFILE_NUMERIC_AGGREGATIONS = ("sum", "mean", "min", "max", "median")
DIMENSION_ROLES = ("categorical", "identifier", "year", "boolean", "datetime")
# -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    name: str
    dtype: str
    role: str
    domain: str = "generic"
    confidence: float = 0.0
    aggregation: str = "none"
    is_identifier: bool = False
    is_year: bool = False
    is_ratio: bool = False
    sensitivity: str = "public"
    pii_entities: tuple = ()
    allowed_aggregations: tuple = ()
    allowed_charts: tuple = ()

    @property
    def can_sum(self) -> bool:
        return not (self.is_ratio or self.is_year or self.is_identifier) and "sum" in self.allowed_aggregations

    @property
    def is_correlatable(self) -> bool:
        return self.role == "numeric" and not (self.is_identifier or self.is_year)

    @property
    def is_dimension(self) -> bool:
        return self.role in DIMENSION_ROLES


@dataclass(frozen=True)
class Contract:
    schema_fingerprint: str
    version: int = 1
    locked: bool = False
    n_rows: int = 0
    n_cols: int = 0
    grain: tuple = ()
    aggregate_row_count: int = 0
    sensitivity: str = "public"
    pii_blocked: bool = False
    fields: dict = field(default_factory=dict)

    def with_lock(self, bump: bool = True) -> "Contract":
        return replace(self, locked=True, version=self.version + (1 if bump else 0))


def _lookup(table: dict, key: Column, default: tuple) -> Column:
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, values in table.items():
        out = out.when(key == name, F.array(*[F.lit(v) for v in values]).cast("array<string>"))
    return out.otherwise(F.array(*[F.lit(v) for v in default]).cast("array<string>"))


def with_allow_lists(fields: DataFrame) -> DataFrame:
    """Adds allowed_aggregations / allowed_charts from role and aggregation."""
    role = F.col("role")
    key = F.when((role == "numeric") & (F.col("aggregation") == "additive"), "numeric_additive").when(
        role.isin(*ALLOWED_AGGREGATIONS), role
    ).otherwise("text")
    keyed = fields.withColumn("allow_key", key)
    return (
        keyed.withColumn("allowed_aggregations", _lookup(ALLOWED_AGGREGATIONS, F.col("allow_key"), ("count",)))
        .withColumn("allowed_charts", _lookup(ALLOWED_CHARTS, F.col("allow_key"), ()))
        .drop("allow_key")
    )


def field_contracts(roled: DataFrame, pii: dict[str, list[str]] | None = None, dataset_sensitive: bool = False) -> DataFrame:
    """One contract row per column from the roled signal table."""
    tags = F.col("semantic_tags")
    has = lambda t: F.array_contains(tags, t)
    base = roled if "is_year" in roled.columns else roles.with_year_ratio(roled)
    old = F.col("old_role")
    aggregation = (
        F.when((old == "numeric") & has("additive"), "additive")
        .when(F.col("is_ratio") | has("rate"), "rate")
        .when(old == "boolean", "additive")
        .otherwise("none")
    )
    domain = (
        F.when(F.col("is_year"), "year")
        .when(F.col("is_ratio"), "ratio")
        .when((old == "numeric") & (F.col("aggregation") == "additive"), F.when(has("monetary"), "monetary").otherwise("measure"))
        .when(old.isin("categorical", "identifier"), "dimension")
        .otherwise("generic")
    )
    role = F.when(F.col("is_year"), "year").when(F.col("is_ratio"), "ratio").otherwise(old)
    found = F.lit(None).cast("array<string>")
    for c, ents in (pii or {}).items():
        found = F.when(F.col("name") == c, F.array(*[F.lit(e) for e in ents])).otherwise(found)
    out = (
        base.withColumnRenamed("role", "old_role")
        .withColumn("aggregation", aggregation)
        .withColumn("domain", domain)
        .withColumn("role", role)
        .withColumn("is_identifier", old == "identifier")
        .withColumn("pii_entities", F.coalesce(found, F.array().cast("array<string>")))
        .withColumn("sensitivity", F.when((F.size("pii_entities") > 0) | F.lit(dataset_sensitive), "sensitive").otherwise("public"))
    )
    return with_allow_lists(out).select(
        "position", "name", "dtype", "role", "domain", "confidence", "alternatives", "semantic_tags", "aggregation",
        "is_identifier", "is_year", "is_ratio", "sensitivity", "pii_entities", "allowed_aggregations", "allowed_charts",
    )


def to_fields(rows) -> dict[str, Field]:
    names = Field.__dataclass_fields__
    return {
        r["name"]: Field(**{k: (tuple(r[k]) if isinstance(r[k], list) else r[k]) for k in names})
        for r in sorted(rows, key=lambda r: r["position"])
    }


def schema_fingerprint(fields: DataFrame) -> DataFrame:
    """sha256 over the sorted (name, dtype, role) triples; column order does not matter."""
    triples = F.array_sort(F.collect_list(F.array("name", "dtype", "role")))
    return fields.agg(F.sha2(F.to_json(triples), 256).alias("fingerprint"))


def detect_grain(df: DataFrame, dims: list[str], max_combo: int = 2) -> tuple[str, ...]:
    """Smallest set of complete dimension columns that is unique per row, first in column order among equals.

    The lattice of sets is walked a size at a time. A set is worth a sketch only if the product of its columns' distinct
    counts reaches the rows; the sketches of a size share a scan, and what they leave is proven in one shuffle.
    """
    if not dims:
        return ()
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(d).isNull()).alias(f"null_{d}") for d in dims],
        *[F.approx_count_distinct(d, 0.02).alias(f"d_{d}") for d in dims],
    ).first()
    n, whole = row["n"], [d for d in dims if not row[f"null_{d}"]]
    if not n:
        return ()
    for k in range(1, max_combo + 1):
        able = [c for c in itertools.combinations(whole, k) if math.prod(row[f"d_{d}"] for d in c) >= 0.85 * n]
        if k > 1 and able:
            sketch = df.agg(*[F.approx_count_distinct(F.struct(*c), 0.02).alias(f"c{i}") for i, c in enumerate(able)]).first()
            able = [c for i, c in enumerate(able) if sketch[f"c{i}"] >= 0.85 * n]
        repeated = _repeated(df, able)
        unique = [c for i, c in enumerate(able) if i not in repeated]
        if unique:
            return unique[0]
    return ()


def _repeated(df: DataFrame, combos: list[tuple]) -> set[int]:
    """Numbers of the column sets that some two rows share, by 128 bits of their values; all sets in one shuffle."""
    if not combos:
        return set()
    cells = F.array(*[F.struct(F.lit(i).alias("set"), F.xxhash64(*c).alias("a"), F.xxhash64(F.lit(1), *c).alias("b")) for i, c in enumerate(combos)])
    counted = df.select(F.inline(cells)).groupBy("set", "a", "b").agg(F.count(F.lit(1)).alias("copies"))
    return {r["set"] for r in counted.filter("copies > 1").select("set").distinct().collect()}


def grain_duplicates(df: DataFrame, combo) -> DataFrame:
    return df.groupBy(*combo).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def acceptance(fields: DataFrame, has_grain: bool) -> DataFrame:
    """(mean_confidence, min_confidence, accepted, reasons): may the contract lock without review?"""
    mean, low = F.avg("confidence"), F.min("confidence")
    reasons = F.array_compact(
        F.array(
            F.when(~F.lit(has_grain), "no-grain"),
            F.when(mean < config.AUTO_ACCEPT_CONFIDENCE, "low-mean-confidence"),
            F.when(low < config.CONFIDENCE_FLOOR, "uncertain-column"),
        )
    )
    return fields.agg(F.round(mean, 4).alias("mean_confidence"), low.alias("min_confidence"), reasons.alias("reasons")).withColumn(
        "accepted", F.size("reasons") == 0
    )


def override_fields(fields: DataFrame, overrides: DataFrame) -> DataFrame:
    """Human corrections (name, role, domain, sensitivity; nulls keep) with re-derived allow-lists.

    Both sides hold one row per column of a dataset.
    """
    o = overrides.select("name", *[F.col(c).alias(f"new_{c}") for c in ("role", "domain", "sensitivity")], F.lit(True).alias("touched"))
    joined = fields.join(o, "name", "left")
    for c in ("role", "domain", "sensitivity"):
        joined = joined.withColumn(c, F.coalesce(f"new_{c}", c))
    aggregation = F.when(F.col("touched") & (F.col("role") == "identifier"), "none").when(
        F.col("touched") & (F.col("role") == "ratio"), "rate"
    ).otherwise(F.col("aggregation"))
    out = joined.withColumn("aggregation", aggregation)
    for flag, r in (("is_identifier", "identifier"), ("is_year", "year"), ("is_ratio", "ratio")):
        out = out.withColumn(flag, F.when(F.col("touched"), F.col("role") == r).otherwise(F.col(flag)))
    kept = out.withColumnRenamed("allowed_aggregations", "kept_agg").withColumnRenamed("allowed_charts", "kept_charts")
    redone = with_allow_lists(kept)
    for new, old in (("allowed_aggregations", "kept_agg"), ("allowed_charts", "kept_charts")):
        redone = redone.withColumn(new, F.when(F.col("touched"), F.col(new)).otherwise(F.col(old)))
    return redone.select(*fields.columns)


def apply_overrides(contract: Contract, fields: DataFrame, overrides: DataFrame) -> tuple[Contract, DataFrame]:
    """New locked version; detected personal data stays blocked whatever the reviewer says."""
    new = override_fields(fields, overrides)
    done = to_fields(new.collect())
    sensitive = contract.pii_blocked or any(f.sensitivity == "sensitive" for f in done.values())
    locked = replace(contract.with_lock(), fields=done, sensitivity="sensitive" if sensitive else "public")
    return locked, new


def drop_items_on_identifiers(items: DataFrame, fields: DataFrame, refs: list[str]) -> DataFrame:
    """Charts or KPIs that reference a column which is now an identifier go away."""
    ids = fields.filter("is_identifier").select(F.col("name").alias("ref"))
    wanted = items.withColumn("refs", F.array_compact(F.array(*refs)))
    bad = wanted.select("id", F.explode("refs").alias("ref")).join(ids, "ref", "left_semi").select("id").distinct()
    return wanted.drop("refs").join(bad, "id", "left_anti")


def latest_contracts(store: DataFrame) -> DataFrame:
    """Newest version per fingerprint from an append-only contract table."""
    win = Window.partitionBy("fingerprint").orderBy(F.desc("version"), F.desc("saved_at"))
    return store.withColumn("rn", F.row_number().over(win)).filter("rn = 1").drop("rn")


def locked_hit(store: DataFrame, fingerprint: str) -> bool:
    return bool(latest_contracts(store.filter(F.col("fingerprint") == fingerprint)).filter("locked").head(1))


def role_overrides_allowed(roled: DataFrame, suggestions: DataFrame, id_name: str) -> DataFrame:
    """Outside role suggestions (name, role) with the guard applied: a key stays a key.

    A suggestion is refused when it would un-identify a column that is over 90 % unique or has an
    id-like name.
    """
    s = suggestions.select("name", F.lower(F.trim("role")).alias("suggested"))
    valid = F.col("suggested").isin("boolean", "datetime", "numeric", "identifier", "categorical", "text")
    unique = F.col("unique_count") / F.greatest(F.col("n_rows"), F.lit(1))
    guarded = (F.col("role") == "identifier") & (F.col("suggested") != "identifier") & ((unique > 0.9) | F.col("name").rlike(id_name))
    joined = roled.join(s, "name", "left")
    take = F.coalesce(valid & (F.col("suggested") != F.col("role")) & ~guarded, F.lit(False))
    marked = joined.withColumn("changed", take).withColumn("old_role", F.col("role"))
    return marked.withColumn("role", F.when(F.col("changed"), F.col("suggested")).otherwise(F.col("role"))).drop("suggested")


# Fixed value: names that mark a key column in role arbitration.
KEY_NAME = r"(?i)(?:^|_)(id|uuid|guid|nhs|ssn|number|num|no|code|key|ref|account|acct|iban|mrn|index)(?:_|$)"


def role_candidates(roled: DataFrame) -> DataFrame:
    """Columns whose role is worth a second look, first 25 in column order."""
    test = (
        F.col("role").isin("identifier", "text")
        | F.array_contains("semantic_tags", "ambiguous_date")
        | ((F.col("role") == "numeric") & (F.col("unique_count") <= 30))
    )
    return roled.filter(test).orderBy("position").limit(25)


def redact(profile: DataFrame, fields: DataFrame, stats: list[str]) -> DataFrame:
    """Profile for export: sensitive columns keep their counts, lose numbers and values."""
    flags = fields.select("name", ((F.col("sensitivity") == "sensitive") | (F.size("pii_entities") > 0)).alias("redacted"))
    out = profile.join(flags, "name", "left").withColumn("redacted", F.coalesce("redacted", F.lit(False)))
    for s in stats:
        out = out.withColumn(s, F.when(~F.col("redacted"), F.col(s)))
    empty = F.slice("top_categories", 1, 0)
    return out.withColumn("top_categories", F.when(F.col("redacted"), empty).otherwise(F.slice("top_categories", 1, 5)))


def compile_contract(df: DataFrame, roled: DataFrame, gate=None) -> tuple[Contract, DataFrame]:
    """Grain, total rows, fingerprint and field rules of a cleaned frame."""
    from tabwise.operators.clean import count_total_rows

    pii = gate.pii_columns if gate else {}
    fields_df = field_contracts(roled, pii, bool(gate and gate.sensitivity == "sensitive"))
    rows = fields_df.collect()
    fields = to_fields(rows)
    role_of = {r["name"]: r["role"] for r in roled.select("name", "role").collect()}
    dims = [c for c in fields if role_of[c] in ("identifier", "categorical", "datetime", "year")]
    labels = [c for c in fields if role_of[c] in ("categorical", "text", "identifier")]
    totals = count_total_rows(df, labels).first()[0] if labels else 0
    spark: SparkSession = df.sparkSession
    plain = spark.createDataFrame([(f, fields[f].dtype, role_of[f]) for f in fields], "name string, dtype string, role string")
    return (
        Contract(
            schema_fingerprint(plain).first()[0], 1, False, df.count(), len(df.columns), detect_grain(df, dims), totals,
            gate.sensitivity if gate else "public", bool(gate and gate.pii_blocked), fields,
        ),
        fields_df,
    )
