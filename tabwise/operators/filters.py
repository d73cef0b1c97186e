"""Filter specs to Column predicates, and the small row-level helpers charts share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise import config
from tabwise.functions import text as tx

TEXT_OPS = ("eq", "neq", "in", "nin")
NUMERIC_OPS = ("gt", "gte", "lt", "lte", "between")


class SpecError(ValueError):
    """A request that names an unknown column, operator or an aggregation its column does not permit."""


def _number(value) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        raise SpecError("Numeric filter needs a numeric value.") from None


def predicate(df: DataFrame, spec: dict, known: set[str] | None = None) -> Column:
    """One filter as a predicate. Text operators compare the string form, where a missing value is a word.

    String columns keep the plain comparison, so the filter reaches the Parquet scan.
    """
    col, op, value = spec.get("column"), str(spec.get("op", "eq")).lower(), spec.get("value")
    if col not in (known if known is not None else set(df.columns)):
        raise SpecError(f"Unknown column '{col}'")
    if op in NUMERIC_OPS:
        x = tx.numeric(df, col)
        if op == "between":
            if not isinstance(value, (list, tuple)) or len(value) != 2:
                raise SpecError("'between' needs [low, high].")
            return x.between(_number(value[0]), _number(value[1]))
        v = F.lit(_number(value))
        return {"gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[op]
    if op not in TEXT_OPS:
        raise SpecError(f"Unsupported filter op '{op}'")
    values = [str(v) for v in (value if isinstance(value, (list, tuple)) else [value])]
    if op in ("eq", "neq"):
        values = [str(value)]
    plain = df.schema[col].dataType.typeName() == "string" and "None" not in values
    if plain and op in ("eq", "in"):
        return F.col(col).isin(*values) if op == "in" else F.col(col) == values[0]
    hit = tx.as_text(df, col).isin(*values)
    return hit if op in ("eq", "in") else ~hit


def apply_filters(df: DataFrame, filters: list[dict] | None, known: set[str] | None = None) -> DataFrame:
    """All filters together (AND), at most twelve."""
    if not filters:
        return df
    if len(filters) > config.INTERACT_MAX_FILTERS:
        raise SpecError(f"Too many filters ({len(filters)} > {config.INTERACT_MAX_FILTERS}).")
    return df.filter(reduce(lambda a, b: a & b, [predicate(df, f, known) for f in filters]))


def count_where(df: DataFrame, col: str, op: str, value) -> Column:
    """Aggregate counting rows by '==', '!=' (string form) or an order comparison (numeric form)."""
    if col not in df.columns:
        raise SpecError(f"Unknown column '{col}'")
    if op in ("==", "!="):
        hit = tx.as_text(df, col) == str(value)
        return F.count_if(hit if op == "==" else ~hit)
    if op not in (">", ">=", "<", "<="):
        raise SpecError(f"Unsupported operator '{op}'")
    x, v = tx.numeric(df, col), F.lit(_number(value))
    return F.count_if({">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v}[op])


def exclude_rows(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not flagged; Spark picks broadcast or shuffle from the size of ``keys``."""
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def highlight_opacity(label: Column, value: str, lit: float = 1.0, dim: float = 0.22) -> Column:
    return F.when(label.cast("string") == value, lit).otherwise(dim)


def chart_dependencies(specs: DataFrame) -> DataFrame:
    """Adds ``deps``: the columns a chart reads (an explicit depends_on wins)."""
    implied = F.array_distinct(F.array_compact(F.array("x_column", "y_column", "column")))
    explicit = F.col("depends_on") if "depends_on" in specs.columns else F.lit(None).cast("array<string>")
    return specs.withColumn("deps", F.when(F.size(explicit) > 0, explicit).otherwise(implied))


def affected_charts(specs: DataFrame, changed: list[str]) -> DataFrame:
    return chart_dependencies(specs).filter(F.arrays_overlap("deps", F.array(*[F.lit(c) for c in changed])))
