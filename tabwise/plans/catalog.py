"""Registry of named queries over the star-schema tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.operators import contract as ct
from tabwise.operators import roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_CONTRACTS: dict[tuple[str, str], ct.Contract] = {}
_PROFILES: dict[tuple[str, str], DataFrame] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles rounded for comparison: summation order differs between engines in the last bits."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def profile_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Roled profile of a table as stored: one row per column, worked out once per session and folder."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{table}")
    if key not in _PROFILES:
        _PROFILES[key] = roles.classify(load(spark, sf_dir, table))
    return _PROFILES[key]


def fields_of(spark: SparkSession, sf_dir: str, table: str) -> ct.Contract:
    """Contract of a table as stored (no cleaning), worked out once per session and folder."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{table}")
    if key not in _CONTRACTS:
        rows = ct.field_contracts(profile_of(spark, sf_dir, table)).collect()
        _CONTRACTS[key] = ct.Contract("", fields=ct.to_fields(rows))
    return _CONTRACTS[key]


def union_all(parts) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def sql_union(parts) -> str:
    return "\nUNION ALL\n".join(parts)
