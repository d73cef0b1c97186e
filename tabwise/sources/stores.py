"""Parquet-backed stores: cleaned frames by fingerprint, analyses with append-only history."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwise.operators import contract


class FrameStore:
    """Cleaned frames under ``root/fingerprint=<fp>``, readable until their age passes the TTL."""

    def __init__(self, spark: SparkSession, root: str, ttl_seconds: int = 3600):
        self.spark, self.root, self.ttl = spark, root.rstrip("/"), ttl_seconds

    def _path(self, fingerprint: str) -> str:
        return f"{self.root}/frames/fingerprint={fingerprint}"

    def put(self, fingerprint: str, df: DataFrame, now: float) -> None:
        df.write.mode("overwrite").parquet(self._path(fingerprint))
        stamp = self.spark.createDataFrame([(fingerprint, float(now))], "fingerprint string, saved_at double")
        stamp.coalesce(1).write.mode("append").parquet(f"{self.root}/index")

    def get(self, fingerprint: str, now: float) -> DataFrame | None:
        try:
            saved = self.spark.read.parquet(f"{self.root}/index").filter(F.col("fingerprint") == fingerprint).agg(F.max("saved_at")).first()[0]
        except Exception:
            return None
        if saved is None or saved + self.ttl <= now:
            return None
        return self.spark.read.parquet(self._path(fingerprint))


def latest_per_key(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Upsert view of an append-only table: the newest row of every key.

    A max over (order, row) pre-aggregates in every task, so a key with very many versions stays cheap.
    """
    rest = [c for c in records.columns if c != key]
    newest = records.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return newest.select(key, "r.*").select(*records.columns)


def live(records: DataFrame, now, expires: str = "expires_at") -> DataFrame:
    return records.filter(F.col(expires) > F.lit(now))


def list_history(records: DataFrame, owner_col: str, owner, now, limit: int = 50) -> DataFrame:
    """Newest entries of one owner that have not expired."""
    mine = live(records.filter(F.col(owner_col) == F.lit(owner)), now)
    return mine.orderBy(F.desc("created_at"), "trace_id").limit(limit).select("trace_id", "original_filename", "created_at")


def newest_per_owner(records: DataFrame, owner_col: str, time_col: str, id_col: str, limit: int = 50) -> DataFrame:
    """The ``limit`` newest entries of every owner at once."""
    win = Window.partitionBy(owner_col).orderBy(F.desc(time_col), id_col)
    return records.withColumn("rn", F.row_number().over(win)).filter(F.col("rn") <= limit).drop("rn")


def reopen(records: DataFrame, owner_col: str, owner, trace_id, now) -> DataFrame:
    mine = records.filter((F.col(owner_col) == F.lit(owner)) & (F.col("trace_id") == F.lit(trace_id)))
    return live(mine, now).orderBy(F.desc("created_at")).limit(1)


class DashboardStore:
    """Dashboards by session (newest wins) plus history, both append-only Parquet."""

    schema = "session_key string, owner_key string, trace_id string, original_filename string, payload string, created_at timestamp, updated_at timestamp, expires_at timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/dashboards"

    def save(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def get(self, session_key: str, now) -> DataFrame:
        mine = self.all().filter(F.col("session_key") == session_key)
        return live(latest_per_key(mine, "session_key", ["updated_at", "trace_id"]), now)

    def count(self, now) -> int:
        return live(latest_per_key(self.all(), "session_key", ["updated_at", "trace_id"]), now).count()

    def purge(self, now, into: str) -> "DashboardStore":
        """Rewrite without expired rows into a new folder and go on from there."""
        other = DashboardStore(self.spark, into)
        live(self.all(), now).write.mode("overwrite").parquet(other.path)
        return other


class ContractStore:
    """Contracts by schema fingerprint, append-only; the newest version of a fingerprint counts."""

    schema = "fingerprint string, version int, locked boolean, saved_at double, payload string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/contracts"

    def all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def save(self, spec: contract.Contract, now: float) -> None:
        row = (spec.schema_fingerprint, spec.version, spec.locked, float(now), json.dumps(asdict(spec)))
        self.spark.createDataFrame([row], self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def locked(self, fingerprint: str) -> contract.Contract | None:
        """The newest contract of the fingerprint, if it is locked."""
        store = self.all()
        if not contract.locked_hit(store, fingerprint):
            return None
        row = contract.latest_contracts(store.filter(F.col("fingerprint") == fingerprint)).first()
        kept = json.loads(row["payload"])
        fields = {n: contract.Field(**{k: tuple(v) if isinstance(v, list) else v for k, v in f.items()}) for n, f in kept.pop("fields").items()}
        return contract.Contract(**{**kept, "grain": tuple(kept["grain"])}, fields=fields)
