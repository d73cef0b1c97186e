"""Helpers the operators share: reading, Arrow maps that add columns, intervals."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

CHUNK = 256  # texts shown to a function at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def add_columns(df: DataFrame, source: str, make, ddl: str, drop_source: bool = True) -> DataFrame:
    """``df`` with further columns worked out from the bytes of its ``source`` text, batch by batch.

    ``make()`` runs once per task and returns a function from one text (bytes; null: None) to a tuple of the values
    that ``ddl`` names. If that function has an attribute ``prepare``, it is shown ``CHUNK`` texts at a time before
    they are asked for one by one.
    """
    fields = T.StructType.fromDDL(ddl).fields
    kept = [f for f in df.schema.fields if not (drop_source and f.name == source)]
    schema = T.StructType(kept + fields)
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    kept_names = [f.name for f in kept]

    def run(batches):
        one = make()
        for batch in batches:
            rows = [row for _, row in _each(one, batch.column("__bytes").to_pylist())]
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept_names] + [pa.array(c, t) for c, t in zip(columns, types)], names=kept_names + names
            )

    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(source).cast("binary").alias("__bytes")).mapInArrow(run, schema)


def _each(one, texts: list):
    """(position, result) of each text, chunks of them shown to ``one.prepare`` first."""
    prepare = getattr(one, "prepare", None)
    for at in range(0, len(texts), CHUNK):
        part = texts[at : at + CHUNK]
        if prepare:
            prepare(part)
        for i, x in enumerate(part, at):
            yield i, one(x)


def explode_rows(df: DataFrame, keep: list[str], source: str, make, ddl: str, batch_rows: int = 50_000) -> DataFrame:
    """Like ``add_columns`` for functions that return any number of rows per text; only ``keep`` is carried along."""
    fields = T.StructType.fromDDL(ddl).fields
    schema = T.StructType([df.schema[k] for k in keep] + fields)
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        one = make()
        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []

            def ready():
                cols = [batch.column(k).take(pa.array(at, pa.int64())) for k in keep]
                return pa.RecordBatch.from_arrays(cols + [pa.array(c, t) for c, t in zip(zip(*out), types)], names=keep + names)

            for i, rows in _each(one, batch.column("__bytes").to_pylist()):
                out += rows
                at += [i] * len(rows)
                if len(out) >= batch_rows:
                    yield ready()
                    at, out = [], []
            if out:
                yield ready()

    return df.select(*keep, F.col(source).cast("binary").alias("__bytes")).mapInArrow(run, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted half-open intervals with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
