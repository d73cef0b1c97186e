"""Session helpers: local builder for tests and benches, lineage cuts through the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "tabwise") -> SparkSession:
    """Small local session used by the tests and the bench; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TABWISE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a scratch one only on local masters."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="tabwise-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives executor loss, ends the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame) -> bool:
    """Whether the planner's size estimate is below 8 MB per core: stored columns open up to ten times that and more."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= 8 * 1024 * 1024 * cores


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on inputs too small to be split by the reader; larger inputs are left as they are."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if is_small(df) else df


def dealt(df: DataFrame, rows: int, task_rows: int = 100_000) -> DataFrame:
    """``df`` of more than ``task_rows`` rows in parts of about so many, one per core at least: small files hold many rows,
    and those open into wide ones. Fewer rows are left as they are."""
    if rows <= task_rows:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows)))


@contextmanager
def several_passes(df: DataFrame):
    """The frame for an algorithm that reads it several times: small ones spread and cached meanwhile."""
    if not is_small(df):
        yield df
        return
    kept = spread(df).persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def side_by_side(jobs: list, threads: int = 4) -> list:
    """Run independent driver calls (model fits, reports) at once; Spark shares the cluster among their jobs."""
    with ThreadPool(max(1, min(threads, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(lambda job: job()), jobs)
