"""Staged tables and spreading of small inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_local_root: list[str] = []


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder; elsewhere executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="staged-"))
    return _local_root[0]


def _session_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/staged/{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_staged(spark: SparkSession) -> None:
    """Delete this application's staged tables; frames read from them become unusable."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str, schema: StructType | None = None, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor re-reads files instead of repeating the
    upstream work, and lets every later pass read only the columns it needs.
    ``schema`` may name a logical type for a column's stored form, ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-distribute an input with fewer than two splits per core.

    Such an input may leave cores idle, as a split need not hold a row group.  A
    table of many files fills the cluster by itself and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores, key)


@contextmanager
def _set(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def batches_of(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Jobs that run inside send tasks' Python workers so many rows at once, for rows that are wide."""
    return _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def batches_up_to(spark: SparkSession, n_bytes: int) -> AbstractContextManager[None]:
    """Jobs that run inside send tasks' Python workers rows of about so many bytes at once, for rows of unlike widths."""
    return _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", n_bytes)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files when they end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
