"""Shared folders for written intermediate tables and checkpoints.

The folder comes from ``spark.checkpoint.dir``. Only a local master may fall back to a fresh temporary folder, because
executors of a cluster cannot read the driver's disk.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors can reach")
    root = tempfile.mkdtemp(prefix="alertlake-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/alertlake/{label}-{uuid.uuid4().hex}"


def read_or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema) -> DataFrame:
    """What ``read`` gives, or an empty frame if its path doesn't exist yet. Any other trouble is an error."""
    try:
        return read()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile drop their shuffle files when they are done, and not when the driver's garbage is collected."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


def store(df: DataFrame, label: str, large_rows: bool = False, tidy: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: a lineage cut that survives the loss of executors.

    ``large_rows`` are rows of megabytes. A writer looks at its size only every 100 rows, and a reader takes a row group's rows at once, up to
    4096 of them, so each such row gets a row group of its own. ``tidy`` drops the shuffle files once the table is there.
    """
    path = new_folder(df.sparkSession, label)
    writer = df.write.options(**{"parquet.block.row.count.limit": "1", "compression": "zstd"}) if large_rows else df.write
    if tidy:
        with shuffles_dropped(df.sparkSession):
            writer.parquet(path)
    else:
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
