"""Intermediate tables that cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from weakref import WeakKeyDictionary

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def staging_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="seatrack-")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and go on from the written table.

    Used where a flow reads the same intermediate result more than once: the readers get column
    pruning and filter pushdown, and nothing upstream is computed again after an executor loss.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/seatrack/{label}-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when the writes end, as nobody reads them after that."""
    before = spark.conf.get(CLEANUP, None)
    if before is not None:  # known to this Spark
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)


def release(*tables: DataFrame) -> None:
    """Delete staged tables whose readers have all been written; other frames are left alone."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            fs, inner = pafs.FileSystem.from_uri(path)
            fs.delete_dir(inner)
