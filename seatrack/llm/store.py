"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where that is unset, local sessions get a temporary folder; a cluster has to name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when they end: nobody reads them after the table is written."""
    before = spark.conf.get(CLEANUP, None)
    if before is not None:  # known to this Spark
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once, go on from the written table: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    with _tidy(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stage` whose readers have all been written; anything else stays."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            fs, inner = pafs.FileSystem.from_uri(path)
            fs.delete_dir(inner)


def hash_cut(n: int, limit: int) -> int:
    """The 64-bit hash that about ``limit`` of ``n`` evenly hashed rows don't exceed, with room for chance.

    Rows above it leave before the ``limit`` smallest are gathered, so what meets there doesn't grow with the
    number of tasks.
    """
    share = min(1.0, (limit + 6 * limit ** 0.5 + 10) / max(n, 1))
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
