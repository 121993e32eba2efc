"""Sinks: partitioned CSV and Parquet, training export, statistics and results as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatrack import schema as S
from seatrack.operators.series import wide_future


def write_labelled_csv(df: DataFrame, path: str, by: str = "file_date", single_file: bool = False) -> None:
    """Labelled messages, one folder per file date. ``single_file`` asks for one file per date."""
    d = df.repartition(by) if single_file else df
    d.write.mode("overwrite").option("header", True).partitionBy(by).csv(path)


def write_prepared(df: DataFrame, path: str, by: str = "file_date") -> None:
    """Prepared data as Parquet; only the dates present in ``df`` are replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(by) if by in df.columns else writer).parquet(path)


def training_columns(df: DataFrame, horizon: int = 0) -> DataFrame:
    """Declared export types of the columns that exist, then the widened future positions."""
    d = df.withColumnRenamed("epoch", "timestamp_epoch") if "timestamp_epoch" not in df.columns else df
    base = [F.col(c).cast(t).alias(c) for c, t in S.EXPORT_TYPES.items() if c in d.columns]
    if not horizon:
        return d.select(*base)
    return wide_future(d.select(*base, "future"), horizon, cast="float")


def export_metadata(exported: DataFrame, version: str, mode: str, sources: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """One row about an export: rows, vessels, columns, schema, time of creation, source folders, output path
    and the number of partitions it is read in."""
    return exported.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("mmsi").alias("vessels"),
    ).select(
        F.lit(version).alias("version"), F.lit(mode).alias("mode"), "rows", "vessels",
        F.lit(len(exported.columns)).alias("columns"), F.lit(exported.schema.simpleString()).alias("schema"),
        F.current_timestamp().alias("created"), F.lit(list(sources)).cast("array<string>").alias("sources"), F.lit(path).alias("path"),
        F.lit(exported.rdd.getNumPartitions()).alias("partitions"),
    )


def write_training_set(df: DataFrame, path: str, version: str, mode: str = "train", horizon: int = 0,
                       sources: Sequence[str] = ()) -> None:
    """Export as Parquet grouped by vessel, with a metadata row beside it.

    Rows are spread by vessel and day, so a busy vessel takes as many tasks as it has days.
    """
    out = training_columns(df, horizon)
    spread = out.repartition("mmsi", F.floor(F.col("timestamp_epoch") / 86_400))
    target = f"{path}/{mode}/{version}"
    spread.sortWithinPartitions("mmsi", "timestamp_epoch").write.mode("overwrite").parquet(f"{target}/data")
    written = df.sparkSession.read.parquet(f"{target}/data")
    export_metadata(written, version, mode, sources, target).write.mode("overwrite").json(f"{target}/metadata")


def write_stats(stats: DataFrame, path: str) -> None:
    """``(feature, mean, std)`` rows as JSON lines; a handful of rows, hence one file."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def results_json(results: DataFrame, columns: Sequence[str] | None = None, name: str = "json") -> DataFrame:
    """Each result as one nested JSON document."""
    return results.select(F.to_json(F.struct(*(columns or results.columns))).alias(name))


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def first_valid_windows(windows: DataFrame, key: str = "mmsi", start: str = "window_start", reason: str = "reason",
                        window: str = "window") -> DataFrame:
    """First valid window of each vessel as a JSON list of its records."""
    ok = windows.where(F.col(reason) == "ok")
    first = ok.groupBy(key).agg(F.min(start).alias(start))
    return ok.join(first, [key, start], "left_semi").select(key, start, F.to_json(window).alias("json"))
