"""Readers for message files, Parquet sets, cable points and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatrack import schema as S
from seatrack.operators.clean import dedup_on_key


def parse_time(text: Column) -> Column:
    """``dd/MM/yyyy HH:mm:ss`` as a timestamp; NULL when it does not parse."""
    return F.try_to_timestamp(text, F.lit(S.TIME_FORMAT))


def read_inferred(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV with header and inferred types; the time column renamed and parsed."""
    df = spark.read.csv(path if isinstance(path, str) else list(path), header=True, inferSchema=True)
    if S.TIME_HEADER in df.columns:
        df = df.withColumnRenamed(S.TIME_HEADER, "Timestamp")
        if isinstance(df.schema["Timestamp"].dataType, T.StringType):
            df = df.withColumn("Timestamp", parse_time(F.col("Timestamp")))
    return df


def read_messages(spark: SparkSession, path: str | Sequence[str], dedup: bool = True) -> DataFrame:
    """Labelled message files with the fixed schema, all files in one scan.

    Adds ``ts``, ``epoch`` and ``file_date`` (from the file name, NULL if it has none). One message is
    kept per file date, vessel and time.
    """
    raw = spark.read.schema(S.MESSAGE_FILE).option("header", True).csv(path if isinstance(path, str) else list(path))
    d = raw.withColumn("file_date", file_date(F.col("_metadata.file_name")))
    d = d.withColumn("ts", parse_time(F.col(f"`{S.TIME_HEADER}`"))).drop(S.TIME_HEADER)
    d = d.withColumn("epoch", F.unix_timestamp("ts")).withColumnsRenamed(S.RENAMES)
    if not dedup:
        return d
    rest = [c for c in d.columns if c not in ("file_date", "mmsi", "ts")]
    return dedup_on_key(d, ["file_date", "mmsi", "ts"], rest)


def file_date(name: Column) -> Column:
    """Date in a name like ``aisdk-2025-01-31...csv``; NULL for other names."""
    text = F.regexp_extract(name, r"^aisdk-(\d{4}-\d{2}-\d{2}).*\.csv$", 1)
    return F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def read_plain_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with header; an unnamed index column ``_c0`` is dropped."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path if isinstance(path, str) else list(path))
    return df.drop("_c0")


def read_prepared(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several prepared Parquet folders as one table."""
    return spark.read.parquet(*paths)


def read_recursive(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every Parquet file below ``path`` with an imposed schema."""
    return spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(path)


def read_xy(spark: SparkSession, paths: Sequence[str], features: Sequence[str], targets: Sequence[str] = (),
            key: Sequence[str] = ("mmsi", "timestamp_epoch")) -> tuple[DataFrame, DataFrame | None]:
    """Features and targets of Parquet sets; the key columns stay, as a table has no row order."""
    df = spark.read.parquet(*paths)
    x = df.select(*dict.fromkeys([*key, *features]))
    y = df.select(*dict.fromkeys([*key, *targets])) if targets else None
    return x, y


def cable_points(df: DataFrame) -> DataFrame:
    """``Cable, Point, Latitude, Longitude`` rows with an explicit ``point_no``: Start, Bend_1, ..., End.

    The end comes after the last bend whatever its number; any other point name fails, as its place is unknown.
    """
    bend = F.expr("try_cast(regexp_extract(`Point`, '^Bend_([0-9]+)$', 1) AS INT)")
    last = F.coalesce(F.max(bend).over(Window.partitionBy("Cable")), F.lit(0)) + 1
    unknown = F.raise_error(F.concat(F.lit("unknown cable point: "), F.coalesce("Point", F.lit("NULL")))).cast("int")
    no = F.when(F.col("Point") == "Start", 0).when(F.col("Point") == "End", last).when(bend.isNotNull(), bend).otherwise(unknown)
    return df.select(
        F.col("Cable").alias("cable"), no.alias("point_no"),
        F.col("Latitude").cast("double").alias("latitude"), F.col("Longitude").cast("double").alias("longitude"),
    )


def read_cables(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(
        [T.StructField("Cable", T.StringType()), T.StructField("Point", T.StringType()),
         T.StructField("Latitude", T.DoubleType()), T.StructField("Longitude", T.DoubleType())]
    )
    return cable_points(spark.read.schema(schema).option("header", True).csv(path))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics written by :func:`seatrack.sources.writers.write_stats`: ``(feature, mean, std)``."""
    return spark.read.schema("feature string, mean double, std double").json(path)


def read_stats_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document ``{feature: {"mean": m, "std": s}}`` as ``(feature, mean, std)`` rows."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,struct<mean:double,std:double>>")
    return text.select(F.explode(parsed).alias("feature", "_s")).select("feature", "_s.mean", "_s.std")


def assign_files(names: DataFrame, train: tuple[Sequence[int], Sequence[int]], test: tuple[Sequence[int], Sequence[int]],
                 column: str = "file_name") -> DataFrame:
    """``split`` of dated files by year set x month set; train wins, other or undated files are left out."""
    d = names.withColumn("file_date", file_date(F.col(column)))

    def chosen(sets: tuple[Sequence[int], Sequence[int]]) -> Column:
        return F.year("file_date").isin(list(sets[0])) & F.month("file_date").isin(list(sets[1]))

    split = F.when(chosen(train), "train").when(chosen(test), "test")
    return d.withColumn("split", split).where(F.col("split").isNotNull())


def next_version(versions: DataFrame, column: str = "version") -> DataFrame:
    """Next ``vN`` after the versions present."""
    no = F.max(F.expr(f"try_cast(regexp_extract({column}, '^v([0-9]+)$', 1) AS INT)"))
    return versions.agg(F.concat(F.lit("v"), (F.coalesce(no, F.lit(0)) + 1).cast("string")).alias("next_version"))


def missing_days(loaded: DataFrame, start: Column, end: Column, column: str = "day") -> DataFrame:
    """Days from ``start`` to ``end`` that are not among the loaded ones."""
    span = loaded.agg(start.cast("date").alias("_a"), end.cast("date").alias("_b"))
    days = span.select(F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(column))
    return days.join(loaded.select(F.col(column).cast("date").alias(column)), column, "left_anti")
