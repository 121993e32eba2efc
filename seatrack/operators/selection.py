"""Seeded, reproducible selection of an exact number of rows without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 4  # hexadecimal digits of the histogram: 65,536 buckets


def row_hash(seed: int | str, *columns: str) -> Column:
    """Hexadecimal md5 of seed and key columns, the same text in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def hash_number(hashed: Column, digits: int = 15) -> Column:
    """Leading hexadecimal digits of a hash as a whole number."""
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("bigint")


def hash_cuts(
    df: DataFrame, by: Sequence[str], hashed: str, wanted: dict[str, Column], prefix: int = PREFIX, few: bool = False
) -> DataFrame:
    """For each group the hash up to which exactly ``wanted[name]`` rows lie, as column ``name``.

    ``wanted`` maps names to expressions over ``n``, the row count of the group (columns of ``by``
    may be used). A cut is NULL where nothing is wanted. Hashes must be distinct within a group.
    Only the bucket of each cut is ranked: about n / 16**prefix rows of a group.

    With ``few`` groups (classes, columns) or none the cut buckets are broadcast. Otherwise the join is a merge join: Spark judges the
    hashes by the size of compressed files, where md5 texts do not count, and would send them all through the driver.
    """
    by = list(by)
    d = df.select(*by, F.col(hashed).alias("_h")).withColumn("_b", F.substring("_h", 1, prefix))
    hist = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_k"))
    whole = Window.partitionBy(*by)
    hist = hist.withColumn("n", F.sum("_k").over(whole)).withColumn(
        "_upto", F.sum("_k").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    )
    goals = F.array(*[F.struct(F.lit(n).alias("name"), e.cast("bigint").alias("m")) for n, e in wanted.items()])
    cut_buckets = (
        hist.withColumn("_g", F.explode(goals))
        .where((F.col("_upto") >= F.col("_g.m")) & (F.col("_upto") - F.col("_k") < F.col("_g.m")))
        .select(*by, "_b", F.col("_g.name").alias("_name"),
                (F.col("_g.m") - F.col("_upto") + F.col("_k")).alias("_need"))
    )
    left, right = d.alias("l"), cut_buckets.hint("broadcast" if few or not by else "merge").alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] + [F.col("l._b") == F.col("r._b")]
    inside = left.join(right, on, "inner").select(*[F.col(f"l.{c}") for c in by], "l._h", "r._b", "r._name", "r._need")
    ranked = inside.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*by, "_name", "_b").orderBy("_h"))
    ).where(F.col("_r") == F.col("_need"))
    return ranked.groupBy(*by).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_h"))).alias(n) for n in wanted]
    )


def single_row(df: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery."""
    return df.select(F.struct(*df.columns).alias("_row")).scalar()
