"""Joins of messages with vessel tables, day lists, grids and split assignments.

No side is forced to be broadcast unless its size has a fixed bound; Spark broadcasts the others when
their measured size allows it and splits skewed partitions of a sort-merge join otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatrack.operators.clean import all_of
from seatrack.operators.ordered import Track, join_per_key


def join_metadata(messages: DataFrame, meta: DataFrame, key: str = "mmsi", column: str = "gear_type",
                  track: Track | None = None) -> DataFrame:
    """Left join of one gear type per vessel; a vessel listed twice does not multiply its rows.

    With ``track`` the join is on vessel and chunk, so a vessel with very many messages is spread over tasks.
    """
    unique = meta.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(column).alias(column))
    if track is None:
        return messages.drop(column).join(unique, key, "left")
    return join_per_key(messages.drop(column), unique, track.with_key(key))


def keep_listed(df: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in the list."""
    return df.join(listed.select(*on), list(on), "left_semi")


def null_profile(df: DataFrame, columns: Sequence[str], key: Sequence[str] = ("mmsi",)) -> DataFrame:
    """NULL counts per column next to the row count of each vessel, from a single aggregate."""
    return df.groupBy(*key).agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns],
        F.count(F.lit(1)).alias("row_count"),
    )


def good_vessels(profile: DataFrame, columns: Sequence[str], key: Sequence[str] = ("mmsi",)) -> DataFrame:
    return profile.where(all_of([F.col(f"{c}_nulls") < F.col("row_count") for c in columns])).select(*key)


def join_grid(grid: DataFrame, df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every grid row, with the message of the same key and time where there is one."""
    return grid.join(df, list(on), "left")


def join_split(df: DataFrame, assignment: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach the split of each key from an assignment table."""
    return df.join(assignment, list(on), "inner")
