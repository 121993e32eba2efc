"""Ordered per-key computations that split long keys over many tasks.

A window partitioned by a key alone puts the whole history of that key into one task. The functions
here partition by ``(key, chunk of time)`` or ``(key, block of rows)`` instead, so a key that holds a
third of all rows is spread over as many tasks as it has chunks:

* what one chunk must know about the others (row offset, last and next known value) is a small
  per-chunk summary; it is folded over the chunks of the key and joined back;
* fixed frames (n rows or n seconds around a row) get copies of the rows near the block border.

With ``chunk_s=None`` a track uses plain windows per key, for data known to have short histories.
Key and order columns must not be NULL; the order column holds epoch seconds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DAY = 86_400
BLOCK_ROWS = 20_000


@dataclass(frozen=True)
class Track:
    """How a table is keyed and ordered."""

    key: tuple[str, ...] = ("mmsi",)
    order: str = "epoch"
    tie: tuple[str, ...] = ()
    chunk_s: int | None = DAY

    def asc(self) -> list[Column]:
        return [F.col(c).asc() for c in (self.order, *self.tie)]

    def desc(self) -> list[Column]:
        return [F.col(c).desc() for c in (self.order, *self.tie)]

    def chunk(self) -> Column:
        if self.chunk_s is None:
            return F.lit(0).cast("bigint")
        return F.floor(F.col(self.order) / self.chunk_s)

    @property
    def parts(self) -> list[str]:
        return [*self.key, "_chunk"]

    def with_key(self, *key: str) -> Track:
        return Track(tuple(key), self.order, self.tie, self.chunk_s)

    def without_tie(self) -> Track:
        return Track(self.key, self.order, (), self.chunk_s)


def _local(parts: Sequence[str], order: Sequence[Column]) -> WindowSpec:
    return Window.partitionBy(*parts).orderBy(*order)


def _earlier(key: Sequence[str], chunk: str = "_chunk") -> WindowSpec:
    return Window.partitionBy(*key).orderBy(F.col(chunk).asc()).rowsBetween(Window.unboundedPreceding, -1)


def _later(key: Sequence[str], chunk: str = "_chunk") -> WindowSpec:
    return Window.partitionBy(*key).orderBy(F.col(chunk).desc()).rowsBetween(Window.unboundedPreceding, -1)


def join_per_key(
    df: DataFrame, table: DataFrame, track: Track, how: str = "left", chunks_of: DataFrame | None = None
) -> DataFrame:
    """Join a table of one row per key on (key, chunk), so that a key with very many rows is spread over its chunks.

    The rows of the table are first repeated for every chunk that the key has in ``chunks_of`` (by default ``df``; any
    table that holds its chunks will do). A join on the key alone would leave the rows dealt by key, and Spark would
    run windows and aggregates over (key, chunk) or (key, slot) on that partitioning.
    """
    if track.chunk_s is None:
        return df.join(table, list(track.key), how)
    source = df if chunks_of is None else chunks_of
    chunk = F.coalesce(track.chunk(), F.lit(0))
    chunks = source.select(*track.key, chunk.alias("_chunk")).distinct()
    spread = chunks.join(table, list(track.key), "inner")
    return df.withColumn("_chunk", chunk).join(spread, track.parts, how).drop("_chunk")


def key_values(df: DataFrame, track: Track, **values: tuple[str, Column]) -> DataFrame:
    """Values over all rows of a key, one row per (key, chunk): ``name=("min" | "max" | "sum", expression)``.

    Every chunk is summed up first; the summaries of a key are few and are folded over its chunks.
    """
    fold = {"min": F.min, "max": F.max, "sum": F.sum}
    per = df.withColumn("_chunk", track.chunk()).groupBy(*track.parts).agg(*[fold[kind](e).alias(n) for n, (kind, e) in values.items()])
    whole = Window.partitionBy(*track.key)
    return per.select(*track.parts, *[fold[kind](n).over(whole).alias(n) for n, (kind, _) in values.items()])


def join_key_values(df: DataFrame, values: DataFrame, track: Track, how: str = "left") -> DataFrame:
    """Join the result of :func:`key_values`."""
    return df.withColumn("_chunk", track.chunk()).join(values, track.parts, how).drop("_chunk")


def row_numbers(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[Column],
    chunk: Column | None,
    name: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """Row number (from 1) within ``key``; ``chunk`` must not decrease along ``order``."""
    key = list(key)
    if chunk is None:
        out = df.withColumn(name, F.row_number().over(_local(key, order)).cast("bigint"))
        return out.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*key))) if total else out
    parts = [*key, "_chunk"]
    d = df.withColumn("_chunk", chunk)
    sums = [F.coalesce(F.sum("_n").over(_earlier(key)), F.lit(0)).alias("_off")]
    if total:
        sums.append(F.sum("_n").over(Window.partitionBy(*key)).alias(total))
    offsets = d.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n")).select(*parts, *sums)
    return (
        d.join(offsets, parts, "left")
        .withColumn(name, F.col("_off") + F.row_number().over(_local(parts, order)))
        .drop("_chunk", "_off")
    )


def track_row_numbers(df: DataFrame, track: Track, name: str = "rn", total: str | None = None) -> DataFrame:
    chunk = None if track.chunk_s is None else track.chunk()
    return row_numbers(df, track.key, track.asc(), chunk, name, total)


def row_blocks(
    df: DataFrame, key: Sequence[str], rn: str, before: int, after: int, size: int = BLOCK_ROWS
) -> tuple[DataFrame, WindowSpec]:
    """Blocks of ``size`` consecutive rows plus the neighbours their frames reach into.

    Returns the rows with ``_core`` (false for the copies) and the window specification whose frames
    of at most ``before`` rows back and ``after`` rows ahead are complete for every core row.
    """
    size = max(size, 4 * (before + after))
    first = F.greatest(F.floor((F.col(rn) - 1 - after) / size), F.lit(0))
    last = F.floor((F.col(rn) - 1 + before) / size)
    own = F.floor((F.col(rn) - 1) / size)
    out = df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn(
        "_core", F.col("_block") == own
    )
    return out, Window.partitionBy(*key, "_block").orderBy(rn)


def framed(
    df: DataFrame, track: Track, before: int, after: int, total: str | None = None, size: int = BLOCK_ROWS
) -> tuple[DataFrame, WindowSpec]:
    """Row numbers, then :func:`row_blocks`; finish with :func:`core_rows`."""
    d = track_row_numbers(df, track, "_rn", total)
    if track.chunk_s is None:
        return d.withColumn("_core", F.lit(True)).withColumn("_block", F.lit(0)), Window.partitionBy(
            *track.key
        ).orderBy("_rn")
    return row_blocks(d, track.key, "_rn", before, after, size)


def core_rows(df: DataFrame, *drop: str) -> DataFrame:
    return df.where("_core").drop("_core", "_block", "_rn", *drop)


def time_blocks(df: DataFrame, track: Track, before_s: int, after_s: int) -> tuple[DataFrame, WindowSpec]:
    """Time chunks plus copies of the rows within ``before_s`` / ``after_s`` of their border."""
    if track.chunk_s is None:
        return df.withColumn("_core", F.lit(True)).withColumn("_block", F.lit(0)), _local(track.key, track.asc())
    size = max(track.chunk_s, 4 * (before_s + after_s))
    t = F.col(track.order)
    out = df.withColumn(
        "_block",
        F.explode(F.sequence(F.floor((t - after_s) / size), F.floor((t + before_s) / size))),
    ).withColumn("_core", F.col("_block") == F.floor(t / size))
    return out, _local([*track.key, "_block"], track.asc())


def known_neighbours(
    df: DataFrame,
    track: Track,
    columns: Sequence[str],
    position: str = "time",
    ahead: bool = True,
    own_ahead: bool = True,
    next_name: str | None = None,
    last_name: str | None = None,
) -> DataFrame:
    """Last and next known value of each column, seen from every row (the row itself included).

    Adds ``{c}__pv`` / ``{c}__pp`` (value and position of the last known one), with ``ahead`` also
    ``{c}__nv`` / ``{c}__np``, and ``_pos``, the position of the row: its time or its row number.
    The next known value is read over the reversed order, never over an unbounded following frame.
    ``own_ahead=False`` looks for the next value only after the row; ``next_name`` also adds the time
    of the row after, ``last_name`` the time of the last row of the key.
    """
    key, parts = list(track.key), track.parts
    d = df.withColumn("_chunk", track.chunk())
    if position == "row":
        d = d.withColumn("_pos", F.row_number().over(_local(parts, track.asc())).cast("bigint"))
    else:
        d = d.withColumn("_pos", F.col(track.order))
    here = {c: F.when(F.col(c).isNotNull(), F.col("_pos")) for c in columns}

    offset = F.lit(0)
    if track.chunk_s is not None:
        aggs = [F.count(F.lit(1)).alias("_n")]
        # Rows of one time are told apart by the tie, as in the windows below.
        rank = F.struct("_pos", *track.tie) if track.tie and position != "row" else F.col("_pos")
        for c in columns:
            known = F.when(F.col(c).isNotNull(), rank)
            aggs += [F.max_by(c, known).alias(f"{c}__pv"), F.max(here[c]).alias(f"{c}__pp")]
            if ahead:
                aggs += [F.min_by(c, known).alias(f"{c}__nv"), F.min(here[c]).alias(f"{c}__np")]
        if next_name:
            aggs.append(F.min(track.order).alias("_first"))
        if last_name:
            aggs.append(F.max(track.order).alias("_top"))
        per = d.groupBy(*parts).agg(*aggs)
        per = per.withColumn("_off", F.coalesce(F.sum("_n").over(_earlier(key)), F.lit(0)))
        shift = F.col("_off") if position == "row" else F.lit(0)
        carry = [F.col("_off")]
        if next_name:
            carry.append(F.lead("_first").over(Window.partitionBy(*key).orderBy("_chunk")).alias("_after"))
        if last_name:
            carry.append(F.max("_top").over(Window.partitionBy(*key)).alias(last_name))
        for c in columns:
            carry += [
                F.last(f"{c}__pv", True).over(_earlier(key)).alias(f"{c}__cpv"),
                F.last(shift + F.col(f"{c}__pp"), True).over(_earlier(key)).alias(f"{c}__cpp"),
            ]
            if ahead:
                carry += [
                    F.last(f"{c}__nv", True).over(_later(key)).alias(f"{c}__cnv"),
                    F.last(shift + F.col(f"{c}__np"), True).over(_later(key)).alias(f"{c}__cnp"),
                ]
        d = d.join(per.select(*parts, *carry), parts, "left")
        offset = shift

    back = _local(parts, track.asc()).rowsBetween(Window.unboundedPreceding, 0)
    fore = _local(parts, track.desc()).rowsBetween(Window.unboundedPreceding, 0 if own_ahead else -1)
    added: dict[str, Column] = {}
    if next_name:
        added[next_name] = F.lead(track.order).over(_local(parts, track.asc()))
    if last_name and track.chunk_s is None:
        added[last_name] = F.max(track.order).over(Window.partitionBy(*key))
    for c in columns:
        added[f"{c}__pv"] = F.last(c, True).over(back)
        added[f"{c}__pp"] = F.last(here[c], True).over(back) + offset
        if ahead:
            added[f"{c}__nv"] = F.last(c, True).over(fore)
            added[f"{c}__np"] = F.last(here[c], True).over(fore) + offset
    d = d.withColumns(added)
    if track.chunk_s is None:
        return d.drop("_chunk")
    ends = ["pv", "pp", "nv", "np"] if ahead else ["pv", "pp"]
    filled = {f"{c}__{e}": F.coalesce(f"{c}__{e}", f"{c}__c{e}") for c in columns for e in ends}
    filled["_pos"] = F.col("_pos") + offset
    if next_name:
        filled[next_name] = F.coalesce(next_name, "_after")
    return d.withColumns(filled).drop("_chunk", "_off", "_after", *[f"{c}__c{e}" for c in columns for e in ends])


def drop_neighbours(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop("_pos", *[f"{c}__{e}" for c in columns for e in ("pv", "pp", "nv", "np")])


def previous_time(df: DataFrame, track: Track, name: str = "prev_epoch") -> DataFrame:
    """Order value of the row before."""
    return _adjacent(df, track, name, ahead=False)


def next_time(df: DataFrame, track: Track, name: str = "next_epoch") -> DataFrame:
    """Order value of the row after."""
    return _adjacent(df, track, name, ahead=True)


def _adjacent(df: DataFrame, track: Track, name: str, ahead: bool) -> DataFrame:
    key, parts, t = list(track.key), track.parts, F.col(track.order)
    step = F.lead if ahead else F.lag
    if track.chunk_s is None:
        return df.withColumn(name, step(t).over(_local(key, track.asc())))
    d = df.withColumn("_chunk", track.chunk())
    edge = (F.min if ahead else F.max)(t).alias("_edge")
    over_chunks = Window.partitionBy(*key).orderBy("_chunk")
    carry = d.groupBy(*parts).agg(edge).select(*parts, step("_edge").over(over_chunks).alias("_carry"))
    return (
        d.join(carry, parts, "left")
        .withColumn(name, F.coalesce(step(t).over(_local(parts, track.asc())), F.col("_carry")))
        .drop("_chunk", "_carry")
    )


def running_count(df: DataFrame, track: Track, flag: str, name: str) -> DataFrame:
    """Running sum of the 0/1 column ``flag`` up to and including the row."""
    key, parts = list(track.key), track.parts
    frame = (Window.unboundedPreceding, 0)
    if track.chunk_s is None:
        return df.withColumn(name, F.sum(flag).over(_local(key, track.asc()).rowsBetween(*frame)))
    d = df.withColumn("_chunk", track.chunk())
    offsets = d.groupBy(*parts).agg(F.sum(flag).alias("_n")).select(
        *parts, F.coalesce(F.sum("_n").over(_earlier(key)), F.lit(0)).alias("_off")
    )
    return (
        d.join(offsets, parts, "left")
        .withColumn(name, F.col("_off") + F.sum(flag).over(_local(parts, track.asc()).rowsBetween(*frame)))
        .drop("_chunk", "_off")
    )
