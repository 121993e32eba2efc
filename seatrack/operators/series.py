"""Tracks: gaps, trajectories, leads and lags, fills, interpolation, sequences and window features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrack import schema as S
from seatrack.functions.arrays import array_median, array_mode
from seatrack.operators.clean import any_of
from seatrack.operators.ordered import (
    Track,
    core_rows,
    drop_neighbours,
    framed,
    known_neighbours,
    previous_time,
    time_blocks,
    track_row_numbers,
)


def gap_seconds(df: DataFrame, track: Track, name: str = "gap_s") -> DataFrame:
    """Previous time and the gap to it in seconds."""
    d = previous_time(df, track, "prev_epoch")
    return d.withColumn(name, F.col(track.order) - F.col("prev_epoch"))


def trajectory_ids(df: DataFrame, track: Track, max_gap_s: int = 3600, name: str = "trajectory_no") -> DataFrame:
    """Running number of the trajectory; a gap longer than ``max_gap_s`` starts the next one.

    A chunk reports the breaks inside it and its first and last time. From these the breaks before and
    at its border follow without reading the rows of other chunks.
    """
    key, parts, t = list(track.key), track.parts, F.col(track.order)
    d = df.withColumn("_chunk", track.chunk())
    local = Window.partitionBy(*parts).orderBy(*track.asc())
    d = d.withColumn("_break", F.when(t - F.lag(t).over(local) > max_gap_s, 1).otherwise(0))
    inside = F.sum("_break").over(local.rowsBetween(Window.unboundedPreceding, 0))
    if track.chunk_s is None:
        return d.withColumn(name, inside).drop("_chunk", "_break")
    chunks = Window.partitionBy(*key).orderBy("_chunk")
    per = d.groupBy(*parts).agg(F.sum("_break").alias("_n"), F.min(t).alias("_first"), F.max(t).alias("_last"))
    per = per.withColumn("_edge", F.when(F.col("_first") - F.lag("_last").over(chunks) > max_gap_s, 1).otherwise(0))
    before = F.coalesce(F.sum(F.col("_n") + F.col("_edge")).over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*parts, (before + F.col("_edge")).alias("_off"))
    return d.join(per, parts, "left").withColumn(name, F.col("_off") + inside).drop("_chunk", "_break", "_off")


def future_positions(
    df: DataFrame, track: Track, horizon: int = 120, name: str = "future", grid_step_s: int | None = None,
    columns: Sequence[str] = ("latitude", "longitude"),
) -> DataFrame:
    """Next ``horizon`` positions as an array of structs, by row offset.

    On a complete grid (``grid_step_s``) rows and time are the same thing, so no row count is needed
    and the frame comes from time chunks: one shuffle instead of two.
    """
    if grid_step_s is None:
        d, w = framed(df, track, 0, horizon)
    else:
        d, w = time_blocks(df, track, 0, horizon * grid_step_s)
    ahead = F.collect_list(F.struct(*columns)).over(w.rowsBetween(1, horizon))
    return core_rows(d.withColumn(name, ahead))


def wide_future(df: DataFrame, horizon: int, column: str = "future", prefix: tuple[str, str] = ("future_lat_", "future_lon_"),
                cast: str = "double") -> DataFrame:
    """The future array as one column per step and coordinate."""
    flat = []
    for i in range(1, horizon + 1):
        p = F.get(F.col(column), i - 1)
        flat += [p["latitude"].cast(cast).alias(f"{prefix[0]}{i}"), p["longitude"].cast(cast).alias(f"{prefix[1]}{i}")]
    return df.select(*[c for c in df.columns if c != column], *flat)


def forecasting_target(
    df: DataFrame, track: Track, steps: int = 20, max_gap_s: int = 3600, break_on_gap: bool = False
) -> DataFrame:
    """Next ``steps`` positions; rows without a latitude at the last step go.

    With ``break_on_gap`` the leads stay within one trajectory.
    """
    if not break_on_gap:
        d = future_positions(df, track, steps)
    else:
        d = trajectory_ids(df, track, max_gap_s, "_trip")
        d = future_positions(d, track.with_key(*track.key, "_trip"), steps).drop("_trip")
    return d.where(F.get(F.col("future"), steps - 1)["latitude"].isNotNull())


def lag_columns(df: DataFrame, track: Track, columns: Sequence[str], lags: Sequence[int], drop: str = "lags") -> DataFrame:
    """``{c}_lag{n}`` for every column and lag; then drop rows with NULL lags (``lags``) or any NULL (``any``)."""
    if not lags:
        return df
    d, w = framed(df, track, max(lags), 0)
    names = {f"{c}_lag{n}": F.lag(c, n).over(w) for n in lags for c in columns}
    d = core_rows(d.withColumns(names))
    return d.na.drop(subset=list(names)) if drop == "lags" else d.na.drop()


def future_value(df: DataFrame, track: Track, columns: Sequence[str] = ("latitude", "longitude"), horizon: int = 5,
                 drop: str = "any") -> DataFrame:
    """``{c}_future{h}``: the value ``h`` rows ahead; rows with a NULL go."""
    d, w = framed(df, track, 0, horizon)
    names = {f"{c}_future{horizon}": F.lead(c, horizon).over(w) for c in columns}
    d = core_rows(d.withColumns(names))
    return d.na.drop(subset=list(names)) if drop == "targets" else d.na.drop()


# --- fills and interpolation --------------------------------------------------------------------


def on_line(c: str) -> Column:
    """Value on the straight line between the known neighbours; where both are of the row's own time, that of the one before."""
    pv, nv, pp, np_ = (F.col(f"{c}__{e}") for e in ("pv", "nv", "pp", "np"))
    return pv + (nv - pv) * F.coalesce((F.col("_pos") - pp) / F.nullif(np_ - pp, F.lit(0)), F.lit(0.0))


def interpolate(
    df: DataFrame, track: Track, columns: Sequence[str], by: str = "row", ends: str = "both"
) -> DataFrame:
    """Linear interpolation over row numbers or over time.

    ``ends``: fill NULLs outside the known values in ``both`` directions, only ``forward``, or ``none``.
    """
    d = known_neighbours(df, track, columns, position=by)
    filled = {}
    for c in columns:
        options = [F.col(c), on_line(c)]
        if ends in ("both", "forward"):
            options.append(F.col(f"{c}__pv"))
        if ends == "both":
            options.append(F.col(f"{c}__nv"))
        filled[c] = F.coalesce(*options)
    return drop_neighbours(d.withColumns(filled), columns)


def interpolate_time(df: DataFrame, track: Track, columns: Sequence[str], max_gap_s: int | None = 300) -> DataFrame:
    """Linear interpolation over time where the known neighbours are at most ``max_gap_s`` apart.

    The limit bounds how far a row must see, so chunks get copies of the rows near their border and a
    single shuffle is enough.
    """
    if max_gap_s is None:
        return interpolate(df, track, columns, by="time", ends="none")
    d, w = time_blocks(df, track, max_gap_s, max_gap_s)
    keys = [*track.key, "_block"] if track.chunk_s is not None else list(track.key)
    t = F.col(track.order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    fore = Window.partitionBy(*keys).orderBy(*track.desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = {"_pos": t}
    for c in columns:
        seen = F.when(F.col(c).isNotNull(), t)
        near |= {
            f"{c}__pv": F.last(c, True).over(back), f"{c}__pp": F.last(seen, True).over(back),
            f"{c}__nv": F.last(c, True).over(fore), f"{c}__np": F.last(seen, True).over(fore),
        }
    d = d.withColumns(near)
    filled = {
        c: F.coalesce(F.col(c), F.when(F.col(f"{c}__np") - F.col(f"{c}__pp") <= max_gap_s, on_line(c)))
        for c in columns
    }
    return core_rows(drop_neighbours(d.withColumns(filled), columns))


def forward_fill(df: DataFrame, track: Track, columns: Sequence[str]) -> DataFrame:
    """Last known value of each column."""
    d = known_neighbours(df, track, columns, ahead=False)
    return drop_neighbours(d.withColumns({c: F.col(f"{c}__pv") for c in columns}), columns)


def fill_both_ways(df: DataFrame, track: Track, columns: Sequence[str]) -> DataFrame:
    """Last known value, before the first one the next known value."""
    d = known_neighbours(df, track, columns)
    return drop_neighbours(d.withColumns({c: F.coalesce(f"{c}__pv", f"{c}__nv") for c in columns}), columns)


# --- windows of rows ----------------------------------------------------------------------------


def sliding_windows(
    df: DataFrame, track: Track, columns: Sequence[str], size: int, step: int, ahead: int = 0, name: str = "window"
) -> DataFrame:
    """Full windows of ``size`` rows starting at rows 0, step, 2*step, ...: ``window_no`` and the rows."""
    d, w = framed(df, track, 0, size + ahead)
    frame = w.rowsBetween(0, size - 1)
    d = d.withColumns(
        {
            name: F.collect_list(F.struct(track.order, *columns)).over(frame),
            "window_start": F.col(track.order),
            "window_end": F.max(track.order).over(frame),
            "window_no": F.floor((F.col("_rn") - 1) / step),
        }
    ).where((F.col("_rn") - 1) % step == 0)
    return core_rows(d.where(F.size(name) == size)).select(
        *track.key, "window_no", "window_start", "window_end", name
    )


def sequences(df: DataFrame, track: Track, features: Sequence[str], label: str, length: int) -> DataFrame:
    """Sequences of ``length`` rows with the label of their last row."""
    d, w = framed(df, track, length, 0)
    seq = F.collect_list(F.struct(*features)).over(w.rowsBetween(-(length - 1), 0))
    d = core_rows(d.withColumn("sequence", seq))
    return d.where(F.size("sequence") == length).select(
        *track.key, F.col(track.order), "sequence", F.col(label).alias("label")
    )


def window_features(
    df: DataFrame, track: Track, features: Sequence[str], targets: Sequence[str] = (), label: str | None = None,
    size: int = 7, step: int = 1, horizon: int = 10,
) -> DataFrame:
    """Mean, median, minimum, maximum and sample deviation of each feature per window, with the window's
    time span, the most frequent label and, if targets are given, their value ``horizon`` rows later."""
    reach = size + horizon - 1 if targets else size - 1
    d, w = framed(df, track, 0, reach + 1)
    frame = w.rowsBetween(0, size - 1)
    new = {
        "window_start": F.col(track.order),
        "window_end": F.max(track.order).over(frame),
        "_last": F.lead("_rn", reach).over(w),
    }
    for f in features:
        new |= {
            f"{f}_mean": F.avg(f).over(frame), f"{f}__all": F.collect_list(f).over(frame),
            f"{f}_min": F.min(f).over(frame), f"{f}_max": F.max(f).over(frame),
            f"{f}_std": F.stddev_samp(f).over(frame),
        }
    if label:
        new["_labels"] = F.collect_list(label).over(frame)
    for t in targets:
        new[f"{t}_target"] = F.lead(t, reach).over(w)
    d = core_rows(d.withColumns(new).where(((F.col("_rn") - 1) % step == 0) & F.col("_last").isNotNull()))
    out = [F.col(c) for c in (*track.key, "window_start", "window_end")]
    for f in features:
        out += [
            F.col(f"{f}_mean"), array_median(F.col(f"{f}__all")).alias(f"{f}_median"),
            F.col(f"{f}_min"), F.col(f"{f}_max"), F.col(f"{f}_std"),
        ]
    if label:
        out.append(array_mode(F.col("_labels")).alias("label"))
    return d.select(*out, *[f"{t}_target" for t in targets])


def majority_sequences(df: DataFrame, track: Track, features: Sequence[str], label: str, length: int) -> DataFrame:
    """Sequences starting at every row, labelled by the half-even rounded mean label clipped to 0..1;
    windows with a NULL label are left out."""
    d, w = framed(df, track, 0, length)
    frame = w.rowsBetween(0, length - 1)
    d = d.withColumns(
        {
            "sequence": F.collect_list(F.struct(*features)).over(frame),
            "_known": F.count(label).over(frame),
            "_mean": F.avg(label).over(frame),
        }
    ).where((F.size("sequence") == length) & (F.col("_known") == length))
    rounded = F.rint("_mean")
    clipped = F.when(rounded < 0, 0).when(rounded > 1, 1).otherwise(rounded.cast("int"))
    return core_rows(d).select(*track.key, F.col(track.order), "sequence", clipped.alias("label"))


def delayed_sequences(
    df: DataFrame, track: Track, features: Sequence[str], targets: Sequence[str], length: int = 10, horizon: int = 10
) -> DataFrame:
    """X = rows i .. i+L-1, y = row i+L+H."""
    d, w = framed(df, track, 0, length + horizon + 1)
    new = {
        "sequence": F.collect_list(F.struct(*features)).over(w.rowsBetween(0, length - 1)),
        "_last": F.lead("_rn", length + horizon).over(w),
    }
    new |= {f"{t}_target": F.lead(t, length + horizon).over(w) for t in targets}
    d = core_rows(d.withColumns(new).where(F.col("_last").isNotNull()), "_last")
    return d.select(*track.key, F.col(track.order), "sequence", *[f"{t}_target" for t in targets])


def lookback_positions(
    df: DataFrame, track: Track, xy: tuple[str, str] = ("latitude", "longitude"), lookback: int = 5
) -> DataFrame:
    """Flattened positions i-lookback .. i-1 and the position i+1 as target."""
    d, w = framed(df, track, lookback, 1)
    past = F.collect_list(F.array(*[F.col(c) for c in xy])).over(w.rowsBetween(-lookback, -1))
    new = {"_past": past, "_next": F.lead("_rn", 1).over(w)}
    new |= {f"{c}_target": F.lead(c, 1).over(w) for c in xy}
    d = core_rows(d.withColumns(new).where((F.size("_past") == lookback) & F.col("_next").isNotNull()))
    return d.select(*track.key, F.col(track.order), F.flatten("_past").alias("past"), *[f"{c}_target" for c in xy])


def check_windows(
    df: DataFrame, track: Track, size: int, step: int = 1, features: Sequence[str] = tuple(S.MODEL_FEATURES),
    partial: bool = False, keep: Sequence[str] = (),
) -> DataFrame:
    """Completeness of each window: ``ok`` or the first reason against it.

    With ``partial`` the short windows at the end of a track are reported as ``too_short``.
    """
    absent = [c for c in features if c not in df.columns]
    present = [c for c in features if c in df.columns]
    d, w = framed(df, track, 0, size)
    frame = w.rowsBetween(0, size - 1)
    new = {"rows": F.count(F.lit(1)).over(frame), "window_no": F.floor((F.col("_rn") - 1) / step)}
    new |= {f"_n_{c}": F.count(c).over(frame) for c in present}
    d = d.withColumns(new).where((F.col("_rn") - 1) % step == 0)
    if not partial:
        d = d.where(F.col("rows") == size)
    return core_rows(d).select(
        *track.key, "window_no", F.col(track.order).alias("window_start"), *keep, "rows",
        _reason(absent, present, size).alias("reason"),
    )


def _reason(absent: Sequence[str], present: Sequence[str], size: int) -> Column:
    if absent:
        return F.lit("missing_columns")
    return (
        F.when(any_of([F.col(f"_n_{c}") == 0 for c in present]), "fully_null")
        .when(any_of([F.col(f"_n_{c}") < F.col("rows") for c in present]), "partly_null")
        .when(F.col("rows") < size, "too_short")
        .otherwise("ok")
    )


def last_rows(df: DataFrame, track: Track, n: int) -> DataFrame:
    """Newest ``n`` rows of each key; every map task keeps at most ``n`` rows per key for the shuffle."""
    w = Window.partitionBy(*track.key).orderBy(*track.desc())
    return df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def last_rows_span(df: DataFrame, track: Track, n: int) -> DataFrame:
    t = track.order
    return last_rows(df, track, n).groupBy(*track.key).agg(
        F.count(F.lit(1)).alias("rows"), F.min(t).alias("from_epoch"), F.max(t).alias("to_epoch"),
        (F.max(t) - F.min(t)).alias("span_s"),
    )


def every_nth_newest(df: DataFrame, track: Track, n: int = 20) -> DataFrame:
    """Every n-th row from the newest backwards."""
    d = track_row_numbers(df, track, "_rn", total="_total")
    return d.where((F.col("_total") - F.col("_rn")) % n == 0).drop("_rn", "_total")


