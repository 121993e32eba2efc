"""Time buckets, complete time grids and resampling of tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrack import schema as S
from seatrack.operators.clean import clamp, dedup_on_key
from seatrack.operators.ordered import DAY, Track, join_key_values, join_per_key, key_values, known_neighbours, next_time, time_blocks


def bucket(order: str, seconds: int) -> Column:
    return F.floor(F.col(order) / seconds) * seconds


def bucket_mean(df: DataFrame, track: Track, columns: Sequence[str], seconds: int = 60) -> DataFrame:
    """Mean of each column per key and non-empty bucket; the order column becomes the bucket start."""
    slot = bucket(track.order, seconds).alias(track.order)
    return df.groupBy(*track.key, slot).agg(*[F.avg(c).alias(c) for c in columns])


def bucket_first(df: DataFrame, track: Track, seconds: int = 60) -> DataFrame:
    """Earliest row per key and bucket, its time moved to the bucket start."""
    d = df.withColumn("_slot", bucket(track.order, seconds))
    first = dedup_on_key(d, [*track.key, "_slot"], [track.order, *track.tie])
    return first.withColumn(track.order, F.col("_slot")).drop("_slot")


def time_grid(bounds: DataFrame, key: Sequence[str], step_s: int, order: str = "epoch") -> DataFrame:
    """Every grid time from ``min_epoch`` to ``max_epoch`` of each key.

    The range of a key is cut into days before the slots are produced, so a long track is produced by
    many tasks.
    """
    day = max(DAY - DAY % step_s, step_s)
    starts = bounds.select(
        *key, "min_epoch", "max_epoch",
        F.explode(F.sequence("min_epoch", "max_epoch", F.lit(day).cast("bigint"))).alias("_from"),
    ).repartition(*key, "_from")
    to = F.least(F.col("max_epoch"), F.col("_from") + day - step_s)
    return starts.select(*key, F.explode(F.sequence("_from", to, F.lit(step_s).cast("bigint"))).alias(order))


def align(df: DataFrame, track: Track, step_s: int, on_collision: str = "first") -> DataFrame:
    """Move times down to the grid; keep the first row per slot, or all of them (``keep``)."""
    if on_collision == "first":
        return bucket_first(df, track, step_s)
    return df.withColumn(track.order, bucket(track.order, step_s))


def _emit_slots(d: DataFrame, track: Track, last: Column, step_s: int, since: Column | None = None) -> DataFrame:
    """Adds ``_slot``: the slot of each row and the empty ones up to ``last``, without those before ``since``.

    A gap of more than a day is cut into pieces of at most a day, dealt by key and piece, before the slots are produced: no
    array is longer than a day, and a long gap is filled by many tasks. All other rows stay where they are. ``since`` bounds the
    slots of a key, and with them the arrays.
    """
    t, step = F.col(track.order), F.lit(step_s).cast("bigint")
    day = max(DAY - DAY % step_s, step_s)
    d = d.withColumn("_end", F.greatest(last, t))
    if since is not None:
        d = d.where(F.col("_end") >= since)
        return d.withColumn("_slot", F.explode(F.sequence(F.greatest(t, since), F.col("_end"), step))).drop("_end")
    wide = F.col("_end") - t >= day
    near = d.where(~wide).withColumn("_slot", F.explode(F.sequence(t, F.col("_end"), step))).drop("_end")
    pieces = d.where(wide).withColumn("_from", F.explode(F.sequence(t, F.col("_end"), F.lit(day).cast("bigint")))).repartition(*track.key, "_from")
    to = F.least(F.col("_end"), F.col("_from") + day - step_s)
    return near.unionByName(pieces.withColumn("_slot", F.explode(F.sequence("_from", to, step))).drop("_from", "_end"))


def fill_grid(
    df: DataFrame, track: Track, step_s: int, constant: Sequence[str] = (), until: str | None = None
) -> DataFrame:
    """Add the missing grid rows of each key: every row emits the empty slots up to the next row.

    Times must already lie on the grid. Rows added carry the key and the ``constant`` columns, NULL
    elsewhere. ``until`` names a column with the last slot of the key, if later than its last row.
    No grid table is joined, so the messages are shuffled once.
    """
    t = F.col(track.order)
    d = next_time(df, track, "_next")
    last = F.coalesce(F.col("_next") - step_s, F.col(until) if until else t)
    d = _emit_slots(d, track, last, step_s)
    own = F.col("_slot") == t
    kept = {*track.key, *constant, track.order, "_next", "_slot"}
    if until:
        kept.add(until)
    d = d.withColumns({c: F.when(own, F.col(c)) for c in df.columns if c not in kept})
    d = d.withColumn(track.order, F.col("_slot")).drop("_slot", "_next")
    return d.drop(until) if until else d


def to_fixed_grid(df: DataFrame, track: Track, step_s: int = 10, on_collision: str = "first",
                  constant: Sequence[str] = ()) -> DataFrame:
    """Messages on a complete grid from the first to the last slot of each key."""
    return fill_grid(align(df, track, step_s, on_collision), track, step_s, constant)


def day_origin(df: DataFrame, track: Track) -> DataFrame:
    """Adds ``_origin``: midnight of the first day of each key, the origin of its buckets."""
    first = key_values(df, track, _origin=("min", F.floor(F.col(track.order) / DAY) * DAY))
    return join_key_values(df, first, track)


def _slot_from_origin(df: DataFrame, track: Track, seconds: int) -> tuple[DataFrame, Column]:
    if DAY % seconds == 0:  # buckets of every day start at midnight
        return df, bucket(track.order, seconds)
    d = day_origin(df, track)
    return d, F.col("_origin") + F.floor((F.col(track.order) - F.col("_origin")) / seconds) * seconds


def downsample_first(df: DataFrame, track: Track, columns: Sequence[str], seconds: int) -> DataFrame:
    """First non-NULL value of each column per bucket; buckets with a column left NULL go.

    ``min_by`` over the time skips NULL values and combines in the map tasks.
    """
    d, slot = _slot_from_origin(df, track, seconds)
    rank = F.struct(track.order, *track.tie) if track.tie else F.col(track.order)
    out = d.groupBy(*track.key, slot.alias(track.order)).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns]
    )
    return out.na.drop(subset=list(columns))


def grid_hits(df: DataFrame, track: Track, seconds: int, columns: Sequence[str]) -> DataFrame:
    """Rows exactly on the grid (first per time), with ``_until``, the slot of the last row of the key."""
    unique = dedup_on_key(df, [*track.key, track.order], [track.order, *track.tie])
    d, slot = _slot_from_origin(unique, track, seconds)
    ends = key_values(df, track, _last=("max", F.col(track.order)), _begin=("min", F.col(track.order)))
    hits = d.where(slot == F.col(track.order)).select(*track.key, track.order, *columns)
    origin = F.floor(F.col("_begin") / DAY) * DAY
    until = origin + F.floor((F.col("_last") - origin) / seconds) * seconds
    return join_key_values(hits, ends.select(*track.parts, until.alias("_until")), track)


def filled_grid(
    df: DataFrame, track: Track, step_s: int, lines: Sequence[str], fills: Sequence[str] = (),
    hold: Sequence[str] = (), back: Sequence[str] = (), max_gap_s: int | None = None, until: str | None = None,
    newest: int | None = None,
) -> DataFrame:
    """Complete grid with filled values, computed while the slots are produced.

    Times must lie on the grid, one row per slot. ``lines`` are interpolated over time (between known
    values at most ``max_gap_s`` apart), ``hold`` columns then keep their last known value and ``back``
    columns take the next one. The neighbours are found among the messages, before the grid is expanded,
    so neither windows nor shuffles run over the much larger grid. ``newest`` asks for only so many slots of each key, the last ones.
    """
    d = grid_neighbours(df, track, list(dict.fromkeys([*lines, *fills])), "_last" if newest else None)
    return expand_grid(d, track, step_s, lines, fills, hold, back, max_gap_s, until, newest)


def grid_neighbours(df: DataFrame, track: Track, columns: Sequence[str], last_name: str | None = None) -> DataFrame:
    """Messages on the grid with the known neighbours of each column and ``_next``, the next slot taken."""
    return known_neighbours(df, track, columns, own_ahead=False, next_name="_next", last_name=last_name)


def expand_grid(
    d: DataFrame, track: Track, step_s: int, lines: Sequence[str], fills: Sequence[str] = (), hold: Sequence[str] = (),
    back: Sequence[str] = (), max_gap_s: int | None = None, until: str | None = None, newest: int | None = None,
) -> DataFrame:
    """Second half of :func:`filled_grid`: every row emits its slot and the empty ones after it.

    With ``newest``, only the last slots of each key are produced; ``_last`` is the time of the last row of the key.
    """
    t = F.col(track.order)
    last = F.coalesce(F.col("_next") - step_s, F.col(until) if until else t)
    end = F.greatest("_last", until) if until else F.col("_last")
    d = _emit_slots(d, track, last, step_s, end - (newest - 1) * step_s if newest else None)
    at = F.col("_slot")
    values = _slot_values(track, at, lines, fills, hold, back, max_gap_s)
    return d.select(*track.key, at.alias(track.order), *[v.alias(c) for c, v in values.items()])


def _slot_values(
    track: Track, at: Column, lines: Sequence[str], fills: Sequence[str], hold: Sequence[str], back: Sequence[str], max_gap_s: int | None
) -> dict[str, Column]:
    """Values of a slot at or after a message, from the message and its known neighbours."""
    own, values = at == F.col(track.order), {}
    for c in dict.fromkeys([*lines, *fills]):
        pv, pp, nv, np_ = (F.col(f"{c}__{e}") for e in ("pv", "pp", "nv", "np"))
        options = [F.when(own, F.col(c))]
        if c in lines:
            line = pv + (nv - pv) * ((at - pp) / (np_ - pp))
            options.append(line if max_gap_s is None else F.when(np_ - pp <= max_gap_s, line))
        if c in hold:
            options.append(pv)
        if c in back:
            options.append(nv)
        values[c] = F.coalesce(*options)
    return values


def expand_with_future(
    d: DataFrame, track: Track, step_s: int, lines: Sequence[str], fills: Sequence[str] = (), hold: Sequence[str] = (), back: Sequence[str] = (),
    max_gap_s: int = 300, horizon: int = 120, columns: Sequence[str] = ("latitude", "longitude"), name: str = "future",
) -> DataFrame:
    """:func:`expand_grid` with the next ``horizon`` positions of each slot, for messages at most ``max_gap_s`` apart.

    A message and the slots up to the next one form a segment, whose positions follow from the message alone. Each message is given the
    first ``horizon`` positions of the segments after it; a slot takes the rest of its own segment and then these. So the one
    window runs over messages, and nothing is shuffled once slots are produced.
    """
    t, reach = F.col(track.order), max_gap_s + horizon * step_s
    slots = F.sequence(t, F.greatest(F.coalesce(F.col("_next") - step_s, t), t), F.lit(step_s).cast("bigint"))
    values = lambda at: _slot_values(track, at, lines, fills, hold, back, max_gap_s)
    d = d.withColumn("_segment", F.transform(slots, lambda at: F.struct(*[values(at)[c].alias(c) for c in columns])))
    d, w = time_blocks(d, track, 0, reach)
    after = F.slice(F.flatten(F.collect_list("_segment").over(w.rangeBetween(1, reach))), 1, horizon)
    d = d.withColumn("_after", after).where("_core")
    d = d.withColumn("_slots", slots).select("*", F.posexplode("_slots").alias("_place", "_slot"))
    future = F.slice(F.concat(F.slice("_segment", F.col("_place") + 2, F.size("_segment")), F.col("_after")), 1, horizon)
    at = F.col("_slot")
    return d.select(*track.key, at.alias(track.order), *[v.alias(c) for c, v in values(at).items()], future.alias(name))


def drop_gappy_keys(
    d: DataFrame, track: Track, step_s: int, columns: Sequence[str], hold: Sequence[str], max_gap_s: int
) -> DataFrame:
    """Drop the keys whose expanded grid would keep a NULL in some column, before expanding it.

    A ``hold`` column stays complete once it is known. The others need known neighbours at most
    ``max_gap_s`` apart around every slot that no message fills.
    """
    bad = F.lit(False)
    for c in columns:
        pv, pp, np_ = (F.col(f"{c}__{e}") for e in ("pv", "pp", "np"))
        unknown = F.col(c).isNull()
        if c in hold:
            bad = bad | pv.isNull()
            continue
        near = F.coalesce(np_ - pp <= max_gap_s, F.lit(False))
        adjacent = np_ - F.col(track.order) <= step_s
        bad = bad | (unknown & ~near) | (~unknown & np_.isNotNull() & ~near & ~adjacent)
    good = key_values(d, track, _bad=("max", F.coalesce(bad, F.lit(False)))).where("NOT _bad")
    return join_key_values(d, good.select(*track.parts), track, "left_semi")


def resample_linear(
    df: DataFrame, track: Track, columns: Sequence[str], seconds: int, label: str | None = "label"
) -> DataFrame:
    """Exact grid hits, linear interpolation (the last value goes on), label filled, incomplete rows dropped."""
    labels = [label] if label else []
    hits = grid_hits(df, track, seconds, [*columns, *labels])
    d = filled_grid(hits, track.without_tie(), seconds, columns, labels, [*columns, *labels], labels, until="_until")
    return d.na.drop(subset=[*columns, *labels])


def key_mode(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Most frequent value per key, the smallest on a tie; counted per (key, value) first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*key, column).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*key).orderBy(F.col("_n").desc(), F.col(column).asc())
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*key, column)


def resample_with_mode(
    df: DataFrame, track: Track, columns: Sequence[str], seconds: int, label: str = "label"
) -> DataFrame:
    """Exact grid hits, ends filled both ways, one label per key (its mode), all-NULL rows dropped."""
    # The label joins the few hits, not the grid; as one value per key it fills like any other column.
    hits = join_per_key(grid_hits(df, track, seconds, columns), key_mode(df, track.key, label), track, chunks_of=df)
    both = [*columns, label]
    d = filled_grid(hits, track.without_tie(), seconds, columns, [label], both, both, until="_until")
    return d.na.drop("all", subset=list(columns))


def upsample(
    df: DataFrame, track: Track, columns: Sequence[str], intervals: Sequence[int] = (1, 11), label: str = "label"
) -> DataFrame:
    """:func:`resample_with_mode` for several intervals, told apart by ``interval_s``."""
    out = None
    for s in intervals:
        one = resample_with_mode(df, track, columns, s, label).withColumn("interval_s", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def scoring_grid(
    df: DataFrame, track: Track, step_s: int = 10, exact_only: bool = False,
    continuous: Sequence[str] = tuple(S.CONTINUOUS), static: Sequence[str] = tuple(S.STATIC), newest: int | None = None,
) -> DataFrame:
    """Grid for scoring: static columns filled both ways, continuous ones interpolated without a gap
    limit and held at the ends, known limits clamped. ``newest`` asks for only so many slots of each key, the last ones."""
    columns = [*continuous, *static]
    if exact_only:
        d, until = grid_hits(df, track, step_s, columns), "_until"
    else:
        d, until = align(df.select(*track.key, track.order, *track.tie, *columns), track, step_s), None
    return clamp(filled_grid(d, track.without_tie(), step_s, continuous, static, columns, columns, until=until, newest=newest))
