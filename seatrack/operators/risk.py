"""Cable zones, closeness of vessels and forecasts to cables, and the risk level.

Positions and the steps of forecast paths are joined with the cables on grid cells, so neither the number of
segments nor that of paths is bounded. Paths are compared once per distinct path and joined back by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrack import schema as S
from seatrack.functions.geo import along, boxes_meet, local_metres, point_segment_sq, segments_within

CELL = 0.1  # degrees
SLACK = 1e-9  # of a cell
SEGMENT = ("lon1", "lat1", "lon2", "lat2")


def cable_segments(points: DataFrame) -> DataFrame:
    """Segments between consecutive points of each cable: ``(cable, seg_no, lon1, lat1, lon2, lat2)``."""
    w = Window.partitionBy("cable").orderBy("point_no")
    return points.select(
        "cable", F.col("point_no").cast("int").alias("seg_no"),
        F.col("longitude").alias("lon1"), F.col("latitude").alias("lat1"),
        F.lead("longitude").over(w).alias("lon2"), F.lead("latitude").over(w).alias("lat2"),
    ).where(F.col("lon2").isNotNull())


def zone_radius(metres: float) -> float:
    """Zone width in degrees, one degree taken as 111,320 m."""
    return metres / S.METRES_PER_DEGREE


def _ends(s: Column) -> tuple[Column, ...]:
    return tuple(s[c] for c in SEGMENT)


def cable_cells(segments: DataFrame, margin: float, lon_margin: Column | float, cell: float = CELL) -> DataFrame:
    """Grid cells (``_cx, _cy``) with the segments that come within the margins of them."""
    s = segments.withColumn("_lon_margin", F.lit(lon_margin))
    lon_margin = F.col("_lon_margin")
    for name, m, a, b in (("_cx", lon_margin, "lon1", "lon2"), ("_cy", margin, "lat1", "lat2")):
        lo, hi = F.floor((F.least(a, b) - m) / cell), F.floor((F.greatest(a, b) + m) / cell)
        s = s.withColumn(name, F.explode(F.sequence(lo, hi)))
    reach = F.greatest(lon_margin, F.lit(margin)) + cell * 0.7072  # half the diagonal of a cell
    centre = ((F.col("_cx") + 0.5) * cell, (F.col("_cy") + 0.5) * cell)
    return s.where(point_segment_sq(*centre, *[F.col(c) for c in SEGMENT]) <= reach * reach).drop("_lon_margin")


def _cell_of(df: DataFrame, lat: str, lon: str, cell: float = CELL) -> DataFrame:
    return df.withColumns({"_cx": F.floor(F.col(lon) / cell), "_cy": F.floor(F.col(lat) / cell)})


def _position_predicate(df: DataFrame, segments: DataFrame, lat: str, lon: str, margin: float,
                        lon_margin: Column | float, name: str, test: Callable[[Column], Column]) -> DataFrame:
    """Whether ``test`` holds for some segment within the margins (degrees).

    Positions meet the segments of their grid cell in an equi-join, so almost all of them are settled by
    a hash lookup; distances are computed for the few in cells that a cable passes.
    """
    cells = cable_cells(segments, margin, lon_margin).groupBy("_cx", "_cy").agg(
        F.collect_list(F.struct(*SEGMENT)).alias("_near")
    )
    d = _cell_of(df, lat, lon).join(cells, ["_cx", "_cy"], "left")
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    hit = F.when(F.col("_near").isNull(), F.when(known, F.lit(False))).otherwise(F.exists("_near", test))
    return d.withColumn(name, hit).drop("_cx", "_cy", "_near")


def in_zone(df: DataFrame, segments: DataFrame, metres: float = S.CRITICAL_ZONE_M, lat: str = "latitude",
            lon: str = "longitude", name: str = "in_zone") -> DataFrame:
    """Whether the position lies less than the zone width from a cable."""
    r = zone_radius(metres)
    y, x = F.col(lat), F.col(lon)
    return _position_predicate(
        df, segments, lat, lon, r, r, name, lambda s: point_segment_sq(x, y, *_ends(s)) < r * r
    )


def near_cable(df: DataFrame, segments: DataFrame, radius_m: float = S.NEAR_CABLE_M, lat: str = "latitude",
               lon: str = "longitude", name: str = "near_cable") -> DataFrame:
    """Whether the closest point (in degrees) of some segment is at most ``radius_m`` metres away."""
    y, x = F.col(lat), F.col(lon)
    # A degree of latitude is never shorter than 110 km; one of longitude shrinks with the cosine.
    margin = radius_m / 110_000.0
    northmost = F.least(F.greatest(F.abs("lat1"), F.abs("lat2")) + margin, F.lit(89.9))
    lon_margin = margin / F.cos(F.radians(northmost))

    def close(s: Column) -> Column:
        t = along(x, y, *_ends(s))
        foot_x, foot_y = s["lon1"] + t * (s["lon2"] - s["lon1"]), s["lat1"] + t * (s["lat2"] - s["lat1"])
        return local_metres(y, x, foot_y, foot_x) <= radius_m

    return _position_predicate(df, segments, lat, lon, margin, lon_margin, name, close)


def _distinct_paths(df: DataFrame, path: str) -> DataFrame:
    return df.select(F.col(path).alias("_path")).where(F.size("_path") > 0).distinct()


def _with_hits(df: DataFrame, hits: DataFrame, path: str) -> DataFrame:
    """``df`` with the columns that ``hits`` has for its path; a row without hits keeps NULL there."""
    hits = hits.withColumnRenamed("_path", "_hit_path").withColumn("_hash", F.xxhash64("_hit_path"))
    return df.join(hits, (F.xxhash64(path) == F.col("_hash")) & (F.col(path) == F.col("_hit_path")), "left").drop("_hit_path", "_hash")


def forecast_zone_steps(df: DataFrame, segments: DataFrame, metres: float = S.CRITICAL_ZONE_M, path: str = "forecast",
                        name: str = "zone_steps") -> DataFrame:
    """Indices (from 0) of all forecast positions inside the zone.

    The positions of the distinct paths meet the segments of their grid cell in an equi-join.
    """
    r = zone_radius(metres)
    at = _distinct_paths(df, path).select("_path", F.posexplode("_path").alias("_i", "_at"))
    at = _cell_of(at.withColumns({"_y": F.col("_at.latitude"), "_x": F.col("_at.longitude")}), "_y", "_x")
    near = at.join(cable_cells(segments, r, r), ["_cx", "_cy"])
    inside = near.where(point_segment_sq(F.col("_x"), F.col("_y"), *[F.col(c) for c in SEGMENT]) < r * r)
    hits = inside.groupBy("_path").agg(F.sort_array(F.collect_set("_i")).alias("_inside"))
    none = F.when(F.col(path).isNotNull(), F.array().cast("array<int>"))
    return _with_hits(df, hits, path).withColumn(name, F.coalesce("_inside", none)).drop("_inside")


def any_forecast_in_zone(df: DataFrame, segments: DataFrame, metres: float = S.CRITICAL_ZONE_M,
                         path: str = "forecast", name: str = "any_in_zone") -> DataFrame:
    d = forecast_zone_steps(df, segments, metres, path, "_steps")
    return d.withColumn(name, F.size("_steps") > 0).drop("_steps")


def first_forecast_in_zone(df: DataFrame, segments: DataFrame, metres: float = S.CRITICAL_ZONE_M,
                           path: str = "forecast", name: str = "first_in_zone") -> DataFrame:
    d = forecast_zone_steps(df, segments, metres, path, "_steps")
    return d.withColumn(name, F.get("_steps", 0)).drop("_steps")


def cells_passed(steps: DataFrame, cell: float = CELL) -> DataFrame:
    """Cells (``_cx, _cy``) that the line from (``_ax, _ay``) to (``_bx, _by``) passes, by columns of cells.

    In each column the line covers one range of rows, so their number grows with the length of the line and not with
    the box around it. Ranges reach a billionth of a cell further, so that rounding loses no cell.
    """
    low, high = F.least("_ax", "_bx"), F.greatest("_ax", "_bx")
    d = steps.withColumn("_cx", F.explode(F.sequence(F.floor(low / cell - SLACK), F.floor(high / cell + SLACK))))
    run = F.col("_bx") - F.col("_ax")
    # A line within one column covers the rows of both its ends.
    at = lambda x: F.when(high - low < cell * SLACK, F.lit(None).cast("double")).otherwise(F.col("_ay") + (F.col("_by") - F.col("_ay")) * F.try_divide(x - F.col("_ax"), run))
    left = at(F.greatest(low, F.col("_cx") * cell))
    right = at(F.least(high, (F.col("_cx") + 1) * cell))
    first, last = F.coalesce(F.least(left, right), F.least("_ay", "_by")), F.coalesce(F.greatest(left, right), F.greatest("_ay", "_by"))
    return d.withColumn("_cy", F.explode(F.sequence(F.floor(first / cell - SLACK), F.floor(last / cell + SLACK))))


def path_crosses_zone(df: DataFrame, segments: DataFrame, metres: float = S.CRITICAL_ZONE_M, path: str = "forecast",
                      name: str = "crosses_zone") -> DataFrame:
    """Whether the line through the forecast positions touches the zone.

    Each step of a distinct path meets the segments of the cells that its line passes; a lone position
    is a step of length zero.
    """
    r = zone_radius(metres)
    steps = _distinct_paths(df, path).select("_path", F.posexplode("_path").alias("_i", "_a"))
    ahead = F.when(F.size("_path") == 1, F.col("_a")).otherwise(F.get("_path", F.col("_i") + 1))
    steps = steps.withColumn("_b", ahead).where("_b IS NOT NULL").select(
        "_path", F.col("_a.longitude").alias("_ax"), F.col("_a.latitude").alias("_ay"),
        F.col("_b.longitude").alias("_bx"), F.col("_b.latitude").alias("_by"))
    steps = cells_passed(steps)
    step, ends = tuple(F.col(c) for c in ("_ax", "_ay", "_bx", "_by")), tuple(F.col(c) for c in SEGMENT)
    near = steps.join(cable_cells(segments, r, r), ["_cx", "_cy"])
    hits = near.where(boxes_meet(step, ends, r) & segments_within(step, ends, r)).select("_path").distinct().withColumn("_touches", F.lit(True))
    return _with_hits(df, hits, path).withColumn(name, F.coalesce("_touches", F.lit(False))).drop("_touches")


def risk_levels(df: DataFrame, segments: DataFrame, critical_m: float = S.CRITICAL_ZONE_M, entry_m: float = S.ENTRY_ZONE_M,
                path: str = "forecast", label: str = "label", name: str = "risk_level",
                keep_negative: bool = True) -> DataFrame:
    """3 when the forecast path touches the critical zone, 2 when it starts in the entry zone, else 1;
    0 for windows without trawling, which are left out unless ``keep_negative``."""
    d = df if keep_negative else df.where(F.col(label) == 1)
    d = path_crosses_zone(d, segments, critical_m, path, "_crosses")
    start = F.get(F.col(path), 0)
    d = d.withColumns({"_lat0": start["latitude"], "_lon0": start["longitude"]})
    d = in_zone(d, segments, entry_m, "_lat0", "_lon0", "_entry")
    level = F.when(F.col(label) != 1, 0).when(F.col("_crosses"), 3).when(F.col("_entry"), 2).otherwise(1)
    return d.withColumn(name, level).drop("_crosses", "_entry", "_lat0", "_lon0")


def near_pairs(df: DataFrame, segments: DataFrame, metres: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Position x segment pairs closer than the zone width, joined on the grid cells a segment can reach."""
    r = zone_radius(metres)
    cells = cable_cells(segments, r, r)
    sq = point_segment_sq(F.col(lon), F.col(lat), *[F.col(c) for c in SEGMENT])
    joined = _cell_of(df, lat, lon).join(cells, ["_cx", "_cy"])
    return joined.withColumn("dist_deg", F.sqrt(sq)).where(F.col("dist_deg") < r).drop("_cx", "_cy")
