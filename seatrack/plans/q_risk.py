"""Queries over cable zones, closeness and risk, and the join of positions with cable segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatrack.fixtures import messages, sql_with
from seatrack.operators import risk, series
from seatrack.operators.ordered import Track
from seatrack.plans.registry import query
from seatrack.sources.readers import cable_points

T = Track(tie=("event_id",))

# Surveyed cable points (cable, point, latitude, longitude), 21 cables, 61 points.
CABLE_POINTS = """
Cable_1,Start,57.35691111,10.53574167
Cable_1,Bend_1,57.47271389,10.84041944
Cable_1,End,57.51526111,12.09806667
Cable_2,Start,57.26806389,10.535875
Cable_2,Bend_1,57.24204167,10.72913611
Cable_2,End,57.28418333,10.912925
Cable_3,Start,57.18691667,11.10171667
Cable_3,Bend_1,57.09657778,11.73715833
Cable_3,End,57.12450278,12.27053889
Cable_4,Start,57.34086667,11.22185556
Cable_4,Bend_1,57.00283056,11.78974444
Cable_4,End,56.68929167,12.70999722
Cable_5,Start,55.70885278,10.01810278
Cable_5,End,55.56739444,10.117775
Cable_6,Start,55.33159722,10.82359722
Cable_6,End,55.33036944,11.18114444
Cable_7,Start,54.67851389,11.38322778
Cable_7,End,54.52283889,11.24311667
Cable_8,Start,56.10806111,12.60946944
Cable_8,End,56.07175556,12.56313056
Cable_9,Start,56.03166111,12.70165833
Cable_9,End,56.02743056,12.6185
Cable_10,Start,55.71930556,12.58794167
Cable_10,Bend_1,55.77198333,12.74938056
Cable_10,End,55.76152778,12.91920556
Cable_11,Start,55.58754722,12.70050278
Cable_11,End,55.5609,12.91053889
Cable_12,Start,55.59030278,12.48239444
Cable_12,Bend_1,55.52267778,12.52938611
Cable_12,End,55.51491111,12.89273611
Cable_13,Start,55.25248333,12.401775
Cable_13,Bend_1,55.14280833,12.85796667
Cable_13,End,55.09215556,14.68496667
Cable_14,Start,54.56651944,11.96096667
Cable_14,Bend_1,54.31893333,11.96540833
Cable_14,End,54.18515833,12.08190556
Cable_15,Start,54.56651944,11.96096667
Cable_15,Bend_1,54.63192778,12.63028056
Cable_15,Bend_2,54.88605556,13.56181944
Cable_15,Bend_3,54.94391111,14.89017778
Cable_15,End,55.02227222,15.01852778
Cable_16,Start,54.54116111,13.70245556
Cable_16,Bend_1,54.89799722,14.46852778
Cable_16,End,55.08648333,14.72975278
Cable_17,Start,55.42622222,13.87678611
Cable_17,Bend_1,55.01434444,14.45977778
Cable_17,End,55.08648333,14.72975278
Cable_18,Start,55.42951944,14.26247222
Cable_18,End,55.21621111,14.71188889
Cable_19,Start,55.08648333,14.72975278
Cable_19,Bend_1,54.57859722,15.45945833
Cable_19,End,54.21017222,15.62174167
Cable_20,Start,55.25203889,14.88678889
Cable_20,Bend_1,55.64501389,15.35341667
Cable_20,End,56.197675,16.46964444
Cable_21,Start,54.18515833,12.08190556
Cable_21,Bend_1,54.70189722,12.65218611
Cable_21,Bend_2,54.94952778,13.54544722
Cable_21,Bend_3,55.33461944,14.44842222
Cable_21,Bend_4,55.58403333,15.35683056
Cable_21,End,55.69911944,16.36183611
"""
_ROWS = [line.split(",") for line in CABLE_POINTS.split()]
_VALUES = ", ".join(f"('{c}', '{p}', CAST({a} AS DOUBLE), CAST({o} AS DOUBLE))" for c, p, a, o in _ROWS)


def segments(spark: SparkSession) -> DataFrame:
    points = spark.sql(f"SELECT * FROM VALUES {_VALUES} AS t(Cable, Point, Latitude, Longitude)")
    return risk.cable_segments(cable_points(points))


SEG_SQL = f"""pts AS (SELECT cable, CASE WHEN point = 'Start' THEN 0 WHEN point = 'End' THEN 1000000 ELSE CAST(substr(point, 6) AS INT) END AS no, lat, lon
 FROM (VALUES {_VALUES}) t(cable, point, lat, lon)),
seg AS (SELECT * FROM (SELECT cable, no AS seg_no, lon AS x1, lat AS y1, lead(lon) OVER (PARTITION BY cable ORDER BY no) AS x2, lead(lat) OVER (PARTITION BY cable ORDER BY no) AS y2 FROM pts) WHERE x2 IS NOT NULL)"""


def along_sql(px, py):
    return f"""least(greatest(coalesce((({px} - x1) * (x2 - x1) + ({py} - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0), 0), 1)"""


def sq_sql(px, py, t):
    return f"(({px} - (x1 + {t} * (x2 - x1))) * ({px} - (x1 + {t} * (x2 - x1))) + ({py} - (y1 + {t} * (y2 - y1))) * ({py} - (y1 + {t} * (y2 - y1))))"


def degrees(metres):
    return f"(CAST({metres} AS DOUBLE) / CAST(111320 AS DOUBLE))"


DIST_SQL = f"""near AS (SELECT event_id, min({sq_sql('longitude', 'latitude', 'tt')}) AS d2, min({{metres}}) AS m FROM (
 SELECT event_id, longitude, latitude, seg.*, {along_sql('longitude', 'latitude')} AS tt FROM msg, seg) GROUP BY event_id)"""
_MID = "radians((latitude + (y1 + tt * (y2 - y1))) / 2)"
_W = f"(1 - 0.0066943799901413165::DOUBLE * sin({_MID}) * sin({_MID}))"
METRES_SQL = f"""sqrt(pow(radians((y1 + tt * (y2 - y1)) - latitude) * (6378137.0::DOUBLE * (1 - 0.0066943799901413165::DOUBLE)) / ({_W} * sqrt({_W})), 2)
 + pow(radians((x1 + tt * (x2 - x1)) - longitude) * 6378137.0::DOUBLE / sqrt({_W}) * cos({_MID}), 2))"""
NEAR_SQL = DIST_SQL.replace("{metres}", METRES_SQL)


@query("s11_cable_segments", sql_with(f"""SELECT cable, CAST(seg_no AS INT) AS seg_no, x1 AS lon1, y1 AS lat1, x2 AS lon2, y2 AS lat2, count(*) FILTER (d2 < {degrees(3738)} * {degrees(3738)}) AS positions_near FROM (
 SELECT *, {sq_sql('longitude', 'latitude', 'tt')} AS d2 FROM (SELECT longitude, latitude, seg.*, {along_sql('longitude', 'latitude')} AS tt FROM msg, seg)) GROUP BY ALL""", SEG_SQL))
def _(spark, sf):
    s = segments(spark)
    near = risk.near_pairs(messages(spark, sf), s, 3738).groupBy("cable", "seg_no").agg(F.count(F.lit(1)).alias("n"))
    return s.join(near, ["cable", "seg_no"], "left").select(
        "cable", "seg_no", *risk.SEGMENT, F.coalesce("n", F.lit(0)).alias("positions_near")
    )


@query("g1_in_zone", sql_with(f"SELECT event_id, d2 < {degrees(1602)} * {degrees(1602)} AS in_zone FROM near", SEG_SQL, NEAR_SQL))
def _(spark, sf):
    return risk.in_zone(messages(spark, sf), segments(spark)).select("event_id", "in_zone")


# Forecasts: the next five positions of the vessel, moved a little.
FORECAST_SQL = """fc AS (SELECT event_id, k, i, lat, lon FROM (SELECT event_id, k, unnest([0, 1, 2, 3, 4]) AS i,
 unnest([lead(latitude, 1) OVER w, lead(latitude, 2) OVER w, lead(latitude, 3) OVER w, lead(latitude, 4) OVER w, lead(latitude, 5) OVER w]) + CAST(0.01 AS DOUBLE) AS lat,
 unnest([lead(longitude, 1) OVER w, lead(longitude, 2) OVER w, lead(longitude, 3) OVER w, lead(longitude, 4) OVER w, lead(longitude, 5) OVER w]) + CAST(0.02 AS DOUBLE) AS lon,
 lead(event_id, 5) OVER w AS whole FROM msg WINDOW w AS (PARTITION BY mmsi ORDER BY epoch, event_id)) WHERE whole IS NOT NULL)"""


def forecasts(spark, sf):
    d = series.forecasting_target(messages(spark, sf), T, 5)
    moved = F.transform("future", lambda p: F.struct((p["latitude"] + 0.01).alias("latitude"), (p["longitude"] + 0.02).alias("longitude")))
    return d.select("event_id", "k", moved.alias("forecast"))


def steps_sql(metres):
    return f"""hit AS (SELECT event_id, i, min({sq_sql('lon', 'lat', 'tt')}) < {degrees(metres)} * {degrees(metres)} AS inside
 FROM (SELECT fc.*, seg.*, {along_sql('lon', 'lat')} AS tt FROM fc, seg) GROUP BY event_id, i)"""


@query("g2_any_forecast_in_zone", sql_with("SELECT event_id, bool_or(inside) AS any_in_zone FROM hit GROUP BY event_id", SEG_SQL, FORECAST_SQL, steps_sql(1602)))
def _(spark, sf):
    return risk.any_forecast_in_zone(forecasts(spark, sf), segments(spark)).select("event_id", "any_in_zone")


@query("g3_first_forecast_in_zone", sql_with("SELECT event_id, CAST(min(i) FILTER (inside) AS INT) AS first_in_zone FROM hit GROUP BY event_id", SEG_SQL, FORECAST_SQL, steps_sql(1602)))
def _(spark, sf):
    return risk.first_forecast_in_zone(forecasts(spark, sf), segments(spark)).select("event_id", "first_in_zone")


@query("g4_forecast_zone_steps", sql_with("SELECT event_id, CAST(i AS INT) AS step FROM hit WHERE inside", SEG_SQL, FORECAST_SQL, steps_sql(3738)))
def _(spark, sf):
    d = risk.forecast_zone_steps(forecasts(spark, sf), segments(spark), 3738)
    return d.select("event_id", F.explode("zone_steps").alias("step"))


@query("g5_near_cable", sql_with("SELECT event_id, m <= 3738 AS near_cable FROM near", SEG_SQL, NEAR_SQL))
def _(spark, sf):
    return risk.near_cable(messages(spark, sf), segments(spark), 3738).select("event_id", "near_cable")


def cross_sql():
    """Path steps against segments: proper crossing or one of four point-segment distances."""
    def d2(px, py, ax, ay, bx, by):
        t = f"least(greatest(coalesce((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}), 0), 0), 0), 1)"
        return f"(pow({px} - ({ax} + {t} * ({bx} - {ax})), 2) + pow({py} - ({ay} + {t} * ({by} - {ay})), 2))"

    def side(ax, ay, bx, by, cx, cy):
        return f"sign(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"

    p, s = ("px", "py", "qx", "qy"), ("x1", "y1", "x2", "y2")
    cross = f"({side(*p, 'x1', 'y1')} * {side(*p, 'x2', 'y2')} < 0 AND {side(*s, 'px', 'py')} * {side(*s, 'qx', 'qy')} < 0)"
    r2 = f"{degrees(1602)} * {degrees(1602)}"
    near = " OR ".join(f"{d} <= {r2}" for d in (d2("px", "py", *s), d2("qx", "qy", *s), d2("x1", "y1", *p), d2("x2", "y2", *p)))
    return f"""step AS (SELECT event_id, lon AS px, lat AS py, lead(lon) OVER w AS qx, lead(lat) OVER w AS qy FROM fc WINDOW w AS (PARTITION BY event_id ORDER BY i)),
crossing AS (SELECT event_id, bool_or({cross} OR {near}) AS crosses_zone FROM step, seg WHERE qx IS NOT NULL GROUP BY event_id)"""


@query("g6_path_crosses_zone", sql_with("SELECT event_id, crosses_zone FROM crossing", SEG_SQL, FORECAST_SQL, cross_sql()))
def _(spark, sf):
    return risk.path_crosses_zone(forecasts(spark, sf), segments(spark)).select("event_id", "crosses_zone")


@query("g7_risk_level", sql_with("""SELECT f.event_id, CASE WHEN k < 40 THEN 0 WHEN crosses_zone THEN 3 WHEN inside THEN 2 ELSE 1 END AS risk_level
 FROM fc f JOIN crossing c ON f.event_id = c.event_id JOIN hit h ON h.event_id = f.event_id AND h.i = 0 WHERE f.i = 0""", SEG_SQL, FORECAST_SQL, cross_sql(), steps_sql(3738)))
def _(spark, sf):
    d = forecasts(spark, sf).withColumn("label", F.when(F.col("k") >= 40, 1).otherwise(0))
    return risk.risk_levels(d, segments(spark)).select("event_id", "risk_level")


@query("j8_near_pairs", sql_with(f"""SELECT event_id, cable, CAST(seg_no AS INT) AS seg_no, round(sqrt(d2), 9) AS dist_deg FROM (SELECT event_id, cable, seg_no, {sq_sql('longitude', 'latitude', 'tt')} AS d2 FROM (
 SELECT event_id, longitude, latitude, seg.*, {along_sql('longitude', 'latitude')} AS tt FROM msg, seg)) WHERE d2 < {degrees(3738)} * {degrees(3738)}""", SEG_SQL))
def _(spark, sf):
    d = risk.near_pairs(messages(spark, sf), segments(spark), 3738)
    return d.select("event_id", "cable", "seg_no", F.round("dist_deg", 9).alias("dist_deg"))
