"""Queries over the compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatrack import schema as S
from seatrack.fixtures import messages, sql_with
from seatrack.operators import degrade, models, profile, series, split
from seatrack.operators.ordered import Track
from seatrack.plans import flows
from seatrack.plans.q_degrade import FEATURES, LEVELS, TRACK, VARIANT_VIEWS, trajectories, variants_sql
from seatrack.plans.q_models import TRAIN_STATS, linear_scores_sql, load_linear_models, train_stats
from seatrack.plans.q_clean import split_sql
from seatrack.plans.q_risk import NEAR_SQL, SEG_SQL, cross_sql, segments, steps_sql
from seatrack.plans.q_series import grid_sql, neighbours_sql
from seatrack.plans.q_sources import new_path
from seatrack.plans.registry import query, rounded

T = Track(tie=("event_id",))


@query("e1_label_fishing", sql_with("""SELECT event_id, m.mmsi, g.gear_type, CASE WHEN nav_status = 'Engaged in fishing' AND g.gear_type = 'TRAWLERS' THEN 1 ELSE 0 END AS trawling
 FROM raw m LEFT JOIN (SELECT mmsi, min(gear_type) AS gear_type FROM raw GROUP BY mmsi) g ON m.mmsi = g.mmsi WHERE mobile_type = 'Class A'"""))
def _(spark, sf):
    raw = messages(spark, sf, True)
    d = flows.label_fishing(raw, raw.select("mmsi", "gear_type").distinct(), "Class A", "mobile_type")
    return d.select("event_id", "mmsi", "gear_type", "trawling")


_STEP, _GAP = 21_600, 864_000
_ALL = [*S.CONTINUOUS, *S.STATIC]


def _gap_line(c, hold):
    tail = f"{c}_p" if hold else "NULL"
    return f"""CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_rn - {c}_rp <= {_GAP} THEN {c}_p + ({c}_n - {c}_p) * ((rn - {c}_rp) / ({c}_rn - {c}_rp)::DOUBLE) ELSE {tail} END AS {c}"""


_PREPARE_SQL = [
    "kept AS (SELECT * FROM msg WHERE mobile_type <> 'Class B' AND gear_type NOT IN ('UNKNOWN', 'INCONCLUSIVE'))",
    "full1 AS (SELECT * FROM kept WHERE mmsi IN (SELECT mmsi FROM kept GROUP BY mmsi HAVING " + " AND ".join(f"count({c}) > 0" for c in S.CONTINUOUS) + "))",
    """q AS (SELECT strftime(ts, '%Y-%m') AS mo, quantile_cont(latitude, 0.25) AS a1, quantile_cont(latitude, 0.75) AS a3, quantile_cont(longitude, 0.25) AS o1, quantile_cont(longitude, 0.75) AS o3 FROM full1 GROUP BY 1)""",
    """inl AS (SELECT f.* FROM full1 f JOIN q ON strftime(f.ts, '%Y-%m') = q.mo WHERE latitude BETWEEN a1 - 1.5 * (a3 - a1) AND a3 + 1.5 * (a3 - a1) AND longitude BETWEEN o1 - 1.5 * (o3 - o1) AND o3 + 1.5 * (o3 - o1))""",
    "wid AS (SELECT * FROM inl WHERE width BETWEEN (SELECT quantile_cont(width, 0.01) FROM inl) AND (SELECT quantile_cont(width, 0.99) FROM inl))",
    "len AS (SELECT * FROM wid WHERE length BETWEEN (SELECT quantile_cont(length, 0.01) FROM wid) AND (SELECT quantile_cont(length, 0.99) FROM wid))",
    grid_sql(_STEP, _ALL, "len"),
    neighbours_sql(_ALL, "epoch", "grid", order="epoch", extra="mmsi, epoch"),
    "filled AS (SELECT mmsi, epoch, " + ", ".join(_gap_line(c, c in ("rot", "heading", "draught")) for c in S.CONTINUOUS) + ", " +
    ", ".join(f"{c}_p AS {c}" for c in S.STATIC) + " FROM nb)",
    "whole AS (SELECT * FROM filled WHERE mmsi NOT IN (SELECT mmsi FROM filled WHERE " + " OR ".join(f"{c} IS NULL" for c in S.CONTINUOUS) + "))",
]


@query("e2_prepare", sql_with("""SELECT * FROM (SELECT mmsi, epoch, latitude, longitude, CASE WHEN rot < -90 THEN -90 WHEN rot > 90 THEN 90 ELSE rot END AS rot,
 CASE WHEN sog < 0 THEN 0 WHEN sog > 40 THEN 40 ELSE sog END AS sog, cog, heading, draught, width, length, trawling, """ + ", ".join(f"lead({c}, {i}) OVER w AS future_{n}_{i}" for i in range(1, 5) for c, n in (("latitude", "lat"), ("longitude", "lon"))) + """
 FROM whole WINDOW w AS (PARTITION BY mmsi ORDER BY epoch)) WHERE future_lon_4 IS NOT NULL""", *_PREPARE_SQL))
def _(spark, sf):
    d = flows.prepare(messages(spark, sf), T, _STEP, _GAP, horizon=4, exact=True)
    return series.wide_future(d.select("mmsi", "epoch", *S.CONTINUOUS, *S.STATIC, "future"), 4)


_EARLY = ["event_id", "epoch", "k", "gear_type", "latitude", "longitude", "rot", "sog", "cog", "heading", "draught", "trawling"]
_LINES = ["rot", "sog", "cog", "heading"]


def _row_line(c):
    return f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_p IS NOT NULL AND {c}_n IS NOT NULL THEN {c}_p + ({c}_n - {c}_p) * ((rn - {c}_rp) / ({c}_rn - {c}_rp)::DOUBLE) ELSE coalesce({c}_p, {c}_n) END"


@query("e3_prepare_early", sql_with("""SELECT l.mmsi, epoch, round(sog, 9) AS sog, round(rot, 9) AS rot, trawling, round(latitude_lag5, 9) AS latitude_lag5, round(lat3, 9) AS lat3, split FROM (
 SELECT *, lead(latitude, 3) OVER (PARTITION BY mmsi ORDER BY epoch) AS lat3 FROM lagged WHERE latitude_lag5 IS NOT NULL) l JOIN assigned a ON a.mmsi = l.mmsi WHERE lat3 IS NOT NULL""",
    "uniq AS (SELECT DISTINCT ts, mmsi, " + ", ".join(_EARLY) + " FROM raw WHERE mobile_type <> 'Class B' AND gear_type NOT IN ('UNKNOWN', 'INCONCLUSIVE'))",
    "days AS (SELECT * FROM uniq WHERE (mmsi, CAST(ts AS DATE)) IN (SELECT (mmsi, CAST(ts AS DATE)) FROM uniq GROUP BY mmsi, CAST(ts AS DATE) HAVING " + " AND ".join(f"count({c}) > 0" for c in _EARLY) + "))",
    split_sql("mmsi", "gear_type", "days", 0.7, 0.15),
    "buckets AS (SELECT mmsi, CAST(floor(epoch / 3600) * 3600 AS BIGINT) AS epoch, " + ", ".join(f"avg({c}) AS {c}" for c in ["latitude", "longitude", *_LINES, "trawling"]) + " FROM days GROUP BY 1, 2)",
    neighbours_sql(_LINES, "rown", "buckets", order="epoch", extra="mmsi, epoch, latitude, longitude, trawling"),
    "lagged AS (SELECT mmsi, epoch, latitude, CAST(trunc(trawling) AS INT) AS trawling, " + ", ".join(f"{_row_line(c)} AS {c}" for c in _LINES) +
    ", lag(latitude, 5) OVER (PARTITION BY mmsi ORDER BY epoch) AS latitude_lag5 FROM nb)"))
def _(spark, sf):
    d = flows.prepare_early(messages(spark, sf, True), T, 3600, steps=3)
    return rounded(d.select("mmsi", "epoch", "sog", "rot", "trawling", "latitude_lag5", F.get("future", 2)["latitude"].alias("lat3"), "split"), 9)


@query("e4_export_with_stats", sql_with(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(CAST({c} AS FLOAT)), 4) AS mean, round(stddev_samp(CAST({c} AS FLOAT)), 4) AS std FROM msg" for c in S.MODEL_FEATURES)))
def _(spark, sf):
    return rounded(flows.export_with_stats(messages(spark, sf), new_path(spark, "export"), "v1"), 4)


@query("e5_training_sequences", sql_with("""SELECT s.mmsi, s.epoch, s.trawling AS label, CAST(r.rn - s.rn + 3 AS INT) AS pos, round((r.sog - m1) / s1, 6) AS sog, round((r.cog - m2) / s2, 6) AS cog
 FROM num s JOIN num r ON s.mmsi = r.mmsi AND r.rn BETWEEN s.rn - 3 AND s.rn, (SELECT avg(sog) AS m1, stddev_samp(sog) AS s1, avg(cog) AS m2, stddev_samp(cog) AS s2 FROM msg) WHERE s.rn >= 4""",
    "num AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY epoch, event_id) AS rn FROM msg)"))
def _(spark, sf):
    m = messages(spark, sf)
    d = flows.training_sequences(m, profile.column_stats(m, ["sog", "cog"]), T, ["sog", "cog"], "trawling", 4)
    d = d.select("mmsi", "epoch", "label", F.posexplode("sequence").alias("pos", "r")).select("mmsi", "epoch", "label", "pos", "r.sog", "r.cog")
    return rounded(d, 6)


_Z = {f: (m, s) for f, m, s in TRAIN_STATS}
_CLAMPED = {"sog": "CASE WHEN sog < 0 THEN 0 WHEN sog > 40 THEN 40 ELSE sog END", "rot": "CASE WHEN rot < -90 THEN -90 WHEN rot > 90 THEN 90 ELSE rot END"}


@query("e6_vessels_for_scoring", sql_with("SELECT mmsi, epoch, trawling, " + ", ".join(
    f"({_CLAMPED.get(c, c)} - CAST({_Z[c][0]} AS DOUBLE)) / CAST({_Z[c][1]} AS DOUBLE) AS {c}" for c in S.MODEL_FEATURES) +
    " FROM (SELECT mmsi, epoch, " + ", ".join(f"{_row_line(c)} AS {c}" for c in S.CONTINUOUS) + ", " + ", ".join(f"coalesce({c}_p, {c}_n) AS {c}" for c in S.STATIC) + " FROM nb)",
    "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, epoch ORDER BY event_id) AS rk FROM raw WHERE mobile_type = 'Class A') WHERE rk = 1)",
    grid_sql(_STEP, _ALL, "one"), neighbours_sql(_ALL, "epoch", "grid", order="epoch", extra="mmsi, epoch")))
def _(spark, sf):
    d = flows.vessels_for_scoring(messages(spark, sf, True), T, train_stats(spark), _STEP)
    return d.select("mmsi", "epoch", "trawling", *S.MODEL_FEATURES)


_POSITIONS = [
    "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, epoch ORDER BY event_id) AS rk FROM msg WHERE mobile_type = 'Class A') WHERE rk = 1)",
    grid_sql(3600, _ALL, "one"), neighbours_sql(_ALL, "epoch", "grid", order="epoch", extra="mmsi, epoch"),
    "track AS (SELECT mmsi, epoch, row_number() OVER (PARTITION BY mmsi ORDER BY epoch) - 1 AS slot_no, count(*) OVER (PARTITION BY mmsi) AS n_slots, " +
    ", ".join(_CLAMPED.get(c, c) + f" AS {c}" for c in _ALL) + " FROM (SELECT mmsi, epoch, " + ", ".join(f"{_row_line(c)} AS {c}" for c in S.CONTINUOUS) + ", " +
    ", ".join(f"coalesce({c}_p, {c}_n) AS {c}" for c in S.STATIC) + " FROM nb))",
]


def _near_sql(metres):
    """Windows whose last position (``ends``) is near a cable."""
    d = NEAR_SQL.replace("event_id", "mmsi, window_no").replace("FROM msg, seg", "FROM ends, seg").replace("near AS", "distances AS")
    return [d, f"close AS (SELECT mmsi, window_no FROM distances WHERE m <= {metres})"]


_RISK = [
    *linear_scores_sql("member", 30, "mmsi, window_no", "min(epoch) AS window_start, max(epoch) AS window_end, " + " OR ".join(f"count({c}) < 30" for c in S.MODEL_FEATURES) + " AS used_fallback",
                       {c: f"({c} - CAST({m} AS DOUBLE)) / CAST({d} AS DOUBLE)" for c, (m, d) in _Z.items()}),
    "fc AS (SELECT mmsi || '/' || window_no AS event_id, step - 1 AS i, latitude AS lat, longitude AS lon FROM ahead)",
    cross_sql(), steps_sql(3738), steps_sql(1602).replace("hit AS", "alarm AS"),
    """rated AS (SELECT s.*, s.mmsi || '/' || s.window_no AS event_id, CASE WHEN label = 0 THEN 0 WHEN crosses_zone THEN 3 WHEN inside THEN 2 ELSE 1 END AS risk_level
 FROM scored s LEFT JOIN crossing c ON c.event_id = s.mmsi || '/' || s.window_no LEFT JOIN (SELECT * FROM hit WHERE i = 0) h ON h.event_id = s.mmsi || '/' || s.window_no),
alerts AS (SELECT event_id, bool_or(inside) AS zone_alert FROM alarm GROUP BY event_id)""",
]


def _forecast_rows(d, *names):
    """One row per forecast position, or one without where there is no forecast."""
    d = d.select(*names, F.size("input").alias("positions"), F.posexplode_outer("forecast").alias("step", "_p"))
    return d.select(*names, "positions", (F.col("step") + 1).alias("step"), F.round("_p.latitude", 6).alias("latitude"), F.round("_p.longitude", 6).alias("longitude"))


@query("e7_cable_risk", sql_with("""SELECT r.mmsi, r.window_no, window_start, window_end, round(probability, 4) AS fishing_confidence, CAST(risk_level AS INT) AS risk_level, zone_alert, used_fallback,
 CAST(30 AS INT) AS positions, step, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM rated r JOIN ahead a ON a.mmsi = r.mmsi AND a.window_no = r.window_no JOIN alerts t ON t.event_id = r.event_id WHERE label = 1""",
    SEG_SQL, *_POSITIONS, "ends AS (SELECT mmsi, (slot_no - 29) // 10 AS window_no, latitude, longitude FROM track WHERE slot_no >= 29 AND (slot_no - 29) % 10 = 0)", *_near_sql("3738"),
    "member AS (SELECT k.*, c.window_no, slot_no - 10 * c.window_no + 1 AS pos FROM track k JOIN close c ON c.mmsi = k.mmsi AND k.slot_no BETWEEN 10 * c.window_no AND 10 * c.window_no + 29)", *_RISK))
def _(spark, sf):
    d = flows.cable_risk(messages(spark, sf), T, segments(spark), train_stats(spark), load_linear_models, 3600, 30, 10)
    return _forecast_rows(d, "mmsi", "window_no", "window_start", "window_end", "fishing_confidence", "risk_level", "zone_alert", "used_fallback")


@query("e7b_latest_risk", sql_with("""SELECT v.mmsi, v.status, v.window_start, v.window_end, label, round(logit, 6) AS logit, round(probability, 6) AS probability, CASE WHEN label = 1 THEN zone_alert END AS zone_alert,
 CAST(risk_level AS INT) AS risk_level, used_fallback, CASE WHEN v.status = 'scored' THEN CAST(30 AS INT) ELSE CAST(NULL AS INT) END AS positions, step, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude
 FROM vessels v LEFT JOIN rated r ON r.mmsi = v.mmsi LEFT JOIN ahead a ON a.mmsi = r.mmsi LEFT JOIN alerts t ON t.event_id = r.event_id""",
    SEG_SQL, *_POSITIONS, "ends AS (SELECT mmsi, 0 AS window_no, latitude, longitude FROM track WHERE slot_no = n_slots - 1)", *_near_sql("20000"),
    """vessels AS (SELECT k.mmsi, CASE WHEN count(*) < 30 THEN 'too few rows' WHEN bool_or(c.mmsi IS NOT NULL) THEN 'scored' ELSE 'not near a cable' END AS status, min(epoch) AS window_start, max(epoch) AS window_end
 FROM track k LEFT JOIN close c ON c.mmsi = k.mmsi WHERE slot_no >= n_slots - 30 GROUP BY k.mmsi)""",
    "member AS (SELECT k.*, 0 AS window_no, slot_no - n_slots + 31 AS pos FROM track k JOIN vessels v ON v.mmsi = k.mmsi AND v.status = 'scored' WHERE slot_no >= n_slots - 30)", *_RISK))
def _(spark, sf):
    d = flows.latest_risk(messages(spark, sf), T, segments(spark), train_stats(spark), load_linear_models, 3600, 30, near_m=20_000.0)
    d = d.withColumns({"logit": F.round("logit", 6), "probability": F.round("probability", 6), "input": F.col("input")})
    out = _forecast_rows(d, "mmsi", "status", "window_start", "window_end", "label", "logit", "probability", "zone_alert", "risk_level", "used_fallback")
    return out.withColumn("positions", F.nullif("positions", F.lit(-1)))


@query("e9_corruption_counts", sql_with(variants_sql(lambda name, rows, lost, _: f"SELECT '{name}' AS corruption, count(*) AS rows, count(*) FILTER (label = 1 AND NOT {lost}) AS positive_rows FROM {rows}",
                                                     clean=True), *VARIANT_VIEWS))
def _(spark, sf):
    marks = degrade.corruption_marks(trajectories(spark, sf), LEVELS, ["event_id"], S.MISSING_SHARES)
    return degrade.variant_counts(marks, LEVELS)


@query("e9b_robustness_study")
def _(spark, sf):
    d = split.split_rows(trajectories(spark, sf), "trajectory_id", "label", 0.7, 0.1)
    tree = {"decision_tree": models.classifiers("label")["decision_tree"]}
    return rounded(flows.robustness_study(d.where("split = 'train'"), d.where("split = 'test'"), ["event_id"], FEATURES, S.MISSING_SHARES, [20], tree), 6)


@query("e8_degradation_study")
def _(spark, sf):
    d = flows.degradation_study(
        trajectories(spark, sf), TRACK, ["event_id"], FEATURES, S.MISSING_SHARES, lags=(1, 2), horizon=3,
        irregular=True, missing=True, impute="linear", duplicates=True,
    )
    return rounded(d, 6)
