"""Queries over tracks: windows of rows and time, interpolation, sequences, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatrack import schema as S
from seatrack.fixtures import messages, sql_with
from seatrack.operators import clean, resample, series
from seatrack.operators.ordered import Track
from seatrack.plans.q_profile import window_check_sql
from seatrack.plans.registry import query, rounded

T = Track(tie=("event_id",))
W = "WINDOW w AS (PARTITION BY mmsi ORDER BY epoch, event_id)"
HOUR = 3600


@query("w1_gap_seconds", sql_with(f"SELECT event_id, lag(epoch) OVER w AS prev_epoch, epoch - lag(epoch) OVER w AS gap_s FROM msg {W}"))
def _(spark, sf):
    return series.gap_seconds(messages(spark, sf), T).select("event_id", "prev_epoch", "gap_s")


TRIP_SQL = """trips AS (SELECT event_id, mmsi, epoch, latitude, longitude, CAST(sum(brk) OVER (PARTITION BY mmsi ORDER BY epoch, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trajectory_no
 FROM (SELECT *, CASE WHEN epoch - lag(epoch) OVER w > 86400 THEN 1 ELSE 0 END AS brk FROM msg WINDOW w AS (PARTITION BY mmsi ORDER BY epoch, event_id)))"""


@query("w2_trajectory_ids", sql_with("SELECT event_id, mmsi, trajectory_no FROM trips", TRIP_SQL))
def _(spark, sf):
    return series.trajectory_ids(messages(spark, sf), T, 86400).select("event_id", "mmsi", "trajectory_no")


def _future_sql(n, source="msg", key="mmsi"):
    leads = ", ".join(f"lead(latitude, {i}) OVER w AS a{i}, lead(longitude, {i}) OVER w AS o{i}" for i in range(1, n + 1))
    return f"fut AS (SELECT event_id, {leads} FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY epoch, event_id))"


def _long_future_sql(n, where):
    return " UNION ALL ".join(
        f"SELECT event_id, {i - 1} AS step, a{i} AS latitude, o{i} AS longitude FROM fut WHERE {where} AND a{i} IS NOT NULL" for i in range(1, n + 1))


def _steps(d):
    p = d.select("event_id", F.posexplode("future").alias("step", "p"))
    return p.select("event_id", "step", "p.latitude", "p.longitude")


@query("w3_forecasting_target", sql_with(_long_future_sql(5, "a5 IS NOT NULL"), _future_sql(5)))
def _(spark, sf):
    return _steps(series.forecasting_target(messages(spark, sf), T, 5))


@query("w3b_forecasting_target_break", sql_with(_long_future_sql(3, "a3 IS NOT NULL"), TRIP_SQL, _future_sql(3, "trips", "mmsi, trajectory_no")))
def _(spark, sf):
    return _steps(series.forecasting_target(messages(spark, sf), T, 3, 86400, break_on_gap=True))


@query("w4_lagged_positions", sql_with(f"""SELECT event_id, a1 AS latitude_lag1, o1 AS longitude_lag1, a5 AS latitude_lag5, o5 AS longitude_lag5 FROM (
 SELECT event_id, lag(latitude) OVER w AS a1, lag(longitude) OVER w AS o1, lag(latitude, 5) OVER w AS a5, lag(longitude, 5) OVER w AS o5 FROM msg {W}) WHERE a5 IS NOT NULL"""))
def _(spark, sf):
    d = series.lag_columns(messages(spark, sf), T, ["latitude", "longitude"], [1, 5])
    return d.select("event_id", "latitude_lag1", "longitude_lag1", "latitude_lag5", "longitude_lag5")


@query("w5_future_positions", sql_with(_long_future_sql(10, "TRUE"), _future_sql(10)))
def _(spark, sf):
    return _steps(series.future_positions(messages(spark, sf), T, 10))


def _row_interp(c):
    return f"""CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_p IS NOT NULL AND {c}_n IS NOT NULL
 THEN {c}_p + ({c}_n - {c}_p) * ((rn - {c}_rp) / ({c}_rn - {c}_rp)::DOUBLE) ELSE coalesce({c}_p, {c}_n) END"""


def neighbours_sql(columns, pos, source, name="nb", key="mmsi", order="epoch, event_id", extra="event_id, mmsi, epoch"):
    """Known neighbours of every row by position."""
    inner = ", ".join(
        f"""{c}, last_value({c} IGNORE NULLS) OVER b AS {c}_p, last_value(CASE WHEN {c} IS NOT NULL THEN {pos} END IGNORE NULLS) OVER b AS {c}_rp,
 first_value({c} IGNORE NULLS) OVER f AS {c}_n, first_value(CASE WHEN {c} IS NOT NULL THEN {pos} END IGNORE NULLS) OVER f AS {c}_rn""" for c in columns)
    return f"""{name} AS (SELECT {extra}, {pos} AS rn, {inner} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rown FROM {source})
 WINDOW b AS (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 f AS (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


_I = ["rot", "sog", "draught"]


@query("w6_interpolate_row", sql_with("SELECT event_id, " + ", ".join(f"{_row_interp(c)} AS {c}" for c in _I) + " FROM nb", neighbours_sql(_I, "rown", "msg")))
def _(spark, sf):
    return series.interpolate(messages(spark, sf), T, _I, by="row").select("event_id", *_I)


def _time_interp(c, limit):
    return f"""CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_rn - {c}_rp <= {limit} THEN {c}_p + ({c}_n - {c}_p) * ((rn - {c}_rp) / ({c}_rn - {c}_rp)::DOUBLE) END"""


@query("w7_interpolate_time", sql_with("SELECT event_id, " + ", ".join(f"{_time_interp(c, 21600)} AS {c}" for c in S.CONTINUOUS) + " FROM nb", neighbours_sql(S.CONTINUOUS, "epoch", "msg")))
def _(spark, sf):
    d = series.interpolate_time(messages(spark, sf), T, S.CONTINUOUS, 21600)
    return d.select("event_id", *S.CONTINUOUS)


@query("w7b_interpolate_time_unlimited", sql_with("SELECT event_id, " + ", ".join(f"{_time_interp(c, 10**12)} AS {c}" for c in ["sog", "cog"]) + " FROM nb", neighbours_sql(["sog", "cog"], "epoch", "msg")))
def _(spark, sf):
    d = series.interpolate_time(messages(spark, sf), T, ["sog", "cog"], None)
    return d.select("event_id", "sog", "cog")


_FF = ["width", "length", "trawling", "rot", "heading", "draught"]


@query("w8_forward_fill", sql_with("SELECT event_id, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER b AS {c}" for c in _FF) + " FROM msg WINDOW b AS (PARTITION BY mmsi ORDER BY epoch, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def _(spark, sf):
    return series.forward_fill(messages(spark, sf), T, _FF).select("event_id", *_FF)


@query("w9_fill_both_ways", sql_with("SELECT event_id, coalesce(length_p, length_n) AS length, coalesce(draught_p, draught_n) AS draught FROM nb", neighbours_sql(["length", "draught"], "epoch", "msg")))
def _(spark, sf):
    return series.fill_both_ways(messages(spark, sf), T, ["length", "draught"]).select("event_id", "length", "draught")


@query("w10_lag_features", sql_with(f"""SELECT event_id, latitude_lag1, latitude_lag3, cog_lag1, cog_lag3, cog FROM (SELECT event_id, cog, lag(latitude, 1) OVER w AS latitude_lag1, lag(latitude, 3) OVER w AS latitude_lag3,
 lag(cog, 1) OVER w AS cog_lag1, lag(cog, 3) OVER w AS cog_lag3 FROM msg {W}) WHERE latitude_lag3 IS NOT NULL AND cog_lag1 IS NOT NULL AND cog_lag3 IS NOT NULL AND cog IS NOT NULL"""))
def _(spark, sf):
    d = messages(spark, sf).select("mmsi", "epoch", "event_id", "latitude", "cog")
    d = series.lag_columns(d, T, ["latitude", "cog"], [1, 3], drop="any")
    return d.select("event_id", "latitude_lag1", "latitude_lag3", "cog_lag1", "cog_lag3", "cog")


@query("w11_future_value", sql_with(f"""SELECT * FROM (SELECT event_id, sog, lead(latitude, 5) OVER w AS latitude_future5, lead(longitude, 5) OVER w AS longitude_future5 FROM msg {W})
 WHERE latitude_future5 IS NOT NULL AND sog IS NOT NULL"""))
def _(spark, sf):
    d = messages(spark, sf).select("mmsi", "epoch", "event_id", "latitude", "longitude", "sog")
    d = series.future_value(d, T, horizon=5)
    return d.select("event_id", "sog", "latitude_future5", "longitude_future5")


ROWS_SQL = "num AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY epoch, event_id) AS rn, count(*) OVER (PARTITION BY mmsi) AS n FROM msg)"


@query("w12_sliding_windows", sql_with("""SELECT s.mmsi, CAST((s.rn - 1) // 2 AS BIGINT) AS window_no, s.epoch AS window_start, CAST(r.rn - s.rn AS INT) AS pos, r.epoch, r.sog
 FROM num s JOIN num r ON s.mmsi = r.mmsi AND r.rn BETWEEN s.rn AND s.rn + 4 WHERE (s.rn - 1) % 2 = 0 AND s.rn + 4 <= s.n""", ROWS_SQL))
def _(spark, sf):
    d = series.sliding_windows(messages(spark, sf), T, ["sog"], 5, 2)
    return d.select("mmsi", "window_no", "window_start", F.posexplode("window").alias("pos", "r")).select(
        "mmsi", "window_no", "window_start", "pos", "r.epoch", "r.sog")


@query("w13_sequences", sql_with("""SELECT s.mmsi, s.epoch, s.trawling AS label, CAST(r.rn - s.rn + 3 AS INT) AS pos, r.sog, r.cog
 FROM num s JOIN num r ON s.mmsi = r.mmsi AND r.rn BETWEEN s.rn - 3 AND s.rn WHERE s.rn >= 4""", ROWS_SQL))
def _(spark, sf):
    d = series.sequences(messages(spark, sf), T, ["sog", "cog"], "trawling", 4)
    return d.select("mmsi", "epoch", "label", F.posexplode("sequence").alias("pos", "r")).select("mmsi", "epoch", "label", "pos", "r.sog", "r.cog")


def _stats_sql(features, size, reach, targets, label):
    agg = ", ".join(
        f"round(avg(r.{f}), 9) AS {f}_mean, round(median(r.{f}), 9) AS {f}_median, min(r.{f}) AS {f}_min, max(r.{f}) AS {f}_max, round(stddev_samp(r.{f}), 9) AS {f}_std" for f in features)
    tgt = "".join(f", max(t.{t}) AS {t}_target" for t in targets)
    join = f" LEFT JOIN num t ON t.mmsi = s.mmsi AND t.rn = s.rn + {reach}" if targets else ""
    return f"""SELECT s.mmsi, s.epoch AS window_start, max(r.epoch) AS window_end, {agg}, CASE WHEN count(*) FILTER (r.{label} = 1) > count(*) FILTER (r.{label} = 0) THEN 1 ELSE 0 END AS label{tgt}
 FROM num s JOIN num r ON r.mmsi = s.mmsi AND r.rn BETWEEN s.rn AND s.rn + {size - 1}{join} WHERE s.rn + {reach} <= s.n AND (s.rn - 1) % 2 = 0 GROUP BY s.mmsi, s.epoch, s.rn"""


@query("w14_window_features", sql_with(_stats_sql(["sog", "draught"], 6, 9, ["latitude"], "trawling"), ROWS_SQL))
def _(spark, sf):
    d = series.window_features(messages(spark, sf), T, ["sog", "draught"], ["latitude"], "trawling", 6, 2, 4)
    return d.withColumns({c: F.round(c, 9) for c in d.columns if c.startswith(("sog_", "draught_"))})


@query("w14b_window_features_plain", sql_with(_stats_sql(["sog", "cog"], 5, 4, [], "trawling"), ROWS_SQL))
def _(spark, sf):
    return rounded(series.window_features(messages(spark, sf), T, ["sog", "cog"], [], "trawling", 5, 2))


@query("w15_majority_sequences", sql_with("""SELECT w.mmsi, w.epoch, w.label, CAST(r.rn - w.rn AS INT) AS pos, r.sog FROM (SELECT s.mmsi, s.epoch, s.rn, CAST(round_even(avg(r.label), 0) AS INT) AS label FROM lab s JOIN lab r ON r.mmsi = s.mmsi AND r.rn BETWEEN s.rn AND s.rn + 3
 WHERE s.rn + 3 <= s.n GROUP BY s.mmsi, s.epoch, s.rn HAVING count(r.label) = 4) w JOIN lab r ON r.mmsi = w.mmsi AND r.rn BETWEEN w.rn AND w.rn + 3""", ROWS_SQL, "lab AS (SELECT *, CASE WHEN event_id % 19 <> 0 THEN trawling END AS label FROM num)"))
def _(spark, sf):
    m = messages(spark, sf).withColumn("label", F.when(F.col("event_id") % 19 != 0, F.col("trawling")))
    d = series.majority_sequences(m, T, ["sog"], "label", 4)
    return d.select("mmsi", "epoch", "label", F.posexplode("sequence").alias("pos", "_r")).select("mmsi", "epoch", "label", "pos", "_r.sog")


@query("w16_delayed_sequences", sql_with("""SELECT s.mmsi, s.epoch, t.latitude AS latitude_target, CAST(r.rn - s.rn AS INT) AS pos, r.longitude FROM num s JOIN num r ON r.mmsi = s.mmsi AND r.rn BETWEEN s.rn AND s.rn + 3
 JOIN num t ON t.mmsi = s.mmsi AND t.rn = s.rn + 7""", ROWS_SQL))
def _(spark, sf):
    d = series.delayed_sequences(messages(spark, sf), T, ["longitude"], ["latitude"], 4, 3)
    return d.select("mmsi", "epoch", "latitude_target", F.posexplode("sequence").alias("pos", "_r")).select(
        "mmsi", "epoch", "latitude_target", "pos", "_r.longitude")


@query("w17_lookback_positions", sql_with("""SELECT s.mmsi, s.epoch, CAST((r.rn - s.rn + 3) * 2 + o.o AS INT) AS pos, CASE o.o WHEN 0 THEN r.latitude ELSE r.longitude END AS value, t.latitude AS latitude_target FROM num s JOIN num r ON r.mmsi = s.mmsi AND r.rn BETWEEN s.rn - 3 AND s.rn - 1
 JOIN num t ON t.mmsi = s.mmsi AND t.rn = s.rn + 1 CROSS JOIN (VALUES (0), (1)) o(o) WHERE s.rn > 3""", ROWS_SQL))
def _(spark, sf):
    d = series.lookback_positions(messages(spark, sf), T, lookback=3)
    return d.select("mmsi", "epoch", "latitude_target", F.posexplode("past").alias("pos", "value"))


@query("w18_check_windows", sql_with("SELECT mmsi, window_no, window_start, rows, reason FROM checked", window_check_sql(5, 2, S.MODEL_FEATURES, True)))
def _(spark, sf):
    return series.check_windows(messages(spark, sf), T, 5, 2, partial=True)


@query("w19_last_rows_span", sql_with("""SELECT mmsi, count(*) AS rows, min(epoch) AS from_epoch, max(epoch) AS to_epoch, max(epoch) - min(epoch) AS span_s FROM (
 SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY epoch DESC, event_id DESC) AS rk FROM msg) WHERE rk <= 30 GROUP BY mmsi"""))
def _(spark, sf):
    return series.last_rows_span(messages(spark, sf), T, 30)


# --- resampling ---------------------------------------------------------------------------------


@query("r1_bucket_mean", sql_with("SELECT mmsi, CAST(floor(epoch / 3600) * 3600 AS BIGINT) AS epoch, round(avg(sog), 9) AS sog, round(avg(cog), 9) AS cog, round(avg(trawling), 9) AS trawling FROM msg GROUP BY 1, 2"))
def _(spark, sf):
    return rounded(resample.bucket_mean(messages(spark, sf), T, ["sog", "cog", "trawling"], HOUR))


@query("r2_bucket_first", sql_with("""SELECT mmsi, CAST(floor(epoch / 86400) * 86400 AS BIGINT) AS epoch, event_id, sog FROM (
 SELECT *, row_number() OVER (PARTITION BY mmsi, floor(epoch / 86400) ORDER BY epoch, event_id) AS rk FROM msg) WHERE rk = 1"""))
def _(spark, sf):
    return resample.bucket_first(messages(spark, sf), T, 86400).select("mmsi", "epoch", "event_id", "sog")


def grid_sql(step, columns, source="msg"):
    """First message per slot on a complete grid per vessel."""
    cols = ", ".join(f"s.{c}" for c in columns)
    return f"""slot1 AS (SELECT * EXCLUDE (epoch), CAST(floor(epoch / {step}) * {step} AS BIGINT) AS epoch FROM (
 SELECT *, row_number() OVER (PARTITION BY mmsi, floor(epoch / {step}) ORDER BY epoch, event_id) AS sk FROM {source}) WHERE sk = 1),
grid AS (SELECT g.mmsi, g.epoch, {cols} FROM (SELECT mmsi, unnest(range(lo, hi + 1, {step})) AS epoch FROM (SELECT mmsi, min(epoch) AS lo, max(epoch) AS hi FROM slot1 GROUP BY mmsi)) g
 LEFT JOIN slot1 s ON s.mmsi = g.mmsi AND s.epoch = g.epoch)"""


@query("r3_fixed_grid", sql_with("SELECT mmsi, epoch, event_id, sog FROM grid", grid_sql(HOUR, ["event_id", "sog"])))
def _(spark, sf):
    d = messages(spark, sf).select("mmsi", "epoch", "event_id", "sog")
    return resample.to_fixed_grid(d, T, HOUR).select("mmsi", "epoch", "event_id", "sog")


@query("r3b_fixed_grid_keep", sql_with("""SELECT g.mmsi, g.epoch, s.event_id FROM (SELECT mmsi, unnest(range(lo, hi + 1, 21600)) AS epoch FROM (SELECT mmsi, min(epoch) AS lo, max(epoch) AS hi FROM al GROUP BY mmsi)) g
 LEFT JOIN al s ON s.mmsi = g.mmsi AND s.epoch = g.epoch""", "al AS (SELECT mmsi, event_id, CAST(floor(epoch / 21600) * 21600 AS BIGINT) AS epoch FROM msg)"))
def _(spark, sf):
    d = messages(spark, sf).select("mmsi", "epoch", "event_id")
    return resample.to_fixed_grid(d, T, 21600, on_collision="keep").select("mmsi", "epoch", "event_id")


@query("r4_downsample_first", sql_with("""SELECT mmsi, CAST(floor(epoch / 43200) * 43200 AS BIGINT) AS epoch, arg_min(sog, epoch * 1000000000 + event_id) FILTER (sog IS NOT NULL) AS sog,
 arg_min(rot, epoch * 1000000000 + event_id) FILTER (rot IS NOT NULL) AS rot FROM msg GROUP BY 1, 2 HAVING count(sog) > 0 AND count(rot) > 0"""))
def _(spark, sf):
    return resample.downsample_first(messages(spark, sf), T, ["sog", "rot"], 43200)


@query("r4b_downsample_first_origin", sql_with("""SELECT m.mmsi, o + CAST(floor((epoch - o) / 35000) * 35000 AS BIGINT) AS epoch, arg_min(sog, epoch * 1000000000 + event_id) FILTER (sog IS NOT NULL) AS sog
 FROM msg m JOIN (SELECT mmsi, CAST(floor(min(epoch) / 86400) * 86400 AS BIGINT) AS o FROM msg GROUP BY mmsi) x ON x.mmsi = m.mmsi GROUP BY 1, 2 HAVING count(sog) > 0"""))
def _(spark, sf):
    return resample.downsample_first(messages(spark, sf), T, ["sog"], 35000)


QUARTER = "qm AS (SELECT * EXCLUDE (epoch), CAST(floor(epoch / 900) * 900 AS BIGINT) AS epoch FROM msg)"


def exact_sql(step, columns):
    cols = ", ".join(f"h.{c}" for c in columns)
    return f"""u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, epoch ORDER BY event_id) AS uk FROM qm) WHERE uk = 1),
xg AS (SELECT g.mmsi, g.epoch, {cols} FROM (SELECT b.mmsi, unnest(range(lo, hi + 1, {step})) AS epoch FROM (SELECT mmsi, min(epoch) AS lo FROM u WHERE epoch % {step} = 0 GROUP BY mmsi) a
 JOIN (SELECT mmsi, CAST(floor(max(epoch) / {step}) * {step} AS BIGINT) AS hi FROM u GROUP BY mmsi) b ON a.mmsi = b.mmsi) g
 LEFT JOIN u h ON h.mmsi = g.mmsi AND h.epoch = g.epoch)"""


def _quarter(spark, sf):
    return clean.floor_epoch(messages(spark, sf).select("mmsi", "epoch", "event_id", "sog", "cog", "draught", "trawling"), 900)


_RI = ["sog", "cog"]


def _line_sql(c, tail):
    return f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_p IS NOT NULL AND {c}_n IS NOT NULL THEN {c}_p + ({c}_n - {c}_p) * ((rn - {c}_rp) / ({c}_rn - {c}_rp)::DOUBLE) ELSE {tail} END"


@query("r5_resample_linear", sql_with("""SELECT mmsi, epoch, sog, cog, label FROM (SELECT mmsi, epoch, """ + ", ".join(f"{_line_sql(c, f'{c}_p')} AS {c}" for c in _RI) +
    ", coalesce(trawling_p, trawling_n) AS label FROM nb) WHERE sog IS NOT NULL AND cog IS NOT NULL AND label IS NOT NULL",
    QUARTER, exact_sql(1800, [*_RI, "trawling"]), neighbours_sql([*_RI, "trawling"], "epoch", "xg", order="epoch", extra="mmsi, epoch")))
def _(spark, sf):
    d = _quarter(spark, sf).withColumnRenamed("trawling", "label")
    return resample.resample_linear(d, T, _RI, 1800)


_MODE = """modes AS (SELECT mmsi, trawling AS label FROM (SELECT mmsi, trawling, row_number() OVER (PARTITION BY mmsi ORDER BY count(*) DESC, trawling) AS rk FROM qm GROUP BY mmsi, trawling) WHERE rk = 1)"""


def _mode_body(extra=""):
    return "SELECT n.mmsi, n.epoch, " + ", ".join(f"{_line_sql(c, f'coalesce({c}_p, {c}_n)')} AS {c}" for c in _RI) + f", label{extra} FROM nb n JOIN modes m ON m.mmsi = n.mmsi WHERE coalesce(sog_p, sog_n, cog_p, cog_n) IS NOT NULL"


def _interval_body(step):
    nb = neighbours_sql(_RI, "epoch", "xg", order="epoch", extra="mmsi, epoch")
    return f"(WITH {exact_sql(step, _RI)},\n{nb}\n{_mode_body(f', {step} AS interval_s')})"


@query("r6_resample_with_mode", sql_with(_mode_body(), QUARTER, _MODE, exact_sql(1800, _RI), neighbours_sql(_RI, "epoch", "xg", order="epoch", extra="mmsi, epoch")))
def _(spark, sf):
    d = _quarter(spark, sf).withColumnRenamed("trawling", "label")
    return resample.resample_with_mode(d, T, _RI, 1800)


@query("r7_upsample", sql_with(f"SELECT * FROM {_interval_body(900)} UNION ALL SELECT * FROM {_interval_body(2700)}", QUARTER, _MODE))
def _(spark, sf):
    d = _quarter(spark, sf).withColumnRenamed("trawling", "label")
    return resample.upsample(d, T, _RI, (900, 2700))


_SC, _SS = ["sog", "rot", "latitude"], ["width", "length"]


@query("r8_scoring_grid", sql_with("""SELECT mmsi, epoch, CASE WHEN sog < 0 THEN 0 WHEN sog > 40 THEN 40 ELSE sog END AS sog, CASE WHEN rot < -90 THEN -90 WHEN rot > 90 THEN 90 ELSE rot END AS rot,
 latitude, width, length FROM (SELECT mmsi, epoch, """ + ", ".join(f"{_line_sql(c, f'coalesce({c}_p, {c}_n)')} AS {c}" for c in _SC) +
    ", " + ", ".join(f"coalesce({c}_p, {c}_n) AS {c}" for c in _SS) + " FROM nb)", grid_sql(HOUR, [*_SC, *_SS]), neighbours_sql([*_SC, *_SS], "epoch", "grid", order="epoch", extra="mmsi, epoch")))
def _(spark, sf):
    return resample.scoring_grid(messages(spark, sf), T, HOUR, continuous=_SC, static=_SS)
