"""Queries over filters, projections, joins, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatrack import schema as S
from seatrack.fixtures import messages, sql_with
from seatrack.operators import clean, joins, profile, series
from seatrack.operators.ordered import Track
from seatrack.operators.resample import time_grid
from seatrack.operators.split import assign_splits, union_splits
from seatrack.plans.registry import query, rounded

T = Track(tie=("event_id",))
COLS = "event_id, mmsi, epoch, latitude, longitude"
_C = COLS.split(", ")


@query("p1_drop_duplicates", sql_with("SELECT DISTINCT * EXCLUDE (ts) FROM raw"))
def _(spark, sf):
    return clean.drop_duplicates(messages(spark, sf, True).drop("ts"))


@query("p2_dedup_on_key", sql_with(
    "SELECT event_id, mmsi, epoch, sog, trawling FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, ts ORDER BY event_id) AS rk FROM raw) WHERE rk = 1"))
def _(spark, sf):
    d = clean.dedup_on_key(messages(spark, sf, True), ["mmsi", "ts"], ["event_id"])
    return d.select("event_id", "mmsi", "epoch", "sog", "trawling")


@query("p3_drop_unknown_gear", sql_with(f"SELECT {COLS}, gear_type FROM msg WHERE gear_type NOT IN ('UNKNOWN', 'INCONCLUSIVE')"))
def _(spark, sf):
    return clean.drop_unknown_gear(messages(spark, sf)).select(*_C, "gear_type")


@query("p4_drop_class_b", sql_with(f"SELECT {COLS}, mobile_type FROM msg WHERE mobile_type <> 'Class B'"))
def _(spark, sf):
    return clean.drop_class_b(messages(spark, sf)).select(*_C, "mobile_type")


@query("p4b_keep_class_a", sql_with(f"SELECT {COLS}, mobile_type FROM msg WHERE mobile_type = 'Class A'"))
def _(spark, sf):
    return clean.drop_class_b(messages(spark, sf), "class_a").select(*_C, "mobile_type")


@query("p5_keep_ship_type", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return clean.keep_ship_type(c, "BUILDING", "c_mktsegment").select("c_custkey", "c_name", "c_mktsegment")


@query("p6_date_range", sql_with(
    f"SELECT {COLS} FROM msg WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'"))
def _(spark, sf):
    return clean.date_range(messages(spark, sf), "2024-01-05", "2024-01-12").select(*_C)


@query("p7_pick_vessels", sql_with(f"SELECT {COLS} FROM msg WHERE mmsi IN (219000004, 219000010)"))
def _(spark, sf):
    return clean.pick_vessels(messages(spark, sf), [219000004, 219000010]).select(*_C)


@query("p8_relevant_columns", sql_with(
    "SELECT mmsi, epoch, width, length, trawling, latitude, longitude, rot, sog, cog, heading, draught FROM msg"))
def _(spark, sf):
    return clean.relevant_columns(messages(spark, sf), ["mmsi", "epoch", *S.STATIC, *S.CONTINUOUS])


@query("p9_drop_features", sql_with("SELECT * EXCLUDE (ts, mobile_type, nav_status, imo, width, length) FROM msg"))
def _(spark, sf):
    return clean.drop_features(messages(spark, sf), ["ts", "mobile_type", "nav_status", "imo", "width", "length"])


@query("p10_label_to_int", sql_with(
    "SELECT mmsi, CAST(floor(epoch / 86400) AS BIGINT) AS day, CAST(trunc(avg(trawling)) AS INT) AS trawling FROM msg GROUP BY ALL"))
def _(spark, sf):
    d = messages(spark, sf).groupBy("mmsi", F.floor(F.col("epoch") / 86400).alias("day")).agg(F.avg("trawling").alias("trawling"))
    return clean.label_to_int(d)


@query("p11_split_inputs", sql_with("SELECT * EXCLUDE (mmsi, ts, trawling) FROM msg"))
def _(spark, sf):
    x, y = clean.split_inputs(messages(spark, sf), forecasting=False)
    assert y.columns == ["trawling"]
    return x


@query("p11b_split_inputs_forecast", sql_with("""SELECT * EXCLUDE (mmsi, ts, trawling, whole) FROM (
 SELECT *, lead(longitude, 2) OVER w AS whole
 FROM msg WINDOW w AS (PARTITION BY mmsi ORDER BY epoch, event_id)) WHERE whole IS NOT NULL"""))
def _(spark, sf):
    d = series.forecasting_target(messages(spark, sf), T, steps=2)
    d = series.wide_future(d, 2, prefix=("y_lat_", "y_lon_"))
    x, y = clean.split_inputs(d, steps=2)
    assert y.columns == ["y_pair_1", "y_pair_2"]
    return x


@query("p12_label_trawling", sql_with(
    "SELECT event_id, CASE WHEN nav_status = 'Engaged in fishing' AND gear_type = 'TRAWLERS' THEN 1 ELSE 0 END AS label FROM msg"))
def _(spark, sf):
    return clean.label_trawling(messages(spark, sf), "label").select("event_id", "label")


@query("p13_standardize_date", "SELECT o_orderkey, substring(replace(CAST(o_orderdate AS VARCHAR), '-', '/'), 1, 10) AS order_day FROM orders")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("string").alias("order_day"))
    return clean.standardize_date(o, "order_day")


@query("p14_round_timestamps", sql_with("SELECT event_id, CAST(floor(epoch / 10) * 10 AS BIGINT) AS epoch FROM msg"))
def _(spark, sf):
    return clean.floor_epoch(messages(spark, sf), 10).select("event_id", "epoch")


@query("p15_clamp", sql_with("""SELECT event_id, CASE WHEN sog < 0 THEN 0.0::DOUBLE WHEN sog > 40 THEN 40.0::DOUBLE ELSE sog END AS sog,
 CASE WHEN rot < -90 THEN -90.0::DOUBLE WHEN rot > 90 THEN 90.0::DOUBLE ELSE rot END AS rot FROM msg"""))
def _(spark, sf):
    return clean.clamp(messages(spark, sf)).select("event_id", "sog", "rot")


def _skew_sql(columns):
    return ", ".join(
        f"(SELECT sqrt(n::DOUBLE) * s3 / pow(s2, 1.5) FROM (SELECT count(*) AS n, sum(pow({c} - m, 3)) AS s3, sum(pow({c} - m, 2)) AS s2 "
        f"FROM msg, (SELECT avg({c}) AS m FROM msg) WHERE {c} IS NOT NULL)) AS sk_{c}" for c in columns
    )


@query("p16_reduce_skewness", sql_with(
    """SELECT event_id, round(CASE WHEN abs(sk_sog) > 1 THEN ln(1 + sog) ELSE sog END, 6) AS sog,
 round(CASE WHEN abs(sk_draught) > 1 THEN ln(1 + draught) ELSE draught END, 6) AS draught,
 round(CASE WHEN abs(sk_rot) > 1 THEN CASE WHEN rot >= 0 THEN ln(1 + rot) ELSE -ln(1 - rot) END ELSE rot END, 6) AS rot
 FROM msg, sk""", f"sk AS (SELECT {_skew_sql(['sog', 'draught', 'rot'])})"))
def _(spark, sf):
    return rounded(clean.reduce_skewness(messages(spark, sf)).select("event_id", "sog", "draught", "rot"), 6)


_STATS_SQL = "stats AS (SELECT {}  FROM msg)".format(
    ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in S.CONTINUOUS)
)


@query("p17_normalize", sql_with(
    "SELECT event_id, trawling, " + ", ".join(f"round(({c} - {c}_mean) / {c}_std, 6) AS {c}" for c in S.CONTINUOUS) + " FROM msg, stats", _STATS_SQL))
def _(spark, sf):
    m = messages(spark, sf)
    d = clean.normalize(m, profile.column_stats(m, S.CONTINUOUS), S.CONTINUOUS, exclude=["trawling"])
    return rounded(d.select("event_id", "trawling", *S.CONTINUOUS), 6)


@query("p18_denormalize", sql_with(
    "SELECT event_id, round(latitude * latitude_std + latitude_mean, 6) AS latitude, round(longitude * longitude_std + longitude_mean, 6) AS longitude FROM msg, stats", _STATS_SQL))
def _(spark, sf):
    m = messages(spark, sf)
    d = clean.denormalize(m, profile.column_stats(m, S.POSITION_FEATURES), S.POSITION_FEATURES)
    return rounded(d.select("event_id", "latitude", "longitude"), 6)


@query("p19_complete_numeric_rows", sql_with(
    "SELECT event_id, gear_type FROM msg WHERE rot IS NOT NULL AND sog IS NOT NULL AND cog IS NOT NULL AND heading IS NOT NULL AND draught IS NOT NULL AND length IS NOT NULL"))
def _(spark, sf):
    return clean.complete_numeric_rows(messages(spark, sf)).select("event_id", "gear_type")


@query("p20_require_full_future", sql_with("""SELECT event_id, mmsi FROM (SELECT event_id, mmsi, lead(event_id, 4) OVER (PARTITION BY mmsi ORDER BY epoch, event_id) AS nx FROM msg) WHERE nx IS NOT NULL"""))
def _(spark, sf):
    d = series.future_positions(messages(spark, sf), T, 4)
    return clean.require_full_future(d, 4).select("event_id", "mmsi")


@query("p21_complete_rows", sql_with("SELECT event_id, sog, cog FROM msg WHERE sog IS NOT NULL AND cog IS NOT NULL"))
def _(spark, sf):
    return clean.complete_rows(messages(spark, sf).select("event_id", "sog", "cog"))


@query("p22_validate_rows", sql_with("""SELECT event_id, TRY_CAST(latitude AS DOUBLE) AS latitude, TRY_CAST(sog AS DOUBLE) AS sog, nullif(concat_ws(',', CASE WHEN sog IS NULL OR TRY_CAST(sog AS DOUBLE) IS NULL THEN 'sog' END,
 CASE WHEN TRY_CAST(heading AS DOUBLE) IS NULL THEN 'heading' END), '') AS error FROM texts""",
    "texts AS (SELECT event_id, latitude, CASE WHEN event_id % 23 = 0 THEN 'n/a' ELSE CAST(sog AS VARCHAR) END AS sog, heading FROM msg)"))
def _(spark, sf):
    m = messages(spark, sf)
    bad = F.when(F.col("event_id") % 23 == 0, "n/a").otherwise(F.col("sog").cast("string"))
    d = clean.validate_rows(m.withColumn("sog", bad), ["latitude", "sog", "heading"])
    return d.select("event_id", "latitude", "sog", "error")


@query("p23_impute_zero", sql_with("SELECT event_id, coalesce(sog, 0.0) AS sog, coalesce(rot, 0.0) AS rot FROM msg"))
def _(spark, sf):
    return clean.impute_constant(messages(spark, sf), ["sog", "rot"]).select("event_id", "sog", "rot")


@query("p23b_impute_mean", sql_with(
    "SELECT event_id, round(coalesce(sog, (SELECT avg(sog) FROM msg)), 6) AS sog, round(coalesce(rot, (SELECT avg(rot) FROM msg)), 6) AS rot FROM msg"))
def _(spark, sf):
    return rounded(clean.impute_mean(messages(spark, sf), ["sog", "rot"]).select("event_id", "sog", "rot"), 6)


@query("p24_sigmoid_threshold", sql_with("""SELECT event_id, round(p, 6) AS probability, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS at_least,
 CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS above, CAST(CASE WHEN p = 0.5 THEN 0 ELSE round(p) END AS INT) AS half_even
 FROM (SELECT event_id, 1.0 / (1.0 + exp(-(k - 50) / 25.0::DOUBLE)) AS p FROM msg)"""))
def _(spark, sf):
    p = clean.sigmoid((F.col("k") - 50) / F.lit(25.0))
    return messages(spark, sf).select(
        "event_id", F.round(p, 6).alias("probability"), clean.decide(p).alias("at_least"),
        clean.decide(p, "above").alias("above"), clean.decide(p, "round").alias("half_even"),
    )


_NAMES = """CASE event_id % 9 WHEN 0 THEN 'train_missing.csv' WHEN 1 THEN 'train_dupes.csv' WHEN 2 THEN 'train_labelnoise_10.csv'
 WHEN 3 THEN 'train_missing_dupes.csv' WHEN 4 THEN 'train_missing_labelnoise_20.csv' WHEN 5 THEN 'train_dupes_labelnoise_30_irregular.csv'
 WHEN 6 THEN 'train_missing_dupes_labelnoise_10.csv' WHEN 7 THEN 'train_irregular.csv' ELSE 'train.csv' END"""


@query("p25_corruption_class", sql_with(f"""SELECT event_id, CASE WHEN m AND d AND l THEN 'missing+dupes+labelnoise' WHEN m AND d THEN 'missing+dupes'
 WHEN m AND l THEN 'missing+labelnoise' WHEN d AND l THEN 'dupes+labelnoise' WHEN m THEN 'missing' WHEN d THEN 'dupes'
 WHEN l THEN 'labelnoise' ELSE 'clean' END AS corruption FROM (SELECT event_id, contains(f, 'missing') AS m, contains(f, 'dupes') AS d,
 contains(f, 'labelnoise') AS l FROM (SELECT event_id, {_NAMES} AS f FROM msg))"""))
def _(spark, sf):
    return messages(spark, sf).select("event_id", clean.corruption_class(F.expr(_NAMES)).alias("corruption"))


@query("p26_horizon_steps", sql_with("""SELECT event_id, CAST(CASE WHEN sampling_s IS NULL THEN minutes * 6 WHEN minutes = 10 AND sampling_s = 30 THEN 20
 WHEN minutes = 10 AND sampling_s = 60 THEN 10 WHEN minutes = 10 AND sampling_s = 180 THEN 4 WHEN minutes = 20 AND sampling_s = 30 THEN 40
 WHEN minutes = 20 AND sampling_s = 60 THEN 20 WHEN minutes = 20 AND sampling_s = 180 THEN 7 END AS INT) AS steps,
 CASE out_minute WHEN 1 THEN 6 WHEN 5 THEN 30 WHEN 10 THEN 60 WHEN 15 THEN 90 WHEN 20 THEN 120 END AS lead_steps
 FROM (SELECT event_id, CASE WHEN k % 2 = 0 THEN 10 ELSE 20 END AS minutes, CASE k % 4 WHEN 0 THEN 30 WHEN 1 THEN 60 WHEN 2 THEN 180 END AS sampling_s,
 CASE k % 5 WHEN 0 THEN 1 ELSE (k % 5) * 5 END AS out_minute FROM msg)"""))
def _(spark, sf):
    m = messages(spark, sf).select(
        "event_id", F.expr("CASE WHEN k % 2 = 0 THEN 10 ELSE 20 END").alias("minutes"),
        F.expr("CASE k % 4 WHEN 0 THEN 30 WHEN 1 THEN 60 WHEN 2 THEN 180 END").alias("sampling_s"),
        F.expr("CASE k % 5 WHEN 0 THEN 1 ELSE (k % 5) * 5 END").alias("out_minute"),
    )
    return m.select(
        "event_id", clean.horizon_steps(F.col("minutes"), F.col("sampling_s")).alias("steps"),
        clean.lead_for_minute(F.col("out_minute")).alias("lead_steps"),
    )


# --- joins --------------------------------------------------------------------------------------


@query("j1_join_metadata", sql_with(
    "SELECT event_id, m.mmsi, g.gear_type FROM raw m LEFT JOIN (SELECT mmsi, min(gear_type) AS gear_type FROM raw GROUP BY mmsi) g ON m.mmsi = g.mmsi"))
def _(spark, sf):
    m = messages(spark, sf, True)
    return joins.join_metadata(m, m.select("mmsi", "gear_type").distinct(), track=Track()).select("event_id", "mmsi", "gear_type")


@query("j2_valid_vessel_days", sql_with("""SELECT event_id, mmsi FROM msg WHERE (mmsi, CAST(ts AS DATE)) IN (
 SELECT (mmsi, CAST(ts AS DATE)) FROM msg GROUP BY mmsi, CAST(ts AS DATE) HAVING count(sog) > 1)"""))
def _(spark, sf):
    m = messages(spark, sf).withColumn("day", F.to_date("ts"))
    good = m.groupBy("mmsi", "day").agg(F.count("sog").alias("n")).where("n > 1")
    return joins.keep_listed(m, good, ["mmsi", "day"]).select("event_id", "mmsi")


@query("j3_back_join_valid", sql_with("""SELECT event_id, mmsi FROM msg WHERE mmsi IN (SELECT mmsi FROM msg GROUP BY mmsi HAVING count(draught) > 0 AND count(length) > 0)"""))
def _(spark, sf):
    m = messages(spark, sf)
    good = joins.good_vessels(joins.null_profile(m, ["draught", "length"]), ["draught", "length"])
    return joins.keep_listed(m, good, ["mmsi"]).select("event_id", "mmsi")


@query("j4_null_profile", sql_with(
    "SELECT mmsi, " + ", ".join(f"count(*) - count({c}) AS {c}_nulls" for c in S.CONTINUOUS) + ", count(*) AS row_count FROM msg GROUP BY mmsi"))
def _(spark, sf):
    return joins.null_profile(messages(spark, sf), S.CONTINUOUS)


@query("j5_monthly_quantiles", """SELECT o_orderkey, round(q.q1, 6) AS q1, round(q.q3, 6) AS q3 FROM orders o LEFT JOIN (
 SELECT strftime(o_orderdate, '%Y-%m') AS mo, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1) q
 ON strftime(o.o_orderdate, '%Y-%m') = q.mo""")
def _(spark, sf):
    from seatrack.operators.quantiles import wide_quantiles

    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    q = wide_quantiles(o, ["o_totalprice"], [0.25, 0.75], by=["month"])
    j = o.join(F.broadcast(q), "month", "left")  # one row per calendar month
    return rounded(j.select("o_orderkey", F.col("o_totalprice_q0").alias("q1"), F.col("o_totalprice_q1").alias("q3")), 6)


_SLOTS = "slots AS (SELECT mmsi, CAST(floor(epoch / 86400) * 86400 AS BIGINT) AS epoch, max(event_id) AS event_id FROM msg GROUP BY 1, 2)"


@query("j6_join_grid", sql_with("""SELECT g.mmsi, g.epoch, s.event_id FROM (SELECT mmsi, unnest(range(lo, hi + 1, 86400)) AS epoch FROM
 (SELECT mmsi, min(epoch) AS lo, max(epoch) AS hi FROM slots GROUP BY mmsi)) g LEFT JOIN slots s ON g.mmsi = s.mmsi AND g.epoch = s.epoch""", _SLOTS))
def _(spark, sf):
    m = messages(spark, sf)
    slots = m.groupBy("mmsi", (F.floor(F.col("epoch") / 86400) * 86400).alias("epoch")).agg(F.max("event_id").alias("event_id"))
    grid = time_grid(profile.track_bounds(slots), ["mmsi"], 86400)
    return joins.join_grid(grid, slots, ["mmsi", "epoch"])


def split_sql(key: str, stratum: str, source: str, train: float, val: float, seed: int = 42) -> str:
    """Seeded stratified assignment in SQL."""
    return f"""assigned AS (SELECT {key}, {stratum}, CASE WHEN rk <= floor(CAST({train} AS DOUBLE) * n) THEN 'train'
 WHEN rk <= floor(CAST({train} AS DOUBLE) * n) + floor(CAST({val} AS DOUBLE) * n) THEN 'val' ELSE 'test' END AS split FROM (
 SELECT {key}, {stratum}, row_number() OVER (PARTITION BY {stratum} ORDER BY md5('{seed}|' || CAST({key} AS VARCHAR))) AS rk,
 count(*) OVER (PARTITION BY {stratum}) AS n FROM (SELECT DISTINCT {key}, {stratum} FROM {source})))"""


@query("j7_join_split", sql_with("SELECT m.event_id, a.split FROM msg m JOIN assigned a ON m.mmsi = a.mmsi", split_sql("mmsi", "gear_type", "msg", 0.7, 0.15)))
def _(spark, sf):
    m = messages(spark, sf)
    a = assign_splits(m, "mmsi", "gear_type").select("mmsi", "split")
    return joins.join_split(m, a, ["mmsi"]).select("event_id", "split")


# --- sorting, limits, set operations ------------------------------------------------------------


@query("o1_total_sort", sql_with(f"SELECT {COLS} FROM msg ORDER BY mmsi, epoch"))
def _(spark, sf):
    return messages(spark, sf).select(*_C).orderBy("mmsi", "epoch")


@query("o2_sample_groups", sql_with("""SELECT mmsi, CAST(ts AS DATE) AS day, count(*) AS total_rows, count(*) - count(sog) AS sog_nulls, count(*) - count(draught) AS draught_nulls
 FROM msg GROUP BY 1, 2 HAVING count(sog) = 0 OR count(draught) = 0 ORDER BY 1, 2 LIMIT 10"""))
def _(spark, sf):
    return clean.vessel_day_examples(messages(spark, sf).select("mmsi", "ts", "sog", "draught"))


@query("o3_every_nth_newest", sql_with(
    "SELECT event_id, mmsi FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY epoch DESC, event_id DESC) AS rk FROM msg) WHERE rk % 20 = 1"))
def _(spark, sf):
    return series.every_nth_newest(messages(spark, sf), T, 20).select("event_id", "mmsi")


@query("o4_union", sql_with(f"SELECT {COLS} FROM msg WHERE k < 30 UNION ALL SELECT {COLS} FROM msg WHERE k >= 20"))
def _(spark, sf):
    m = messages(spark, sf)
    return union_splits([m.where("k < 30").select(*_C), m.where("k >= 20").select(*_C)])


@query("o5_distinct_pairs", sql_with("SELECT DISTINCT mmsi, gear_type FROM raw"))
def _(spark, sf):
    return messages(spark, sf, True).select("mmsi", "gear_type").distinct()
