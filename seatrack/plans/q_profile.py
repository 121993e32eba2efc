"""Queries over aggregations and data-quality profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatrack import schema as S
from seatrack.fixtures import messages, sql_with
from seatrack.operators import clean, profile, series
from seatrack.operators.ordered import Track
from seatrack.operators.split import split_rows
from seatrack.plans.q_clean import split_sql
from seatrack.plans.registry import query, rounded

T = Track(tie=("event_id",))


def union_all(parts) -> str:
    return "\nUNION ALL ".join(parts)


_MISS = ["rot", "sog", "cog", "heading", "draught", "length", "gear_type"]


@query("a1_missing_counts", sql_with(union_all(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing FROM raw" for c in _MISS)))
def _(spark, sf):
    return profile.missing_counts(messages(spark, sf, True).select("ts", *_MISS))


_DAYCOLS = ["sog", "rot", "draught", "gear_type"]
_GOOD_DAYS = "good AS (SELECT mmsi, CAST(ts AS DATE) AS day FROM raw GROUP BY 1, 2 HAVING " + " AND ".join(f"count({c}) > 0" for c in _DAYCOLS) + ")"


@query("a2_drop_empty_vessel_days", sql_with(
    "SELECT r.mmsi, r.epoch AS e, sog, rot, draught, gear_type FROM raw r JOIN good g ON r.mmsi = g.mmsi AND CAST(r.ts AS DATE) = g.day", _GOOD_DAYS))
def _(spark, sf):
    d = messages(spark, sf, True).select("mmsi", "ts", *_DAYCOLS)
    d = clean.drop_empty_vessel_days(d)
    return d.select("mmsi", F.unix_timestamp("ts").alias("e"), *_DAYCOLS)


@query("a2b_vessel_day_report", sql_with("""SELECT count(*) AS vessel_days, count(*) FILTER (bad) AS dropped_vessel_days, CAST(sum(n) AS BIGINT) AS total_rows,
 CAST(coalesce(sum(n) FILTER (bad), 0) AS BIGINT) AS dropped_rows, round(coalesce(sum(n) FILTER (bad), 0) * 100.0::DOUBLE / sum(n), 2) AS dropped_percent
 FROM (SELECT count(*) AS n, """ + " OR ".join(f"count({c}) = 0" for c in _DAYCOLS) + " AS bad FROM raw GROUP BY mmsi, CAST(ts AS DATE))"))
def _(spark, sf):
    return clean.vessel_day_report(messages(spark, sf, True).select("mmsi", "ts", *_DAYCOLS))




@query("a3_drop_hollow_vessels", sql_with(
    "SELECT event_id, mmsi FROM msg WHERE mmsi IN (SELECT mmsi FROM msg GROUP BY mmsi HAVING " + " AND ".join(f"count({c}) > 0" for c in S.CONTINUOUS) + ")"))
def _(spark, sf):
    return clean.drop_hollow_vessels(messages(spark, sf), S.CONTINUOUS).select("event_id", "mmsi")


@query("a4_drop_incomplete_vessels", sql_with("""SELECT event_id, mmsi FROM msg WHERE mmsi IN (
 SELECT mmsi FROM msg GROUP BY mmsi HAVING count(*) = count(gear_type) AND count(*) = count(width))"""))
def _(spark, sf):
    return clean.drop_incomplete_vessels(messages(spark, sf), ["gear_type", "width"]).select("event_id", "mmsi")


_IQR = """mq AS (SELECT strftime(ts, '%Y-%m') AS mo, quantile_cont(latitude, 0.25) AS a1, quantile_cont(latitude, 0.75) AS a3,
 quantile_cont(longitude, 0.25) AS o1, quantile_cont(longitude, 0.75) AS o3 FROM {src} GROUP BY 1)"""


@query("a5_monthly_iqr", sql_with("""SELECT event_id, mmsi FROM shifted r JOIN mq ON strftime(r.ts, '%Y-%m') = mq.mo
 WHERE latitude BETWEEN a1 - 1.5 * (a3 - a1) AND a3 + 1.5 * (a3 - a1) AND longitude BETWEEN o1 - 1.5 * (o3 - o1) AND o3 + 1.5 * (o3 - o1)""",
    "shifted AS (SELECT event_id, mmsi, ts, CASE WHEN event_id % 40 = 0 THEN latitude + k ELSE latitude END AS latitude, longitude FROM msg)",
    _IQR.format(src="shifted")))
def _(spark, sf):
    m = messages(spark, sf)
    far = F.when(F.col("event_id") % 40 == 0, F.col("latitude") + F.col("k")).otherwise(F.col("latitude"))
    return clean.filter_monthly_iqr(m.withColumn("latitude", far), exact=True).select("event_id", "mmsi")


@query("a6_quantile_range", sql_with("""SELECT event_id, width, length FROM w WHERE length BETWEEN (SELECT quantile_cont(length, 0.01) FROM w) AND (SELECT quantile_cont(length, 0.99) FROM w)""",
    "w AS (SELECT event_id, width, length FROM msg WHERE width BETWEEN (SELECT quantile_cont(width, 0.01) FROM msg) AND (SELECT quantile_cont(width, 0.99) FROM msg))"))
def _(spark, sf):
    d = messages(spark, sf).select("event_id", "width", "length")
    d = clean.filter_quantile_range(d, "width", exact=True)
    return clean.filter_quantile_range(d, "length", exact=True)


@query("a7_column_stats", sql_with(union_all(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM msg" for c in S.MODEL_FEATURES)))
def _(spark, sf):
    return rounded(digits=6, df=profile.column_stats(messages(spark, sf), S.MODEL_FEATURES))


def _skew(c, corrected):
    g1 = f"sqrt(n::DOUBLE) * sum(pow({c} - m, 3)) / pow(sum(pow({c} - m, 2)), 1.5)"
    v = f"{g1} * sqrt(n::DOUBLE * (n - 1)) / (n - 2)" if corrected else g1
    return f"SELECT '{c}' AS feature, round({v}, 6) AS skewness FROM msg, (SELECT avg({c}) AS m, count({c}) AS n FROM msg) WHERE {c} IS NOT NULL GROUP BY n"


@query("a8_skewness", sql_with(union_all(_skew(c, False) for c in ["sog", "draught", "rot"])))
def _(spark, sf):
    return rounded(digits=6, df=profile.skewness_table(messages(spark, sf), ["sog", "draught", "rot"]))


@query("a8b_skewness_corrected", sql_with(union_all(f"SELECT '{c}' AS feature, round(skewness({c}), 6) AS skewness FROM msg" for c in ["sog", "draught", "rot"])))
def _(spark, sf):
    return rounded(digits=6, df=profile.skewness_table(messages(spark, sf), ["sog", "draught", "rot"], bias_corrected=True))


@query("a9_duplicate_groups", sql_with("SELECT event_id, mmsi, epoch, sog, gear_type, count(*) AS copies FROM raw GROUP BY ALL HAVING count(*) > 1"))
def _(spark, sf):
    return profile.duplicate_groups(messages(spark, sf, True).select("event_id", "mmsi", "epoch", "sog", "gear_type"))


@query("a10_duplicate_summary", sql_with("""SELECT n AS total_rows, d AS distinct_rows, n - d AS duplicate_rows, round((n - d) * 100.0::DOUBLE / n, 4) AS duplicate_percent
 FROM (SELECT count(*) AS n FROM raw), (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM raw))"""))
def _(spark, sf):
    return profile.duplicate_summary(messages(spark, sf, True))


@query("a10b_duplicate_summary_lineitem", """SELECT n AS total_rows, d AS distinct_rows, n - d AS duplicate_rows, round((n - d) * 100.0::DOUBLE / n, 4) AS duplicate_percent
 FROM (SELECT count(*) AS n FROM lineitem), (SELECT count(*) AS d FROM (SELECT DISTINCT l_suppkey, l_shipdate, l_quantity FROM lineitem))""")
def _(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_quantity")
    return profile.duplicate_summary(li)


@query("a11_conflicting_ids", sql_with("SELECT mmsi, count(DISTINCT imo) AS imo_count FROM raw GROUP BY mmsi HAVING count(DISTINCT imo) > 1"))
def _(spark, sf):
    return profile.conflicting_ids(messages(spark, sf, True))


def _quartiles(c, src):
    return f"""SELECT '{c}' AS feature, q1, median, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (
 SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {src})"""


def _round_sql(sql, names):
    return "SELECT feature, " + ", ".join(f"round({n}, 6) AS {n}" for n in names) + f" FROM ({sql})"


_Q = ["q1", "median", "q3", "iqr", "lower", "upper"]


@query("a12_quartile_bounds", sql_with(_round_sql(union_all(_quartiles(c, "msg") for c in ["longitude", "sog", "width"]), _Q)))
def _(spark, sf):
    return rounded(digits=6, df=profile.quartile_bounds(messages(spark, sf), ["longitude", "sog", "width"]))


@query("a12b_quartile_bounds_lineitem", _round_sql(union_all(_quartiles(c, "lineitem") for c in ["l_extendedprice", "l_discount"]), _Q))
def _(spark, sf):
    return rounded(digits=6, df=profile.quartile_bounds(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_extendedprice", "l_discount"]))


_GAP = "gaps AS (SELECT epoch - lag(epoch) OVER (PARTITION BY mmsi ORDER BY epoch, event_id) AS gap_s FROM msg)"


@query("a13_gap_stats", sql_with("""SELECT count(gap_s) AS count, round(avg(gap_s), 6) AS mean, round(stddev_samp(gap_s), 6) AS std, min(gap_s)::DOUBLE AS min,
 quantile_cont(gap_s::DOUBLE, 0.25) AS q1, quantile_cont(gap_s::DOUBLE, 0.5) AS median, quantile_cont(gap_s::DOUBLE, 0.75) AS q3, max(gap_s)::DOUBLE AS max
 FROM gaps WHERE gap_s <= 7200""", _GAP))
def _(spark, sf):
    return rounded(digits=6, df=profile.gap_stats(messages(spark, sf).select("mmsi", "epoch", "event_id"), T, 7200))


def _hist(column, src, bins):
    return f"""SELECT CAST(b.bin AS INT) AS bin, round(lo + b.bin * ((hi - lo) / {bins}), 6) AS bin_start, round(lo + (b.bin + 1) * ((hi - lo) / {bins}), 6) AS bin_end,
 coalesce(n, 0) AS n FROM (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {src}) e,
 (SELECT unnest(range(0, {bins})) AS bin) b LEFT JOIN (SELECT least(floor(({column} - lo) * {bins} / (hi - lo)), {bins} - 1) AS bin, count(*) AS n
 FROM {src}, (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {src}) WHERE {column} IS NOT NULL GROUP BY 1) h ON h.bin = b.bin"""


@query("a14_histogram", sql_with(_hist("sog", "msg", 20)))
def _(spark, sf):
    return rounded(digits=6, df=profile.histogram(messages(spark, sf), "sog", 20))


@query("a14b_gap_histogram", sql_with(_hist("gap_s", "gaps", 30), _GAP))
def _(spark, sf):
    return rounded(digits=6, df=profile.histogram(profile.gaps(messages(spark, sf).select("mmsi", "epoch", "event_id"), T), "gap_s", 30))


def _box(c):
    return f"""SELECT '{c}' AS feature, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
 round(min({c}) FILTER ({c} BETWEEN lo AND hi), 6)::DOUBLE AS whisker_low, round(max({c}) FILTER ({c} BETWEEN lo AND hi), 6)::DOUBLE AS whisker_high,
 count(*) FILTER ({c} < lo OR {c} > hi) AS fliers FROM msg, (SELECT q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
 SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3 FROM msg)) GROUP BY q1, median, q3, lo, hi"""


@query("a15_box_plot", sql_with(union_all(_box(c) for c in ["sog", "rot", "draught"])))
def _(spark, sf):
    return rounded(digits=6, df=profile.box_plot(messages(spark, sf), ["sog", "rot", "draught"]))


_CORR = ["sog", "cog", "heading", "rot"]


@query("a16_correlation_pairs", sql_with(union_all(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM msg WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _CORR)
    for a in _CORR for b in _CORR)))
def _(spark, sf):
    return rounded(digits=6, df=profile.correlation_pairs(messages(spark, sf), _CORR))


_PAT = ["rot", "sog", "cog", "heading"]


@query("a17_null_patterns", sql_with("SELECT CAST(" + " + ".join(f"CASE WHEN {c} IS NULL THEN {1 << i} ELSE 0 END" for i, c in enumerate(_PAT)) +
       " AS BIGINT) AS pattern, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean" for c in _PAT) + " FROM msg GROUP BY 1"))
def _(spark, sf):
    return rounded(digits=6, df=profile.null_patterns(messages(spark, sf), _PAT))


@query("a17b_mcar_test")
def _(spark, sf):
    return profile.mcar_test(messages(spark, sf), _PAT)


@query("a18_track_bounds", sql_with("SELECT mmsi, min(epoch) AS min_epoch, max(epoch) AS max_epoch FROM msg GROUP BY mmsi"))
def _(spark, sf):
    return profile.track_bounds(messages(spark, sf))


@query("a19_keys_per_label", sql_with("SELECT trawling, count(DISTINCT mmsi) AS trajectories FROM msg GROUP BY trawling"))
def _(spark, sf):
    return profile.keys_per_label(messages(spark, sf), "mmsi", "trawling")


@query("a20_split_report", sql_with("""SELECT split, count(DISTINCT m.mmsi) AS vessels, round(count(DISTINCT m.mmsi) * 100.0::DOUBLE / (SELECT count(*) FROM assigned), 1) AS vessel_percent,
 count(*) AS rows, count(*) FILTER (trawling = 1) AS positive_rows, count(*) FILTER (trawling <> 1) AS negative_rows
 FROM msg m JOIN assigned a ON m.mmsi = a.mmsi GROUP BY split""", split_sql("mmsi", "gear_type", "msg", 0.7, 0.15)))
def _(spark, sf):
    return profile.split_report(split_rows(messages(spark, sf)))


@query("a21_mean_scores", sql_with("""SELECT nav_status AS corruption, event_kind AS model, round(avg(k / 100.0::DOUBLE), 3) AS accuracy, round(avg(k / 200.0::DOUBLE), 3) AS f1_score
 FROM (SELECT nav_status, k, coalesce(gear_type, 'NONE') AS event_kind FROM msg) GROUP BY 1, 2"""))
def _(spark, sf):
    runs = messages(spark, sf).select(
        F.col("nav_status").alias("corruption"), F.coalesce("gear_type", F.lit("NONE")).alias("model"),
        (F.col("k") / F.lit(100.0)).alias("accuracy"), (F.col("k") / F.lit(200.0)).alias("f1_score"),
    )
    return profile.mean_scores(runs)


@query("a22_fallback_use", sql_with("SELECT count(*) AS results, count(*) FILTER (sog IS NULL) AS fallback_count, round(avg(CASE WHEN sog IS NULL THEN 1 ELSE 0 END), 4) AS fallback_ratio FROM msg"))
def _(spark, sf):
    return profile.fallback_use(messages(spark, sf).select(F.col("sog").isNull().alias("used_fallback")))


WINDOW_CHECK_SQL = """checked AS (SELECT mmsi, CAST((rn - 1) / {step} AS BIGINT) AS window_no, epoch AS window_start, rows, CASE
 WHEN {full} THEN 'fully_null' WHEN {part} THEN 'partly_null' WHEN rows < {size} THEN 'too_short' ELSE 'ok' END AS reason FROM (
 SELECT mmsi, epoch, row_number() OVER (PARTITION BY mmsi ORDER BY epoch, event_id) AS rn, count(*) OVER w AS rows, {counts}
 FROM msg WINDOW w AS (PARTITION BY mmsi ORDER BY epoch, event_id ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING))
 WHERE (rn - 1) % {step} = 0{only})"""


def window_check_sql(size, step, features, partial):
    return WINDOW_CHECK_SQL.format(
        size=size, step=step, last=size - 1, full=" OR ".join(f"n_{c} = 0" for c in features),
        part=" OR ".join(f"n_{c} < rows" for c in features), counts=", ".join(f"count({c}) OVER w AS n_{c}" for c in features),
        only="" if partial else f" AND rows = {size}",
    ).replace(f"CAST((rn - 1) / {step} AS BIGINT)", f"CAST((rn - 1) // {step} AS BIGINT)")


_WF = ["latitude", "sog", "heading"]


@query("a23_window_counts", sql_with(
    "SELECT mmsi, count(*) FILTER (reason = 'ok') AS valid_windows, count(*) FILTER (reason <> 'ok') AS skipped_windows FROM checked GROUP BY mmsi", window_check_sql(5, 1, _WF, False)))
def _(spark, sf):
    return profile.window_counts(series.check_windows(messages(spark, sf), T, 5, 1, _WF))


@query("a23b_window_counts_until_first", sql_with("""SELECT mmsi, CAST(CASE WHEN f IS NULL THEN 0 ELSE 1 END AS BIGINT) AS valid_windows, coalesce(f, n) AS skipped_windows FROM (
 SELECT mmsi, min(window_no) FILTER (reason = 'ok') AS f, count(*) AS n FROM checked GROUP BY mmsi)""", window_check_sql(5, 1, _WF, False)))
def _(spark, sf):
    return profile.window_counts(series.check_windows(messages(spark, sf), T, 5, 1, _WF), until_first=True)
