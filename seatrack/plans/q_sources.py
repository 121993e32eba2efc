"""Queries over sources and sinks: data is written with the engine's sinks and read back with its readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatrack import schema as S
from seatrack.fixtures import messages, sql_with
from seatrack.operators import profile, series
from seatrack.operators.ordered import Track
from seatrack.plans.registry import query, rounded
from seatrack.sources import readers, writers
from seatrack.sources.staging import staging_root

TRACK = Track(tie=("event_id",))


def new_path(spark, label: str) -> str:
    return f"{staging_root(spark)}/seatrack/{label}-{uuid.uuid4().hex}"


def write_message_files(spark, sf: str) -> str:
    """The messages as CSV in the layout of labelled message files."""
    back = {v: k for k, v in S.RENAMES.items()}
    m = messages(spark, sf, True)
    have = {back.get(c, c): c for c in m.columns}
    columns = []
    for name, kind in S.MESSAGE_FILE_FIELDS:
        if name == S.TIME_HEADER:
            columns.append(F.date_format("ts", S.TIME_FORMAT).alias(name))
        elif name in have:
            columns.append(F.col(have[name]).alias(name))
        else:
            columns.append(F.lit(None).cast(kind).alias(name))
    path = new_path(spark, "messages")
    m.select(*columns).write.option("header", True).csv(path)
    return path


@query("s1_read_inferred", sql_with("SELECT CAST(mmsi AS INT) AS mmsi, epoch, sog, gear_type FROM raw"))
def _(spark, sf):
    d = readers.read_inferred(spark, write_message_files(spark, sf))
    return d.select(
        F.col("MMSI").alias("mmsi"), F.unix_timestamp("Timestamp").alias("epoch"), F.col("SOG").alias("sog"),
        F.col("Gear Type").alias("gear_type"),
    )


@query("s2_read_messages", sql_with("SELECT DISTINCT mmsi, epoch, trawling, width, heading FROM raw"))
def _(spark, sf):
    d = readers.read_messages(spark, write_message_files(spark, sf))
    return d.select("mmsi", "epoch", "trawling", "width", "heading")


@query("s3_read_plain_csv", sql_with("SELECT event_id, mmsi, sog, nav_status FROM msg"))
def _(spark, sf):
    path = new_path(spark, "plain")
    m = messages(spark, sf).select(F.col("event_id").alias("_c0"), "event_id", "mmsi", "sog", "nav_status")
    m.write.option("header", True).csv(path)
    schema = T.StructType([f for f in m.schema.fields])
    d = readers.read_plain_csv(spark, path, schema)
    assert "_c0" not in d.columns
    return d


@query("s4_read_prepared", sql_with("SELECT event_id, mmsi, sog FROM msg"))
def _(spark, sf):
    m, paths = messages(spark, sf).select("event_id", "mmsi", "sog"), []
    for part in ("k < 50", "k >= 50"):
        paths.append(new_path(spark, "prepared"))
        m.where(part).write.parquet(paths[-1])
    return readers.read_prepared(spark, paths)


@query("s5_read_recursive", sql_with("SELECT event_id, mmsi, sog FROM msg"))
def _(spark, sf):
    path, m = new_path(spark, "nested"), messages(spark, sf).select("event_id", "mmsi", "sog", "trawling")
    m.where("k < 50").write.parquet(f"{path}/a/b")
    m.where("k >= 50").write.parquet(f"{path}/c")
    schema = T.StructType([f for f in m.schema.fields if f.name != "trawling"])
    return readers.read_recursive(spark, path, schema)


@query("s6_read_xy", sql_with("SELECT mmsi, epoch, sog, cog, CAST(trawling AS INT) AS trawling FROM (SELECT mmsi, epoch, min(sog) AS sog, min(cog) AS cog, min(trawling) AS trawling FROM msg GROUP BY ALL)"))
def _(spark, sf):
    path = new_path(spark, "xy")
    m = messages(spark, sf).groupBy("mmsi", "epoch").agg(*[F.min(c).alias(c) for c in ("sog", "cog", "trawling")])
    m.write.parquet(path)
    x, y = readers.read_xy(spark, [path], ["sog", "cog"], ["trawling"], ["mmsi", "epoch"])
    return x.join(y, ["mmsi", "epoch"])


@query("s7_write_labelled_csv", sql_with("SELECT CAST(ts AS DATE) AS file_date, count(*) AS n, CAST(sum(trawling) AS BIGINT) AS positives FROM msg GROUP BY 1"))
def _(spark, sf):
    path, m = new_path(spark, "labelled"), messages(spark, sf).withColumn("file_date", F.to_date("ts"))
    writers.write_labelled_csv(m.select("file_date", "event_id", "trawling"), path)
    d = spark.read.option("header", True).schema("event_id bigint, trawling int, file_date date").csv(path)
    return d.groupBy("file_date").agg(F.count(F.lit(1)).alias("n"), F.sum("trawling").alias("positives"))


@query("s8_write_prepared", sql_with("SELECT CAST(ts AS DATE) AS file_date, count(*) AS n FROM msg WHERE k < 50 OR CAST(ts AS DATE) <> DATE '2024-01-10' GROUP BY 1"))
def _(spark, sf):
    path, m = new_path(spark, "days"), messages(spark, sf).withColumn("file_date", F.to_date("ts"))
    m = m.select("file_date", "event_id", "k")
    writers.write_prepared(m, path)
    writers.write_prepared(m.where("file_date = DATE '2024-01-10' AND k < 50"), path)  # replaces one day only
    return spark.read.parquet(path).groupBy("file_date").agg(F.count(F.lit(1)).alias("n"))


@query("s9_training_export", sql_with("""SELECT epoch AS timestamp_epoch, mmsi, CAST(latitude AS FLOAT) AS latitude, CAST(longitude AS FLOAT) AS longitude, CAST(rot AS FLOAT) AS rot, CAST(sog AS FLOAT) AS sog,
 CAST(cog AS FLOAT) AS cog, CAST(heading AS FLOAT) AS heading, CAST(width AS FLOAT) AS width, CAST(length AS FLOAT) AS length, CAST(draught AS FLOAT) AS draught, trawling,
 CAST(lead(latitude, 1) OVER w AS FLOAT) AS future_lat_1, CAST(lead(longitude, 1) OVER w AS FLOAT) AS future_lon_1, CAST(lead(latitude, 2) OVER w AS FLOAT) AS future_lat_2, CAST(lead(longitude, 2) OVER w AS FLOAT) AS future_lon_2
 FROM msg WINDOW w AS (PARTITION BY mmsi ORDER BY epoch, event_id)"""))
def _(spark, sf):
    path = new_path(spark, "training")
    d = series.future_positions(messages(spark, sf), TRACK, 2)
    writers.write_training_set(d, path, "v1", horizon=2)
    return spark.read.parquet(f"{path}/train/v1/data")


@query("s9b_export_metadata", sql_with("SELECT 'v1' AS version, 'train' AS mode, count(*) AS rows, count(DISTINCT mmsi) AS vessels, 12 AS columns, 'day files' AS sources, 'out' AS path FROM msg"))
def _(spark, sf):
    exported = writers.training_columns(messages(spark, sf))
    d = writers.export_metadata(exported, "v1", "train", ["day files"], "out")
    return d.drop("schema", "created", "partitions").withColumn("sources", F.array_join("sources", ","))


@query("s10_stats_round_trip", sql_with(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM msg" for c in S.CONTINUOUS)))
def _(spark, sf):
    path = new_path(spark, "stats")
    writers.write_stats(profile.column_stats(messages(spark, sf), S.CONTINUOUS), path)
    return rounded(readers.read_stats(spark, path), 6)


@query("s12_results_json", sql_with("SELECT event_id, '{\"event_id\":' || event_id || ',\"position\":{\"mmsi\":' || mmsi || ',\"k\":' || k || '}}' AS json FROM msg"))
def _(spark, sf):
    d = messages(spark, sf).select("event_id", F.struct("mmsi", "k").alias("position"))
    return writers.results_json(d).select(F.get_json_object("json", "$.event_id").cast("bigint").alias("event_id"), "json")


_FILE = "'aisdk-' || CAST(CAST(ts AS DATE) AS VARCHAR(10)) || CASE WHEN event_id % 2 = 0 THEN '_fishing_labeled' ELSE '' END || '.csv'"


@query("s13_assign_files", sql_with("""SELECT file_name, d AS file_date, 'train' AS split FROM (SELECT DISTINCT """ + _FILE + """ AS file_name, CAST(ts AS DATE) AS d FROM msg)
 WHERE year(d) IN (2024) AND month(d) IN (1, 2, 3)"""))
def _(spark, sf):
    names = messages(spark, sf).select(F.expr(_FILE).alias("file_name")).distinct()
    odd = names.limit(1).select(F.lit("notes.txt").alias("file_name"))
    return readers.assign_files(names.unionByName(odd), ([2024], [1, 2, 3]), ([2024, 2025], [1, 11, 12]))


@query("s13b_next_version", sql_with("SELECT 'v' || CAST(max(k) + 1 AS VARCHAR) AS next_version FROM msg"))
def _(spark, sf):
    return readers.next_version(messages(spark, sf).select(F.concat(F.lit("v"), F.col("k").cast("string")).alias("version")))


@query("s14_missing_days", sql_with("""SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(DATE '2023-12-25', max(CAST(ts AS DATE)) + 5, INTERVAL 1 DAY)) AS d FROM msg)
 WHERE CAST(d AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM msg WHERE day(ts) % 7 <> 3)"""))
def _(spark, sf):
    m = messages(spark, sf).withColumn("day", F.to_date("ts"))
    last = m.agg(F.max("day").alias("m")).select("m").scalar()
    loaded = m.where(F.dayofmonth("day") % 7 != 3).select("day").distinct()
    return readers.missing_days(loaded.withColumn("_last", last), F.lit("2023-12-25"), F.date_add(F.max("_last"), 5))


@query("s15_first_valid_windows")
def _(spark, sf):
    m = messages(spark, sf)
    w = series.sliding_windows(m, TRACK, ["latitude", "sog", "heading"], 5, 1)
    c = series.check_windows(m, TRACK, 5, 1, ["latitude", "sog", "heading"]).select("mmsi", "window_no", "reason")
    return writers.first_valid_windows(w.join(c, ["mmsi", "window_no"]))
