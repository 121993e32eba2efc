"""AIS-shaped views over the ``events`` table, written once for Spark and for a SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_EPOCH = "unix_timestamp(ts)"
SQL_EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"

# Columns of the message view over (event_id, ts, user_id, event_type, value, epoch, k).
MESSAGE_COLUMNS = [
    ("event_id", "event_id"),
    ("mmsi", "CAST(219000000 + user_id AS INT)"),
    ("ts", "ts"),
    ("epoch", "epoch"),
    ("k", "k"),
    ("mobile_type", "CASE WHEN user_id % 10 = 9 THEN 'Class B' ELSE 'Class A' END"),
    ("nav_status", "CASE WHEN event_type IN ('purchase','view') THEN 'Engaged in fishing' ELSE 'Under way using engine' END"),
    ("gear_type", "CASE user_id % 6 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'INCONCLUSIVE' WHEN 2 THEN 'FIXED_GEAR' WHEN 3 THEN NULL ELSE 'TRAWLERS' END"),
    ("imo", "CAST(CASE WHEN user_id % 37 = 0 THEN 'IMO' || CAST(user_id AS VARCHAR(20)) || '_' || CAST(event_id % 2 AS VARCHAR(20)) ELSE 'IMO' || CAST(user_id AS VARCHAR(20)) END AS VARCHAR(40))"),
    ("latitude", "CAST(55.0 AS DOUBLE) + (user_id % 25) * CAST(0.1 AS DOUBLE) + CAST(0.3 AS DOUBLE) * abs((epoch % 172800) - 86400) / CAST(86400 AS DOUBLE)"),
    ("longitude", "CAST(10.5 AS DOUBLE) + (user_id % 40) * CAST(0.1 AS DOUBLE) + CAST(0.5 AS DOUBLE) * abs((epoch % 259200) - 129600) / CAST(129600 AS DOUBLE)"),
    ("rot", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST((k - 50) * 3 AS DOUBLE) END"),
    ("sog", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / CAST(10 AS DOUBLE) END"),
    ("cog", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST((k * 37) % 360 AS DOUBLE) END"),
    ("heading", "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST((k * 53) % 360 AS DOUBLE) END"),
    ("draught", "CASE WHEN user_id % 29 = 0 OR event_id % 17 = 0 THEN NULL ELSE CAST(2 + (k % 7) AS DOUBLE) END"),
    ("width", "CAST(4 + user_id % 9 AS INT)"),
    ("length", "CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(10 + user_id % 40 AS INT) END"),
]
TRAWLING = "CASE WHEN nav_status = 'Engaged in fishing' AND gear_type = 'TRAWLERS' THEN 1 ELSE 0 END"
K_EXPR = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

_SELECT = ",\n  ".join(f"{e} AS {n}" for n, e in MESSAGE_COLUMNS)

# The same views as common table expressions: `raw` with 2 % exact duplicates, `msg` without.
SQL_VIEWS = f"""
base AS (SELECT event_id, ts, user_id, event_type, value, {SQL_EPOCH} AS epoch, {K_EXPR} AS k FROM events),
doubled AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE event_id % 50 = 0),
raw AS (SELECT *, {TRAWLING} AS trawling FROM (SELECT
  {_SELECT}
 FROM doubled)),
msg AS (SELECT *, {TRAWLING} AS trawling FROM (SELECT
  {_SELECT}
 FROM base))"""


def messages(spark: SparkSession, sf_dir: str, duplicates: bool = False) -> DataFrame:
    """Ship messages derived from ``events``; ``duplicates`` repeats every fiftieth one."""
    base = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "ts", "user_id", "event_type", "value", f"{SPARK_EPOCH} AS epoch", f"{K_EXPR} AS k"
    )
    if duplicates:
        base = base.unionByName(base.where("event_id % 50 = 0"))
    return base.selectExpr(*[f"{e} AS {n}" for n, e in MESSAGE_COLUMNS]).selectExpr("*", f"{TRAWLING} AS trawling")


def sql_with(body: str, *views: str) -> str:
    """A query over the views, with more common table expressions in front of ``body``."""
    return "WITH " + ",\n".join([SQL_VIEWS.strip(), *views]) + "\n" + body
