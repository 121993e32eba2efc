"""Trawling hours per vessel: dedup, filters, metadata join, label, hourly downsampling, gaps, aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatrack.fixtures import messages, sql_with
from seatrack.operators import clean, joins
from seatrack.operators.ordered import Track
from seatrack.operators.resample import bucket_first
from seatrack.operators.series import gap_seconds
from seatrack.plans.registry import query

SQL = sql_with(
    """SELECT mmsi, count(*) AS hours, CAST(sum(label) AS BIGINT) AS trawling_hours, CAST(max(gap_s) AS BIGINT) AS longest_gap_s FROM (
 SELECT mmsi, label, epoch - lag(epoch) OVER (PARTITION BY mmsi ORDER BY epoch) AS gap_s FROM hourly) GROUP BY mmsi""",
    """uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, ts ORDER BY event_id) AS rk FROM raw)
 WHERE rk = 1 AND mobile_type <> 'Class B' AND gear_type NOT IN ('UNKNOWN', 'INCONCLUSIVE'))""",
    """hourly AS (SELECT mmsi, trawling AS label, CAST(floor(epoch / 3600) * 3600 AS BIGINT) AS epoch FROM (
 SELECT *, row_number() OVER (PARTITION BY mmsi, floor(epoch / 3600) ORDER BY epoch, event_id) AS hr FROM uniq) WHERE hr = 1)""",
)


@query("flagship_trawling_hours", SQL)
def trawling_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = messages(spark, sf_dir, duplicates=True)
    meta = raw.select("mmsi", "gear_type").distinct()
    track = Track(tie=("event_id",))
    d = clean.dedup_on_key(raw, ["mmsi", "ts"], ["event_id"])
    d = clean.drop_class_b(d).select("mmsi", "epoch", "event_id", "nav_status")
    # Gear is one value per vessel: it joins the hourly rows, on vessel and day, which the windows of the gaps share.
    d = joins.join_metadata(bucket_first(d, track, 3600), meta, track=track)
    d = clean.label_trawling(clean.drop_unknown_gear(d), "label").select("mmsi", "epoch", "event_id", "label")
    d = gap_seconds(d, track)
    return d.groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("hours"), F.sum("label").alias("trawling_hours"), F.max("gap_s").alias("longest_gap_s")
    )
