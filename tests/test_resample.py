"""Long gaps on a time grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatrack.operators import resample
from seatrack.operators.ordered import Track


def test_long_gap_is_filled_by_many_tasks(spark):
    rows = [(1, 0, 50.0), (1, 90 * 86_400, 60.0), (2, 10, 5.0), (2, 40, 8.0)]
    d = spark.createDataFrame(rows, "mmsi long, epoch long, latitude double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = resample.filled_grid(d, Track(), 60, ["latitude"]).cache()
        tasks = out.where("mmsi = 1").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1
    assert out.where("mmsi = 1").count() == 90 * 1440 + 1 == out.where("mmsi = 1").select("epoch").distinct().count()
    mid = out.where(F.col("epoch") == 45 * 86_400).first()
    assert mid["latitude"] == 55.0
    out.unpersist()
