"""File names and cable points."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seatrack.operators import risk
from seatrack.sources import readers


def test_only_day_files_have_a_date(spark):
    names = ["aisdk-2024-01-01.csv", "aisdk-2024-01-02_x.csv", "old_aisdk-2024-01-01.csv", "aisdk-2024-01-01.csv.tmp", "aisdk-2024-99-01.csv"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(readers.file_date(F.col("n")).cast("string")).collect()]
    assert got == ["2024-01-01", "2024-01-02", None, None, None]


def test_the_end_of_a_cable_comes_last(spark):
    points = [("a", "End", 9.0), ("a", "Bend_2000000", 5.0), ("a", "Start", 0.0), ("a", "Bend_1", 1.0), ("b", "End", 3.0), ("b", "Start", 2.0)]
    d = spark.createDataFrame([(c, p, x, x) for c, p, x in points], "Cable string, Point string, Latitude double, Longitude double")
    rows = risk.cable_segments(readers.cable_points(d)).orderBy("cable", "seg_no").collect()
    assert [(r["cable"], r["lon1"], r["lon2"]) for r in rows] == [("a", 0.0, 1.0), ("a", 1.0, 5.0), ("a", 5.0, 9.0), ("b", 2.0, 3.0)]


@pytest.mark.parametrize("name", ["Mid", "bend_1", None])
def test_other_point_names_fail(spark, name):
    d = spark.createDataFrame([("a", "Start", 0.0, 0.0), ("a", name, 1.0, 1.0)], "Cable string, Point string, Latitude double, Longitude double")
    with pytest.raises(Exception, match="unknown cable point"):
        readers.cable_points(d).collect()
