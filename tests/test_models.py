"""Fits run on all cores, however small the files of their vectors are."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from seatrack.operators import models


class Probe:
    """A decision tree that tells over how many tasks its training rows lie."""

    tasks = 0

    def fit(self, rows):
        Probe.tasks, Probe.rows = rows.rdd.getNumPartitions(), rows.count()
        return DecisionTreeClassifier(featuresCol="features", labelCol="y", maxDepth=2).fit(rows)


def test_training_rows_lie_on_all_cores(spark):
    rows = spark.range(60_000).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2).alias("a"), F.lit(1.0).alias("b")).coalesce(1)
    out = models.compare_classifiers(rows, rows, ["a", "b"], "y", models={"probe": Probe()}).first()
    assert (Probe.tasks, Probe.rows, out.accuracy) == (spark.sparkContext.defaultParallelism, 60_000, 1.0)
    few = models.vector_table(spark.range(10).select(F.col("id").cast("double")), "few")
    assert (few.rdd.getNumPartitions(), few.count()) == (1, 10)
    none = models.vector_table(spark.range(0).select(F.col("id").cast("double")), "none")
    assert none.count() == 0
