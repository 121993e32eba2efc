"""Boosted trees over binned features against those of pyspark.ml, and the comparison that fits them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from seatrack.operators import forest, models

X = ["a", "b", "c"]


def _rows(spark, n=4_000):
    d = spark.range(n).selectExpr("CAST(pmod(hash(id), 20) AS DOUBLE) AS a", "CAST(pmod(hash(id, 1), 15) AS DOUBLE) AS b", "CAST(pmod(hash(id, 2), 4) AS DOUBLE) AS c", "id")
    return d.withColumn("y", F.expr("CAST(a * 1.3 + sin(b * 7) * 6 + pmod(hash(id, 3), 100) / 12.0 > 16 AS INT)"))


def test_boosted_trees_match_spark(spark):
    d = _rows(spark)
    vectors = VectorAssembler(inputCols=X, outputCol="features").transform(d)
    boosted = GBTClassifier(labelCol="y", maxDepth=4, stepSize=0.3, maxIter=6).fit(vectors)
    fitted = forest.fit_boosted(d, X, "y", trees=6, depth=4, step=0.3, share=1.0)
    same = boosted.transform(vectors).join(fitted.transform(d, "got").select("id", "got"), "id").agg(F.count("*"), F.avg((F.col("prediction") == F.col("got")).cast("int"))).first()
    assert same[0] == 4_000 and same[1] > 0.995
    assert np.allclose(fitted.trees[0].stats[0], [4_000, *d.agg(F.sum(2 * F.col("y") - 1), F.count("*")).first()])
    assert boosted.treeWeights == [1.0] + [0.3] * 5 and len(fitted.trees) == 6


def test_share_of_rows_is_drawn_and_few_rows_do(spark):
    d = _rows(spark, 2_000)
    fitted = forest.fit_boosted(d, X, "y", trees=3, depth=3)
    seen = [t.stats[0][0] for t in fitted.trees]
    assert all(900 < n < 1_100 for n in seen) and len(set(seen)) > 1
    one = spark.createDataFrame([(1.0, 0), (1.0, 0)], "a double, y int")
    assert [r.prediction for r in forest.fit_boosted(one, ["a"], "y", trees=3).transform(one).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError, match="two classes"):
        forest.fit_boosted(spark.createDataFrame([(1.0, 0), (1.0, 2)], "a double, y int"), ["a"], "y")


def test_comparison_fits_binned_trees(spark, monkeypatch):
    used = []
    for name in ("fit_forest", "fit_boosted"):
        run = getattr(models, name)
        monkeypatch.setattr(models, name, lambda *a, run=run, name=name, **k: used.append(name) or run(*a, **k | {"trees": 5}))
    d = _rows(spark, 1_500).withColumn("a", F.when(F.col("id") % 9 > 0, F.col("a")))
    for impute in ("zero", "mean"):
        out = {r.model: r for r in models.compare_classifiers(d, d, X, "y", impute).collect()}
        assert list(out) == ["logistic_regression", "decision_tree", "random_forest", "boosted_trees"]
        assert all(out[m].accuracy > 0.8 for m in list(out)[1:])
    assert used == ["fit_forest", "fit_boosted"] * 2
