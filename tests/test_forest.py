"""Forests over binned features against direct calculation and the forests of pyspark.ml."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from seatrack.operators import forest, models


def _seen(monkeypatch):
    """The blocks that the first pass reads."""
    found, run = [], forest._pass

    def watch(blocks, *rest):
        if not found:
            found.extend(blocks.collect())
        return run(blocks, *rest)

    monkeypatch.setattr(forest, "_pass", watch)
    return found


def test_regressor_matches_spark_and_holds_each_cell_once(spark, monkeypatch):
    blocks = _seen(monkeypatch)
    d = spark.range(40_000).selectExpr("CAST(id % 4 AS DOUBLE) AS a", "CAST((id * 7) % 5 AS DOUBLE) AS b", "id").withColumn("y", 2 * F.col("a") + F.col("b") + F.sin("id"))
    got = models.forest_regressors(d, ["a", "b"], ["y"])
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(d)
    fitted = RandomForestRegressor(labelCol="y", numTrees=100, maxDepth=10, seed=1).fit(vectors)
    both = models.forest_predict(fitted.transform(vectors), got, ["a", "b"]).select("a", "b", "prediction", "y_pred").distinct().collect()
    apart = [abs(r.prediction - r.y_pred) for r in both]  # other draws: forests of two seeds differ as much
    assert len(both) == 20 and max(apart) < 0.6 and np.mean(apart) < 0.2
    assert np.allclose(got["y"].featureImportances.toArray(), fitted.featureImportances.toArray(), atol=0.1)
    cells = [len(b["cells"]) // 2 for b in blocks]
    assert max(cells) <= 20 and sum(np.frombuffer(b["sizes"], np.int64).sum() for b in blocks) == 40_000


def test_importance_matches_spark_and_rows_are_read_as_blocks(spark, monkeypatch):
    blocks = _seen(monkeypatch)
    d = spark.range(6_000).selectExpr("CAST(id % 50 AS DOUBLE) AS a", "CAST(pmod(hash(id), 1000) AS DOUBLE) AS b", "CAST(id % 3 AS INT) AS c", "CAST(id % 50 > 30 OR pmod(hash(id), 1000) > 800 AS INT) AS y")
    x = ["a", "b", "c"]
    got = models.feature_importance(models.random_forest(d, x, "y", trees=20, depth=4), x, spark).collect()
    vectors = VectorAssembler(inputCols=x, outputCol="features").transform(d)
    fitted = RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=4, seed=1).fit(vectors)
    want = models.feature_importance(fitted, x, spark).collect()
    assert [r.feature for r in got] == [r.feature for r in want] == ["a", "b", "c"]
    assert np.allclose([r.importance for r in got], [r.importance for r in want], atol=0.1)
    assert 1 <= len(blocks) <= spark.sparkContext.defaultParallelism and sum(np.frombuffer(b["sizes"], np.int64).sum() for b in blocks) == 6_000


def test_scores_follow_the_rule_and_work_is_done_per_cell(spark, monkeypatch):
    asked, walk = [], forest.Tree.walk
    monkeypatch.setattr(forest.Tree, "walk", lambda t, flat, start, depth: asked.append(len(start)) or walk(t, flat, start, depth))
    d = spark.range(6_000).selectExpr("CAST(id % 10 AS DOUBLE) AS a", "CAST(id % 3 AS INT) AS b", "CAST(id % 10 > 6 OR id % 3 = 2 AS INT) AS y")
    fitted = models.random_forest(d, ["a", "b"], "y", trees=20)
    assert fitted.transform(d).where("prediction <> y").count() == 0
    a, b, y = np.array(d.collect(), dtype=float).T
    assert (fitted.predict([a, b]) == y).all() and set(asked) == {30}


@pytest.mark.parametrize("classify", [True, False])
def test_first_split_is_the_best_of_the_drawn_rows(spark, monkeypatch, classify):
    blocks = _seen(monkeypatch)
    d = spark.range(900).selectExpr("CAST(pmod(hash(id), 300) AS DOUBLE) AS x", "id").withColumn("y", F.expr(f"CAST({'(x > 100 AND id % 5 > 0) OR x > 250' if classify else 'x * x / 100 + id % 7'} AS INT)"))
    fitted = forest.fit_forest(d, ["x"], "y", classify, trees=1, depth=1, seed=3)
    (block,) = blocks
    sizes, labels = np.frombuffer(block["sizes"], np.int64), np.frombuffer(block["labels"], np.int64 if classify else np.float64)
    x = np.repeat(np.frombuffer(block["cells"], np.uint8), sizes)
    y = np.repeat(labels, sizes) if classify else labels
    drawn = np.repeat(np.arange(900), forest._draws(3, block["block"], 0, 900))
    x, y = x[drawn], y[drawn]

    def spread(v):
        return len(v) * (2 * v.mean() * (1 - v.mean()) if classify else v.var()) if len(v) else 0.0

    gains = {c: spread(y) - spread(y[x <= c]) - spread(y[x > c]) for c in range(31)}
    cut = max(gains, key=gains.get)
    (tree,) = fitted.trees
    assert tree.cut[0] == cut and np.isclose(tree.weight[0], gains[cut])
    sides = [y[x <= cut].mean(), y[x > cut].mean()]
    values = forest._value(tree.stats, fitted.classes)[tree.child[:2]]
    assert np.allclose(values[:, 1] if classify else values[:, 0], sides)


def test_rows_left_out_and_refused(spark):
    d = spark.createDataFrame([(1.0, 0), (2.0, 0), (None, 1), (float("nan"), 1)], "x double, y int")
    fitted = forest.fit_forest(d, ["x"], "y", True, trees=3)
    assert [(r.x, r.prediction) for r in fitted.transform(d).orderBy("x").collect()] == [(1.0, 0.0), (2.0, 0.0)]
    assert fitted.featureImportances.toArray().tolist() == [0.0]
    for bad in (d.where("x < 0"), d.withColumn("y", F.lit(None).cast("int")), d.withColumn("y", F.lit(-1)), d.withColumn("y", F.lit(0.5))):
        with pytest.raises(ValueError):
            forest.fit_forest(bad, ["x"], "y", True, trees=3)
    three = spark.range(600).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id DIV 200 AS INT) AS y")
    assert forest.fit_forest(three, ["x"], "y", True, trees=5).transform(three).where("prediction <> y").count() < 60


def test_leaves_with_one_prediction_are_merged():
    leaf = lambda *i: [v for k in i for v in (k, k)]
    t = forest.Tree(np.array([0, 1, 0, 0, 0]), np.array([3, 3, 32, 32, 32]), np.array([1, 2, 3, 4, *leaf(2, 3, 4)]),
                    np.array([[9.0, 5], [9, 1], [0, 4], [5, 1], [4, 0]]), np.array([4.0, 1, 0, 0, 0]))
    merged = forest._merged(t, 2)
    assert merged.child.tolist() == [1, 2, 1, 1, 2, 2, 3, 3, 4, 4] and merged.weight.tolist() == [4, 0, 0, 0, 0]


def test_rows_of_one_cell_and_class_are_one_entry_whichever_task_read_them(spark, monkeypatch):
    blocks = _seen(monkeypatch)
    monkeypatch.setattr(forest, "ENTRY_ROWS", 1_000)
    d = spark.range(60_000).repartition(8).selectExpr("CAST(id % 5 AS DOUBLE) AS a", "CAST(IF(id % 100 < 90, 0, id % 4) AS DOUBLE) AS b", "CAST(id % 5 > 2 AS INT) AS y")
    fitted = forest.fit_forest(d, ["a", "b"], "y", True, trees=5, depth=4)
    sizes = np.concatenate([np.frombuffer(b["sizes"], np.int64) for b in blocks])
    assert sizes.sum() == 60_000 and sizes.max() <= 1_000  # 5 cells hold 54,000 rows and more
    assert len(sizes) <= 20 + 60  # before: up to 20 in each of 8 tasks, of any size
    assert fitted.transform(d).where("prediction <> y").count() == 0


def test_features_are_derived_once_for_a_row(spark, monkeypatch):
    d = spark.range(2_000).selectExpr("CAST(regexp_extract(CAST(id AS STRING), '([0-9]+)', 1) AS DOUBLE) AS x", "CAST(id % 2 AS INT) AS y")
    plans, write = [], forest.stage
    monkeypatch.setattr(forest, "stage", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, label))
    fitted = forest.fit_forest(d, ["x"], "y", True, trees=2, depth=2)
    plans.append(fitted.transform(d)._jdf.queryExecution().executedPlan().toString())
    assert plans[0].count("regexp_extract") == 1 and plans[-1].count("regexp_extract") == 1 and plans[-1].count("score(") <= 2


def test_edges_are_quantiles_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 20_000)
    d = spark.range(0, 100_000, 1, 3).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(pmod(hash(id), 7) AS DOUBLE) AS b", "CAST(IF(id < 60000, 5, id) AS DOUBLE) AS c")
    a, b, c = forest._edges(d, ["a", "b", "c"])
    assert np.abs(a - np.arange(1, 32) * 3_125).max() <= 100 and b.tolist() == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5]
    assert c[0] == 5 and len(c) == 13 and np.abs(c[1:] - np.arange(20, 32) * 3_125).max() <= 100
    assert forest._edges(d.where("a < 64"), ["a"])[0].tolist() == list(range(1, 63, 2))  # few rows: exact


def test_bins_in_longs_and_histograms_against_direct_counts():
    rng = np.random.default_rng(0)
    cells = rng.integers(0, forest.BINS, (500, 14)).astype(np.uint8)
    codes = forest._coded(cells)
    assert len(codes) == 2 and (forest._decoded(codes, 14) == cells).all()
    sizes, labels = rng.integers(1, 5, 500), rng.integers(0, 2, 500)
    ends = sizes.cumsum()
    draws = forest._draws(1, 2, 3, int(ends[-1]))
    room = forest._Room(500, int(ends[-1]))
    column = forest._by_cell(draws, ends, room)
    assert (column == np.add.reduceat(draws.astype(int), ends - sizes)).all()
    t = forest.Tree(np.array([3, 9, 0, 0, 0]), np.array([15, 7, 32, 32, 32]), np.array([1, 2, 3, 4, 2, 2, 3, 3, 4, 4]), np.zeros((5, 2)), np.zeros(5))
    open_nodes, may = np.array([3, 4]), np.array([[0, 5], [13, 2]])
    bins = (cells * 2 + labels[:, None]).astype(np.uint8)
    got = forest._histograms(cells.ravel(), bins.ravel(), [column], *forest._steps(t, open_nodes, 2), may.T.copy(), 14, 2, room)
    node = np.where(cells[:, 3] > 15, 2, np.where(cells[:, 9] > 7, 4, 3))  # 2 is a leaf already
    want = np.zeros((2, 2, forest.BINS, 2))
    for i in np.flatnonzero(node > 2):
        for j in range(2):
            want[node[i] - 3, j, cells[i, may[node[i] - 3, j]], labels[i]] += column[i]
    assert (got == want).all()
