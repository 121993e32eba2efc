from __future__ import annotations

import math

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_joins import nodes

from seatrack.fixtures import messages
from seatrack.operators import degrade, split
from seatrack.operators.selection import hash_cuts, row_hash


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for i in range(900):
        key = 1 if i % 3 == 0 else 2 + i % 40  # one trajectory holds a third of the rows
        data.append((i, key, key % 2, float(i), float(i % 17)))
    return spark.createDataFrame(data, "id bigint, trajectory_id bigint, label int, a double, b double").cache()


@pytest.mark.parametrize("prefix", [1, 4])
def test_hash_cuts_select_the_exact_number(rows, prefix):
    d = rows.withColumn("h", row_hash(1, "id"))
    cuts = hash_cuts(d, ["trajectory_id"], "h", {"half": F.floor(F.col("n") / 2), "none": F.lit(0), "all": F.col("n")}, prefix)
    got = d.join(cuts, "trajectory_id").groupBy("trajectory_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("h") <= F.col("half")).alias("half"),
        F.count_if(F.col("h") <= F.col("none")).alias("none"), F.count_if(F.col("h") <= F.col("all")).alias("all"),
    ).collect()
    for r in got:
        assert (r.half, r.none, r.all) == (r.n // 2, 0, r.n)


def test_splits_are_disjoint_complete_and_sized(rows):
    a = split.assign_splits(rows, "trajectory_id", "label", 0.7, 0.1).collect()
    assert len({r.trajectory_id for r in a}) == len(a) == rows.select("trajectory_id").distinct().count()
    for label in (0, 1):
        part = [r.split for r in a if r.label == label]
        n = len(part)
        assert part.count("train") == math.floor(0.7 * n) and part.count("val") == math.floor(0.1 * n)


def test_duplicates_missing_noise_irregular_counts(rows):
    n = rows.count()
    assert degrade.add_duplicates(rows, ["id"], 30).count() == n + int(n * 0.3)
    m = degrade.add_missing_values(rows, ["id"], {"a": 29, "b": 70, "absent": 5})
    assert m.where("a IS NULL").count() == int(n * 0.29) and m.where("b IS NULL").count() == int(n * 0.70)
    fishing = rows.where("label = 1").select("trajectory_id").distinct().count()
    noisy = degrade.add_label_noise(rows, 40).where("label = 1").select("trajectory_id").distinct().count()
    assert noisy == fishing - int(fishing * 0.4)
    left = {r.trajectory_id: r.n for r in degrade.drop_irregularly(rows, ["id"]).groupBy("trajectory_id").agg(F.count("*").alias("n")).collect()}
    for r in rows.groupBy("trajectory_id").agg(F.count("*").alias("n")).collect():
        assert 0 <= r.n - left[r.trajectory_id] <= int(r.n * 0.1)


def test_threshold_mode_comes_close(rows):
    m = degrade.add_missing_values(rows, ["id"], {"a": 50}, exact=False)
    assert 350 < m.where("a IS NULL").count() < 550


def test_all_versions_equal_the_chains(rows):
    shares = {"a": 20, "b": 30}
    got = degrade.all_corrupted_versions(rows, [10, 40], ["id"], shares).cache()
    names = degrade.corruption_variants([10, 40])
    assert len(names) == 7 + 8 * 2
    assert {r.variant for r in got.select("variant").distinct().collect()} == {n for n, _, _ in names}
    for name, steps, level in names:
        if name not in ("missing", "dupes_irregular", "labelnoise_40_irregular", "missing_dupes_labelnoise_10_irregular"):
            continue
        want = degrade.apply_corruption(rows, steps, level, ["id"], shares)
        have = got.where(F.col("variant") == name).drop("variant")
        assert sorted(map(str, have.collect())) == sorted(map(str, want.select(have.columns).collect())), name


def test_variant_count():
    assert len(degrade.corruption_variants([10, 20, 30, 40])) == 39


def test_marks_stand_for_every_variant(spark):
    """Weights, labels and cells of the marked table against the written versions."""
    from seatrack import schema as S
    from seatrack.plans.q_degrade import trajectories

    levels, d = [10, 40], trajectories(spark, SF)
    marks = degrade.corruption_marks(d, levels, ["event_id"], S.MISSING_SHARES)
    want = {r["variant"]: (r["n"], r["p"]) for r in degrade.all_corrupted_versions(d, levels, ["event_id"], S.MISSING_SHARES).groupBy("variant").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).collect()}
    got = {r["corruption"]: (r["rows"], r["positive_rows"]) for r in degrade.variant_counts(marks, levels).collect()}
    assert got.pop("clean") == (d.count(), d.where("label = 1").count()) and got == want
    written = degrade.add_missing_values(d, ["event_id"], S.MISSING_SHARES)
    for c in S.MISSING_SHARES:
        assert marks.where(F.col(f"blank_{c}").isNull()).count() == written.where(F.col(c).isNull()).count()


def test_robustness_study_scores_every_version(spark):
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression

    from seatrack import schema as S
    from seatrack.plans import flows
    from seatrack.plans.q_degrade import FEATURES, trajectories

    d = trajectories(spark, SF).withColumn("label", F.when(F.col("event_id") % 10 != 0, F.col("label")))
    fitted = {"tree": DecisionTreeClassifier(featuresCol="features", labelCol="label", maxDepth=3), "line": LogisticRegression(featuresCol="features", labelCol="label", maxIter=5)}
    rows = flows.robustness_study(d.where("event_id % 3 > 0"), d.where("event_id % 3 = 0"), ["event_id"], FEATURES, S.MISSING_SHARES, [30], fitted).collect()
    names = {"clean", *[n for n, _, _ in degrade.corruption_variants([30])]}
    assert {(r["corruption"], r["model"]) for r in rows} == {(n, m) for n in names for m in fitted} and len(rows) == 2 * len(names)
    assert all(0 <= r["accuracy"] <= 1 and 0 <= r["f1_score"] <= 1 for r in rows)
    assert {r["rows"] for r in rows if r["corruption"] == "clean"} == {d.where("event_id % 3 > 0 AND label IS NOT NULL").count()}
    assert all(r["positive_rows"] <= r["rows"] for r in rows)


def test_no_broadcast_holds_a_row_of_the_table(spark):
    """Compressed files say little of the size of hashes: only tables of cuts and buckets may be broadcast."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        m = messages(spark, SF).select("event_id", "mmsi", "gear_type", "sog", "rot")
        for d in (split.split_rows(m).where("split = 'train'"), degrade.missing_flags(m, ["event_id"], {"sog": 5.0, "rot": 20.0}), degrade.drop_irregularly(m, ["event_id"], "mmsi")):
            for node in nodes(d._jdf.queryExecution().executedPlan()):
                if node.nodeName() == "BroadcastExchange":
                    names = {str(node.output().apply(i)).split("#")[0] for i in range(node.output().size())}
                    assert not names & {"event_id", "_h"}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_split_rows_marks_every_row_that_has_a_key(spark):
    m = messages(spark, SF).select("event_id", F.when(F.col("mmsi") % 7 != 0, F.col("mmsi")).alias("mmsi"), "gear_type")
    pairs = split.assign_splits(m, "mmsi", "gear_type")
    want = m.join(pairs.withColumnsRenamed({"mmsi": "k", "gear_type": "g"}), (F.col("mmsi") == F.col("k")) & F.col("gear_type").eqNullSafe(F.col("g"))).select("event_id", "split")
    assert sorted(map(str, split.split_rows(m).select("event_id", "split").collect())) == sorted(map(str, want.collect()))
