from __future__ import annotations

import math
import random

import numpy as np
import pytest

from seatrack.operators import clean, metrics, profile
from seatrack.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("accuracy", [50, 100_000])
@pytest.mark.parametrize("shape", ["uniform", "third_same", "outliers", "constant"])
def test_exact_quantiles(spark, accuracy, shape):
    rng = random.Random(3)
    make = {
        "uniform": lambda i: rng.uniform(-5, 5),
        "third_same": lambda i: 1.0 if i % 3 == 0 else rng.uniform(0, 2),
        "outliers": lambda i: rng.gauss(0, 1) if i % 50 else 1e12,
        "constant": lambda i: 4.0,
    }[shape]
    data = [("a" if i % 4 else "b", make(i), None if i % 5 == 0 else float(i)) for i in range(4000)]
    data += [("c", None, 1.0), ("c", float("nan"), 3.0)]
    d = spark.createDataFrame(data, "g string, x double, y double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r.g, r.feature, r.p): r.quantile for r in exact_quantiles(d, ["x", "y"], probs, ["g"], accuracy).collect()}
    for g in ("a", "b"):
        for f, k in (("x", 1), ("y", 2)):
            values = [r[k] for r in data if r[0] == g and r[k] is not None]
            for p in probs:
                assert got[g, f, p] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-12)
    assert got["c", "y", 0.5] == 2.0
    whole = {(r.feature, r.p): r.quantile for r in exact_quantiles(d, ["x"], probs, (), accuracy).collect()}
    values = [r[1] for r in data if r[1] is not None and not math.isnan(r[1])]
    for p in probs:
        assert whole["x", p] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-12)


def test_histogram_edges(spark):
    d = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    got = [(r.bin, r.n) for r in profile.histogram(d, "x", 5).orderBy("bin").collect()]
    assert got == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3)]
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r.n for r in profile.histogram(flat, "x", 3).orderBy("bin").collect()] == [0, 2, 0]


def test_normalize_round_trip_and_zero_deviation(spark):
    d = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    stats = spark.createDataFrame([("a", 2.0, 4.0), ("b", 5.0, 0.0)], "feature string, mean double, std double")
    z = clean.normalize(d, stats, ["a", "b"])
    assert [tuple(r) for r in z.collect()] == [(-0.25, 0.0), (0.25, 0.0), (None, 0.0)]
    assert [r.a for r in clean.denormalize(z, stats, ["a"]).collect()] == [1.0, 3.0, None]


def test_validate_rows(spark):
    d = spark.createDataFrame([("1.5", "x"), (None, "2"), ("3", "4")], "a string, b string")
    got = [tuple(r) for r in clean.validate_rows(d, ["a", "b"]).select("a", "b", "error").collect()]
    assert got == [(1.5, None, "b"), (None, 2.0, "a"), (3.0, 4.0, None)]


def test_mcar_statistic_is_small_for_random_holes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    rows = [[None if rng.random() < 0.2 else float(v) for v in r] for r in x]
    r = profile.mcar_test(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).first()
    assert r.dof == 9 and r.p_value > 0.001
    tied = [[float(a), None if a > 0.5 else float(b), float(c)] for a, b, c in x]
    assert profile.mcar_test(spark.createDataFrame(tied, "a double, b double, c double"), ["a", "b", "c"]).first().p_value < 1e-6


def test_metadata_listed_twice_does_not_multiply(spark):
    from seatrack.operators.joins import join_metadata

    m = spark.createDataFrame([(1, "x"), (2, "y")], "mmsi int, gear_type string")
    meta = spark.createDataFrame([(1, "B"), (1, "A"), (3, "C")], "mmsi int, gear_type string")
    got = sorted((r.mmsi, r.gear_type) for r in join_metadata(m, meta).collect())
    assert got == [(1, "A"), (2, None)]


@pytest.mark.parametrize("higher", [False, True])
@pytest.mark.parametrize("delta", [0.0, 0.3])
def test_early_stopping_equals_a_loop(spark, higher, delta):
    rng = random.Random(11)
    rows = [(run, e, rng.uniform(0, 1) * (40 / (e + 5) if not higher else e / 20 + 1)) for run in range(8) for e in range(1, 60)]
    h = spark.createDataFrame(rows, "run int, epoch int, v double")
    got = {r.run: (r.best_epoch, r.best_value, r.stop_after) for r in
           metrics.early_stopping(h, ["run"], "epoch", "v", 4, delta, higher, chunk=7).collect()}
    for run in range(8):
        best = at = stop = None
        bad = 0
        for i, (_, e, v) in enumerate([r for r in rows if r[0] == run], 1):
            better = best is None or (v > best + delta if higher else v < best - delta)
            if better:
                best, at, bad = v, e, 0
            else:
                bad += 1
                if bad >= 4:
                    stop = i
                    break
        assert got[run] == (at, best, stop)


def test_early_stopping_with_several_values_of_one_epoch(spark):
    rng = random.Random(3)
    rows = [(run, e, i, rng.choice([None, rng.uniform(0, 1) * 40 / (e + 5)])) for run in range(8) for e in range(1, 20) for i in range(5)]
    h = spark.createDataFrame(rng.sample(rows, len(rows)), "run int, epoch int, id int, v double").repartition(5).cache()
    for tie in (["id"], []):
        got = {r.run: (r.best_epoch, r.best_value, r.stop_after) for r in metrics.early_stopping(h, ["run"], "epoch", "v", 12, 0.05, chunk=7, tie=tie).collect()}
        for run in range(8):
            best = at = stop = None
            bad = 0
            order = sorted([r for r in rows if r[0] == run], key=lambda r: (r[1], r[2] if tie else 0, r[3] is None, r[3] or 0.0))
            for i, (_, e, _, v) in enumerate(order, 1):
                if v is not None and (best is None or v < best - 0.05):
                    best, at, bad = v, e, 0
                elif best is not None:
                    bad += 1
                    if bad >= 12:
                        stop = i
                        break
            assert got[run] == (at, best, stop)


def test_quantiles_compute_each_step_of_the_bits_once(spark):
    from seatrack.operators.quantiles import exact_quantiles

    d = exact_quantiles(spark.range(10).selectExpr("CAST(id AS DOUBLE) AS v"), ["v"], [0.5])
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("LOG2(") == 7  # a round has its own and those of the rounds before, each twice
    assert d.first().quantile == 4.5


def test_scores_with_nothing_predicted(spark):
    d = spark.createDataFrame([(0, 0), (1, 0)], "t int, p int")
    r = metrics.classification_scores(d, "t", "p").first()
    assert (r.accuracy, r.precision, r.recall, r.f1_score) == (0.5, 0.0, 0.0, 0.0)


def test_ordered_bits(spark):
    import struct

    from seatrack.operators.quantiles import ordered_bits

    rng = random.Random(11)
    values = [0.0, -0.0, 1.0, -1.0, 2.0, 0.5, 1e308, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, math.inf, -math.inf, math.pi]
    values += [math.ldexp(1.0, e) for e in range(-1074, 1024, 7)] + [math.nextafter(math.ldexp(1.0, e), s) for e in range(-1000, 1023, 13) for s in (0.0, math.inf)]
    values += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(2000)]
    d = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "x double")
    for r in d.select("x", ordered_bits(d["x"]).alias("b")).collect():
        if r.x is None or math.isnan(r.x):
            assert r.b is None
        else:
            size = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
            assert r.b == (-size if r.x < 0 else size)


@pytest.mark.parametrize("limit", [0, 100_000])
def test_quantiles_of_values_that_share_their_leading_bits(spark, limit):
    """Groups of very different sizes, with NULL as a group; broadcast or not."""
    rng = random.Random(2)
    data = [(None, 1e9 + rng.random() * 1e-6) for _ in range(3000)] + [(1, 7.0)] + [(2, float(rng.randrange(3))) for _ in range(5000)] + [(3, None)]
    d = spark.createDataFrame(data, "g int, x double").repartition(5)
    got = {(r.g, r.p): r.quantile for r in exact_quantiles(d, ["x"], [0.1, 0.5, 0.9], ["g"], limit).collect()}
    want = {(g, p): float(np.quantile([x for k, x in data if k == g], p)) for g in (None, 1, 2) for p in (0.1, 0.5, 0.9)}
    assert got == pytest.approx(want, rel=1e-15, abs=0)


def test_long_falling_history(spark):
    """Every epoch is a record: pointers are searched block by block and doubled."""
    from pyspark.sql import functions as F

    n = 20_000
    h = spark.range(n).select(F.lit("r").alias("run"), F.col("id").alias("epoch"), (1.0 - F.col("id") / n).alias("v"))
    for delta, patience, best, stop in ((0.0, 3, n - 1, None), (0.01, 5, 0, 1 + 5), (0.01, 250, None, None)):
        r = metrics.early_stopping(h, ["run"], "epoch", "v", patience, delta, chunk=500).first()
        if best is None:  # an improvement about every 201 epochs
            at = i = 0
            for i in range(n):
                if 1.0 - i / n < 1.0 - at / n - delta:
                    at = i
            best = at
        assert (r.best_epoch, r.stop_after) == (best, stop)


def test_stopping_without_values(spark):
    rows = [("a", i, None) for i in range(6)] + [("b", 0, None), ("b", 1, 3.0), ("b", 2, None), ("b", 3, 4.0)]
    h = spark.createDataFrame(rows, "run string, epoch int, v double")
    got = {r.run: (r.best_epoch, r.best_value, r.stop_after) for r in metrics.early_stopping(h, ["run"], "epoch", "v", 2).collect()}
    assert got == {"a": (None, None, None), "b": (1, 3.0, 4)}


def test_mcar_moments_are_maximum_likelihood(spark):
    """Against EM over the rows in NumPy, with correlated columns of very different sizes."""
    rng = np.random.default_rng(5)
    n, p = 600, 4
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) * [1, 100, 0.01, 5] + [1e6, 3, 0, -40]
    x[rng.random((n, p)) < 0.2] = np.nan
    x[0] = np.nan
    mean, cov = np.nanmean(x, 0), np.diag(np.nanvar(x, 0))
    known = x[~np.isnan(x).all(1)]
    for _ in range(3000):
        filled, rest = np.empty_like(known), np.zeros((p, p))
        for k, row in enumerate(known):
            o = ~np.isnan(row)
            b = cov[np.ix_(~o, o)] @ np.linalg.inv(cov[np.ix_(o, o)])
            filled[k] = row
            filled[k, ~o] = mean[~o] + b @ (row[o] - mean[o])
            rest[np.ix_(~o, ~o)] += cov[np.ix_(~o, ~o)] - b @ cov[np.ix_(o, ~o)]
        new = filled.mean(0)
        cov, mean, old = (filled - new).T @ (filled - new) / len(known) + rest / len(known), new, mean
        if np.abs((new - old) / np.sqrt(np.diag(cov))).max() < 1e-12:
            break
    cov = cov * len(known) / (len(known) - 1)
    d2, dof = 0.0, -p
    for pattern in {tuple(np.isnan(r)) for r in known}:
        some, o = known[(np.isnan(known) == pattern).all(1)], ~np.array(pattern)
        away = some[:, o].mean(0) - mean[o]
        d2, dof = d2 + len(some) * away @ np.linalg.inv(cov[np.ix_(o, o)]) @ away, dof + o.sum()
    d = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double, d double")
    r = profile.mcar_test(d, ["a", "b", "c", "d"]).first()
    assert r.statistic == pytest.approx(d2, rel=1e-6) and r.dof == dof
    other = profile.mcar_test(d, ["a", "b", "c", "d"], moments="available").first()
    assert other.dof == dof and other.statistic != pytest.approx(d2, rel=1e-6)


def test_chi_square_tail(spark):
    """Against known quantiles of the distribution and its closed form for two degrees of freedom."""
    from pyspark.sql import functions as F

    points = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (124.34211340400407, 100, 0.05),
              (0.0039321400000195, 1, 0.95), (6.634896601021213, 1, 0.01), (23.209251158954356, 10, 0.01), (0.0, 3, 1.0), (5.0, 0, 1.0)]
    points += [(x, 2, math.exp(-x / 2)) for x in (0.1, 1.0, 3.0, 10.0, 60.0)]
    d = spark.createDataFrame(points, "x double, k int, p double")
    for r in d.select("*", profile.chi2_tail(F.col("x"), F.col("k")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, rel=1e-6)
