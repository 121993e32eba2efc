"""Chunked computations equal plain windows and a brute-force walk, also for a key with most of the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seatrack.operators import resample, series
from seatrack.operators.ordered import (
    Track,
    core_rows,
    framed,
    known_neighbours,
    next_time,
    previous_time,
    running_count,
    time_blocks,
    track_row_numbers,
)

CHUNKED = Track(("k",), "t", (), 50)
PLAIN = Track(("k",), "t", (), None)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for key, n, span in (("hot", 600, 3000), ("b", 40, 3000), ("c", 1, 10), ("d", 30, 40)):
        for t in sorted(rng.sample(range(-span // 3, span), min(n, span))):
            v = rng.choice([None, None, round(rng.uniform(0, 9), 2)])
            data.append((key, t, v, None if key == "b" else float(t % 7)))
    return spark.createDataFrame(data, "k string, t bigint, v double, u double").repartition(5).cache()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    left = sorted(map(str, a.select(cols).collect()))
    assert left == sorted(map(str, b.select(cols).collect()))
    assert left


def test_row_numbers_and_totals(rows):
    same(track_row_numbers(rows, CHUNKED, "rn", "n"), track_row_numbers(rows, PLAIN, "rn", "n"))


def test_adjacent_times(rows):
    same(previous_time(rows, CHUNKED), previous_time(rows, PLAIN))
    same(next_time(rows, CHUNKED), next_time(rows, PLAIN))


def test_running_count(rows):
    d = rows.withColumn("f", (F.col("t") % 3 == 0).cast("int"))
    same(running_count(d, CHUNKED, "f", "s"), running_count(d, PLAIN, "f", "s"))


@pytest.mark.parametrize("position", ["time", "row"])
@pytest.mark.parametrize("own", [True, False])
def test_known_neighbours(rows, position, own):
    args = {"position": position, "own_ahead": own, "next_name": "_next"}
    a = known_neighbours(rows, CHUNKED, ["v", "u"], **args)
    b = known_neighbours(rows, PLAIN, ["v", "u"], **args)
    same(a, b)


@pytest.mark.parametrize("before,after", [(0, 7), (5, 0), (4, 3)])
def test_row_blocks_have_complete_frames(rows, before, after):
    d, w = framed(rows, CHUNKED, before, after, size=10)
    got = core_rows(d.withColumn("s", F.collect_list("t").over(w.rowsBetween(-before, after))))
    plain = Window.partitionBy("k").orderBy("t").rowsBetween(-before, after)
    same(got, rows.withColumn("s", F.collect_list("t").over(plain)))


def test_blocks_split_a_hot_key(rows):
    d, _ = framed(rows, CHUNKED, 2, 2, size=20)
    sizes = d.groupBy("k", "_block").count().agg(F.max("count")).first()[0]
    assert sizes <= 20 + 4


def test_time_blocks(rows):
    d, w = time_blocks(rows, CHUNKED, 30, 45)
    got = core_rows(d.withColumn("s", F.collect_list("t").over(w.rangeBetween(-30, 45))))
    plain = Window.partitionBy("k").orderBy("t").rangeBetween(-30, 45)
    same(got, rows.withColumn("s", F.collect_list("t").over(plain)))


@pytest.mark.parametrize("by", ["row", "time"])
@pytest.mark.parametrize("ends", ["both", "forward", "none"])
def test_interpolation(rows, by, ends):
    got = series.interpolate(rows, CHUNKED, ["v"], by, ends)
    want = []
    per_key: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.k, r.t)):
        per_key.setdefault(r.k, []).append(r)
    for key, rs in per_key.items():
        pos = [r.t if by == "time" else i for i, r in enumerate(rs)]
        for i, r in enumerate(rs):
            before = [j for j in range(i + 1) if rs[j].v is not None]
            after = [j for j in range(i, len(rs)) if rs[j].v is not None]
            v = r.v
            if v is None and before and after:
                a, b = before[-1], after[0]
                v = rs[a].v + (rs[b].v - rs[a].v) * ((pos[i] - pos[a]) / (pos[b] - pos[a]))
            elif v is None and before and ends in ("both", "forward"):
                v = rs[before[-1]].v
            elif v is None and after and ends == "both":
                v = rs[after[0]].v
            want.append((key, r.t, None if v is None else round(v, 9)))
    have = sorted((r.k, r.t, None if r.v is None else round(r.v, 9)) for r in got.collect())
    assert have == sorted(want, key=lambda x: (x[0], x[1]))


def test_gap_limit_is_inclusive(spark):
    d = spark.createDataFrame([("a", 0, 1.0), ("a", 5, None), ("a", 10, 3.0), ("a", 15, None), ("a", 21, 5.0)], "k string, t bigint, v double")
    got = {r.t: r.v for r in series.interpolate_time(d, Track(("k",), "t", (), 8), ["v"], 10).collect()}
    assert got == {0: 1.0, 5: 2.0, 10: 3.0, 15: None, 21: 5.0}


def test_trajectory_breaks(spark):
    times = [0, 10, 70, 71, 131, 132, 400]
    d = spark.createDataFrame([("a", t) for t in times], "k string, t bigint")
    for track in (Track(("k",), "t", (), 50), Track(("k",), "t", (), None)):
        got = [r.trajectory_no for r in series.trajectory_ids(d, track, 59).orderBy("t").collect()]
        assert got == [0, 0, 1, 1, 2, 2, 3]
        same_gap = [r.trajectory_no for r in series.trajectory_ids(d, track, 60).orderBy("t").collect()]
        assert same_gap == [0, 0, 0, 0, 0, 0, 1]


def test_windows_of_short_and_empty_tracks(spark, rows):
    w = series.sliding_windows(rows, CHUNKED, ["v"], 50, 10)
    sizes = {r.k: r.n for r in rows.groupBy("k").agg(F.count("*").alias("n")).collect()}
    want = sum(max(0, (n - 50) // 10 + 1) for n in sizes.values() if n >= 50)
    assert w.count() == want
    assert series.sliding_windows(rows.limit(0), CHUNKED, ["v"], 5, 2).count() == 0


@pytest.mark.parametrize("max_gap", [None, 40])
def test_filled_grid_equals_grid_then_fill(spark, rows, max_gap):
    step, t = 10, Track(("k",), "t", (), 100)
    d = resample.align(rows, t, step)
    fused = resample.filled_grid(d, t, step, ["v"], ["u"], hold=["u"], max_gap_s=max_gap)
    grid = resample.fill_grid(d.select("k", "t", "v", "u"), t, step)
    lines = series.interpolate_time(grid, t, ["v"], max_gap)
    same(fused, series.forward_fill(lines, t, ["u"]))
    steps = fused.groupBy("k").agg(F.count("*").alias("n"), ((F.max("t") - F.min("t")) / step + 1).alias("m"))
    assert steps.where("n <> m").count() == 0


def test_gappy_keys_are_those_with_a_null_on_the_grid(spark, rows):
    step, t = 10, Track(("k",), "t", (), 100)
    d = resample.align(rows, t, step)
    for gap in (10, 30, 60, 5000):
        n = resample.grid_neighbours(d, t, ["v", "u"])
        kept = {r.k for r in resample.drop_gappy_keys(n, t, step, ["v", "u"], ["u"], gap).select("k").distinct().collect()}
        full = resample.expand_grid(n, t, step, ["v", "u"], hold=["u"], max_gap_s=gap)
        bad = {r.k for r in full.where("v IS NULL OR u IS NULL").select("k").distinct().collect()}
        assert kept == {"hot", "b", "c", "d"} - bad


def test_time_grid_is_complete(spark):
    b = spark.createDataFrame([("a", 86_000, 300_000), ("b", 5, 5)], "k string, min_epoch bigint, max_epoch bigint")
    got = sorted((r.k, r.t) for r in resample.time_grid(b, ["k"], 1000, "t").collect())
    assert got == [("a", t) for t in range(86_000, 300_001, 1000)] + [("b", 5)]


def test_rows_of_one_time_are_told_apart_by_the_tie(spark):
    """The last known value of a day, and the next of another, come from the last and first row of their time."""
    rng = random.Random(5)
    data = [(i, "a", 10 * (i // 6), rng.choice([None, float(i)])) for i in range(600)]
    rng.shuffle(data)
    d = spark.createDataFrame(data, "id bigint, k string, t bigint, v double").repartition(7).cache()
    chunked, plain = Track(("k",), "t", ("id",), 10), Track(("k",), "t", ("id",), None)
    same(known_neighbours(d, chunked, ["v"]), known_neighbours(d, plain, ["v"]))
    same(series.interpolate_time(d, chunked, ["v"], None), series.interpolate_time(d, plain, ["v"], None))


def test_a_row_between_known_rows_of_its_own_time_is_filled(spark):
    d = spark.createDataFrame([(1, "a", 5, 2.0), (2, "a", 5, None), (3, "a", 5, 4.0), (4, "a", 9, None)], "id bigint, k string, t bigint, v double")
    for limit in (None, 300):
        got = series.interpolate_time(d, Track(("k",), "t", ("id",)), ["v"], limit).orderBy("id").collect()
        assert [r.v for r in got] == [2.0, 2.0, 4.0, None]
