"""Vessel joins: results, and plans that deal no window or aggregate over chunks by vessel alone."""

from __future__ import annotations

import pytest
from conftest import SF
from pyspark.sql import functions as F

from seatrack.fixtures import messages
from seatrack.operators import clean, joins, ordered, resample
from seatrack.operators.ordered import Track
from seatrack.plans import flagship, flows

T = Track(tie=("event_id",))


def nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def dealt_by_vessel(df, key="mmsi"):
    """Windows and aggregates over the vessel and something finer whose rows are dealt by the vessel alone."""
    out = []
    for node in nodes(df._jdf.queryExecution().executedPlan()):
        name = node.nodeName()
        if name not in ("Window", "WindowGroupLimit", "HashAggregate", "SortAggregate", "ObjectHashAggregate"):
            continue
        wanted = node.partitionSpec() if name.startswith("Window") else node.groupingExpressions()
        names = [wanted.apply(i).toString().split("#")[0] for i in range(wanted.size())]
        dealt = node.children().apply(0).outputPartitioning()
        if dealt.getClass().getSimpleName() == "HashPartitioning" and names[:1] == [key] and len(names) > 1:
            by = [dealt.expressions().apply(i).toString().split("#")[0] for i in range(dealt.expressions().size())]
            # The summaries of chunks are small and dealt by vessel on purpose; a window over them has the vessel alone.
            if by == [key]:
                out.append((name, names))
    return out


@pytest.fixture
def plain(spark):
    """Plans as they are, without broadcasts."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_the_check_finds_joins_on_the_vessel(plain):
    m = messages(plain, SF)
    hot = m.join(m.groupBy("mmsi").agg(F.max("gear_type").alias("g")), "mmsi")
    assert dealt_by_vessel(ordered.previous_time(hot, T))


def test_plans_are_dealt_by_vessel_and_chunk(plain):
    m = messages(plain, SF, True)
    meta = m.select("mmsi", "gear_type").distinct()
    joined = joins.join_metadata(m, meta, track=T)
    assert dealt_by_vessel(ordered.previous_time(joined, T)) == []
    assert dealt_by_vessel(resample.bucket_first(joined, T, 3600)) == []
    assert dealt_by_vessel(flagship.trawling_hours(plain, SF)) == []
    one = clean.dedup_on_key(m, ["mmsi", "epoch"], ["event_id"])
    columns = ["latitude", "longitude", "sog"]
    assert dealt_by_vessel(resample.downsample_first(one, T, columns, 7)) == []
    assert dealt_by_vessel(resample.resample_linear(one, T, columns, 7, "trawling")) == []
    assert dealt_by_vessel(resample.resample_with_mode(one, T, columns, 7, "trawling")) == []
    assert dealt_by_vessel(resample.upsample(one, T, columns, (1, 11), "trawling")) == []


@pytest.mark.parametrize("flow", ["prepare", "prepare_early"])
def test_flows_are_dealt_by_vessel_and_chunk(plain, monkeypatch, flow):
    staged = []
    monkeypatch.setattr(flows, "stage", lambda df, label, f=flows.stage: staged.append((label, dealt_by_vessel(df))) or f(df, label))
    m = messages(plain, SF, flow == "prepare_early")
    out = flows.prepare(m, T, 21_600, 864_000, 4, exact=True) if flow == "prepare" else flows.prepare_early(m, T, 3600, steps=3)
    assert [x for x in staged if x[1]] == [] and dealt_by_vessel(out) == []


def test_join_per_key_agrees_with_a_plain_join(spark):
    m = messages(spark, SF).select("mmsi", "epoch", "event_id").withColumn("mmsi", F.when(F.col("event_id") % 50 != 0, F.col("mmsi")))
    m = m.withColumn("epoch", F.when(F.col("event_id") % 41 != 0, F.col("epoch")))
    table = m.groupBy("mmsi").agg(F.max("event_id").alias("top")).where("mmsi % 3 <> 0")
    for how in ("left", "inner", "left_semi"):
        want = sorted(map(str, m.join(table, "mmsi", how).collect()))
        assert sorted(map(str, ordered.join_per_key(m, table, T, how).collect())) == want
        assert sorted(map(str, ordered.join_per_key(m, table, Track(chunk_s=None), how).collect())) == want
        assert sorted(map(str, ordered.join_per_key(m, table, T, how, chunks_of=m.where("epoch IS NOT NULL").union(m)).collect())) == want


def test_key_values(spark):
    m = messages(spark, SF)
    got = ordered.join_key_values(m, ordered.key_values(m, T, a=("min", F.col("epoch")), b=("max", F.col("sog") > 5), n=("sum", F.lit(1))), T)
    want = m.join(m.groupBy("mmsi").agg(F.min("epoch").alias("a"), F.max(F.col("sog") > 5).alias("b"), F.count("*").alias("n")), "mmsi")
    assert sorted(map(str, got.select("event_id", "a", "b", "n").collect())) == sorted(map(str, want.select("event_id", "a", "b", "n").collect()))


def test_nothing_is_shuffled_after_the_grid_is_produced(plain):
    out = flows.prepare(messages(plain, SF), T, 21_600, 864_000, 4, exact=True)
    names = [n.nodeName() for n in nodes(out._jdf.queryExecution().executedPlan())]
    grid = names.index("Generate")
    assert not {"Exchange", "Window", "Sort"} & set(names[:grid]) and "Window" in names[grid:]


def test_future_of_the_grid_equals_a_window_over_it(spark):
    """Positions carried by messages against leads over the expanded grid, with holes of several slots."""
    from seatrack.operators import series

    rows = [(1, 60 * i, 0.5 * i, -1.0 * i) for i in range(90) if i % 7 not in (2, 3, 4)] + [(2, 60 * i, None if i % 2 else 1.0 * i, 2.0) for i in range(21)] + [(3, 0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "mmsi long, epoch long, latitude double, longitude double").repartition(5)
    for track in (Track(), Track(chunk_s=600)):
        near = resample.grid_neighbours(d, track, ["latitude", "longitude"])
        got = resample.expand_with_future(near, track, 60, ["latitude", "longitude"], max_gap_s=300, horizon=6)
        grid = resample.expand_grid(near, track, 60, ["latitude", "longitude"], max_gap_s=300)
        want = series.future_positions(grid, track, 6, grid_step_s=60)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
