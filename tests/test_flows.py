from __future__ import annotations

import pytest
from conftest import SF
from pyspark.sql import functions as F

from seatrack import schema as S
from seatrack.fixtures import messages
from seatrack.operators import clean, models, resample, risk, series
from seatrack.operators.ordered import Track
from seatrack.plans import flows
from seatrack.plans.q_models import load_linear_models, train_stats
from seatrack.plans.q_risk import segments
from seatrack.sources import readers, writers
from seatrack.sources.staging import stage, staging_root

T = Track(tie=("event_id",))


def test_cable_risk_equals_scoring_every_window(spark):
    """Starting from the windows near a cable gives the windows that a full scan keeps."""
    m, seg, stats = messages(spark, SF), segments(spark), train_stats(spark)
    got = flows.cable_risk(m, T, seg, stats, load_linear_models, 3600, 12, 5, near_m=15_000.0)
    rows = stage(flows.scoring_rows(m, T, 3600), "test-rows")
    w = series.sliding_windows(rows, T.without_tie(), S.MODEL_FEATURES, 12, 5)
    end = F.element_at("window", -1)
    w = risk.near_cable(w.withColumns({"a": end["latitude"], "o": end["longitude"]}), seg, 15_000.0, "a", "o").where("near_cable")
    means = {f: (mean, std) for f, mean, std in ((r.feature, r.mean, r["std"]) for r in stats.collect())}
    z = F.transform("window", lambda r: F.struct(*[((r[c] - means[c][0]) / means[c][1]).alias(c) for c in S.MODEL_FEATURES]))
    w = w.withColumn("used_fallback", F.exists("window", lambda r: clean.any_of([r[c].isNull() for c in S.MODEL_FEATURES])))
    scored = models.score_windows(w.withColumn("window", z), load_linear_models, S.MODEL_FEATURES)
    want = risk.risk_levels(scored, seg).where("label = 1")
    key = ["mmsi", "window_no", "window_start", "window_end", "risk_level", "used_fallback"]
    have = sorted(tuple(r) for r in got.select(key).collect())
    assert have and have == sorted(tuple(r) for r in want.select(key).collect())
    first = got.first()
    assert len(first.forecast) == 20 and len(first.input) == 12 and 0.5 <= first.fishing_confidence <= 1


def test_only_ends_of_windows_are_compared_with_cables(spark, monkeypatch):
    seen, near = [], risk.near_cable
    monkeypatch.setattr(risk, "near_cable", lambda df, *a, **k: seen.append(df) or near(df, *a, **k))
    m = messages(spark, SF).where("mmsi % 8 = 0")
    flows.cable_risk(m, T, segments(spark), train_stats(spark), load_linear_models, 3600, 12, 5, near_m=15_000.0)
    rows = stage(flows.scoring_rows(m, T, 3600), "test-rows")
    windows = rows.groupBy("mmsi").agg(F.floor((F.count(F.lit(1)) - 12) / 5 + 1).alias("n")).where("n > 0").agg(F.sum("n")).first()[0]
    assert [d.count() for d in seen] == [windows] and windows


def test_newest_slots_equal_the_end_of_the_whole_grid(spark):
    rows = [(v, e, None if e % 7 == 0 else float(e % 30), 1.0) for v in (1, 2, 3) for e in (5, 1_000, 90_000, 400_000, 400_090, 1_000_000 * v)]
    d = spark.createDataFrame([*rows, (4, 77, None, None)], "mmsi int, epoch bigint, sog double, rot double")
    for track in (Track(), Track(chunk_s=None)):
        for step, exact in ((3600, False), (35_000, False), (500, True)):
            whole, part = (resample.scoring_grid(d, track, step, exact, ["sog"], ["rot"], newest=n) for n in (None, 30))
            want = series.last_rows(whole, track, 30).drop("back").collect()
            assert sorted(map(tuple, part.collect()), key=str) == sorted(map(tuple, want), key=str) and len(want) > 30


def test_latest_risk_answers_for_every_vessel(spark):
    m, seg, stats = messages(spark, SF), segments(spark), train_stats(spark)
    rows = flows.latest_risk(m, T, seg, stats, load_linear_models, 3600, 12, near_m=60_000.0).collect()
    vessels = flows.scoring_rows(m, T, 3600).select("mmsi").distinct().count()
    assert len(rows) == vessels == len({r.mmsi for r in rows})
    assert "scored" in {r.status for r in rows}
    far = flows.latest_risk(m, T, seg, stats, load_linear_models, 3600, 12, near_m=0.001)
    assert {(r.status, r.label) for r in far.collect()} == {("not near a cable", None)}
    for r in rows:
        if r.status != "scored":
            assert (r.label, r.logit, r.probability, r.risk_level, r.zone_alert) == (None,) * 5
        elif r.label == 0:
            assert r.risk_level == 0 and r.zone_alert is None and r.probability < 0.5
        else:
            assert r.risk_level in (1, 2, 3) and r.zone_alert in (True, False) and len(r.forecast) == 20
            assert not r.zone_alert or r.risk_level == 3


def test_bad_times_and_file_dates(spark):
    root = f"{staging_root(spark)}/test-files"
    row = {n: None for n, _ in S.MESSAGE_FILE_FIELDS}
    good = row | {"# Timestamp": "31/01/2025 10:00:05", "MMSI": 1, "SOG": 2.5}
    rows = [good, good | {"SOG": 9.0}, good | {"# Timestamp": "2025-01-31", "MMSI": 2}]
    d = spark.createDataFrame([[r[n] for n, _ in S.MESSAGE_FILE_FIELDS] for r in rows], S.MESSAGE_FILE)
    d.write.mode("overwrite").option("header", True).csv(root)
    got = {r.mmsi: r for r in readers.read_messages(spark, root).collect()}
    assert got[1].epoch == 1738317605 and got[1].sog == 2.5 and got[2].ts is None
    names = spark.createDataFrame([("aisdk-2025-03-19_fishing_labeled.csv",), ("aisdk-2025-13-99.csv",), ("x.csv",)], "n string")
    assert [str(r[0]) for r in names.select(readers.file_date(F.col("n"))).collect()] == ["2025-03-19", "None", "None"]


def test_versions_and_stats_documents(spark, tmp_path):
    v = spark.createDataFrame([("v2",), ("v10",), ("old",)], "version string")
    assert readers.next_version(v).first()[0] == "v11"
    assert readers.next_version(v.limit(0)).first()[0] == "v1"
    (tmp_path / "stats.json").write_text('{"sog": {"mean": 1.5, "std": 2.0}, "rot": {"mean": 0.0, "std": 0.0}}')
    got = {r.feature: (r.mean, r["std"]) for r in readers.read_stats_document(spark, str(tmp_path / "stats.json")).collect()}
    assert got == {"sog": (1.5, 2.0), "rot": (0.0, 0.0)}


def test_dynamic_overwrite_keeps_other_days(spark, tmp_path):
    d = spark.createDataFrame([("2025-01-01", 1), ("2025-01-02", 2)], "file_date string, x int")
    writers.write_prepared(d, str(tmp_path / "p"))
    writers.write_prepared(d.where("x = 2").withColumn("x", F.lit(7)), str(tmp_path / "p"))
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [1, 7]


def test_horizons_and_config_checks(spark):
    d = spark.createDataFrame([(10, 30), (20, 180), (10, None), (15, 60)], "m int, s int")
    assert [r[0] for r in d.select(clean.horizon_steps(F.col("m"), F.col("s"))).collect()] == [20, 7, 60, None]
    with pytest.raises(ValueError):
        clean.check_sampling(True, True, True)
    with pytest.raises(ValueError):
        clean.check_sampling(True, False, False)


def test_cables_from_a_file_and_results_to_json(spark, tmp_path):
    lines = ["Cable,Point,Latitude,Longitude", "A,Start,1.0,2.0", "A,End,4.0,5.0", "A,Bend_10,3.0,4.0", "A,Bend_2,2.0,3.0", "B,Start,0,0", "B,End,1,1"]
    (tmp_path / "cables.csv").write_text("\n".join(lines) + "\n")
    seg = risk.cable_segments(readers.read_cables(spark, str(tmp_path / "cables.csv")))
    got = sorted((r.cable, r.lon1, r.lat1, r.lon2, r.lat2) for r in seg.collect())
    assert got == [("A", 2.0, 1.0, 3.0, 2.0), ("A", 3.0, 2.0, 4.0, 3.0), ("A", 4.0, 3.0, 5.0, 4.0), ("B", 0.0, 0.0, 1.0, 1.0)]
    results = spark.createDataFrame([(1, [(1.0, 2.0)])], "risk_level int, forecast array<struct<latitude:double,longitude:double>>")
    writers.write_results(results, str(tmp_path / "results"))
    back = spark.read.json(str(tmp_path / "results")).first()
    assert back.risk_level == 1 and back.forecast[0].longitude == 2.0
