"""Zones and distances against a plain Python calculation."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from seatrack.operators import risk
from seatrack.plans.q_risk import segments


@pytest.fixture(scope="module")
def cables(spark):
    return segments(spark).cache()


def foot(px, py, s):
    dx, dy = s.lon2 - s.lon1, s.lat2 - s.lat1
    t = min(max(((px - s.lon1) * dx + (py - s.lat1) * dy) / (dx * dx + dy * dy), 0), 1)
    return s.lon1 + t * dx, s.lat1 + t * dy


def degrees(px, py, segs):
    return min(math.dist((px, py), foot(px, py, s)) for s in segs)


def metres(lat1, lon1, lat2, lon2):
    mid = math.radians((lat1 + lat2) / 2)
    w = 1 - 0.0066943799901413165 * math.sin(mid) ** 2
    n = math.radians(lat2 - lat1) * 6378137 * (1 - 0.0066943799901413165) / w**1.5
    e = math.radians(lon2 - lon1) * 6378137 / math.sqrt(w) * math.cos(mid)
    return math.hypot(n, e)


@pytest.fixture(scope="module")
def points(spark, cables):
    rng, out = random.Random(5), []
    for i, s in enumerate(cables.collect()):
        for j in range(12):
            f = rng.random()
            out.append((len(out), s.lat1 + f * (s.lat2 - s.lat1) + rng.gauss(0, 0.03), s.lon1 + f * (s.lon2 - s.lon1) + rng.gauss(0, 0.05)))
        out.append((len(out), s.lat1, s.lon1))  # exactly on a cable end
    out.append((len(out), None, 11.0))
    return spark.createDataFrame(out, "id int, latitude double, longitude double").cache()


def test_segments(cables):
    assert cables.count() == 40
    assert cables.select("cable").distinct().count() == 21


@pytest.mark.parametrize("radius", [1602.0, 3738.0])
def test_in_zone(points, cables, radius):
    segs = cables.collect()
    for r in risk.in_zone(points, cables, radius).collect():
        if r.latitude is None:
            assert r.in_zone is None
            continue
        assert r.in_zone == (degrees(r.longitude, r.latitude, segs) < radius / 111320)


def test_near_cable(points, cables):
    segs = cables.collect()
    got = risk.near_cable(points, cables, 2200).collect()
    assert len(got) == points.count()
    for r in got:
        if r.latitude is None:
            continue
        near = any(metres(r.latitude, r.longitude, y, x) <= 2200 for x, y in (foot(r.longitude, r.latitude, s) for s in segs))
        assert r.near_cable == near


def test_near_pairs(points, cables):
    segs = cables.collect()
    want = {(p.id, s.cable, s.seg_no) for p in points.collect() if p.latitude is not None for s in segs
            if math.dist((p.longitude, p.latitude), foot(p.longitude, p.latitude, s)) < 3738 / 111320}
    got = [(r.id, r.cable, r.seg_no) for r in risk.near_pairs(points, cables, 3738).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_paths(spark, points, cables):
    rng = random.Random(2)
    pts = [r for r in points.collect() if r.latitude is not None][::6]
    rows = [(i, [(p.latitude + rng.gauss(0, 0.05) * j, p.longitude + rng.gauss(0, 0.05) * j) for j in range(4)], rng.randint(0, 1)) for i, p in enumerate(pts)]
    rows.append((9999, [(56.5, 11.0)], 1))
    # No point in the zone, but the line between the two points crosses the first cable.
    rows.append((10000, [(57.2, 10.65), (57.6, 10.70)], 1))
    d = spark.createDataFrame(rows, "id int, forecast array<struct<latitude:double,longitude:double>>, label int")
    segs, r = cables.collect(), 1602 / 111320
    d = risk.any_forecast_in_zone(d, cables)
    d = risk.first_forecast_in_zone(d, cables)
    d = risk.forecast_zone_steps(d, cables)
    d = risk.path_crosses_zone(d, cables)
    d = risk.risk_levels(d, cables)
    for x in d.collect():
        inside = [i for i, p in enumerate(x.forecast) if degrees(p.longitude, p.latitude, segs) < r]
        assert x.any_in_zone == bool(inside)
        assert x.first_in_zone == (inside[0] if inside else None)
        assert x.zone_steps == inside
        dense = [(a.longitude + (b.longitude - a.longitude) * f / 60, a.latitude + (b.latitude - a.latitude) * f / 60)
                 for a, b in zip(x.forecast, x.forecast[1:] or x.forecast) for f in range(61)]
        closest = min(degrees(px, py, segs) for px, py in dense)
        longest = max((math.dist(a, b) for a, b in zip(dense, dense[1:])), default=0.0)
        if closest <= r:
            assert x.crosses_zone
        elif closest > r + longest:
            assert not x.crosses_zone
        start = degrees(x.forecast[0].longitude, x.forecast[0].latitude, segs) < 3738 / 111320
        assert x.risk_level == (0 if x.label == 0 else 3 if x.crosses_zone else 2 if start else 1)
    assert [x.crosses_zone for x in d.where("id = 10000").collect()] == [True]
    assert [x.any_in_zone for x in d.where("id = 10000").collect()] == [False]


def test_many_segments_agree_with_brute_force(spark):
    rng = random.Random(7)
    lines = [(f"c{i}", 0, x, y, x + rng.uniform(-0.05, 0.05), y + rng.uniform(-0.05, 0.05))
             for i in range(50_000) for x, y in [(rng.uniform(0, 40), rng.uniform(40, 65))]]
    cables = spark.createDataFrame(lines, "cable string, seg_no int, lon1 double, lat1 double, lon2 double, lat2 double")
    rows = [(i, [(rng.uniform(40, 65), rng.uniform(0, 40))]) for i in range(40)]
    rows = [(i, [(y + 0.05 * k, x - 0.03 * k) for k in range(3)]) for i, [(y, x)] in rows] + [(40, None), (41, []), (42, rows[0][1])]
    d = spark.createDataFrame(rows, "id int, forecast array<struct<latitude:double,longitude:double>>")
    d = risk.path_crosses_zone(risk.forecast_zone_steps(d, cables), cables)
    assert "SinglePartition" not in d._jdf.queryExecution().executedPlan().toString()
    x1, y1, x2, y2 = (np.array([s[k] for s in lines]) for k in (2, 3, 4, 5))
    r = 1602 / 111320

    def closest(px, py):
        t = np.clip(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0, 1)
        return np.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1)).min()

    for x in d.collect():
        path = x.forecast or []
        want = [i for i, p in enumerate(path) if closest(p.longitude, p.latitude) < r]
        assert x.zone_steps == (want if x.forecast is not None else None)
        dense = [(a.longitude + (b.longitude - a.longitude) * f / 40, a.latitude + (b.latitude - a.latitude) * f / 40)
                 for a, b in zip(path, path[1:] or path) for f in range(41)]
        least = min((closest(*p) for p in dense), default=9.0)
        assert x.crosses_zone or least > r
        assert not x.crosses_zone or least <= r + 0.002


def test_cells_of_long_steps(spark):
    """The cells of a line against points along it; their number grows with its length, not with its box."""
    rng = random.Random(3)
    steps = [(rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(40)]
    steps += [(1.0, 1.0, 1.0, 1.0), (0.25, -2.0, 0.25, 2.0), (-2.0, 0.35, 2.0, 0.35), (0.0, 0.0, 60.0, 80.0), (0.3, 0.1, 0.3 + 1e-12, 2.0)]
    d = spark.createDataFrame([(i, *s) for i, s in enumerate(steps)], "i int, _ax double, _ay double, _bx double, _by double")
    got = {}
    for r in risk.cells_passed(d).select("i", "_cx", "_cy").collect():
        got.setdefault(r.i, set()).add((r["_cx"], r["_cy"]))
    for i, (ax, ay, bx, by) in enumerate(steps):
        seen = {(math.floor((ax + (bx - ax) * k / 9973) / risk.CELL), math.floor((ay + (by - ay) * k / 9973) / risk.CELL)) for k in range(9974)}
        assert seen <= got[i]
        assert len(got[i]) <= 3 * (abs(bx - ax) + abs(by - ay)) / risk.CELL + 9
