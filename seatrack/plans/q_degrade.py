"""Queries over splits and controlled degradation of trajectory data."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatrack import schema as S
from seatrack.fixtures import messages, sql_with
from seatrack.operators import degrade, split
from seatrack.operators.ordered import Track
from seatrack.plans.q_clean import split_sql
from seatrack.plans.registry import query, rounded

TRAJECTORY = {
    "mmsi": "trajectory_id", "epoch": "t", "trawling": "label", "sog": "euc_speed", "cog": "bearing",
    "rot": "signed_turn", "draught": "distanceToShore",
}
FEATURES = ["euc_speed", "bearing", "signed_turn", "distanceToShore"]
TRACK = Track(("trajectory_id",), "t", ("event_id",))
TRAJ_SQL = 'traj AS (SELECT event_id, mmsi AS trajectory_id, epoch AS t, trawling AS label, latitude, longitude, sog AS euc_speed, cog AS bearing, rot AS signed_turn, draught AS "distanceToShore" FROM msg)'


def trajectories(spark, sf):
    keep = ["event_id", "mmsi", "epoch", "trawling", "latitude", "longitude", "sog", "cog", "rot", "draught"]
    return messages(spark, sf).select(*[F.col(c).alias(TRAJECTORY.get(c, c)) for c in keep])


@query("d1_split_by_gear", sql_with("SELECT m.event_id, m.mmsi, a.split FROM msg m JOIN assigned a ON m.mmsi = a.mmsi", split_sql("mmsi", "gear_type", "msg", 0.7, 0.15)))
def _(spark, sf):
    return split.split_rows(messages(spark, sf)).select("event_id", "mmsi", "split")


@query("d2_split_by_label", sql_with("SELECT m.event_id, m.label, a.split FROM traj m JOIN assigned a ON m.trajectory_id = a.trajectory_id AND m.label = a.label",
       TRAJ_SQL, split_sql("trajectory_id", "label", "traj", 0.7, 0.1)))
def _(spark, sf):
    return split.split_rows(trajectories(spark, sf), "trajectory_id", "label", 0.7, 0.1).select("event_id", "label", "split")


DUPES_SQL = """idx AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || CAST(event_id AS VARCHAR))) AS i, count(*) OVER () AS n FROM traj),
draws AS (SELECT CAST('0x' || substr(md5('42:draw|' || CAST(i AS VARCHAR)), 1, 15) AS BIGINT) % n + 1 AS i FROM idx WHERE i <= floor(n * CAST(0.3 AS DOUBLE)))"""


@query("d3_add_duplicates", sql_with("SELECT event_id, trajectory_id, label FROM idx UNION ALL SELECT x.event_id, x.trajectory_id, x.label FROM idx x JOIN draws d ON x.i = d.i", TRAJ_SQL, DUPES_SQL))
def _(spark, sf):
    return degrade.add_duplicates(trajectories(spark, sf), ["event_id"], 30).select("event_id", "trajectory_id", "label")


@query("d4_label_noise", sql_with("""SELECT event_id, trajectory_id, CASE WHEN trajectory_id IN (SELECT trajectory_id FROM (
 SELECT trajectory_id, row_number() OVER (ORDER BY md5('42|' || CAST(trajectory_id AS VARCHAR))) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT trajectory_id FROM traj WHERE label = 1))
 WHERE rk <= floor(n * CAST(0.3 AS DOUBLE))) THEN 0 ELSE label END AS label FROM traj""", TRAJ_SQL))
def _(spark, sf):
    return degrade.add_label_noise(trajectories(spark, sf), 30).select("event_id", "trajectory_id", "label")


def _missing_sql(c, p):
    return f"""CASE WHEN row_number() OVER (ORDER BY md5('42:{c}|' || CAST(event_id AS VARCHAR))) <= floor(count(*) OVER () * CAST({p / 100.0} AS DOUBLE)) THEN NULL ELSE "{c}" END AS "{c}" """


@query("d5_missing_values", sql_with("SELECT event_id, " + ", ".join(_missing_sql(c, p) for c, p in S.MISSING_SHARES.items()) + " FROM traj", TRAJ_SQL))
def _(spark, sf):
    return degrade.add_missing_values(trajectories(spark, sf), ["event_id"], S.MISSING_SHARES).select("event_id", *S.MISSING_SHARES)


@query("d5b_missing_values_threshold", sql_with("SELECT event_id, " + ", ".join(
    f"""CASE WHEN CAST('0x' || substr(md5('42:{c}|' || CAST(event_id AS VARCHAR)), 1, 15) AS BIGINT) % 10000 >= {p * 100} THEN "{c}" END AS "{c}" """ for c, p in S.MISSING_SHARES.items()) + " FROM traj", TRAJ_SQL))
def _(spark, sf):
    return degrade.add_missing_values(trajectories(spark, sf), ["event_id"], S.MISSING_SHARES, exact=False).select("event_id", *S.MISSING_SHARES)


IRREGULAR_SQL = """irr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY md5('42|' || CAST(event_id AS VARCHAR))) AS rk, count(*) OVER (PARTITION BY trajectory_id) AS n,
 CAST(1 AS DOUBLE) + CAST(9 AS DOUBLE) * ((CAST('0x' || substr(md5('42:share|' || CAST(trajectory_id AS VARCHAR)), 1, 15) AS BIGINT) % 1000000) / CAST(1000000 AS DOUBLE)) AS pct FROM traj)
 WHERE rk > floor(n * (pct / CAST(100 AS DOUBLE))))"""


@query("d6_drop_irregularly", sql_with("SELECT event_id, trajectory_id FROM irr", TRAJ_SQL, IRREGULAR_SQL))
def _(spark, sf):
    return degrade.drop_irregularly(trajectories(spark, sf), ["event_id"]).select("event_id", "trajectory_id")


LEVELS = [10, 20, 30, 40]


def variants_sql(part, clean=False):
    """``part(name, rows, lost, missing)`` of every corrupted version, in one query over ``VARIANT_VIEWS``."""
    parts = []
    for name, steps, level in [*([("clean", (), None)] if clean else []), *degrade.corruption_variants(LEVELS)]:
        rows = ("copies" if "dupes" in steps else "plain") + ("_left" if "irregular" in steps else "")
        lost = "FALSE" if level is None else f"trajectory_id IN (SELECT trajectory_id FROM noisy WHERE rk <= floor(n * CAST({level / 100} AS DOUBLE)))"
        parts.append(part(name, rows, lost, "missing" in steps))
    return " UNION ALL ".join(parts)


def _left_sql(name, key):
    return f"""{name}_left AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY md5({key})) AS rk, count(*) OVER (PARTITION BY trajectory_id) AS n,
 CAST(1 AS DOUBLE) + CAST(9 AS DOUBLE) * ((CAST('0x' || substr(md5('42:share|' || CAST(trajectory_id AS VARCHAR)), 1, 15) AS BIGINT) % 1000000) / CAST(1000000 AS DOUBLE)) AS pct FROM {name})
 WHERE rk > floor(n * (pct / CAST(100 AS DOUBLE))))"""


VARIANT_VIEWS = [
    TRAJ_SQL, DUPES_SQL, "plain AS (SELECT event_id, trajectory_id, label FROM traj)",
    "copies AS (SELECT event_id, trajectory_id, label, 0 AS copy_no FROM idx UNION ALL SELECT x.event_id, x.trajectory_id, x.label, row_number() OVER (PARTITION BY x.event_id) AS copy_no FROM idx x JOIN draws d ON x.i = d.i)",
    _left_sql("plain", "'42|' || CAST(event_id AS VARCHAR)"), _left_sql("copies", "'42|' || CAST(event_id AS VARCHAR) || '|' || CAST(copy_no AS VARCHAR)"),
    "noisy AS (SELECT trajectory_id, row_number() OVER (ORDER BY md5('42|' || CAST(trajectory_id AS VARCHAR))) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT trajectory_id FROM traj WHERE label = 1))",
]
_CELLS = ", ".join(f'c."{c}" AS "{c}"' for c in S.MISSING_SHARES)


@query("d7_all_corrupted_versions", sql_with(
    variants_sql(lambda name, rows, lost, missing: f"SELECT '{name}' AS variant, r.event_id, CASE WHEN {lost} THEN 0 ELSE r.label END AS label, {_CELLS} FROM (SELECT event_id, trajectory_id, label FROM {rows}) r JOIN {'holes' if missing else 'whole'} c ON c.event_id = r.event_id"),
    *VARIANT_VIEWS, "whole AS (SELECT event_id, " + ", ".join(f'"{c}"' for c in S.MISSING_SHARES) + " FROM traj)",
    "holes AS (SELECT event_id, " + ", ".join(_missing_sql(c, p) for c, p in S.MISSING_SHARES.items()) + " FROM traj)"))
def _(spark, sf):
    d = degrade.all_corrupted_versions(trajectories(spark, sf), LEVELS, ["event_id"], S.MISSING_SHARES)
    return d.select("variant", "event_id", "label", *S.MISSING_SHARES)


@query("d8_degrade_zero_impute", sql_with("SELECT event_id, " + ", ".join(f'coalesce("{c}", 0.0) AS "{c}"' for c in S.MISSING_SHARES) + " FROM (SELECT event_id, " + ", ".join(
    _missing_sql(c, p) for c, p in S.MISSING_SHARES.items()) + " FROM irr)", TRAJ_SQL, IRREGULAR_SQL))
def _(spark, sf):
    d = degrade.degrade(trajectories(spark, sf), TRACK, ["event_id"], S.MISSING_SHARES, FEATURES, irregular=True, missing=True, impute="zero")
    return d.select("event_id", *S.MISSING_SHARES)


@query("d8b_degrade_linear_impute", sql_with("SELECT event_id, " + ", ".join(
    f"""CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_p IS NOT NULL AND {c}_n IS NOT NULL THEN {c}_p + ({c}_n - {c}_p) * ((rn - {c}_rp) / ({c}_rn - {c}_rp)::DOUBLE) ELSE coalesce({c}_p, {c}_n) END AS {c}"""
    for c in ("bearing", "euc_speed")) + " FROM nb", TRAJ_SQL,
    "holes AS (SELECT event_id, trajectory_id, t, " + ", ".join(_missing_sql(c, p) for c, p in (("bearing", 21), ("euc_speed", 1))) + " FROM traj)",
    """nb AS (SELECT event_id, rn, """ + ", ".join(f"""{c}, last_value({c} IGNORE NULLS) OVER b AS {c}_p, last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS {c}_rp,
 first_value({c} IGNORE NULLS) OVER f AS {c}_n, first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS {c}_rn""" for c in ("bearing", "euc_speed")) +
    """ FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY t, event_id) AS rn FROM holes)
 WINDOW b AS (PARTITION BY trajectory_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY trajectory_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""))
def _(spark, sf):
    shares = {"bearing": 21, "euc_speed": 1}
    d = degrade.degrade(trajectories(spark, sf), TRACK, ["event_id"], shares, ["bearing", "euc_speed"], missing=True, impute="linear")
    return d.select("event_id", "bearing", "euc_speed")


@query("d8c_degrade_downsampled_mean_impute", sql_with("""SELECT trajectory_id, t, round(coalesce(e, avg(e) OVER ()), 6) AS euc_speed, label FROM (SELECT *,
 CASE WHEN row_number() OVER (ORDER BY md5('42:euc_speed|' || CAST(trajectory_id AS VARCHAR) || '|' || CAST(t AS VARCHAR))) <= floor(count(*) OVER () * CAST(0.25 AS DOUBLE)) THEN NULL ELSE euc_speed END AS e FROM (
 SELECT trajectory_id, CAST(floor(t / 43200) * 43200 AS BIGINT) AS t, arg_min(euc_speed, t * 1000000000 + event_id) FILTER (euc_speed IS NOT NULL) AS euc_speed, arg_min(label, t * 1000000000 + event_id) AS label
 FROM traj GROUP BY 1, 2 HAVING count(euc_speed) > 0))""", TRAJ_SQL))
def _(spark, sf):
    d = degrade.degrade(trajectories(spark, sf), TRACK, ["event_id"], {"euc_speed": 25}, ["euc_speed"], downsample_s=43200, missing=True, impute="mean")
    return rounded(d.select("trajectory_id", "t", "euc_speed", "label"), 6)
