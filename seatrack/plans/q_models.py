"""Queries over models, evaluation and run histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatrack import schema as S
from seatrack.fixtures import messages, sql_with
from seatrack.operators import metrics, models, series
from seatrack.operators.ordered import Track
from seatrack.operators.split import split_rows
from seatrack.plans.registry import query, rounded

T = Track(tie=("event_id",))
_X = ["latitude", "longitude", "sog", "cog", "heading", "width"]

# Published mean and standard deviation of the training data.
TRAIN_STATS = [
    ("latitude", 56.885, 0.871), ("longitude", 9.741, 1.421), ("rot", 0.0036, 1.961), ("sog", 1.019, 2.196),
    ("cog", 195.169, 109.381), ("heading", 185.927, 99.521), ("draught", 4.040, 2.102), ("width", 6.903, 3.177),
    ("length", 26.504, 17.264),
]


def train_stats(spark):
    values = ", ".join(f"('{f}', CAST({m} AS DOUBLE), CAST({s} AS DOUBLE))" for f, m, s in TRAIN_STATS)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(feature, mean, std)")


_LINEAR = {"sog": -0.8, "cog": 0.3, "draught": 0.5}, 0.2
_SIMPLE = {"latitude": 0.7, "longitude": -0.2}, 0.1
FORECAST_STEPS = 20


def load_linear_models():
    """Linear stand-ins for the full and the position-only model, forecasting in degrees."""
    mean = {f: m for f, m, _ in TRAIN_STATS}
    std = {f: s for f, _, s in TRAIN_STATS}
    degrees = {"scale": (std["latitude"], std["longitude"]), "shift": (mean["latitude"], mean["longitude"]), "steps": FORECAST_STEPS}
    return (models.linear_window_model(S.MODEL_FEATURES, *_LINEAR, **degrees),
            models.linear_window_model(S.POSITION_FEATURES, *_SIMPLE, **degrees))


def linear_scores_sql(rows: str, size: int, key: str, keep: str, values: dict[str, str]) -> list[str]:
    """The stand-ins in SQL over ``rows`` (key columns, ``pos`` from 1 to ``size`` in a window, features): views up to ``scored`` and ``ahead``.

    ``values`` gives the normalised features; windows with a NULL in one of them go to the position-only model.
    """
    mean, std = {f: m for f, m, _ in TRAIN_STATS}, {f: s for f, _, s in TRAIN_STATS}
    z = {c: f"CAST(CAST({e} AS FLOAT) AS DOUBLE)" for c, e in values.items()}

    def logit(model):
        weights, bias = model
        parts = [f"CAST({w} AS DOUBLE) * (CASE WHEN count({z[c]}) = count(*) THEN avg({z[c]}) ELSE 0 END)" for c, w in weights.items()]
        return " + ".join([*parts, f"CAST({bias} AS DOUBLE)"])

    at = lambda c, p: f"max(CASE WHEN pos = {p} THEN {z[c]} END)"
    ends = ", ".join(f"{at(c, size)} AS {c}_last, {at(c, size - 1)} AS {c}_before" for c in S.POSITION_FEATURES)
    path = ", ".join(f"({c}_last + ({c}_last - {c}_before) * step) * CAST({std[c]} AS DOUBLE) + CAST({mean[c]} AS DOUBLE) AS {c}" for c in S.POSITION_FEATURES)
    return [
        f"judged AS (SELECT {key}, {keep}, {logit(_LINEAR)} AS full_logit, {logit(_SIMPLE)} AS simple_logit, {ends} FROM {rows} GROUP BY {key})",
        f"scored AS (SELECT *, 1 / (1 + exp(-logit)) AS probability, CAST(1 / (1 + exp(-logit)) >= 0.5 AS INT) AS label FROM (SELECT *, CASE WHEN used_fallback THEN simple_logit ELSE full_logit END AS logit FROM judged))",
        f"ahead AS (SELECT {key}, CAST(step AS INT) AS step, {path} FROM scored, range(1, {FORECAST_STEPS + 1}) AS steps(step) WHERE label = 1)",
    ]


def _labelled(spark, sf):
    d = split_rows(messages(spark, sf))
    return d.where("split = 'train'"), d.where("split = 'val'")


@query("m1_random_forest")
def _(spark, sf):
    d = split_rows(messages(spark, sf))
    model = models.random_forest(d.where("split = 'train'"), _X, "trawling")
    scored = model.transform(d.where("split = 'test'").withColumns({c: F.col(c).cast("double") for c in [*_X, "trawling"]}))
    return metrics.classification_scores(scored, "trawling", "prediction")


@query("m2_linear_forecaster_single", sql_with("""SELECT 'latitude_future3' AS target, round(regr_intercept(y, x), 6) AS intercept, round(regr_slope(y, x), 6) AS slope FROM pairs
 UNION ALL SELECT 'longitude_future3', round(regr_intercept(z, x), 6), round(regr_slope(z, x), 6) FROM pairs""",
    "pairs AS (SELECT * FROM (SELECT latitude AS x, lead(latitude, 3) OVER w AS y, lead(longitude, 3) OVER w AS z FROM msg WINDOW w AS (PARTITION BY mmsi ORDER BY epoch, event_id)) WHERE y IS NOT NULL)"))
def _(spark, sf):
    d = series.future_value(messages(spark, sf).select("mmsi", "epoch", "event_id", "latitude", "longitude"), T, horizon=3)
    rows = models.linear_coefficients(d, ["latitude"], ["latitude_future3", "longitude_future3"])
    table = spark.createDataFrame(rows, "target string, term string, value double")
    wide = table.groupBy("target").agg(
        F.max(F.when(F.col("term") == "(intercept)", F.col("value"))).alias("intercept"),
        F.max(F.when(F.col("term") != "(intercept)", F.col("value"))).alias("slope"),
    )
    return rounded(wide, 6)


@query("m2b_linear_forecaster")
def _(spark, sf):
    d = series.lag_columns(messages(spark, sf), T, ["latitude", "longitude"], [1, 2])
    d = series.future_value(d, T, horizon=5, drop="targets")
    x = ["latitude", "longitude", "latitude_lag1", "longitude_lag1", "latitude_lag2", "longitude_lag2"]
    y = ["latitude_future5", "longitude_future5"]
    predicted = models.linear_predict(d, models.linear_coefficients(d, x, y))
    return rounded(metrics.position_errors(predicted, [(c, f"{c}_pred") for c in y]), 6)


@query("m3_compare_classifiers")
def _(spark, sf):
    train, val = _labelled(spark, sf)
    features = ["sog", "cog", "heading", "draught"]
    zero = models.compare_classifiers(train, val, features, "trawling", "zero")
    return zero.unionByName(models.compare_classifiers(train, val, features, "trawling", "mean"))


@query("m4_forest_regressor")
def _(spark, sf):
    d = series.future_value(messages(spark, sf).select("mmsi", "epoch", "event_id", "latitude", "longitude"), T, horizon=1)
    targets = ["latitude_future1", "longitude_future1"]
    fitted = models.forest_regressors(d, ["latitude", "longitude"], targets)
    predicted = models.forest_predict(d, fitted, ["latitude", "longitude"])
    return metrics.position_errors(predicted, [(t, f"{t}_pred") for t in targets])


@query("m5_standard_scale", sql_with("""SELECT event_id, round((sog - m1) / s1, 6) AS sog, round((cog - m2) / s2, 6) AS cog FROM msg, (
 SELECT avg(sog) AS m1, stddev_pop(sog) AS s1, avg(cog) AS m2, stddev_pop(cog) AS s2 FROM msg WHERE k < 60)"""))
def _(spark, sf):
    m = messages(spark, sf)
    _, d = models.standard_scale(m.where("k < 60"), [m], ["sog", "cog"])
    return rounded(d.select("event_id", "sog", "cog"), 6)


_M6 = linear_scores_sql("member", 5, "mmsi, window_no", "count(sog) < 5 OR count(draught) < 5 AS used_fallback", {c: c for c in S.MODEL_FEATURES})


@query("m6_score_windows", sql_with("""SELECT s.mmsi, s.window_no, label, round(probability, 6) AS probability, step, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude
 FROM scored s LEFT JOIN ahead a ON a.mmsi = s.mmsi AND a.window_no = s.window_no""",
    "num AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY epoch, event_id) - 1 AS rn FROM msg)",
    "member AS (SELECT n.*, w.window_no, rn - 2 * w.window_no + 1 AS pos FROM num n JOIN (SELECT mmsi, CAST((rn - 4) / 2 AS BIGINT) AS window_no FROM num WHERE rn >= 4 AND rn % 2 = 0) w ON n.mmsi = w.mmsi AND n.rn BETWEEN 2 * w.window_no AND 2 * w.window_no + 4)",
    *_M6))
def _(spark, sf):
    w = series.sliding_windows(messages(spark, sf), T, S.MODEL_FEATURES, 5, 2)
    w = w.withColumn("used_fallback", F.exists("window", lambda r: r["sog"].isNull() | r["draught"].isNull()))
    scored = models.score_windows(w, load_linear_models, S.MODEL_FEATURES)
    ahead = F.posexplode_outer("forecast").alias("step", "_p")
    d = scored.select("mmsi", "window_no", "label", "probability", ahead)
    return rounded(d.select("mmsi", "window_no", "label", "probability", (F.col("step") + 1).alias("step"), "_p.latitude", "_p.longitude"), 6)


_FLIP = "CASE WHEN event_id % 9 = 0 THEN 1 - trawling ELSE trawling END"
_CM = "cm AS (SELECT count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p = 0) AS fn, count(*) FILTER (t = 0 AND p = 0) AS tn FROM {src})"
_SCORES = """SELECT tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision,
 coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1_score FROM cm"""


@query("m7_classification_scores", sql_with(_SCORES, f"tp AS (SELECT trawling AS t, {_FLIP} AS p FROM msg)", _CM.format(src="tp")))
def _(spark, sf):
    return metrics.classification_scores(messages(spark, sf).withColumn("predicted", F.expr(_FLIP)), "trawling", "predicted")


@query("m7b_classification_scores_labels", "WITH " + _CM.format(src="(SELECT quality AS t, toxic AS p FROM labels)") + " " + _SCORES)
def _(spark, sf):
    return metrics.classification_scores(spark.read.parquet(f"{sf}/labels.parquet"), "quality", "toxic")


@query("m8_confusion_matrix", sql_with(f"""SELECT t AS truth, p AS predicted, n, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY t) AS row_percent FROM (
 SELECT trawling AS t, {_FLIP} AS p, count(*) AS n FROM msg GROUP BY 1, 2)"""))
def _(spark, sf):
    return metrics.confusion_matrix(messages(spark, sf).withColumn("predicted", F.expr(_FLIP)), "trawling", "predicted")


_CURVE_SQL = """curve AS (SELECT sc AS threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS flagged, sum(pos) OVER () AS whole FROM (
 SELECT sog AS sc, count(*) FILTER (trawling = 1) AS pos, count(*) AS n FROM msg WHERE sog IS NOT NULL GROUP BY sog) WINDOW w AS (ORDER BY sc DESC ROWS UNBOUNDED PRECEDING))"""


@query("m9_precision_recall_curve", sql_with("SELECT threshold, tp, flagged, round(tp / flagged::DOUBLE, 9) AS precision, round(tp / whole::DOUBLE, 9) AS recall FROM curve", _CURVE_SQL))
def _(spark, sf):
    return rounded(metrics.precision_recall_curve(messages(spark, sf), "trawling", "sog").drop("_range"))


@query("m9b_pr_curve_area", sql_with("""SELECT round(sum((r - coalesce(lag_r, 0)) * (p + coalesce(lag_p, 1)) / 2), 6) AS area, count(*) AS thresholds FROM (
 SELECT p, r, lag(p) OVER (ORDER BY threshold DESC) AS lag_p, lag(r) OVER (ORDER BY threshold DESC) AS lag_r FROM (SELECT threshold, tp / flagged::DOUBLE AS p, tp / whole::DOUBLE AS r FROM curve))""", _CURVE_SQL))
def _(spark, sf):
    return rounded(metrics.pr_curve_area(metrics.precision_recall_curve(messages(spark, sf), "trawling", "sog")), 6)


_ERR_SQL = """err AS (SELECT step, abs(da) AS a, abs(d_o) AS o, (abs(da) + abs(d_o)) / 2 AS m FROM (SELECT unnest([0, 1, 2]) AS step,
 unnest([lead(latitude, 1) OVER w, lead(latitude, 2) OVER w, lead(latitude, 3) OVER w]) - latitude AS da,
 unnest([lead(longitude, 1) OVER w, lead(longitude, 2) OVER w, lead(longitude, 3) OVER w]) - longitude AS d_o, lead(event_id, 3) OVER w AS whole
 FROM msg WINDOW w AS (PARTITION BY mmsi ORDER BY epoch, event_id)) WHERE whole IS NOT NULL)"""


@query("m10_forecast_errors", sql_with("""SELECT CAST(step AS INT) AS step, count(*) AS n, round(avg(a), 6) AS mae_lat, round(avg(o), 6) AS mae_lon, round(avg(m), 6) AS mae_mean,
 round(var_samp(a), 6) AS var_lat, round(var_samp(o), 6) AS var_lon, round(var_samp(m), 6) AS var_mean FROM err GROUP BY ROLLUP (step)""", _ERR_SQL))
def _(spark, sf):
    d = series.forecasting_target(messages(spark, sf), T, 3)
    still = F.transform("future", lambda p: F.struct(F.col("latitude"), F.col("longitude")))
    return rounded(metrics.forecast_errors(d.withColumn("held", still), "future", "held"), 6)


@query("m11_position_errors", sql_with("""SELECT round(avg((abs(la) + abs(lo)) / 2), 6) AS mae, round(avg((la * la + lo * lo) / 2), 6) AS mse, count(*) AS n FROM (
 SELECT lead(latitude, 5) OVER w - latitude AS la, lead(longitude, 5) OVER w - longitude AS lo FROM msg WINDOW w AS (PARTITION BY mmsi ORDER BY epoch, event_id)) WHERE la IS NOT NULL"""))
def _(spark, sf):
    d = series.future_value(messages(spark, sf), T, horizon=5, drop="targets")
    return rounded(metrics.position_errors(d, [("latitude_future5", "latitude"), ("longitude_future5", "longitude")]), 6)


@query("m12_feature_importance")
def _(spark, sf):
    train, _ = _labelled(spark, sf)
    fitted = models.random_forest(train, _X, "trawling")
    return models.feature_importance(fitted, _X, spark)


@query("m13_early_stopping", sql_with("""SELECT run, arg_max(best_epoch, i) AS best_epoch, arg_max(best, i) AS best_value, min(i) FILTER (stopped) AS stop_after FROM walk GROUP BY run""",
    "hist AS (SELECT mmsi AS run, epoch, sog AS loss, row_number() OVER (PARTITION BY mmsi ORDER BY epoch) AS i FROM msg WHERE sog IS NOT NULL)",
    """walk AS (WITH RECURSIVE w AS (SELECT run, i, epoch AS best_epoch, loss AS best, 0 AS bad, FALSE AS stopped FROM hist WHERE i = 1
 UNION ALL SELECT h.run, h.i, CASE WHEN h.loss < w.best - CAST(0.5 AS DOUBLE) THEN h.epoch ELSE w.best_epoch END, CASE WHEN h.loss < w.best - CAST(0.5 AS DOUBLE) THEN h.loss ELSE w.best END,
 CASE WHEN h.loss < w.best - CAST(0.5 AS DOUBLE) THEN 0 ELSE w.bad + 1 END, NOT (h.loss < w.best - CAST(0.5 AS DOUBLE)) AND w.bad + 1 >= 15
 FROM w JOIN hist h ON h.run = w.run AND h.i = w.i + 1 WHERE NOT w.stopped) SELECT * FROM w)"""))
def _(spark, sf):
    h = messages(spark, sf).where("sog IS NOT NULL").select(F.col("mmsi").alias("run"), "epoch", "sog", "event_id")
    return metrics.early_stopping(h, ["run"], "epoch", "sog", patience=15, min_delta=0.5, chunk=86_400, tie=["event_id"])


