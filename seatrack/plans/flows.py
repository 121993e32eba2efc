"""Compositions: labelling, preparation, export, sequences, scoring of windows, degradation studies.

Intermediate results that are read more than once are staged as tables (see
:mod:`seatrack.sources.staging`), so no flow computes its upstream part twice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatrack import schema as S
from seatrack.operators import clean, degrade, joins, metrics, models, profile, resample, risk, series, split
from seatrack.operators.ordered import Track, join_key_values, join_per_key, key_values
from seatrack.sources import readers, writers
from seatrack.sources.staging import stage


def label_fishing(raw: DataFrame, meta: DataFrame, ship_type: str = "Fishing", column: str = "ship_type") -> DataFrame:
    """Fishing ships with their gear type and the trawling label."""
    d = clean.keep_ship_type(raw, ship_type, column)
    return clean.label_trawling(joins.join_metadata(d, meta, track=Track()))


def prepare(
    messages: DataFrame, track: Track, step_s: int = 10, max_gap_s: int = 300, horizon: int = 120, exact: bool = False,
    keep_null_static: bool = False,
) -> DataFrame:
    """Filter, drop outliers, build the grid, interpolate, fill, clamp and attach future positions.

    A vessel with a gap longer than ``max_gap_s`` keeps NULLs on its grid and is dropped as a whole. This
    is decided on the messages, so the grid of such vessels is never built.
    """
    d = clean.drop_unknown_gear(clean.drop_class_b(messages))
    d = d.select(*track.key, "ts", track.order, *track.tie, *S.STATIC, *S.CONTINUOUS)
    d = clean.drop_hollow_vessels(d, S.CONTINUOUS, track.key, track)
    d = stage(clean.filter_monthly_iqr(d, exact=exact), "inliers")
    for c in ("width", "length"):
        d = stage(clean.filter_quantile_range(d, c, exact=exact, keep_null=keep_null_static), "in-range")
    d = resample.align(d.drop("ts"), track, step_s)
    track = track.without_tie()
    d = stage(resample.grid_neighbours(d, track, [*S.CONTINUOUS, *S.STATIC]), "neighbours")
    hold = ["width", "length", "trawling", "rot", "heading", "draught"]
    d = resample.drop_gappy_keys(d, track, step_s, S.CONTINUOUS, hold, max_gap_s)
    d = resample.expand_with_future(d, track, step_s, S.CONTINUOUS, S.STATIC, hold, max_gap_s=max_gap_s, horizon=horizon)
    return clean.require_full_future(clean.clamp(d), horizon)


def prepare_early(
    messages: DataFrame, track: Track, bucket_s: int = 60, steps: int = 20, train: float = 0.7, val: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Early preparation: dedup, day filter, split, bucket means, row interpolation, lags and targets."""
    unused = ["mobile_type", "nav_status", "imo", "width", "length"]
    d = clean.drop_duplicates(clean.drop_features(clean.drop_class_b(messages), unused))
    d = stage(clean.drop_unknown_gear(d), "unique")
    d = stage(clean.drop_empty_vessel_days(d, track.key[0]), "complete-days")
    assignment = split.assign_splits(d, track.key[0], "gear_type", train, val, seed).select(*track.key, "split")
    bare = track.without_tie()
    values = ["latitude", "longitude", "rot", "sog", "cog", "heading", "draught", "trawling"]
    d = stage(resample.bucket_mean(d, bare, values, bucket_s), "buckets")
    d = series.interpolate(d, bare, ["rot", "sog", "cog", "heading"], by="row")
    d = stage(clean.label_to_int(d), "interpolated")
    d = stage(series.lag_columns(d, bare, ["latitude", "longitude"], [1, 5]), "lagged")
    d = join_per_key(d, assignment, bare, "inner")
    return series.forecasting_target(d, bare, steps)


def export_with_stats(prepared: DataFrame, path: str, version: str, mode: str = "train", horizon: int = 0) -> DataFrame:
    """Write the training set and its normalisation statistics; returns the statistics."""
    writers.write_training_set(prepared, path, version, mode, horizon)
    written = prepared.sparkSession.read.parquet(f"{path}/{mode}/{version}/data")
    features = [c for c in S.MODEL_FEATURES if c in written.columns]
    stats = profile.column_stats(written, features)
    writers.write_stats(stats, f"{path}/{mode}/{version}/stats")
    return readers.read_stats(prepared.sparkSession, f"{path}/{mode}/{version}/stats")


def training_sequences(
    prepared: DataFrame, stats: DataFrame, track: Track, features: Sequence[str], label: str, length: int
) -> DataFrame:
    """Normalised sequences with the label of the last row."""
    d = clean.normalize(prepared, stats, features, exclude=[label], zero_std=False)
    return series.sequences(d, track, features, label, length)


def scoring_rows(messages: DataFrame, track: Track, step_s: int = 10, newest: int | None = None) -> DataFrame:
    """Class A messages, one per vessel and time, on a filled grid (or its ``newest`` slots per vessel); values not yet normalised."""
    d = clean.drop_class_b(messages, "class_a").select(*track.key, track.order, *track.tie, *S.CONTINUOUS, *S.STATIC)
    d = clean.dedup_on_key(d, [*track.key, track.order], list(track.tie) or [track.order])
    return resample.scoring_grid(d, track, step_s, newest=newest)


def vessels_for_scoring(
    messages: DataFrame, track: Track, stats: DataFrame, step_s: int = 10,
    skewed: tuple[Sequence[str], Sequence[str]] = ((), ()),
) -> DataFrame:
    """Scoring rows of all vessels, optionally with reduced skewness, normalised except for the label."""
    d = scoring_rows(messages, track, step_s)
    if skewed[0] or skewed[1]:
        d = clean.reduce_skewness(stage(d, "scoring"), *skewed)
    return clean.normalize(d, stats, S.MODEL_FEATURES, exclude=["trawling"])


def cable_risk(
    messages: DataFrame, track: Track, segments: DataFrame, stats: DataFrame,
    load_models: Callable[[], tuple[models.WindowModel, models.WindowModel]], step_s: int = 10, size: int = 30, step: int = 10,
    near_m: float = S.ENTRY_ZONE_M, critical_m: float = S.CRITICAL_ZONE_M, entry_m: float = S.ENTRY_ZONE_M,
) -> DataFrame:
    """Score the sliding windows of all vessels whose last position is near a cable.

    Only the windows near a cable reach the model; only those it calls trawling get a risk level. On the
    complete grid the number of a row follows from its time, so the wanted windows are exploded into
    times and meet the rows on (vessel, time).
    """
    rows = stage(scoring_rows(messages, track, step_s), "scoring")
    begin = key_values(rows, track, _begin=("min", F.col(track.order)))
    t = F.col(track.order)
    ends = rows.select(*track.key, track.order, "latitude", "longitude")
    past = (t - F.col("_begin")) / step_s + 1 - size  # rows before the window
    ends = join_key_values(ends, begin, track, "inner").where((past >= 0) & (past % step == 0))
    # Distances cost far more than the join, so only the ends of windows are compared with the cables.
    ends = risk.near_cable(ends, segments, near_m, name="_close").where("_close")
    span = F.sequence(t - (size - 1) * step_s, t, F.lit(step_s).cast("bigint"))
    members = ends.select(
        *track.key, F.floor(past / step).alias("window_no"), F.explode(span).alias(track.order))
    windows = rows.join(members, [*track.key, track.order]).groupBy(*track.key, "window_no").agg(
        F.min(track.order).alias("window_start"), F.max(track.order).alias("window_end"),
        F.sort_array(F.collect_list(F.struct(track.order, *S.MODEL_FEATURES))).alias("window"),
    )
    return risk_of_windows(windows, track, segments, stats, load_models, critical_m, entry_m)


def latest_risk(
    messages: DataFrame, track: Track, segments: DataFrame, stats: DataFrame,
    load_models: Callable[[], tuple[models.WindowModel, models.WindowModel]], step_s: int = 10, size: int = 30,
    near_m: float = S.ENTRY_ZONE_M, critical_m: float = S.CRITICAL_ZONE_M, entry_m: float = S.ENTRY_ZONE_M,
) -> DataFrame:
    """One row per vessel: its newest full window, scored if it ends near a cable.

    ``status`` is ``scored``, ``not near a cable`` or ``too few rows``; label, logit, probability and
    risk level (0 for a negative label) are NULL unless scored, ``zone_alert`` and forecast unless positive.
    """
    newest = scoring_rows(messages, track, step_s, newest=size)  # at most `size` rows per vessel, no other slot is produced
    entry = F.struct(track.order, *S.MODEL_FEATURES)
    windows = newest.groupBy(*track.key).agg(
        F.lit(0).cast("bigint").alias("window_no"), F.min(track.order).alias("window_start"),
        F.max(track.order).alias("window_end"), F.sort_array(F.collect_list(entry)).alias("window"),
    )
    last = F.element_at("window", -1)
    windows = windows.withColumns({"_lat": last["latitude"], "_lon": last["longitude"]})
    windows = risk.near_cable(windows, segments, near_m, "_lat", "_lon", "_close").drop("_lat", "_lon")
    short, near = F.size("window") < size, F.coalesce("_close", F.lit(False))
    status = F.when(short, "too few rows").when(near, "scored").otherwise("not near a cable")
    windows = stage(windows.withColumn("status", status).drop("_close"), "newest")
    scored = risk_of_windows(
        windows.where("status = 'scored'").drop("status"), track, segments, stats, load_models, critical_m, entry_m, keep_negative=True)
    return windows.select(*track.key, "status", "window_start", "window_end").join(
        scored.drop("window_no", "window_start", "window_end"), list(track.key), "left")


def risk_of_windows(
    windows: DataFrame, track: Track, segments: DataFrame, stats: DataFrame,
    load_models: Callable[[], tuple[models.WindowModel, models.WindowModel]],
    critical_m: float = S.CRITICAL_ZONE_M, entry_m: float = S.ENTRY_ZONE_M, keep_negative: bool = False,
) -> DataFrame:
    """Completeness check, normalisation, model and risk level of windows near a cable.

    ``zone_alert`` says whether a forecast position lies in the critical zone; it is NULL without a forecast.
    """
    incomplete = F.exists("window", lambda r: clean.any_of([r[c].isNull() for c in S.MODEL_FEATURES]))
    windows = windows.withColumns(
        {
            "used_fallback": incomplete,
            "input": F.transform("window", lambda r: F.struct(r["latitude"], r["longitude"])),
            "_stats": clean.stats_row(stats, S.MODEL_FEATURES),
        }
    ).withColumn("window", F.transform("window", _z_scores)).drop("_stats")
    # Written, as the paths are compared apart from their rows: the models run once.
    scored = stage(models.score_windows(windows, load_models, S.MODEL_FEATURES, S.POSITION_FEATURES), "scored")
    d = risk.risk_levels(scored, segments, critical_m, entry_m, keep_negative=keep_negative)
    d = risk.any_forecast_in_zone(d, segments, critical_m, name="_alert")
    return d.select(
        *track.key, "window_no", "window_start", "window_end", "label", "logit", "probability", "forecast",
        F.round("probability", 4).alias("fishing_confidence"), "risk_level",
        F.when(F.col("forecast").isNotNull(), F.col("_alert")).alias("zone_alert"), "input", "used_fallback",
    )


def _z_scores(row: Column) -> Column:
    values = []
    for c in S.MODEL_FEATURES:
        mean, std = F.col(f"_stats.{c}_mean"), F.col(f"_stats.{c}_std")
        z = F.when(std != 0, F.try_divide(row[c] - mean, std)).otherwise(F.lit(0.0))
        values.append(F.when(mean.isNull(), row[c].cast("double")).otherwise(z).alias(c))
    return F.struct(*values)


def study_inputs(
    trajectories: DataFrame, track: Track, row_key: Sequence[str], features: Sequence[str],
    shares: Mapping[str, float], lags: Sequence[int] = (1, 5), horizon: int = 5, seed: int = 42, **degradation,
) -> DataFrame:
    """Split by trajectory, degrade, add lags and future positions: one table with ``split``."""
    d = stage(split.split_rows(trajectories, track.key[0], "label", 0.7, 0.1, seed), "split")
    columns = ["latitude", "longitude", *features]
    sampled = degradation.get("downsample_s") or degradation.get("resample_s")
    parts = []
    for name in ("train", "val", "test"):
        part = d.where(F.col("split") == name).drop("split")
        part = degrade.degrade(part, track, row_key, shares, columns, seed=seed, **degradation)
        parts.append(part.withColumn("split", F.lit(name)))
    d = stage(split.union_splits(parts), "degraded")
    t = (track.without_tie() if sampled else track).with_key(track.key[0], "split")
    d = stage(series.lag_columns(d, t, columns, lags, drop="any"), "lagged")
    return series.future_value(d, t, horizon=horizon)


def robustness_study(
    train: DataFrame, val: DataFrame, row_key: Sequence[str], features: Sequence[str], shares: Mapping[str, float], levels: Sequence[float],
    fitted: Mapping[str, object] | None = None, key: str = "trajectory_id", label: str = "label", seed: int = 42,
) -> DataFrame:
    """Scores of each classifier fitted on each corrupted version of the training rows, on one common validation set.

    One row per (corruption, model) with the size of the training set. Rows without a label go first; missing values become 0. The versions are
    weights, labels and cells of one table (:func:`seatrack.operators.degrade.corruption_marks`), and all models score the validation set in one pass.
    """
    fitted, features = dict(fitted or models.classifiers(label, seed)), list(features)
    train, val = (d.where(F.col(label).isNotNull()) for d in (train, val))
    marks = degrade.corruption_marks(train, levels, row_key, shares, key=key, label=label, seed=seed)
    blank = [f"blank_{c}" if c in shares else c for c in features]
    weights = ["weight", "weight_dupes", "weight_irregular", "weight_dupes_irregular"]
    labels = [label, *[f"label_{i}" for i in range(len(levels))]]
    doubles = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in dict.fromkeys([*features, *blank])}
    d = marks.withColumns(doubles)
    for name, columns in (("_whole", features), ("_blank", blank)):
        d = VectorAssembler(inputCols=columns, outputCol=name).transform(d)
    table = stage(d.select("_whole", "_blank", *weights, *[F.col(c).cast("double").alias(c) for c in labels]), "corruption-marks")
    scored = VectorAssembler(inputCols=features, outputCol="features").transform(
        val.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})).select("features", F.col(label).alias("_truth"))
    names = []
    for corruption, steps, level in [("clean", (), None), *degrade.corruption_variants(levels)]:
        w, y = degrade.variant_columns(steps, level, levels, label)
        rows = table.where(F.col(w) > 0).select(
            F.col("_blank" if "missing" in steps else "_whole").alias("features"), F.col(w).cast("double").alias("_weight"), F.col(y).alias(label))
        for model_name, model in fitted.items():
            column = f"_p{len(names)}"
            one = model.copy().setWeightCol("_weight").setPredictionCol(column).setRawPredictionCol(f"{column}_raw").setProbabilityCol(f"{column}_prob").fit(rows)
            scored = one.transform(scored).drop(f"{column}_raw", f"{column}_prob")
            names.append((corruption, model_name))
    guesses = F.array(*[F.struct(F.lit(c).alias("corruption"), F.lit(m).alias("model"), F.col(f"_p{i}").alias("prediction")) for i, (c, m) in enumerate(names)])
    long = scored.select("_truth", F.explode(guesses).alias("_g")).select("_truth", "_g.*")
    scores = metrics.classification_scores(long, "_truth", "prediction", ["corruption", "model"])
    return scores.join(degrade.variant_counts(table, levels, label), "corruption").select(
        "corruption", "model", "rows", "positive_rows", "accuracy", "precision", "recall", "f1_score")


def degradation_study(
    trajectories: DataFrame, track: Track, row_key: Sequence[str], features: Sequence[str],
    shares: Mapping[str, float], lags: Sequence[int] = (1, 5), horizon: int = 5, seed: int = 42, **degradation,
) -> DataFrame:
    """Error of a linear forecaster per split after degrading the data."""
    d = stage(study_inputs(trajectories, track, row_key, features, shares, lags, horizon, seed, **degradation), "study")
    base = ["latitude", "longitude", *features]
    inputs = [*base, *[f"{c}_lag{n}" for c in base for n in lags]]
    targets = [f"latitude_future{horizon}", f"longitude_future{horizon}"]
    train = d.where("split = 'train'")
    fitted, every = models.standard_scale(train, [d], inputs)
    predicted = models.linear_predict(every, models.linear_coefficients(fitted, inputs, targets))
    return metrics.position_errors(predicted, [(t, f"{t}_pred") for t in targets], ["split"])
