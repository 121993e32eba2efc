"""Classifiers and forecasters on Spark ML, and scoring of windows with a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatrack.operators.forest import BinnedForest, fit_boosted, fit_forest
from seatrack.operators.metrics import classification_scores
from seatrack.operators.selection import single_row
from seatrack.sources.staging import release, stage


def standard_scale(train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """z-scores with mean and population deviation of the training set; a zero deviation divides by one."""
    row = train.agg(
        *[e for c in columns for e in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    )
    out = []
    for df in (train, *others):
        d = df.withColumn("_s", single_row(row))
        z = {
            c: (F.col(c) - F.col(f"_s.{c}_mean")) / F.when(F.col(f"_s.{c}_std") == 0, 1.0).otherwise(F.col(f"_s.{c}_std"))
            for c in columns
        }
        out.append(d.withColumns(z).drop("_s"))
    return out


def _as_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


#: Rows of vectors that are worth a task of their own.
TASK_ROWS = 5_000


def vector_table(df: DataFrame, label: str) -> DataFrame:
    """The written rows, dealt evenly over all cores.

    Vectors of few distinct values compress so well that Spark reads millions of them in two tasks, and every pass of a fit would run in
    these two. More tasks than cores are of no use: each sends sums for all open nodes of all trees.
    """
    table = stage(df, label)
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK_ROWS))
    return table.repartition(max(tasks, 1))


def random_forest(train: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 10, seed: int = 42) -> BinnedForest:
    """Random forest fitted on rows complete in the features."""
    return fit_forest(train, features, label, classify=True, trees=trees, depth=depth, seed=seed)


def classifiers(label: str, seed: int = 42) -> dict[str, object]:
    common = {"featuresCol": "features", "labelCol": label}
    return {
        "logistic_regression": LogisticRegression(maxIter=1000, regParam=0.02, **common),
        "decision_tree": DecisionTreeClassifier(maxDepth=10, minInstancesPerNode=2, seed=seed, **common),
        "random_forest": RandomForestClassifier(numTrees=100, maxDepth=10, seed=seed, **common),
        "boosted_trees": GBTClassifier(maxDepth=10, stepSize=0.3, subsamplingRate=0.5, maxIter=20, seed=seed, **common),
    }


@dataclass
class BinnedClassifier:
    """Trees over binned features, fitted on and applied to a vector column ``features``."""

    fitter: Callable[..., BinnedForest]
    label: str
    options: dict[str, object]
    fitted: BinnedForest | None = None

    @staticmethod
    def _columns(rows: DataFrame, names: Sequence[str]) -> DataFrame:
        return rows.withColumn("_x", vector_to_array("features")).withColumns({c: F.col("_x")[i] for i, c in enumerate(names)}).drop("_x")

    def fit(self, rows: DataFrame) -> BinnedClassifier:
        first = rows.select("features").first()
        names = [f"_x{i}" for i in range(first["features"].size if first else 1)]
        return replace(self, fitted=self.fitter(self._columns(rows, names), names, self.label, **self.options))

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.fitted.transform(self._columns(rows, self.fitted.features)).drop(*self.fitted.features)


def binned_classifiers(label: str, seed: int = 42) -> dict[str, object]:
    """The same models for rows without weights; many trees are fitted on bins, as ``pyspark.ml`` takes a microsecond for each row, tree and level."""
    return classifiers(label, seed) | {
        "random_forest": BinnedClassifier(fit_forest, label, {"classify": True, "trees": 100, "depth": 10, "seed": seed}),
        "boosted_trees": BinnedClassifier(fit_boosted, label, {"trees": 20, "depth": 10, "step": 0.3, "share": 0.5, "seed": seed}),
    }


def compare_classifiers(
    train: DataFrame, val: DataFrame, features: Sequence[str], label: str, impute: str = "zero",
    models: dict[str, object] | None = None, name: str = "clean",
) -> DataFrame:
    """Scores on the validation set of each model fitted on the training set; rows without a label take no part."""
    features = list(features)
    train, val = (_as_double(d.where(F.col(label).isNotNull()), [*features, label]) for d in (train, val))
    if impute == "zero":
        train, val = train.na.fill(0.0, features), val.na.fill(0.0, features)
        head = []
        inputs = features
    else:
        inputs = [f"{c}_imputed" for c in features]
        head = [Imputer(strategy="mean", inputCols=features, outputCols=inputs)]
    head.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    prepared = Pipeline(stages=head).fit(train)
    # Every model makes many passes over the training vectors.
    fit_on = vector_table(prepared.transform(train).select("features", label), "training-vectors")
    check_on = vector_table(prepared.transform(val).select("features", label), "validation-vectors")
    out = None
    for model_name, model in (models or binned_classifiers(label)).items():
        scored = model.fit(fit_on).transform(check_on)
        one = classification_scores(scored, label, "prediction").select(
            F.lit(model_name).alias("model"), F.lit(name).alias("corruption"), F.lit(impute).alias("imputation"),
            "accuracy", "precision", "recall", "f1_score",
        )
        out = one if out is None else out.unionByName(one)
    return out


def feature_importance(model, features: Sequence[str], spark) -> DataFrame:
    """Tree importances or absolute coefficients, largest first."""
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    rows = [(c, abs(float(v))) for c, v in zip(features, values.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


# --- multi-output linear forecaster -------------------------------------------------------------


def linear_coefficients(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> list[tuple[str, str, float]]:
    """Least squares for each target: rows (target, term, coefficient); rows with a NULL go.

    Spark's weighted least squares reads the written vectors once per target; collinear features go to its iterative solver.
    """
    features = list(features)
    rows = _as_double(df.select(*features, *targets), [*features, *targets]).na.drop()
    vectors = VectorAssembler(inputCols=features, outputCol="_features").transform(rows).select("_features", *targets)
    vectors = stage(vectors, "regression-vectors")
    out: list[tuple[str, str, float]] = []
    for t in targets:
        fitted = LinearRegression(featuresCol="_features", labelCol=t, solver="normal", regParam=0.0, maxIter=500, tol=1e-12).fit(vectors)
        out += [(t, "(intercept)", float(fitted.intercept)), *((t, c, float(v)) for c, v in zip(features, fitted.coefficients.toArray(), strict=True))]
    release(vectors)
    return out


def linear_predict(df: DataFrame, coefficients: Sequence[tuple[str, str, float]], suffix: str = "_pred") -> DataFrame:
    out = {}
    for target, term, value in coefficients:
        part = F.lit(value) if term == "(intercept)" else F.col(term) * F.lit(value)
        name = f"{target}{suffix}"
        out[name] = out[name] + part if name in out else part
    return df.withColumns(out)


def forest_regressors(train: DataFrame, features: Sequence[str], targets: Sequence[str], trees: int = 100, seed: int = 42) -> dict[str, BinnedForest]:
    """One random-forest regressor per target: ``{target: fitted model}``."""
    table = stage(_as_double(train.select(*features, *targets), [*features, *targets]), "training-rows")
    fitted = {t: fit_forest(table, features, t, classify=False, trees=trees, seed=seed) for t in targets}
    release(table)
    return fitted


def forest_predict(df: DataFrame, models: dict[str, BinnedForest], features: Sequence[str]) -> DataFrame:
    d = _as_double(df, features)
    for t, m in models.items():
        d = m.transform(d, f"{t}_pred")
    return d


# --- window scoring -----------------------------------------------------------------------------


@dataclass(frozen=True)
class WindowModel:
    """A classifier and a forecaster over windows ``[n, rows, features]``."""

    classify: Callable[[np.ndarray], np.ndarray]  # logits [n]
    forecast: Callable[[np.ndarray], np.ndarray]  # positions [n, steps, 2]


SCORE_FIELDS = "label int, probability double, logit double, forecast array<struct<latitude:double,longitude:double>>"


def _by_length(column: pa.Array, rows: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of the given rows as tensors, those of equal length together; NULL values are NaN."""
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)[rows]
    for size in np.unique(sizes):
        some = rows[sizes == size]
        at = offsets[some][:, None] + np.arange(size)
        yield some, values[at].reshape(len(some), size // width, width).astype(np.float32)


def score_windows(
    windows: DataFrame, load_models: Callable[[], tuple[WindowModel, WindowModel]], features: Sequence[str],
    position_features: Sequence[str] = ("latitude", "longitude"), window: str = "window", fallback: str = "used_fallback",
    threshold: float = 0.5,
) -> DataFrame:
    """Classify each window and forecast the positive ones.

    ``load_models`` gives the full and the position-only model and is called once per task. Windows
    flagged as fallback go to the position-only model. Windows travel as flat Arrow lists that become tensors without an object per row;
    all windows of a batch are classified first, and only the positive ones reach the forecaster. Columns other than the window pass through.
    """
    features, position_features = list(features), list(position_features)

    def flat(columns: list[str]) -> Column:
        return F.flatten(F.transform(window, lambda r: F.array(*[r[c].cast("float") for c in columns])))

    chosen = F.when(F.col(fallback), flat(position_features)).otherwise(flat(features))
    rows = windows.withColumn("_values", chosen).drop(window)
    kept = [c for c in rows.columns if c != "_values"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [(m, w) for m, w in zip(load_models(), (len(features), len(position_features)), strict=True)]
        for batch in batches:
            values, simple = batch.column("_values"), batch.column(fallback).fill_null(False).to_numpy(zero_copy_only=False)
            parts = [(m, w, np.flatnonzero(simple == k)) for k, (m, w) in enumerate(models)]
            logits = np.zeros(len(batch))
            for m, width, some in parts:
                for at, x in _by_length(values, some, width):
                    logits[at] = m.classify(x)
            probability = 1.0 / (1.0 + np.exp(-logits))
            label = (probability >= threshold).astype(np.int32)
            steps, paths = np.zeros(len(batch), np.int64), []
            for m, width, some in parts:
                for at, x in _by_length(values, some[label[some] == 1], width):
                    path = np.asarray(m.forecast(x), dtype=float)
                    steps[at] = path.shape[1]
                    paths.append((at, path))
            ends = steps.cumsum()
            points = np.zeros((int(ends[-1]) if len(ends) else 0, 2))
            for at, path in paths:
                points[(ends[at] - steps[at])[:, None] + np.arange(path.shape[1])] = path
            positions = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["latitude", "longitude"])
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32(), mask=np.append(label == 0, False))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(label), pa.array(probability), pa.array(logits), pa.ListArray.from_arrays(offsets, positions)],
                [*kept, "label", "probability", "logit", "forecast"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept]
    return rows.mapInArrow(score, ", ".join([*fields, SCORE_FIELDS]))


def linear_window_model(
    features: Sequence[str], weights: dict[str, float], bias: float, steps: int = 20,
    scale: tuple[float, float] = (1.0, 1.0), shift: tuple[float, float] = (0.0, 0.0),
) -> WindowModel:
    """Stand-in model: logit from feature means, forecast by holding the last movement, in units of ``scale`` from ``shift``."""
    w = np.array([weights.get(c, 0.0) for c in features])
    place = [list(features).index("latitude"), list(features).index("longitude")]

    def classify(x: np.ndarray) -> np.ndarray:
        return np.nan_to_num(x.astype(np.float64).mean(axis=1)) @ w + bias

    def forecast(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        last = x[:, -1, place]
        move = last - x[:, -2, place] if x.shape[1] > 1 else np.zeros_like(last)
        return (last[:, None, :] + move[:, None, :] * np.arange(1, steps + 1)[None, :, None]) * scale + shift

    return WindowModel(classify, forecast)
