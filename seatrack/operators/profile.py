"""Data-quality profiling: counts, duplicates, quartiles, histograms, correlations, NULL patterns."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations_with_replacement
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatrack.operators.clean import numeric_columns, skewness_of
from seatrack.operators.ordered import Track, previous_time
from seatrack.operators.quantiles import wide_quantiles
from seatrack.operators.selection import single_row
from seatrack.sources.staging import stage


def _long(row: DataFrame, columns: Sequence[str], parts: Sequence[str], name: str = "feature") -> DataFrame:
    """One wide row with columns ``{column}__{part}`` as one row per column."""
    entries = [
        F.struct(F.lit(c).alias(name), *[F.col(f"{c}__{p}").alias(p) for p in parts]) for c in columns
    ]
    return row.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def missing_counts(df: DataFrame, exclude: Sequence[str] = ("ts",)) -> DataFrame:
    """NULL or NaN count of every column."""
    columns = [f for f in df.schema.fields if f.name not in exclude]

    def missing(f: T.StructField) -> Column:
        c = F.col(f.name)
        nan = isinstance(f.dataType, (T.DoubleType, T.FloatType))
        return c.isNull() | F.isnan(c) if nan else c.isNull()

    row = df.agg(*[F.count_if(missing(f)).alias(f"{f.name}__missing") for f in columns])
    return _long(row, [f.name for f in columns], ["missing"])


def column_stats(df: DataFrame, columns: Sequence[str], population: bool = False) -> DataFrame:
    """Mean and standard deviation per column: rows ``(feature, mean, std)``."""
    std = F.stddev_pop if population else F.stddev_samp
    row = df.agg(*[e for c in columns for e in (F.avg(c).alias(f"{c}__mean"), std(c).alias(f"{c}__std"))])
    return _long(row, columns, ["mean", "std"])


def skewness_table(df: DataFrame, columns: Sequence[str], bias_corrected: bool = False) -> DataFrame:
    row = df.agg(*[skewness_of(c, bias_corrected).alias(f"{c}__skewness") for c in columns])
    return _long(row, columns, ["skewness"])


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Distinct rows that occur more than once, with their count."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Total, distinct and surplus rows and the share of the surplus in percent."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    s = groups.agg(F.sum("_copies").alias("total_rows"), F.count(F.lit(1)).alias("distinct_rows"))
    return s.select(
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        "distinct_rows",
        F.coalesce(F.col("total_rows") - F.col("distinct_rows"), F.lit(0)).alias("duplicate_rows"),
        F.round(
            F.try_divide((F.col("total_rows") - F.col("distinct_rows")) * 100.0, F.col("total_rows")), 4
        ).alias("duplicate_percent"),
    )


def conflicting_ids(df: DataFrame, key: str = "mmsi", other: str = "imo", approximate: bool = False) -> DataFrame:
    """Keys that carry more than one value of ``other``.

    The exact form counts distinct pairs first, so the rows of a busy key collapse in the map tasks.
    """
    if approximate:
        counts = df.groupBy(key).agg(F.approx_count_distinct(other).alias(f"{other}_count"))
    else:
        pairs = df.where(F.col(other).isNotNull()).select(key, other).distinct()
        counts = pairs.groupBy(key).agg(F.count(F.lit(1)).alias(f"{other}_count"))
    return counts.where(F.col(f"{other}_count") > 1)


def quartile_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact quartiles, IQR and the 1.5 IQR outlier bounds of each column."""
    row = wide_quantiles(df, columns, [0.25, 0.5, 0.75])
    for c in columns:
        iqr = F.col(f"{c}_q2") - F.col(f"{c}_q0")
        row = row.withColumns(
            {
                f"{c}__q1": F.col(f"{c}_q0"), f"{c}__median": F.col(f"{c}_q1"), f"{c}__q3": F.col(f"{c}_q2"),
                f"{c}__iqr": iqr, f"{c}__lower": F.col(f"{c}_q0") - 1.5 * iqr,
                f"{c}__upper": F.col(f"{c}_q2") + 1.5 * iqr,
            }
        )
    return _long(row, columns, ["q1", "median", "q3", "iqr", "lower", "upper"])


def gaps(df: DataFrame, track: Track, max_gap_s: int | None = None) -> DataFrame:
    """Seconds since the message before, optionally only those up to a limit."""
    d = previous_time(df, track, "_prev").select((F.col(track.order) - F.col("_prev")).alias("gap_s"))
    return d.where(F.col("gap_s").isNotNull() if max_gap_s is None else F.col("gap_s") <= max_gap_s)


def gap_stats(df: DataFrame, track: Track, max_gap_s: int = 30) -> DataFrame:
    """count, mean, std, min, quartiles and max of the gaps up to ``max_gap_s``."""
    return describe(gaps(df, track, max_gap_s), "gap_s")


def describe(df: DataFrame, column: str) -> DataFrame:
    basics = df.agg(
        F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).cast("double").alias("min"), F.max(column).cast("double").alias("max"),
    )
    q = wide_quantiles(df, [column], [0.25, 0.5, 0.75])
    return basics.withColumn("_q", single_row(q)).select(
        "count", "mean", "std", "min", F.col(f"_q.{column}_q0").alias("q1"),
        F.col(f"_q.{column}_q1").alias("median"), F.col(f"_q.{column}_q2").alias("q3"), "max",
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins between minimum and maximum, the last bin closed; empty bins included."""
    d = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"))
    ends = d.agg(F.min("_v").alias("a"), F.max("_v").alias("b"))
    half = F.when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)  # a constant column gets a width of one
    edges = ends.select((F.col("a") - half).alias("lo"), (F.col("b") + half).alias("hi"))
    d = d.withColumn("_e", single_row(edges))
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    index = F.least(F.floor(F.try_divide((F.col("_v") - lo) * bins, hi - lo)), F.lit(bins - 1))
    filled = d.groupBy(index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = edges.where(F.col("lo").isNotNull()).select(
        "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return frame.join(filled, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def box_plot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median, quartiles, whiskers (last values inside 1.5 IQR) and number of fliers per column."""
    row = single_row(wide_quantiles(df, columns, [0.25, 0.5, 0.75]))
    d = df.select(*columns).withColumn("_q", row)
    aggs = []
    for c in columns:
        q1, q3 = F.col(f"_q.{c}_q0"), F.col(f"_q.{c}_q2")
        lower, upper = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = F.col(c).between(lower, upper)
        aggs += [
            F.first(q1).alias(f"{c}__q1"), F.first(F.col(f"_q.{c}_q1")).alias(f"{c}__median"),
            F.first(q3).alias(f"{c}__q3"),
            F.min(F.when(inside, F.col(c))).cast("double").alias(f"{c}__whisker_low"),
            F.max(F.when(inside, F.col(c))).cast("double").alias(f"{c}__whisker_high"),
            F.count_if(F.col(c).isNotNull() & ~inside).alias(f"{c}__fliers"),
        ]
    parts = ["q1", "median", "q3", "whisker_low", "whisker_high", "fliers"]
    return _long(d.agg(*aggs), columns, parts)


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair over the rows complete in all columns."""
    columns = list(columns or numeric_columns(df))
    pairs = list(combinations_with_replacement(columns, 2))
    d = df.na.drop(subset=columns)
    row = d.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = [
        F.struct(F.lit(x).alias("feature_a"), F.lit(y).alias("feature_b"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
        for x, y in ({(a, b), (b, a)})
    ]
    return row.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def null_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per NULL pattern: bit i of the pattern is set when column i is NULL."""
    bits = [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)]
    pattern = bits[0]
    for b in bits[1:]:
        pattern = pattern + b
    return df.groupBy(pattern.cast("bigint").alias("pattern")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in columns]
    )


def pattern_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sufficient statistics of each NULL pattern: ``pattern, n``, sums ``s`` and products ``ss`` of the standardised columns.

    Columns are shifted by their mean and divided by their deviation first, so that sums of squares keep their precision; ``shift``
    and ``scale`` say how. NULL adds nothing. All sums combine in the map tasks; rows without any value are left out.
    """
    row = df.agg(*[e for i, c in enumerate(columns) for e in (F.coalesce(F.avg(c), F.lit(0.0)).alias(f"m{i}"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"d{i}"))])
    d = df.withColumn("_s", single_row(row))
    bits = [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)]
    z = [((F.col(c).cast("double") - F.col(f"_s.m{i}")) / F.col(f"_s.d{i}")).alias(f"z{i}") for i, c in enumerate(columns)]
    d = d.select(reduce(add, bits).cast("bigint").alias("pattern"), "_s", *z).where(F.col("pattern") != (1 << len(columns)) - 1)
    names = [f"z{i}" for i in range(len(columns))]
    total = lambda e: F.coalesce(F.sum(e), F.lit(0.0))
    return d.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[total(c) for c in names]).alias("s"),
        F.array(*[total(F.col(a) * F.col(b)) for a in names for b in names]).alias("ss"),
        F.array(*[F.first(f"_s.m{i}") for i in range(len(columns))]).alias("shift"), F.array(*[F.first(f"_s.d{i}") for i in range(len(columns))]).alias("scale"))


def _seen(pattern: int, p: int) -> np.ndarray:
    return np.array([not (pattern >> i) & 1 for i in range(p)])


def _expected(mean: np.ndarray, cov: np.ndarray):
    """E step of one batch of patterns: sums and products with the missing values filled in by regression on the seen ones."""
    p = len(mean)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, t1, t2 = 0, np.zeros(p), np.zeros((p, p))
            for pattern, count, s, ss in zip(batch["pattern"], batch["n"], batch["s"], batch["ss"], strict=True):
                o = _seen(int(pattern), p)
                s, ss = np.asarray(s), np.asarray(ss).reshape(p, p)
                # Filled row = a + B x over the seen x; B is the identity there.
                b = np.zeros((p, int(o.sum())))
                b[o] = np.eye(int(o.sum()))
                b[~o] = cov[np.ix_(~o, o)] @ np.linalg.pinv(cov[np.ix_(o, o)])
                a = mean - b @ mean[o]
                rest = np.zeros((p, p))
                rest[np.ix_(~o, ~o)] = cov[np.ix_(~o, ~o)] - b[~o] @ cov[np.ix_(o, ~o)]
                first = b @ s[o]
                n += count
                t1 += count * a + first
                t2 += count * (np.outer(a, a) + rest) + np.outer(a, first) + np.outer(first, a) + b @ ss[np.ix_(o, o)] @ b.T
            yield pd.DataFrame({"n": [n], "t1": [t1.tolist()], "t2": [t2.ravel().tolist()]})

    return run


def _moments(table: DataFrame, p: int, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Maximum-likelihood mean and covariance of the standardised columns by EM; one row comes back from each round."""
    mean, cov = np.zeros(p), np.eye(p)
    for _ in range(rounds):
        parts = table.mapInPandas(_expected(mean, cov), "n long, t1 array<double>, t2 array<double>")
        row = parts.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("t1", i)) for i in range(p)]).alias("t1"),
                        F.array(*[F.sum(F.get("t2", i)) for i in range(p * p)]).alias("t2")).first()
        new = np.array(row["t1"]) / row["n"]
        new_cov = np.array(row["t2"]).reshape(p, p) / row["n"] - np.outer(new, new)
        moved = max(np.abs(new - mean).max(), np.abs(new_cov - cov).max())
        mean, cov = new, new_cov
        if moved < tolerance:
            break
    return mean, cov, row["n"]


def mcar_test(df: DataFrame, columns: Sequence[str], moments: str = "em", rounds: int = 200, tolerance: float = 1e-8) -> DataFrame:
    """Little's test of "missing completely at random": statistic, degrees of freedom, p value.

    ``moments``: ``em`` takes the maximum-likelihood mean and covariance that the test is defined on, ``available`` those of the
    known values and pairs. The table is read once for each and reduced to one row of sums per NULL pattern, which stay in Spark;
    every round of EM and the statistic are aggregates over these rows.
    """
    columns = list(columns)
    p = len(columns)
    table = stage(pattern_sums(df, columns), "null-patterns")
    table = table.coalesce(1 + table.count() // 1000)
    if table.isEmpty():
        return df.sparkSession.createDataFrame([(0.0, 0, 1.0)], "statistic double, dof int, p_value double")
    if moments == "em":
        mean, cov, n = _moments(table, p, rounds, tolerance)
        cov = cov * n / max(n - 1, 1)
    else:
        mean, cov = _available_moments(df, columns, table)

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d2 = np.zeros(len(batch))
            for k, (pattern, count, s) in enumerate(zip(batch["pattern"], batch["n"], batch["s"], strict=True)):
                o = _seen(int(pattern), p)
                away = np.asarray(s)[o] / count - mean[o]
                d2[k] = count * float(away @ np.linalg.pinv(cov[np.ix_(o, o)]) @ away)
            yield pd.DataFrame({"d2": d2, "seen": [int(_seen(int(x), p).sum()) for x in batch["pattern"]]})

    out = table.select("pattern", "n", "s").mapInPandas(distances, "d2 double, seen int").agg(
        F.sum("d2").alias("statistic"), F.greatest(F.sum("seen") - p, F.lit(0)).cast("int").alias("dof"))
    return out.withColumn("p_value", chi2_tail(F.col("statistic"), F.col("dof")))


def _available_moments(df: DataFrame, columns: Sequence[str], table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means of the known values and covariances of the known pairs, standardised like the patterns."""
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    first = table.select("shift", "scale").first()
    shift, scale = np.array(first["shift"]), np.array(first["scale"])
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = (row[f"s{i}_{j}"] or 0.0) / (scale[i] * scale[j])
    return (np.array([row[f"m{i}"] if row[f"m{i}"] is not None else shift[i] for i in range(len(columns))]) - shift) / scale, cov


def chi2_tail(x: Column, dof: Column, terms: int = 400) -> Column:
    """Upper tail of the chi-square distribution, by the incomplete gamma function at (dof / 2, x / 2).

    Below a + 1 the power series of the lower function is summed, above it the continued fraction of the upper one is evaluated (modified Lentz).
    Zero degrees of freedom give 1.
    """
    a, z = F.greatest(dof, F.lit(1)) / 2.0, x / 2.0
    half = dof % 2 == 1
    # log gamma(a): steps of one from 1/2 or 1.
    start = F.when(half, F.lit(0.5)).otherwise(F.lit(1.0))
    base = F.when(half, F.lit(0.5 * math.log(math.pi))).otherwise(F.lit(0.0))
    log_gamma = base + F.aggregate(F.sequence(F.lit(0), F.greatest((a - start).cast("int"), F.lit(0))), F.lit(0.0), lambda s, k: s + F.when(k < a - start, F.log(start + k)).otherwise(0.0))
    scale = F.exp(a * F.log(z) - z - log_gamma)
    steps = F.sequence(F.lit(1), F.lit(terms) + (4 * F.sqrt(a)).cast("int"))
    series = F.aggregate(steps, F.struct((1.0 / a).alias("t"), (1.0 / a).alias("s")), lambda s, k: F.struct((s["t"] * z / (a + k)).alias("t"), (s["s"] + s["t"] * z / (a + k)).alias("s")))["s"]
    tiny = F.lit(1e-300)
    b0 = z + 1.0 - a
    b0 = F.when(F.abs(b0) < tiny, tiny).otherwise(b0)

    def lentz(s: Column, k: Column) -> Column:
        an, b = -k * (k - a), b0 + 2.0 * k
        d = 1.0 / F.when(F.abs(an * s["d"] + b) < tiny, tiny).otherwise(an * s["d"] + b)
        c = F.when(F.abs(b + an / s["c"]) < tiny, tiny).otherwise(b + an / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    fraction = F.aggregate(steps, F.struct((1.0 / tiny).alias("c"), (1.0 / b0).alias("d"), (1.0 / b0).alias("h")), lentz)["h"]
    tail = F.when(z < a + 1.0, 1.0 - scale * series).otherwise(scale * fraction)
    return F.when((dof <= 0) | (x <= 0), F.lit(1.0)).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))


def track_bounds(df: DataFrame, key: Sequence[str] = ("mmsi",), order: str = "epoch") -> DataFrame:
    return df.groupBy(*key).agg(F.min(order).alias("min_epoch"), F.max(order).alias("max_epoch"))


def keys_per_label(df: DataFrame, key: str = "trajectory_id", label: str = "label") -> DataFrame:
    pairs = df.select(label, key).distinct()
    return pairs.groupBy(label).agg(F.count(key).alias("trajectories"))


def split_report(df: DataFrame, split: str = "split", key: str = "mmsi", label: str = "trawling") -> DataFrame:
    """Vessels, share of all vessels, rows and positive rows of each split."""
    per_key = df.groupBy(split, key).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(F.col(label) == 1).alias("_pos")
    )
    per_split = per_key.groupBy(split).agg(
        F.count(key).alias("vessels"), F.sum("_rows").alias("rows"), F.sum("_pos").alias("positive_rows")
    )
    total = per_split.agg(F.sum("vessels").alias("v"))
    d = per_split.withColumn("_t", single_row(total))
    return d.select(
        split, "vessels", F.round(F.col("vessels") * 100.0 / F.col("_t.v"), 1).alias("vessel_percent"),
        "rows", "positive_rows", (F.col("rows") - F.col("positive_rows")).alias("negative_rows"),
    )


def mean_scores(runs: DataFrame, by: Sequence[str] = ("corruption", "model"),
                scores: Sequence[str] = ("accuracy", "f1_score")) -> DataFrame:
    return runs.groupBy(*by).agg(*[F.round(F.avg(s), 3).alias(s) for s in scores])


def fallback_use(results: DataFrame, flag: str = "used_fallback") -> DataFrame:
    hit = F.col(flag).cast("int")
    return results.agg(
        F.count(F.lit(1)).alias("results"), F.coalesce(F.sum(hit), F.lit(0)).alias("fallback_count"),
        F.round(F.avg(hit), 4).alias("fallback_ratio"),
    )


def window_counts(windows: DataFrame, key: str = "mmsi", reason: str = "reason", start: str = "window_no",
                  until_first: bool = False) -> DataFrame:
    """Valid and skipped windows per vessel; ``until_first`` counts as if stopping at the first valid one."""
    ok = F.col(reason) == "ok"
    d = windows.groupBy(key).agg(
        F.count_if(ok).alias("valid_windows"), F.count_if(~ok).alias("skipped_windows"),
        F.min(F.when(ok, F.col(start))).alias("_first"),
    )
    if not until_first:
        return d.drop("_first")
    found = F.col("_first").isNotNull()
    return d.select(
        key, found.cast("bigint").alias("valid_windows"),
        F.when(found, F.col("_first")).otherwise(F.col("skipped_windows")).alias("skipped_windows"),
    )


