"""Filters, projections, imputation and row validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatrack import schema as S
from seatrack.operators.ordered import Track, join_key_values, key_values
from seatrack.operators.quantiles import approx_wide_quantiles, wide_quantiles
from seatrack.operators.selection import single_row


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# --- rows and columns ---------------------------------------------------------------------------


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Drop repeated whole rows; copies collapse in the map-side aggregate."""
    return df.dropDuplicates()


def dedup_on_key(df: DataFrame, key: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Keep the first row of each key in ``tie`` order.

    ``row_number() = 1`` lets Spark keep one row per key in every map task before the shuffle, so a
    key with very many copies sends one row per task.
    """
    w = Window.partitionBy(*key).orderBy(*tie)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def drop_unknown_gear(df: DataFrame, column: str = "gear_type") -> DataFrame:
    """Drop unlabelled gear; rows without gear go too."""
    return df.where(~F.col(column).isin(S.UNLABELLED_GEAR))


def drop_class_b(df: DataFrame, mode: str = "not_class_b", column: str = "mobile_type") -> DataFrame:
    tests = {
        "not_class_b": F.col(column) != "Class B",
        "not_b": ~F.col(column).isin("B"),
        "class_a": F.col(column) == "Class A",
    }
    return df.where(tests[mode])


def keep_ship_type(df: DataFrame, ship_type: str = "Fishing", column: str = "ship_type") -> DataFrame:
    return df.where(F.col(column) == ship_type)


def date_range(df: DataFrame, start: str, end: str, column: str = "ts") -> DataFrame:
    """Rows with start <= column < end."""
    kind = df.schema[column].dataType
    lo, hi = F.lit(start).cast(kind), F.lit(end).cast(kind)
    return df.where((F.col(column) >= lo) & (F.col(column) < hi))


def pick_vessels(df: DataFrame, mmsi: Sequence[int], column: str = "mmsi") -> DataFrame:
    return df.where(F.col(column).isin(list(mmsi)))


def relevant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.select(*(columns or ["mmsi", "ts", *S.STATIC, *S.CONTINUOUS]))


def drop_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def label_to_int(df: DataFrame, column: str = "trawling") -> DataFrame:
    """A bucket mean becomes 1 only when every row of the bucket was 1."""
    return df.withColumn(column, F.col(column).cast("int"))


def split_inputs(df: DataFrame, forecasting: bool = True, steps: int = 20) -> tuple[DataFrame, DataFrame]:
    """Inputs and targets; the targets do not stay among the inputs."""
    base = df.drop("mmsi", "ts")
    if not forecasting:
        return base.drop("trawling"), base.select("trawling")
    pairs = [(f"y_lat_{i}", f"y_lon_{i}") for i in range(1, steps + 1)]
    x = base.drop("trawling", *[c for pair in pairs for c in pair])
    y = base.select(*[F.struct(a, b).alias(f"y_pair_{i}") for i, (a, b) in enumerate(pairs, 1)])
    return x, y


def label_trawling(df: DataFrame, name: str = "trawling") -> DataFrame:
    is_trawling = (F.col("nav_status") == S.FISHING_STATUS) & (F.col("gear_type") == S.TRAWL_GEAR)
    return df.withColumn(name, F.when(is_trawling, 1).otherwise(0))


def standardize_date(df: DataFrame, column: str) -> DataFrame | None:
    """Slashes for dashes, first ten characters; None when the column is missing."""
    if column not in df.columns:
        return None
    return df.withColumn(column, F.substring(F.regexp_replace(F.col(column), "-", "/"), 1, 10))


def floor_epoch(df: DataFrame, seconds: int = 10, column: str = "epoch") -> DataFrame:
    return df.withColumn(column, F.floor(F.col(column) / seconds) * seconds)


def clamp(df: DataFrame, limits: Mapping[str, tuple[float, float]] = S.CLAMP_LIMITS) -> DataFrame:
    """Clamp to the limits; NULL stays NULL."""
    return df.withColumns(
        {
            c: F.when(F.col(c) < lo, F.lit(float(lo))).when(F.col(c) > hi, F.lit(float(hi))).otherwise(F.col(c))
            for c, (lo, hi) in limits.items()
        }
    )


# --- skewness and scaling -----------------------------------------------------------------------


def skewness_of(column: str, bias_corrected: bool = False) -> Column:
    """Population skewness g1, or the bias-corrected G1 = g1 * sqrt(n(n-1)) / (n-2)."""
    g1, n = F.skewness(column), F.count(column)
    if not bias_corrected:
        return g1
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def signed_log1p(column: str) -> Column:
    c = F.col(column)
    return F.when(c >= 0, F.log1p(c)).otherwise(-F.log1p(-c))


def reduce_skewness(
    df: DataFrame,
    positive: Sequence[str] = tuple(S.SKEWED_POSITIVE),
    signed: Sequence[str] = tuple(S.SKEWED_SIGNED),
    threshold: float = 1.0,
    bias_corrected: bool = False,
) -> DataFrame:
    """log1p (signed log1p) for columns whose absolute skewness exceeds the threshold."""
    columns = [*positive, *signed]
    if not columns:
        return df
    skews = df.agg(*[skewness_of(c, bias_corrected).alias(c) for c in columns])
    d = df.withColumn("_skew", single_row(skews))
    changed = {}
    for c in columns:
        logged = F.log1p(F.col(c)) if c in positive else signed_log1p(c)
        changed[c] = F.when(F.abs(F.col(f"_skew.{c}")) > threshold, logged).otherwise(F.col(c))
    return d.withColumns(changed).drop("_skew")


def stats_row(stats: DataFrame, features: Sequence[str]) -> Column:
    """``(feature, mean, std)`` rows of a small stats table as one struct ``{feature}_mean/_std``."""
    wide = stats.agg(
        *[
            F.max(F.when(F.col("feature") == c, F.col(kind))).alias(f"{c}_{kind}")
            for c in features
            for kind in ("mean", "std")
        ]
    )
    return single_row(wide)


def normalize(
    df: DataFrame, stats: DataFrame, columns: Sequence[str], exclude: Sequence[str] = (), zero_std: bool = True
) -> DataFrame:
    """z-scores with stored statistics; a zero deviation gives 0. Columns without stats stay as they are."""
    todo = [c for c in columns if c in df.columns and c not in exclude]
    d = df.withColumn("_stats", stats_row(stats, todo))
    changed = {}
    for c in todo:
        mean, std = F.col(f"_stats.{c}_mean"), F.col(f"_stats.{c}_std")
        z = F.try_divide(F.col(c) - mean, std)
        value = F.when(std != 0, z).otherwise(F.lit(0.0)) if zero_std else z
        changed[c] = F.when(mean.isNull(), F.col(c)).otherwise(value)
    return d.withColumns(changed).drop("_stats")


def denormalize(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    d = df.withColumn("_stats", stats_row(stats, columns))
    return d.withColumns(
        {c: F.col(c) * F.col(f"_stats.{c}_std") + F.col(f"_stats.{c}_mean") for c in columns}
    ).drop("_stats")


# --- NULL handling ------------------------------------------------------------------------------


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def complete_numeric_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=numeric_columns(df))


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns else None)


def require_full_future(df: DataFrame, horizon: int, column: str = "future") -> DataFrame:
    """Rows whose future array has ``horizon`` positions without a NULL coordinate."""
    whole = F.forall(column, lambda p: p["latitude"].isNotNull() & p["longitude"].isNotNull())
    return df.where((F.size(column) == horizon) & whole)


def validate_rows(df: DataFrame, features: Sequence[str] = tuple(S.MODEL_FEATURES)) -> DataFrame:
    """Parse the features as doubles; ``error`` names the ones that do not parse, NULL if all do."""
    parsed = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in features}
    bad = F.concat_ws(",", *[F.when(parsed[c].isNull(), F.lit(c)) for c in features])
    return df.withColumn("error", F.when(bad != "", bad)).withColumns(parsed)


def impute_constant(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.na.fill(value, subset=list(columns))


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    d = df.withColumn("_mean", single_row(means))
    return d.withColumns({c: F.coalesce(F.col(c), F.col(f"_mean.{c}")) for c in columns}).drop("_mean")


# --- scores and names ---------------------------------------------------------------------------


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def decide(probability: Column, rule: str = "at_least") -> Column:
    """0/1 decision: >= 0.5, > 0.5, or half-even rounding of the probability."""
    if rule == "round":
        return F.rint(probability).cast("int")
    hit = probability >= 0.5 if rule == "at_least" else probability > 0.5
    return F.when(hit, 1).otherwise(0)


def corruption_class(name: Column) -> Column:
    """Kind of degradation named in a data set name."""
    has = {k: F.contains(name, F.lit(k)) for k in ("missing", "dupes", "labelnoise")}
    parts = F.concat_ws("+", *[F.when(test, F.lit(k)) for k, test in has.items()])
    return F.when(parts == "", "clean").otherwise(parts)


def horizon_steps(minutes: Column, sampling_s: Column) -> Column:
    """Steps ahead for a horizon in minutes; unsampled data has six messages a minute."""
    table = F.create_map(
        *[F.lit(x) for (m, s), steps in S.HORIZON_STEPS.items() for x in (f"{m}/{s}", steps)]
    )
    looked_up = F.element_at(table, F.concat_ws("/", minutes.cast("string"), sampling_s.cast("string")))
    return F.when(sampling_s.isNull(), minutes * S.UNSAMPLED_STEPS_PER_MINUTE).otherwise(looked_up).cast("int")


def lead_for_minute(minute: Column) -> Column:
    """Lead in ten-second steps for an output minute."""
    table = F.create_map(*[F.lit(x) for pair in S.MINUTE_TO_LEAD.items() for x in pair])
    return F.element_at(table, minute.cast("int")).cast("int")


def check_sampling(downsampling: bool, resampling: bool, irregular: bool) -> None:
    """Only one sampling mode at a time, and sampling only of irregular data."""
    if downsampling and resampling:
        raise ValueError("choose either downsampling or resampling")
    if (downsampling or resampling) and not irregular:
        raise ValueError("sampling needs irregular data")


# --- quality filters ----------------------------------------------------------------------------


def drop_empty_vessel_days(df: DataFrame, key: str = "mmsi", ts: str = "ts") -> DataFrame:
    """Drop the days of a vessel on which some column is entirely NULL."""
    columns = [c for c in df.columns if c not in (key, ts)]
    d = df.withColumn("_day", F.to_date(ts))
    good = _vessel_days(d, key, columns).where(all_of([F.col(f"_n_{c}") > 0 for c in columns]))
    return d.join(good.select(key, "_day"), [key, "_day"], "left_semi").select(*df.columns)


def _vessel_days(d: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return d.groupBy(key, "_day").agg(
        *[F.count(c).alias(f"_n_{c}") for c in columns], F.count(F.lit(1)).alias("_rows")
    )


def vessel_day_report(df: DataFrame, key: str = "mmsi", ts: str = "ts") -> DataFrame:
    """What :func:`drop_empty_vessel_days` removes: vessel-days, rows and their share."""
    columns = [c for c in df.columns if c not in (key, ts)]
    per_day = _vessel_days(df.withColumn("_day", F.to_date(ts)), key, columns)
    bad = any_of([F.col(f"_n_{c}") == 0 for c in columns])
    return per_day.agg(
        F.count(F.lit(1)).alias("vessel_days"),
        F.count_if(bad).alias("dropped_vessel_days"),
        F.sum("_rows").alias("total_rows"),
        F.coalesce(F.sum(F.when(bad, F.col("_rows"))), F.lit(0)).alias("dropped_rows"),
    ).withColumn("dropped_percent", F.round(F.try_divide(F.col("dropped_rows") * 100.0, F.col("total_rows")), 2))


def vessel_day_examples(df: DataFrame, key: str = "mmsi", ts: str = "ts", limit: int = 10) -> DataFrame:
    """First dropped vessel-days with the NULL count of each column."""
    columns = [c for c in df.columns if c not in (key, ts)]
    per_day = _vessel_days(df.withColumn("_day", F.to_date(ts)), key, columns)
    bad = per_day.where(any_of([F.col(f"_n_{c}") == 0 for c in columns]))
    return bad.orderBy(key, "_day").limit(limit).select(
        key,
        F.col("_day").alias("day"),
        F.col("_rows").alias("total_rows"),
        *[(F.col("_rows") - F.col(f"_n_{c}")).alias(f"{c}_nulls") for c in columns],
    )


def drop_hollow_vessels(df: DataFrame, columns: Sequence[str], key: Sequence[str] = ("mmsi",), track: Track | None = None) -> DataFrame:
    """Drop vessels for which some column is NULL in every row; with ``track`` vessels are joined chunk by chunk."""
    if track is not None:
        counts = key_values(df, track, **{f"_n_{c}": ("sum", F.col(c).isNotNull().cast("bigint")) for c in columns})
        counts = counts.where(all_of([F.col(f"_n_{c}") > 0 for c in columns]))
        return join_key_values(df, counts.select(*track.parts), track, "left_semi")
    good = df.groupBy(*key).agg(*[F.count(c).alias(f"_n_{c}") for c in columns])
    good = good.where(all_of([F.col(f"_n_{c}") > 0 for c in columns]))
    return df.join(good.select(*key), list(key), "left_semi")


def drop_incomplete_vessels(df: DataFrame, columns: Sequence[str], key: Sequence[str] = ("mmsi",)) -> DataFrame:
    """Drop vessels that have a NULL in any row of any column."""
    missing = any_of([F.col(c).isNull() for c in columns])
    good = df.groupBy(*key).agg(F.count_if(missing).alias("_bad")).where("_bad = 0")
    return df.join(good.select(*key), list(key), "left_semi")


def filter_monthly_iqr(
    df: DataFrame, columns: Sequence[str] = ("latitude", "longitude"), ts: str = "ts",
    exact: bool = False, factor: float = 1.5,
) -> DataFrame:
    """Keep rows inside q1 - f*IQR .. q3 + f*IQR of their calendar month; rows with NULL go.

    One quantile row per calendar month is broadcast, so its size does not grow with the messages.
    """
    d = df.withColumn("_month", F.date_format(ts, "yyyy-MM"))
    quantiles = wide_quantiles if exact else approx_wide_quantiles
    q = quantiles(d, columns, [0.25, 0.75], by=["_month"])
    joined = d.join(F.broadcast(q), "_month", "left")
    kept = all_of([_inside_iqr(c, factor) for c in columns])
    return joined.where(kept).select(*df.columns)


def _inside_iqr(c: str, factor: float) -> Column:
    q1, q3 = F.col(f"{c}_q0"), F.col(f"{c}_q1")
    return F.col(c).between(q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))


def filter_quantile_range(
    df: DataFrame, column: str, low: float = 0.01, high: float = 0.99,
    exact: bool = False, keep_null: bool = False,
) -> DataFrame:
    """Keep rows whose value lies between two quantiles of the column; NULL goes unless kept."""
    q = wide_quantiles(df, [column], [low, high]) if exact else approx_wide_quantiles(df, [column], [low, high], accuracy=1000)
    d = df.withColumn("_q", single_row(q))
    inside = F.col(column).between(F.col(f"_q.{column}_q0"), F.col(f"_q.{column}_q1"))
    if keep_null:
        inside = inside | F.col(column).isNull()
    return d.where(inside).drop("_q")
