"""Classifier and forecaster evaluation, and the history of training runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrack.operators.ordered import row_numbers
from seatrack.sources.staging import release, stage


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_scores(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1; a division by zero counts as 0."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = df.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        *by, "tp", "fp", "fn", "tn",
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts per (truth, prediction) and their percentage of the true class."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    whole = F.sum("n").over(Window.partitionBy("truth"))
    return counts.withColumn("row_percent", F.col("n") * 100.0 / whole)


def _locate(value: Column, lo: int, hi: int) -> Column:
    """Number of the range a value falls into, by binary search over the marks ``_m.m0 ..``."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(value <= F.col(f"_m.m{mid}"), _locate(value, lo, mid)).otherwise(_locate(value, mid + 1, hi))


def precision_recall_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row per distinct score as threshold, from the highest down.

    Equal scores collapse in the map tasks. Running totals are taken inside ranges of scores that hold
    about equally many rows and shifted by the totals of the ranges above. There are as many ranges as
    shuffle partitions, but at least 64.
    """
    ranges = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = df.where(F.col(score).isNotNull())
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    marks = d.agg(F.percentile_approx(score, shares, F.lit(100 * ranges)).alias("m"))
    per_score = d.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(truth) == 1).alias("_pos"), F.count(F.lit(1)).alias("_n")
    )
    fields = F.struct(*[F.get("m", i).alias(f"m{i}") for i in range(ranges - 1)])
    ranged = per_score.withColumn("_m", marks.select(fields.alias("m")).scalar()).withColumn(
        "_range", _locate(F.col("threshold"), 0, ranges - 1)
    ).drop("_m")
    totals = ranged.groupBy("_range").agg(F.sum("_pos").alias("_rp"), F.sum("_n").alias("_rn"))
    above = Window.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = totals.select(
        "_range", F.coalesce(F.sum("_rp").over(above), F.lit(0)).alias("_ap"),
        F.coalesce(F.sum("_rn").over(above), F.lit(0)).alias("_an"), F.sum("_rp").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_range").orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(totals), "_range").withColumns(
        {"tp": F.col("_ap") + F.sum("_pos").over(inside), "flagged": F.col("_an") + F.sum("_n").over(inside)}
    )
    return out.select(
        "threshold", "tp", "flagged",
        _ratio(F.col("tp"), F.col("flagged")).alias("precision"), _ratio(F.col("tp"), F.col("_all")).alias("recall"),
        "_range",
    )


def pr_curve_area(curve: DataFrame) -> DataFrame:
    """Trapezoid area under the curve, starting at recall 0 with precision 1.

    The first point of each score range needs the last point of the range above: one row per range.
    """
    edge = curve.groupBy("_range").agg(F.min_by(F.struct("recall", "precision"), "threshold").alias("_last"))
    order = Window.orderBy(F.col("_range").desc())
    edge = edge.select(F.col("_range"), F.lag("_last").over(order).alias("_from"))
    w = Window.partitionBy("_range").orderBy(F.col("threshold").desc())
    start = F.struct(F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    before = F.coalesce(F.lag(F.struct("recall", "precision")).over(w), F.col("_from"), start)
    d = curve.join(F.broadcast(edge), "_range").withColumn("_b", before)
    strip = (F.col("recall") - F.col("_b.recall")) * (F.col("precision") + F.col("_b.precision")) / 2.0
    return d.agg(F.sum(strip).alias("area"), F.count(F.lit(1)).alias("thresholds"))


def exploded_errors(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Absolute errors per row and step of two arrays of positions."""
    steps = df.select(F.posexplode(F.arrays_zip(F.col(truth).alias("t"), F.col(predicted).alias("p"))).alias("step", "e"))
    lat = F.abs(F.col("e.p.latitude") - F.col("e.t.latitude"))
    lon = F.abs(F.col("e.p.longitude") - F.col("e.t.longitude"))
    return steps.select("step", lat.alias("err_lat"), lon.alias("err_lon"), ((lat + lon) / 2.0).alias("err_mean"))


def forecast_errors(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean absolute error of latitude, longitude and both, per step and (step NULL) overall, with variance."""
    e = exploded_errors(df, truth, predicted)
    cols = ["err_lat", "err_lon", "err_mean"]
    # One pass: per-step moments merge into the overall ones through a rollup.
    return e.rollup("step").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(c.replace("err", "mae")) for c in cols],
        *[F.var_samp(c).alias(c.replace("err", "var")) for c in cols],
    )


def position_errors(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """MAE and MSE over (truth, prediction) column pairs, averaged over the outputs."""
    diffs = [F.col(p) - F.col(t) for t, p in pairs]
    n = float(len(pairs))
    mae = sum((F.abs(d) for d in diffs[1:]), F.abs(diffs[0])) / n
    mse = sum((d * d for d in diffs[1:]), diffs[0] * diffs[0]) / n
    return df.groupBy(*by).agg(F.avg(mae).alias("mae"), F.avg(mse).alias("mse"), F.count(F.lit(1)).alias("n"))


#: Records of a run that are searched together.
RECORD_BLOCK = 1000


def early_stopping(
    history: DataFrame, run: Sequence[str], epoch: str, metric: str, patience: int = 5, min_delta: float = 0.0,
    higher_is_better: bool = False, chunk: int = 1000, tie: Sequence[str] = (),
) -> DataFrame:
    """Best epoch and value of each run and the epoch at which training stops (NULL if it does not).

    Only a record, an epoch that beats all earlier ones, can count as an improvement. Each record points to the first later
    one that is better by more than ``min_delta``, if that comes within ``patience`` epochs; the last improvement is the end of the chain from
    the first record, found by doubling the pointers. Records are found inside blocks of epochs that carry the best value of the blocks
    before, and pointers by searching blocks of records, so no run is gathered in one task. A NULL metric is an epoch without improvement.
    Values of one epoch are taken in the order of ``tie``, then the best first.
    """
    run, ties = list(run), [f"_t{i}" for i in range(len(tie))]
    sign = -1.0 if higher_is_better else 1.0
    d = history.select(*run, F.col(epoch).cast("bigint").alias("_e"), (F.col(metric) * sign).alias("_v"), *[F.col(c).alias(t) for c, t in zip(tie, ties, strict=True)])
    d = d.withColumn("_c", F.floor(F.col("_e") / chunk))
    per = d.groupBy(*run, "_c").agg(F.min("_v").alias("_m"), F.count(F.lit(1)).alias("_k"))
    blocks = Window.partitionBy(*run).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        *run, "_c", F.min("_m").over(blocks).alias("_best_before"),
        F.coalesce(F.sum("_k").over(blocks), F.lit(0)).alias("_off"),
    )
    local = Window.partitionBy(*run, "_c").orderBy("_e", *ties, F.col("_v").asc_nulls_last())
    d = d.join(per, [*run, "_c"], "left").withColumns(
        {
            "_i": F.col("_off") + F.row_number().over(local),
            "_prev": F.least(F.col("_best_before"), F.min("_v").over(local.rowsBetween(Window.unboundedPreceding, -1))),
        }
    )
    record = F.col("_v").isNotNull() & (F.col("_prev").isNull() | (F.col("_v") < F.col("_prev")))
    records = row_numbers(d.where(record).select(*run, "_i", "_e", "_v", "_c"), run, [F.col("_i").asc()], F.col("_c"), "_j")
    records = stage(records.select(*run, "_j", "_i", "_e", "_v", F.floor((F.col("_j") - 1) / RECORD_BLOCK).alias("_b")), "records")
    pointers = stage(_improvements(records, run, patience, float(min_delta)), "improvements")
    while True:
        ahead = pointers.select(*run, F.col("_to").alias("_at"), F.col("_j").alias("_from")).join(
            pointers.select(*run, F.col("_j").alias("_at"), F.col("_to").alias("_further")), [*run, "_at"])
        doubled = stage(ahead.select(*run, F.col("_from").alias("_j"), F.col("_further").alias("_to"), (F.col("_at") != F.col("_further")).alias("_moved")), "improvements")
        going = not doubled.where("_j = 1 AND _moved").isEmpty()
        release(pointers)
        pointers = doubled
        if not going:
            break
    best = pointers.where("_j = 1").select(*run, F.col("_to").alias("_j")).join(records, [*run, "_j"])
    last = d.groupBy(*run).agg(F.max("_i").alias("_last"))
    out = last.join(best.select(*run, "_i", "_e", "_v"), run, "left")
    return out.select(
        *run, F.col("_e").alias("best_epoch"), (F.col("_v") * sign).alias("best_value"),
        F.when(F.col("_last") - F.col("_i") >= patience, F.col("_i") + patience).alias("stop_after"),
    )


def _improvements(records: DataFrame, run: list[str], patience: int, min_delta: float) -> DataFrame:
    """``_to``: the record that improves on record ``_j`` in time, else ``_j`` itself.

    Values of the records of a run fall, so a wanted value lies in the first block whose least value is below it. Blocks are
    few; for each the first and last block that its records can point to are found by one ordered pass over block limits.
    """
    blocks = records.groupBy(*run, "_b").agg(
        F.sort_array(F.collect_list(F.struct("_j", "_i", "_v"))).alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    limits = blocks.select(*run, "_b", "_low", "_high", F.max("_b").over(Window.partitionBy(*run)).alias("_end"))
    marks = limits.select(*run, "_b", "_end", F.explode(F.array(
        F.struct(F.col("_low").alias("at"), F.lit(2).alias("kind")),
        F.struct((F.col("_high") - min_delta).alias("at"), F.lit(0).alias("kind")),
        F.struct((F.col("_low") - min_delta).alias("at"), F.lit(1).alias("kind")))).alias("_m"))
    below = Window.partitionBy(*run).orderBy("_m.at", "_m.kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("_t", F.last(F.when(F.col("_m.kind") == 2, F.col("_b")), True).over(below))
    spans = marks.where("_m.kind < 2").groupBy(*run, "_b").agg(
        F.max(F.when(F.col("_m.kind") == 0, F.col("_t"))).alias("_first"),
        F.coalesce(F.max(F.when(F.col("_m.kind") == 1, F.col("_t"))), F.max("_end")).alias("_final")).where("_first IS NOT NULL")
    wanted = records.join(spans, [*run, "_b"]).select(
        *run, "_j", "_i", (F.col("_v") - min_delta).alias("_below"), F.explode(F.sequence("_first", "_final")).alias("_t"))
    order = Window.partitionBy(*run).orderBy("_b")
    targets = blocks.select(*run, F.col("_b").alias("_t"), "_rows", "_low").join(
        limits.select(*run, F.col("_b").alias("_t"), F.lag("_low").over(order).alias("_before")), [*run, "_t"])
    met = wanted.join(targets, [*run, "_t"]).where(
        (F.col("_low") < F.col("_below")) & (F.col("_before").isNull() | (F.col("_before") >= F.col("_below"))))
    first = F.get("_rows", F.size(F.filter("_rows", lambda r: r["_v"] >= F.col("_below"))))
    met = met.select(*run, "_j", "_i", first.alias("_x")).where(F.col("_x._i") - F.col("_i") <= patience)
    return records.select(*run, "_j").join(met.select(*run, "_j", F.col("_x._j").alias("_next")), [*run, "_j"], "left").select(
        *run, "_j", F.coalesce("_next", "_j").alias("_to"))
