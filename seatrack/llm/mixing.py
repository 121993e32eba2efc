"""Mixing sources to target weights along a curriculum. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrack.llm.store import stage

WEIGHTS = (5, 2, 1)
#: Weight schedules over training time 0..1 as (time, weight) points with straight lines between, dealt like the weights.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.25), (1.0, 1.25)), ((0.0, 1.0), (1.0, 1.0)))
BUCKET_DIGITS = 3
_WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row (source, class, source_size, target) per source.

    Sources in code-point order, null last, take the weights in turn and share ``share`` of all words.
    What a source gets beyond ``cap`` times its size goes to the others by weight. The water level is where the
    sources, sorted by capacity over weight, stop being full; two windows over one row per source find it.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("_source").isNull(), "_source")
    rows = (sizes.groupBy("_source").agg(F.sum("_size").alias("_total"))
            .withColumn("_class", (F.row_number().over(by_name) - 1) % n))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_class") + 1)
    rows = rows.withColumn("_w", weight).withColumn("_cap", F.col("_total") * F.lit(cap))
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").isNull(), "_source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("_total").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    rows = rows.withColumn("_level", level)
    rows = rows.withColumn("_level", F.max(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.col("_level"))).over(everything))
    return rows.select("_source", "_class", "_total", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("_target"))


def _time(share: Column, kind: Column, schedules: tuple) -> Column:
    """Training time at which a source of this class has given the share (0..1) of its words.

    The demand is the integral of the schedule: in each segment a quadratic in time, which is solved for time.
    """
    out = F.lit(0.0)
    for c, points in enumerate(schedules):
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(points, points[1:])]
        done, case = 0.0, None
        for (t0, w0), (t1, w1), area in zip(points, points[1:], areas):
            need = F.greatest(share * F.lit(sum(areas)) - F.lit(done), F.lit(0.0))
            slope = (w1 - w0) / (t1 - t0)
            when = F.lit(t0) + 2 * need / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0))))
            done += area
            inside = share * F.lit(sum(areas)) <= F.lit(done)
            case = F.when(inside, when) if case is None else case.when(inside, when)
        out = F.when(kind == c, F.coalesce(F.least(case, F.lit(1.0)), F.lit(1.0))).otherwise(out)
    return out


def _order(key: str, text: str) -> Column:
    return F.md5(F.concat_ws("-", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
             weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, schedules: tuple = SCHEDULES) -> DataFrame:
    """One row per document: key, ``size, source_size, target, taken, first_position, second_position``.

    A source walks through its documents in the order of a hash of key and text, as often as its target
    asks (at most ``cap`` = 2 passes); the document at the end of the walk gives only the words still wanted. The
    words given before a copy decide its training time by the inverted schedule of the source; positions are null for copies
    not taken. Running sums go over hash buckets first, then inside a bucket, so no source is gathered.
    Rows alike in key, text and source are interchangeable. Null text: size 0, nothing taken.
    """
    if cap != 2:
        raise ValueError("positions are made for two passes")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stage(docs.select(
        F.col(key).alias("_key"), F.col(source).alias("_source"), F.regexp_count(body, F.lit(_WORD)).cast("long").alias("_size"),
        _order(key, text).alias("_order")), "mix-sizes")
    rows = rows.withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words"))
    ahead = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_ahead"))
    targets = source_targets(rows, weights, share, float(cap)).withColumnRenamed("_source", "_name")
    buckets = buckets.join(targets, F.col("_s").eqNullSafe(F.col("_name")))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", "_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
            .join(buckets, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))))
    wanted = F.round("_target").cast("long")
    at = F.col("_ahead") + F.col("_inside")
    part = lambda start: F.greatest(F.lit(0), F.least(F.col("_size"), wanted - start))
    time = lambda start: F.when(part(start) > 0, _time(start / F.col("_target"), F.col("_class"), schedules))
    return rows.select(
        F.col("_key").alias(key), F.col("_order").alias("order_hash"), F.col("_source").alias(source), F.col("_size").alias("size"),
        F.col("_total").alias("source_size"), F.col("_target").alias("target"),
        (part(at) + part(F.col("_total") + at)).cast("long").alias("taken"),
        time(at).alias("first_position"), time(F.col("_total") + at).alias("second_position"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", position: str = "position", **options) -> DataFrame:
    """The copies the mix takes, with all columns of ``docs`` and their ``position``, range-sorted by it.

    A copy taken in part keeps its leading words. Repeated rows are numbered on both sides, so each gets its own share: different ones are
    counted first and take ranges of numbers, as one row may stand for most of a source. A column of ``docs`` called like ``position`` is replaced.
    """
    plan = mix_plan(docs, key, text, source, **options)
    first, again = F.least("taken", "size"), F.col("taken") - F.col("size")
    copies = F.filter(F.array(F.struct(F.col("first_position").alias("at"), first.alias("words")),
                              F.struct(F.col("second_position").alias("at"), again.alias("words"))), lambda c: c["words"] > 0)
    names = ["_llm_k", "_llm_o", "_llm_s"]
    plan = stage(plan.select(F.col(key).alias("_llm_k"), F.col("order_hash").alias("_llm_o"), F.col(source).alias("_llm_s"), F.col("size").alias("_llm_size"),
                             copies.alias("_llm_copies")), "mix-plan")
    again = stage(plan.groupBy(*names).agg(F.count("*").alias("_llm_n")).filter("_llm_n > 1").drop("_llm_n"), "mix-repeats")
    again = again.select(*[F.col(c).alias(c + "r") for c in names])
    repeated = (F.col("_llm_o") == F.col("_llm_or")) & F.col("_llm_k").eqNullSafe(F.col("_llm_kr")) & F.col("_llm_s").eqNullSafe(F.col("_llm_sr"))
    taken = F.size("_llm_copies") > 0
    rows = docs.withColumn("_llm_order", _order(key, text))
    alike = (F.col("_llm_order") == F.col("_llm_o")) & F.col(key).eqNullSafe(F.col("_llm_k")) & F.col(source).eqNullSafe(F.col("_llm_s"))
    single = rows.join(plan.filter(taken).join(again, repeated, "left_anti"), alike)
    whole = rows.join(again, (F.col("_llm_order") == F.col("_llm_or")) & F.col(key).eqNullSafe(F.col("_llm_kr")) & F.col(source).eqNullSafe(F.col("_llm_sr")), "left_semi")
    whole = whole.groupBy(*rows.columns).agg(F.count("*").alias("_llm_n"))
    group = Window.partitionBy("_llm_order", key, source)
    upto = F.sum("_llm_n").over(group.orderBy("_llm_order", *[c for c in docs.columns if c not in (key, source, text)]).rowsBetween(Window.unboundedPreceding, 0))
    whole = whole.withColumn("_llm_upto", upto)
    turns = (plan.join(again, repeated, "left_semi")
             .withColumn("_llm_turn", F.row_number().over(Window.partitionBy(*names).orderBy("_llm_copies"))).filter(taken))
    several = whole.join(turns, alike & (F.col("_llm_turn") <= F.col("_llm_upto")) & (F.col("_llm_turn") > F.col("_llm_upto") - F.col("_llm_n")))
    wanted = [*rows.columns, "_llm_size", "_llm_copies"]
    out = (single.select(*wanted).union(several.select(*wanted))
           .withColumn("_llm_copy", F.explode("_llm_copies")))
    words = F.col("_llm_copy")["words"]
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, words.cast("int")), "")
    return (out.withColumn(text, F.when(words < F.col("_llm_size"), cut).otherwise(F.col(text))).withColumn(position, F.col("_llm_copy")["at"])
            .select(*[c for c in docs.columns if c != position], position)
            .repartitionByRange(F.col(position), F.col(key)).sortWithinPartitions(position, key))
