"""Exact quantiles by radix selection.

Doubles are mapped to 64-bit integers of the same order. A histogram of their leading bits, counted per group and column
with partial sums in the map tasks, tells in which bucket each wanted rank lies; the rows of that bucket alone are
counted by the next bits, and so on until all bits are fixed. There is one path for every size: no sketch, no sorting
of values, and no window over more rows than a histogram has buckets (2^22 at most, however many rows there are).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits right of each digit: the leading 22, then 21, then the last 21 bits.
SHIFTS = (42, 21, 0)
#: Groups x columns x ranks up to which the table of wanted buckets is broadcast.
BROADCAST_ROWS = 100_000


def ordered_bits(x: Column) -> Column:
    """A 64-bit integer that rises with the double; NULL and NaN give NULL, both zeros the same.

    It is the bit pattern of the absolute value, negated for negative values, found with exact arithmetic on powers of two.
    """
    return _signed(x, _pattern(x, _exponent(x, _near(x))))


def with_ordered_bits(df: DataFrame, value: str, name: str = "_bits") -> DataFrame:
    """Adds :func:`ordered_bits` of a column, step by step: as one expression every use of a step would compute it again."""
    x = F.col(value)
    d = df.withColumn("_near", _near(x)).withColumn("_exponent", _exponent(x, F.col("_near")))
    d = d.withColumn("_pattern", _pattern(x, F.col("_exponent")))
    return d.withColumn(name, _signed(x, F.col("_pattern"))).drop("_near", "_exponent", "_pattern")


def _two(e: Column) -> Column:
    return F.pow(F.lit(2.0), e.cast("double"))


def _near(x: Column) -> Column:
    size = F.abs(x)
    return F.greatest(F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size))), F.lit(-1022))


def _exponent(x: Column, near: Column) -> Column:
    """The logarithm may miss by one next to a power of two."""
    size = F.abs(x)
    return near + F.when(size >= _two(near + 1), 1).when((size < _two(near)) & (near > -1022), -1).otherwise(0)


def _pattern(x: Column, exponent: Column) -> Column:
    size = F.abs(x)
    bits = (exponent + 1022) * F.lit(1 << 52) + (size / _two(exponent - 52)).cast("bigint")
    return F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(2047 << 52)).otherwise(bits).cast("bigint")


def _signed(x: Column, bits: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x < 0, -bits).otherwise(bits))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Linearly interpolated quantiles as rows ``(*by, feature, p_index, p, quantile)``.

    NULL and NaN values do not take part; a column without values in a group has no row. The wanted buckets (one row per group, column and rank)
    are broadcast where their number is fixed or was counted to be at most ``broadcast_rows``; otherwise Spark joins them as it sees fit.
    """
    by, ranks = list(by), 2 * len(probs) * len(columns)
    small = not by or df.select(*by).distinct().limit(broadcast_rows // ranks + 1).count() * ranks <= broadcast_rows
    sent = F.broadcast if small else lambda x: x
    pairs = [F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]
    rows = df.select(*by, F.explode(F.array(*pairs)).alias("_e")).select(*by, "_e.f", "_e.v")
    rows = with_ordered_bits(rows.where("v IS NOT NULL AND NOT isnan(v)"), "v")

    wanted, bucket = None, [*by, "f"]
    for shift in SHIFTS:
        inside = rows
        if wanted is not None:
            inside = _same(rows.withColumn("_in", F.shiftright("_bits", above)), sent(wanted.select(*bucket).distinct()), bucket, "left_semi")
        counts = inside.groupBy(*bucket, F.shiftright("_bits", shift).alias("_out")).agg(F.count(F.lit(1)).alias("_k"), F.min("v").alias("_v"))
        within = Window.partitionBy(*bucket)
        counts = counts.withColumns({"_before": F.sum("_k").over(within.orderBy("_out")) - F.col("_k"), "_n": F.sum("_k").over(within)})
        here = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_k"))
        if wanted is None:
            held = counts.withColumn("_r", F.explode(F.filter(F.array(*_ranks(probs)), lambda r: here(r["rank"])))).select(*counts.columns, "_r.*")
        else:
            held = _same(counts, sent(wanted), bucket, "inner").where(here(F.col("rank")))
        wanted = held.select(*by, "f", "q", "side", "pos", F.col("_out").alias("_in"), (F.col("rank") - F.col("_before")).alias("rank"), F.col("_v").alias("value"))
        bucket, above = [*by, "f", "_in"], shift
    ends = wanted.groupBy(*by, "f", "q", "pos").agg(*[F.max(F.when(F.col("side") == s, F.col("value"))).alias(f"_x{s}") for s in (0, 1)])
    value = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * (F.col("pos") - F.floor("pos"))
    names, marks = F.array(*[F.lit(c) for c in columns]), F.array(*[F.lit(float(p)) for p in probs])
    return ends.select(
        *by, F.element_at(names, F.col("f") + 1).alias("feature"), F.col("q").alias("p_index"),
        F.element_at(marks, F.col("q") + 1).alias("p"), value.alias("quantile"))


def _ranks(probs: Sequence[float]) -> list[Column]:
    """Both neighbours of each wanted position among ``_n`` values."""
    out = []
    for q, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        out += [F.struct(F.lit(q).alias("q"), F.lit(s).alias("side"), pos.alias("pos"), end(pos).cast("bigint").alias("rank"))
                for s, end in enumerate((F.floor, F.ceil))]
    return out


def _same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on equal columns, NULL equal to NULL."""
    right = right.withColumnsRenamed({c: f"_same_{c}" for c in on})
    test = [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in on]
    return left.join(right, test, how).drop(*[f"_same_{c}" for c in on])


def wide_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """:func:`exact_quantiles` as one row per group with columns ``{column}_q{index}``."""
    long = exact_quantiles(df, columns, probs, by)
    return long.groupBy(*by).agg(
        *[
            F.max(F.when((F.col("feature") == c) & (F.col("p_index") == j), F.col("quantile"))).alias(f"{c}_q{j}")
            for c in columns
            for j in range(len(probs))
        ]
    )


def approx_wide_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), accuracy: int = 10_000
) -> DataFrame:
    """One-pass sketch version of :func:`wide_quantiles`."""
    return df.groupBy(*by).agg(
        *[
            F.percentile_approx(c, F.lit(float(p)), F.lit(accuracy)).cast("double").alias(f"{c}_q{j}")
            for c in columns
            for j, p in enumerate(probs)
        ]
    )
