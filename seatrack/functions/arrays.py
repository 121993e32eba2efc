"""Statistics of small arrays collected from a window frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_median(values: Column) -> Column:
    """Median of the non-NULL elements; NULL for none."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(s)
    mid = F.floor(n / 2).cast("int")
    odd = F.get(s, mid)
    even = (F.get(s, mid - 1) + F.get(s, mid)) / 2.0
    return F.when(n % 2 == 1, odd).when(n > 0, even)


def array_mode(values: Column) -> Column:
    """Most frequent non-NULL element, the smallest one on a tie."""
    known = F.filter(values, lambda x: x.isNotNull())
    counted = F.transform(
        F.array_distinct(known),
        lambda v: F.struct((-F.size(F.filter(known, lambda x: x == v))).alias("neg"), v.alias("v")),
    )
    return F.array_min(counted)["v"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)
