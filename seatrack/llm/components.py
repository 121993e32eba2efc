"""Connected components over link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatrack.llm.store import release, stage


def components(links: DataFrame, a: str, b: str, label: str = "components") -> DataFrame:
    """(``_node``, ``_root``) of every node that has a link, with the smallest node as root.

    Alternating large-star and small-star steps: every step is a minimum per node, combined before the
    shuffle, and a join back on a written table, so a node with very many links is split like any
    skewed join. Each round is written and the one before deleted; rounds grow with the logarithm of the longest chain.
    """
    edges = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), label)
    before = None
    while True:
        after = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before or not after[0]:
            return edges.select(F.col("u").alias("_node"), F.col("v").alias("_root")).union(
                edges.select(F.col("v"), F.col("v")).distinct())
        before = after
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = stage(both.groupBy(F.col("u").alias("n")).agg(F.least("n", F.min("v")).alias("m")), label)
        large = stage(both.filter("v > u").join(nearest, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), label)
        low = stage(large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")), label)
        small = (large.join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                 .union(low.select("n", "m")))
        read = (edges, nearest, large, low)
        edges = stage(small.distinct(), label)
        release(*read)
