"""Reproducible stratified splits by vessel or trajectory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatrack.operators.selection import hash_cuts, row_hash


def assign_splits(
    keys: DataFrame, key: str, stratum: str, train: float = 0.7, val: float = 0.15, seed: int = 42
) -> DataFrame:
    """``split`` for each (key, stratum) pair: per stratum ``floor(p*n)`` keys to train, then to val.

    Keys are ordered by a seeded hash, so the split is the same in every run. Only the hashes at the
    borders are looked up; no stratum is sorted as a whole.
    """
    pairs = keys.select(key, stratum).distinct()
    return _marked(pairs, _cuts(pairs, key, stratum, train, val, seed), key, stratum, seed)


def split_rows(
    df: DataFrame, key: str = "mmsi", stratum: str = "gear_type", train: float = 0.7, val: float = 0.15, seed: int = 42
) -> DataFrame:
    """All rows that have a key, with the split of their (key, stratum) pair.

    The split follows from the hash of the key and the cuts of the stratum, so rows are neither shuffled nor joined with their pairs.
    """
    cuts = _cuts(df.select(key, stratum).distinct(), key, stratum, train, val, seed)
    return _marked(df.where(F.col(key).isNotNull()), cuts, key, stratum, seed)


def _cuts(pairs: DataFrame, key: str, stratum: str, train: float, val: float, seed: int) -> DataFrame:
    """Per stratum the hashes up to which keys belong to train and to val."""
    if not 0 <= train + val <= 1 + 1e-12:
        raise ValueError("split shares must not exceed 1")
    n_train = F.floor(F.lit(float(train)) * F.col("n"))
    n_val = F.floor(F.lit(float(val)) * F.col("n"))
    hashed = pairs.withColumn("_hash", row_hash(seed, key))
    return hash_cuts(hashed, [stratum], "_hash", {"_train": n_train, "_val": n_train + n_val}, few=True)


def _marked(df: DataFrame, cuts: DataFrame, key: str, stratum: str, seed: int) -> DataFrame:
    """``split`` from the cuts; strata are classes, of which there are few, so their cuts are broadcast."""
    cuts = F.broadcast(cuts.withColumnRenamed(stratum, "_stratum"))
    hashed = row_hash(seed, key)
    split = F.when(hashed <= F.col("_train"), "train").when(hashed <= F.col("_val"), "val").otherwise("test")
    d = df.join(cuts, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    return d.withColumn("split", split).drop("_stratum", "_train", "_val")


def union_splits(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
