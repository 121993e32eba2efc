"""Fingerprints from Lempel-Ziv phrases: texts that would compress each other share phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

KEEP = 64
_BITS = 48


def parse(text: str, seen: set[str], start: int, end: int, stop: int) -> int:
    """Cut ``text`` into phrases up to ``stop``: each is the shortest one not seen before.

    Goes on from a phrase begun at ``start`` that is known up to ``end``; returns the start of the phrase left open, which is
    known already.
    """
    add = seen.add
    for k in range(end + 1, stop + 1):
        phrase = text[start:k]
        if phrase not in seen:
            add(phrase)
            start = k
    return start


def hashes(phrases: Iterable[str], n: int) -> np.ndarray:
    """48-bit hashes of ``n`` phrases, in any order: the smallest, or all of few."""
    from xxhash import xxh64_intdigest

    out = np.fromiter(map(xxh64_intdigest, phrases), np.uint64, n) >> np.uint64(64 - _BITS)
    # Twice as many as needed, so that equal hashes of different phrases leave enough.
    return np.partition(out, 2 * KEEP)[:2 * KEEP] if n > 2 * KEEP else out


def signature(*parts: np.ndarray) -> np.ndarray:
    """The ``KEEP`` smallest hashes of all parts, ascending; all of a smaller set."""
    return np.unique(np.concatenate(parts))[:KEEP]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases, 0 to 1; exact for small sets. Two empty texts are alike."""
    both = np.union1d(a, b)[:KEEP]
    if not len(both):
        return 1.0
    return float(np.isin(both, a, assume_unique=True).astype(int) @ np.isin(both, b, assume_unique=True)) / len(both)


def fingerprint(text: str) -> np.ndarray:
    seen: set[str] = set()
    parse(text, seen, 0, 0, len(text))
    return signature(hashes(seen, len(seen)))


def text_and_edit(text: str, follower: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The edited text and both fingerprints. The common first part is parsed and hashed once."""
    n = len(text)
    cut = n - n // 2
    edited = text[:cut] + follower[:n // 2]
    seen: set[str] = set()
    at = parse(text, seen, 0, 0, cut)
    common, other = set(seen), set(seen)
    parse(text, seen, at, cut, n)
    parse(edited, other, at, cut, len(edited))
    shared = hashes(common, len(common))
    seen -= common
    other -= common
    return edited, signature(shared, hashes(seen, len(seen))), signature(shared, hashes(other, len(other)))


def as_text(sig: np.ndarray) -> str:
    return "".join(f"{x:012x}" for x in sig.tolist())


def _neighbours(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """Rows dealt to ranges of the key, each range with a copy of the row that follows its last one.

    Ranges are cut at approximate quantiles; their number is a parameter, so cuts and first keys are small.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = rows.agg(F.percentile_approx("_key", shares, 100 * buckets).alias("c")).first()["c"] if shares else []
    cuts = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def bucket_of(keys: pd.Series) -> pd.Series:
        # Descending keys, null last.
        place = len(cuts) - np.searchsorted(cuts, keys.fillna(0).to_numpy(np.int64), "left")
        return pd.Series(np.where(keys.isna(), len(cuts) + 1, place))

    dealt = rows.withColumn("_bucket", bucket_of(F.col("_key").cast("long")))
    heads = sorted((r["_bucket"], r["k"]) for r in rows.select("_key").withColumn("_bucket", bucket_of(F.col("_key").cast("long")))
                   .groupBy("_bucket").agg(F.max("_key").alias("k")).collect())
    if not heads:
        return dealt.withColumn("_copy", F.lit(0))
    # The first key of a range is also needed by the range before; the first of all by the last.
    before = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}
    known = {k: b for k, b in before.items() if k is not None}
    lone = before.get(None)

    @F.pandas_udf("int")
    def also_in(keys: pd.Series) -> pd.Series:
        return keys.map(known).astype("Int64").where(keys.notna(), lone if lone is not None else pd.NA)

    places = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("c")), F.struct(F.col("_also").alias("b"), F.lit(1).alias("c")))
    return (dealt.withColumn("_also", also_in(F.col("_key").cast("long")))
            .withColumn("_place", F.explode(F.filter(places, lambda p: p["b"].isNotNull())))
            .select("_key", "_text", F.col("_place")["b"].alias("_bucket"), F.col("_place")["c"].alias("_copy")))


def phrase_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per document with its fingerprint, that of an edited text, and their likeness.

    The edited text ends in the beginning of the next document by descending integer key (null last; repeated keys by
    text; after the last the first): its last floor(n/2) characters are replaced by as many of those. Null text is empty: no
    phrases, empty fingerprint. A lone document follows itself. Every text is parsed whole, once for itself and half
    more for the edit; a task holds two texts at a time.
    """
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _neighbours(docs, key, text, n)
    kind = rows.schema["_key"].dataType
    schema = (f"_key {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last = None  # (bucket, key, text) waiting for its follower
        open_ = None  # (row without near_next, signature) waiting for the follower's signature
        for b in batches:
            for bucket, copy, key_, text_ in zip(*(b.column(c).to_pylist() for c in ("_bucket", "_copy", "_key", "_text")), strict=True):
                if last and last[0] == bucket:
                    edited, own, other = text_and_edit(last[2], text_)
                    if open_:
                        out.append((*open_[0], likeness(open_[1], own)))
                    row = (last[1], len(last[2]), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(other), likeness(own, other))
                    open_ = (row, own)
                    if copy:
                        out.append((*row, likeness(own, fingerprint(text_))))
                        open_ = None
                last = None if copy else (bucket, key_, text_)
                if len(out) >= 500:
                    yield _batch(out, kind, schema)
                    out = []
        if out:
            yield _batch(out, kind, schema)

    dealt = rows.repartition(max(1, n // 4), "_bucket").sortWithinPartitions("_bucket", "_copy", F.desc_nulls_last("_key"), "_text")
    return dealt.mapInArrow(run, schema).withColumnRenamed("_key", key)


def _batch(rows: list[tuple], kind, schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
