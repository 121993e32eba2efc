"""Groups of rows with a common key, compared inside tasks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
_SLAB = 1 << 16
_BYTES = 1 << 27


def in_blocks(rows: DataFrame, key: str, item: str, compare: Callable, schema: str, limit: int = LIMIT) -> DataFrame:
    """Run ``compare`` so that every two items with a common key meet in some task.

    ``rows`` has a 64-bit ``key`` and ``item``. A key with more than ``limit`` items is dealt by a hash of the
    item into parts, and every two parts form a block of their own: nothing is dropped, and no
    block exceeds about twice the limit. ``compare(batch, ends)`` gets Arrow rows sorted by block, and the
    end of every block among them.
    """
    sizes = (rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
             .select(F.col(key).alias("_big"), F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    dealt = rows.join(sizes, F.col(key) == F.col("_big"), "left")
    own = F.pmod(F.xxhash64(item, F.lit(17)), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = (dealt.withColumn("_own", own)
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
             .withColumn("_block", F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other")))
             .select("_block", *rows.columns))

    dealt = dealt.repartition("_block").sortWithinPartitions("_block", item)
    return dealt.mapInArrow(by_key("_block", compare), schema)


def by_key(key: str, compare: Callable) -> Callable:
    """For ``mapInArrow`` over rows sorted by a 64-bit key: ``compare(rows, ends)`` gets many whole groups of two rows and more at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in _chain(batches):
            if b is not None:
                held.append(b)
                if sum(map(len, held)) < _SLAB and sum(x.nbytes for x in held) < _BYTES:
                    continue
            if not held:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            block = whole.column(key).to_numpy()
            ends = np.concatenate([np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            if b is not None:  # the last block may go on in the next batch
                ends = ends[:-1]
            done = int(ends[-1]) if len(ends) else 0
            held = whole.slice(done).to_batches() if done < len(block) else []
            if done:
                sizes = np.diff(np.concatenate([[0], ends]))
                keep = np.repeat(sizes > 1, sizes)
                if keep.any():
                    yield from compare(whole.slice(0, done).filter(pa.array(keep)), sizes[sizes > 1].cumsum())

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of all pairs (a, b); a label is the smallest member."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
