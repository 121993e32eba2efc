"""Quality classifier: a factorisation machine over hashed words and text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatrack.llm import tokens
from seatrack.llm.store import hash_cut

BITS = 18
LEVELS = 16
_CLASSES = ("upper", "lower", "digit", "space", "newline", "stop", "symbol", "other", "wide")
_CLASS = np.full(256, _CLASSES.index("other"), np.uint8)
_CLASS[ord("A"):ord("Z") + 1] = 0
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[[32, 9, 11, 12, 13]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:?'\""]] = 5
_CLASS[[ord(c) for c in "#*$%&|<>!"]] = 6
_CLASS[128:] = 8
N_STATS = len(_CLASSES) + 5
SIZE = (1 << BITS) + N_STATS * (LEVELS + 1)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def _stats(off: np.ndarray, data: np.ndarray, woff: np.ndarray, distinct: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Level 0..LEVELS of every statistic of every row."""
    n, c = len(off) - 1, len(_CLASSES)
    size = np.diff(off)
    counts = np.bincount(np.repeat(np.arange(n) * c, size) + _CLASS[data], minlength=n * c).reshape(n, c)
    words = np.maximum(np.diff(woff), 1)
    share = counts / np.maximum(size, 1)[:, None]
    # Square roots spread the small shares over more levels.
    graded = np.sqrt(np.column_stack([share, distinct / words, most / words])) * LEVELS
    rest = np.column_stack([np.log2(1 + size), np.log2(1 + np.diff(woff)), size / words])
    return np.clip(np.concatenate([graded, rest], 1).astype(np.int64), 0, LEVELS)


def features(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids, values and row offsets: log counts of hashed words scaled to length one, and one
    feature per statistic and level. Every row has its statistics, so none is empty."""
    n = len(off) - 1
    hashes, woff = tokens.word_hashes(off, data)
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(woff))
    keys, counts = np.unique((row << np.uint64(BITS)) | (hashes >> np.uint64(64 - BITS)), return_counts=True)
    row, ids = (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)
    x = 1 + np.log(counts)
    length = np.sqrt(np.bincount(row, x * x, n))
    most = np.zeros(n)
    np.maximum.at(most, row, counts)
    levels = _stats(off, data, woff, np.bincount(row, minlength=n), most)
    own = (1 << BITS) + np.arange(N_STATS) * (LEVELS + 1) + levels
    order = np.argsort(np.concatenate([row, np.repeat(np.arange(n), N_STATS)]), kind="stable")
    all_ids = np.concatenate([ids, own.ravel()])[order]
    all_x = np.concatenate([x / length[row] if len(row) else x, np.full(own.size, 0.5)])[order]
    ends = np.bincount(row, minlength=n).cumsum() + N_STATS * np.arange(1, n + 1)
    return all_ids.astype(np.int32), all_x.astype(np.float32), np.concatenate([[0], ends])


def scores(model: Model, ids: np.ndarray, x: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds by the sum-of-squares identity, and the factor sums. Linear in the number of features."""
    v = model.factors[ids] * x[:, None]
    sums = np.add.reduceat(v, ptr[:-1])
    pairs = (sums * sums - np.add.reduceat(v * v, ptr[:-1])).sum(1) / 2
    return model.bias + np.add.reduceat(model.linear[ids] * x, ptr[:-1]) + pairs, sums


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], rank: int = 8, epochs: int = 8, rate: float = 0.1,
        decay: float = 1e-5, batch: int = 256, seed: int = 7) -> Model:
    """AdaGrad on the logistic loss over rows of (ids, values, label 0/1). Without rows every score is one half."""
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, rank)).astype(np.float32))
    if not rows:
        model.factors[:] = 0
        return model
    past_w, past_v, past_b = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, rank), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = [rows[i] for i in order[k:k + batch]]
            sizes = np.array([len(r[0]) for r in part])
            ids, x = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            z, sums = scores(model, ids, x, np.concatenate([[0], sizes.cumsum()]))
            g = (probability(z) - np.array([r[2] for r in part])) / len(part)
            used, back = np.unique(ids, return_inverse=True)
            gx = np.repeat(g, sizes) * x
            grad_w = np.bincount(back, gx) + decay * model.linear[used]
            each = gx[:, None] * (np.repeat(sums, sizes, 0) - model.factors[ids] * x[:, None])
            grad_v = np.column_stack([np.bincount(back, each[:, f]) for f in range(rank)]) + decay * model.factors[used]
            past_w[used] += grad_w ** 2
            past_v[used] += grad_v ** 2
            past_b += g.sum() ** 2
            model.linear[used] -= rate * grad_w / np.sqrt(past_w[used])
            model.factors[used] -= rate * 0.3 * grad_v / np.sqrt(past_v[used])
            model.bias -= rate * g.sum() / np.sqrt(past_b)
    return model


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, off, data in tokens.chunks(b.column("_text")):
            ids, x, ptr = features(off, data)
            lists = [pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(a)) for a in (ids, x)]
            yield pa.RecordBatch.from_arrays([b.column("_order")[i:j], b.column("_label")[i:j], *lists], ["_order", "_label", "ids", "x"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          max_rows: int = 6000, **options) -> Model:
    """Fit on a sample of at most ``max_rows`` labelled documents, those with the smallest hash of their key.

    The sampled labels (bounded) are broadcast, so texts aren't shuffled; features of the sample come to
    the driver. Rows with a null label are left out; repeated rows count as often as they occur.
    """
    known, order = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()), F.xxhash64(F.col(key).cast("string"))
    chosen = (known.filter(order <= hash_cut(known.count(), max_rows))
              .select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_label"), order.alias("_order"))
              .orderBy("_order", "_k", "_label").limit(max_rows))
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = (rows.join(F.broadcast(chosen), F.col("_key") == F.col("_k")).select("_order", "_label", "_text")
             .mapInArrow(_feature_batches, "_order long, _label int, ids array<int>, x array<float>"))
    sample = found.orderBy("_order", "_label").limit(max_rows).toArrow()
    get = [sample.column(c).combine_chunks() for c in ("ids", "x", "_label")]
    return fit([(a.values.to_numpy(), b.values.to_numpy(), y.as_py()) for a, b, y in zip(*get, strict=True)], **options)


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, score) per document; score 0..1, higher where label 1 is likelier.

    Null and empty texts are scored by their statistics alone; very long ones whole. The model has a
    fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(F.col(key).alias("_key")).schema[0].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, off, data in tokens.chunks(b.column("_text")):
                z, _ = scores(shared.value, *features(off, data))
                yield pa.RecordBatch.from_arrays([b.column("_key")[i:j], pa.array(probability(z))], ["_key", "score"])

    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(score, f"_key {kind.simpleString()}, score double").withColumnRenamed("_key", key)


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, off, data in tokens.chunks(b.column(text)):
                good = probability(scores(shared.value, *features(off, data))[0]) >= least
                yield b.slice(i, j - i).filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
