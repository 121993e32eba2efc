"""Language of words and texts: a linear-chain conditional random field."""

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
AFFIX = 4
NGRAMS = (2, 3, 4)


@dataclass
class Model:
    labels: list[str]
    emit: np.ndarray  # feature x label
    start: np.ndarray
    step: np.ndarray  # label x label


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and the word each belongs to: the word itself (lexicon), prefixes and suffixes, n-grams."""
    size, word, ids, owner = ends - starts, np.arange(len(starts)), [], []

    def add(kind: int, a: np.ndarray, b: np.ndarray, own: np.ndarray) -> None:
        order = np.argsort(a, kind="stable")
        h = tokens.mix(tokens.hash_spans(data, a[order], b[order]) + np.uint64(kind))
        ids.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        owner.append(own[order])

    add(1, starts, ends, word)
    for k in range(1, AFFIX + 1):
        long = size >= k
        add(10 + k, starts[long], starts[long] + k, word[long])
        add(20 + k, ends[long] - k, ends[long], word[long])
    for k in NGRAMS:
        n = np.maximum(size - k + 1, 0)
        own = np.repeat(word, n)
        a = starts[own] + np.arange(len(own)) - np.repeat(n.cumsum() - n, n)
        add(30 + k, a, a + k, own)
    return np.concatenate(ids), np.concatenate(owner)


def _sequences(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the lines of all rows: start, end, first word of each line (with the end), row of each line."""
    lines = np.unique(np.concatenate([off, np.flatnonzero(data == 10) + 1]))
    starts, ends, first = tokens.find_words(off, data, lines)
    some = np.diff(first) > 0
    row = np.searchsorted(off, lines[:-1][some], "right") - 1
    return starts, ends, np.concatenate([first[:-1][some], [len(starts)]]), row


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Features of the distinct words, and the distinct word of every word."""
    _, some, back = np.unique(tokens.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    some_sorted = np.argsort(starts[some], kind="stable")
    place = np.empty(len(some), np.int64)
    place[some_sorted] = np.arange(len(some))
    ids, own = word_features(data, starts[some][some_sorted], ends[some][some_sorted])
    return ids, own, len(some), place[back]


def _emissions(emit: np.ndarray, ids: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    count = np.maximum(np.bincount(own, minlength=n), 1)
    return np.column_stack([np.bincount(own, emit[ids, c], n) for c in range(emit.shape[1])]) / np.sqrt(count)[:, None]


def forward_backward(emission: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray):
    """Posterior of every word's label in many sequences at once, expected transitions and starts.

    ``first``: the first word of every sequence, with the end; all sequences have a word. Sequences are
    walked side by side, longest first, so each position costs a few array operations.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    e = np.exp(emission - emission.max(1, keepdims=True))
    t, s = np.exp(step - step.max()), np.exp(start - start.max())
    n, m = e.shape
    alpha, beta, live = np.empty((n, m)), np.ones((n, m)), len(size)
    lives = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right") if len(size) else np.zeros(0, int)
    before = None
    for k, live in enumerate(lives):
        at = begin[:live] + k
        a = e[at] * (s if before is None else before[:live] @ t)
        a /= a.sum(1, keepdims=True)
        alpha[at] = before = a
    moves = np.zeros((m, m))
    after = None
    for k in range(len(lives) - 1, 0, -1):
        live = lives[k]
        at = begin[:live] + k
        ahead = e[at] * beta[at]
        ahead /= ahead.sum(1, keepdims=True)
        b = ahead @ t.T
        prior = alpha[at - 1]
        scale = (prior * b).sum(1, keepdims=True)
        moves += (prior / scale).T @ ahead * t
        beta[at - 1] = b / b.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    return post, moves, post[first[:-1]].sum(0)


def fit(texts: list[str], langs: list[str], rounds: int = 30, rate: float = 0.3, decay: float = 1e-6, seed: int = 7) -> Model | None:
    """Learn from whole texts of known language; None without any.

    A training sequence is three lines of different texts in a row, so that the chain also learns what a
    change of language costs. AdaGrad on the log-likelihood of all sequences.
    """
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    lines = [(x, labels.index(y)) for t, y in zip(texts, langs, strict=True) for x in t.lower().split("\n") if x.split()]
    lines = [lines[i] for i in rng.permutation(len(lines))]
    blob = [" ".join(x for x, _ in lines[i:i + 3]) for i in range(0, len(lines), 3)]
    off, data = tokens.byte_column(pa.array(blob, pa.large_string()))
    starts, ends, first = tokens.find_words(off, data)
    truth = np.concatenate([np.full(len(x.encode().split()), y) for x, y in lines]) if lines else np.zeros(0, int)
    m = len(labels)
    model = Model(labels, np.zeros((1 << BITS, m), np.float32), np.zeros(m), np.zeros((m, m)))
    if not len(truth):
        return model
    ids, own, n, word = _distinct(data, starts, ends)
    share = 1 / np.sqrt(np.maximum(np.bincount(own, minlength=n), 1))
    same = np.ones(len(truth) - 1, bool)
    same[first[1:-1] - 1] = False
    seen = np.bincount(truth[:-1][same] * m + truth[1:][same], minlength=m * m).reshape(m, m)
    begun = np.bincount(truth[first[:-1]], minlength=m)
    past = [np.full(model.emit.shape, 1e-8), np.full(m, 1e-8), np.full((m, m), 1e-8)]
    for _ in range(rounds):
        post, moves, starts_expected = forward_backward(_emissions(model.emit, ids, own, n)[word], first, model.start, model.step)
        miss = -post
        miss[np.arange(len(truth)), truth] += 1
        by_word = np.column_stack([np.bincount(word, miss[:, c], n) for c in range(m)]) * share[:, None]
        grads = [np.column_stack([np.bincount(ids, by_word[own, c], 1 << BITS) for c in range(m)]), begun - starts_expected, seen - moves]
        for value, grad, total in zip((model.emit, model.start, model.step), grads, past, strict=True):
            grad = grad / len(truth) - decay * value
            total += grad ** 2
            value += (rate * grad / np.sqrt(total)).astype(value.dtype)
    return model


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = 400,
          max_bytes: int = 65536, **options) -> Model | None:
    """Fit on at most ``max_docs`` documents of known language and at most ``max_bytes`` each, whole, with the smallest hash of their key."""
    known, order = docs.filter(F.col(lang).isNotNull()), F.xxhash64(F.col(key).cast("string"))
    sample = (known.filter((order <= hash_cut(known.count(), max_docs)) & (F.octet_length(text) <= max_bytes))
              .select(F.col(text).alias("_text"), F.col(lang).alias("_lang"), order.alias("_order"), F.xxhash64(text).alias("_tie"))
              .orderBy("_order", "_tie", "_lang").limit(max_docs).toArrow())
    return fit(sample.column("_text").to_pylist(), sample.column("_lang").to_pylist(), **options)


def tag(model: Model, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges with the word offsets of their rows, word starts and ends, and label posteriors of all words."""
    for i, j, off, data in tokens.chunks(texts):
        starts, ends, first, _ = _sequences(off, data)
        if len(starts):
            ids, own, n, word = _distinct(data, starts, ends)
            post, _, _ = forward_backward(_emissions(model.emit, ids, own, n)[word], first, model.start, model.step)
        else:
            post = np.zeros((0, len(model.labels)))
        yield i, j, np.searchsorted(starts, off), starts, ends, post


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, lang_pred, score) per document.

    Words of a line form a chain, so texts in several languages are labelled word by word; a text gets the
    language with the largest sum of word posteriors, and as score its mean. ``und`` and 0 for null texts,
    texts without a letter, or if nothing could be learned. Case is ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(F.col(key).alias("_key")).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if m is None:
                yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(["und"] * len(b), pa.string()), pa.array(np.zeros(len(b)))], ["_key", "lang_pred", "score"])
                continue
            letters = b.column("_letters")
            for i, j, woff, _, _, post in tag(m, b.column("_text")):
                sums = np.concatenate([np.zeros((1, post.shape[1])), post.cumsum(0)])
                mean = (sums[woff[1:]] - sums[woff[:-1]]) / np.maximum(np.diff(woff), 1)[:, None]
                some = letters[i:j].to_numpy(zero_copy_only=False) & (np.diff(woff) > 0)
                lang = np.where(some, np.array([*m.labels], object)[mean.argmax(1)], "und")
                yield pa.RecordBatch.from_arrays(
                    [b.column("_key")[i:j], pa.array(lang.tolist(), pa.string()), pa.array(np.where(some, np.clip(mean.max(1), 0, 1), 0.0))],
                    ["_key", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("_key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"),
                       F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    return rows.mapInArrow(run, f"_key {kind.simpleString()}, lang_pred string, score double").withColumnRenamed("_key", key)
