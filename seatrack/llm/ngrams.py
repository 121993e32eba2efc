"""Interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays.

Words are ranked by hash: the sorted array of word hashes in the shared folder maps a hash to its rank. Bigrams
are the numbers ``rank of first * (V + 2) + rank of second``, sorted in shards; continuation counts and
the numbers of followers are arrays over ranks. Workers map all arrays into memory and look up sorted,
distinct keys of a part of the text at a time. No table passes through the driver, only shard lists and sums.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatrack.llm import tokens
from seatrack.llm.store import shared_path

END = np.uint64(0xE0D0E0D0E0D0E0D1)
SHARD_TOKENS = 4_000_000
_FLUSH = 4_000_000
_MAPS: dict[str, np.ndarray] = {}


def write_array(uri: str, values: np.ndarray) -> str:
    """Write raw values under a new name: a repeated task leaves its own files, only those it reports are read."""
    uri = f"{uri}-{uuid.uuid4().hex}"
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    return uri


def mapped(uri: str, dtype: str) -> np.ndarray:
    """The array mapped into memory; from a remote store through an unlinked local copy."""
    if uri not in _MAPS:
        if len(_MAPS) > 20_000:
            _MAPS.clear()
        fs, path = pafs.FileSystem.from_uri(uri)
        size = fs.get_file_info(path).size
        if not size:
            _MAPS[uri] = np.zeros(0, dtype)
        elif isinstance(fs, pafs.LocalFileSystem):
            _MAPS[uri] = np.memmap(path, dtype, "r")
        else:
            with tempfile.TemporaryFile() as copy, fs.open_input_stream(path) as data:
                while part := data.read(1 << 24):
                    copy.write(part)
                copy.flush()
                _MAPS[uri] = np.memmap(copy, dtype, "r")
    return _MAPS[uri]


def _pack(values: np.ndarray) -> bytes:
    """Equal bytes of all values side by side, compressed: small or slowly rising numbers take little room."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    raw, size = zstandard.decompress(data), np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


@dataclass
class Shards:
    """A sorted array in pieces: the first key, number and file names of each."""

    first: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    files: list[list[str]] = field(default_factory=list)

    def bases(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard and place in it of sorted keys, and whether they are there."""
        shard = np.searchsorted(np.array(self.first, np.uint64), keys, "right") - 1
        place, there = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for k in np.unique(shard[shard >= 0]):
            a, b = np.searchsorted(shard, [k, k + 1])
            held = mapped(self.files[k][0], "<u8")
            at = np.searchsorted(held, keys[a:b])
            place[a:b] = np.minimum(at, len(held) - 1)
            there[a:b] = held[place[a:b]] == keys[a:b]
        return shard, place, there


@dataclass
class Model:
    words: Shards  # hash; count, running count
    pairs: Shards  # bigram; count up to 255, places and values of larger ones
    ranks: list[list[str]]  # by SHARD of ranks: continuations; followers by count 1, 2, more
    span: int  # ranks in each of these
    n_words: int
    n_tokens: int
    n_docs: int
    total_pairs: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    word_rest: float  # share that discounting gives to unknown words and back to all
    totals: list[int] = field(default_factory=list)  # tokens in each shard of words

    def rank_values(self, rank: np.ndarray, column: int) -> np.ndarray:
        """Of sorted ranks, the value of an array over ranks."""
        out = np.zeros(len(rank), np.int64)
        for k in np.unique(rank // self.span) if len(rank) else ():
            a, b = np.searchsorted(rank, [k * self.span, (k + 1) * self.span])
            out[a:b] = mapped(self.ranks[k][column], "<u4")[rank[a:b] - k * self.span]
        return out


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3 and more, from how many keys are counted 1, 2, 3, 4 times."""
    n = np.maximum(counts.astype(float), 0)
    if n[0] == 0 or n[1] == 0:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0] + [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return np.clip(d, 0, [0, 1, 2, 3])


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and row offsets, part by part."""
    for b in batches:
        for _, _, off, data in tokens.chunks(b.column("_text")):
            yield tokens.word_hashes(off, data)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def batch() -> Iterator[pa.RecordBatch]:
        keys, counts = _added(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        held.clear()
        for i in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + (1 << 17)].view(np.int64)), pa.array(counts[i:i + (1 << 17)])], ["h", "c"])

    for h, rows in _training(batches):
        keys, counts = np.unique(h, return_counts=True)
        held += [(keys, counts.astype(np.int64)), (np.array([END]), np.array([len(rows) - 1]))]
        if sum(len(k) for k, _ in held) > _FLUSH:
            yield from batch()
    if held:
        yield from batch()


def _write_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("h").to_numpy(), b.column("c").to_numpy()) for b in batches if len(b)]
        if held:
            keys = np.concatenate([k for k, _ in held]).view(np.uint64)
            counts = np.concatenate([c for _, c in held])
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            names = [write_array(f"{folder}/{kind}", x) for kind, x in (("hash", keys.astype("<u8")), ("count", counts.astype("<i8")), ("sum", counts.cumsum().astype("<i8")))]
            yield pa.RecordBatch.from_pylist([{"first": str(keys[0]), "n": len(keys), "total": int(counts.sum()), "files": names}],
                pa.schema([("first", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("files", pa.list_(pa.string()))]))

    return run


_SHARD = "first string, n long, total long, files array<string>"


def _ranks(model: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of hashes in any order: rank (-1 if unknown), count, and count of all words ranked before."""
    keys, back = np.unique(h, return_inverse=True)
    shard, place, there = model.words.find(keys)
    bases, totals = model.words.bases(), np.concatenate([[0], np.cumsum(model.totals)])
    rank, count, before = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for k in np.unique(shard[there]):
        at = np.flatnonzero(there & (shard == k))
        p = place[at]
        rank[at] = bases[k] + p
        count[at] = mapped(model.words.files[k][1], "<i8")[p]
        before[at] = totals[k] + mapped(model.words.files[k][2], "<i8")[p] - count[at]
    return rank[back], count[back], before[back]


def _previous(rows: np.ndarray) -> np.ndarray:
    """Place of the token before each, in the sequence of all rows with their ends; -1 at the begin of a text."""
    n = len(rows) - 1
    out = np.arange(rows[-1] + n) - 1
    out[rows[:-1] + np.arange(n)] = -1
    return out


def _with_ends(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(h) + len(rows) - 1, np.uint64)
    ends = rows[1:] + np.arange(len(rows) - 1)
    rest = np.ones(len(out), bool)
    rest[ends] = False
    out[ends], out[rest] = END, h
    return out


def _pair_keys(model: Model, h: np.ndarray, rows: np.ndarray):
    """Rank, count and earlier count of all tokens with the ends, and the place of the one before each."""
    rank, count, before = _ranks(model, _with_ends(h, rows))
    return rank, count, before, _previous(rows)


def _count_pairs(model: Model, n_shards: int):
    """Bigram counts of a task, dealt to shards by the share of all bigrams expected before them.

    With the word counts known, the place of a bigram among all is (words ranked before its first word + the
    share of the second rank of that word's own count): shards are ranges of bigrams of about equal size, and a
    very frequent first word is spread over many.
    """
    width, size = np.uint64(model.n_words + 2), float(model.n_tokens + model.n_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def batch() -> Iterator[pa.RecordBatch]:
            keys, shards, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(keys, kind="stable")
            keys, shards, counts = keys[order], shards[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, shards, counts = keys[first], shards[first], np.add.reduceat(counts, first)
            cuts = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1], [True]]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = keys[a:b].copy()
                part[1:] -= keys[a:b - 1]
                yield pa.RecordBatch.from_arrays([pa.array([int(shards[a])], pa.int32()), pa.array([_pack(part)]), pa.array([_pack(counts[a:b].astype("<u4"))])], ["shard", "keys", "counts"])

        for h, rows in _training(batches):
            rank, count, before, first = _pair_keys(model, h, rows)
            begin = first < 0
            v = np.where(begin, model.n_words, rank[first])
            share = (rank + 1) / (model.n_words + 2)
            at = np.where(begin, model.n_tokens + model.n_docs * share, before[first] + count[first] * share)
            shard = np.minimum(at / size * n_shards, n_shards - 1).astype(np.int64)
            keys, one, counts = np.unique(v.astype(np.uint64) * width + rank.astype(np.uint64), return_index=True, return_counts=True)
            held.append((keys, shard[one], counts))
            if sum(len(k) for k, _, _ in held) > _FLUSH:
                yield from batch()
        if held:
            yield from batch()

    return run


def _write_pairs(model: Model, folder: str):
    """Merge the parts of every shard, write it, and send on followers per first and continuations per second word."""
    width = np.uint64(model.n_words + 2)

    def finish(shard: int, parts: list[tuple[bytes, bytes]]) -> Iterator[dict]:
        keys = np.concatenate([np.cumsum(_unpack(k, "<u8"), dtype=np.uint64) for k, _ in parts])
        keys, counts = _added(keys, np.concatenate([_unpack(c, "<u4") for _, c in parts]).astype(np.int64))
        large = np.flatnonzero(counts >= 255)
        names = [write_array(f"{folder}/{kind}", x) for kind, x in (
            ("pair", keys.astype("<u8")), ("times", np.minimum(counts, 255).astype("u1")), ("place", large.astype("<i8")), ("large", counts[large].astype("<i8")))]
        yield {"span": -1, "first": str(keys[0]), "n": len(keys), "files": names, "data": None, "seen": [int((counts == k).sum()) for k in (1, 2, 3, 4)]}
        v, w = (keys // width).astype(np.int64), (keys % width).astype(np.int64)
        for kind, ranks, weights in ((0, w, None), (1, v, counts == 1), (2, v, counts == 2), (3, v, counts >= 3)):
            ids, back = np.unique(ranks, return_inverse=True)
            sums = np.bincount(back, weights).astype("<u4") if len(ids) else np.zeros(0, "<u4")
            some = sums > 0
            ids, sums = ids[some], sums[some]
            part = ids // model.span
            for k in np.unique(part):
                a, b = np.searchsorted(part, [k, k + 1])
                rise = ids[a:b].copy()
                rise[1:] -= ids[a:b - 1]
                yield {"span": int(k), "first": str(kind), "n": b - a, "files": [], "data": [_pack(rise), _pack(sums[a:b])], "seen": []}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("span", pa.int32()), ("first", pa.string()), ("n", pa.int64()), ("files", pa.list_(pa.string())), ("data", pa.list_(pa.binary())), ("seen", pa.list_(pa.int64()))])
        now, parts = None, []
        for b in batches:
            for shard, keys, counts in zip(b.column("shard").to_pylist(), b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if shard != now and parts:
                    for row in finish(now, parts):
                        yield pa.RecordBatch.from_pylist([row], schema)
                    parts = []
                now = shard
                parts.append((keys, counts))
        if parts:
            for row in finish(now, parts):
                yield pa.RecordBatch.from_pylist([row], schema)

    return run


def _write_ranks(model: Model, folder: str):
    """Dense arrays over a span of ranks: continuations, and followers seen once, twice, more often."""
    def finish(span: int, sums: np.ndarray) -> pa.RecordBatch:
        names = [write_array(f"{folder}/rank{k}", sums[k].astype("<u4")) for k in range(4)]
        return pa.RecordBatch.from_pylist([{"span": span, "files": names, "seen": [int((sums[0] == k).sum()) for k in (1, 2, 3, 4)], "types": int((sums[0] > 2).sum())}],
            pa.schema([("span", pa.int32()), ("files", pa.list_(pa.string())), ("seen", pa.list_(pa.int64())), ("types", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        for b in batches:
            for span, kind, data in zip(b.column("span").to_pylist(), b.column("first").to_pylist(), b.column("data").to_pylist(), strict=True):
                if span != now:
                    if sums is not None:
                        yield finish(now, sums)
                    now, sums = span, np.zeros((4, model.span), np.int64)
                ids = np.cumsum(_unpack(data[0], "<i8")) - span * model.span
                sums[int(kind), ids] += _unpack(data[1], "<u4")
        if sums is not None:
            yield finish(now, sums)

    return run


def train(docs: DataFrame, text: str = "text", shard_tokens: int = SHARD_TOKENS) -> Model:
    """Count words and bigrams of all rows of ``docs``; a null text is empty. All counts cover all rows."""
    spark, folder = docs.sparkSession, shared_path(docs.sparkSession, "bigrams")
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    words = rows.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    # As unsigned numbers negative hashes come last.
    order = [F.col("h") < 0, F.col("h")]
    listed = sorted(words.repartitionByRange(*order).mapInArrow(_write_words(folder), _SHARD).collect(), key=lambda r: int(r["first"]))
    n_words, n_tokens = sum(r["n"] for r in listed), sum(r["total"] for r in listed)
    n_docs = docs.count()
    if (n_words + 2) ** 2 >= 1 << 64:
        raise ValueError("more than 2^32 different words don't fit a bigram number")
    model = Model(Shards([int(r["first"]) for r in listed], [r["n"] for r in listed], [r["files"] for r in listed]), Shards(), [],
                  max(1, shard_tokens // 4), n_words, n_tokens, n_docs, 0, np.zeros(4), np.zeros(4), 1.0, [r["total"] for r in listed])
    if not n_words:
        return model
    n_shards = max(1, -(-n_tokens // shard_tokens))
    merged = (rows.mapInArrow(_count_pairs(model, n_shards), "shard int, keys binary, counts binary")
              .repartition(n_shards, "shard").sortWithinPartitions("shard")
              .mapInArrow(_write_pairs(model, folder), "span int, first string, n long, files array<string>, data array<binary>, seen array<long>"))
    path = shared_path(spark, "bigram-parts")
    merged.write.parquet(path)
    merged = spark.read.schema(merged.schema).parquet(path)
    pairs = sorted(merged.filter("span < 0").select("first", "n", "files", "seen").collect(), key=lambda r: int(r["first"]))
    model.pairs = Shards([int(r["first"]) for r in pairs], [r["n"] for r in pairs], [r["files"] for r in pairs])
    model.total_pairs = sum(model.pairs.size)
    model.pair_discounts = discounts(np.sum([r["seen"] for r in pairs], 0))
    n_spans = -(-(n_words + 1) // model.span)
    spans = (merged.filter("span >= 0").select("span", "first", "data").repartition(n_spans, "span").sortWithinPartitions("span")
             .mapInArrow(_write_ranks(model, folder), "span int, files array<string>, seen array<long>, types long").collect())
    files = {r["span"]: r["files"] for r in spans}
    blank = [write_array(f"{folder}/blank", np.zeros(model.span, "<u4"))] * 4
    model.ranks = [files.get(k, blank) for k in range(n_spans)]
    seen = np.sum([r["seen"] for r in spans], 0)
    model.word_discounts = discounts(seen)
    model.word_rest = float(model.word_discounts[1:] @ [seen[0], seen[1], sum(r["types"] for r in spans)]) / model.total_pairs
    return model


def log_probabilities(model: Model, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of every token (ends included) and its training count."""
    rank, count, _, first = _pair_keys(model, h, rows)
    words, back = np.unique(rank, return_inverse=True)
    known = words >= 0
    one = np.full(len(words), model.word_rest / (model.n_words + 1))
    if known.any():
        c = model.rank_values(words[known], 0)
        one[known] += (c - model.word_discounts[np.minimum(c, 3)]) / max(model.total_pairs, 1)
    p = one[back]
    begin = first < 0
    v = np.where(begin, model.n_words, rank[first])
    total = np.where(begin, model.n_docs, count[first])
    seen = (v >= 0) & (total > 0)
    contexts, where = np.unique(np.where(seen, v, 0), return_inverse=True)
    if model.ranks:
        given = sum(model.pair_discounts[k] * model.rank_values(contexts, k) for k in (1, 2, 3))
        key = v.astype(np.uint64) * np.uint64(model.n_words + 2) + rank.astype(np.uint64)
        both = seen & (rank >= 0)
        keys, place = np.unique(key[both], return_inverse=True)
        c = _pair_counts(model, keys)[place]
        top = np.zeros(len(p))
        top[both] = c - model.pair_discounts[np.minimum(c, 3)]
        p = np.where(seen, (top + given[where] * p) / np.maximum(total, 1), p)
    return np.log10(p), count


def _pair_counts(model: Model, keys: np.ndarray) -> np.ndarray:
    shard, place, there = model.pairs.find(keys)
    out = np.zeros(len(keys), np.int64)
    for k in np.unique(shard[there]):
        at = np.flatnonzero(there & (shard == k))
        out[at] = mapped(model.pairs.files[k][1], "u1")[place[at]]
        big = at[out[at] == 255]
        if len(big):
            out[big] = mapped(model.pairs.files[k][3], "<i8")[np.searchsorted(mapped(model.pairs.files[k][2], "<i8"), place[big])]
    return out


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``n_tokens, n_known, train_tokens, base_score, score``.

    A-Z are lowered; every text ends with one end token, so a null or empty text has one. ``score`` is the
    model's log10 probability of the text, ``base_score`` that of smoothed word counts. A model without
    training text gives every token the probability 1.
    """
    kind = docs.select(F.col(key).alias("_key")).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, off, data in tokens.chunks(b.column("_text")):
                h, rows = tokens.word_hashes(off, data)
                logs, count = log_probabilities(model, h, rows)
                n, own = np.diff(rows) + 1, np.repeat(np.arange(j - i), np.diff(rows) + 1)
                base = np.log10((count + 0.1) / (model.n_tokens + 0.1 * (model.n_words + 1)))
                columns = [n, np.bincount(own, count > 0, j - i).astype(np.int64), np.full(j - i, model.n_tokens), np.bincount(own, base, j - i), np.bincount(own, logs, j - i)]
                yield pa.RecordBatch.from_arrays([b.column("_key")[i:j], *map(pa.array, columns)], ["_key", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("_key", key)
