"""Phrase collocations from count streams: external sorted runs, merged in prefix order, joined in lockstep in prefix and suffix order.

Frequent words of a language are numbered by sorted hash arrays in the shared folder. Each place of a text is one record of the
numbers of the next four words; tasks sort and combine records into packed runs, runs are cut at sampled
boundaries and merged, and one walk over a merged range counts all phrases of two to four words, which are its prefixes. Phrases
under the least count end there, so what is joined later is much smaller than the text. Counts of left and right parts and of
extensions come from sort-merge joins (hint ``merge``): streams sorted by their first words, or by their last, are read in
lockstep; no hash table is built, and a frequent key is split like any skewed join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrack.llm import tokens
from seatrack.llm.ngrams import Shards, _added, _pack, _unpack, mapped, write_array
from seatrack.llm.store import shared_path, stage

WORDS = 4
#: Words of the dictionary in a file, records of a merged range, of a flush and of a packed run, and for one sampled boundary.
SHARD_WORDS, RANGE, FLUSH, RUN, SAMPLE = 1 << 20, 1 << 21, 1 << 22, 1 << 18, 1 << 14
_CHUNK = 1 << 23
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAP[[*b" \t"]] = True
_LOW = np.uint64(0xFFFFFFFF)
_GRAM = [f"w{i}" for i in range(1, WORDS + 1)]


def _found(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hash (of language and word), language hash, whether it goes on from the word before, start and end byte of every word, and the bytes."""
    group = b.column("_group").to_numpy().view(np.uint64)
    for i, j, off, data in tokens.chunks(b.column("_text"), _CHUNK):
        low, stop = tokens.LOWER[data], _BREAK[data]
        starts, ends, rows = tokens.find_runs(off, ~(stop | _GAP[data]))
        own = np.repeat(group[i:j], np.diff(rows))
        stops = np.concatenate([[0], stop.cumsum()])
        on = np.zeros(len(starts), bool)
        on[1:] = stops[starts[1:]] == stops[ends[:-1]]
        on[rows[:-1][rows[:-1] < len(starts)]] = False
        yield tokens.combine(own, tokens.hash_spans(low, starts, ends)), own, on, starts, ends, low


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for h, group, *_ in _found(b):
            keys, first, n = np.unique(h, return_index=True, return_counts=True)
            groups, totals = np.unique(group, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([groups, group[first]]).view(np.int64)),
                pa.concat_arrays([pa.nulls(len(groups), pa.int64()), pa.array(keys.view(np.int64))]), pa.array(np.concatenate([totals, n]))], ["g", "h", "c"])


def _write_shard(folder: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            whole = pa.Table.from_batches(held)
            values = [whole.column(c).to_numpy() for c in columns]
            files = [write_array(f"{folder}/{c}", v.astype("<i8")) for c, v in zip(columns, values, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([str(int(values[0].view(np.uint64)[0]))]), pa.array([len(whole)]), pa.array([files], pa.list_(pa.string()))], ["first", "n", "files"])

    return run


def sorted_arrays(rows: DataFrame, columns: list[str], label: str) -> Shards:
    """Long columns as arrays in the shared folder, in the unsigned order of the first one; the driver gets one entry a file."""
    shards = max(1, -(-rows.count() // SHARD_WORDS))
    order = [F.col(columns[0]) < 0, F.col(columns[0])]
    written = rows.select(*columns).repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(
        _write_shard(shared_path(rows.sparkSession, label), columns), "first string, n long, files array<string>")
    listed = sorted(written.collect(), key=lambda r: int(r["first"]))
    return Shards([int(r["first"]) for r in listed], [r["n"] for r in listed], [r["files"] for r in listed])


@dataclass
class Dictionary:
    """Numbers of words from 1, by the unsigned order of their hashes; columns: hash, count, language."""

    shards: Shards

    def numbers(self, h: np.ndarray) -> np.ndarray:
        keys, back = np.unique(h, return_inverse=True)
        shard, place, there = self.shards.find(keys)
        return np.where(there, self.shards.bases()[shard] + place + 1, 0)[back]

    def values(self, numbers: np.ndarray, column: int) -> np.ndarray:
        keys, back = np.unique(numbers, return_inverse=True)
        bases, out = self.shards.bases(), np.zeros(len(keys), np.int64)
        shard = np.searchsorted(bases, keys - 1, "right") - 1
        for k in np.unique(shard):
            a, b = np.searchsorted(shard, [k, k + 1])
            out[a:b] = mapped(self.shards.files[k][column], "<i8")[keys[a:b] - 1 - bases[k]]
        return out[back]


def _combined(high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct records in prefix order with the sums of their counts."""
    order = np.lexsort((low, high))
    high, low, counts = high[order], low[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return high[first], low[first], np.add.reduceat(counts, first)


def _packed(high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> list[bytes]:
    rise = high.copy()
    rise[1:] -= high[:-1]
    return [_pack(rise), _pack(low), _pack(counts.astype("<u4"))]


def _unpacked(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(_unpack(data[0], "<u8"), dtype=np.uint64), _unpack(data[1], "<u8"), _unpack(data[2], "<u4").astype(np.int64)


def _runs(words: Dictionary, step: int):
    """Sorted, combined and packed records of the places where two frequent words stand together, and every ``step``-th of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            high, low, counts = _combined(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            at = np.arange(int(tokens.mix(high[:1])[0] % np.uint64(step)), len(high), step)
            for i in range(0, len(high), RUN):
                some = at[(at >= i) & (at < i + RUN)]
                sample = np.column_stack([high[some], low[some]]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([_packed(high[i:i + RUN], low[i:i + RUN], counts[i:i + RUN])], pa.list_(pa.binary())),
                                                  pa.array([sample.tolist()], pa.list_(pa.int64()))], ["data", "sample"])

        for b in batches:
            for h, _, on, *_ in _found(b):
                w = words.numbers(h).astype(np.uint64)
                on &= w != 0
                on[1:] &= w[:-1] != 0
                after, going = [w], np.ones(len(w), bool)
                for k in range(1, WORDS):
                    n = max(len(w) - k, 0)
                    going[:n] &= on[k:]
                    going[n:] = False
                    after.append(np.where(going, np.roll(w, -k), np.uint64(0)))
                some = after[1] != 0
                high, low = after[0][some] << np.uint64(32) | after[1][some], after[2][some] << np.uint64(32) | after[3][some]
                if len(high):
                    held.append((high, low, np.ones(len(high), np.int64)))
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _cut(high: np.ndarray, low: np.ndarray):
    """Parts of every run between the boundaries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data"):
                a, z, counts = _unpacked(data.as_py())
                i, j = np.searchsorted(high, [a[0], a[-1]], "left")[0], np.searchsorted(high, a[-1], "right")
                ends = []
                for k in range(i, j):
                    left, right = np.searchsorted(a, high[k], "left"), np.searchsorted(a, high[k], "right")
                    ends.append(left + int(np.searchsorted(z[left:right], low[k], "left")))
                ends = [0, *ends, len(a)]
                for k, (x, y) in enumerate(zip(ends[:-1], ends[1:])):
                    if x < y:
                        yield pa.RecordBatch.from_arrays([pa.array([int(i + k)], pa.int32()), pa.array([_packed(a[x:y], z[x:y], counts[x:y])], pa.list_(pa.binary()))], ["range", "data"])

    return run


def _phrases(words: Dictionary, least: int):
    """Merge the parts of a range and count the phrases in it. Those at its ends may go on in the next range: they pass whatever their count."""
    def finish(parts: list[list[bytes]]) -> pa.RecordBatch:
        high, low, counts = _combined(*(np.concatenate(x) for x in zip(*map(_unpacked, parts), strict=True)))
        third, turn = low >> np.uint64(32), np.concatenate([[True], high[1:] != high[:-1]])
        columns: list[list[np.ndarray]] = []
        for k, new in ((2, turn), (3, turn | np.concatenate([[True], third[1:] != third[:-1]])), (4, np.ones(len(high), bool))):
            first = np.flatnonzero(new)
            f = np.add.reduceat(counts, first)
            some = f >= least
            if k < WORDS:
                some[[0, -1]] = True
            if k > 2:
                some &= (third if k == 3 else low & _LOW)[first] != 0
            at, none = first[some], np.zeros(int(some.sum()), np.uint64)
            gram = [high[at] >> np.uint64(32), high[at] & _LOW, third[at] if k > 2 else none, low[at] & _LOW if k > 3 else none]
            columns.append([np.full(len(at), k), *gram, f[some]])
        k, *gram, f = (np.concatenate(x).astype(np.int64) for x in zip(*columns, strict=True))
        last = np.choose(k - 2, gram[1:])
        return pa.RecordBatch.from_arrays(list(map(pa.array, (words.values(gram[0], 2), k, *gram, f, words.values(gram[0], 1), words.values(last, 1)))), _STREAM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for number, data in zip(b.column("range").to_pylist(), b.column("data"), strict=True):
                if number != now and parts:
                    yield finish(parts)
                    parts = []
                now = number
                parts.append(data.as_py())
        if parts:
            yield finish(parts)

    return run


_STREAM = ["g", "k", *_GRAM, "f", "first", "last"]


def _rows(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(F.coalesce(F.col(lang).cast("string"), F.lit("und"))).alias("_group"), F.coalesce(F.col(text), F.lit("")).alias("_text"))


def count_phrases(rows: DataFrame, words: Dictionary, n_words: int, least: int, span: int = RANGE) -> DataFrame:
    """The count stream: (g, k, w1..w4, f, first, last) of phrases of k words with f >= ``least``, the last two being counts of single words."""
    step = max(SAMPLE, n_words // 1_000_000)
    runs = stage(rows.mapInArrow(_runs(words, step), "data array<binary>, sample array<long>"), "phrase-runs")
    sample = np.array([x["v"] for x in runs.select(F.explode("sample").alias("v")).collect()], np.int64).view(np.uint64).reshape(-1, 2)
    sample = sample[np.lexsort((sample[:, 1], sample[:, 0]))]
    ranges = max(1, -(-n_words // span))
    bounds = np.unique(sample[np.arange(1, ranges) * len(sample) // ranges], axis=0) if len(sample) else sample
    merged = (runs.select("data").mapInArrow(_cut(bounds[:, 0].copy(), bounds[:, 1].copy()), "range int, data array<binary>")
              .repartition(len(bounds) + 1, "range").sortWithinPartitions("range")
              .mapInArrow(_phrases(words, least), ", ".join(f"{c} long" for c in _STREAM)))
    keys = [c for c in _STREAM if c != "f"]
    return merged.groupBy(*keys).agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _merge(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Lockstep join of two streams sorted by these words; the right side's words get other names."""
    right = right.withColumnsRenamed({b: f"_{b}" for _, b in pairs})
    on = [F.col(a) == F.col(f"_{b}") for a, b in pairs]
    return left.join(right.hint("merge"), on, how).drop(*[f"_{b}" for _, b in pairs])


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741 - named as in the contract
    """floor(2000000 * a / (l + r)) in exact decimals."""
    wide = "decimal(20,0)"
    return F.call_function("div", a.cast(wide) * F.lit(2_000_000).cast("decimal(7,0)"), (l.cast(wide) + r.cast(wide)))


def scored_phrases(stream: DataFrame, percent: int = 80) -> DataFrame:
    """(g, w1..w4, k, a, l, r, score) of phrases that no extension by one word covers to ``percent``.

    A phrase inside a longer one that covers it is inside an extension by one word that does, as that is as frequent or more.
    """
    two, three, four = (stream.filter(F.col("k") == k) for k in (2, 3, 4))
    ahead, behind = [(c, c) for c in _GRAM], list(zip(_GRAM[1:], _GRAM))
    part = lambda x, name, n, *more: x.select(*_GRAM[:n], F.col("f").alias(name), *more)
    three = _merge(_merge(three, part(two, "l2", 2), ahead[:2]), part(two, "r1", 2), behind[:2])
    three = stage(three, "phrases-three")
    four = _merge(four, part(three, "l3", 3, "l2"), ahead[:3])
    four = _merge(four, part(three, "r1", 3, F.col("r1").alias("r2")), behind[:3])
    cut = lambda k, left, right: F.struct(_score(F.col("f"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("cut"), F.col(left).alias("l"), F.col(right).alias("r"))

    def best(x: DataFrame, *cuts: Column) -> DataFrame:
        return x.withColumn("_cut", F.array_min(F.array(*cuts))).select("g", "k", *_GRAM, F.col("f").alias("a"), "_cut.l", "_cut.r", "_cut.score")

    def apart(x: DataFrame, longer: DataFrame, n: int) -> DataFrame:
        for words in (_GRAM[:n], _GRAM[1:n + 1]):
            most = longer.groupBy(*words).agg(F.max("f").alias("_most")).withColumnsRenamed(dict(zip(words, _GRAM)))
            x = _merge(x, most, ahead[:n], "left").filter(F.col("_most").isNull() | (100 * F.col("_most") < percent * F.col("f"))).drop("_most")
        return x

    return (best(apart(two, three, 2), cut(1, "first", "last"))
            .union(best(apart(three, four, 3), cut(1, "first", "r1"), cut(2, "l2", "last")))
            .union(best(four, cut(1, "first", "r1"), cut(2, "l2", "r2"), cut(3, "l3", "last"))))


def _leading(found: DataFrame, top: int) -> DataFrame:
    """All phrases of a language down to the score and count of its ``top``-th; from histograms, so no language is gathered in one task."""
    for value, same in (("score", []), ("a", ["score"])):
        counts = found.groupBy("g", *same, value).agg(F.count("*").alias("_n"))
        order = Window.partitionBy("g").orderBy(*[F.desc(c) for c in (*same, value)])
        ahead = counts.withColumn("_ahead", F.sum("_n").over(order) - F.col("_n"))
        last = ahead.filter(F.col("_ahead") < top).groupBy(F.col("g").alias("_g")).agg(F.min(F.struct(*same, value)).alias("_least"))
        found = found.join(last, F.col("g") == F.col("_g")).filter(F.struct(*same, value) >= F.col("_least")).drop("_g", "_least")
    return found


def _spelled(wanted: Shards):
    """Every wanted word that a part of the text holds, once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, _, _, starts, ends, low in _found(b):
                keys, first = np.unique(h, return_index=True)
                there = wanted.find(keys)[2]
                words = [low[starts[i]:ends[i]].tobytes().decode() for i in first[there]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[there].view(np.int64)), pa.array(words, pa.string())], ["_h", "word"])

    return run


def _hashes(words: Dictionary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = np.column_stack([b.column(c).to_numpy() for c in _GRAM])
            h = np.zeros(w.shape, np.int64)
            h[w > 0] = words.values(w[w > 0], 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], (w > 0).sum(1).cumsum()]), pa.int32()), pa.array(h[w > 0]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in _FOUND], lists], [*_FOUND, "hashes"])

    return run


_FOUND = ["g", "a", "l", "r", "score"]


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, top: int = 2000, percent: int = 80, span: int = RANGE) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Phrases are two to four words that stand together, without a stop between them, ``least`` times and more; ``a`` is their count, ``l`` and ``r`` the
    counts of the two parts at the cut of the lowest score, ``n`` the words of the language. Phrases that a longer one covers to ``percent`` are left out.
    Ties go by count, then by the phrase's bytes. A null language is ``und``; null and empty texts have no words; repeated rows count as often as they
    stand there; an empty table has no phrases. Words of a language are told apart by 64-bit hashes.
    """
    rows = _rows(docs, lang, text)
    counts = rows.mapInArrow(_count_words, "g long, h long, c long").groupBy("g", "h").agg(F.sum("c").alias("c"))
    counts = stage(counts.filter(F.col("h").isNull() | (F.col("c") >= least)), "collocation-words")
    n_words = counts.filter("h IS NULL").agg(F.sum("c")).first()[0] or 0
    words = Dictionary(sorted_arrays(counts.filter("h IS NOT NULL"), ["h", "c", "g"], "collocation-dictionary"))
    if sum(words.shards.size) >= 1 << 32:
        raise ValueError("more than 2^32 frequent words")
    stream = stage(count_phrases(rows, words, n_words, least, span), "phrase-stream")
    found = stage(scored_phrases(stream, percent), "phrases-scored")
    ahead = stage(_leading(found, top).mapInArrow(_hashes(words), ", ".join(f"{c} long" for c in _FOUND) + ", hashes array<long>"), "phrases-leading")
    wanted = sorted_arrays(ahead.select(F.explode("hashes").alias("h")).distinct(), ["h"], "collocation-wanted")
    spelled = rows.mapInArrow(_spelled(wanted), "_h long, word string").groupBy("_h").agg(F.min("word").alias("word"))
    places = ahead.select(*_FOUND, F.xxhash64("hashes").alias("_id"), F.posexplode("hashes").alias("_at", "_hash"))
    phrases = (places.join(spelled, F.col("_hash") == F.col("_h")).groupBy(*_FOUND, "_id").agg(F.array_sort(F.collect_list(F.struct("_at", "word"))).alias("_words"))
               .withColumn("phrase", F.array_join(F.col("_words.word"), " ")))
    names = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")).distinct().withColumn("_g", F.xxhash64("lang"))
    totals = counts.filter("h IS NULL").select(F.col("g").alias("_n_g"), F.col("c").alias("n"))
    order = Window.partitionBy("g").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return (ranked.join(names, F.col("g") == F.col("_g")).join(totals, F.col("g") == F.col("_n_g"))
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
