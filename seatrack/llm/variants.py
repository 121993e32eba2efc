"""Spelling variants: the vocabulary's acceptor composed with a one-edit transducer and with the acceptor again.

The initial states of the composition are parted: words that share their first part meet in a partition for edits behind
it, words that share their last part in one for edits before it. So a partition is a small acceptor of the parts in
between. Tasks minimise the acceptors of many partitions together and enumerate the accepted pairs of all of them step by
step; a pair is accepted at the place of its edit alone, hence in one partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatrack.llm import blocks, tokens
from seatrack.llm.store import stage

LIMIT = 8192
_CHUNK = 1 << 22
#: Bytes of runs of letters: A-Z, a-z and the two bytes of U+00C0 to U+00FF, whose first is always 0xC3.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True


def _counted(min_length: int, spoil: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
            for i, j, off, data in tokens.chunks(b.column("_text"), _CHUNK):
                lead = data == 0xC3
                solid = _LETTER[data]
                solid[1:] |= lead[:-1]
                starts, ends, rows = tokens.find_runs(off, solid)
                leads = np.concatenate([np.zeros(1, np.int32), lead.cumsum(dtype=np.int32)])
                size = ends - starts - (leads[ends] - leads[starts])
                row = np.repeat(np.arange(j - i), np.diff(rows))
                long = size >= min_length
                starts, ends, size, row = starts[long], ends[long], size[long], row[long]
                low = tokens.LOWER[data]
                raw, extra = memoryview(low.tobytes()), []
                if spoil:
                    seeds = np.array([zlib.crc32(f"{k or ''}:".encode()) for k in b.column("_key")[i:j].to_pylist()], np.int64)[row]
                    h = np.array([zlib.crc32(raw[a:z], s) for a, z, s in zip(starts.tolist(), ends.tolist(), seeds.tolist(), strict=True)], np.int64)
                    hit = h % spoil == 0
                    at = (h % np.maximum(size, 1))[hit]
                    words = [str(raw[a:z], "utf-8") for a, z in zip(starts[hit].tolist(), ends[hit].tolist())]
                    extra = [w[:p] + w[p + 1:] for w, p in zip(words, at.tolist(), strict=True) if len(w) > min_length]
                    starts, ends = starts[~hit], ends[~hit]
                keys, first, n = np.unique(tokens.hash_spans(low, starts, ends), return_index=True, return_counts=True)
                words = [str(raw[a:z], "utf-8") for a, z in zip(starts[first].tolist(), ends[first].tolist())]
                held.append((keys, n, pa.array(words, pa.string())))
                if extra:
                    yield pa.RecordBatch.from_arrays([pa.array(extra, pa.string()), pa.array(np.ones(len(extra), np.int64))], ["word", "n"])
            if held:
                keys, n = (np.concatenate(x) for x in list(zip(*held, strict=True))[:2])
                _, first, back = np.unique(keys, return_index=True, return_inverse=True)
                words = pa.concat_arrays([x for _, _, x in held]).take(pa.array(first))
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(back, n, len(first)).astype(np.int64))], ["word", "n"])

    return run


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 7, min_count: int = 2, spoil: int | None = 31) -> DataFrame:
    """(word, n): runs of letters of ``min_length`` code points and more that occur ``min_count`` times and more.

    Only A-Z are lowered. With ``spoil`` an occurrence whose crc32 of ``<key>:<run>`` it divides loses one code point
    first, a made misspelling; a null key is written as nothing. Null, empty and wordless texts have no words, and
    repeated rows count as often as they stand there.
    """
    rows = docs.select(F.col(key).cast("string").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return (rows.mapInArrow(_counted(min_length, spoil), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


def _key(word: Column) -> Column:
    """Partition of a word: what stands before and behind the places ``lo`` to ``hi`` of edits in the shorter word."""
    before, behind = word.substr(F.lit(1), F.col("lo")), F.right(word, F.greatest(F.col("size") - F.col("hi"), F.lit(0)))
    return F.xxhash64("size", "lo", "hi", before, behind)


def _parts(vocabulary: DataFrame, min_length: int) -> DataFrame:
    """Every word with the two halves of the places of edits, as the shorter and as the longer word of a pair."""
    size = F.length("word")
    halves = lambda n: [F.struct(n.alias("size"), F.lit(0).alias("lo"), F.floor(n / 2).cast("int").alias("hi")),
                        F.struct(n.alias("size"), F.floor(n / 2).cast("int").alias("lo"), (n + 1).alias("hi"))]
    rows = vocabulary.select("word", "n", F.explode(F.array(*halves(size), *halves(size - 1))).alias("_p")).select("word", "n", "_p.*")
    return rows.filter(F.col("size") >= min_length).withColumn("key", _key(F.col("word")))


def partitions(vocabulary: DataFrame, min_length: int = 7, limit: int = LIMIT) -> DataFrame:
    """(word, n, size, lo, hi, key): each partition of more than ``limit`` words is parted again by halving its places of edits.

    At one place left, the words of a partition differ in one or two code points only, so they are bounded by the letters.
    """
    now, done = _parts(vocabulary, min_length), []
    while True:
        big = now.groupBy("key").agg(F.count("*").alias("_n"), F.min(F.col("hi") - F.col("lo")).alias("_places"))
        big = stage(big.filter((F.col("_n") > limit) & (F.col("_places") > 1)).select(F.col("key").alias("_big")), "variants-large")
        if big.isEmpty():
            return reduce(DataFrame.union, done, now)
        same = F.col("key") == F.col("_big")
        done.append(now.join(big, same, "left_anti"))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        finer = now.join(big, same, "left_semi").withColumn("_p", F.explode(F.array(
            F.struct(F.col("lo").alias("a"), middle.alias("z")), F.struct(middle.alias("a"), F.col("hi").alias("z")))))
        finer = finer.withColumn("lo", F.col("_p.a")).withColumn("hi", F.col("_p.z")).drop("_p")
        now = stage(finer.withColumn("key", _key(F.col("word"))), "variants-parts")


class Acceptor:
    """Minimised acceptor of many word lists, each with an initial state of its own; equal right languages are one state.

    Words of a list are numbered in code-point order: a path's number is the sum of the offsets of its arcs.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, owner: np.ndarray, lists: int) -> None:
        ends = sizes.cumsum()
        begin, node, first = ends - sizes, owner.astype(np.int64), lists
        levels: list[tuple[np.ndarray, np.ndarray, int]] = []  # parent and letter of every node of a level, and its first node
        going = np.arange(len(sizes))
        for d in range(int(sizes.max(initial=0))):
            going = going[sizes[going] > d]
            keys, back = np.unique(node[going] << 21 | codes[begin[going] + d], return_inverse=True)
            node[going] = first + back
            levels.append((keys >> 21, keys & 0x1FFFFF, first))
            first += len(keys)
        final, words = np.zeros(first, bool), np.zeros(first, np.int64)
        final[node] = True
        words += final
        language = np.where(final, np.uint64(0x9E3779B97F4A7C15), np.uint64(1))
        shift = []
        for up, letter, low in reversed(levels):
            own = np.arange(low, low + len(up))
            n = words[own]
            before = n.cumsum() - n
            turn = np.concatenate([[True], up[1:] != up[:-1]])
            shift.append(before - np.repeat(before[turn], np.diff(np.append(np.flatnonzero(turn), len(up)))) + final[up])
            np.add.at(words, up, n)
            np.add.at(language, up, tokens.combine(letter.astype(np.uint64), tokens.mix(language[own])))
        _, one, state = np.unique(language, return_index=True, return_inverse=True)
        up, letter, below, offset = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (
            [x[0] for x in levels], [x[1] for x in levels], [state[x[2] + np.arange(len(x[0]))] for x in levels], shift[::-1]))
        kept = one[state[up]] == up  # arcs of one node for each state
        key = state[up[kept]] << 21 | letter[kept]
        order = np.argsort(key)
        self.arcs, self.to, self.offset = key[order], below[kept][order], offset[kept][order]
        self.first = np.searchsorted(self.arcs, np.arange(len(one) + 1) << 21)
        self.final, self.initial = final[one], state[:lists]

    def out(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every arc of the given states: which of them it leaves, and the arc."""
        low, n = self.first[state], self.first[state + 1] - self.first[state]
        own = np.repeat(np.arange(len(state)), n)
        return own, np.arange(len(own)) - np.repeat(n.cumsum() - n, n) + low[own]

    def find(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The arc with a letter, -1 where there is none."""
        at = np.searchsorted(self.arcs, state << 21 | letter)
        there = self.arcs[np.minimum(at, len(self.arcs) - 1)] == (state << 21 | letter)
        return np.where(there, at, -1)


def compose(acceptor: Acceptor) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Accepted pairs of acceptor, one-edit transducer and acceptor: list, numbers of both words, and whether the edit stands at the end.

    Before the edit both sides are in the same state. The edit replaces a letter by a greater one, or inserts a letter on the right
    that is not the left word's next; so each pair has one path.
    """
    a = acceptor
    own, state, number = np.arange(len(a.initial)), a.initial, np.zeros(len(a.initial), np.int64)
    edited = [np.zeros(0, np.int64)] * 6  # list, both states, both numbers, letter that may not come next
    while len(own) or len(edited[0]):
        # Steps of edited paths: both sides read the same letter.
        g, p, q, x, y, bar = edited
        at, arc = a.out(p)
        letter = a.arcs[arc] & 0x1FFFFF
        free = letter != bar[at]
        at, arc, letter = at[free], arc[free], letter[free]
        other = a.find(q[at], letter)
        both = other >= 0
        at, arc, other = at[both], arc[both], other[both]
        moved = [g[at], a.to[arc], a.to[other], x[at] + a.offset[arc], y[at] + a.offset[other], np.zeros(len(at), np.int64)]
        # The edit.
        at, arc = a.out(state)
        inserted = [own[at], state[at], a.to[arc], number[at], number[at] + a.offset[arc], a.arcs[arc] & 0x1FFFFF]
        place = np.arange(len(at))
        later = np.searchsorted(at, at, "right") - place - 1
        left = np.repeat(place, later)
        right = left + 1 + np.arange(len(left)) - np.repeat(later.cumsum() - later, later)
        changed = [own[at[left]], a.to[arc[left]], a.to[arc[right]], number[at[left]] + a.offset[arc[left]], number[at[left]] + a.offset[arc[right]],
                   np.zeros(len(left), np.int64)]
        edited = [np.concatenate(z) for z in zip(moved, inserted, changed, strict=True)]
        # Steps before the edit.
        own, state, number = own[at], a.to[arc], number[at] + a.offset[arc]
        done = a.final[edited[1]] & a.final[edited[2]]
        if done.any():
            yield edited[0][done], edited[3][done], edited[4][done], edited[5][done] > 0


def _pairs(rows: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    middle = rows.column("middle").combine_chunks()
    codes = np.frombuffer("".join(middle.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    sizes = rows.column("letters").to_numpy()
    first = np.concatenate([[0], ends[:-1]])
    short, last = rows.column("short").to_numpy(), rows.column("last").to_numpy()
    for own, x, y, at_end in compose(Acceptor(codes, sizes, np.repeat(np.arange(len(ends)), ends - first), len(ends))):
        x, y = x + first[own], y + first[own]
        # Two longer words belong to their own partition, and an insertion behind the places of edits to the next one.
        good = short[x] & (last[x] | ~at_end)
        a, b = pa.array(x[good]), pa.array(y[good])
        yield pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().take(i) for i in (a, b) for c in ("word", "n")], ["a", "na", "b", "nb"])


def near_pairs(vocabulary: DataFrame, min_length: int = 7, limit: int = LIMIT) -> DataFrame:
    """(a, na, b, nb) of all words that differ by exactly one inserted, deleted or replaced code point, each pair once.

    ``vocabulary`` has distinct words of ``min_length`` code points and more. Partitions are told apart by 64-bit hashes.
    """
    left, behind = F.length("word"), F.greatest(F.col("size") - F.col("hi"), F.lit(0))
    rows = partitions(vocabulary, min_length, limit).select(
        "key", "word", "n", F.col("word").substr(F.col("lo") + 1, left - F.col("lo") - behind).alias("middle"),
        (left - F.col("lo") - behind).cast("long").alias("letters"), (left == F.col("size")).alias("short"), (F.col("hi") > F.col("size")).alias("last"))
    dealt = rows.repartition("key").sortWithinPartitions("key", "middle")
    return dealt.mapInArrow(blocks.by_key("key", _pairs), "a string, na long, b string, nb long")


def spelling_variants(vocabulary: DataFrame, ratio: int = 10, min_length: int = 7, limit: int = LIMIT) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    A word's form is its near word of largest n (ties: the smallest), if that n is ``ratio`` times its own or more; the root
    follows forms to the last, by doubling. Forms grow by ``ratio``, so chains are short and end. An empty vocabulary has no rows.
    """
    vocabulary = stage(vocabulary, "vocabulary")
    pairs = near_pairs(vocabulary, min_length, limit)
    both = stage(pairs.select("a", F.struct((-F.col("nb")).alias("m"), F.col("b").alias("w")).alias("best")).union(
        pairs.select("b", F.struct((-F.col("na")).alias("m"), F.col("a").alias("w")))).groupBy("a").agg(F.count("*").alias("n_near"), F.min("best").alias("best")), "near-words")
    best = vocabulary.join(both, F.col("word") == F.col("a"), "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(
        -F.col("best.m") >= ratio * F.col("n"), F.col("best")).alias("best"))
    best = stage(best.select("word", "n", "n_near", F.col("best.w").alias("form"), (-F.col("best.m")).alias("form_n")), "forms")
    roots = best.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        further = stage(roots.join(ahead, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_on")), "roots")
        going = not further.filter("_on").isEmpty()
        roots = further.drop("_on")
        if not going:
            break
    roots = roots.withColumnRenamed("word", "_w")
    return best.join(roots, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
