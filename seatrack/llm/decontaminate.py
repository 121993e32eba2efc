"""Benchmark decontamination: one Aho-Corasick automaton over windows of normalised item words, one scan per text.

The automaton's letters are words. Its arrays (sorted edges, failure and output links) lie in the shared folder and
are mapped into memory by workers, which walk all texts of a part in lockstep. Items are dealt to several
automata only beyond ``limit`` windows, so neither the tasks that build nor those that scan grow with the benchmark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatrack.llm import tokens
from seatrack.llm.ngrams import mapped, write_array
from seatrack.llm.store import shared_path

WINDOW = 10
LIMIT = 500_000
_LANE = 512
_CHUNK = 1 << 23
#: Bytes of words after A-Z are lowered: digits, letters and everything beyond ASCII.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Arrays of an automaton and their types.
_ARRAYS = {"vocabulary": "<u8", "edges": "<i8", "fail": "<i4", "output": "<i4", "depth": "u1", "root": "<i4",
           "node": "<i4", "item": "<i4", "item_end": "<i8", "item_bytes": "u1"}


def words(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start byte and end byte of every word, and the word offsets of the rows."""
    low = tokens.LOWER[data]
    starts, ends, rows = tokens.find_runs(off, _SOLID[low])
    return tokens.hash_spans(low, starts, ends), starts, ends, rows


@dataclass
class Automaton:
    """Nodes are numbered level by level, so the edge at place ``i`` of the sorted edges leads to node ``i + 1``."""

    vocabulary: np.ndarray  # sorted word hashes; the word at place i has number i + 1, others have 0
    edges: np.ndarray  # node * (number of words + 1) + word
    fail: np.ndarray
    output: np.ndarray  # the node itself, or the next on its failure path, that ends a window; else 0
    depth: np.ndarray
    root: np.ndarray  # node after a word from the root
    node: np.ndarray  # sorted; ends a window of the item at the same place
    item: np.ndarray
    item_end: np.ndarray
    item_bytes: np.ndarray

    def names(self, items: np.ndarray) -> list[str]:
        return [self.item_bytes[self.item_end[i]:self.item_end[i + 1]].tobytes().decode() for i in items]

    def next(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Node after each word; ``state`` and ``word`` are not 0."""
        out, open_ = self.root[word], np.arange(len(state))
        while len(open_):
            key = state.astype(np.int64) * (len(self.vocabulary) + 1) + word
            at = np.searchsorted(self.edges, key)
            hit = self.edges[np.minimum(at, len(self.edges) - 1)] == key
            out[open_[hit]] = at[hit] + 1
            state = self.fail[state]
            rest = ~hit & (state != 0)
            open_, state, word = open_[rest], state[rest], word[rest]
        return out

    def matches(self, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last word and node of every window that occurs; rows are walked as one stream of words parted by a word 0."""
        at = np.searchsorted(self.vocabulary, h)
        number = np.where(self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == h, at + 1, 0).astype(np.int32)
        place = np.arange(len(h)) + np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        lanes = -(-(len(h) + len(rows) - 1) // _LANE)
        stream = np.zeros(WINDOW - 1 + lanes * _LANE, np.int32)
        stream[WINDOW - 1 + place] = number
        # Each lane starts a window early, so that it knows the windows that began in the lane before.
        steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(stream, (_LANE + WINDOW - 1, lanes), (4, 4 * _LANE)))
        state, found = np.zeros(lanes, np.int32), []
        for t, word in enumerate(steps):
            new = self.root[word]
            deep = np.flatnonzero((state != 0) & (word != 0))
            if len(deep):
                new[deep] = self.next(state[deep], word[deep])
            state = new
            if t >= WINDOW - 1:
                node = self.output[state]
                some = np.flatnonzero(node)
                if len(some):
                    found.append((some * _LANE + t - WINDOW + 1, node[some]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        position, node = (np.concatenate(x) for x in zip(*found, strict=True))
        every = []
        while len(node):
            every.append((position, node))
            node = self.output[self.fail[node]]
            position, node = position[node != 0], node[node != 0]
        position, node = (np.concatenate(x) for x in zip(*every, strict=True))
        return np.searchsorted(place, position), node


def build(windows: np.ndarray, sizes: np.ndarray, items: list[str]) -> dict[str, np.ndarray]:
    """The automaton of windows of word hashes (one per row, ``sizes`` of them used) that belong to items."""
    used = np.arange(WINDOW) < sizes[:, None]
    vocabulary = np.unique(windows[used])
    number = np.where(used, np.searchsorted(vocabulary, windows) + 1, 0)
    width, now, levels = len(vocabulary) + 1, np.zeros(len(windows), np.int64), [np.zeros(0, np.int64)]
    first = [0, 1]  # first node of each level
    for d in range(WINDOW):
        going = np.flatnonzero(used[:, d])
        keys, back = np.unique(now[going] * width + number[going, d], return_inverse=True)
        now[going] = first[-1] + back
        levels.append(keys)
        first.append(first[-1] + len(keys))
    n = first[-1]
    a = Automaton(vocabulary, np.concatenate(levels), np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.uint8),
                  np.zeros(width, np.int32), *[np.zeros(0, np.int64)] * 4)
    a.root[levels[1]] = first[1] + np.arange(len(levels[1]))
    a.output[now] = now
    for d, keys in enumerate(levels[1:], 1):
        own = np.arange(first[d], first[d + 1])
        a.depth[own] = d
        if d > 1:
            up, word = a.fail[keys // width], (keys % width).astype(np.int32)
            a.fail[own] = a.root[word]
            deep = np.flatnonzero(up)
            a.fail[own[deep]] = a.next(up[deep], word[deep])
        a.output[own] = np.where(a.output[own] != 0, a.output[own], a.output[a.fail[own]])
    names, place = np.unique(np.array(items, object).astype(str), return_inverse=True) if items else (np.zeros(0, str), np.zeros(0, np.int64))
    pairs = np.unique(np.column_stack([now, place]), axis=0)
    raw = [x.encode() for x in names.tolist()]
    a.node, a.item = pairs[:, 0], pairs[:, 1]
    a.item_end = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    a.item_bytes = np.frombuffer(b"".join(raw), np.uint8)
    return {k: np.asarray(getattr(a, k)).astype(kind) for k, kind in _ARRAYS.items()}


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the items; an item of fewer words is one window."""
    for b in batches:
        for i, _, off, data in tokens.chunks(b.column("_text")):
            h, _, _, rows = words(off, data)
            n = np.diff(rows)
            count = np.where(n >= WINDOW, n - WINDOW + 1, (n > 0).astype(np.int64))
            row = np.repeat(np.arange(len(n)), count)
            start = rows[row] + np.arange(len(row)) - (count.cumsum() - count)[row]
            size = np.minimum(n[row], WINDOW)
            ends = np.concatenate([[0], size.cumsum()])
            at = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("_item").take(pa.array(row + i)), lists], ["_item", "_words"])


def _write(folder: str):
    def finish(lists: list[pa.Array], items: list[str]) -> pa.RecordBatch:
        sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
        windows = np.zeros((len(sizes), WINDOW), np.uint64)
        windows[np.arange(WINDOW) < sizes[:, None]] = np.concatenate([x.flatten().to_numpy() for x in lists]).view(np.uint64)
        files = [write_array(f"{folder}/{k}", x) for k, x in build(windows, sizes, items).items()]
        return pa.RecordBatch.from_arrays([pa.array([files], pa.list_(pa.string()))], ["files"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists, items = None, [], []
        for b in batches:
            part = b.column("_part").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else [0]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if part[i] != now and lists:
                    yield finish(lists, items)
                    lists, items = [], []
                now = part[i]
                lists.append(b.column("_words").slice(i, j - i))
                items += b.column("_item").slice(i, j - i).to_pylist()
        if lists:
            yield finish(lists, items)

    return run


def automata(items: DataFrame, key: str = "item_id", text: str = "text", limit: int = LIMIT) -> list[list[str]]:
    """File names of the automata of all items, one for each ``limit`` windows.

    Keys are told apart as text, a null key is the empty one. Items without words (null, empty) have no
    windows; repeated items count once. The driver gets file names only, ten for each ``limit`` windows.
    """
    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_item"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    windows = rows.mapInArrow(_windows, "_item string, _words array<long>").distinct()
    parts = max(1, -(-windows.count() // limit))
    dealt = windows.withColumn("_part", F.pmod(F.xxhash64("_item", "_words"), F.lit(parts)).cast("int"))
    written = (dealt.repartition(parts, "_part").sortWithinPartitions("_part")
               .mapInArrow(_write(shared_path(items.sparkSession, "automaton")), "files array<string>"))
    return [r["files"] for r in written.collect()]


def _opened(files: list[str]) -> Automaton:
    return Automaton(*[mapped(f, kind) for f, kind in zip(files, _ARRAYS.values(), strict=True)])


def _scan(models: list[list[str]], texts: pa.Array, named: bool):
    """Row range, word starts, ends and offsets, which words are hit, and the items of every row, part by part."""
    for i, j, off, data in tokens.chunks(texts, _CHUNK):
        h, starts, ends, rows = words(off, data)
        edge, items = np.zeros(len(h) + 1, np.int64), [set() for _ in range(j - i)] if named else []
        for files in models if len(h) else ():
            a = _opened(files)
            last, node = a.matches(h, rows)
            np.add.at(edge, last - a.depth[node] + 1, 1)
            np.add.at(edge, last + 1, -1)
            if named and len(last):
                for row, n in np.unique(np.column_stack([np.searchsorted(rows, last, "right") - 1, node]), axis=0):
                    items[row].update(a.names(a.item[slice(*np.searchsorted(a.node, [n, n + 1]))]))
        yield i, j, off, data, starts, ends, rows, edge[:-1].cumsum() > 0, items


def _rows(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows, rows.schema["_key"].dataType.simpleString()


def contamination(docs: DataFrame, models: list[list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it lies in any occurrence of a window; ``n_items`` is the number of item keys with an
    occurring window and ``items_sha256`` the digest of these keys, sorted as strings and joined by commas. A null,
    empty or wordless text has no words; rows alike are rows of their own; null keys stay. Words compare by 64-bit hashes.
    """
    rows, kind = _rows(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, _, _, _, _, offsets, hit, items in _scan(models, b.column("_text"), True):
                n_hit = np.diff(np.concatenate([[0], hit.cumsum()])[offsets])
                digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
                columns = [np.diff(offsets), n_hit, np.array([len(x) for x in items], np.int64), digest, n_hit > 0]
                yield pa.RecordBatch.from_arrays([b.column("_key")[i:j], *map(pa.array, columns)], _NAMES)

    return rows.mapInArrow(run, f"_key {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").withColumnRenamed("_key", key)


_NAMES = ["_key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def contaminated_spans(docs: DataFrame, models: list[list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per unbroken run of hit words: key, ``first_word, n_words``, and where it stands in the text.

    ``start`` and ``end`` count code points of the original text from 0, ``passage`` is what stands there.
    """
    rows, kind = _rows(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, off, data, starts, ends, offsets, hit, _ in _scan(models, b.column("_text"), False):
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                turn = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
                first = np.flatnonzero(hit & (turn | ~np.concatenate([[False], hit[:-1]])[:len(hit)]))
                last = np.flatnonzero(hit & np.concatenate([turn[1:] | ~hit[1:], [True]])[:len(hit)])
                points = np.concatenate([[0], ((data & 0xC0) != 0x80).cumsum()])
                low, high, own = starts[first], ends[last], row[first]
                columns = [first - offsets[own], last - first + 1, points[low] - points[off[own]], points[high] - points[off[own]],
                           [data[a:z].tobytes().decode() for a, z in zip(low, high)]]
                yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(own + i)), *map(pa.array, columns[:4]), pa.array(columns[4], pa.string())],
                                                 ["_key", "first_word", "n_words", "start", "end", "passage"])

    return rows.mapInArrow(run, f"_key {kind}, first_word long, n_words long, start long, end long, passage string").withColumnRenamed("_key", key)


def clean_documents(docs: DataFrame, models: list[list[str]], text: str = "text", share: float = 0.0) -> DataFrame:
    """The rows of ``docs`` of whose words at most ``share`` are hit; columns stay as they are."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, _, _, _, _, offsets, hit, _ in _scan(models, b.column(text), False):
                n_hit = np.diff(np.concatenate([[0], hit.cumsum()])[offsets])
                yield b.slice(i, j - i).filter(pa.array(n_hit <= share * np.diff(offsets)))

    return docs.select(*names).mapInArrow(run, docs.schema)
