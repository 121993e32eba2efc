"""Passages that recur in other documents: MinHash of lines and of paragraphs cut by content, exact spans of small ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatrack.llm import blocks, tokens
from seatrack.llm.collocations import sorted_arrays
from seatrack.llm.components import components
from seatrack.llm.ngrams import Shards, _pack, _unpack, mapped, write_array
from seatrack.llm.store import release, shared_path, stage

REACH = 4
WIDE = 24
WIDTH = 5
BANDS = 3
SIMILAR = 0.8
_COLUMNS, _PAIRS = 1 << 14, 1 << 20
#: Characters of all texts for one shard of keys, and keys of a task that are combined at once.
SHARD_CHARS, _FLUSH = 1 << 25, 1 << 22
#: Longs of a sketch, and shingles from which a paragraph has all of them.
SKETCH, _MANY = 4, 48
#: Sketches of a band that are compared in one block.
SKETCHES = 4096
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = tokens.mix(np.arange(101, 101 + BANDS, dtype=np.uint64))


def levels(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Word hashes, word offsets of the rows, and first word and end of every small paragraph, wide paragraph and line.

    A paragraph ends with its line, and inside a line before a word whose hash is smaller than those of the ``REACH``
    (``WIDE``: 49 words on average) words on either side, or, small ones, in a run of one word after every eighth. Cuts depend on nearby
    words of the line alone, so a passage is cut alike wherever it stands, but for its first and last few words.
    """
    low = tokens.LOWER[data]
    starts, ends, rows = tokens.find_words(off, low)
    h = tokens.hash_spans(low, starts, ends)
    lines = np.unique(np.concatenate([off, np.flatnonzero(data == 10) + 1]))
    first = np.unique(np.searchsorted(starts, lines))
    first = first[first < len(h)]
    cut, wide = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if len(h):
        v = tokens.mix(h + np.uint64(1))
        inner = np.zeros(len(h), bool)
        inner[REACH:len(h) - REACH] = True
        lowest = inner.copy()
        for k in range(1, REACH + 1):
            lowest[k:] &= v[k:] < v[:-k]
            lowest[:-k] &= v[:-k] < v[k:]
        line = np.zeros(len(h), np.int64)
        line[first] = 1
        line = line.cumsum()
        at = np.flatnonzero(lowest)
        at = at[(line[at] == line[at - REACH]) & (line[at] == line[at + REACH])]
        cut[at] = True
        at = at[(at >= WIDE) & (at < len(h) - WIDE)]
        at = at[(line[at] == line[at - WIDE]) & (line[at] == line[at + WIDE])]
        for k in range(REACH + 1, WIDE + 1):
            at = at[(v[at] < v[at - k]) & (v[at] < v[at + k])]
        wide[at] = True
        # A run of one word has no smallest hash: it is cut after every eighth.
        turn = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        place = np.arange(len(h)) - np.repeat(turn, np.diff(np.append(turn, len(h))))
        cut |= (place > 0) & (place % 8 == 0)
        cut[first] = wide[first] = True
    begins = [np.flatnonzero(cut), np.flatnonzero(wide), first]
    return h, rows, [(x, np.append(x[1:], len(h))[:len(x)]) for x in begins]


def _whole(h: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First words, ends, and which of them are no paragraph of a finer level, for every level."""
    ends = np.full(len(h), -1)
    for begin, end in parts:
        yield begin, end, ends[begin] != end
        ends[begin] = end


def paragraphs(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, word offsets of the rows, and first word, end and row of every small paragraph."""
    h, rows, parts = levels(off, data)
    begin, end = parts[0]
    return h, rows, begin, end, np.searchsorted(rows, begin, "right") - 1


def _shingles(h: np.ndarray) -> np.ndarray:
    """Hash of the shingle at every word; the largest value where there is none."""
    out = np.full(len(h), _TOP)
    if len(h) >= WIDTH:
        n = len(h) - WIDTH + 1
        out[:n] = np.minimum(tokens.hash_runs(h, np.arange(n), np.arange(WIDTH, len(h) + 1)), _TOP - np.uint64(1))
    return out


def _column(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _repeats(near: Shards, again: Shards, min_words: int):
    """Places of the paragraphs that recur: small ones in a class or held by two documents, others in a class of similar ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, off, data in tokens.chunks(b.column("_text")):
                h, rows, parts = levels(off, data)
                for level, (begin, end, new) in enumerate(_whole(h, parts)):
                    some = new & (end - begin >= min_words) if level else new
                    begin, end = begin[some], end[some]
                    digest, back = np.unique(tokens.hash_runs(h, begin, end), return_inverse=True)
                    shard, place, there = near.find(digest)
                    root = digest.copy()
                    for k in np.unique(shard[there]):
                        at = there & (shard == k)
                        root[at] = mapped(near.files[k][1], "<u8")[place[at]]
                    held = there if level else there | again.find(digest)[2]
                    some = np.flatnonzero(held[back])
                    if not len(some):
                        continue
                    begin, end = begin[some], end[some]
                    row = np.searchsorted(rows, begin, "right") - 1
                    take = pa.array(row + i)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("_key").take(take), b.column("_text_hash").take(take), _column(begin - rows[row]), _column(end - begin),
                         _column(root[back[some]]), pa.array(np.full(len(some), level > 0))],
                        ["_key", "_text_hash", "start", "words", "class", "wide"])

    return run


def _long(h: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Paragraphs that can be similar without being equal: four shingles at least, as 4 of 5 is the least share."""
    for begin, end, new in _whole(h, parts):
        some = new & (end - begin >= WIDTH + 3)
        if some.any():
            yield begin[some], end[some]


def _bands(h: np.ndarray, s: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Bands of all paragraphs with their digests, first shingles and numbers of shingles, each pair once and in order of the bands."""
    found = [[np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64)]
    values = [tokens.mix(s ^ seed) for seed in _SEEDS]
    for level, part in enumerate(parts):
        # Every level has bands of its own, as a line would meet the paragraphs in it; pairs across levels are not sought.
        begin, end = next(_long(h, [part]), (None, None))
        if begin is None:
            continue
        # The last shingles would leave the paragraph.
        starts, digest = np.column_stack([begin, end - WIDTH + 1]).ravel(), tokens.hash_runs(h, begin, end)
        for v, seed in zip(values, _SEEDS, strict=True):
            band = tokens.mix(np.minimum.reduceat(v, starts)[::2] + seed + np.uint64(level))
            for x, more in zip(found, (band, digest, begin, end - begin - WIDTH + 1), strict=True):
                x.append(more)
    found = [np.concatenate(x) for x in found]
    order = np.lexsort((found[1], found[0]))
    band, digest, begin, n = (x[order] for x in found)
    new = np.ones(len(band), bool)
    new[1:] = (band[1:] != band[:-1]) | (digest[1:] != digest[:-1])
    return band[new], digest[new], begin[new], n[new]


def _one_each(keys: np.ndarray, values: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a value of each, and whether it has two values."""
    order = np.argsort(keys, kind="stable")
    keys, values, twice = keys[order], values[order], twice[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys, values, twice
    low = np.minimum.reduceat(values, first)
    return keys[first], low, np.logical_or.reduceat(twice, first) | (low != np.maximum.reduceat(values, first))


def _held_twice(shards: int):
    """Packed tables of a task: digests of small paragraphs with a document each (kind 0), bands with a digest each (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[], []]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(held):
                if not parts:
                    continue
                keys, values, twice = _one_each(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                parts.clear()
                ends = np.searchsorted((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1).astype(np.uint64))
                for k in range(shards):
                    x, y = ends[k], ends[k + 1]
                    if x < y:
                        rise = keys[x:y].copy()
                        rise[1:] -= keys[x:y - 1]
                        data = [_pack(rise), _pack(np.where(twice[x:y], np.uint64(0), values[x:y])), _pack(twice[x:y].astype("u1"))]
                        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([k], pa.int32()), pa.array([data], pa.list_(pa.binary()))], ["kind", "shard", "data"])

        for b in batches:
            document = b.column("_document").to_numpy().view(np.uint64)
            for i, _, off, data in tokens.chunks(b.column("_text")):
                h, rows, parts = levels(off, data)
                begin, end = parts[0]
                own = document[i + np.searchsorted(rows, begin, "right") - 1] if len(begin) else np.zeros(0, np.uint64)
                held[0].append((tokens.hash_runs(h, begin, end), own, np.zeros(len(begin), bool)))
                band, digest, _, _ = _bands(h, _shingles(h), parts)
                held[1].append((band, digest, np.zeros(len(band), bool)))
                if sum(len(x[0]) for kind in held for x in kind) > _FLUSH:
                    yield from flush()
        yield from flush()

    return run


def _write_twice(folder: str):
    """Sorted arrays of the keys that have two values over all tasks."""
    def finish(kind: int, parts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        keys, _, twice = _one_each(*(np.concatenate(x) for x in zip(*[
            (np.cumsum(_unpack(k, "<u8"), dtype=np.uint64), _unpack(v, "<u8"), _unpack(t, "u1").astype(bool)) for k, v, t in parts], strict=True)))
        keys = keys[twice]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([str(int(keys[0]))]), pa.array([len(keys)]), pa.array([[write_array(f"{folder}/kind{kind}", keys)]], pa.list_(pa.string()))],
                                             ["kind", "first", "n", "files"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for kind, shard, data in zip(b.column("kind").to_pylist(), b.column("shard").to_pylist(), b.column("data"), strict=True):
                if (kind, shard) != now and parts:
                    yield from finish(now[0], parts)
                    parts = []
                now = kind, shard
                parts.append(data.as_py())
        if parts:
            yield from finish(now[0], parts)

    return run


def held_twice(rows: DataFrame) -> tuple[Shards, Shards]:
    """Digests of small paragraphs that two documents hold, and bands that two paragraphs hold, as mapped sorted arrays.

    Tasks keep one entry a key, so a very frequent paragraph or band is sent once by each; one in ``SHARD_CHARS`` characters makes a shard.
    """
    shards = max(1, -(-(rows.agg(F.sum(F.length("_text"))).first()[0] or 0) // SHARD_CHARS))
    parts = rows.select(F.xxhash64("_key", "_text_hash").alias("_document"), "_text").mapInArrow(_held_twice(shards), "kind int, shard int, data array<binary>")
    written = stage(parts.repartition(2 * shards, "kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(
        _write_twice(shared_path(rows.sparkSession, "held-twice")), "kind int, first string, n long, files array<string>"), "held-twice")
    listed = sorted(written.collect(), key=lambda r: int(r["first"]))
    found = [[r for r in listed if r["kind"] == kind] for kind in (0, 1)]
    return tuple(Shards([int(r["first"]) for r in x], [r["n"] for r in x], [r["files"] for r in x]) for x in found)


def _sketches(s: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of 64 * ``SKETCH`` bits the ``n`` shingles from each place on set.

    A bit in which two paragraphs differ comes of a shingle that one of them alone has, so two sets differ in no fewer shingles than their sketches in bits.
    """
    ends = n.cumsum()
    bits = tokens.mix(s[np.repeat(begin - (ends - n), n) + np.arange(n.sum())] + np.uint64(7))
    word, bit = (bits >> np.uint64(6)) % np.uint64(SKETCH), np.uint64(1) << (bits & np.uint64(63))
    return np.column_stack([np.bitwise_or.reduceat(np.where(word == k, bit, np.uint64(0)), ends - n) for k in range(SKETCH)])


def _meeting(shared: Shards):
    """Bands that two paragraphs hold, with the digests that hold them, their numbers of shingles and sketches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, off, data in tokens.chunks(b.column("_text")):
                h, _, parts = levels(off, data)
                s = _shingles(h)
                band, digest, begin, n = _bands(h, s, parts)
                there = shared.find(band)[2]
                band, digest = band[there], digest[there]
                if not len(band):
                    continue
                _, some, back = np.unique(digest, return_index=True, return_inverse=True)
                begin, n = begin[there][some], n[there][some]
                sketch, short = _sketches(s, begin, n), n < _MANY
                sketch[short, 0] = np.bitwise_or.reduce(sketch[short], axis=1)
                size = np.where(short, 1, SKETCH)[back]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, size.cumsum()), pa.int32()), _column(sketch[back][np.arange(SKETCH) < size[:, None]]))
                yield pa.RecordBatch.from_arrays([_column(band), _column(digest), pa.array(n[back].astype(np.int32)), lists], ["band", "digest", "n", "sketch"])

    return run


def _candidates(rows: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each block the paragraphs that may be similar to another: their sets differ in a ninth of both sizes at most, and so do the sketches."""
    band, digest, n = (rows.column(c).to_numpy() for c in ("band", "digest", "n"))
    column = rows.column("sketch").combine_chunks()
    at, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    full, sketch = np.diff(at) > 1, np.zeros((len(n), SKETCH), np.uint64)
    sketch[full] = values[at[:-1][full][:, None] + np.arange(SKETCH)]
    folded = np.where(full, np.bitwise_or.reduce(sketch, axis=1), values[at[:-1]])
    least = np.where(full, np.bitwise_count(sketch).sum(1, dtype=np.int64), np.bitwise_count(folded))  # so many shingles it has at least
    keep, begin = np.zeros(len(n), bool), 0
    for end in ends:
        step = max(1, _PAIRS // (end - begin))
        for i in range(begin, end, step):
            j = min(i + step, end)
            room = n[i:j, None] + n[None, begin:end]
            a, b = np.nonzero((9 * np.bitwise_count(folded[i:j, None] ^ folded[None, begin:end]).astype(np.int32) <= room) & (digest[i:j, None] != digest[None, begin:end]))
            a, b = a + i, b + begin
            both = np.flatnonzero(full[a] & full[b])
            far = both[9 * np.bitwise_count(sketch[a[both]] ^ sketch[b[both]]).sum(1, dtype=np.int32) > n[a[both]] + n[b[both]]]
            near = (4 * least[a] <= 5 * n[b]) & (4 * least[b] <= 5 * n[a])
            near[far] = False
            keep[a[near]] = keep[b[near]] = True
        begin = end
    yield pa.RecordBatch.from_arrays([pa.array(band[keep]), pa.array(digest[keep])], ["band", "digest"])


def _contents(wanted: Shards):
    """Shingles of the wanted paragraphs; they are looked up in mapped arrays, so the others aren't sent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, off, data in tokens.chunks(b.column("_text")):
                h, _, parts = levels(off, data)
                s = _shingles(h)
                for begin, end in _long(h, parts):
                    digest, some = np.unique(tokens.hash_runs(h, begin, end), return_index=True)
                    there = wanted.find(digest)[2]
                    digest, some = digest[there], some[there]
                    if not len(digest):
                        continue
                    begin, n = begin[some], (end - begin)[some] - WIDTH + 1
                    ends = n.cumsum()
                    at = np.repeat(begin - (ends - n), n) + np.arange(n.sum())
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), _column(s[at]))
                    yield pa.RecordBatch.from_arrays([_column(digest), lists], ["digest", "shingles"])

    return run


def _similar(rows: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links that hold together the paragraphs of a block with a Jaccard similarity of ``SIMILAR`` or more."""
    digest, column = rows.column("digest").to_numpy(), rows.column("shingles").combine_chunks()
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    label, begin = np.arange(len(digest)), 0
    for end in ends:
        _, some = np.unique(digest[begin:end], return_index=True)
        if len(some) > 1:
            sets = [np.unique(values[at[begin + i]:at[begin + i + 1]]) for i in some]
            _, back = np.unique(np.concatenate(sets), return_inverse=True)
            size = np.array([len(x) for x in sets])
            owner, common = np.repeat(np.arange(len(sets)), size), np.zeros((len(sets), len(sets)), np.float32)
            order = np.argsort(back, kind="stable")
            owner, back = owner[order], back[order]
            for low in range(0, int(back[-1]) + 1, _COLUMNS):  # lines can be long
                i, j = np.searchsorted(back, [low, low + _COLUMNS])
                table = np.zeros((len(sets), min(_COLUMNS, int(back[-1]) + 1 - low)), np.float32)
                table[owner[i:j], back[i:j] - low] = 1
                common += table @ table.T
            a, b = np.nonzero(np.triu(common >= SIMILAR * (size[:, None] + size[None, :] - common) - 1e-4, 1))
            label = blocks.unite(label, some[a] + begin, some[b] + begin)
        begin = end
    moved = np.flatnonzero(label != np.arange(len(label)))
    yield pa.RecordBatch.from_arrays([pa.array(digest[moved]), pa.array(digest[label[moved]])], ["a", "b"])


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("_key"), body.alias("_text"), F.xxhash64(body).alias("_text_hash"))


def similar_paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(``_node``, ``_root``) over paragraph digests: classes of different paragraphs that are similar.

    Three bands of one minimum over five-word shingles meet 99 % of the pairs at similarity 0.8 and more
    above. Bands held by one paragraph alone end there; of the others go those whose sketches are too far from all they meet, and only for the rest
    shingles are fetched and compared.
    """
    rows = _rows(docs, docs.columns[0], text)
    return _similar_classes(rows, held_twice(rows)[1])


def _similar_classes(rows: DataFrame, shared: Shards) -> DataFrame:
    rows = rows.select("_text")
    met = stage(rows.mapInArrow(_meeting(shared), "band long, digest long, n int, sketch array<long>").distinct(), "met")
    meeting = stage(blocks.in_blocks(met, "band", "digest", _candidates, "band long, digest long", limit=SKETCHES).distinct(), "bands")
    release(met)
    wanted = sorted_arrays(meeting.select("digest").distinct(), ["digest"], "band-digests")
    contents = stage(rows.mapInArrow(_contents(wanted), "digest long, shingles array<long>").dropDuplicates(["digest"]), "band-contents")
    compared = meeting.join(contents.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d")).select("band", "digest", "shingles")
    links = stage(blocks.in_blocks(compared, "band", "digest", _similar, "a long, b long", limit=512), "similar")
    release(meeting, contents)
    classes = components(links, "a", "b", "paragraphs")
    release(links)
    return classes


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 18) -> DataFrame:
    """One row per passage to remove: key, ``text_hash, start_word, n_words, keep_<key>, component_id``.

    Lines and wide paragraphs of ``min_words`` words and more that are similar to those of a document with a smaller key are passages.
    So is a run of small paragraphs of ``min_words`` words and more that such a document holds as well. What else holds
    parts of it doesn't matter: spans that are just long enough are judged one by one, each kept by its smallest holder, and
    those that overlap are put together; the holder of most of them is named. As the first and last words of a passage
    share a paragraph with their surroundings, one of 50 words is met with its inner 18 at least as a rule. Rows
    alike in key and text are one document, different texts under one key are different ones; null keys come last; null, empty and wordless texts have no passages.
    """
    rows = _rows(docs, key, text)
    kind = rows.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, _text_hash long, start long, words long, class long, wide boolean"
    again, shared = held_twice(rows)
    near = sorted_arrays(_similar_classes(rows, shared), ["_node", "_root"], "similar")
    found = stage(rows.mapInArrow(_repeats(near, again, int(min_words)), schema), "repeats")
    whole = found.filter("wide").select("_key", "_text_hash", "start", (F.col("start") + F.col("words")).alias("stop"),
                                        F.xxhash64(F.array("class")).alias("code"), F.col("class").alias("component"))
    spans = stage(_spans(found.filter("NOT wide").drop("wide"), min_words).union(whole), "spans")
    release(found)
    document = F.struct(F.col("_key").isNull().alias("n"), F.col("_key").alias("k"), F.col("_text_hash").alias("h"))
    keepers = stage(spans.groupBy("code").agg(F.min(document).alias("keep"), F.max(document).alias("last")).filter("NOT keep <=> last")
                    .select(F.col("code").alias("c"), "keep"), "keepers")
    # Written before it is dealt by document: the join is free to split the rows of a frequent span, and what it has shuffled goes before more is.
    extra = stage(spans.join(keepers, (F.col("code") == F.col("c")) & ~document.eqNullSafe(F.col("keep"))).select("_key", "_text_hash", "start", "stop", "component", "keep"), "extra")
    release(spans, keepers)
    extra = extra.repartition("_key", "_text_hash")
    order = Window.partitionBy("_key", "_text_hash").orderBy("start", "stop", "keep")  # spans of one place in the same order on every run
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = (F.col("start") < reached) | ((F.col("start") == reached) & F.lag("keep").over(order).eqNullSafe(F.col("keep")))
    runs = extra.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    shares = runs.groupBy("_key", "_text_hash", "_run", "keep").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("component").alias("component"), F.sum(F.col("start") - F.col("stop")).alias("less"))
    return (shares.groupBy("_key", "_text_hash", "_run")
            .agg(F.min("start").alias("start_word"), (F.max("stop") - F.min("start")).alias("n_words"), F.min("component").alias("component_id"),
                 F.min(F.struct("less", "keep"))["keep"]["k"].alias("keep"))
            .select(F.col("_key").alias(key), F.col("_text_hash").alias("text_hash"), "start_word", "n_words", F.col("keep").alias(f"keep_{key}"), "component_id"))


def _spans(found: DataFrame, min_words: int) -> DataFrame:
    """(``_key``, ``_text_hash``, start, stop, code, component): the shortest unbroken spans of ``min_words`` words and more from and up to
    every repeated paragraph; ``code`` stands for their classes.

    Any unbroken run of ``min_words`` words is a union of such spans, whichever other documents hold parts of it. So a run that
    another document holds is found from a minimum per span alone, without pairs of documents.
    """
    rows = found.repartition("_key", "_text_hash").dropDuplicates(["_key", "_text_hash", "start"]).withColumn("stop", F.col("start") + F.col("words"))
    document = Window.partitionBy("_key", "_text_hash")
    parts = []
    for frame in (document.orderBy("start").rangeBetween(0, min_words - 1), document.orderBy("stop").rangeBetween(1 - min_words, 0)):
        wide = rows.select("_key", "_text_hash", F.min("start").over(frame).alias("start"), F.max("stop").over(frame).alias("stop"),
                           F.sum("words").over(frame).alias("n"), F.xxhash64(F.collect_list("class").over(frame)).alias("code"), F.min("class").over(frame).alias("component"))
        parts.append(wide.filter((F.col("n") >= min_words) & (F.col("n") == F.col("stop") - F.col("start"))).drop("n"))
    return parts[0].union(parts[1]).dropDuplicates(["_key", "_text_hash", "start", "stop"])


def without_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 18) -> DataFrame:
    """``docs`` without repeated passages; documents of which no word is left go. Other rows stay as they are."""
    cuts = repeated_passages(docs, key, text, min_words).groupBy(key, "text_hash").agg(
        F.collect_list(F.struct("start_word", "n_words")).alias("_llm_cuts")).select(F.col(key).alias("_llm_k"), F.col("text_hash").alias("_llm_h"), "_llm_cuts")

    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                spans = ([(s["start_word"], s["n_words"]) for s in x] for x in part.column("_llm_cuts").to_pylist())
                left = [remove_words(t.as_py(), x) for t, x in zip(part.column(text), spans, strict=True)]
                columns = [pa.array(left, pa.string()) if c == text else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([x != "" for x in left]))

    marked = docs.join(cuts, F.col(key).eqNullSafe(F.col("_llm_k")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_llm_h")), "left")
    whole = marked.filter("_llm_cuts IS NULL").select(*docs.columns)
    less = marked.filter("_llm_cuts IS NOT NULL").select(*names, "_llm_cuts").mapInArrow(cut, docs.schema)
    return whole.union(less)


def remove_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (first word, number) and the gap behind each; empty if no word is left."""
    data = text.encode()
    starts, _, _ = tokens.find_words(np.array([0, len(data)]), np.frombuffer(data, np.uint8))
    keep = np.ones(len(data), bool)
    edges = np.append(starts, len(data))
    for first, n in spans:
        keep[edges[first]:edges[first + n]] = False
    return np.frombuffer(data, np.uint8)[keep].tobytes().decode() if keep[starts].any() else ""
