"""SimHash fingerprints, and near duplicates by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatrack.llm import blocks, tokens
from seatrack.llm.components import components
from seatrack.llm.store import stage

_STEP = 1 << 16
_PAIRS = 1 << 18


def _shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the shingles of ``width`` words, in parts; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= width:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    for i in range(0, len(starts), _STEP):
        yield np.array([xxh64_intdigest(line[s:e], 42) for s, e in zip(starts[i:i + _STEP].tolist(), ends[i:i + _STEP].tolist(), strict=True)], np.uint64)


def _majority(parts: list[np.ndarray]) -> int:
    counts = sum((np.unpackbits(p.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64) for p in parts), np.zeros(64, np.int64))
    return int.from_bytes(np.packbits(2 * counts > sum(map(len, parts))).tobytes(), "big", signed=True)


def fingerprint(text: bytes, width: int = 4) -> int:
    """64 bits, each set if over half of the shingles' hashes have it; 0 without words."""
    return _majority(list(_shingle_hashes(text, width)))


def fingerprints(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(``_key``, ``_fp``) of every row."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), width) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(fps, pa.int64())], ["_key", "_fp"])

    return rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, _fp long")


def _sum3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _over(planes: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the vertical counters exceed the radius; the last plane stands for all higher counts."""
    more, same = planes[-1].copy(), ~planes[-1]
    for k in range(len(planes) - 2, -1, -1):
        if radius >> k & 1:
            same &= planes[k]
        else:
            more |= same & planes[k]
            same &= ~planes[k]
    return more


def close_pairs(fps: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of items of a block that differ in at most ``radius`` bits, in parts.

    Bit plane b holds bit b of 64 items a word. One item against one word of items costs an xor per
    plane; distances of all 64 are kept in vertical counters fed by carry-save adders, eight planes at a
    time, and a word is given up once all its items exceed the radius.
    """
    n = len(fps)
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8)).reshape(n, 64)
    words = -(-n // 64)
    packed = np.zeros((64, words * 8), np.uint8)
    packed[:, :-(-n // 8)] = np.packbits(bits.T, axis=1, bitorder="little")
    planes = packed.view("<u8").astype(np.uint64)
    wide = (np.uint64(0) - bits.T.astype(np.uint64))
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    here = np.arange(n)
    some = here + 1 < end
    item, first, last = here[some], (here[some] + 1) // 64, (end[some] - 1) // 64
    count = last - first + 1
    levels = max(3, radius.bit_length())
    total = count.cumsum()
    done = 0
    while done < len(item):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + _PAIRS, "right")))
        q = np.repeat(item[done:stop], count[done:stop])
        c = count[done:stop]
        w = np.repeat(first[done:stop], c) + np.arange(len(q)) - np.repeat(c.cumsum() - c, c)
        done = stop
        low = np.clip(q + 1 - w * 64, 0, 63).astype(np.uint64)
        high = np.clip(end[q] - w * 64, 1, 64)
        valid = (~np.uint64(0) << low) & (~np.uint64(0) >> (64 - high).astype(np.uint64))
        counters = [np.zeros(len(q), np.uint64) for _ in range(levels + 1)]
        for base in range(0, 64, 8):
            d = [planes[base + k][w] ^ wide[base + k][q] for k in range(8)]
            carry = d
            # Eight planes become four carries, two, one; what is left goes up as in a plain counter.
            for level in range(levels):
                up = []
                for x, y in zip(carry[::2], carry[1::2]):
                    counters[level], out = _sum3(counters[level], x, y)
                    up.append(out)
                if len(carry) % 2:
                    up.append(counters[level] & carry[-1])
                    counters[level] = counters[level] ^ carry[-1]
                carry = up
            for x in carry:
                counters[levels] = counters[levels] | x
            valid &= ~_over(counters, radius)
            alive = valid != 0
            if np.count_nonzero(alive) < 0.7 * len(alive):
                q, w, valid = q[alive], w[alive], valid[alive]
                counters = [x[alive] for x in counters]
            if not len(q):
                break
        hit = valid != 0
        if hit.any():
            spread = np.unpackbits(valid[hit].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            at, bit = np.nonzero(spread)
            yield q[hit][at], w[hit][at] * 64 + bit


def _links(radius: int):
    def compare(rows: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps = rows.column("_fp").to_numpy().astype(np.int64).view(np.uint64)
        label = np.arange(len(fps))
        for a, b in close_pairs(fps, ends, radius):
            label = blocks.unite(label, a, b)
        moved = np.flatnonzero(label != np.arange(len(fps)))
        yield pa.RecordBatch.from_arrays([pa.array(fps[moved].view(np.int64)), pa.array(fps[label[moved]].view(np.int64))], ["a", "b"])

    return compare


def band_masks(radius: int, extra: int = 2) -> list[int]:
    """Masks of ``extra`` out of radius + extra bit ranges: fingerprints within the radius agree under one at least."""
    cuts = np.linspace(0, 64, radius + extra + 1).astype(int)
    ranges = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(ranges, extra)]


def near_fingerprints(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(``_node``, ``_root``) over distinct ``_fp``: classes of fingerprints linked within the radius.

    Candidates agree in two of radius + 2 bit ranges (exact by the pigeonhole principle). Inside a bucket only links that
    hold its classes together leave the task, never all pairs.
    """
    keys = [F.xxhash64(F.col("_fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)), F.lit(i)) for i, m in enumerate(band_masks(radius))]
    rows = distinct.select(F.explode(F.array(*keys)).alias("_bucket"), "_fp")
    links = blocks.in_blocks(rows, "_bucket", "_fp", _links(radius), "a long, b long")
    return components(links, "a", "b", "simhash")


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row (key, fingerprint, component_id) per document; component_id is the smallest key reachable.

    A-Z are lowered. Fewer than ``width`` words make one shingle; null and wordless texts have fingerprint zero and link like any
    other. Equal fingerprints are one node, so copies cost nothing. A class whose keys are all null has a null id.
    """
    rows = stage(fingerprints(docs, key, text, width), "fingerprints")
    distinct = stage(rows.groupBy("_fp").agg(F.min("_key").alias("_least")), "distinct-fingerprints")
    near = near_fingerprints(distinct, radius)
    known = distinct.join(near, F.col("_fp") == F.col("_node"), "left").withColumn("_root", F.coalesce("_root", "_fp"))
    least = known.groupBy("_root").agg(F.min("_least").alias("component_id")).withColumnRenamed("_root", "_r")
    classes = stage(known.join(least, F.col("_root") == F.col("_r")).select(F.col("_fp").alias("_f"), "component_id"), "simhash-classes")
    return rows.join(classes, F.col("_fp") == F.col("_f")).select(
        F.col("_key").alias(key), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


SLOTS = 128
BANDS = 6
#: Pairs whose share of slots alike is so close to the limit are decided by their shingles: four standard errors.
MARGIN = 0.14
_SEEDS = tokens.mix(np.arange(301, 301 + 2 * BANDS, dtype=np.uint64))


def _profile(text: bytes, width: int) -> tuple[int, bytes, list[int]]:
    """Fingerprint, one-permutation MinHash of ``SLOTS`` 16-bit values (0: no shingle falls there), and band keys of two minima each."""
    parts = list(_shingle_hashes(text, width)) or [np.zeros(1, np.uint64)]
    h = np.unique(np.concatenate(parts))
    m = np.unique(tokens.mix(h))
    slot = (m >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    slots = np.zeros(SLOTS, "<u2")
    slots[slot[first]] = np.maximum(m[first] & np.uint64(0xFFFF), 1)
    low = np.array([tokens.mix(h ^ s).min() for s in _SEEDS])
    return _majority(parts), slots.tobytes(), tokens.combine(low[::2], low[1::2]).view(np.int64).tolist()


def _candidates(rows: pa.Table, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a block within the radius, with the share of slots alike; of pairs that meet in several bands, the first one."""
    fps = rows.column("_fp").to_numpy().astype(np.int64).view(np.uint64)
    band = rows.column("_band").to_numpy()
    slots = np.frombuffer(b"".join(rows.column("_slots").to_pylist()), "<u2").reshape(-1, SLOTS)
    bands = rows.column("_bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    place = (bands == band[:, None]).argmax(1)
    for a, b in close_pairs(fps, ends, radius):
        for i in range(0, len(a), 1 << 15):
            x, y = a[i:i + (1 << 15)], b[i:i + (1 << 15)]
            first = (bands[x] == bands[y]).argmax(1) == place[x]
            x, y = x[first], y[first]
            p, q = slots[x], slots[y]
            used = ((p > 0) | (q > 0)).sum(1)
            yield x, y, ((p == q) & (p > 0)).sum(1) / used


def _clear(radius: int, similar: float):
    """Links between pairs that are near beyond doubt, and (band, node) of those that only their shingles decide."""
    def compare(rows: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, band = rows.column("_node").to_numpy(), rows.column("_band").to_numpy()
        label, doubt = np.arange(len(node)), np.zeros(len(node), bool)
        for a, b, alike in _candidates(rows, ends, radius):
            label = blocks.unite(label, a[alike >= similar + MARGIN], b[alike >= similar + MARGIN])
            open_ = (alike >= similar - MARGIN) & (alike < similar + MARGIN) & (label[a] != label[b])
            doubt[a[open_]] = doubt[b[open_]] = True
        moved, ask = np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(doubt)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([node[moved], band[ask]])), pa.array(np.concatenate([node[label[moved]], node[ask]])),
             pa.array(np.repeat([False, True], [len(moved), len(ask)]))], ["a", "b", "ask"])

    return compare


def _exact(radius: int, similar: float):
    """Links between pairs of a block in doubt that have the similarity by their shingles."""
    def compare(rows: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, column = rows.column("_node").to_numpy(), rows.column("_shingles").combine_chunks()
        values, at = column.values.to_numpy(), column.offsets.to_numpy()
        label = np.arange(len(node))
        for a, b, alike in _candidates(rows, ends, radius):
            some = (alike >= similar - MARGIN) & (alike < similar + MARGIN)
            for x, y in zip(a[some].tolist(), b[some].tolist(), strict=True):
                if label[x] != label[y]:
                    p, q = values[at[x]:at[x + 1]], values[at[y]:at[y + 1]]
                    common = len(p) + len(q) - len(np.union1d(p, q))
                    if common >= similar * (len(p) + len(q) - common) - 1e-9:
                        label = blocks.unite(label, np.array([x]), np.array([y]))
        moved = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"])

    return compare


def _contents(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                sets = [np.unique(np.concatenate(list(_shingle_hashes(t.as_py(), width)) or [np.zeros(1, np.uint64)])).view(np.int64) for t in part.column("_text")]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column("_node"), lists], ["_node", "_shingles"])

    return run


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similar: float = 0.8,
                        radius: int = 18) -> DataFrame:
    """``docs`` with one document of every group of near copies, the one with the smallest key.

    A fingerprint radius of 4 meets few pairs of a shingle similarity of 0.8 (they differ in ten bits on average), and bit ranges
    can't find candidates for a wide one. Candidates therefore share a band of two minima of the shingles (six
    bands: 99.8 % at 0.8); inside a bucket the bit-sliced comparison with a wide radius and 128 MinHash slots
    (standard error 0.035 at 0.8) leave clear pairs and such as are held to ``similar`` by all their shingles, fetched for them alone. Keys are integers; nodes
    are texts, so different texts under one key stay or go by themselves. Null keys come last, one row of a text that only they have stays. Rows alike in
    key and text are one document, wordless texts are copies of each other.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.xxhash64(body).alias("_node"), body.cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, slots, bands = zip(*(_profile(t.as_py(), width) for t in b.column("_text")), strict=True) if len(b) else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("_key"), b.column("_node"), pa.array(fps, pa.int64()), pa.array(slots, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["_key", "_node", "_fp", "_slots", "_bands"])

    profiles = stage(rows.mapInArrow(run, "_key long, _node long, _fp long, _slots binary, _bands array<long>"), "profiles")
    # Copies are one node, named by their text.
    nodes = stage(profiles.groupBy("_node").agg(F.min("_key").alias("_least"), F.count("*").alias("_n")), "nodes")
    firsts = profiles.select("_node", "_fp", "_slots", "_bands").dropDuplicates(["_node"]).select("_node", "_fp", "_slots", "_bands", F.explode("_bands").alias("_band"))
    found = stage(blocks.in_blocks(firsts, "_band", "_node", _clear(radius, similar), "a long, b long, ask boolean"), "clear-links")
    doubt = found.filter("ask").select(F.col("a").alias("_band"), F.col("b").alias("_node")).distinct()
    wanted = stage(doubt.groupBy("_node").agg(F.collect_list("_band").alias("_asked")).withColumnRenamed("_node", "_w"), "doubtful")
    contents = (rows.select("_node", "_text").join(wanted.select("_w"), F.col("_node") == F.col("_w"), "left_semi").dropDuplicates(["_node"])
                .mapInArrow(_contents(width), "_node long, _shingles array<long>"))
    known = profiles.select("_node", "_fp", "_slots", "_bands").join(wanted, F.col("_node") == F.col("_w")).dropDuplicates(["_node"]).drop("_node")
    asked = contents.join(known, F.col("_node") == F.col("_w")).select("_node", "_fp", "_slots", "_bands", "_shingles", F.explode("_asked").alias("_band"))
    exact = blocks.in_blocks(asked, "_band", "_node", _exact(radius, similar), "a long, b long", limit=512)
    links = found.filter("NOT ask").select("a", "b").union(exact)
    near = stage(components(links, "a", "b", "near-copies"), "near").withColumnRenamed("_node", "_m")
    nodes = stage(nodes.join(near, F.col("_node") == F.col("_m"), "left").withColumn("_root", F.coalesce("_root", "_node")).drop("_m"), "rooted")
    best = (nodes.groupBy("_root").agg(F.min(F.struct(F.col("_least").isNull().alias("n"), F.col("_least").alias("k"), F.col("_node").alias("m"))).alias("_best"))
            .select(F.col("_root").alias("_r"), F.col("_best")["m"].alias("_keep")))
    named = stage(nodes.join(best, F.col("_root") == F.col("_r")).select(F.col("_node").alias("_m"), "_least", "_n", "_keep"), "survivors")
    # Of a text that only rows without a key have, one row comes back.
    unnamed = "_m = _keep AND _least IS NULL AND _n > 1"
    copies = (profiles.select("_key", "_node").join(named, F.col("_node") == F.col("_m"))
              .filter(f"_node <> _keep OR NOT _key <=> _least OR ({unnamed})"))
    gone = stage(copies.select(F.col("_key").alias("_llm_k"), F.col("_node").alias("_llm_d")).distinct(), "copies")
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    kept = docs.join(gone, F.col(key).cast("long").eqNullSafe(F.col("_llm_k")) & (digest == F.col("_llm_d")), "left_anti")
    again = named.filter(unnamed).select(F.col("_m").alias("_llm_d"))
    one = docs.filter(F.col(key).cast("long").isNull()).withColumn("_llm_x", digest).join(again, F.col("_llm_x") == F.col("_llm_d"), "left_semi")
    return kept.union(one.dropDuplicates(["_llm_x"]).select(*docs.columns))
