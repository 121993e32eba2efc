"""Token pieces of documents, and bulk-synchronous best-fit packing of pieces into sequences."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seatrack.llm.store import stage

MEMO = 300_000
LONG = 64
TASK_ROWS = 50_000
END = np.array([1], "<u4").tobytes()
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]*")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: visible Latin-1 for itself, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def id_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Little-endian 32-bit ids of texts, without added special tokens.

    A tokenizer file that drops white space and cuts words with this pattern sees every part between spaces
    on its own. Parts met before come from a memo of bounded size; a new part of plain letters goes straight to the
    vocabulary's merges, any other through the library. Texts with special strings, and other tokenizer
    files, are encoded whole.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    apart = (steps == ["NFC", "Replace", "Lowercase"] and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
             and cuts[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
             and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
             and all(len(t["content"]) > 3 and t["content"].startswith("<|") for t in spec["added_tokens"]) and spec["post_processor"] is None)
    letters, merge = str.maketrans({chr(b): c for b, c in _byte_letters().items()}), tok.model.tokenize
    memo: dict[str, bytes] = {"": b""}
    pieces: dict[str, bytes] = {}

    def pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def whole(text: str) -> bytes:
        return pack(tok.encode(text, add_special_tokens=False).ids)

    def piece(x: str) -> bytes:
        found = pieces.get(x)
        if found is None:
            found = pieces[x] = pack([t.id for t in merge(x.encode().decode("latin-1").translate(letters))])
        return found

    def part(p: str) -> bytes:
        if not _PLAIN.fullmatch(p):
            return whole(p)
        low = p.lower()
        return piece(low) if low.isalpha() else b"".join(map(piece, _PIECE.findall(low)))

    def encode(texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if not apart or "<|" in text:
                out.append(whole(text))
                continue
            parts = text.replace("\n", " ").split(" ")
            new = set(parts).difference(memo)
            for p in new:
                memo[p] = part(p)
            out.append(b"".join(map(memo.__getitem__, parts)))
            for p in new:
                if len(p) > LONG:
                    del memo[p]
            for held in (memo, pieces):
                if len(held) > MEMO:  # those met first are the frequent ones
                    for p in list(islice(reversed(held), MEMO // 4)):
                        del held[p]
        return out

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: key, ``piece, start, length, ids_crc32``.

    A document is its ids and the end id 1; null text is empty, so one id. Only documents of more than
    ``size`` ids are cut.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(tokenizer)  # its memo goes with the task
        for b in batches:
            for i in range(0, len(b), 256):
                texts, row, out = b.column("_text")[i:i + 256].to_pylist(), [], []
                for r, ids in enumerate(encode(texts)):
                    ids += END
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        cut = ids[at:at + 4 * size]
                        row.append(i + r)
                        out.append((k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                piece, start, length, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_key").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["_key", "piece", "start", "length", "ids_crc32"])

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, piece int, start long, length long, ids_crc32 long")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's share of a sweep from large to small over gaps and items.

    Every item takes the smallest gap seen so far that holds it; what is left of a gap stays open while it can
    hold items of the size now passed. Items without a gap, and open gaps, are numbered for the match across tasks.
    """
    at, rows = TaskContext.get().partitionId(), [r for b in batches for r in zip(b["kind"].to_pylist(), b["id"].to_pylist(), b["size"].to_pylist())]
    open_: list[tuple[int, int]] = []  # (size, bin), ascending
    parked, items, alone = [], [], 0
    for kind, id_, size in rows:
        if kind == 0:
            open_.insert(0, (size, id_)) if not open_ or size <= open_[0][0] else open_.insert(bisect_left(open_, (size, id_)), (size, id_))
            continue
        k = bisect_left(open_, (size, -1))
        if k == len(open_):
            items.append((1, id_, size, None, alone))
            alone += 1
            continue
        room, bin_ = open_.pop(k)
        items.append((1, id_, size, bin_, None))
        if room - size >= size:
            open_.insert(bisect_left(open_, (room - size, bin_)), (room - size, bin_))
        elif room > size:
            parked.append((0, bin_, room - size, None, None))
    last = rows[-1][2] if rows else 0
    left = [(0, bin_, size, None, None) for size, bin_ in open_ if size < last]
    left += [(0, bin_, size, None, n) for n, (size, bin_) in enumerate(x for x in open_ if x[0] >= last)]
    out = items + parked + left
    if out:
        kind, id_, size, bin_, rank = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(id_, pa.int64()), pa.array(size, pa.int64()), pa.array(bin_, pa.int64()),
             pa.array(rank, pa.int64()), pa.array([at] * len(out), pa.int32())], ["kind", "id", "size", "bin", "rank", "part"])


def _across(counts: dict[tuple[int, int], tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which unplaced items of a task take which open gaps of earlier tasks, by rank.

    From the (number, smallest, largest size) of the numbered rows per (task, kind) alone: the latest task's gaps are the
    smallest that fit. Rows: items' task, first and last rank, gaps' task, first rank, items per gap.
    """
    stack: list[list[int]] = []  # task, next rank, end rank, smallest gap
    out = []
    for part in sorted({p for p, _ in counts}):
        todo, _, largest = counts.get((part, 1), (0, 0, 0))
        done = 0
        while done < todo and stack:
            gaps = stack[-1]
            per = max(1, gaps[3] // largest)
            used = min(gaps[2] - gaps[1], -(-(todo - done) // per))
            here = min(todo - done, used * per)
            out.append((part, done, done + here - 1, gaps[0], gaps[1], per))
            done += here
            gaps[1] += used
            if gaps[1] == gaps[2]:
                stack.pop()
        n, smallest, _ = counts.get((part, 0), (0, 0, 0))
        if n:
            stack.append([part, 0, n, smallest])
    return out


def best_fit(items: DataFrame, size: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """(``id``, ``bin``) for items (``id``, ``size`` < sequence size).

    Rounds: gaps and items are range-sorted by size, tasks sweep their range, what no task could match is
    matched across tasks by rank, gaps shrink, and what is left goes on. As many sequences are opened as the
    unplaced items would fill at least; more only once a round places next to nothing. The driver sees
    sums per task and never a row.
    """
    spark = items.sparkSession
    n, total = items.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    gaps, opened, placed, results = spark.createDataFrame([], "id long, size long"), 0, 0, []
    n_gaps = 0
    while n:
        if not opened or placed < max(1, n // 50):
            new = -(-total // size)
            gaps = gaps.union(spark.range(opened, opened + new).select("id", F.lit(size).cast("long").alias("size")))
            opened, n_gaps = opened + new, n_gaps + new
        parts = max(1, (n + n_gaps) // task_rows)
        rows = gaps.select(F.lit(0).alias("kind"), "id", "size").union(items.select(F.lit(1).alias("kind"), "id", "size"))
        order = [F.desc("size"), F.col("kind"), F.xxhash64("id"), F.col("id")]
        swept = stage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                      .mapInArrow(_sweep, "kind int, id long, size long, bin long, rank long, part int"), "sweep")
        sums = swept.groupBy("part", "kind").agg(
            F.count("rank").alias("n"), F.min(F.when(F.col("rank").isNotNull(), F.col("size"))).alias("low"),
            F.max(F.when(F.col("rank").isNotNull(), F.col("size"))).alias("high"), F.count("*").alias("rows")).collect()
        matches = _across({(r["part"], r["kind"]): (r["n"], r["low"], r["high"]) for r in sums if r["n"]})
        alone = swept.filter("kind = 1 AND bin IS NULL")
        if matches:
            plan = spark.createDataFrame(matches, "p int, first long, last long, q int, gap long, per long")
            gap_of = alone.join(F.broadcast(plan), (F.col("part") == F.col("p")) & F.col("rank").between(F.col("first"), F.col("last")), "left").select(
                "id", "size", "q", (F.col("gap") + F.floor((F.col("rank") - F.col("first")) / F.col("per"))).alias("gap_rank"))
            free = swept.filter("kind = 0 AND rank IS NOT NULL").select(F.col("part").alias("g_part"), F.col("rank").alias("g_rank"), F.col("id").alias("bin"))
            met = stage(gap_of.join(free, (F.col("q") == F.col("g_part")) & (F.col("gap_rank") == F.col("g_rank")), "left").select("id", "size", "bin"), "matched")
            taken = met.filter("bin IS NOT NULL").groupBy("bin").agg(F.sum("size").alias("taken")).withColumnRenamed("bin", "b")
            gaps = (swept.filter("kind = 0").join(taken, F.col("id") == F.col("b"), "left")
                    .select("id", (F.col("size") - F.coalesce("taken", F.lit(0))).alias("size")).filter("size > 0"))
            results.append(met.filter("bin IS NOT NULL").select("id", "bin"))
            items = met.filter("bin IS NULL").select("id", "size")
        else:
            gaps, items = swept.filter("kind = 0").select("id", "size"), alone.select("id", "size")
        results.append(swept.filter("kind = 1 AND bin IS NOT NULL").select("id", "bin"))
        before = n
        n, total = items.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        placed, n_gaps = before - n, sum(r["rows"] for r in sums if r["kind"] == 0)
    out = spark.createDataFrame([], "id long, bin long")
    for r in results:
        out = out.union(r)
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, ``piece, start, length, ids_crc32, sequence_id, offset``.

    Sequences hold at most ``size`` ids without gaps between pieces. Full pieces are sequences of their own with
    negative numbers. Rows with null or repeated keys are packed like any other.
    """
    pieces = stage(token_pieces(docs, tokenizer, size, key, text).withColumn("_id", F.monotonically_increasing_id()), "pieces")
    bins = best_fit(pieces.filter(F.col("length") < size).select(F.col("_id").alias("id"), F.col("length").alias("size")), size)
    ahead = Window.partitionBy("bin").orderBy(F.desc("length"), "_id").rowsBetween(Window.unboundedPreceding, -1)
    fit = (pieces.filter(F.col("length") < size).join(bins, F.col("_id") == F.col("id"))
           .withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))))
    columns = [F.col("_key").alias(key), "piece", "start", "length", "ids_crc32"]
    full = pieces.filter(F.col("length") == size).select(*columns, (-1 - F.col("_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return fit.select(*columns, F.col("bin").alias("sequence_id"), "offset").union(full)
