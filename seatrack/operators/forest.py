"""Random forests over binned features: Spark deals the rows and adds up the histograms, tasks count them with NumPy.

The trees are those of ``pyspark.ml``: at most 32 bins a feature, Poisson(1) draws of every row for every tree, a random subset of the features
for every node, Gini or variance, no split without gain, leaves of one parent with the same prediction merged. ``pyspark.ml`` keeps an array of all
draws with each row and looks nodes up in boxed maps, a microsecond for each row, tree and level; here a task does the same for a block of rows at once.
A classifier's rows of the same bins and class are one entry with their number, whichever task read them, so passes grow with the different rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatrack.sources.staging import release, stage

#: Rows that one block holds, and rows that are worth a task of their own.
BLOCK_ROWS, TASK_ROWS = 524_288, 5_000
#: Rows that one entry stands for at most, so that very frequent ones are dealt out too.
ENTRY_ROWS = 4_096
BINS = 32
#: Bytes of one tree's histograms that the driver adds up itself.
DRIVER_BYTES = 1 << 26
#: Bins of 5 bits that a long holds, and values that stand for a block when quantiles are sought.
PER_LONG, RANKS = 12, 2_048
#: Impurity under which a node counts as pure.
PURE = 1e-12
_BLOCK = "block long, cells binary, sizes binary, labels binary"
_SPLIT = "tree int, split binary"


@dataclass
class Tree:
    """Nodes as arrays, the root first; both children of a leaf are the leaf itself."""

    feature: np.ndarray
    cut: np.ndarray  # rows of a bin up to it go left
    child: np.ndarray  # left, right of each node in turn
    stats: np.ndarray  # sums of draws per class; of draws, labels and squares
    weight: np.ndarray  # gain times draws, 0 in a leaf

    def walk(self, flat: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
        """Node, after so many steps, of the cells that start at these places."""
        node, cut = np.zeros(len(start), np.intp), self.cut.astype(np.uint8)
        for _ in range(depth):
            node = self.child.take(2 * node + (flat.take(start + self.feature.take(node)) > cut.take(node)))
        return node


def _impurity(stats: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws, and Gini impurity or variance, over the last axis."""
    n = stats.sum(-1) if classes else stats[..., 0]
    some = np.maximum(n, 1)
    if classes:
        return n, 1 - ((stats / some[..., None]) ** 2).sum(-1)
    return n, np.maximum(stats[..., 2] / some - (stats[..., 1] / some) ** 2, 0)


def _value(stats: np.ndarray, classes: int) -> np.ndarray:
    """Shares of the classes, or the mean in a column."""
    if classes:
        return stats / np.maximum(stats.sum(-1, keepdims=True), 1)
    return stats[..., 1:2] / np.maximum(stats[..., :1], 1)


#: Chances that a Poisson(1) draw is at most 0, 1, 2, ..., and the draw for each 2^-16 of chance, or 255 where a bound lies inside.
_POISSON = np.exp(-1) * np.cumsum(1 / np.cumprod(np.maximum(np.arange(20), 1), dtype=float))
_FROM, _TO = (np.searchsorted(_POISSON, (np.arange(65_536) + i) / 65_536, side="right") for i in (0, 1))
_DRAW = np.where(_FROM == _TO, _FROM, 255).astype(np.uint8)


def _draws(seed: int, block: int, tree: int, n: int) -> np.ndarray:
    """How often each row of a block is in a tree's sample: the same in every pass."""
    rng = np.random.default_rng([seed, 0, block, tree])
    chance = rng.bit_generator.random_raw(-(-n // 4)).view(np.uint16)[:n]
    out = _DRAW.take(chance)
    between = np.flatnonzero(out == 255)
    out[between] = np.searchsorted(_POISSON, (chance[between] + rng.random(len(between))) / 65_536, side="right")
    return out


def _subsets(seed: int, tree: int, level: int, nodes: int, features: int, k: int) -> np.ndarray:
    """The k features that each node of a level may split at."""
    return np.random.default_rng([seed, 1, tree, level]).random((nodes, features)).argsort(1)[:, :k]


def _cells(values: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, v, side="left").astype(np.uint8) for v, e in zip(values, edges, strict=True)], 1)


def _distinct(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal rows together, and where each group of them starts."""
    order = np.lexsort(cells.T)
    ordered = cells[order]
    new = np.ones(len(cells), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    return order, np.flatnonzero(new)


def _coded(cells: np.ndarray) -> list[np.ndarray]:
    """The bins of each row in as few longs as hold them."""
    return [(cells[:, i:i + PER_LONG].astype(np.int64) << 5 * np.arange(cells[:, i:i + PER_LONG].shape[1])).sum(1) for i in range(0, cells.shape[1], PER_LONG)]


def _decoded(codes: Sequence[np.ndarray], wide: int) -> np.ndarray:
    return np.stack([codes[i // PER_LONG] >> 5 * (i % PER_LONG) & BINS - 1 for i in range(wide)], 1).astype(np.uint8)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together, until they hold the rows of a block."""
    parts, size = [], 0
    for b in batches:
        parts.append(b)
        size += len(b)
        if size >= BLOCK_ROWS:
            yield pa.Table.from_batches(parts)
            parts, size = [], 0
    if size:
        yield pa.Table.from_batches(parts)


@dataclass
class BinnedForest:
    """A fitted forest; ``classes`` is 0 for a regressor."""

    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    classes: int
    mean: float
    depth: int

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  (as in pyspark.ml)
        """Gain times draws by feature, in each tree and then overall brought to a sum of 1."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            one = np.bincount(t.feature, t.weight, len(self.features))
            total += one / (one.sum() or 1)
        return Vectors.dense(total / (total.sum() or 1))

    def predict(self, values: Sequence[np.ndarray]) -> np.ndarray:
        cells = _cells(values, self.edges)
        if not len(cells):
            return np.zeros(0)
        order, starts = _distinct(cells)
        flat = cells[order[starts]].ravel()
        places = np.arange(len(starts)) * cells.shape[1]
        votes = sum(_value(t.stats, self.classes)[t.walk(flat, places, self.depth)] for t in self.trees) / len(self.trees)
        of_cell = votes.argmax(1).astype(float) if self.classes else votes[:, 0] + self.mean
        out = np.empty(len(cells))
        out[order] = np.repeat(of_cell, np.diff(starts, append=len(cells)))
        return out

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Rows complete in the features, with their prediction."""

        @F.pandas_udf("double")
        def score(*values: pd.Series) -> pd.Series:
            rows = np.stack([v.to_numpy(np.float64) for v in values])
            out, known = np.full(rows.shape[1], np.nan), ~np.isnan(rows).any(0)
            out[known] = self.predict(rows[:, known])
            return pd.Series(out)  # NaN arrives as NULL

        # Complete rows are told here, as conditions on the features would make Spark derive each of them again; so would a deterministic score.
        return df.withColumn(prediction, score.asNondeterministic()(*[F.col(c).cast("double") for c in self.features])).where(F.col(prediction).isNotNull())


@dataclass
class BoostedForest(BinnedForest):
    """Trees that add up: the first one whole, the others times ``step``; class 1 where the sum is above 0."""

    step: float

    def predict(self, values: Sequence[np.ndarray]) -> np.ndarray:
        cells = _cells(values, self.edges)
        if not len(cells):
            return np.zeros(0)
        order, starts = _distinct(cells)
        flat, places = cells[order[starts]].ravel(), np.arange(len(starts)) * cells.shape[1]
        score = sum((self.step if i else 1.0) * _value(t.stats, 0)[t.walk(flat, places, self.depth), 0] for i, t in enumerate(self.trees))
        out = np.empty(len(cells))
        out[order] = np.repeat((score > 0).astype(float), np.diff(starts, append=len(cells)))
        return out


def complete(features: Sequence[str]) -> Column:
    known = F.lit(True)
    for c in features:
        known &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return known


def _edges(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Upper ends of all bins but the last: between all values of a feature of few, else quantiles of all rows.

    Of each block of rows so many evenly spaced ranks stand for all, a rank being off by 1 / RANKS of the rows at most.
    """

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _gathered(batches):
            for i, c in enumerate(features):
                v = np.sort(block[c].to_numpy())
                ranks = v if len(v) <= RANKS else v[((np.arange(RANKS) + 0.5) * len(v) / RANKS).astype(np.int64)]
                distinct = v[np.append(True, v[1:] != v[:-1])]
                yield pa.RecordBatch.from_pydict({"feature": pa.array([i], pa.int32()), "ranks": [ranks.tobytes()], "weight": [len(v) / len(ranks)],
                                                  "few": pa.array([distinct.tobytes() if len(distinct) <= BINS else None], pa.binary())})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        few = None if part["few"].isna().any() else np.unique(np.concatenate([np.frombuffer(f) for f in part["few"]]))
        if few is not None and len(few) <= BINS:
            edges = (few[1:] + few[:-1]) / 2
        else:
            ranks = [np.frombuffer(r) for r in part["ranks"]]
            weights, ranks = np.repeat(part["weight"].to_numpy(), [len(r) for r in ranks]), np.concatenate(ranks)
            order = ranks.argsort(kind="stable")
            upto = weights[order].cumsum()
            edges = np.unique(ranks[order][np.searchsorted(upto, np.arange(1, BINS) / BINS * upto[-1])])
        return pd.DataFrame({"feature": part["feature"].iloc[:1], "edges": [edges.tobytes()]})

    found = rows.mapInArrow(summaries, "feature int, ranks binary, weight double, few binary").groupBy("feature").applyInPandas(merge, "feature int, edges binary").collect()
    return [np.frombuffer(e) for _, e in sorted(found)]


def _packed(df: DataFrame, features: Sequence[str], label: str, classify: bool) -> tuple[DataFrame, list[np.ndarray], int, float, int]:
    """Blocks of the rows complete in the features, upper ends of the bins, number of classes or 0, mean of a regressor's labels, and tasks."""
    features = list(features)
    written = stage(df.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y")), "training-rows")
    held = written.where(complete([f"f{i}" for i in range(len(features))]))  # not before: Spark would derive the features once for each condition
    n, labelled, top, least, whole, mean = held.agg(F.count("*"), F.count(F.when(~F.isnan("y"), F.col("y"))), F.max("y"), F.min("y"), F.min(F.col("y") == F.floor("y")), F.avg("y")).first()
    if not n or labelled < n:
        raise ValueError("a forest needs rows, and a label in each of them")
    if classify and (least < 0 or not whole):
        raise ValueError("classes are numbers from 0 on")
    classes = int(top) + 1 if classify else 0
    edges, center, wide = _edges(held, [f"f{i}" for i in range(len(features))]), 0.0 if classify else float(mean), len(features)
    cores = df.sparkSession.sparkContext.defaultParallelism

    def block(cells: np.ndarray, sizes: np.ndarray, labels: np.ndarray, at: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array([(TaskContext.get().partitionId() << 32) + at], pa.int64()), "cells": [cells.tobytes()],
                                           "sizes": [sizes.astype(np.int64).tobytes()], "labels": [labels.tobytes()]})

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*_coded(_cells([b[f"f{i}"].to_numpy() for i in range(wide)], edges)), b["y"].cast(pa.int64())], [*codes, "y"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in enumerate(_gathered(batches)):
            if classes:
                yield block(_decoded([rows[c].to_numpy() for c in codes], wide), rows["size"].to_numpy(), rows["y"].to_numpy(), at)
                continue
            cells = _cells([rows[f"f{i}"].to_numpy() for i in range(wide)], edges)
            order, starts = _distinct(cells)
            yield block(cells[order[starts]], np.diff(starts, append=len(order)), rows["y"].to_numpy()[order] - center, at)

    codes = [f"c{i}" for i in range(-(-wide // PER_LONG))]
    tasks = max(1, min(cores, -(-n // TASK_ROWS)))
    entries = held
    if classes:
        part = F.explode(F.expr(f"sequence(0L, (count - 1) DIV {ENTRY_ROWS})"))
        counted = held.mapInArrow(code, ", ".join(f"{c} long" for c in [*codes, "y"])).groupBy(*codes, "y").count()
        entries = counted.select("*", part.alias("part")).select(*codes, "y", F.expr(f"least({ENTRY_ROWS}, count - {ENTRY_ROWS} * part)").alias("size"))
    packed = stage(entries.repartition(tasks).mapInArrow(pack, _BLOCK), "training-blocks")
    release(written)
    return packed, edges, classes, center, tasks


def _trees(blocks: DataFrame, trees: int, depth: int, classes: int, wide: int, k: int, seed: int, tasks: int, weights=None) -> list[Tree]:
    """Each level is one pass; ``weights`` of a block's entries stand for its draws."""
    grown = [Tree(np.zeros(1, np.intp), np.full(1, BINS), np.zeros(2, np.intp), np.zeros((1, classes or 3)), np.zeros(1)) for _ in range(trees)]
    open_nodes = [np.zeros(1, np.intp) for _ in range(trees)]
    width = classes or 3
    for level in range(depth):
        live = [t for t in range(trees) if len(open_nodes[t])]
        if not live:
            break
        for t, split in _pass(blocks, grown, open_nodes, live, level, level == depth - 1, classes, wide, k, seed, tasks, weights):
            at = np.frombuffer(split, np.float64).reshape(-1, 4 + 2 * width)
            grown[t], open_nodes[t] = _grow(grown[t], open_nodes[t], at, width, level == 0)
    return [_merged(t, classes) for t in grown]


def fit_forest(
    df: DataFrame, features: Sequence[str], label: str, classify: bool, trees: int = 100, depth: int = 10, seed: int = 42,
) -> BinnedForest:
    """A forest of the rows complete in the features, with ceil(sqrt) of them per node, or ceil(a third) for a regressor.

    Each level is one pass: tasks add up histograms of all open nodes, one task per tree's histograms chooses its splits, and the splits alone reach the driver.
    """
    features = list(features)
    packed, edges, classes, center, tasks = _packed(df, features, label, classify)
    wide = len(features)
    k = int(np.ceil(np.sqrt(wide))) if classify else -(-wide // 3)
    blocks = packed.repartitionByRange(tasks, "block").persist()  # as they were packed: the same number in each task
    grown = _trees(blocks, trees, depth, classes, wide, k, seed, tasks)
    blocks.unpersist()
    release(packed)
    return BinnedForest(features, edges, grown, classes, center, depth)


def fit_boosted(
    df: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 10, step: float = 0.3, share: float = 0.5, seed: int = 42,
) -> BoostedForest:
    """Gradient-boosted regression trees for classes 0 and 1 under log loss, as ``GBTClassifier`` has them.

    Rows of the same bins and class have the same score and residual throughout, so an entry keeps one of each; a tree sees ``share`` of its rows,
    drawn anew. Small histograms of one tree are added up by the driver.
    """
    features = list(features)
    packed, edges, classes, _, tasks = _packed(df, features, label, True)
    if classes > 2:
        release(packed)
        raise ValueError("boosted trees tell two classes apart")
    wide = len(features)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                truth = 2.0 * np.frombuffer(b["labels"], np.int64) - 1
                yield pa.RecordBatch.from_pylist([{**b, "labels": truth.tobytes(), "truth": truth.tobytes(), "scores": np.zeros(len(truth)).tobytes()}], batches_of)

    def onward(tree: Tree, weight: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in batch.to_pylist():
                    truth, flat = np.frombuffer(b["truth"]), np.frombuffer(b["cells"], np.uint8)
                    scores = np.frombuffer(b["scores"]) + weight * _value(tree.stats, 0)[tree.walk(flat, np.arange(len(truth)) * wide, depth), 0]
                    residual = 4 * truth / (1 + np.exp(2 * truth * scores))
                    yield pa.RecordBatch.from_pylist([{**b, "labels": residual.tobytes(), "scores": scores.tobytes()}], batches_of)

        return run

    def drawn(round_: int):
        return lambda b: np.random.default_rng([seed, 2, b["block"], round_]).binomial(np.frombuffer(b["sizes"], np.int64), share).astype(float)

    kinds = f"{_BLOCK}, truth binary, scores binary"
    batches_of = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("cells", "sizes", "labels", "truth", "scores"))])
    blocks, grown = stage(packed.mapInArrow(begin, kinds), "boosting-blocks"), []
    release(packed)
    for i in range(trees):
        if grown:  # written anew: plans of tables kept one upon the other would grow with the trees
            before, blocks = blocks, stage(blocks.mapInArrow(onward(grown[-1], 1.0 if i == 1 else step), kinds), "boosting-blocks")
            release(before)
        grown += _trees(blocks, 1, depth, 0, wide, wide, seed + i, tasks, drawn(i))
    release(blocks)
    return BoostedForest(features, edges, grown, 0, 0.0, depth, step)


def _pass(blocks, grown, open_nodes, live, level, last, classes, wide, k, seed, tasks, weights=None) -> list[tuple[int, bytes]]:
    """Per tree the best split of each open node: feature or -1, cut, gain times draws, 1 and 2 for a left and right child that stays open, sums left and right."""
    width = classes or 3

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = {t: (*_steps(grown[t], open_nodes[t], level), _subsets(seed, t, level, len(open_nodes[t]), wide, k).T.copy()) for t in live}
        sums = {}
        for batch in batches:
            for b in batch.to_pylist():
                sizes, labels = np.frombuffer(b["sizes"], np.int64), np.frombuffer(b["labels"], np.int64 if classes else np.float64)
                flat, ends = np.frombuffer(b["cells"], np.uint8), np.cumsum(sizes if weights is None else np.ones_like(sizes))
                n, room = int(ends[-1]), _Room(len(sizes), int(ends[-1]))
                bins = (flat.reshape(-1, wide) * np.intp(classes) + labels[:, None]).astype(np.min_scalar_type(BINS * classes)).ravel() if classes else flat
                for t in live:
                    draws = _draws(seed, b["block"], t, n) if weights is None else weights(b)
                    columns = [_by_cell(v, ends, room) for v in ([draws] if classes else [draws, draws * labels, draws * labels * labels])]
                    found = _histograms(flat, bins, columns, *ways[t], wide, classes or 1, room)
                    if t in sums:
                        sums[t] += found
                    else:
                        sums[t] = found
        for t, s in sums.items():
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "split": [s.tobytes()]})

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        t = int(part["tree"].iloc[0])
        total = sum(np.frombuffer(s, np.float64) for s in part["split"]).reshape(-1, k, BINS, width)
        nodes = np.arange(len(total))
        left = total.cumsum(2)
        whole = left[:, :, -1:, :]
        right = whole - left
        (nl, il), (nr, ir), (n, i) = (_impurity(s, classes) for s in (left, right, whole))
        gain = np.where((nl > 0) & (nr > 0), i - (nl * il + nr * ir) / np.maximum(n, 1), -1.0).reshape(len(total), -1)
        best = gain.argmax(1)
        j, cut = best // BINS, best % BINS
        gained = gain[nodes, best]
        splits = gained > PURE
        stay = splits & (not last)
        out = np.column_stack([
            np.where(splits, _subsets(seed, t, level, len(total), wide, k)[nodes, j], -1), cut, gained * n[:, 0, 0],
            (stay & (il[nodes, j, cut] > PURE)) + 2 * (stay & (ir[nodes, j, cut] > PURE)), left[nodes, j, cut], right[nodes, j, cut]])
        return pd.DataFrame({"tree": [t], "split": [np.ascontiguousarray(out).tobytes()]})

    sent = blocks.mapInArrow(histograms, _SPLIT)
    if len(grown) == 1 and 8 * tasks * len(open_nodes[0]) * k * BINS * width < DRIVER_BYTES:
        chosen = choose(pd.DataFrame(sent.collect(), columns=["tree", "split"])).itertuples(index=False)
    else:
        chosen = sent.repartition(tasks, "tree").groupBy("tree").applyInPandas(choose, _SPLIT).collect()
    return [(r.tree, r.split) for r in chosen]


class _Room:
    """Arrays that every tree of a block uses anew: fresh ones of this length cost more than what is done in them."""

    def __init__(self, m: int, n: int):
        self.upto, self.ends, self.draws = np.empty(n, np.int32), np.empty(m + 1, np.int32), np.empty(m)
        self.node, self.place, self.key, self.starts = (np.empty(m, np.intp) for _ in range(4))
        self.cell, self.cut, self.right = np.empty(m, np.uint8), np.empty(m, np.uint8), np.empty(m, bool)


def _by_cell(values: np.ndarray, ends: np.ndarray, room: _Room) -> np.ndarray:
    """Sums of the rows of each cell; draws are whole, so that differences of sums up to a row are exact."""
    if values.dtype != np.uint8:
        return values if len(ends) == len(values) else np.add.reduceat(values, np.append(0, ends[:-1]))
    if len(ends) == len(values):
        np.copyto(room.draws, values)
        return room.draws
    np.cumsum(values, dtype=np.int32, out=room.upto)
    room.ends[0] = 0
    room.upto.take(ends - 1, out=room.ends[1:], mode="clip")
    return np.subtract(room.ends[1:], room.ends[:-1], out=room.draws)


def _steps(t: Tree, nodes: np.ndarray, level: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Feature and cut at each place of each level, where the places below p are 2p and 2p + 1; the number of the open node at each place of the last one, or -1."""
    at, steps = np.zeros(1, np.intp), []
    for _ in range(level):
        steps.append((t.feature[at], t.cut[at].astype(np.uint8)))
        at = t.child.reshape(-1, 2)[at].ravel()
    number = np.full(len(t.cut), -1)
    number[nodes] = np.arange(len(nodes))
    return steps, number[at]


def _histograms(flat, bins, columns, steps, number, may, wide: int, inner: int, room: _Room) -> np.ndarray:
    """Sums of the columns by open node, feature it may split at, and bin, for the cells that are drawn at all."""
    drawn = np.flatnonzero(columns[0] > 0)
    m = len(drawn)
    starts, columns = np.multiply(drawn, wide, out=room.starts[:m]), [c.take(drawn) for c in columns]
    node, place, cell, cut, right = (a[:m] for a in (room.node, room.place, room.cell, room.cut, room.right))
    node.fill(0)
    for feature, bound in steps:
        np.add(feature.take(node, out=place, mode="clip"), starts, out=place)
        np.greater(flat.take(place, out=cell, mode="clip"), bound.take(node, out=cut, mode="clip"), out=right)
        np.left_shift(node, 1, out=node)
        np.add(node, right, out=node)
    number.take(node, out=place, mode="clip")
    np.copyto(node, place)
    if (number < 0).any():
        some = np.flatnonzero(node >= 0)
        node, starts, columns = node.take(some), starts.take(some), [c.take(some) for c in columns]
        m = len(some)
    size, place, key = BINS * inner, room.place[:m], room.key[:m]
    total = np.empty((may.shape[1], len(may), BINS, inner * len(columns)))
    first = node * size
    for j, feature in enumerate(may):
        np.add(feature.take(node, out=place, mode="clip"), starts, out=place)
        np.add(first, bins.take(place), out=key)
        for i, values in enumerate(columns):
            total[:, j, :, i * inner:(i + 1) * inner] = np.bincount(key, values, len(total) * size).reshape(-1, BINS, inner)
    return total


def _grow(t: Tree, nodes: np.ndarray, at: np.ndarray, width: int, root: bool) -> tuple[Tree, np.ndarray]:
    """The tree with the chosen splits of its open nodes, and the nodes that are open then."""
    stats = at[:, 4:4 + width], at[:, 4 + width:]
    if root:
        t.stats[0] = stats[0][0] + stats[1][0]
    s = at[:, 0] >= 0
    parents, first, m = nodes[s], len(t.cut), int(s.sum())
    new = first + np.arange(2 * m)
    grown = Tree(
        np.concatenate([t.feature, np.zeros(2 * m, np.intp)]), np.concatenate([t.cut, np.full(2 * m, BINS)]),
        np.concatenate([t.child, np.repeat(new, 2)]),
        np.concatenate([t.stats, np.stack([stats[0][s], stats[1][s]], 1).reshape(-1, width)]), np.concatenate([t.weight, np.zeros(2 * m)]))
    grown.feature[parents], grown.cut[parents], grown.weight[parents] = at[s, 0], at[s, 1], at[s, 2]
    grown.child[2 * parents], grown.child[2 * parents + 1] = new[::2], new[1::2]
    flags = at[s, 3].astype(int)
    return grown, new[np.stack([flags & 1, flags & 2], 1).ravel() > 0]


def _merged(t: Tree, classes: int) -> Tree:
    """Two leaves of one parent with the same prediction become one; children come after their parents."""
    value = _value(t.stats, classes)
    says = value.argmax(1) if classes else value[:, 0]
    leaf = t.child[::2] == np.arange(len(t.cut))
    for p in np.flatnonzero(~leaf)[::-1]:
        a, b = t.child[2 * p], t.child[2 * p + 1]
        if leaf[a] and leaf[b] and says[a] == says[b]:
            leaf[p], t.child[2 * p], t.child[2 * p + 1], t.weight[p], t.feature[p], t.cut[p] = True, p, p, 0.0, 0, BINS
    return t
