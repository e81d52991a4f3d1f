"""Gradient-boosted regression trees on histograms, with L1 and L2 penalties on the leaves.

Features are cut into at most ``bins`` bins by quantiles; features whose bins together make at most CODES combinations share one
code, of which a histogram gives the histogram of each. Rows lie in blocks of codes, targets and margins in the shared
folder. A level of a tree is one sum over all blocks: sums of gradients and of second derivatives by (model,
node, feature, bin), from which the driver takes each node's best split; of two siblings the one with fewer rows is summed, the other is
what the parent has beyond it. Several models grow together, each on the rows of its own training set, so all folds of a cross-validation
cost as many jobs as one model. The driver holds sums and trees alone: models x 2^depth x features x bins numbers.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, kept

BLOCK_ROWS = 1 << 15
#: A task has at least and at most so many rows (where there is a core for each task, fewer than the most).
LEAST_ROWS, MOST_ROWS = 1 << 12, 1 << 18
#: Combinations of bins that share a code at most, at least the bins of one feature.
CODES = 1 << 10
#: Parts of a sum beyond which they are added up in a tree of tasks before the driver adds them.
SENT_SUMS = 64
#: Rounds after which the blocks are written anew with their margins, so that a job evaluates few trees.
KEPT_ROUNDS = 20


@dataclass(frozen=True)
class Settings:
    """200 rounds of depth 5 at a step of 0.05, shares of rows and features a round, penalties, seed."""

    rounds: int = 200
    depth: int = 5
    step: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    l1: float = 0.1
    l2: float = 1.0
    least_weight: float = 1.0
    bins: int = 32
    seed: int = 42


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    """A sum of gradients less the L1 penalty, towards zero."""
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_weight(g, h, s: Settings):
    """The margin that is best for a leaf of gradient sum ``g`` and second derivatives ``h``."""
    return -shrunk(g, s.l1) / np.maximum(h + s.l2, 1e-300)


def leaf_score(g, h, s: Settings):
    """Twice what a leaf takes off the penalised loss."""
    return shrunk(g, s.l1) ** 2 / np.maximum(h + s.l2, 1e-300)


@dataclass
class Tree:
    """A complete tree by levels: the children of node i are 2i + 1 and 2i + 2. ``feature`` is -1 in leaves; bins up to ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row of ``bins`` reaches after at most ``depth`` splits."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[at]
            inner = f >= 0
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


def best_splits(hist: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """(gain, feature, cut, g left, h left, g, h) of each node from its sums, by node, feature, bin and (g, h)."""
    left = np.cumsum(hist, axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    gain = leaf_score(left[..., 0], left[..., 1], s) + leaf_score(right[..., 0], right[..., 1], s) - leaf_score(total[..., 0], total[..., 1], s)
    gain[(left[..., 1] < s.least_weight) | (right[..., 1] < s.least_weight)] = -np.inf
    nodes, features, bins = gain.shape
    best = gain.reshape(nodes, -1).argmax(axis=1)
    f, cut, n = best // bins, best % bins, np.arange(nodes)
    return gain[n, f, cut], f, cut, left[n, f, cut, 0], left[n, f, cut, 1], total[:, 0, 0, 0], total[:, 0, 0, 1]


@dataclass(frozen=True)
class Model:
    """Trees over binned features; ``bounds[i]`` are the upper bounds of the bins of feature i but the last."""

    names: tuple[str, ...]
    bounds: tuple[tuple[float, ...], ...]
    base: float
    step: float
    depth: int
    trees: tuple[Tree, ...]

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for tree in self.trees:
            out += self.step * tree.value[tree.nodes(bins, self.depth)]
        return out

    def predict(self, values: np.ndarray) -> np.ndarray:
        """Predictions for rows of raw features; NaN counts as 0."""
        return self.margins(binned(np.nan_to_num(values, nan=0.0), self.bounds))

    def prediction(self, columns: list[Column] | None = None) -> Column:
        """The prediction as a column over the features' columns; null counts as 0."""
        own = self

        @F.pandas_udf("double")
        def run(vector: pd.Series) -> pd.Series:
            return pd.Series(own.predict(np.array(vector.tolist(), float).reshape(len(vector), len(own.names))))

        return run(F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns or [F.col(n) for n in self.names]]))

    def importance(self) -> dict[str, float]:
        """Mean gain of a feature's splits, as a share of all features' means."""
        gain, count = np.zeros(len(self.names)), np.zeros(len(self.names))
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(gain, tree.feature[inner], tree.gain[inner])
            np.add.at(count, tree.feature[inner], 1)
        mean = gain / np.maximum(count, 1)
        return dict(zip(self.names, (mean / (mean.sum() or 1.0)).tolist(), strict=True))


def binned(values: np.ndarray, bounds: tuple[tuple[float, ...], ...]) -> np.ndarray:
    return np.stack([np.searchsorted(np.array(b), values[:, i]) for i, b in enumerate(bounds)], axis=1).astype(np.uint8)


def bin_bounds(rows: DataFrame, names: tuple[str, ...], bins: int) -> tuple[tuple[float, ...], ...]:
    """Quantiles of each feature, equal ones once; null counts as 0."""
    asked = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.coalesce(F.col(n).cast("double"), F.lit(0.0)), asked, 10_000).alias(f"f{i}") for i, n in enumerate(names)]).first()
    return tuple(tuple(sorted(set(found[i] or []))) for i in range(len(names)))


@dataclass(frozen=True)
class Layout:
    """Which code each feature is part of, the step of one of its bins in that code, and its number of bins; the size of each code."""

    code: tuple[int, ...]
    step: tuple[int, ...]
    bins: tuple[int, ...]
    sizes: tuple[int, ...]

    @classmethod
    def of(cls, bounds: tuple[tuple[float, ...], ...]) -> Layout:
        """Features by descending number of bins, each into the first code that has room for it."""
        bins, sizes = [len(b) + 1 for b in bounds], []
        code, step = [0] * len(bins), [0] * len(bins)
        for f in sorted(range(len(bins)), key=lambda f: -bins[f]):
            at = next((i for i, size in enumerate(sizes) if size * bins[f] <= CODES), len(sizes))
            if at == len(sizes):
                sizes.append(1)
            code[f], step[f] = at, sizes[at]
            sizes[at] *= bins[f]
        return cls(tuple(code), tuple(step), tuple(bins), tuple(sizes))

    def codes(self, bins: np.ndarray) -> np.ndarray:
        """The codes of rows of bins, by code and row."""
        out = np.zeros((len(self.sizes), len(bins)), np.uint16)
        for f, (at, step) in enumerate(zip(self.code, self.step, strict=True)):
            out[at] += bins[:, f].astype(np.uint16) * np.uint16(step)
        return out

    def right(self, feature: int, cut: int) -> np.ndarray:
        """For each code that the feature is part of: whether its bin is beyond ``cut``."""
        return np.arange(self.sizes[self.code[feature]]) // self.step[feature] % self.bins[feature] > cut

    def by_bin(self, sums: list[np.ndarray], use: list[int], width: int) -> np.ndarray:
        """Sums by (..., code) as sums by (..., feature of ``use``, bin)."""
        out = np.zeros((*sums[0].shape[:-1], len(use), width))
        for i, f in enumerate(use):
            of, step, bins = sums[self.code[f]], self.step[f], self.bins[f]
            out[..., i, :bins] = of.reshape(*of.shape[:-1], -1, bins, step).sum(axis=(-3, -1))
        return out


BLOCK = "n long, keys binary, hashes binary, folds binary, y binary, codes binary, margins binary"


def blocks_of(rows: DataFrame, names: tuple[str, ...], label: str, key: str, folds: int, bounds: tuple[tuple[float, ...], ...], base: list[float]) -> DataFrame:
    """``rows`` in blocks, with a fold of each row's own (by hash of its key) and a margin a model."""
    layout = Layout.of(bounds)

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        n = sum(p.num_rows for p in parts)
        column = lambda i: np.concatenate([np.asarray(p.column(i)) for p in parts])
        values = np.concatenate([np.asarray(p.column(4).flatten()) for p in parts]).reshape(n, len(names))
        fields = [*[column(i) for i in range(4)], layout.codes(binned(values, bounds)), np.repeat(np.array(base), n)]
        return pa.record_batch([pa.array([n], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in fields]], names=[f.split()[0] for f in BLOCK.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                parts.append(batch.slice(at, BLOCK_ROWS - n))
                at, n = at + parts[-1].num_rows, n + parts[-1].num_rows
                if n == BLOCK_ROWS:
                    yield block(parts)
                    parts, n = [], 0
        if parts:
            yield block(parts)

    hashed = F.xxhash64(F.col(key).cast("string"), F.lit(42))
    vector = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])
    fold = F.pmod(hashed, F.lit(folds)).cast("int") if folds else F.lit(-1)
    return rows.where(F.col(label).isNotNull()).select(F.col(key).cast("long"), hashed.alias("h"), fold.alias("fold"), F.col(label).cast("double").alias("y"), vector.alias("v")).mapInArrow(pack, BLOCK)


class Block:
    """A block's arrays."""

    def __init__(self, row: dict, layout: Layout, models: int):
        self.row, self.n, self.layout = row, row["n"], layout
        self.hashes = np.frombuffer(row["hashes"], "<u8")
        self.folds = np.frombuffer(row["folds"], "<i4")
        self.y = np.frombuffer(row["y"], "<f8")
        self.codes = np.frombuffer(row["codes"], "<u2").reshape(len(layout.sizes), -1)
        self.margins = np.frombuffer(row["margins"], "<f8").reshape(models, -1)

    def beyond(self, tree: Tree, at: int, rows: np.ndarray) -> np.ndarray:
        """Whether each of the rows of node ``at`` goes to its right child."""
        f = tree.feature[at]
        return self.layout.right(f, tree.cut[at])[self.codes[self.layout.code[f]][rows]]

    def reached(self, tree: Tree, rows: np.ndarray, asked: list[int]) -> Iterator[np.ndarray]:
        """Those of ``rows`` that reach each of the nodes asked for."""
        known = {0: rows}

        def of(node: int) -> np.ndarray:
            if node not in known:
                above = of((node - 1) // 2)
                known[node] = above[self.beyond(tree, (node - 1) // 2, above) == (node % 2 == 0)]
            return known[node]

        for node in asked:
            yield of(node)

    def advance(self, rounds: list[list[Tree]], s: Settings) -> np.ndarray:
        """The margins with the trees of ``rounds``, one a model each."""
        margins = self.margins.copy()
        for trees in rounds:
            for m, tree in enumerate(trees):
                left = [(0, np.arange(self.n))]
                while left:
                    at, rows = left.pop()
                    if tree.feature[at] < 0:
                        margins[m, rows] += s.step * tree.value[at]
                    else:
                        beyond = self.beyond(tree, at, rows)
                        left += [(2 * at + 1, rows[~beyond]), (2 * at + 2, rows[beyond])]
        return margins

    def sampled(self, round_: int, s: Settings) -> np.ndarray:
        """The rows that take part in a round, by hash of their key and the round."""
        x = self.hashes + np.uint64((0x9E3779B97F4A7C15 * (round_ + 1) + s.seed) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) < np.uint64(min(2**64 - 1, int(s.row_share * 2**64)))


def _sums(held: RDD, out_of: list[int | None], now: list[Tree], asked: list[list[int]], round_: int, use: list[int], layout: Layout, s: Settings) -> np.ndarray:
    """Sums of (g, h) by model, node asked for, used feature and bin: added up within tasks, then by the driver or first in a tree of tasks.

    A round has ``depth`` of these jobs, one after the other, and each is a sum of arrays of one size: as a grouped aggregate
    with a column a bin it took 0.8 s on 2,000 rows, most of it planning.
    """
    models, nodes, used = len(out_of), max(map(len, asked)), sorted({layout.code[f] for f in use})

    def run(rows: Iterator[dict]) -> Iterator[np.ndarray]:
        sums = [np.zeros((2, models, nodes, size if c in used else 0)) for c, size in enumerate(layout.sizes)]
        for row in rows:
            b = Block(row, layout, models)
            sampled = b.sampled(round_, s)
            for m, fold in enumerate(out_of):
                g = b.margins[m] - b.y
                for i, mine in enumerate(b.reached(now[m], np.flatnonzero(sampled & (b.folds != fold) if fold is not None else sampled), asked[m])):
                    own = g[mine]
                    for c in used:
                        code = b.codes[c][mine].astype(np.intp)
                        sums[c][0, m, i] += np.bincount(code, own, layout.sizes[c])
                        sums[c][1, m, i] += np.bincount(code, minlength=layout.sizes[c])
        yield layout.by_bin(sums, use, s.bins)

    depth = 1 if held.getNumPartitions() <= SENT_SUMS else 2
    return np.moveaxis(held.mapPartitions(run).treeReduce(np.add, depth), 0, -1)


def _advance(row: dict, rounds: list[list[Tree]], layout: Layout, models: int, s: Settings) -> dict:
    return row | {"margins": Block(row, layout, models).advance(rounds, s).tobytes()}


def _held(blocks: DataFrame) -> RDD:
    """The blocks' rows in memory, or on disk; a lost part is read again from the written table. Keys are not needed to grow trees."""
    return blocks.drop("keys").rdd.map(lambda r: r.asDict()).persist(StorageLevel.MEMORY_AND_DISK)


def _written(blocks: DataFrame, rounds: list[list[Tree]], layout: Layout, models: int, s: Settings) -> DataFrame:
    """The blocks with the trees of ``rounds`` in their margins, in the shared folder: what is held after it starts from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([_advance(row, rounds, layout, models, s)], schema=batch.schema)

    return kept(blocks.mapInArrow(run, BLOCK), "boosting-blocks")


def _grown(held: RDD, out_of: list[int | None], round_: int, use: list[int], layout: Layout, s: Settings) -> list[Tree]:
    """The round's tree of each model, level by level."""
    now = [Tree.empty(s.depth) for _ in out_of]
    asked: list[list[int]] = [[0] for _ in out_of]
    above: list[dict[int, np.ndarray]] = [{} for _ in out_of]
    for _ in range(s.depth):
        sums = _sums(held, out_of, now, asked, round_, use, layout, s)
        for m, tree in enumerate(now):
            known = dict(zip(asked[m], sums[m], strict=False))
            for node in [n for n in asked[m] if n]:
                rest = above[m][(node - 1) // 2] - known[node]
                rest[rest[..., 1] == 0, 0] = 0.0  # an empty bin has no gradients, not what rounding leaves
                known[node + 1 if node % 2 else node - 1] = rest
            above[m], asked[m] = known, []
            if not known:
                continue
            nodes = sorted(known)
            for at, gain, f, cut, gl, hl, g, h in zip(nodes, *best_splits(np.stack([known[n] for n in nodes]), s), strict=True):
                if h == 0:
                    continue
                tree.value[at] = leaf_weight(g, h, s)
                if gain > 1e-12:
                    tree.feature[at], tree.cut[at], tree.gain[at] = use[f], cut, gain
                    tree.value[2 * at + 1], tree.value[2 * at + 2] = leaf_weight(gl, hl, s), leaf_weight(g - gl, h - hl, s)
                    asked[m].append(2 * at + 1 if 2 * hl <= h else 2 * at + 2)
        if not any(asked):
            break
    return now


def train(rows: DataFrame, names: tuple[str, ...], label: str = "target", key: str = "skin_id", folds: int = 0, settings: Settings = Settings()) -> tuple[list[Model], DataFrame]:
    """One model, or one for each of ``folds`` trained on the other folds; and the blocks with all margins.

    A row's fold, and whether a round takes it, follow from its key by hash. Rows without a label take no part; missing
    features count as 0. A margin starts from the mean label of the model's training rows.
    """
    s, features = settings, len(names)
    known = rows.where(F.col(label).isNotNull())
    fold = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(42)), F.lit(max(folds, 1))).cast("int")
    sums = {r.fold: (r.y, r.n) for r in known.groupBy(fold.alias("fold")).agg(F.sum(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).alias("n")).collect()}
    out_of: list[int | None] = list(range(folds)) if folds else [None]
    mean = lambda out: sum(y for f, (y, _) in sums.items() if f != out) / max(1, sum(n for f, (_, n) in sums.items() if f != out))
    base = [mean(f) for f in out_of]
    bounds = bin_bounds(known, names, s.bins)
    layout, count = Layout.of(bounds), sum(n for _, n in sums.values())
    tasks = max(1, -(-count // MOST_ROWS), min(-(-count // LEAST_ROWS), rows.sparkSession.sparkContext.defaultParallelism))
    blocks = kept(blocks_of(known.repartition(tasks), names, label, key, folds, bounds, base), "boosting-blocks")
    draw, done, trees, held, stale = random.Random(s.seed), [], [], _held(blocks), []
    for round_ in range(s.rounds):
        use = sorted(draw.sample(range(features), max(1, round(s.feature_share * features))))
        now = _grown(held, out_of, round_, use, layout, s)
        trees.append(now)
        done.append(now)
        before = held
        if len(done) == KEPT_ROUNDS or round_ == s.rounds - 1:
            old, blocks, done = blocks, _written(blocks, done, layout, len(out_of), s), []
            held = _held(blocks)
            discard(old)
        else:
            held = held.map(lambda row, now=now: _advance(row, [now], layout, len(out_of), s)).persist(StorageLevel.MEMORY_AND_DISK)
        stale.append(before)
        if len(stale) > 1:  # the one before is what the new one is made of
            stale.pop(0).unpersist()
    for rdd in stale:
        rdd.unpersist()
    held.unpersist()
    return [Model(tuple(names), bounds, b, s.step, s.depth, tuple(t[m] for t in trees)) for m, b in enumerate(base)], blocks


def held_out(blocks: DataFrame, features: int, folds: int) -> DataFrame:
    """(key, fold, y, prediction) of every row, predicted by the model that did not see its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                of = lambda name, kind: np.frombuffer(row[name], kind)
                own = of("folds", "<i4")
                yield pa.record_batch({"key": of("keys", "<i8"), "fold": own, "y": of("y", "<f8"), "prediction": of("margins", "<f8").reshape(folds, -1)[own, np.arange(row["n"])]})

    return blocks.mapInArrow(run, "key long, fold int, y double, prediction double")
