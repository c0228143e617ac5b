"""Extremely randomized trees, grown level by level over the rows where they lie.

Every tree sees every row. A node draws one cut for each feature, uniform between the least and the greatest value of its
rows, and splits at the cut with the best gain. A level takes two passes over the rows: the first finds each node's bounds,
the second the sums of targets left of each cut. Rows are routed through the trees so far inside their task and leave it
only as bounds and sums, which are merged by node in a shuffle; the merging tasks choose the splits. Nodes of a level are
taken in blocks, so that a task's sums have a fixed size whatever the data and the budget.

A cut comes from a digest of (seed, node, feature), and nodes are numbered level by level in order, so equal rows give
equal trees however they are partitioned, up to the order of floating additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ramplake.operators.chunks import cut_lineage

#: Sums that one task holds for a block of nodes, and (row, tree) pairs that it handles at once.
SUMS, PAIRS = 4_000_000, 200_000


@dataclass
class Trees:
    """Nodes of all trees, level by level; node t is the root of tree t. A leaf's feature is -1; a row whose feature is
    above the cut goes to the node after `left`, any other, one that misses the feature too, to `left`."""

    n_trees: int
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    tree: np.ndarray
    count: np.ndarray
    sums: np.ndarray

    def route(self, x: np.ndarray, trees: slice = slice(None)) -> np.ndarray:
        """The node of each row in each tree, rows x trees."""
        roots = np.arange(self.n_trees)[trees]
        at = np.broadcast_to(roots, (len(x), len(roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return at
            right = x[rows, np.maximum(feature, 0)] > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)

    def means(self, x: np.ndarray) -> np.ndarray:
        """Mean target of a row's leaves, averaged over the trees."""
        total = np.zeros((len(x), self.sums.shape[1]))
        for t in range(self.n_trees):
            leaf = self.route(x, slice(t, t + 1))[:, 0]
            total += self.sums[leaf] / self.count[leaf, None]
        return total / self.n_trees


def uniform(seed: int, nodes: np.ndarray, features: int) -> np.ndarray:
    """A number in [0, 1) for each node and feature."""
    x = nodes.astype(np.uint64)[:, None] * np.uint64(features) + np.arange(features, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(float) / 2**53


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of doubles, missing values as NaN."""
    flat = column.flatten().cast(pa.float64()).fill_null(np.nan)
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def by_node(model: Trees, x: np.ndarray, first: int, slots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows sorted by the slots of the nodes they are in (node first + k has slot slots[k], below zero if not wanted), a few
    trees at a time: row numbers, starts of the slots' blocks, the slots."""
    step = max(1, PAIRS // max(1, len(x)))
    for t in range(0, model.n_trees, step):
        at = model.route(x, slice(t, t + step)) - first
        slot = np.where((at >= 0) & (at < len(slots)), slots[np.clip(at, 0, len(slots) - 1)], -1)
        row, _ = np.nonzero(slot >= 0)
        slot = slot[slot >= 0]
        if len(slot):
            order = np.argsort(slot, kind="stable")
            starts = np.flatnonzero(np.diff(slot[order], prepend=-1))
            yield row[order], starts, slot[order][starts]


def merged(rows: DataFrame, local, combine, finish, fields: list[str]) -> dict[str, np.ndarray]:
    """Per-task results (slot, values) of `local`, merged by slot with `combine` in as many tasks as there are partitions and
    finished there: what `finish` returns for each slot, by slot."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, values = local(batches)
        for k in range(0, len(slots), 1000):
            yield pa.record_batch([pa.array(slots[k : k + 1000], pa.int64()), pa.array([v.tobytes() for v in values[k : k + 1000]], pa.binary())], ["slot", "v"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = np.frombuffer(raw)
                held[slot] = combine(held[slot], value) if slot in held else value
        if held:
            slots = np.array(list(held))
            done = finish(slots, np.stack(list(held.values())))
            yield pa.record_batch([pa.array(slots), *(pa.array(list(v)) for v in done)], ["slot", *(f.split()[0] for f in fields)])

    parts = rows.mapInArrow(partial, "slot long, v binary").repartition(tasks, "slot")
    table = parts.mapInArrow(reduce, ", ".join(["slot long", *fields])).toArrow().sort_by("slot")
    return {name: np.array(table[name].to_pylist()) for name in table.column_names}


def grow(train: DataFrame, target: str, *, x: str = "x", trees: int = 150, depth: int = 16, leaf: int = 32, seed: int = 41) -> Trees:
    """Trees on the features `x` (array) for the targets `target` (array, one-hot for classes).

    A node is a leaf at `depth`, with fewer than two times `leaf` rows, with equal targets, or where no drawn cut leaves
    `leaf` rows on both sides. Rows with a missing array or a missing target count for nothing; a missing feature goes left.
    Without rows an error is raised.
    """
    if trees < 1 or depth < 1 or leaf < 1:
        raise ValueError("trees, depth and leaf must be positive")
    rows = train.select(F.col(x).cast("array<double>").alias("x"), F.col(target).cast("array<double>").alias("t"))
    rows = cut_lineage(rows.filter("x IS NOT NULL AND t IS NOT NULL AND NOT exists(t, v -> v IS NULL)"))
    head = rows.first()
    if head is None:
        raise ValueError("no rows to grow trees on")
    d, m = len(head["x"]), len(head["t"])
    model = Trees(trees, np.full(trees, -1), np.zeros(trees), np.zeros(trees, int), np.zeros(trees, int), np.arange(trees), np.zeros(trees), np.zeros((trees, m)))
    room = max(1, SUMS // (d * (m + 1)))
    first, level = 0, 0
    while first < len(model.feature):
        frontier = np.arange(first, len(model.feature))
        found = [level_of(rows, model, block, d, m, leaf, seed, level < depth) for block in np.array_split(frontier, -(-len(frontier) // room))]
        feature, cut, count, sums, left_count, left_sums = (np.concatenate(part) for part in zip(*found))
        model.count[frontier], model.sums[frontier] = count, sums
        split = frontier[feature >= 0]
        children = len(model.feature) + 2 * np.arange(len(split))
        model.feature[frontier], model.cut[frontier] = feature, cut
        model.left[split] = children
        first, level = len(model.feature), level + 1
        fresh = 2 * len(split)
        model.feature, model.cut = np.append(model.feature, np.full(fresh, -1)), np.append(model.cut, np.zeros(fresh))
        model.left, model.depth = np.append(model.left, np.zeros(fresh, int)), np.append(model.depth, np.full(fresh, level))
        model.tree = np.append(model.tree, np.repeat(model.tree[split], 2))
        # the children's sums are those of their rows, known already
        lc, ls = left_count[feature >= 0], left_sums[feature >= 0]
        both = np.stack([lc, count[feature >= 0] - lc], 1).reshape(-1)
        model.count = np.append(model.count, both)
        model.sums = np.append(model.sums, np.stack([ls, sums[feature >= 0] - ls], 1).reshape(-1, m), axis=0)
        # a last level has nothing to look for
        if level == depth or not (both >= 2 * leaf).any():
            break
    return model


def level_of(rows: DataFrame, model: Trees, nodes: np.ndarray, d: int, m: int, leaf: int, seed: int, may_split: bool):
    """For each of the neighbouring nodes: feature (-1: a leaf) and cut, rows and sums, and those of the left side."""
    n = len(nodes)
    count, sums = model.count[nodes], model.sums[nodes]
    whole = nodes[0] < model.n_trees  # roots: their sums are not known yet
    wanted = np.flatnonzero((count >= 2 * leaf) | whole) if may_split else np.empty(0, int)
    slots = np.full(n, -1)
    slots[wanted] = np.arange(len(wanted))
    feature, cut = np.full(n, -1), np.zeros(n)
    left_count, left_sums = np.zeros(n), np.zeros((n, m))
    if not len(wanted):
        return feature, cut, count, sums, left_count, left_sums

    def read(batches):
        for batch in batches:
            if batch.num_rows:
                yield matrix(batch.column(0)), matrix(batch.column(1))

    def bounds(batches):
        held = np.full((len(wanted), 2 * d + 1 + m), -np.inf)  # minus the least, the greatest; then rows and sums
        held[:, 2 * d :] = 0
        for x, t in read(batches):
            for row, starts, slot in by_node(model, x, int(nodes[0]), slots):
                values = x[row]
                low = np.fmin.reduceat(values, starts, axis=0)
                high = np.fmax.reduceat(values, starts, axis=0)
                held[slot, :d] = np.fmax(held[slot, :d], -low)
                held[slot, d : 2 * d] = np.fmax(held[slot, d : 2 * d], high)
                held[slot, 2 * d] += np.diff(starts, append=len(row))
                held[slot, 2 * d + 1 :] += np.add.reduceat(t[row], starts, axis=0)
        some = np.flatnonzero(held[:, 2 * d] > 0)
        return some, held[some]

    def join(a, b):
        return np.concatenate([np.fmax(a[: 2 * d], b[: 2 * d]), a[2 * d :] + b[2 * d :]])

    told = merged(rows, bounds, join, lambda s, v: (list(v),), ["v array<double>"])
    at, v = told["slot"], told["v"].reshape(-1, 2 * d + 1 + m)
    low, high = -v[:, :d], v[:, d : 2 * d]
    known_count, known_sums = v[:, 2 * d], v[:, 2 * d + 1 :]
    with np.errstate(invalid="ignore"):
        drawn = low + uniform(seed, nodes[wanted[at]], d) * (high - low)
        drawn = np.where(low < high, drawn, np.inf)  # a constant feature has no cut
    cuts = np.full((len(wanted), d), np.inf)
    cuts[at] = drawn
    totals = np.zeros((len(wanted), m + 1))
    totals[at, 0], totals[at, 1:] = known_count, known_sums

    def left_of(batches):
        held = np.zeros((len(wanted), d, m + 1))
        for x, t in read(batches):
            for row, starts, slot in by_node(model, x, int(nodes[0]), slots):
                goes = ~(x[row] > cuts[np.repeat(slot, np.diff(starts, append=len(row)))])
                held[slot, :, 0] += np.add.reduceat(goes, starts, axis=0, dtype=float)
                for k in range(m):
                    held[slot, :, k + 1] += np.add.reduceat(goes * t[row, k : k + 1], starts, axis=0)
        some = np.flatnonzero(held[:, :, 0].any(axis=1))
        return some, held[some]

    def choose(s, v):
        left = v.reshape(len(s), d, m + 1)
        total = totals[s][:, None, :]
        right = total - left
        valid = (left[:, :, 0] >= leaf) & (right[:, :, 0] >= leaf) & np.isfinite(cuts[s])
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = sum((part[:, :, 1:] ** 2).sum(2) / part[:, :, 0] for part in (left, right)) - (total[:, :, 1:] ** 2).sum(2) / total[:, :, 0]
        gain = np.where(valid, gain, -np.inf)
        best = gain.argmax(axis=1)  # of equals the first feature
        pick = np.arange(len(s))
        good = gain[pick, best] > 1e-12 * np.maximum(1.0, total[:, 0, 0])
        return np.where(good, best, -1), cuts[s][pick, best], left[pick, best, 0], list(left[pick, best, 1:])

    chosen = merged(rows, left_of, lambda a, b: a + b, choose, ["feature long", "cut double", "n double", "sums array<double>"])
    at = wanted[chosen["slot"]]
    feature[at], cut[at] = chosen["feature"], np.where(chosen["feature"] >= 0, chosen["cut"], 0)
    left_count[at], left_sums[at] = chosen["n"], chosen["sums"].reshape(-1, m)
    count, sums = count.copy(), sums.copy()
    count[wanted], sums[wanted] = totals[:, 0], totals[:, 1:]
    return feature, cut, count, sums, left_count, left_sums


def one_hot(label: str, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == F.col(label)).cast("double"))


def predicted(model: Trees, x: str = "x") -> Column:
    """Mean target of the row's leaves over the trees: for one-hot targets class probabilities, zero for unseen classes."""

    @F.pandas_udf("array<double>")
    def means(values: pd.Series) -> pd.Series:
        return pd.Series(list(model.means(np.array(values.tolist(), float).reshape(len(values), -1))))

    return means(F.col(x).cast("array<double>"))


def leaves(model: Trees, x: str = "x") -> Column:
    """The leaf of the row in each tree."""

    @F.pandas_udf("array<long>")
    def routed(values: pd.Series) -> pd.Series:
        return pd.Series(list(model.route(np.array(values.tolist(), float).reshape(len(values), -1))))

    return routed(F.col(x).cast("array<double>"))
