"""Classification trees and bagged forests of them, on binned rows.

Numbers are binned at quantiles, and rows live in blocks, a few thousand to a Spark row. While a node has
more than ``LOCAL_ROWS`` rows, a pass over all blocks adds up class weights by (tree, node, feature, bin) in
each task; a shuffle by (tree, node) adds up tasks and finds the split with the best Gini gain. A smaller node
goes with its rows to one task, by one shuffle, which grows all that is below it. So a row is
shuffled once for each tree, and passes grow with the depth at which nodes are still large, not
with the number of nodes.

A split needs a gain, and ``min_leaf`` rows on both sides. A tree of a forest has a Poisson number of
copies of each row and looks at ``sqrt(features)`` features, drawn for each node. The class shares of leaves
are added up over trees. Ties between splits go to the first feature and bin, between classes to
the first. A missing value goes right.
"""

from __future__ import annotations

import base64
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.operators.boosting import binned, quantile_edges

#: Rows of a node, with copies, up to which one task grows what is below it; as often for a forest as it
#: has trees to a ``LOCAL_TREES``, as many trees keep all tasks busy with larger nodes.
LOCAL_ROWS = 50_000
LOCAL_TREES = 10
#: Tasks at most that grow small nodes.
LOCAL_TASKS = 1_000
_STATE = "block long, bins binary, label binary, weight binary"
_SUMS = "tree int, node int, sums binary"
_BEST = "tree int, node int, feature int, cut int, left binary, right binary"
_ROWS = "tree int, node int, bins binary, label binary, weight binary, copies binary"
_GROWN = "tree int, node int, feature binary, cut binary, left binary, weights binary"


class Nodes:
    """A tree in arrays. A node's children are ``left`` and the one after it; a leaf has feature -1.

    ``stats`` holds a node's weight by class, and its rows at the end.
    """

    def __init__(self, stats: np.ndarray):
        self.feature, self.cut, self.left, self.stats = [-1], [0], [0], [stats]

    def split(self, node: int, feature: int, cut: int, sides: list[np.ndarray]) -> list[int]:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for stats in sides:
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.stats.append(stats)
        return [len(self.feature) - 2, len(self.feature) - 1]

    def frozen(self) -> tuple[np.ndarray, ...]:
        kinds = (np.int16, np.int16, np.int32)
        arrays = (np.array(x, dtype=k) for x, k in zip((self.feature, self.cut, self.left), kinds, strict=True))
        return (*arrays, np.array(self.stats, dtype=np.float64))


def walked(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node in which each row ends."""
    node, flat, width = np.zeros(len(bins), dtype=np.int64), bins.ravel(), bins.shape[1]
    rows, at = np.arange(len(bins)), node
    while len(rows):
        f = feature.take(at)
        inner = f >= 0
        if not inner.all():
            node[rows[~inner]] = at[~inner]
            rows, at, f = rows[inner], at[inner], f[inner]
        at = left.take(at) + (flat.take(rows * width + f) > cut.take(at))
    return node


@dataclass(frozen=True)
class _Limits:
    sizes: list[int]
    n_classes: int
    min_leaf: int
    max_depth: int
    #: Features that a node looks at.
    looked_at: int
    seed: int
    bagged: bool
    weighted: bool = True

    @property
    def bin_kind(self) -> type:
        return np.uint8 if max(self.sizes) <= 256 else np.uint16

    @property
    def label_kind(self) -> type:
        return np.uint8 if self.n_classes <= 256 else np.int32

    def looks(self, *key: int, n: int = 1) -> np.ndarray:
        """Which features each of ``n`` nodes looks at."""
        if self.looked_at >= len(self.sizes):
            return np.ones((n, len(self.sizes)), dtype=bool)
        place = np.random.default_rng([self.seed, 1, *key]).random((n, len(self.sizes))).argsort(axis=1).argsort(axis=1)
        return place < self.looked_at

    def copies(self, tree: int, block: int, n: int) -> np.ndarray:
        if not self.bagged:
            return np.ones(n, dtype=np.uint8)
        return np.random.default_rng([self.seed, 0, tree, block]).poisson(1.0, n).astype(np.uint8)

    def closed(self, stats: np.ndarray, depth: int) -> bool:
        """Whether a node cannot be split: its depth, its rows, or a single class."""
        return depth >= self.max_depth or stats[-1] < 2 * self.min_leaf or np.count_nonzero(stats[:-1]) < 2


def _gains(left: np.ndarray, total: np.ndarray, min_leaf: int) -> np.ndarray:
    """Gini gains, times the weight, of sides ``left`` of ``total``; minus infinity where a side is too small."""

    def score(part: np.ndarray) -> np.ndarray:
        return (part[:, :-1] ** 2).sum(axis=1) / np.maximum(part[:, :-1].sum(axis=1), 1e-300)

    right = total - left
    gain = score(left) + score(right) - score(total)
    return np.where(np.minimum(left[:, -1], right[:, -1]) >= min_leaf, gain, -np.inf)


def _added(slot: np.ndarray, bins: np.ndarray, label: np.ndarray, weight: np.ndarray, copies: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """[slot, bin, class weights and rows] of one feature."""
    n, size, classes = shape
    at = slot * size + bins
    out = np.empty((n * size, classes + 1))
    out[:, :-1] = np.bincount(at * classes + label, weight, n * size * classes).reshape(-1, classes)
    out[:, -1] = np.bincount(at, copies, n * size)
    return out.reshape(n, size, classes + 1)


def _cells(key: np.ndarray, n_keys: int, label: np.ndarray, weight: np.ndarray, copies: np.ndarray | None, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys with rows, in order, and [class weights and rows, key] of each; ``weight`` counts rows without ``copies``."""
    seen = np.zeros(n_keys, dtype=bool)
    seen[key] = True
    keys = np.flatnonzero(seen)
    place = np.empty(n_keys, dtype=np.int64)
    place[keys] = np.arange(len(keys))
    cell, n = place.take(key), len(keys)
    sums = np.empty((n_classes + 1, n))
    sums[:-1] = np.bincount(label * n + cell, weight, n_classes * n).reshape(n_classes, n)
    sums[-1] = sums[:-1].sum(axis=0) if copies is None else np.bincount(cell, copies, n)
    return keys, sums


def _best_cells(keys: np.ndarray, sums: np.ndarray, total: np.ndarray, n_bins: int, min_leaf: int) -> tuple[np.ndarray, ...]:
    """Slots with rows, and the gain, bin and left side of the best split of each."""
    slot, own = np.divmod(keys, n_bins)
    first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    length = np.diff(np.r_[first, len(slot)])
    left = np.cumsum(sums, axis=1)
    left -= np.repeat(np.concatenate([np.zeros((len(left), 1)), left[:, first[1:] - 1]], axis=1), length, axis=1)
    found = slot[first]
    whole = total[:, found]
    base = (whole[:-1] ** 2).sum(axis=0) / np.maximum(whole[:-1].sum(axis=0), 1e-300)
    whole = np.repeat(whole, length, axis=1)
    right = whole - left
    gain = np.square(left[:-1]).sum(axis=0) / np.maximum(left[:-1].sum(axis=0), 1e-300)
    gain += np.square(right[:-1]).sum(axis=0) / np.maximum(right[:-1].sum(axis=0), 1e-300)
    gain -= np.repeat(base, length)
    gain[np.minimum(left[-1], right[-1]) < min_leaf] = -np.inf
    top = np.maximum.reduceat(gain, first)
    hit = np.flatnonzero(gain == np.repeat(top, length))
    hit = hit[np.r_[True, slot[hit[1:]] != slot[hit[:-1]]]]
    return found, top, own[hit], left[:, hit]


def grown(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, copies: np.ndarray, limits: _Limits, depth: int, key: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """All that is below a node at ``depth``, level by level, as ``Nodes.frozen`` has it. ``weight`` has the copies in it."""
    n_bins, classes = max(limits.sizes), limits.n_classes
    total = np.append(np.bincount(label, weight, classes), copies.sum())[:, None]
    stats, links, size = [total.T], [], 1
    label = label.astype(np.int64)
    many = None if np.array_equal(weight, copies) else copies
    flat, width = bins.ravel(), bins.shape[1]
    slot, rows, open_ = np.zeros(len(label), dtype=np.int64), np.arange(len(label)), np.zeros(1, dtype=np.int64)
    if limits.closed(total[:, 0], depth):
        open_ = open_[:0]
    while len(open_):
        n = len(open_)
        # The features that each node looks at, in order.
        looks = np.nonzero(limits.looks(*key, depth, n=n))[1].reshape(n, -1)
        best, feature, cut, sides = np.zeros(n), np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros_like(total)
        y, w, c, start = label[rows], weight[rows], None if many is None else many[rows], slot * n_bins
        at = rows * width
        for f in looks.T:
            keys, sums = _cells(start + flat.take(at + f.take(slot)), n * n_bins, y, w, c, classes)
            own, gain, b, left = _best_cells(keys, sums, total, n_bins, limits.min_leaf)
            better = gain > best[own] + 1e-9
            own = own[better]
            best[own], feature[own], cut[own], sides[:, own] = gain[better], f[own], b[better], left[:, better]
        split = np.flatnonzero(feature >= 0)
        below = np.empty((len(total), len(split), 2))
        below[:, :, 0], below[:, :, 1] = sides[:, split], total[:, split] - sides[:, split]
        below = below.reshape(len(total), -1)
        children = size + np.arange(below.shape[1])
        links.append((open_[split], feature[split], cut[split], children[::2]))
        stats.append(below.T)
        size, depth = size + len(children), depth + 1
        alive = (below[-1] >= 2 * limits.min_leaf) & (np.count_nonzero(below[:-1], axis=0) > 1) & (depth < limits.max_depth)
        to = np.full((n, 2), -1)
        to[split] = np.where(alive, np.cumsum(alive) - 1, -1).reshape(-1, 2)
        moved = to.ravel().take(2 * slot + (flat.take(at + feature.take(slot)) > cut.take(slot)))
        kept = np.flatnonzero(moved >= 0)
        slot, open_, total = moved[kept], children[alive], below[:, alive]
        # Rows of a node lie together, so that counting stays in the cache.
        order = np.argsort(slot.astype(np.uint16) if len(open_) < 1 << 16 else slot, kind="stable")
        rows, slot = rows[kept[order]], slot[order]
    parts = [np.full(size, -1, dtype=np.int16), np.zeros(size, dtype=np.int16), np.zeros(size, dtype=np.int32)]
    for node, *values in links:
        for part, value in zip(parts, values, strict=True):
            part[node] = value
    return (*parts, np.concatenate(stats))


# Passes --------------------------------------------------------------------------


def _first_state(edges: list[np.ndarray], limits: _Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                values = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
                bins, label = binned(values, edges, limits.sizes), batch["label"].to_numpy()
                parts = bins.astype(limits.bin_kind), label.astype(limits.label_kind), batch["weight"].to_numpy()
                columns = [pa.array([block], pa.int64()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "bins", "label", "weight"])
                block += 1

    return run


def _blocks(batches: Iterator[pa.RecordBatch], limits: _Limits) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in batch.to_pylist():
            bins = np.frombuffer(row["bins"], dtype=limits.bin_kind).reshape(-1, len(limits.sizes))
            yield row["block"], bins, np.frombuffer(row["label"], dtype=limits.label_kind), np.frombuffer(row["weight"])


def _reached(blocks: list, tree: int, nodes: tuple, open_: list[int], limits: _Limits) -> Iterator[tuple]:
    """Rows of the open nodes, block by block: (slot, bins, label, weight with copies, copies)."""
    slots = np.full(len(nodes[0]), -1)
    slots[open_] = np.arange(len(open_))
    for block, bins, label, weight in blocks:
        copies = limits.copies(tree, block, len(label))
        slot = slots[walked(bins, *nodes[:3])]
        used = np.flatnonzero((slot >= 0) & (copies > 0))
        yield slot[used], bins[used], label[used], weight[used] * copies[used], copies[used]


def _histograms(trees: dict[int, tuple], open_: dict[int, list[int]], limits: _Limits):
    starts = np.cumsum([0, *limits.sizes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = list(_blocks(batches, limits))
        for tree, nodes in trees.items():
            looks = np.concatenate([limits.looks(tree, node) for node in open_[tree]])
            parts = [np.concatenate(x) for x in zip(*_reached(blocks, tree, nodes, open_[tree], limits), strict=True)]
            if not parts or not len(parts[0]):
                continue
            slot, bins, label, weight, copies = parts
            sums = np.zeros((len(looks), starts[-1], limits.n_classes + 1))
            for f, size in enumerate(limits.sizes):
                used = np.flatnonzero(looks[:, f].take(slot))
                own = slot[used], bins[used, f], label[used], weight[used], copies[used]
                sums[:, starts[f] : starts[f + 1]] = _added(*own, (len(looks), size, limits.n_classes))
            kept = [sums[i, np.repeat(looks[i], limits.sizes)].tobytes() for i in range(len(looks))]
            columns = [pa.array([tree] * len(looks), pa.int32()), pa.array(open_[tree], pa.int32()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "node", "sums"])

    return run


def _best(limits: _Limits):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tree, node = (x.as_py() for x in key)
        sums = sum(np.frombuffer(s) for s in rows["sums"].to_pylist()).reshape(-1, limits.n_classes + 1)
        best, feature, cut, sides, at = 1e-9, -1, 0, None, 0
        for f in np.flatnonzero(limits.looks(tree, node)[0]):
            own = sums[at : at + limits.sizes[f]]
            at += limits.sizes[f]
            left, total = np.cumsum(own, axis=0)[:-1], own.sum(axis=0)
            gain = _gains(left, np.broadcast_to(total, left.shape), limits.min_leaf)
            if len(gain) and gain.max() > best:
                b = int(gain.argmax())
                best, feature, cut, sides = gain[b], int(f), b, (left[b].tobytes(), (total - left[b]).tobytes())
        sides = sides or (total.tobytes(), b"")
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        columns = [pa.array([v], t) for v, t in zip((tree, node, feature, cut, *sides), kinds, strict=True)]
        return pa.table(columns, names=["tree", "node", "feature", "cut", "left", "right"])

    return run


def _rows_of(trees: dict[int, tuple], open_: dict[int, list[int]], limits: _Limits):
    """The rows of small nodes, a packed row for each node and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = list(_blocks(batches, limits))
        for tree, nodes in trees.items():
            parts = [np.concatenate(x) for x in zip(*_reached(blocks, tree, nodes, open_[tree], limits), strict=True)]
            if not parts or not len(parts[0]):
                continue
            order = np.argsort(parts[0], kind="stable")
            slot, *kept = (p[order] for p in parts)
            starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            found = [open_[tree][s] for s in slot[starts]]
            bounds = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(slot)], strict=True)]
            columns = [pa.array([tree] * len(found), pa.int32()), pa.array(found, pa.int32())]
            if not limits.weighted:
                kept[2] = np.zeros(0)
            columns += [pa.array([p[b].tobytes() for b in bounds], pa.binary()) for p in kept]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "node", "bins", "label", "weight", "copies"])

    return run


def _narrow(weights: np.ndarray) -> np.ndarray:
    """In half the bytes, if that loses nothing."""
    half = weights.astype(np.float32)
    return half if np.array_equal(half, weights) else weights


def _grown(depths: dict[tuple[int, int], int], limits: _Limits):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        key = tuple(x.as_py() for x in key)
        kinds = {"bins": limits.bin_kind, "label": limits.label_kind, "weight": np.float64, "copies": np.uint8}
        bins, label, weight, copies = (np.frombuffer(b"".join(rows[c].to_pylist()), dtype=k) for c, k in kinds.items())
        # Without row weights, a row weighs as much as it has copies.
        weight = weight if limits.weighted else copies.astype(np.float64)
        *links, stats = grown(bins.reshape(-1, len(limits.sizes)), label, weight, copies, limits, depths[key], key)
        below = *links, _narrow(stats[links[0] < 0, :-1])
        columns = [pa.array([k], pa.int32()) for k in key] + [pa.array([x.tobytes()], pa.binary()) for x in below]
        return pa.table(columns, names=["tree", "node", "feature", "cut", "left", "weights"])

    return run


# Estimator -------------------------------------------------------------------------


class GrownTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Class probabilities and the most probable position; trees and bin edges are a parameter."""

    payload = Param(Params._dummy(), "payload", "trees and bin edges, packed")

    @keyword_only
    def __init__(self, *, payload: str | None = None):
        super().__init__()
        if payload is not None:
            self._set(payload=payload)

    def _parts(self) -> tuple[list[np.ndarray], list[tuple[np.ndarray, ...]]]:
        """Bin edges of each feature; of each tree feature, cut, left and the class weights of leaves, at ``left``."""
        with np.load(io.BytesIO(base64.b64decode(self.getOrDefault(self.payload)))) as packed:
            parts = dict(packed)
        edges = np.split(parts["edges"], np.cumsum(parts["n_edges"])[:-1])
        at, leaves = np.cumsum(parts["sizes"])[:-1], np.cumsum(parts["leaves"])[:-1]
        of_nodes = [np.split(parts[n], at) for n in ("feature", "cut", "left")]
        return edges, list(zip(*of_nodes, np.split(parts["shares"], leaves), strict=True))

    @property
    def node_counts(self) -> list[int]:
        return [len(tree[0]) for tree in self._parts()[1]]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        edges, trees = self._parts()
        sizes, n_classes = [len(e) + 1 for e in edges], trees[0][3].shape[1]

        @F.arrow_udf("array<double>")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                bins = binned(batch.flatten().to_numpy().reshape(len(batch), len(sizes)), edges, sizes)
                total = np.zeros((len(batch), n_classes))
                for feature, cut, left, weights in trees:
                    own = weights[left[walked(bins, feature, cut, left)]].astype(np.float64)
                    total += own / np.maximum(own.sum(axis=1, keepdims=True), 1e-300)
                ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * n_classes)
                yield pa.ListArray.from_arrays(ends, pa.array((total / len(trees)).ravel()))

        found = dataset.withColumn("__chances", scored(vector_to_array("features")))
        best = (F.array_position("__chances", F.array_max("__chances")) - 1).cast("double")
        return found.withColumns({"probability": array_to_vector("__chances"), "prediction": best}).drop("__chances")


@dataclass(frozen=True)
class GrownTrees:
    """Settings of a tree, or of a forest if ``bagged``; ``fit`` takes (features, label_position[, weight])."""

    trees: int = 1
    max_depth: int = 20
    min_leaf: int = 50
    max_bins: int = 255
    seed: int = 42
    bagged: bool = False
    weighted: bool = False

    def fit(self, vectors: DataFrame) -> GrownTreesModel:
        weight = F.col("weight").cast("double") if self.weighted else F.lit(1.0)
        rows = vectors.select(
            vector_to_array("features").alias("x"), F.col("label_position").cast("int").alias("label"), weight.alias("weight")
        )
        n_features, n_classes = rows.agg(F.max(F.size("x")), F.max("label") + 1).first()
        edges = quantile_edges(rows, list(range(n_features)), self.max_bins)
        sizes = [len(e) + 1 for e in edges]
        looked_at = math.ceil(math.sqrt(n_features)) if self.bagged else n_features
        limits = _Limits(sizes, n_classes, self.min_leaf, self.max_depth, looked_at, self.seed, self.bagged, self.weighted)
        state = rows.mapInArrow(_first_state(edges, limits), _STATE).persist()
        try:
            trees, small = self._large(state, limits, rows.count())
            below = self._below(state, trees, small, limits)
        finally:
            state.unpersist()
        return self._model(trees, below, edges)

    def _large(self, state: DataFrame, limits: _Limits, n_rows: int) -> tuple[list[Nodes], dict[int, dict[int, int]]]:
        """The trees down to small nodes, and of each tree these nodes with their depths."""
        unknown = np.append(np.ones(limits.n_classes), n_rows)
        trees, small = [Nodes(unknown) for _ in range(self.trees)], {}
        local = LOCAL_ROWS * max(1, self.trees // LOCAL_TREES)
        if n_rows <= local:
            return trees, {t: {0: 0} for t in range(self.trees)}
        open_, depth = {t: [0] for t in range(self.trees)}, 0
        while open_:
            sums = state.mapInArrow(_histograms({t: trees[t].frozen() for t in open_}, open_, limits), _SUMS)
            found = sums.groupBy("tree", "node").applyInArrow(_best(limits), _BEST).collect()
            depth, next_ = depth + 1, {}
            for row in sorted(found, key=lambda r: (r["tree"], r["node"])):
                if row["feature"] < 0:
                    trees[row["tree"]].stats[row["node"]] = np.frombuffer(row["left"])
                    continue
                sides = [np.frombuffer(row[side]) for side in ("left", "right")]
                for child, stats in zip(trees[row["tree"]].split(row["node"], row["feature"], row["cut"], sides), sides, strict=True):
                    if limits.closed(stats, depth):
                        continue
                    if stats[-1] > local:
                        next_.setdefault(row["tree"], []).append(child)
                    else:
                        small.setdefault(row["tree"], {})[child] = depth
            open_ = next_
        return trees, small

    def _below(self, state: DataFrame, trees: list[Nodes], small: dict[int, dict[int, int]], limits: _Limits) -> dict[int, dict[int, tuple]]:
        """What is below each small node."""
        depths = {(t, n): d for t, nodes in small.items() for n, d in nodes.items()}
        if not depths:
            return {}
        open_ = {t: list(nodes) for t, nodes in small.items()}
        rows = state.mapInArrow(_rows_of({t: trees[t].frozen() for t in open_}, open_, limits), _ROWS)
        placed = rows.repartition(min(len(depths), LOCAL_TASKS), "tree", "node")
        out: dict[int, dict[int, tuple]] = {}
        for row in placed.groupBy("tree", "node").applyInArrow(_grown(depths, limits), _GROWN).collect():
            feature, cut = (np.frombuffer(row[n], dtype=np.int16) for n in ("feature", "cut"))
            left, leaves = np.frombuffer(row["left"], dtype=np.int32), np.count_nonzero(feature < 0)
            narrow = len(row["weights"]) == 4 * leaves * limits.n_classes
            weights = np.frombuffer(row["weights"], dtype=np.float32 if narrow else np.float64).reshape(leaves, -1)
            out.setdefault(row["tree"], {})[row["node"]] = feature, cut, left, weights
        return out

    @staticmethod
    def _model(trees: list[Nodes], below: dict[int, dict[int, tuple]], edges: list[np.ndarray]) -> GrownTreesModel:
        parts = []
        for t, tree in enumerate(trees):
            feature, cut, left, stats = ([x] for x in tree.frozen())
            at, leaf_of = len(feature[0]), [np.zeros(len(feature[0]), dtype=np.int32)]
            weights, n_leaves = [], 0
            for node, (f, c, l, w) in sorted(below.get(t, {}).items()):
                # Its root takes the small node's place, the others follow behind.
                moved = np.where(f >= 0, l + (at - 1), 0).astype(np.int32)
                place = np.where(f < 0, n_leaves + np.cumsum(f < 0) - 1, 0).astype(np.int32)
                feature[0][node], cut[0][node], left[0][node], leaf_of[0][node] = f[0], c[0], moved[0], place[0]
                for to, own in ((feature, f), (cut, c), (left, moved), (leaf_of, place)):
                    to.append(own[1:])
                at, n_leaves = at + len(f) - 1, n_leaves + len(w)
                weights.append(w)
            # Leaves that no task has grown.
            own = np.setdiff1d(np.flatnonzero(feature[0] < 0), list(below.get(t, {})))
            leaf_of[0][own] = n_leaves + np.arange(len(own))
            weights.append(_narrow(stats[0][own, :-1]))
            feature, cut, left, leaf_of, weights = (np.concatenate(x) for x in (feature, cut, left, leaf_of, weights))
            parts.append((feature, cut, np.where(feature < 0, leaf_of, left), weights))
        packed = io.BytesIO()
        np.savez_compressed(
            packed, edges=np.concatenate(edges), n_edges=np.array([len(e) for e in edges]),
            sizes=np.array([len(p[0]) for p in parts]), leaves=np.array([len(p[3]) for p in parts]),
            **{n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(("feature", "cut", "left", "shares"))},
        )
        return GrownTreesModel(payload=base64.b64encode(packed.getvalue()).decode())
