"""Histogram gradient boosting of all folds at once.

Values are binned at quantiles of each fold's training part. A pass over the binned rows sums gradients per (open leaf,
feature, bin) in the map tasks; the sums meet in one shuffle, by leaf and feature, where running sums over the bins give
the gain of every split, and each task sends back its best split of every leaf. Trees are small tables in the driver that travel with the next pass. Gradients are
whole numbers of 1 / SCALE, so sums do not depend on the order of tasks. All folds and classes share each pass.

Three ways to grow a tree: `depth` splits every leaf down to max_depth, `symmetric` gives all leaves of a level the one
split that is best for them together, `leaves` splits the best leaves first until there are num_leaves.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from gradus.plans.ordering import quantile_grid
from gradus.session import written

SCALE = 1 << 24
BINS = 32
ROUNDS = 500
PATIENCE = 20
REFRESH = 10
MOST_CELLS = 1 << 22
MARGIN_LIMIT = 1e6

HIST = "deal bigint, cells binary"  # (slot, feature, bin, g, h, n) of cells, whole numbers
SPLIT = "slot int, feature int, bin int, worth double, gain double, gl bigint, hl bigint, nl bigint, ga bigint, ha bigint, na bigint"
STATE = "fold int, part binary, label binary, bins binary, margins binary"  # up to BLOCK rows of a fold, as bytes
KINDS = (np.uint8, np.float64, np.uint8, np.float64)
TRAIN, VAL = 1, 2
BLOCK = 1 << 12
CHUNK = 1 << 18


@dataclass
class Params:
    """`l1` and `l2` act on leaf weights; a child needs `min_rows` rows and a second derivative of `min_hess`."""

    growth: str = "depth"
    max_depth: int = 5
    num_leaves: int = 512
    step: float = 0.08
    l1: float = 0.0
    l2: float = 1.0
    min_rows: int = 1
    min_hess: float = 0.0
    rounds: int = ROUNDS
    patience: int = PATIENCE

    def __post_init__(self):
        if self.growth not in ("depth", "symmetric", "leaves"):
            raise ValueError(f"no way to grow a tree named {self.growth}")
        if not (0 < self.step < float("inf")) or self.l1 < 0 or self.l2 < 0 or self.rounds < 1:
            raise ValueError("step must be positive, penalties not negative, and a fit has a round at least")


@dataclass
class Tree:
    """Nodes: rows with a value up to edge `bin` of `feature` go left; a leaf has feature -1 and a value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, bin_: int, left: float, right: float) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, bin_, at, at + 1
        for v in (left, right):
            for column, x in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, v), (self.depth, self.depth[node] + 1)):
                column.append(x)
        return at, at + 1

    @property
    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        feature, bin_, left, right = (np.array(x, np.int64) for x in (self.feature, self.bin, self.left, self.right))
        leaf, own = feature < 0, np.arange(len(feature))
        feature[leaf] = 0
        down = np.stack([np.where(leaf, own, left), np.where(leaf, own, right)], axis=1).reshape(-1)  # a leaf leads to itself
        node, cells = np.zeros(len(bins), np.int64), np.ascontiguousarray(bins).reshape(-1)
        first = np.arange(len(bins)) * bins.shape[1]
        for _ in range(max(self.depth)):
            high = cells.take(first + feature.take(node)) > bin_.take(node)
            node = down.take(2 * node + high)
        return node


def soft(g: float, l1: float) -> float:
    return np.sign(g) * max(abs(g) - l1, 0.0)


def leaf_value(g: float, h: float, p: Params) -> float:
    return 0.0 if h + p.l2 <= 0 else float(-p.step * soft(g, p.l1) / (h + p.l2))


def gradients(objective: str, margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second derivative per class, and each row's loss."""
    if objective == "regression":
        d = margins - label[:, None]
        return d, np.ones_like(d), d[:, 0] ** 2
    if objective == "binary":
        p = 1 / (1 + np.exp(-np.clip(margins, -40, 40)))
        own = np.where(label == 1, p[:, 0], 1 - p[:, 0])
        return p - label[:, None], p * (1 - p), -np.log(np.maximum(own, 1e-15))
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    hot = label[:, None] == np.arange(margins.shape[1])
    return p - hot, p * (1 - p), -np.log(np.maximum((p * hot).sum(axis=1), 1e-15))


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the bytes of `data`, cut at its rows `ends`, the first of which is 0."""
    data = np.ascontiguousarray(data)
    size = data.itemsize * int(np.prod(data.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(data.tobytes())])


def _bytes_of(column: pa.Array, kind: type) -> np.ndarray:
    """The values of a _binary column, one row after another, without a Python object each."""
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset:column.offset + len(column) + 1]
    if not len(at) or at[-1] == at[0]:
        return np.zeros(0, kind)
    return np.frombuffer(data, kind, (at[-1] - at[0]) // np.dtype(kind).itemsize, at[0])


def _blocks(fold: np.ndarray, part: np.ndarray, label: np.ndarray, bins: np.ndarray, margins: np.ndarray) -> pa.RecordBatch:
    """STATE of rows."""
    order = np.argsort(fold, kind="stable")
    ends, own = [0], []
    for f, n in zip(*np.unique(fold, return_counts=True)):
        cuts = [*range(BLOCK, n, BLOCK), n]
        own += [f] * len(cuts)
        ends += (ends[-1] + np.array(cuts)).tolist()
    columns = [_binary(c[order], np.array(ends)) for c in (part.astype(np.uint8), label, bins, margins)]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *columns], names=["fold", "part", "label", "bins", "margins"])


def _chunks(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(fold, part, label, bins, margins) of the rows of STATE, about CHUNK of them together; margins may be changed."""
    held, n = [], 0
    for block in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
        part, label, bins, margins = (_bytes_of(block.column(i), kind) for i, kind in enumerate(KINDS, 1))
        size = len(part)
        held.append((np.full(size, block.column(0)[0].as_py()), part, label, bins.reshape(size, -1), margins.reshape(size, classes)))
        n += size
        if n >= CHUNK:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _of_folds(fold: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice]]:
    """Each fold and its rows; a slice where all are of one."""
    found = np.unique(fold).tolist()
    for f in found:
        yield f, slice(None) if len(found) == 1 else np.flatnonzero(fold == f)


def _advance(fold: np.ndarray, bins: np.ndarray, margins: np.ndarray, rounds: list[dict[int, list[Tree]]]) -> None:
    """Adds the values of whole rounds of trees to the margins."""
    for f, rows in _of_folds(fold) if rounds else ():
        mine = bins[rows]
        for trees in rounds:
            for k, tree in enumerate(trees.get(f, ())):
                margins[rows, k] += np.array(tree.value)[tree.nodes_of(mine)]
    np.clip(margins, -MARGIN_LIMIT, MARGIN_LIMIT, out=margins)


def _histograms(shared):
    """Sums per (slot, feature, bin) of a partition; a slot of -1 - fold has the loss of the fold's validation part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        objective, classes, width, bins_at, rounds, growing, slots, deal, losses, dense = shared.value
        n_slots = len(deal)
        total = np.zeros((3, n_slots, width, bins_at))
        loss: dict[int, list[int]] = {}
        for fold, part, label, bins, margins in _chunks(batches, classes):
            _advance(fold, bins, margins, rounds)
            g, h, row_loss = gradients(objective, margins, label)
            place = np.full((len(fold), classes), -1)
            for f, mine in _of_folds(fold):
                if losses:
                    val = part[mine] == VAL
                    one = loss.setdefault(f, [0, 0])
                    one[0] += int(np.rint(np.minimum(row_loss[mine][val], 1e9) * SCALE).sum())
                    one[1] += int(val.sum())
                if f in growing:
                    train, cells = part[mine] == TRAIN, bins[mine]
                    for k, tree in enumerate(growing[f]):
                        place[mine, k] = np.where(train, slots[f][k][tree.nodes_of(cells)], -1)
            for k in range(classes):
                at = np.flatnonzero(place[:, k] >= 0)
                if not len(at):
                    continue
                first, cells = place[at, k] * bins_at, bins[at]
                # a square's second derivative is 1 in every row, so its sums are the counts
                weights = (np.rint(g[at, k] * SCALE), None if objective == "regression" else np.rint(h[at, k] * SCALE), None)
                for j in range(width):
                    cell = first + cells[:, j]
                    for i, w in enumerate(weights):
                        if i != 1 or w is not None:
                            total[i, :, j] += np.bincount(cell, w, n_slots * bins_at).reshape(n_slots, bins_at)
        if objective == "regression":
            total[1] = total[2] * SCALE
        total = total.reshape(3, -1)
        # densely, a slot with rows here has all its cells
        cells = np.flatnonzero(np.repeat(total[2].reshape(n_slots, width * bins_at).any(axis=1), width * bins_at) if dense else total[2])
        table = np.stack([cells // (width * bins_at), cells // bins_at % width, cells % bins_at, *total[:, cells].astype(np.int64)], axis=1)
        dealt = deal[table[:, 0]] * width + table[:, 1] if n_slots else table[:, 0]
        first = np.flatnonzero(np.diff(cells // bins_at, prepend=-1))
        if loss:
            rows = np.array([(-1 - f, -1, 0, s, 0, n) for f, (s, n) in loss.items()], np.int64)
            first = np.append(first, len(table) + np.arange(len(rows)))
            table, dealt = np.concatenate([table, rows]), np.append(dealt, rows[:, 0])
        if len(table):
            yield pa.RecordBatch.from_arrays([pa.array(dealt[first]), _binary(table, np.append(first, len(table)))], names=["deal", "cells"])

    return run


def _gains(sums: np.ndarray, whole: np.ndarray, p: Params) -> np.ndarray:
    """Gain of splits with (g, h, n) `sums` on the left of `whole`, all as whole numbers; NaN where a side is too small."""
    def half(x: np.ndarray) -> np.ndarray:
        g, h = np.maximum(np.abs(x[0]) / SCALE - p.l1, 0.0), x[1] / SCALE + p.l2
        return np.where(h > 0, g * g / np.where(h > 0, h, 1.0), 0.0)

    rest = whole - sums
    able = (np.minimum(sums[2], rest[2]) >= max(1, p.min_rows)) & (np.minimum(sums[1], rest[1]) >= p.min_hess * SCALE)
    return np.where(able, half(sums) + half(rest) - half(whole), np.nan)


def _splits(shared):
    """The best split of each slot, or of each tree if `tree_of` tells the tree of a slot, among the partition's features.

    Rows have the sums left of the split and in all. Ties go to the lower feature, then bin. A leaf that cannot be split
    has a null gain; with trees, all of a tree's leaves have a row and `worth` is their gains' sum.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, tree_of = shared.value
        rows = [_bytes_of(b.column(1), np.int64).copy() for b in batches if b.num_rows]
        if not rows:
            return
        cells = np.ascontiguousarray(np.concatenate(rows).reshape(-1, 6).T)
        cells = cells[:, np.lexsort(cells[2::-1])]
        new = np.flatnonzero(np.append(True, (np.diff(cells[:3]) != 0).any(axis=0)))
        slot, feature, bin_ = cells[:3, new]
        sums = np.add.reduceat(cells[3:], new, axis=1)
        first = np.flatnonzero(np.append(True, (np.diff(slot) != 0) | (np.diff(feature) != 0)))
        size = np.diff(np.append(first, len(slot)))
        whole = np.repeat(np.add.reduceat(sums, first, axis=1), size, axis=1)
        left = np.cumsum(sums, axis=1)
        left -= np.repeat(left[:, first] - sums[:, first], size, axis=1)
        gain = _gains(left, whole, p)
        gain[slot < 0] = np.nan
        group = slot if tree_of is None else np.where(slot < 0, slot, tree_of[np.maximum(slot, 0)])
        worth = np.nan_to_num(gain, nan=-1.0)
        if tree_of is not None:  # one sum per tree, feature and bin, in whole numbers
            units = np.floor(np.nan_to_num(gain) * SCALE).astype(np.int64)
            _, same = np.unique(np.stack([group, feature, bin_]), axis=1, return_inverse=True)
            total = np.zeros(same.max() + 1, np.int64)
            np.add.at(total, same.reshape(-1), units)
            worth = total[same.reshape(-1)] / SCALE
        order = np.lexsort((slot, bin_, feature, -worth, group))
        best = order[np.flatnonzero(np.append(True, np.diff(group[order]) != 0))]
        at = dict(zip(group[best].tolist(), best.tolist()))
        top = np.array([at[x] for x in group.tolist()])
        keep = np.flatnonzero((feature == feature[top]) & (bin_ == bin_[top])) if tree_of is not None else best
        columns = [slot[keep], feature[keep], bin_[keep], worth[keep], gain[keep], *left[:, keep], *whole[:, keep]]
        kinds = [pa.int32()] * 3 + [pa.float64()] * 2 + [pa.int64()] * 6
        names = ["slot", "feature", "bin", "worth", "gain", "gl", "hl", "nl", "ga", "ha", "na"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k, from_pandas=True) for c, k in zip(columns, kinds)], names=names)

    return run


def best_splits(hist: DataFrame, p: Params, tree_of: np.ndarray | None = None) -> dict[int, dict]:
    """The best split of each slot over all features, by slot; see _splits. Parameters bound how many there are."""
    shared = hist.sparkSession.sparkContext.broadcast((p, tree_of))
    rows = hist.repartition("deal").mapInArrow(_splits(shared), SPLIT).collect()
    shared.unpersist()
    best: dict[int, tuple] = {}
    for r in rows:
        group = r.slot if tree_of is None or r.slot < 0 else int(tree_of[r.slot])
        key = (-r.worth, r.feature, r.bin)
        if group not in best or key < best[group]:
            best[group] = key
    out = {}
    for r in rows:
        group = r.slot if tree_of is None or r.slot < 0 else int(tree_of[r.slot])
        if best[group] == (-r.worth, r.feature, r.bin):
            out[r.slot] = r.asDict() | ({} if tree_of is None else {"gain": (r.gain or 0.0) if r.worth > 0 else None})
    for slot, group in enumerate(() if tree_of is None else tree_of.tolist()):
        if slot not in out and group in best:  # a leaf without rows, split as its tree's others are
            worth, feature, bin_ = best[group]
            out[slot] = dict.fromkeys(("gl", "hl", "nl", "ga", "ha", "na"), 0) | {"slot": slot, "feature": feature, "bin": bin_, "worth": -worth, "gain": 0.0 if worth < 0 else None}
    return out


class Booster:
    """Fitted trees of every fold, cut at the round that its validation part liked best."""

    def __init__(self, objective: str, params: Params, classes: int):
        self.objective, self.params, self.classes = objective, params, classes
        self.edges: dict[int, list[np.ndarray]] = {}
        self.start: dict[int, np.ndarray] = {}
        self.scale: dict[int, tuple[float, float]] = {}
        self.rounds: list[dict[int, list[Tree]]] = []
        self.best: dict[int, int] = {}
        self.losses: dict[int, list[float]] = {}

    def transform(self, rows: DataFrame) -> DataFrame:
        """(row_id, fold, part, label, prediction, proba) of assembled rows; proba is null for a regression."""
        kept = [{f: trees for f, trees in r.items() if i < self.best.get(f, 0)} for i, r in enumerate(self.rounds)]
        shared = rows.sparkSession.sparkContext.broadcast((self.edges, self.start, self.scale, kept, self.objective))
        out = "row_id bigint, fold int, part string, label double, prediction double, proba array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges, start, scale, trees, objective = shared.value
            for batch in batches:
                fold, bins, margins = _binned(batch, edges, start)
                _advance(fold, bins, margins, trees)
                proba = None
                if objective == "regression":
                    mean, sd = _scales(fold, scale)
                    prediction = margins[:, 0] * sd + mean
                elif objective == "binary":
                    p = 1 / (1 + np.exp(-np.clip(margins[:, 0], -40, 40)))
                    proba, prediction = np.stack([1 - p, p], axis=1), (p > 0.5).astype(float)
                else:
                    p = np.exp(margins - margins.max(axis=1, keepdims=True))
                    proba = p / p.sum(axis=1, keepdims=True)
                    prediction = proba.argmax(axis=1).astype(float)
                arrays = pa.nulls(len(fold), pa.list_(pa.float64())) if proba is None else pa.ListArray.from_arrays(np.arange(len(fold) + 1, dtype=np.int32) * np.int32(proba.shape[1]), proba.reshape(-1))
                columns = [batch.column(i) for i in range(4)] + [pa.array(prediction), arrays]
                yield pa.RecordBatch.from_arrays(columns, names=["row_id", "fold", "part", "label", "prediction", "proba"])

        return _slim(rows).mapInArrow(run, out)


def _scales(fold: np.ndarray, scale: dict[int, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each row's fold."""
    at = np.unique(fold, return_inverse=True)
    mean, sd = (np.array([scale[f][i] for f in at[0].tolist()]) for i in (0, 1))
    return mean[at[1]], sd[at[1]]


def _slim(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("fold").cast("int").alias("fold"), "part", F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))


def _binned(batch: pa.RecordBatch, edges: dict, start: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fold, bins and first margins of a batch of _slim; a missing value has the last bin."""
    fold, n = batch.column(1).to_numpy(), batch.num_rows
    values = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    bins, margins = np.zeros(values.shape, np.uint8), np.zeros((n, len(next(iter(start.values())))))
    for f in np.unique(fold).tolist():
        rows = fold == f
        margins[rows] = start[f]
        for j, cuts in enumerate(edges[f]):
            bins[rows, j] = np.searchsorted(cuts, values[rows, j], "left")
    return fold, bins, margins


def fit_edges(train: DataFrame, bins: int = BINS) -> dict[int, list[np.ndarray]]:
    """Cut values of each (fold, feature): distinct quantiles of the training part but the largest, `bins` at most."""
    long = train.select("fold", F.posexplode("x").alias("feature", "value")).filter("NOT isnan(value)")
    counts = long.groupBy("fold", "feature", "value").agg(F.count("*").alias("n_rows"))
    grid = quantile_grid(counts, ["fold", "feature"], "value", ["n_rows"], bins + 1, shrink=False).filter("k < m - 1")
    got = grid.select("fold", "feature", "value").distinct().collect()
    width = train.select(F.max(F.size("x"))).first()[0]
    out: dict[int, list[np.ndarray]] = {}
    for r in got:
        out.setdefault(r.fold, [np.zeros(0)] * width)
        out[r.fold][r.feature] = np.append(out[r.fold][r.feature], r.value)
    return {f: [np.unique(c) for c in cuts] for f, cuts in out.items()}


def fit(rows: DataFrame, objective: str, params: Params) -> Booster:
    """Fits a booster on every fold of assembled rows (row_id, fold, part, label, features); labels of classes count from 0."""
    slim = _slim(rows)
    train = slim.filter("part = 'train'")
    label = F.col("label")
    stats = train.groupBy("fold").agg(F.avg(label).alias("m"), F.stddev_pop(label).alias("s"), F.max(label).alias("top")).collect()
    classes = 1 if objective != "classification" else int(slim.agg(F.max("label")).first()[0]) + 1
    model = Booster(objective, params, classes)
    model.edges = fit_edges(train)
    for r in stats:
        model.scale[r.fold] = (r.m, r.s or 1.0)
        p = min(max(r.m, 1e-6), 1 - 1e-6) if objective == "binary" else 0.5
        model.start[r.fold] = np.array([np.log(p / (1 - p)) if objective == "binary" else 0.0])
    if objective == "classification":
        shares = train.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()
        for f in model.scale:
            n = np.full(classes, 1e-3)
            for r in shares:
                if r.fold == f:
                    n[int(r.label)] += r.n
            model.start[f] = np.log(n / n.sum())
    width = max((len(c) for c in model.edges.values()), default=0)
    for f in model.scale:
        model.edges.setdefault(f, [np.zeros(0)] * width)
    _grow(model, _state(slim.filter("part <> 'test'").drop("row_id"), model), width)
    return model


def _state(slim: DataFrame, model: Booster) -> DataFrame:
    shared = slim.sparkSession.sparkContext.broadcast((model.edges, model.start, model.scale, model.objective))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, start, scale, objective = shared.value
        for batch in batches:
            fold, bins, margins = _binned(batch, edges, start)
            label = batch.column(3).to_numpy()
            if objective == "regression":
                mean, sd = _scales(fold, scale)
                label = (label - mean) / sd
            yield _blocks(fold, batch.column(2).to_numpy(), label, bins, margins)

    part = F.when(F.col("part") == "train", TRAIN).when(F.col("part") == "val", VAL).otherwise(0)
    return written(slim.select(F.lit(0), "fold", part.alias("part"), "label", "x").mapInArrow(run, STATE), "boosting", "fold")


def _refreshed(state: DataFrame, model: Booster, rounds: list) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast((rounds, model.classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, classes = shared.value
        for fold, part, label, bins, margins in _chunks(batches, classes):
            _advance(fold, bins, margins, trees)
            yield _blocks(fold, part, label, bins, margins)

    return written(state.mapInArrow(run, STATE), "boosting", "fold")


def _grow(model: Booster, state: DataFrame, width: int) -> None:
    p, pending = model.params, []
    live = sorted(model.scale)
    model.losses = {f: [] for f in live}
    model.best = {f: 0 for f in live}
    bins_at = BINS + 1
    per_pass = max(1, MOST_CELLS // max(1, width * bins_at))

    def one_pass(growing: dict[int, list[Tree]], open_: list[tuple[int, int, int]], losses: bool) -> dict[int, dict]:
        """The best split of each open leaf (fold, class, node), by its number in `open_`; -1 - fold has a loss."""
        slots = {f: [np.full(len(t.feature), -1) for t in trees] for f, trees in growing.items()}
        for s, (f, k, node) in enumerate(open_):
            slots[f][k][node] = s
        trees = np.array([f * model.classes + k for f, k, _ in open_], np.int64)
        deal = trees if p.growth == "symmetric" else np.arange(len(open_))
        shared = state.sparkSession.sparkContext.broadcast((model.objective, model.classes, width, bins_at, pending, growing, slots, deal, losses, p.growth == "symmetric"))
        hist = state.filter(F.col("fold").isin(*live)).mapInArrow(_histograms(shared), HIST)
        found = best_splits(hist, p, trees if p.growth == "symmetric" and open_ else None)
        shared.unpersist()
        return found

    for number in range(p.rounds + 1):
        growing = {f: [Tree() for _ in range(model.classes)] for f in live} if number < p.rounds else {}
        open_ = [(f, k, 0) for f in growing for k in range(model.classes)]
        first = True
        while open_ or first:
            some, later = open_[:per_pass], open_[per_pass:]
            found = one_pass(growing, some, first)
            if first:
                for f in list(live):
                    r = found.get(-1 - f)
                    loss = r["ga"] / SCALE / r["na"] if r and r["na"] else -float(number)  # no validation part: every round is the best
                    model.losses[f].append(loss)
                    if loss < model.losses[f][model.best[f]]:
                        model.best[f] = number
                    elif number - model.best[f] >= p.patience:
                        live.remove(f)
                        growing.pop(f, None)
            first = False
            open_ = later + _split_leaves(p, growing, some, found)
            open_ = [x for x in open_ if x[0] in growing]
        if not live or number == p.rounds:
            return
        model.rounds.append(growing)
        pending.append(growing)
        if len(pending) == REFRESH:
            state, pending = _refreshed(state.filter(F.col("fold").isin(*live)), model, pending), []


def _split_leaves(p: Params, growing: dict, open_: list, found: dict) -> list[tuple[int, int, int]]:
    """Splits open leaves by what a pass found; returns the leaves that are open now."""
    out, ranked = [], []
    for s, (f, k, node) in enumerate(open_):
        r = found.get(s)
        if f not in growing or r is None:
            continue
        tree = growing[f][k]
        if node == 0:
            tree.value[0] = leaf_value(r["ga"] / SCALE, r["ha"] / SCALE, p)
        if r["gain"] is not None and (r["gain"] > 1e-9 or p.growth == "symmetric"):
            ranked.append((-r["gain"], s))
    for _, s in sorted(ranked):
        f, k, node = open_[s]
        r, tree = found[s], growing[f][k]
        if p.growth == "leaves" and tree.leaves >= p.num_leaves:
            continue
        gl, hl, ga, ha = (r[c] / SCALE for c in ("gl", "hl", "ga", "ha"))
        children = tree.split(node, r["feature"], r["bin"], leaf_value(gl, hl, p), leaf_value(ga - gl, ha - hl, p))
        if p.growth == "leaves" or tree.depth[children[0]] < p.max_depth:
            out += [(f, k, c) for c in children]
    return out
