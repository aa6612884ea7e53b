"""Random forests of large tables.

Spark's own forest keeps, for every row, a drawn count and a node of every tree, and adds to the
sums of a node row by row. Here a row is cut to its bins once. Rows are sorted by their bins, so
that rows with the same bins (a cell) stand side by side. How often a tree draws a row (Poisson, as
in Spark's) is a hash of the seed, the tree, the row's bins and target and, of equal rows, their
number, so it does not depend on where a row lies; it is drawn again where it is needed. The sums
of a tree are taken over cells.

Every slot is tried at every node, with the cut of the largest drop in variance, as in Spark's
forest with all features; equal cuts go to the first slot and bin. Cuts lie between all distinct
values of a slot that has at most ``maxBins`` of them, else at exact quantiles. The result is
Spark's own model.

A table whose cells and targets take at most ``WHOLE_BYTES`` goes to all tasks, and a task grows
whole trees; a larger one stays where it is, and a level of all trees costs one aggregate. Both
ways draw the same rows. Tables of at most ``LEAST_ROWS`` rows are Spark's.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.operators.cuts import cut_points, row_table
from estima.operators.ridge import handed

#: Rows up to which Spark's forest is used.
LEAST_ROWS = 100_000
#: Bytes of cells and targets that every task may hold.
WHOLE_BYTES = 64_000_000
#: Trees that share a hash of a row, and rows drawn at a time.
TOGETHER = 4
TILE_ROWS = 32_768
#: Rows of a block; depth up to which trees are arrays in heap order; bytes of sums that a task holds.
BLOCK_ROWS = 1_000_000
MOST_DEPTH = 12
LEVEL_BYTES = 64_000_000
#: A cut must gain more than this part of the squares of all targets.
LEAST_GAIN = 1e-12

_BLOCK = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("before", pa.int64())] + [(n, pa.binary()) for n in ("bins", "counts", "target")])


def left_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of rows x slots; a value on a cut is left of it, as in Spark's trees."""
    out = np.zeros(x.shape, np.uint8 if max(map(len, cuts)) < 256 else np.uint16)
    for s, c in enumerate(cuts):
        out[:, s] = x[:, s] > c[0] if len(c) == 1 else np.searchsorted(c, x[:, s], side="left")
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)


class Block:
    """Rows sorted by their bins and target. ``bins``: slots x cells; ``y``: targets from their mean."""

    def __init__(self, row: dict, slots: int, kind: type, mean: float):
        self.counts = np.frombuffer(row["counts"], np.int32)
        self.bins = np.frombuffer(row["bins"], kind).reshape(slots, len(self.counts))
        self.cell = np.repeat(np.arange(len(self.counts)), self.counts)
        target = np.frombuffer(row["target"])
        self.y = target - mean
        # the number of a row among equal ones; "before": those ahead of the block
        new = np.flatnonzero(np.concatenate([[True], (self.cell[1:] != self.cell[:-1]) | (target[1:] != target[:-1])]))
        again = np.arange(len(target)) - np.repeat(new, np.diff(np.append(new, len(target))))
        again[: new[1] if len(new) > 1 else len(target)] += row["before"]
        h = np.zeros(len(self.counts), np.uint64)
        for b in self.bins:
            h = mix(h * _ODD + b.astype(np.uint64) + np.uint64(1))
        self.key = mix(mix(h[self.cell] ^ mix(target.view(np.uint64))) + again.astype(np.uint64) * _ODD)
        # rows that a core's cache holds, whole cells
        ends = np.cumsum(self.counts)
        at = np.unique(np.searchsorted(ends, np.arange(0, len(target), TILE_ROWS)))
        self.tiles = np.append(at, len(ends)) if len(at) else np.zeros(1, np.int64)
        self.start = np.concatenate([[0], ends])
        self.held = (-1, False, [])

    def drawn(self, seed: int, tree: int, draws: np.ndarray | None, squares: bool = False) -> list[np.ndarray]:
        """Sums of the weights and of weight x target (and x its square) of each cell. ``draws``: see :func:`poisson`."""
        if draws is None:
            y, n = self.y, len(self.counts)
            return [self.counts.astype(float)] + [np.bincount(self.cell, weights=x, minlength=n) for x in ([y, y * y] if squares else [y])]
        if self.held[:2] != (tree // TOGETHER, squares):
            self.held = (tree // TOGETHER, squares, self._drawn(seed, tree // TOGETHER, draws, squares))
        return self.held[2][tree % TOGETHER]

    def _drawn(self, seed: int, group: int, draws: np.ndarray, squares: bool) -> list[list[np.ndarray]]:
        out = [[np.empty(len(self.counts)) for _ in range(3 if squares else 2)] for _ in range(TOGETHER)]
        salt = mix(np.array([(seed & 0xFFFFFFFF) << 32 | group], np.uint64))
        for a, b in zip(self.tiles[:-1].tolist(), self.tiles[1:].tolist(), strict=True):
            rows = slice(int(self.start[a]), int(self.start[b]))
            bits = np.ascontiguousarray(mix(self.key[rows] + salt).view(np.uint16).reshape(-1, TOGETHER).T)
            cell, y = self.cell[rows] - a, self.y[rows]
            for u, sums_ in zip(bits, out, strict=True):
                count = np.zeros(len(u), np.uint8)
                for d in draws:
                    count += (u >= d).view(np.uint8)
                w = count.astype(float)
                for to in sums_:
                    to[a:b] = w if b - a == len(w) else np.bincount(cell, weights=w, minlength=b - a)
                    w = w * y
        return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def poisson(mean: float) -> np.ndarray:
    """16 random bits that are at least the first k of these numbers are a Poisson count of k or more."""
    p = [np.exp(-mean)]
    while sum(p) < 1 - 2.0**-17 and len(p) < 200:
        p.append(p[-1] * mean / len(p))
    at = np.round(np.cumsum(p)[:-1] * 65536)
    return at[at < 65536].astype(np.uint16)


class Tree:
    """A growing tree in heap order; slot -1: a leaf, or still open. Bins up to ``cut`` go left."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.slot, self.cut, self.gain = np.full(size, -1, np.int16), np.zeros(size, np.int32), np.zeros(size)
        self.open = np.array([0])

    def step(self, bins: np.ndarray, at: np.ndarray) -> None:
        """Moves every cell on that lies in a cut node."""
        slot = self.slot[at]
        for s in np.unique(self.slot[self.slot >= 0]).tolist():
            cells = np.flatnonzero(slot == s)
            node = at[cells]
            at[cells] = 2 * node + 2 - (bins[s][cells] <= self.cut[node])

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(bins.shape[1], np.int64)
        if self.slot[0] >= 0:
            for _ in range(int(np.log2(len(self.slot) + 1)) - 1):
                self.step(bins, at)
        return at

    def split(self, slot: np.ndarray, cut: np.ndarray, gain: np.ndarray) -> None:
        """Cuts the open nodes (slot -1: not); their children are open then."""
        go = np.flatnonzero(slot >= 0)
        node = self.open[go]
        self.slot[node], self.cut[node], self.gain[node] = slot[go], cut[go], gain[go]
        self.open = np.sort(np.concatenate([2 * node + 1, 2 * node + 2]))


def sums(bins: np.ndarray, place: np.ndarray, h: np.ndarray, g: np.ndarray, nodes: int, first: np.ndarray, cells: np.ndarray | None = None) -> np.ndarray:
    """Sums of h and g per (node, bin) over ``cells`` (all): nodes x all bins x 2. ``place``, ``h`` and ``g`` are theirs."""
    width = int(first[-1])
    out = np.zeros((nodes, width, 2))
    base = place * width
    whole = np.stack([np.bincount(place, weights=x, minlength=nodes) for x in (h, g)], axis=-1)
    key = np.empty(len(place), np.int64)
    for s in range(len(first) - 1):
        a, b = int(first[s]), int(first[s + 1])
        own = bins[s] if cells is None else bins[s][cells]
        if b - a == 2:  # what is not in the second bin is in the first
            on = np.flatnonzero(own)
            to = place[on]
            for k, x in enumerate((h, g)):
                out[:, a + 1, k] = np.bincount(to, weights=x[on], minlength=nodes)
            out[:, a] = whole - out[:, a + 1]
            continue
        np.add(base, own, out=key, casting="unsafe")
        for k, x in enumerate((h, g)):
            # a key is the bin within its node's own room
            out[:, a:b, k] = np.bincount(key, weights=x, minlength=nodes * width).reshape(nodes, width)[:, : b - a]
    return out


def best_cuts(hist: np.ndarray, first: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot (-1: none gains more than ``least``), bin and gain of the best cut of each node."""
    slot_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    may = np.ones(first[-1], bool)
    may[first[1:] - 1] = False
    total = hist[:, first[0]:first[1]].sum(axis=1)
    run = np.concatenate([np.zeros((len(hist), 1, 2)), np.cumsum(hist, axis=1)], axis=1)
    left = run[:, 1:] - run[:, first[:-1]][:, slot_of]
    right = total[:, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        g = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - (total[:, 1] ** 2 / total[:, 0])[:, None]
    g[(left[..., 0] < 1) | (right[..., 0] < 1) | ~may] = -np.inf
    at = np.argmax(g, axis=1)
    gain = g[np.arange(len(g)), at]
    ok = gain > least
    return np.where(ok, slot_of[at], -1), at - first[slot_of[at]], np.where(ok, gain / np.maximum(total[:, 0], 1), 0.0)


def whole_tree(bins: np.ndarray, h: np.ndarray, g: np.ndarray, q: np.ndarray, first: np.ndarray, depth: int, least: float) -> tuple[Tree, np.ndarray]:
    """A tree over all cells, and the sums (h, g, q) of its leaves. Of two siblings only the smaller one is summed."""
    drawn = np.flatnonzero(h)
    if len(drawn) < 0.8 * len(h):
        bins, h, g, q = np.stack([b[drawn] for b in bins]), h[drawn], g[drawn], q[drawn]
    tree, at = Tree(depth), np.zeros(len(h), np.int64)
    hist = sums(bins, at, h, g, 1, first)
    for level in range(depth):
        nodes = tree.open
        tree.split(*best_cuts(hist, first, least))
        if not len(tree.open):
            break
        tree.step(bins, at)
        if level + 1 == depth:
            break
        size = np.bincount(at, minlength=len(tree.slot))[tree.open].reshape(-1, 2)
        right = (size[:, 1] < size[:, 0]).astype(np.int64)  # the smaller child
        place = np.full(len(tree.slot), -1, np.int64)
        place[tree.open[::2] + right] = np.arange(len(right))
        to = place[at]
        cells = np.flatnonzero(to >= 0)
        small = sums(bins, to[cells], h[cells], g[cells], len(right), first, cells)
        large = hist[np.searchsorted(nodes, (tree.open[::2] - 1) // 2)] - small
        large[..., 0] = np.round(large[..., 0])
        hist = np.stack([np.where(right[:, None, None] == k, small, large) for k in (0, 1)], axis=1).reshape(-1, *small.shape[1:])
    return tree, np.stack([np.bincount(at, weights=x, minlength=len(tree.slot)) for x in (h, g, q)], axis=-1)


class Cells:
    """A table's blocks (a DataFrame) and what its trees need to know."""

    def __init__(self, df: DataFrame, features: str, label: str, bins: int):
        self.cuts = cut_points(df, features, bins)
        cuts, slots = self.cuts, len(self.cuts)
        rows = df.select(handed(features, slots).alias("x"), F.col(label).cast("double").alias("y")).where("y is not null")
        r = rows.agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("v")).first()
        self.n, self.mean, self.least = r["n"], r["mean"] or 0.0, LEAST_GAIN * (r["v"] or 0.0) * r["n"]
        self.first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])]).astype(np.int64)
        self.kind = kind = np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    got = left_bins(row_table(pa.concat_arrays([batch.column("x")]), slots), cuts)
                    ends = np.arange(len(got) + 1, dtype=np.int32) * (slots * got.itemsize)
                    packed = pa.Array.from_buffers(pa.binary(), len(got), [None, pa.py_buffer(ends), pa.py_buffer(got)])
                    yield pa.RecordBatch.from_arrays([packed, batch.column("y")], ["bins", "y"])

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            part, number, held, size, last, equal = TaskContext.get().partitionId(), 0, [], 0, None, 0
            for batch in chain(batches, [None]):
                if batch is not None:
                    held.append(batch)
                    size += batch.num_rows
                if size < BLOCK_ROWS and (batch is not None or not size):
                    continue
                rows = pa.Table.from_batches(held)
                b = np.concatenate([np.frombuffer(c.buffers()[2], kind)[c.offset * slots:(c.offset + len(c)) * slots].reshape(-1, slots)
                                    for c in rows.column("bins").chunks if len(c)])
                y = rows.column("y").to_numpy()
                start = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]).any(axis=1)]))
                before = equal if last == (b[0].tobytes(), y[0]) else 0
                same = (b == b[-1]).all(axis=1) & (y == y[-1])
                last, equal = (b[-1].tobytes(), y[-1]), int(same.sum()) + (before if same[0] else 0)
                yield pa.RecordBatch.from_pylist([{
                    "part": part, "number": number, "before": before, "bins": np.ascontiguousarray(b[start].T).tobytes(),
                    "counts": np.diff(np.append(start, len(b))).astype(np.int32).tobytes(), "target": y.tobytes()}], schema=_BLOCK)
                held, size, number = [], 0, number + 1

        cores = df.sparkSession.sparkContext.defaultParallelism
        # by the target as well: a large cell is dealt out
        table = rows.mapInArrow(cut, "bins binary, y double").repartitionByRange(max(cores, -(-self.n // BLOCK_ROWS)), "bins", "y")
        table = table.sortWithinPartitions("bins", "y")
        self.blocks = table.mapInArrow(gather, "part int, number int, before long, bins binary, counts binary, target binary").persist(StorageLevel.MEMORY_AND_DISK)
        self.bytes = self.blocks.agg(F.sum(F.length("bins") + F.length("counts") + F.length("target"))).first()[0] or 0

    def grown(self, trees: int, depth: int, seed: int, draws: np.ndarray | None) -> list[tuple[Tree, np.ndarray]]:
        return (self._whole if self.bytes <= WHOLE_BYTES else self._levels)(trees, depth, seed, draws)

    def _whole(self, trees: int, depth: int, seed: int, draws: np.ndarray | None) -> list[tuple[Tree, np.ndarray]]:
        """A task grows whole trees, each over all cells."""
        sc = self.blocks.sparkSession.sparkContext
        held = sc.broadcast([r.asDict() for r in self.blocks.orderBy("part", "number").toLocalIterator()])  # at most WHOLE_BYTES
        slots, kind, mean, first, least = len(self.cuts), self.kind, self.mean, self.first, self.least

        def grow(some: Iterator[int]) -> Iterator[tuple[Tree, np.ndarray]]:
            blocks = [Block(r, slots, kind, mean) for r in held.value]
            bins = np.concatenate([b.bins for b in blocks], axis=1)
            for t in (t for a in some for t in range(a, min(a + TOGETHER, trees))):
                h, g, q = (np.concatenate(x) for x in zip(*(b.drawn(seed, t, draws, squares=True) for b in blocks), strict=True))
                yield whole_tree(bins, h, g, q, first, depth, least)

        try:
            starts = range(0, trees, TOGETHER)
            return sc.parallelize(starts, min(len(starts), 4 * sc.defaultParallelism)).mapPartitions(grow).collect()
        finally:
            held.destroy()

    def _levels(self, trees: int, depth: int, seed: int, draws: np.ndarray | None) -> list[tuple[Tree, np.ndarray]]:
        """A level of many trees costs one aggregate over all blocks."""
        made = [Tree(depth) for _ in range(trees)]
        width, first, least = int(self.first[-1]), self.first, self.least
        for _ in range(depth):
            left = [t for t in range(trees) if len(made[t].open)]
            while left:
                size, some = 0, []
                while left and (not some or size + len(made[left[0]].open) * width * 16 <= LEVEL_BYTES):
                    size += len(made[left[0]].open) * width * 16
                    some.append(left.pop(0))

                def each(block: Block, tree: Tree, t: int) -> np.ndarray:
                    h, g = block.drawn(seed, t, draws)
                    place = np.full(len(tree.slot), -1, np.int64)
                    place[tree.open] = np.arange(len(tree.open))
                    to = place[tree.leaves(block.bins)]
                    cells = np.flatnonzero((to >= 0) & (h > 0))
                    if len(cells) == len(to):
                        return sums(block.bins, to, h, g, len(tree.open), first)
                    return sums(block.bins, to[cells], h[cells], g[cells], len(tree.open), first, cells)

                def best(total: np.ndarray) -> np.ndarray:
                    return np.stack(best_cuts(total.reshape(-1, width, 2), first, least))

                for t, got in self._summed(made, some, each, best):
                    slot, cut, gain = got.reshape(3, -1)
                    made[t].split(slot.astype(np.int64), cut.astype(np.int64), gain)

        def at_leaves(block: Block, tree: Tree, t: int) -> np.ndarray:
            at = tree.leaves(block.bins)
            return np.stack([np.bincount(at, weights=x, minlength=len(tree.slot)) for x in block.drawn(seed, t, draws, squares=True)], axis=-1)

        ends = dict(self._summed(made, list(range(trees)), at_leaves, lambda total: total))
        return [(made[t], ends[t].reshape(-1, 3)) for t in range(trees)]

    def _summed(self, made: list[Tree], some: list[int], each, last) -> list[tuple[int, np.ndarray]]:
        """``last`` of the sums over all blocks of ``each(block, tree, number)``, for some trees."""
        slots, kind, mean, trees = len(self.cuts), self.kind, self.mean, [(t, made[t]) for t in some]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, part = {}, -1
            for batch in batches:
                for r in batch.to_pylist():
                    block, part = Block(r, slots, kind, mean), r["part"]
                    for t, tree in trees:
                        got = each(block, tree, t)
                        total[t] = total[t] + got if t in total else got
            for t in list(total):
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([part], pa.int32()), pa.array([total.pop(t).tobytes()], pa.binary())], ["tree", "part", "sums"])

        def add(group: pa.Table) -> pa.Table:
            parts = sorted(zip(group.column("part").to_pylist(), group.column("sums").to_pylist(), strict=True))
            total = sum(np.frombuffer(x) for _, x in parts)
            return pa.table({"tree": group.column("tree").slice(0, 1), "sums": pa.array([np.ascontiguousarray(last(total), float).tobytes()], pa.binary())})

        got = self.blocks.mapInArrow(run, "tree int, part int, sums binary").groupBy("tree").applyInArrow(add, "tree int, sums binary").collect()
        return [(r["tree"], np.frombuffer(r["sums"])) for r in got]


def _nodes(number: int, tree: Tree, ends: np.ndarray, cuts: list[np.ndarray], mean: float) -> list[dict]:
    """The nodes of a tree as Spark saves them: in preorder, sums from the leaves."""
    total = ends.copy()
    inner = np.flatnonzero(tree.slot >= 0)
    for n in inner[::-1]:
        total[n] = total[2 * n + 1] + total[2 * n + 2]
    h, g, q = total.T
    with np.errstate(divide="ignore", invalid="ignore"):
        centre = np.where(h > 0, g / h, 0.0)
        spread = np.where(h > 0, np.maximum(q / h - centre**2, 0.0), 0.0)
    order, stack = [], [0]
    while stack:
        n = stack.pop()
        order.append(n)
        if tree.slot[n] >= 0:
            stack += [2 * n + 2, 2 * n + 1]
    name = {n: i for i, n in enumerate(order)}
    out = []
    for n in order:
        leaf, s = tree.slot[n] < 0, int(tree.slot[n])
        stats = [float(h[n]), float(g[n] + mean * h[n]), float(q[n] + 2 * mean * g[n] + mean * mean * h[n])]
        split = {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1} if leaf else {
            "featureIndex": s, "leftCategoriesOrThreshold": [float(cuts[s][tree.cut[n]])], "numCategories": -1}
        out.append({"treeID": number, "nodeData": {
            "id": name[n], "prediction": float(mean + centre[n]), "impurity": float(spread[n]), "impurityStats": stats, "rawCount": int(h[n]),
            "gain": -1.0 if leaf else float(tree.gain[n]), "leftChild": -1 if leaf else name[2 * n + 1], "rightChild": -1 if leaf else name[2 * n + 2], "split": split}})
    return out


_NODES = pa.schema([("treeID", pa.int32()), ("nodeData", pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()),
    ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
    ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())]))]))])


def spark_model(estimator: RandomForestRegressor, spark, grown: list[tuple[Tree, np.ndarray]], cuts: list[np.ndarray], mean: float) -> RandomForestRegressionModel:
    """The trees as Spark's model, by way of its saved form in the shared scratch folder."""
    from estima.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"

    def meta(kind: str, uid: str, own: set[str], **more) -> str:
        values = lambda m: {p.name: v for p, v in m.items() if p.name in own}
        return json.dumps({"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
                           "paramMap": values(estimator._paramMap), "defaultParamMap": values(estimator._defaultParamMap)} | more)

    names = {p.name for p in estimator.params}
    trees = [(i, meta("DecisionTreeRegressionModel", f"{estimator.uid}_{i}", names - {"numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap"}), 1.0) for i in range(len(grown))]
    # tree by tree: the nodes of all as Python objects would fill the driver
    table = pa.Table.from_batches([pa.RecordBatch.from_pylist(_nodes(i, tree, ends, cuts, mean), schema=_NODES) for i, (tree, ends) in enumerate(grown)])
    try:
        spark.createDataFrame([(meta("RandomForestRegressionModel", estimator.uid, names, numFeatures=len(cuts), numTrees=len(grown)),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame(trees, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame(table).write.parquet(f"{path}/data")
        return RandomForestRegressionModel.load(path)
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class RandomForest(RandomForestRegressor):
    """Spark's estimator; large tables are fitted here (see the module's text)."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=20, maxDepth=5, maxBins=32, seed=0,
                 subsamplingRate=1.0, bootstrap=True, featureSubsetStrategy="auto", cacheNodeIds=False, checkpointInterval=10, maxMemoryInMB=256):
        super().__init__(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> RandomForestRegressionModel:
        of = lambda p: self.getOrDefault(p)
        plain = of("featureSubsetStrategy") == "all" and of("maxDepth") <= MOST_DEPTH and (of("bootstrap") or of("subsamplingRate") == 1)
        # rows are counted up to the bound only
        if not plain or df.limit(LEAST_ROWS + 1).count() <= LEAST_ROWS:
            return super()._fit(df)
        cells = Cells(df, self.getFeaturesCol(), self.getLabelCol(), of("maxBins"))
        try:
            grown = cells.grown(of("numTrees"), of("maxDepth"), of("seed"), poisson(of("subsamplingRate")) if of("bootstrap") else None)
        finally:
            cells.blocks.unpersist()
        return spark_model(self, df.sparkSession, grown, cells.cuts, cells.mean)
