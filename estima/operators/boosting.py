"""Second-order gradient boosting on histograms.

A round fits one tree to the gradients g = prediction - target and Hessians h = 1 of the squared
loss. A level of the tree costs one aggregate: the sums of g and h per (open node, slot, bin). From
them every open node gets its best cut by the gain GL^2/(HL+lambda) + GR^2/(HR+lambda) - G^2/(H+lambda), tried with the
missing values on either side, and its children's totals; a leaf predicts -G/(H+lambda), times the
learning rate.

Bins are cut once, before the first round: between all distinct values of a slot that has at
most ``bins`` of them (then every cut an exact search would try is there), else at exact
quantiles; 0/1 slots have one cut. A table of at most ``TASK_CELLS`` binned cells is boosted inside
one task, as a round there costs no job. Of a larger one, rows with the same bins become one with
their number and the sum of their targets, which is all that g and h need. If it is still larger it stays
where it is: each task sums its own rows and the driver adds the sums, one job a level, without SQL,
whose plans and metrics the driver would keep. All ways run the same code on the same histograms.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.operators.cuts import cut_points, row_table
from estima.operators.ridge import handed

#: Cells (rows x slots) that one task boosts by itself.
TASK_CELLS = 8_000_000
#: Cells of a block of a larger table.
BLOCK_CELLS = 8_000_000
#: Rounds after which the predictions so far are cut off from their lineage.
CUT_EVERY = 20
#: A cut must gain more than this.
LEAST_GAIN = 1e-6


class Tree:
    """A tree as arrays in heap order; ``slot`` -1: a leaf. Bins up to ``cut`` go left."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.slot, self.cut = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.missing_left, self.value, self.gain = np.zeros(size, bool), np.zeros(size), np.zeros(size)

    def leaves(self, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """The node of each row of ``bins`` (rows x slots); ``missing``: the bin of missing values, by slot."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            slot = self.slot[at]
            go = slot >= 0
            if not go.any():
                return at
            b = bins[rows, np.maximum(slot, 0)].astype(np.int64)
            left = np.where(b == missing[slot], self.missing_left[at], b <= self.cut[at])
            at = np.where(go, 2 * at + 2 - left, at)


def grown(histogram, first: np.ndarray, depth: int, rate: float, penalty: float, least: float) -> Tree:
    """One tree. ``histogram(tree, nodes)``: sums (nodes x all bins x 2) of g and h; ``first``: each
    slot's first bin and the end; a slot's last bin holds its missing values."""
    tree, slots = Tree(depth), len(first) - 1
    slot_of = np.repeat(np.arange(slots), np.diff(first))
    last = first[1:] - 1
    may_cut = np.ones(first[-1], bool)
    may_cut[last] = False
    score = lambda g, h: g * g / (h + penalty)
    nodes = np.array([0])
    for level in range(depth):
        hist = histogram(tree, nodes)
        total = hist[:, first[0]:first[1]].sum(axis=1)
        if level == 0:
            tree.value[0] = -rate * total[0, 0] / (total[0, 1] + penalty)
        sums = np.cumsum(hist, axis=1)
        before = np.concatenate([np.zeros((len(nodes), 1, 2)), sums], axis=1)[:, first[:-1]]
        left = sums - before[:, slot_of]  # without missing values
        absent = hist[:, last][:, slot_of]
        best, gain = np.zeros((2, len(nodes)), np.int64), np.full((2, len(nodes)), -np.inf)
        for m in (0, 1):
            l = left + absent if m else left
            r = total[:, None] - l
            with np.errstate(divide="ignore", invalid="ignore"):
                g = score(l[..., 0], l[..., 1]) + score(r[..., 0], r[..., 1]) - score(total[:, 0], total[:, 1])[:, None]
            g[(l[..., 1] < least) | (r[..., 1] < least) | ~may_cut] = -np.inf
            best[m] = np.argmax(g, axis=1)
            gain[m] = g[np.arange(len(nodes)), best[m]]
        side = (gain[1] > gain[0]).astype(np.int64)
        n = np.arange(len(nodes))
        cut = np.flatnonzero(gain[side, n] > LEAST_GAIN)
        if not len(cut):
            break
        b, node = best[side, n][cut], nodes[cut]
        tree.slot[node], tree.cut[node], tree.missing_left[node] = slot_of[b], b - first[slot_of[b]], side[cut] > 0
        tree.gain[node] = gain[side, n][cut]
        l = left[cut, b] + np.where(side[cut, None] > 0, absent[cut, b], 0)
        for child, s in ((2 * node + 1, l), (2 * node + 2, total[cut] - l)):
            tree.value[child] = -rate * s[:, 0] / (s[:, 1] + penalty)
        nodes = np.sort(np.concatenate([2 * node + 1, 2 * node + 2]))
    return tree


def summed(bins: np.ndarray, gradient: np.ndarray, at: np.ndarray, nodes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of g and h over rows, per (node, bin): nodes x all bins x 2."""
    place = np.full(int(nodes.max()) + 1, -1, np.int64)
    place[nodes] = np.arange(len(nodes))
    at = np.where(at <= nodes.max(), place[np.minimum(at, nodes.max())], -1)
    ok = at >= 0
    base, g, size = at[ok] * first[-1], gradient[ok], len(nodes) * first[-1]
    out = np.zeros((size, 2))
    for s in range(len(first) - 1):
        key = base + first[s] + bins[ok, s]
        out[:, 0] += np.bincount(key, weights=g, minlength=size)
        out[:, 1] += np.bincount(key, minlength=size)
    return out.reshape(len(nodes), first[-1], 2)


class Here:
    """Rows inside one task. The rows' nodes are kept and go on by one level at a time."""

    def __init__(self, bins: np.ndarray, target: np.ndarray, first: np.ndarray, base: float | np.ndarray, count: np.ndarray | None = None):
        """``count``: rows that are one here, their targets added up (None: each is its own)."""
        self.bins, self.target, self.first, self.missing = np.ascontiguousarray(bins.T), target, first, np.diff(first) - 1
        self.predicted, self.count = np.zeros(len(target)) + base, count
        self.at = np.zeros(len(target), np.int64)

    def histogram(self, tree: Tree, nodes: np.ndarray) -> np.ndarray:
        if nodes[0] == 0:
            self.at[:] = 0
            self.gradient = (self.predicted if self.count is None else self.predicted * self.count) - self.target
        else:
            self._down(tree)
        return self.sums(tree, nodes)

    def sums(self, tree: Tree, nodes: np.ndarray) -> np.ndarray:
        place = np.full(len(tree.slot), -1, np.int64)
        place[nodes] = np.arange(len(nodes)) * self.first[-1]
        base, gradient, count, bins = place[self.at], self.gradient, self.count, self.bins
        if (base < 0).any():
            ok = np.flatnonzero(base >= 0)
            base, gradient, bins = base[ok], gradient[ok], bins[:, ok]
            count = None if count is None else count[ok]
        width = int(self.first[-1])
        out = np.zeros((len(nodes), width, 2))
        key = np.empty(len(base), np.int64)
        for s in range(len(self.first) - 1):
            np.add(base, bins[s], out=key, casting="unsafe")
            a, b = self.first[s], self.first[s + 1]
            size = len(nodes) * width
            # a key is the bin within its node's own room
            out[:, a:b, 0] = np.bincount(key, weights=gradient, minlength=size).reshape(len(nodes), width)[:, :b - a]
            out[:, a:b, 1] = np.bincount(key, weights=count, minlength=size).reshape(len(nodes), width)[:, :b - a]
        return out

    def _down(self, tree: Tree) -> None:
        """One step of every row whose node is cut."""
        slot = tree.slot[self.at]
        for s in np.unique(slot[slot >= 0]).tolist():
            rows = np.flatnonzero(slot == s)
            at, b = self.at[rows], self.bins[s][rows]
            left = np.where(b == self.missing[s], tree.missing_left[at], b <= tree.cut[at])
            self.at[rows] = 2 * at + 2 - left

    def add(self, tree: Tree) -> None:
        while (tree.slot[self.at] >= 0).any():
            self._down(tree)
        self.predicted += tree.value[self.at]


_BLOCK = pa.schema([(n, pa.binary()) for n in ("bins", "target", "predicted")])
_CELLS = pa.schema([(n, pa.binary()) for n in ("bins", "count", "target")])


class There:
    """Rows in an RDD of blocks: (bins, targets, predictions, counts)."""

    def __init__(self, blocks: RDD, first: np.ndarray):
        self.first, self.rounds, self.blocks, self.old = first, 0, blocks, []

    def histogram(self, tree: Tree, nodes: np.ndarray) -> np.ndarray:
        first, level = self.first, int(np.log2(nodes[0] + 1))

        def run(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
            total = np.zeros((len(nodes), first[-1], 2))
            for bins, target, predicted, count in blocks:
                here = Here(bins.T, target, first, predicted, count)
                here.gradient = predicted * count - target
                for _ in range(level):
                    here._down(tree)
                total += here.sums(tree, nodes)
            yield total

        out = sum(self.blocks.mapPartitions(run).collect())  # bins of one level a task, added in the tasks' order
        self.release()
        return out

    def add(self, tree: Tree) -> None:
        first = self.first

        def run(block: tuple) -> tuple:
            bins, target, predicted, count = block
            here = Here(bins.T, target, first, predicted, count)
            here.add(tree)
            return bins, target, here.predicted, count

        self.rounds += 1
        self.old.append(self.blocks)
        # made by the first job of the next round
        self.blocks = self.blocks.map(run).persist(StorageLevel.MEMORY_AND_DISK)
        if self.rounds % CUT_EVERY == 0:
            self.blocks.checkpoint()
            self.blocks.count()

    def release(self) -> None:
        """The blocks of rounds before."""
        while self.old:
            self.old.pop().unpersist()


def boosted(rows: Here | There, rounds: int, depth: int, rate: float, penalty: float, least: float) -> list[Tree]:
    trees = []
    for _ in range(rounds):
        trees.append(grown(rows.histogram, rows.first, depth, rate, penalty, least))
        rows.add(trees[-1])
    return trees


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint16)
    for s, c in enumerate(cuts):
        out[:, s] = np.where(np.isnan(x[:, s]), len(c) + 1, np.searchsorted(c, x[:, s], side="right"))
    return out


class BoostedTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Boosting of regression trees on the second order of the squared loss (see the module's text)."""

    rounds = Param(Params._dummy(), "rounds", "trees", typeConverter=TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "depth of a tree", typeConverter=TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", typeConverter=TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "L2 penalty of a leaf", typeConverter=TypeConverters.toFloat)
    least = Param(Params._dummy(), "least", "least Hessian of a child", typeConverter=TypeConverters.toFloat)
    bins = Param(Params._dummy(), "bins", "bins of a slot", typeConverter=TypeConverters.toInt)
    base = Param(Params._dummy(), "base", "prediction before the first round", typeConverter=TypeConverters.toFloat)
    cells = Param(Params._dummy(), "cells", "cells that one task boosts", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, rounds=100, depth=6, rate=0.3, penalty=1.0, least=1.0, bins=256, base=0.5, cells=TASK_CELLS,
                 featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(rounds=100, depth=6, rate=0.3, penalty=1.0, least=1.0, bins=256, base=0.5, cells=TASK_CELLS)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> BoostedTreesModel:
        of = lambda p: self.getOrDefault(p)
        feats = self.getFeaturesCol()
        cuts = cut_points(df, feats, of("bins"))
        rows = df.select(handed(feats, len(cuts)).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")).where("y is not null")
        first = np.concatenate([[0], np.cumsum([len(c) + 2 for c in cuts])]).astype(np.int64)
        base, settings = of("base"), [of(p) for p in ("rounds", "depth", "rate", "penalty", "least")]
        size = 50_000 // max(1, len(cuts)) + 1

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, size):
                    part = batch.slice(a, size)
                    y = np.ascontiguousarray(part.column("y").to_numpy(zero_copy_only=False))
                    bins = binned(row_table(pa.concat_arrays([part.column("x")]), len(cuts)), cuts)
                    yield pa.RecordBatch.from_pylist([{"bins": bins.tobytes(), "target": y.tobytes(), "predicted": np.full(len(y), base).tobytes()}],
                                                     schema=_BLOCK)

        table = rows.mapInArrow(blocks, "bins binary, target binary, predicted binary")
        n = rows.count()
        if not n or not len(cuts):
            trees = []
        elif n * len(cuts) <= of("cells"):
            def run(group: pa.Table) -> pa.Table:
                parts = sorted(zip(group.column("target").to_pylist(), group.column("bins").to_pylist(), strict=True))
                here = Here(np.concatenate([np.frombuffer(b, np.uint16).reshape(-1, len(cuts)) for _, b in parts]),
                            np.concatenate([np.frombuffer(y) for y, _ in parts]), first, base)
                return pa.table({"trees": [json.dumps([_plain(t, cuts) for t in boosted(here, *settings)])]})
            trees = json.loads(table.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(run, "trees string").first()["trees"])
        else:
            trees = self._many(rows, cuts, first, base, settings)
        return BoostedTreesModel(trees=json.dumps(trees), base=base, slots=len(cuts), featuresCol=feats, labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol())


    def _many(self, rows: DataFrame, cuts: list[np.ndarray], first: np.ndarray, base: float, settings: list) -> list[dict]:
        """The trees of a table that is too large for one task as it is."""
        slots = len(cuts)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bins = binned(row_table(pa.concat_arrays([batch.column("x")]), slots), cuts)
                    ends = np.arange(len(bins) + 1, dtype=np.int32) * (2 * slots)
                    yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(ends), pa.py_buffer(bins)]), batch.column("y")], ["bins", "y"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in chain(batches, [None]):
                if batch is not None:
                    held.append(batch)
                    size += batch.num_rows
                if size and (batch is None or size * slots >= BLOCK_CELLS):
                    t = pa.Table.from_batches(held)
                    data = b"".join(chain.from_iterable(c.to_pylist() for c in t.column("bins").chunks))
                    bins = np.frombuffer(data, np.uint16).reshape(-1, slots)
                    order = np.lexsort(bins.T)  # whatever way the rows have come
                    yield pa.RecordBatch.from_pylist([{"bins": np.ascontiguousarray(bins[order].T).tobytes()} | {
                        c: t.column(c).to_numpy().astype(float)[order].tobytes() for c in ("count", "target")}], schema=_CELLS)
                    held, size = [], 0

        cells = rows.mapInArrow(cut, "bins binary, y double").groupBy("bins").agg(F.count("y").alias("count"), F.sum("y").alias("target"))
        cells = cells.mapInArrow(pack, "bins binary, count binary, target binary").persist(StorageLevel.MEMORY_AND_DISK)

        def block(r) -> tuple:
            target = np.frombuffer(r["target"])
            return np.frombuffer(r["bins"], np.uint16).reshape(slots, -1), target, np.full(len(target), base), np.frombuffer(r["count"])

        try:
            n = (cells.agg(F.sum(F.length("target"))).first()[0] or 0) // 8
            if n * slots <= self.getOrDefault("cells"):
                def run(group: pa.Table) -> pa.Table:
                    parts = sorted(group.to_pylist(), key=lambda r: r["bins"])
                    bins, target, predicted, count = (np.concatenate(x, axis=-1) for x in zip(*map(block, parts), strict=True))
                    here = Here(bins.T, target, first, predicted, count)
                    return pa.table({"trees": [json.dumps([_plain(t, cuts) for t in boosted(here, *settings)])]})
                return json.loads(cells.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(
                    lambda g: run(g.drop_columns(["all"])), "trees string").first()["trees"])
            def merged(some: Iterator) -> Iterator[tuple]:
                if got := [block(r) for r in some]:
                    yield tuple(np.concatenate(x, axis=-1) for x in zip(*got, strict=True))

            # a round is many short jobs: few tasks, a block each
            tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * slots // BLOCK_CELLS))
            there = There(cells.rdd.coalesce(tasks).mapPartitions(merged).persist(StorageLevel.MEMORY_AND_DISK), first)
            try:
                return [_plain(t, cuts) for t in boosted(there, *settings)]
            finally:
                there.release()
                there.blocks.unpersist()
        finally:
            cells.unpersist()


def _plain(tree: Tree, cuts: list[np.ndarray]) -> dict:
    """A tree with its cuts as values: what is below goes left."""
    inner = np.flatnonzero(tree.slot >= 0)
    edge = lambda s, b: float(cuts[s][b]) if b < len(cuts[s]) else float("inf")
    return {"depth": int(np.log2(len(tree.slot) + 1)) - 1, "node": inner.tolist(), "slot": tree.slot[inner].tolist(),
            "below": [edge(int(s), int(b)) for s, b in zip(tree.slot[inner], tree.cut[inner], strict=True)],
            "missing_left": tree.missing_left[inner].tolist(), "gain": tree.gain[inner].tolist(), "leaf": np.flatnonzero(tree.value).tolist(), "value": tree.value[tree.value != 0].tolist()}


class BoostedTreesModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted boosting; a missing slot goes the way its node has learned."""

    trees = Param(Params._dummy(), "trees", "the trees as JSON", typeConverter=TypeConverters.toString)
    base = Param(Params._dummy(), "base", "prediction before the first tree", typeConverter=TypeConverters.toFloat)
    slots = Param(Params._dummy(), "slots", "slots of a row", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, trees="[]", base=0.5, slots=0, featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def featureImportances(self) -> DenseVector:
        """Mean gain of the cuts on each slot, of 1 in all."""
        trees, slots = json.loads(self.getOrDefault("trees")), self.getOrDefault("slots")
        at = np.array([s for t in trees for s in t["slot"]], np.int64)
        gain = np.bincount(at, weights=[g for t in trees for g in t["gain"]], minlength=slots) / np.maximum(np.bincount(at, minlength=slots), 1)
        return DenseVector(gain / gain.sum() if gain.sum() else gain)

    def prefix(self, size: int) -> BoostedTreesModel:
        """The model after ``size`` rounds."""
        return self.copy({self.trees: json.dumps(json.loads(self.getOrDefault("trees"))[:size])})

    def _transform(self, df: DataFrame) -> DataFrame:
        plain, base = json.loads(self.getOrDefault("trees")), self.getOrDefault("base")

        @F.pandas_udf("double")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trees = []
            for t in plain:
                tree, below = Tree(t["depth"]), np.zeros(2 ** (t["depth"] + 1) - 1)
                tree.slot[t["node"]], below[t["node"]], tree.missing_left[t["node"]] = t["slot"], t["below"], t["missing_left"]
                tree.value[t["leaf"]] = t["value"]
                trees.append((tree, below))
            for batch in batches:
                out = np.full(len(batch), base)
                x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
                rows = np.arange(len(x))
                for tree, below in trees:
                    at = np.zeros(len(x), np.int64)
                    for _ in range(int(np.log2(len(tree.slot) + 1))):
                        slot = tree.slot[at]
                        v = x[rows, np.maximum(slot, 0)]
                        left = np.where(np.isnan(v), tree.missing_left[at], v < below[at])
                        at = np.where(slot >= 0, 2 * at + 2 - left, at)
                    out += tree.value[at]
                yield pd.Series(out)

        return df.withColumn(self.getPredictionCol(), predict(vector_to_array(F.col(self.getFeaturesCol()))))
