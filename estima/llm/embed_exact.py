"""All links of vectors exactly, by blocked comparison: what the audit of operator 5's graph leaves open.

1. A label of at most ``whole`` nodes is one cell, compared whole.
2. The nodes of a bigger label have their nearest centroid (fitted on a bounded sample) as home
   shard. A node goes to every shard that may hold a partner: two nodes with the cosine of the
   threshold are at most ``sqrt(2 - 2 threshold)`` apart, so a partner can only be homed where
   the node is no farther than that beyond the plane between the two centroids. The nodes that
   two shards may have to link meet in one cell; no pair is left out.
3. A shard over the part limit is dealt out to parts, and every part meets every part.
4. In a cell all pairs are compared in single precision, those near the threshold again in
   double precision, each pair once. A task returns one count per node and the pairs of a
   spanning forest, never all pairs of a group.

Data that no centroids tell apart send every node to every shard; the work is then the square of
the label, as that of any comparison that loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.llm.common import join_unique, written
from estima.llm.vectors import k_means, matrix, sampled, unit, usable

#: Nodes a shard is meant to have, the most in a part, and the most of a label compared whole.
SHARD, PART, CELL = 2000, 3000, 12_000
#: Centroids at most; a bounded codebook.
MOST_CENTROIDS = 4096
SAMPLE = 20_000
#: Rows compared at a time.
BLOCK = 512


# ---- in a cell -----------------------------------------------------------------------

def linked(x: np.ndarray, y: np.ndarray | None, threshold: float, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    """Per block of the unit rows ``x``: its first row, and which pairs (row, row of ``y``) have a cosine
    >= threshold; without ``y`` the pairs with later rows of ``x``. The values don't depend on the blocks."""
    near = x.astype(np.float32)
    other, far = (x, near) if y is None else (y, y.astype(np.float32))
    doubt = max(1e-3, x.shape[1] * 2.0**-22)  # more than single precision is off
    for a in range(0, len(x), block):
        s = near[a:a + block] @ far.T
        hit = s >= threshold + doubt
        rows, cols = np.nonzero(~hit & (s >= threshold - doubt))
        for b in range(0, len(rows), 100_000):
            r, c = rows[b:b + 100_000], cols[b:b + 100_000]
            hit[r, c] = np.einsum("nd,nd->n", x[a + r], other[c]) >= threshold
        if y is None:
            hit &= np.arange(len(x)) > np.arange(a, a + len(hit))[:, None]
        yield a, hit


def cell_links(x: np.ndarray, y: np.ndarray | None, wx: np.ndarray, wy: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weighted link counts of the rows of ``x`` and of ``y``, and a spanning forest of the links, its
    nodes numbered through ``x`` and then ``y``. Without ``y`` the links within ``x``."""
    shift = 0 if y is None else len(x)
    nx, ny = np.zeros(len(x), np.int64), np.zeros(0 if y is None else len(y), np.int64)
    label = np.arange(shift + (len(x) if y is None else len(y)))
    forest = []
    for a, hit in linked(x, y, threshold):
        with_hits = np.flatnonzero(hit.any(axis=1))
        if not len(with_hits):
            continue
        hit = hit[with_hits]
        nx[a + with_hits] += hit @ (wx if y is None else wy)
        (nx if y is None else ny)[:] += wx[a + with_hits] @ hit
        for i, row in zip((a + with_hits).tolist(), hit, strict=True):
            ends = np.flatnonzero(row) + shift
            ends = ends[label[ends] != label[i]]
            if len(ends):
                groups, first = np.unique(label[ends], return_index=True)
                forest += [(i, int(j)) for j in ends[first]]
                label[np.isin(label, groups)] = label[i]
    return nx, ny, forest


# ---- on Spark ------------------------------------------------------------------------

def reach(x: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The home shard of each unit row, and which shards (rows x shards) may be the home of a
    row with a cosine >= threshold to it."""
    score = x @ centroids.T - 0.5 * (centroids**2).sum(axis=1)
    home = np.argmax(score, axis=1)
    length = (centroids**2).sum(axis=1)
    between = np.sqrt(np.maximum(0, length[home][:, None] + length - 2 * centroids[home] @ centroids.T))
    # a partner u homed at c has score(u, c) >= score(u, home), and the difference changes by at
    # most the distance of the rows times that of the centroids
    most = math.sqrt(max(0.0, 2 - 2 * threshold))
    return home, score[np.arange(len(x)), home][:, None] - score <= (most + 1e-6) * between + 1e-6


def _assigned(nodes: DataFrame, centroids: np.ndarray, dim: int, threshold: float) -> DataFrame:
    """Nodes with ``home`` and ``shards``: those that may hold a partner, the home included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                rows = batch.slice(a, 1000)
                home, there = reach(unit(matrix(rows.column("v"), dim)), centroids, threshold)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(home, pa.int32()), pa.array([np.flatnonzero(t).tolist() for t in there], pa.list_(pa.int32()))],
                    [*rows.schema.names, "home", "shards"])
    return nodes.mapInArrow(run, "k binary, `group` string, v array<double>, w long, home int, shards array<int>")


def _dealt(nodes: DataFrame, dim: int, threshold: float, centroids: np.ndarray, part: int) -> DataFrame:
    """The nodes of big labels in cells: cell (text), left (bool), inner (the cell's pairs are those
    within its left side), k, v, w."""
    assigned = written(_assigned(nodes, centroids, dim, threshold), "embed-assigned")
    place = lambda shard: F.concat_ws("/", F.col("group"), F.col(shard))
    sizes = assigned.groupBy(place("home").alias("place")).agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    visits = assigned.select("*", F.explode("shards").alias("shard")).select("*", place("shard").alias("place"))
    counts = assigned.select("group", F.explode("shards").alias("shard")).groupBy(place("shard").alias("place")).agg(F.count("*").alias("n"))
    sizes = written(counts.join(sizes, "place"), "embed-sizes")  # shards that are nobody's home go
    homes = assigned.groupBy(place("home").alias("place")).agg(F.count("*").alias("n"))
    homes = homes.join(sizes.select("place", F.col("parts").alias("own_parts")), "place")
    visits = join_unique(visits, sizes, "place", sizes.agg(F.sum("n")).first()[0], "n").where(F.col("parts").isNotNull())
    visits = visits.withColumn("place", place("home"))
    visits = join_unique(visits, homes, "place", assigned.count(), "n")
    visits = visits.withColumn("own", F.pmod(F.xxhash64("k"), F.col("own_parts")).cast("int"))
    # the part meets each part of the shard; in the home shard, part i stands left of part j > i
    met = visits.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("met"))
    at, to = F.struct(F.col("home").alias("s"), F.col("own").alias("p")), F.struct(F.col("shard").alias("s"), F.col("met").alias("p"))
    lo, hi = F.least(at, to), F.greatest(at, to)
    return met.select(F.concat_ws("/", "group", lo["s"], lo["p"], hi["s"], hi["p"]).alias("cell"), (at <= to).alias("left"),
                      (at == to).alias("inner"), "k", "v", "w")


def exact_links(nodes: DataFrame, dim: int, threshold: float, whole: int = CELL, part: int = PART) -> DataFrame:
    """Counts (k, n) and forest links (k, other) of the nodes of one length, in one written table."""
    labels = written(nodes.groupBy("group").agg(F.count("*").alias("n")), "embed-labels")
    largest = labels.agg(F.max("n")).first()[0]
    cells = nodes.select(F.col("group").alias("cell"), F.lit(True).alias("left"), F.lit(True).alias("inner"), "k", "v", "w")
    if largest > whole:
        sized = join_unique(nodes, labels.withColumn("in_label", F.col("n")), "group", nodes.count(), "n")
        big = sized.where(F.col("in_label") > whole).drop("in_label")
        centroids = k_means(sampled(big, "k", "v", dim, SAMPLE), min(MOST_CENTROIDS, max(1, math.ceil(largest / SHARD))))
        small = sized.where(F.col("in_label") <= whole)
        cells = small.select(F.col("group").alias("cell"), F.lit(True).alias("left"), F.lit(True).alias("inner"), "k", "v", "w").unionByName(
            _dealt(big, dim, threshold, centroids, part))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        inner = bool(group["inner"].iloc[0])
        a, b = (group, None) if inner else (group[group["left"]], group[~group["left"]])
        if not len(a) or b is not None and not len(b):
            return pd.DataFrame({"k": [], "n": [], "other": []})
        x, wx = unit(np.stack(a["v"].to_numpy())), a["w"].to_numpy(np.int64)
        y, wy = (None, wx[:0]) if b is None else (unit(np.stack(b["v"].to_numpy())), b["w"].to_numpy(np.int64))
        nx, ny, forest = cell_links(x, y, wx, wy, threshold)
        keys, n = a["k"].tolist() + ([] if b is None else b["k"].tolist()), np.concatenate([nx, ny])
        hit = np.flatnonzero(n)
        return pd.DataFrame({"k": [keys[i] for i in hit] + [keys[i] for i, _ in forest], "n": n[hit].tolist() + [0] * len(forest),
                             "other": [None] * len(hit) + [keys[j] for _, j in forest]})

    return written(cells.groupBy("cell").applyInPandas(run, "k binary, n long, other binary"), "embed-found")
