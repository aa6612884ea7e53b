"""Near-duplicate vectors over a robust-pruned flat graph (operator 5).

Vectors of one label (and length) are compared by cosine. Equal vectors are one node with a
weight. Then:

1. Overlapping shards: every node goes to the shards of its ``overlap`` nearest centroids
   (fitted on a bounded sample); a shard over the size limit is dealt out to parts.
2. In each part a flat graph is built: nodes are inserted in batches, each batch is searched
   from the part's medoid, and what the search saw is robustly pruned (a neighbour goes when a
   kept one is much nearer to it); reverse edges are pruned again when a list is full.
3. The adjacency lists that a node has from its shards are united, and edges lead both ways.
4. Search: a label that fits one cell is searched as a whole, a bigger one by shard (a shard
   over the cell limit by pieces, every query against every piece). Each node greedily searches
   the united graph from the medoids and its own list and expands its range: every node it knows within
   the range, until there is none it has not expanded.
5. Found pairs are verified in double precision. Two nodes that share several cells count in
   the smallest of them. A task returns one count per node and the pairs of a spanning forest,
   never all pairs of a group.
6. Audit: the links of a bounded number of nodes, drawn from every stratum of found links, are
   counted by brute force over all vectors, after each search. If a link of any of them is
   missing, the search is repeated with a wider beam and overlap; if it still is, the graph can't
   be trusted with these vectors, and all pairs are compared (:mod:`estima.llm.embed_exact`).

Defined cases: vectors without a label, and those that are null, empty, zero or hold null or
non-finite components, link with nothing; equal rows are linked with each other; a null id
counts as larger than every other; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.llm.common import join_unique, least_hashes, written
from estima.llm.embed_exact import exact_links
from estima.llm.graph import components
from estima.llm.minhash import classes
from estima.llm.vectors import k_means, matrix, nearest, sampled, unit, usable

THRESHOLD = 0.93
#: Nodes a shard is meant to have, the most in a part, and the most in a searched cell.
SHARD, PART, CELL = 2000, 6000, 12_000
#: Centroids at most; a bounded codebook.
MOST_CENTROIDS = 4096
SAMPLE = 20_000
DEGREE, BEAM, ALPHA = 20, 24, 1.2
#: Nodes whose neighbours are looked at together.
EXPANDED = 50_000
#: Nodes whose candidates are pruned together.
PRUNED = 128
#: Similarity below the threshold at which a range search still expands a node.
SLACK = 0.08
#: Nodes audited in each stratum (by links found: from 0, 1, 2, 4, 16, 64 on), and searches before all pairs are compared.
AUDIT, STRATA, ROUNDS = 160, (0, 1, 2, 4, 16, 64), 2


# ---- the graph -----------------------------------------------------------------------

def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Pruned lists (nodes x degree, -1: none). ``candidates``: rows of node numbers, -1: none."""
    out = np.full((len(nodes), degree), -1, np.int64)
    for a in range(0, len(nodes), PRUNED):
        own, near = nodes[a:a + PRUNED], np.sort(candidates[a:a + PRUNED], axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[near == own[:, None]] = -1
        c = x[near]  # nodes x candidates x dim
        far = 1 - (c @ x[own][:, :, None])[:, :, 0]
        far[near < 0] = np.inf
        # squared distances on the sphere are twice these; alpha applies to distances
        apart = np.float32(alpha**2) * (1 - c @ c.transpose(0, 2, 1))
        n = np.arange(len(own))
        for r in range(degree):
            best = np.argmin(far, axis=1)
            there = np.isfinite(far[n, best])
            if not there.any():
                break
            out[a:a + PRUNED][there, r] = near[n, best][there]
            far[(apart[n, best] <= far) & there[:, None]] = np.inf
            far[n, best] = np.inf
    return out


def compact(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Padded lists as (offsets, neighbours)."""
    there = lists >= 0
    return np.concatenate([[0], np.cumsum(there.sum(axis=1))]), lists[there]


def both_ways(rows: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges and their reverses as (offsets, neighbours): nobody is left without a way in."""
    code = np.unique(np.concatenate([rows * n + ends, ends * n + rows]))
    code = code[code // n != code % n]
    return np.searchsorted(code // n, np.arange(n + 1)), code % n


def ranks(rows: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its row; ``rows`` ascend."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows)


def greedy(x: np.ndarray, queries: np.ndarray, lists: tuple[np.ndarray, np.ndarray], entry: np.ndarray, beam: int, reach: float | None = None,
           own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Greedy search of all ``queries`` together: yields, per round, query numbers (ascending), the nodes
    they saw for the first time and the similarities. They start at the nodes ``entry`` and, if the
    queries are nodes themselves (``own``), at their own lists. A query expands
    every node within ``reach``, and ``beam`` of the others, the best first. ``lists`` name no node twice.

    What a round costs depends on the nodes that it sees, not on how many there are: a query keeps
    only as many open nodes as the beam can still expand."""
    q, n = len(queries), len(x)
    offsets, ends = lists
    seen = np.zeros(q * n, bool)
    nodes, sims = np.zeros((q, 0), np.int64), np.zeros((q, 0), np.float32)  # open, out of reach

    def met(rows: np.ndarray, near: np.ndarray, s: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray]:
        """Keeps the ``left`` best open nodes of each query; returns the nodes within reach."""
        nonlocal nodes, sims
        inside = s > reach if reach is not None else np.zeros(len(s), bool)
        out = ~inside
        if sims.shape[1] >= left:  # full: what is worse than all that is kept stays out
            out &= s > sims.min(axis=1)[rows]
        r, at = rows[out], ranks(rows[out])
        wide = int(at.max()) + 1 if len(at) else 0
        more, more_sims = np.full((q, wide), -1), np.full((q, wide), -np.inf, np.float32)
        more[r, at], more_sims[r, at] = near[out], s[out]
        nodes, sims = np.hstack([nodes, more]), np.hstack([sims, more_sims])
        if sims.shape[1] > left:
            best = np.argpartition(-sims, left - 1, axis=1)[:, :left]
            nodes, sims = np.take_along_axis(nodes, best, 1), np.take_along_axis(sims, best, 1)
        return rows[inside], near[inside]

    def expanded(rows: np.ndarray, at: np.ndarray, many: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The neighbours of the nodes that their queries see for the first time, and the similarities;
        ``many``: a query may expand several nodes."""
        first, count = offsets[at], offsets[at + 1] - offsets[at]
        who = np.repeat(rows, count)
        near = ends[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(who))]
        code = who * n + near
        ok = np.flatnonzero(~seen[code])
        who, near, code = who[ok], near[ok], code[ok]
        if many:
            code = np.unique(code)
            who, near = code // n, code % n
        seen[code] = True
        return who, near, np.einsum("nd,nd->n", queries[who], x[near])

    if own is not None:
        seen[np.arange(q) * n + own] = True
    starts = np.arange(q)[:, None] * n + entry
    who, at = np.nonzero(~seen[starts])
    seen[starts] = True
    start = (queries @ x[entry].T)[who, at]
    yield who, entry[at], start
    inside = met(who, entry[at], start, beam)
    if own is not None:
        inside = np.concatenate([np.arange(q), inside[0]]), np.concatenate([own, inside[1]])
    for step in range(beam + 1):
        # the range grows by all nodes in it at once, so a round is a step outwards, whatever a group holds
        while len(inside[0]):
            found = []
            for a in range(0, len(inside[0]), EXPANDED):
                got = expanded(inside[0][a:a + EXPANDED], inside[1][a:a + EXPANDED], True)
                yield got
                found.append(met(*got, max(1, beam - step)))
            inside = tuple(np.concatenate([f[k] for f in found]) for k in range(2))
        # the beam is for finding the way: what is in the range costs none of it
        if step == beam or not sims.shape[1]:
            return
        best = np.argmax(sims, axis=1)
        active = np.flatnonzero(sims[np.arange(q), best] > -np.inf)
        if not len(active):
            return
        best = best[active]
        at = nodes[active, best]
        sims[active, best] = -np.inf
        got = expanded(active, at, False)
        yield got
        inside = met(*got, max(1, beam - step - 1))


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, batch: int = 256) -> tuple[np.ndarray, int]:
    """Lists of a robust-pruned flat graph of the rows of ``x`` and its medoid."""
    n = len(x)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    wide = degree + degree // 2  # a list is pruned again when it would be longer
    lists = np.full((n, wide), -1, np.int64)
    rng = np.random.Generator(np.random.PCG64(n))
    if n <= degree + 1:
        for i in range(n):
            lists[i, : n - 1] = [j for j in range(n) if j != i]
        return lists[:, :degree], medoid
    # random lists to start with; a list has no node twice
    start = np.sort(rng.integers(0, n, (n, degree // 2)), axis=1)
    start[:, 1:][start[:, 1:] == start[:, :-1]] = -1
    lists[:, : degree // 2] = -np.sort(-start, axis=1)
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            nodes = order[a:a + batch]
            seen = list(greedy(x, x[nodes], compact(lists), np.array([medoid]), beam))
            rows, what, sim = (np.concatenate([s[k] for s in seen]) for k in range(3))
            # the most similar nodes seen by each
            most = 3 * degree
            o = np.argsort(4.0 * rows - sim)  # by row, then by similarity; one key is sorted faster than two
            rows, what = rows[o], what[o]
            rank = ranks(rows)
            candidates = np.full((len(nodes), most), -1, np.int64)
            ok = rank < most
            candidates[rows[ok], rank[ok]] = what[ok]
            pruned = robust_prune(x, nodes, np.hstack([candidates, lists[nodes]]), degree, alpha)
            lists[nodes] = -1
            lists[nodes, :degree] = pruned
            # reverse edges go to the end of the other's list
            back, ends = np.repeat(nodes, degree), pruned.ravel()
            back, ends = back[ends >= 0], ends[ends >= 0]
            new = ~(lists[ends] == back[:, None]).any(axis=1)
            back, ends = back[new], ends[new]
            o = np.argsort(ends, kind="stable")
            back, ends = back[o], ends[o]
            others, which, count = np.unique(ends, return_inverse=True, return_counts=True)
            there = (lists[others] >= 0).sum(axis=1)
            full = there + count > wide
            rank = ranks(ends)
            ok = ~full[which]
            lists[ends[ok], (there[which] + rank)[ok]] = back[ok]
            # a full one is pruned together with what it gets
            others, which = others[full], (np.cumsum(full) - 1)[which[~ok]]
            back, rank = back[~ok], rank[~ok]
            for low in range(0, int(rank.max()) + 1 if len(rank) else 0, degree):
                ok = (rank >= low) & (rank < low + degree)
                extra = np.full((len(others), degree), -1, np.int64)
                extra[which[ok], rank[ok] - low] = back[ok]
                pruned = robust_prune(x, others, np.hstack([lists[others], extra]), degree, alpha)
                lists[others] = -1
                lists[others, :degree] = pruned
    long = np.flatnonzero(lists[:, degree] >= 0)
    lists[long, :degree] = robust_prune(x, long, lists[long], degree, ALPHA)
    return lists[:, :degree], medoid


def linked(x: np.ndarray, exact: np.ndarray, lists: tuple[np.ndarray, np.ndarray], entry: np.ndarray, queries: np.ndarray, threshold: float,
           beam: int, own: bool = False, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of ``queries`` (exact unit rows; ``own``: they are the nodes): first query, and pairs
    (query in block, node) of cosine >= threshold; ``x`` is ``exact`` in single precision."""
    for a in range(0, len(queries), block):
        q = queries[a:a + block]
        hits = [(r[keep], w[keep]) for r, w, s in greedy(x, q.astype(np.float32), lists, entry, beam, threshold - SLACK, np.arange(a, a + len(q)) if own else None)
                if (keep := s >= threshold - 1e-3).any()]
        if not hits:
            continue
        rows, nodes = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
        sure = np.concatenate([np.einsum("nd,nd->n", q[rows[b:b + 100_000]], exact[nodes[b:b + 100_000]]) >= threshold
                               for b in range(0, len(rows), 100_000)])
        yield a, rows[sure], nodes[sure]


def least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that is in both rows of each pair of rows; a number beyond all, if there is none."""
    both = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return np.where(both, a, np.iinfo(a.dtype).max).min(axis=1)


# ---- on Spark ------------------------------------------------------------------------

def _nodes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k) per row, k null for rows that can't link; and one node per k: k, group, v, w."""
    ok = F.col(label_col).isNotNull() & usable(F.col(vector_col))
    v = F.col(vector_col).cast("array<double>")
    group = F.concat_ws(":", F.col(label_col).cast("string"), F.size(vector_col).cast("string"))
    key = F.unhex(F.md5(F.concat_ws(",", group, v.cast("array<string>"))))
    rows = vectors.select(F.col(id_col).alias("doc_id"), F.when(ok, key).alias("k"), F.when(ok, group).alias("group"), F.when(ok, v).alias("v"))
    nodes = rows.where(F.col("k").isNotNull()).groupBy("k").agg(F.first("group").alias("group"), F.first("v").alias("v"), F.count("*").alias("w"))
    return rows.select("doc_id", "k"), written(nodes, "graph-nodes")


def _assigned(nodes: DataFrame, centroids: np.ndarray, overlap: int, dim: int) -> DataFrame:
    """Nodes with ``shards``: the numbers of their nearest centroids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = nearest(unit(matrix(batch.column("v"), dim)), centroids, overlap) if batch.num_rows else np.zeros((0, overlap), int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "shards"])
    return nodes.mapInArrow(run, "k binary, `group` string, v array<double>, w long, shards array<int>")


def _graph(placed: DataFrame, dim: int) -> DataFrame:
    """Per part: k, near (keys of neighbours), medoid (bool). ``placed``: place, part, k, v."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        k = group["k"].tolist()
        lists, medoid = build(unit(np.stack(group["v"].to_numpy())).astype(np.float32))
        return pd.DataFrame({"k": k, "near": [[k[j] for j in r if j >= 0] for r in lists], "medoid": np.arange(len(k)) == medoid})
    return placed.groupBy("place", "part").applyInPandas(run, "k binary, near array<binary>, medoid boolean")


def _searched(nodes: DataFrame, dim: int, threshold: float, centroids: np.ndarray, overlap: int, beam: int, whole: int = CELL,
              part: int = PART) -> DataFrame:
    """Counts (k, n) and forest links (k, other) of the nodes of one length, in one written table."""
    assigned = written(_assigned(nodes, centroids, min(overlap, len(centroids)), dim), "graph-assigned")
    total = assigned.count()
    # a place: a label's shard. Its size tells the number of parts
    placed = assigned.select("*", F.explode("shards").alias("shard")).withColumn("place", F.concat_ws("/", "group", "shard"))
    sizes = placed.groupBy("place").agg(F.count("*").alias("n"), F.first("group").alias("__group"))
    labels = assigned.groupBy("group").agg(F.count("*").alias("in_label"))
    sizes = written(sizes.join(labels, F.col("__group") == F.col("group")).select("place", "n", F.col("n").alias("members"), "in_label"), "graph-sizes")
    placed = join_unique(placed, sizes, "place", total * overlap, "n")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("k"), F.ceil(F.col("members") / part)).cast("int"))
    placed = written(placed, "graph-placed")
    graph = _graph(placed.select("place", "part", "k", "v"), dim)
    lists = graph.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("medoid").alias("medoid"))
    lists = written(lists, "graph-lists")

    # cells: the label if it fits, else the shard; pieces of a shard that doesn't fit are groups of its parts
    small = F.col("in_label") <= whole
    pieces = F.when(small, 1).otherwise(F.ceil(F.col("members") / whole)).cast("int")
    piece = F.when(small, 0).otherwise(F.floor(F.col("part") * pieces / F.ceil(F.col("members") / part))).cast("int")
    cells = placed.select("k", "v", "w", "group", F.when(small, F.col("group")).otherwise(F.col("place")).alias("cell"),
                          pieces.alias("pieces"), piece.alias("piece"), "shards", small.alias("whole")).dropDuplicates(["k", "cell"])
    cells = cells.join(lists, "k")
    # a piece is a graph (target); the nodes of every piece ask it, one piece (asker) in a task
    every = F.sequence(F.lit(0), F.col("pieces") - 1)
    graph_side = cells.select("cell", F.col("piece").alias("target"), F.explode(every).alias("asker"), F.lit(True).alias("graph"),
                              "k", "v", "w", "near", "medoid", "shards", "whole")
    other = cells.where("pieces > 1").select("cell", F.explode(every).alias("target"), F.col("piece").alias("asker"), F.lit(False).alias("graph"),
                                             "k", "v", "w", F.lit(None).cast("array<binary>").alias("near"), "medoid", "shards", "whole")
    work = graph_side.unionByName(other.where("target != asker"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group[group["graph"]].reset_index(drop=True)
        others = group[~group["graph"]].reset_index(drop=True)
        same = int(group["target"].iloc[0]) == int(group["asker"].iloc[0])
        asks = g if same else others
        if not len(g) or not len(asks):
            return pd.DataFrame({"k": [], "n": [], "other": []})
        exact = unit(np.stack(g["v"].to_numpy()))
        x = exact.astype(np.float32)
        at = {k: i for i, k in enumerate(g["k"])}
        near = [[at[j] for j in r if j in at] for r in g["near"]]
        lists = both_ways(np.repeat(np.arange(len(g)), [len(r) for r in near]), np.array([j for r in near for j in r], np.int64), len(g))
        entry = np.flatnonzero(g["medoid"].to_numpy(bool))
        entry = entry if len(entry) else np.array([int(np.argmax(x @ x.mean(axis=0)))])
        queries = exact if same else unit(np.stack(asks["v"].to_numpy()))
        keys, gk, w = asks["k"].tolist(), g["k"].tolist(), g["w"].to_numpy(np.int64)
        whole_cell = bool(group["whole"].iloc[0])
        mine = -1 if whole_cell else int(str(group["cell"].iloc[0]).rpartition("/")[2])
        ashards, gshards = np.stack(asks["shards"].to_numpy()), np.stack(g["shards"].to_numpy())
        n = np.zeros(len(asks), np.int64)
        shift = 0 if same else len(g)  # queries are numbered after the nodes, unless they are the nodes
        top = np.arange(shift + len(asks))

        def find(i: int) -> int:
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        joined = []
        for first, rows, nodes in linked(x, exact, lists, entry, queries, threshold, beam, own=same):
            rows = rows + first
            if same:
                ok = nodes != rows
                rows, nodes = rows[ok], nodes[ok]
            if not whole_cell:  # a pair counts in the smallest cell that has both
                ok = np.concatenate([least_common(ashards[rows[b:b + 100_000]], gshards[nodes[b:b + 100_000]]) == mine for b in range(0, len(rows), 100_000)]
                                    or [np.zeros(0, bool)])
                rows, nodes = rows[ok], nodes[ok]
            np.add.at(n, rows, w[nodes])
            while (top[top] != top).any():
                top = top[top]
            ok = top[rows + shift] != top[nodes]
            for a, b in zip(rows[ok].tolist(), nodes[ok].tolist(), strict=True):
                p, q = find(a + shift), find(b)
                if p != q:
                    top[p] = q
                    joined.append((keys[a], gk[b]))
        hit = np.flatnonzero(n)
        return pd.DataFrame({"k": [keys[i] for i in hit] + [a for a, _ in joined], "n": n[hit].tolist() + [0] * len(joined),
                             "other": [None] * len(hit) + [b for _, b in joined]})

    return written(work.groupBy("cell", "target", "asker").applyInPandas(run, "k binary, n long, other binary"), "graph-found")


def audited(nodes: DataFrame, found: DataFrame, dim: int, threshold: float) -> tuple[int, int, int]:
    """(nodes with a missing link, links found, true links) of a bounded number of nodes of every stratum."""
    counts = found.where("other is null").groupBy("k").agg(F.sum("n").alias("n"))
    known = written(nodes.select("k", "group").join(counts, "k", "left").select("k", "group", F.coalesce("n", F.lit(0)).alias("n")), "graph-counts")
    sample = {}
    for low, high in zip(STRATA, (*STRATA[1:], None), strict=True):
        stratum = known.where(F.col("n") >= low) if high is None else known.where((F.col("n") >= low) & (F.col("n") < high))
        sample |= {r["k"]: r for r in least_hashes(stratum, AUDIT, "k").collect()}
    if not sample:
        return 0, 0, 0
    keys = list(sample)
    ids = nodes.sparkSession.createDataFrame([(k,) for k in keys], "k binary")  # bounded by the strata
    vectors = {r["k"]: r["v"] for r in nodes.join(F.broadcast(ids), "k", "left_semi").select("k", "v").collect()}
    q = unit(np.array([vectors[k] for k in keys], np.float64).reshape(-1, dim))
    number = {g: i for i, g in enumerate(sorted({r["group"] for r in sample.values()}))}
    groups = np.array([number[sample[k]["group"]] for k in keys])
    place = {k: i for i, k in enumerate(keys)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                x = unit(matrix(part.column("v"), dim))
                s = q @ x.T
                hit = s >= threshold
                rows, cols = np.nonzero(np.abs(s - threshold) < 1e-9)  # a matrix product is not exact
                hit[rows, cols] = np.einsum("nd,nd->n", q[rows], x[cols]) >= threshold
                hit &= groups[:, None] == np.array([number.get(g, -1) for g in part.column("group").to_pylist()])[None, :]
                for j, k in enumerate(part.column("k").to_pylist()):
                    if k in place:
                        hit[place[k], j] = False
                total += hit @ part.column("w").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(total)], ["k", "true"])

    true = {r["k"]: r["true"] for r in nodes.mapInArrow(scan, "k binary, true long").groupBy("k").agg(F.sum("true").alias("true")).collect()}
    got = {k: sample[k]["n"] for k in keys}
    return sum(got[k] < true[k] for k in keys), sum(min(got[k], true[k]) for k in keys), sum(true.values())


def graph_links(nodes: DataFrame, dim: int, threshold: float, rounds: int = ROUNDS) -> tuple[DataFrame, tuple[int, int, int]]:
    """Counts and forest links of the nodes of one length by the graph, and what its last audit found."""
    largest = nodes.groupBy("group").count().agg(F.max("count")).first()[0]
    centroids = k_means(sampled(nodes, "k", "v", dim, SAMPLE), min(MOST_CENTROIDS, max(1, math.ceil(largest / SHARD))))
    overlap, beam = 2, BEAM
    for _ in range(rounds):
        found = _searched(nodes, dim, threshold, centroids, overlap, beam)
        audit = audited(nodes, found, dim, threshold)
        if not audit[0]:
            break
        overlap, beam = overlap + 2, 2 * beam
    return found, audit


def duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                      threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: vec_id, n_links, component_id (smallest id reachable by links), kept."""
    keyed, nodes = _nodes(vectors, id_col, vector_col, label_col)
    found = None
    for dim in sorted(r["d"] for r in nodes.select(F.size("v").alias("d")).distinct().collect()):
        own = nodes.where(F.size("v") == dim)
        got, audit = graph_links(own, dim, threshold)
        if audit[0]:
            got = exact_links(own, dim, threshold)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return keyed.select(F.col("doc_id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    known = written(components(found.where("other is not null"), "k", "other"), "graph-components")
    counts = found.where("other is null").groupBy("k").agg(F.sum("n").alias("found"))
    per = nodes.select("k", "w").join(counts, "k", "left").select("k", "w", (F.col("w") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"))
    out = classes(keyed, known)
    out = join_unique(out, per, "k", keyed.count(), "w")
    return out.select(F.col("doc_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.col("class_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
