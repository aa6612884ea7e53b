"""Approximate nearest neighbours with an inverted multi-index (operator 7).

Unit vectors are cut into two halves, each quantised with its own centroids (fitted on a
bounded sample). An entry lies in the cell of its pair of centroids. A query walks the pairs
in the order of their summed distances with a heap until the cells passed hold a set share of
all entries; the entries of those cells are ranked by the exact cosine.

The share is not guessed: for a bounded number of audit queries the true neighbours are found
by brute force over all vectors, and the share is the least at which the walk passes the cells
of ``recall`` of them. The same audit measures the recall reached.

Queries meet entries per region (first centroid), a hot region is dealt out to parts, and a
task returns its best few for each query only, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take
no part; vectors of different lengths are never compared; a null id is no query and comes last
among ties; rows that repeat an id are rows of their own; a query's own row is no candidate;
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estima.llm.common import written
from estima.llm.vectors import k_means, matrix, nearest, sampled, unit, usable

CENTROIDS = 64
SAMPLE = 10_000
AUDIT_QUERIES = 128
RECALL = 0.97
#: Room for the rounding of a matrix product of unit vectors.
SLACK = 1e-9
#: Entries in a part of a region.
PART = 4000


class MultiIndex:
    """Two codebooks and the sizes of their pairs' cells."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.half = first, second, first.shape[1]
        self.sizes = np.zeros((len(first), len(second)), np.int64)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(x[:, :self.half], self.first), nearest(x[:, self.half:], self.second)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (((x[:, None, :self.half] - self.first) ** 2).sum(axis=2), ((x[:, None, self.half:] - self.second) ** 2).sum(axis=2))

    def walk(self, d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of centroids in the order of summed distance."""
        o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
        s1, s2 = d1[o1].tolist(), d2[o2].tolist()
        heap, row_at = [(s1[0] + s2[0], 0, 0)], 0
        while heap:
            _, a, b = heapq.heappop(heap)
            yield o1[a], o2[b]
            if b + 1 < len(s2):
                heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
            if b == 0 and a == row_at and a + 1 < len(s1):
                row_at = a + 1
                heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))

    def probes(self, d1: np.ndarray, d2: np.ndarray, entries: float) -> dict[int, list[int]]:
        """Cells that the walk passes until they hold ``entries`` entries, by first centroid."""
        out: dict[int, list[int]] = {}
        passed = 0
        for i, j in self.walk(d1, d2):
            if n := int(self.sizes[i, j]):
                out.setdefault(i, []).append(j)
                passed += n
                if passed >= entries:
                    break
        return out

    def passed_before(self, d1: np.ndarray, d2: np.ndarray, cells: set[tuple[int, int]]) -> dict[tuple[int, int], int]:
        """For each of ``cells``, the entries passed once the walk has passed it."""
        out, passed = {}, 0
        for c in self.walk(d1, d2):
            passed += int(self.sizes[c])
            if c in cells:
                out[c] = passed
                if len(out) == len(cells):
                    break
        return out


def _entries(rows: DataFrame, index: MultiIndex, dim: int) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = index.cells(unit(matrix(batch.column("v"), dim))) if batch.num_rows else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("v"), pa.array(i, pa.int32()),
                                              pa.array(j, pa.int32())], ["row", "id", "v", "i", "j"])
    kind = dict(rows.dtypes)["id"]
    return written(rows.mapInArrow(place, f"row long, id {kind}, v array<double>, i int, j int"), "ann-entries")


def _best(query: np.ndarray, query_row: np.ndarray, entries: np.ndarray, entry_row: np.ndarray, entry_id: np.ndarray,
          allowed: np.ndarray | None, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of its ``k`` best entries, ties to the smaller id."""
    for a in range(0, len(query), 256):
        s = query[a:a + 256] @ entries.T
        s[query_row[a:a + 256, None] == entry_row[None, :]] = -np.inf
        if allowed is not None:
            s[~allowed[a:a + 256]] = -np.inf
        for n, r in enumerate(s):
            # the product only shortlists, with room for its rounding: it adds up in another order for each shape
            floor = np.partition(r, len(r) - k)[len(r) - k] - SLACK if len(r) > k else -np.inf
            at = np.flatnonzero((r >= floor) & (r > -np.inf))
            # equal vectors get equal scores here, so that a tie is decided by the id
            score = (entries[at] * query[a + n]).sum(axis=1)
            best = np.lexsort((entry_id[at], -score))[:k]
            yield at[best], score[best]


def _ids(column: pa.Array) -> np.ndarray:
    """Ids for ordering; a null comes last."""
    return np.array([np.iinfo(np.int64).max if x is None else x for x in column.to_pylist()], np.int64)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(rows: DataFrame, queries: list, dim: int, k: int) -> DataFrame:
    """Exact neighbours of a bounded list of queries (row, id, v) among ``rows``: q, row, id, score, rank, i, j."""
    x = unit(np.array([q["v"] for q in queries], np.float64).reshape(-1, dim))
    own = np.array([q["row"] for q in queries], np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            e, row = unit(matrix(batch.column("v"), dim)), batch.column("row").to_numpy()
            q, at, score = [], [], []
            for n, (places, scores) in enumerate(_best(x, own, e, row, _ids(batch.column("id")), None, k)):
                q += [own[n]] * len(places)
                at += places.tolist()
                score += scores.tolist()
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), batch.column("row").take(take), batch.column("id").take(take),
                                              pa.array(score, pa.float64()), batch.column("i").take(take), batch.column("j").take(take)],
                                             ["q", "row", "id", "score", "i", "j"])

    kind = dict(rows.dtypes)["id"]
    return _top(rows.mapInArrow(scan, f"q long, row long, id {kind}, score double, i int, j int"), k)


def audited_share(entries: DataFrame, index: MultiIndex, queries: list, dim: int, k: int, recall: float) -> float:
    """The least share of entries a walk has to pass to reach ``recall`` on the audit queries."""
    if not queries:
        return 1.0
    truth: dict[int, list[tuple[int, int]]] = {}
    for r in brute_force(entries, queries, dim, k).select("q", "i", "j").collect():  # at most k per audit query
        truth.setdefault(r["q"], []).append((r["i"], r["j"]))
    d1, d2 = index.distances(unit(np.array([q["v"] for q in queries], np.float64).reshape(-1, dim)))
    need = []
    for n, q in enumerate(queries):
        cells = truth.get(q["row"], [])
        passed = index.passed_before(d1[n], d2[n], set(cells))
        need += [passed[c] for c in cells]
    if not need:
        return 1.0
    need.sort()
    return min(1.0, need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)] / max(1, int(index.sizes.sum())))


def _search(rows: DataFrame, dim: int, every: int, k: int, centroids: int, recall: float) -> DataFrame:
    sample = sampled(rows, "id", "v", dim, SAMPLE)
    half = max(1, dim // 2)
    index = MultiIndex(k_means(sample[:, :half], centroids), k_means(sample[:, half:], centroids))
    entries = _entries(rows, index, dim)
    for r in entries.groupBy("i", "j").count().collect():  # at most centroids squared
        index.sizes[r["i"], r["j"]] = r["count"]
    total = int(index.sizes.sum())
    queries = entries.where(F.col("id") % every == 0)
    audit = queries.orderBy(F.xxhash64("id"), "row").select("row", "id", "v").limit(AUDIT_QUERIES).collect()
    share = audited_share(entries, index, audit, dim, k, recall)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d1, d2 = index.distances(unit(matrix(batch.column("v"), dim)))
            at, region, cells = [], [], []
            for n in range(batch.num_rows):
                for i, js in index.probes(d1[n], d2[n], max(k + 1, share * total)).items():
                    at.append(n), region.append(i), cells.append(js)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(take), batch.column("id").take(take), batch.column("v").take(take),
                                              pa.array(region, pa.int32()), pa.array(cells, pa.list_(pa.int32()))],
                                             ["q", "query_id", "qv", "i", "cells"])

    kind = dict(rows.dtypes)["id"]
    probes = queries.select("row", "id", "v").mapInArrow(probe, f"q long, query_id {kind}, qv array<double>, i int, cells array<int>")
    # a region's number of parts, from the sizes; one number per first centroid
    parts = F.array(*[F.lit(int(-(-n // PART) or 1)) for n in index.sizes.sum(axis=1).tolist()])
    of = F.element_at(parts, F.col("i") + 1)
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), of - 1)))
    dealt = entries.withColumn("part", F.pmod(F.xxhash64("row"), of).cast("int"))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "query_id": left.column("query_id").slice(0, 0), "row": pa.array([], pa.int64()),
                             "id": right.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        x, e = unit(matrix(left.column("qv"), dim)), unit(matrix(right.column("v"), dim))
        j = right.column("j").to_numpy()
        allowed = np.zeros((len(x), centroids), bool)
        for n, js in enumerate(left.column("cells").to_pylist()):
            allowed[n, js] = True
        at, who, score = [], [], []
        found = _best(x, left.column("q").to_numpy(), e, right.column("row").to_numpy(), _ids(right.column("id")), allowed[:, j], k)
        for n, (places, scores) in enumerate(found):
            who += [n] * len(places)
            at += places.tolist()
            score += scores.tolist()
        who, at = pa.array(who, pa.int64()), pa.array(at, pa.int64())
        return pa.table({"q": left.column("q").take(who), "query_id": left.column("query_id").take(who), "row": right.column("row").take(at),
                         "id": right.column("id").take(at), "score": pa.array(score, pa.float64())})

    found = probes.groupBy("i", "part").cogroup(dealt.groupBy("i", "part")).applyInArrow(
        rerank, f"q long, query_id {kind}, row long, id {kind}, score double")
    return _top(found, k)


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5,
                       centroids: int = CENTROIDS, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` nearest found for each row whose id is
    divisible by ``every``, by cosine."""
    v = F.col(vector_col)
    rows = vectors.where(usable(v)).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), v.cast("array<double>").alias("v"))
    rows = written(rows, "ann-vectors")
    out = None
    for dim in sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect()):
        got = _search(rows.where(F.size("v") == dim), dim, every, k, centroids, recall)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = rows.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return out.select(F.col("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
