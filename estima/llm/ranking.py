"""Ranked lexical search by dual trees (operator 12).

Items (the queries) and documents are sparse vectors over the items' terms: an item holds the
weight of a term times its repeats, a document the term's impact, which falls with the
document's length; a score is their product in whole numbers. Two hierarchies are searched
against each other. A node holds, for each coordinate, the maximum over what lies below it, so the
product of an item node and a document node is at least every score between them. A pair of
nodes is dropped, with all items and documents below it, when that bound is less than the
weakest k-th score that the items of the node have so far; ties are kept, so nothing that could
be in a result is lost. What is left at the leaves is scored exactly.

On Spark: one pass over the whole texts counts terms and writes each document's vector over the
items' terms; term statistics are aggregates over all documents. Every task then builds trees
over the documents it reads, searches them with the tree of the items and returns its best few
of each item. A first search over a fixed share of the documents gives every task a k-th score
to start from; it is a true bound and changes no result. Items are taken in blocks of a bounded
number, and only a block's tree is sent to the tasks.

Defined cases: null and empty texts, and texts without a term, are no documents; an item
without a term has no rows; rows that repeat an item are searched each, rows that repeat a
document are ranked each; equal scores go by ascending id, null ids last; empty tables give no
rows. Very long texts count in full. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estima.llm.common import written

#: Items searched in one go, and bytes of their texts.
ITEMS = 4096
ITEM_BYTES = 16 << 20
#: Children of a node.
FAN = 8
#: Documents in one tree, and tokens held at a time while counting.
TREE = 4096
HELD = 200_000
#: One in so many documents is searched first, for scores to start from.
FIRST = 32

# a term is made of letters, digits and everything beyond ASCII; A-Z count as a-z
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_FOLD).split()


# ---- sparse rows and trees -----------------------------------------------------------

class Rows:
    """Sparse rows: row r has ``values[a:b]`` at ``places[a:b]``, with a, b = ``starts[r], starts[r + 1]``."""

    def __init__(self, starts: np.ndarray, places: np.ndarray, values: np.ndarray):
        self.starts, self.places, self.values = starts, places, values

    def __len__(self) -> int:
        return len(self.starts) - 1

    def taken(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of ``rows`` one after the other, and where each row begins among them."""
        size = self.starts[rows + 1] - self.starts[rows]
        begin = np.cumsum(size) - size
        return np.repeat(self.starts[rows] - begin, size) + np.arange(size.sum()), begin

    def ordered(self, order: np.ndarray) -> Rows:
        at, _ = self.taken(order)
        size = self.starts[order + 1] - self.starts[order]
        return Rows(np.concatenate([[0], np.cumsum(size)]), self.places[at], self.values[at])

    def parents(self, width: int) -> Rows:
        """A row for every ``FAN`` rows: the maximum at each place."""
        row = np.repeat(np.arange(len(self)), np.diff(self.starts)) // FAN
        key = row * width + self.places
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        top = np.maximum.reduceat(self.values[order], first) if len(key) else self.values
        n = -(-len(self) // FAN)
        return Rows(np.searchsorted(key[first], np.arange(n + 1) * width), key[first] % width, top)

    def by_likeness(self, width: int, weight: np.ndarray) -> np.ndarray:
        """An order that puts rows with the same heaviest places side by side."""
        row = np.repeat(np.arange(len(self)), np.diff(self.starts))
        heavy = self.values * weight[self.places]
        order = np.lexsort((self.places, -heavy, row))
        size = np.diff(self.starts)
        keys = [np.arange(len(self))]
        for k in (2, 1, 0):
            there = size > k
            key = np.full(len(self), width)
            key[there] = self.places[order][self.starts[:-1][there] + k]
            keys.append(key)
        return np.lexsort(keys)


def tree(leaves: Rows, width: int) -> list[Rows]:
    """Levels of nodes, from ``leaves`` to one node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].parents(width))
    return levels


class Items:
    """The tree of a block of items over their terms."""

    def __init__(self, ids: list[int | None], texts: list[bytes]):
        counts = [Counter(terms(t)) for t in texts]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        size = [len(c) for c in counts]
        places = np.array([self.vocabulary[t] for c in counts for t in c], np.int64)
        values = np.array([n for c in counts for n in c.values()], np.int64)
        self.rows = Rows(np.concatenate([[0], np.cumsum(size)]).astype(np.int64), places, values)
        self.ids = ids

    def weigh(self, docs: int, df: np.ndarray) -> None:
        """Weights from the number of documents and of those holding each term; builds the tree."""
        self.weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        shared = np.bincount(self.rows.places, minlength=len(df)) > 1
        order = self.rows.by_likeness(len(df), self.weight * shared + 1)
        rows = self.rows.ordered(order)
        self.ids = [self.ids[i] for i in order.tolist()]
        self.levels = tree(Rows(rows.starts, rows.places, rows.values * self.weight[rows.places]), len(df))


class Search:
    """The best documents of each item so far, and what a task's documents add to them."""

    def __init__(self, items: Items, floors: np.ndarray, k: int):
        self.items, self.k, self.width = items, k, len(items.vocabulary)
        self.best: list[list[tuple]] = [[] for _ in items.ids]
        self.floors = [np.maximum(floors, 1)]
        while len(self.floors) < len(items.levels):
            self.floors.append(np.minimum.reduceat(self.floors[-1], np.arange(0, len(self.floors[-1]), FAN)))
        self.dense = np.zeros(self.width)
        self.exact = np.zeros((FAN, self.width), np.int64)

    def alive(self, docs: Rows, node: int) -> np.ndarray:
        """Items that a document below the node may still serve."""
        a, b = docs.starts[node], docs.starts[node + 1]
        self.dense[docs.places[a:b]] = docs.values[a:b]
        nodes = np.zeros(1, np.int64)
        for level in range(len(self.items.levels) - 1, -1, -1):
            rows = self.items.levels[level]
            nodes = nodes[rows.starts[nodes + 1] > rows.starts[nodes]]
            if len(nodes):
                at, begin = rows.taken(nodes)
                bound = np.add.reduceat(rows.values[at] * self.dense[rows.places[at]], begin)
                nodes = nodes[bound * (1 + 1e-9) >= self.floors[level][nodes]]
            if not len(nodes):
                break
            if level:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = nodes[nodes < len(self.items.levels[level - 1])]
        self.dense[docs.places[a:b]] = 0
        return nodes

    def score(self, docs: Rows, first: int, items: np.ndarray, names: list[tuple]) -> None:
        """Scores ``FAN`` documents from ``first`` on for ``items``, exactly."""
        last = min(first + FAN, len(docs))
        for d in range(first, last):
            a, b = docs.starts[d], docs.starts[d + 1]
            self.exact[d - first, docs.places[a:b]] = docs.values[a:b]
        rows = self.items.levels[0]
        at, begin = rows.taken(items)
        got = np.add.reduceat(self.exact[:, rows.places[at]] * rows.values[at], begin, axis=1)
        self.exact[:last - first] = 0
        for d, n in zip(*np.nonzero(got[:last - first] >= self.floors[0][items]), strict=True):
            self.add(int(items[n]), (int(got[d, n]), *names[first + d]))

    def add(self, item: int, entry: tuple) -> None:
        best = self.best[item]
        if len(best) < self.k:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)
        if len(best) == self.k and best[0][0] > self.floors[0][item]:
            self.floors[0][item] = best[0][0]
            for level in range(1, len(self.floors)):  # the weakest score of every node above
                item //= FAN
                self.floors[level][item] = self.floors[level - 1][item * FAN:(item + 1) * FAN].min()

    def documents(self, impacts: Rows, names: list[tuple]) -> None:
        """Searches documents with (place in the order of ties) ``names``."""
        order = impacts.by_likeness(self.width, self.items.weight)
        levels, names = tree(impacts.ordered(order), self.width), [names[i] for i in order.tolist()]
        if len(levels) == 1:
            levels.append(levels[0].parents(self.width))
        open_nodes = [(len(levels) - 1, 0)]
        while open_nodes:
            level, node = open_nodes.pop()
            items = self.alive(levels[level], node)
            if not len(items):
                continue
            if level == 1:
                self.score(levels[0], node * FAN, items, names)
            else:
                open_nodes += [(level - 1, c) for c in range(node * FAN, min((node + 1) * FAN, len(levels[level - 1])))]


# ---- on Spark ------------------------------------------------------------------------

def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Each document's number of terms, and of each term of ``vocabulary``: row, doc_id, n, places, tfs."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most a block of items' terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        width = len(known.value)

        def flush(at: int, held: list[bytes], n: list[int]) -> pa.RecordBatch:
            found = np.fromiter(map(get, held, repeat(-1)), np.int64, len(held))
            doc = np.repeat(np.arange(len(n)), n)[found >= 0]
            key, tf = np.unique(doc * width + found[found >= 0], return_counts=True)
            starts = np.searchsorted(key, np.arange(len(n) + 1) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(x)) for x in ((key % max(width, 1)).astype(np.int32), tf.astype(np.int64))]
            return pa.RecordBatch.from_arrays([ids.slice(at, len(n)), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "places", "tfs"])

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            at, held, n = 0, [], []
            for i in range(batch.num_rows):
                got = terms(texts[i].as_py())
                n.append(len(got))
                held += got
                if len(held) >= HELD or i + 1 == batch.num_rows:
                    yield flush(at, held, n)
                    at, held, n = i + 1, [], []

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.length("text") > 0)
    found = rows.mapInArrow(count, f"doc_id {kind}, n long, places array<int>, tfs array<long>").where("n > 0")
    return written(found.withColumn("row", F.monotonically_increasing_id()), "rank-vectors")


def _found(vectors: DataFrame, items: Items, floors: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """The best ``k`` of every item: item (its place), item_id, doc_id, row, score, rank."""
    sent = vectors.sparkSession.sparkContext.broadcast((items, floors))  # a block of items

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, least = sent.value
        state = Search(block, least.copy(), k)
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                part = batch.slice(at, TREE)
                places, tfs = part.column("places"), part.column("tfs")
                starts = places.offsets.to_numpy().astype(np.int64)
                tf = tfs.flatten().to_numpy()
                m = 75 + (25 * part.column("n").to_numpy() * docs) // length
                impact = (1000000000 * tf) // (1000 * tf + 12 * np.repeat(m, np.diff(starts)))
                ids, row = part.column("doc_id").to_pylist(), part.column("row").to_pylist()
                names = [(i is not None, -(i or 0), -r) for i, r in zip(ids, row, strict=True)]
                state.documents(Rows(starts - starts[0], places.flatten().to_numpy().astype(np.int64), impact), names)
        out = [(n, block.ids[n], -e[2] if e[1] else None, -e[3], e[0]) for n, best in enumerate(state.best) for e in best]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                                         ["item", "item_id", "doc_id", "row", "score"])

    # a document without any of the terms has no score above 0
    rows = vectors.where(F.size("places") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), "row", "n", "places", "tfs")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return rows.mapInArrow(search, "item int, item_id long, doc_id long, row long, score long").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(docs: DataFrame, items: Items, k: int) -> DataFrame:
    vectors = _vectors(docs, items.vocabulary)
    total = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    df = np.zeros(len(items.vocabulary), np.int64)
    for r in vectors.select(F.explode("places").alias("place")).groupBy("place").count().collect():  # a block of items' terms
        df[r["place"]] = r["count"]
    items.weigh(total["docs"], df)
    floors = np.zeros(len(items.ids), np.int64)
    first = vectors.where(F.pmod(F.xxhash64("row"), F.lit(FIRST)) == 0)
    if total["docs"]:
        for r in _found(first, items, floors, total["docs"], total["length"], k).where(F.col("rank") == k).select("item", "score").collect():
            floors[r["item"]] = r["score"]
    return _found(vectors, items, floors, total["docs"], total["length"] or 1, k)


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 20, most: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    items = written(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
                    .withColumn("row", F.monotonically_increasing_id()), "rank-items")
    size = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("bytes")).first()
    blocks = max(-(-size["n"] // most), -(-(size["bytes"] or 0) // ITEM_BYTES))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row").collect()  # a block
        block = Items([r["item_id"] for r in rows], [bytes(r["text"]) for r in rows])
        if block.vocabulary:
            out = out.unionByName(_search(docs, block, k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
