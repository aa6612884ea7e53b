"""Near-duplicate documents by BagMinHash (operator 2).

The multiset of a document's five-word shingles is signed by BagMinHash: each shingle drives
Poisson processes over its discretised weight. The weight axis is split into the intervals
[0, 1), [1, 2), [2, 4), ... each with a process of its own whose rate is the interval's
length; a point has a place in its interval and counts if that lies below the shingle's
multiplicity. Each point falls into one register, which keeps its first point. Points are made
in rising order, only until no register can change, for many documents at a time. Two
registers are equal with exactly the weighted Jaccard similarity of the multisets.

Bands of registers give buckets. Links are only made by verifying the multisets themselves
(sum of minima over sum of maxima):

1. Each document of a bucket against the bucket's hub; a pair met in many buckets is
   verified once. Components of these links follow.
2. Buckets whose other documents are of different components: every document against every
   document of another component, inside tasks, block by block. A block's links are reported
   as a forest, which keeps all of its components. Only documents outside a bucket's largest
   component make blocks of their own, so a big group costs one pass per such block.

So no candidate pair of a bucket is left out except those already known to be connected, and
no pairs are written out. Equal texts are one node of the graph from the start.

Words are runs of letters and digits in lower case; a text of one to four words is one
shingle. Defined cases: a null text is alone in its class; texts without words (the empty
text) only match equal texts; repeated rows and equal texts share a class; a null id counts
as larger than every other; an empty table gives no rows. Extra columns are ignored by
:func:`duplicate_classes` and kept by :func:`keep_one`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estima.llm.common import HOT_SHARE, join_matched, join_unique, tidy, written
from estima.llm.graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
#: Documents signed together, by their shingles; documents in a verified block.
CHUNK = 100_000
BLOCK = 800
CACHE_WORDS = 400_000

_WORD = re.compile(r"[^\W_]+")
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Hashes of a text's shingles, in the text's order, with repeats."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text.lower()) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        for w in set(words).difference(self.known):
            raw = w.encode("utf-8", "surrogatepass")
            self.known[w] = (zlib.crc32(raw) << 32) | zlib.crc32(raw, 0x5BD1E995)
        ids = mix(np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words)))
        n = min(self.size, len(ids))
        h = np.full(len(ids) - n + 1, np.uint64(n))
        for k in range(n):
            h = mix(h * _C1 + ids[k:len(ids) - n + 1 + k])
        return h

    def elements(self, text: str | None) -> np.ndarray:
        """The multiset as a sorted set: the j-th occurrence of a shingle is an element of its own."""
        h = np.sort(self(text))
        if not len(h):
            return h
        new = np.concatenate([[True], h[1:] != h[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        return np.sort(mix(h + (np.arange(len(h)) - start).astype(np.uint64) * _C1))


# ---- signatures ----------------------------------------------------------------------

def bagminhash(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, documents: int, registers: int) -> np.ndarray:
    """Signatures (documents x registers) of weighted sets; ``owner`` says whose a shingle is.
    Rows of documents without shingles are 0."""
    # one process per interval of the weight axis that the shingle reaches into
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64)
    count = levels + 1
    at = np.repeat(np.arange(len(shingle)), count)
    level = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    doc, w = owner[at].astype(np.int64), weight[at]
    seed = mix(shingle[at] * _C1 + level.astype(np.uint64) + np.uint64(1))
    rate = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    low = np.where(level > 0, rate, 0.0)
    x = np.zeros(len(at))
    best = np.full(documents * registers, np.inf)
    name = np.zeros(documents * registers, np.uint64)
    full = np.full(documents, np.inf)  # the largest of a document's registers
    step = 0
    while len(doc):
        # the more the processes have thinned out, the more points at a time
        for _ in range(1 if len(doc) > 20_000 else 4 if len(doc) > 2_000 else 24):
            step += 1
            h = mix(seed + np.uint64(step * int(_C2) & 0xFFFFFFFFFFFFFFFF))
            x = x - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            g = mix(h + _C1)
            place = low + rate * ((g >> np.uint64(40)).astype(np.float64) * 2.0**-24)
            ok = (x < full[doc]) & (place < w)
            cell = doc[ok] * registers + ((g[ok] & np.uint64(0xFFFFFF)) * np.uint64(registers) >> np.uint64(24)).astype(np.int64)
            xs, hs = x[ok], h[ok]
            np.minimum.at(best, cell, xs)
            won = xs == best[cell]
            name[cell[won]] = hs[won]
        there = np.unique(doc)
        full[there] = best.reshape(documents, registers)[there].max(axis=1)
        on = x < full[doc]
        doc, w, seed, rate, low, x = doc[on], w[on], seed[on], rate[on], low[on], x[on]
    return name.reshape(documents, registers)


def signatures(texts: list[str | None], shingler: Shingler, registers: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signatures, has shingles), CHUNK shingles at a time."""
    held, total = [], 0
    for i, text in enumerate(texts):
        held.append(shingler(text))
        total += len(held[-1])
        if total >= CHUNK or i + 1 == len(texts):
            counted = [np.unique(h, return_counts=True) for h in held]
            owner = np.repeat(np.arange(len(held)), [len(u) for u, _ in counted])
            yield (bagminhash(owner, np.concatenate([u for u, _ in counted]), np.concatenate([c for _, c in counted]).astype(float),
                              len(held), registers), np.array([len(h) > 0 for h in held]))
            held, total = [], 0


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per document and band, as signed longs; the band's number is part of it."""
    parts = signature.reshape(len(signature), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        h = mix(h * _C1 + parts[:, :, r])
    return h.view(np.int64)


# ---- verification --------------------------------------------------------------------

def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two element sets."""
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def forest(sets: list[np.ndarray], group: np.ndarray, threshold: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of sets of different groups at least ``threshold`` alike: enough of them to join all
    that such pairs join. With ``side`` (bool) only pairs of one side with the other."""
    sizes = np.array([len(s) for s in sets], float)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    width = max(256, 4_000_000 // len(sets))
    for first in range(0, int(element[-1]) + 1 if len(element) else 0, width):
        lo, hi = np.searchsorted(element, [first, first + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[lo:hi], element[lo:hi] - first] = 1
        common += x @ x.T
    alike = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    alike &= group[:, None] != group[None, :]
    alike &= sizes[:, None] > 0
    if side is not None:
        alike &= side[:, None] != side[None, :]
    top = {}

    def find(v: int) -> int:
        while top.get(v, v) != v:
            top[v] = top.get(top[v], top[v])
            v = top[v]
        return v

    out = []
    for i, j in zip(*np.nonzero(np.triu(alike, 1)), strict=True):
        a, b = find(int(i)), find(int(j))
        if a != b:
            top[a] = b
            out.append((int(i), int(j)))
    return out


# ---- on Spark ------------------------------------------------------------------------

def _bands(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Per row: k (md5 of the text) and its band hashes; written."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            keys, at = batch.column("k"), 0
            for signature, there in signatures(batch.column("text").to_pylist(), shingler, bands * rows):
                values = band_hashes(signature, bands, rows)[there].ravel()
                offsets = np.concatenate([[0], np.cumsum(there * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(there)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                                                 ["k", "bands"])
                at += len(there)

    return written(docs.mapInArrow(tidy(sign), "k binary, bands array<long>"), "minhash-bands")


def _elements(docs: DataFrame) -> DataFrame:
    """Per row: k and the multiset's elements; written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([shingler.elements(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())],
                                             ["k", "elements"])

    return written(docs.mapInArrow(tidy(run), "k binary, elements binary"), "minhash-elements")


def _alike(threshold: float):
    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= threshold for x, y in zip(a, b, strict=True)])
    return alike


def _verified_hubs(pairs: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (k, hub) that are alike. A hub of many pairs is copied, so that they spread."""
    total = pairs.count()
    most = max(200, -(-total // HOT_SHARE))  # so at most HOT_SHARE hubs have more
    hot = pairs.groupBy("hub").count().where(F.col("count") > most).select(
        F.col("hub").alias("__hub"), F.ceil(F.col("count") / most).cast("int").alias("copies"))
    spread = pairs.join(F.broadcast(hot), F.col("hub") == F.col("__hub"), "left").select(
        "k", "hub", F.pmod(F.xxhash64("k"), F.coalesce("copies", F.lit(1))).cast("int").alias("copy"))
    hubs = elements.join(pairs.select(F.col("hub").alias("k")).distinct(), "k", "left_semi")
    hubs = hubs.join(F.broadcast(hot), F.col("k") == F.col("__hub"), "left").select(
        F.col("k").alias("hub"), F.col("elements").alias("hub_elements"),
        F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    both = spread.join(elements, "k").join(hubs, ["hub", "copy"])
    return both.where(_alike(threshold)("elements", "hub_elements")).select("k", "hub")


def _within_buckets(members: DataFrame, elements: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different components inside buckets. ``members``: bucket, k, component,
    without the buckets' hubs; ``held``, if it is there, says how many rows the bucket has."""
    if "held" not in members.columns:
        members = members.withColumn("held", F.count("*").over(Window.partitionBy("bucket")))
    per = members.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("k") % 1_000_000_007).alias("s1"),
                                                     F.sum(F.xxhash64("k", F.lit(1)) % 998_244_353).alias("s2"), F.max("held").alias("held"))
    per = per.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("size"), F.max("n").alias("largest"),
                                    F.max_by("component", F.struct("n", "component")).alias("major"), F.max("held").alias("held"),
                                    F.sum("s1").alias("s1"), F.sum("s2").alias("s2")).where("parts > 1")
    # buckets of different bands with the same members are one
    per = written(per.groupBy("size", "s1", "s2").agg(F.min("bucket").alias("bucket"), F.first("major").alias("major"),
                                                      F.first("largest").alias("largest"), F.min_by("held", "bucket").alias("held")), "minhash-mixed")
    # only rows of these buckets go on; a big bucket's rows stay where they are, whether it is one of these or not
    many = max(2, -(-members.count() // HOT_SHARE))
    hot, cold = (per.where(c).select("bucket", "largest", "major") for c in (F.col("held") >= many, F.col("held") < many))
    rows = members.where(F.col("held") >= many).join(F.broadcast(hot), "bucket").unionByName(members.where(F.col("held") < many).join(cold, "bucket")).drop("held")
    sizes = per.select(F.col("bucket").alias("b2"), "size")
    big = F.broadcast(sizes.where(F.col("size") > block))  # at most members / block rows, each over block
    rows = rows.join(big, F.col("bucket") == F.col("b2"), "left").drop("b2")
    one = rows.where(F.col("size").isNull()).select("bucket", F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(False).alias("left"), "k", "component")
    # big buckets: documents outside the largest component, in blocks, each against all blocks
    many = rows.where(F.col("size").isNotNull())
    minor = F.ceil((F.col("size") - F.col("largest")) / block).cast("int")
    major = F.ceil(F.col("largest") / block).cast("int")
    outside = F.col("component") != F.col("major")
    many = many.withColumn("u", minor).withColumn("g", major).withColumn(
        "own", F.when(outside, F.pmod(F.xxhash64("k"), F.col("u"))).otherwise(F.pmod(F.xxhash64("k"), F.col("g"))).cast("int"))
    left = many.where(outside).select("bucket", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("g") + F.col("u") - 1)).alias("j"),
                                      F.lit(True).alias("left"), "k", "component")
    right = many.select("bucket", F.explode(F.sequence(F.lit(0), F.col("u") - 1)).alias("i"),
                        (F.col("own") + F.when(outside, F.col("g")).otherwise(0)).alias("j"), F.lit(False).alias("left"), "k", "component")
    work = one.unionByName(left).unionByName(right).join(elements, "k")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in group["elements"]]
        codes = pd.factorize(group["component"])[0]
        side = group["left"].to_numpy() if group["j"].iloc[0] >= 0 else None
        k = group["k"].tolist()
        found = forest(sets, codes, threshold, side)
        return pd.DataFrame({"a": [k[i] for i, _ in found], "b": [k[j] for _, j in found]})

    return work.groupBy("bucket", "i", "j").applyInPandas(run, "a binary, b binary")


def duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, component: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id (smallest doc_id of its class),
    k (md5 of the text, null for a null text); with ``component`` also the class's key."""
    keyed = docs.select("doc_id", F.unhex(F.md5(F.col("text"))).alias("k"), "text")
    texts = keyed.where(F.col("k").isNotNull()).select("k", "text")
    signed = _bands(texts, bands, rows)
    nodes = signed.where(F.size("bands") > 0).dropDuplicates(["k"])
    places = written(nodes.select("k", F.explode("bands").alias("bucket")), "minhash-places")
    shared = places.groupBy("bucket").agg(F.count("*").alias("n"), F.min("k").alias("hub")).where("n > 1").withColumn("size", F.col("n"))
    members = written(join_matched(places, written(shared, "minhash-shared"), "bucket", places.count(), "n"), "minhash-members")
    pairs = written(members.where("k != hub").select("k", "hub").distinct(), "minhash-pairs")
    wanted = members.select("k").distinct()
    elements = _elements(texts.join(wanted, "k", "left_semi").dropDuplicates(["k"]))
    links = written(_verified_hubs(pairs, elements, threshold).select(F.col("k").alias("a"), F.col("hub").alias("b")), "minhash-links")
    known = written(components(links, "a", "b"), "minhash-components")
    # every pair with a hub is verified already, so what is left is among the others
    rest = members.where("k != hub and size > 2")
    labelled = rest.join(known, F.col("k") == F.col("node"), "left").select(
        "bucket", "k", F.coalesce("component", "k").alias("component"), (F.col("size") - 1).alias("held"))
    more = written(_within_buckets(written(labelled, "minhash-labelled"), elements, threshold), "minhash-links")
    if not more.isEmpty():
        stars = known.select(F.col("node").alias("a"), F.col("component").alias("b"))
        known = written(components(stars.unionByName(more), "a", "b"), "minhash-components")
    return classes(keyed.select("doc_id", "k"), known, component)


def classes(keyed: DataFrame, known: DataFrame, component: bool = False) -> DataFrame:
    """doc_id, class_id, k (``component``: and the smallest k of the class, which no other class has,
    whatever the ids) from the documents' keys and the components of keys."""
    more = ["component"] if component else []
    per = keyed.where(F.col("k").isNotNull()).groupBy("k").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    per = per.join(known, F.col("k") == F.col("node"), "left").select("k", "first", "n", F.coalesce("component", "k").alias("component"))
    per = written(per, "minhash-keys")
    tops = per.groupBy("component").agg(F.min("first").alias("class_id"), F.count("*").alias("m"))
    per = join_unique(per, tops, "component", per.count(), "m")
    got = join_unique(keyed, per.select("k", "class_id", "n", *more), "k", keyed.count(), "n")
    return got.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "k", *more)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of each class the row with the smallest doc_id (nulls last), then the smallest key of the text;
    of equal rows one. Rows without a text are all kept. Ids may repeat or be null."""
    found = duplicate_classes(docs.select("doc_id", "text"), threshold, component=True).where(F.col("k").isNotNull())
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("__id"),
                                                         F.col("k").alias("__k"))).alias("first")).select("first.__id", "first.__k")
    some = docs.where(F.col("text").isNotNull()).withColumn("__key", F.unhex(F.md5(F.col("text"))))
    out = some.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left_semi")
    out = out.dropDuplicates(["doc_id", "__key"]).select(*docs.columns)
    return out.unionByName(docs.where(F.col("text").isNull()))
