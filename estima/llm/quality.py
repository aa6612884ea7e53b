"""Quality classifier: random-indexing word vectors and a small calibrated network (operator 1).

1. Random indexing over the whole corpus. Every token (a word in lower case, the marks at its
   edges, a mark for capitals, a mark for a word said again) falls into one of a fixed number
   of hash buckets; a bucket's index vector is sparse and of signs, made from its number. A
   bucket's context vector is the sum of the index vectors of its neighbours. Each task sums a
   table of whole numbers of fixed size; tables are added block by block, a bounded number at a
   time, so the sums do not depend on the order and no task gathers all of them.
2. Word vectors are the context vectors, scaled by the bucket's count, centred and normalised.
   A document's vector is the mean and the deviation of its tokens' word vectors.
3. A two-layer numpy network is fitted on the vectors of a bounded sample of labelled
   documents; every fourth of them fits a temperature instead.

Defined cases: a null or empty text has the zero vector and gets a score like any other; a
document labelled twice counts as good only if no label says otherwise; labels that are null
or of missing documents are left out; without both classes every score is the share of good
labels (0.5 where there is none). Very long texts count in full. Repeated rows are scored
each; an empty table gives no rows. Extra columns are kept by :func:`reject_poor`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.llm.common import crc32_text, least_hashes, release, tidy, written

BUCKETS = 1 << 13
DIMENSIONS = 40
#: Nonzero entries of an index vector, and neighbours to each side.
NONZERO = 2
NEAR = 2
#: Labelled documents of each class in the fitted sample.
SAMPLE_DOCS = 6000
HIDDEN = 24
#: Tokens handled at a time and distinct tokens in a task's table.
CHUNK_TOKENS = 150_000
CACHE_TOKENS = 250_000
#: Buckets in a block, and tables added in one group.
BLOCK = 512
TOGETHER = 128

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”‘’…–—"
_AGAIN, _UPPER = 0, 1


# ---- tokens --------------------------------------------------------------------------

def _bucket(text: str) -> int:
    return 2 + zlib.crc32(text.encode("utf-8", "surrogatepass")) % (BUCKETS - 2)


def _look(token: str) -> tuple[int, int, int]:
    """Buckets of a token: mark for capitals, word, marks at its edges (-1: none)."""
    if token.isalpha():
        return (_UPPER if len(token) > 1 and token.isupper() else -1, _bucket(token.lower()), -1)
    core = token.strip(_EDGES)
    edge = token.replace(core, "", 1)[:8] if core else token[:8]
    return (_UPPER if len(core) > 1 and core.isupper() else -1, _bucket(core.lower()) if core else -1,
            _bucket("\t" + edge) if edge else -1)


class Tokens:
    """Bucket streams of texts; each distinct token is looked at once."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, 3), np.int32)

    def streams(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, buckets, number of buckets of each document), CHUNK_TOKENS at a time."""
        first, held, lengths = 0, [], []
        for i, text in enumerate(texts):
            tokens = text.split() if text else []
            lengths.append(len(tokens))
            held += tokens
            if len(held) >= CHUNK_TOKENS or i + 1 == len(texts):
                yield first, *self._stream(held, np.array(lengths))
                first, held, lengths = i + 1, [], []

    def _stream(self, tokens: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE_TOKENS:
            self.known.clear()
        fresh = [t for t in set(tokens) if t not in self.known]
        n = len(self.known)
        self.known.update(zip(fresh, range(n, n + len(fresh)), strict=True))
        if len(self.table) < n + len(fresh):
            self.table = np.concatenate([self.table[:n], np.zeros((n + 2 * len(fresh), 3), np.int32)])
        if fresh:
            self.table[n:n + len(fresh)] = np.fromiter((x for t in fresh for x in _look(t)), np.int32, 3 * len(fresh)).reshape(-1, 3)
        ids = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        got = self.table[ids]
        doc = np.repeat(np.arange(len(lengths)), lengths)
        again = np.flatnonzero((ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])) + 1
        got[again] = [-1, _AGAIN, -1]
        there = got >= 0
        return got[there], np.bincount(doc, weights=there.sum(axis=1), minlength=len(lengths)).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each bucket's index vector."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    return (rng.integers(0, DIMENSIONS, (BUCKETS, NONZERO)).astype(np.int64), rng.integers(0, 2, (BUCKETS, NONZERO)) * 2 - 1)


# ---- word vectors over the corpus ----------------------------------------------------

def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's table of context sums (the last column counts), as blocks of buckets."""
    places, signs = index_vectors()
    width = DIMENSIONS + 1
    total, tokens = np.zeros(BUCKETS * width, np.int64), Tokens()
    entries = places + (signs < 0) * len(total)  # negative entries are counted in a second table
    for batch in batches:
        for _, b, n in tokens.streams(batch.column("text").to_pylist()):
            b = b.astype(np.int64)
            total[DIMENSIONS::width] += np.bincount(b, minlength=BUCKETS)
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            keys = []
            for o in range(1, NEAR + 1):
                same = doc[o:] == doc[:-o]
                left, right = b[:-o][same], b[o:][same]
                for k in range(NONZERO):
                    keys += [left * width + entries[right, k], right * width + entries[left, k]]
            got = np.bincount(np.concatenate(keys), minlength=2 * len(total))
            total += got[: len(total)] - got[len(total):]
    if total.any():
        parts = total.reshape(-1, BLOCK * width)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())],
                                         ["block", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Word vector of each bucket, from all of ``docs``; BUCKETS x DIMENSIONS numbers reach the driver."""
    parts = written(docs.select("text").mapInArrow(tidy(_blocks), "block int, sums binary")
                    .withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)), "quality-sums")

    def add(group: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(x, np.int64) for x in group["sums"])
        return pd.DataFrame({"block": [group["block"].iloc[0]], "sums": [sums.tobytes()], "part": [group["part"].min()]})

    most, divide = parts.agg(F.max("part")).first()[0] or 0, TOGETHER
    while True:  # tables of tasks, then of groups of tasks, TOGETHER at a time
        parts = parts.groupBy("block", F.floor(F.col("part") / divide).alias("__of")).applyInPandas(
            add, "block int, sums binary, part long")
        if most < divide:
            break
        divide *= TOGETHER
    total = np.zeros((BUCKETS // BLOCK, BLOCK * (DIMENSIONS + 1)), np.int64)
    for r in parts.select("block", "sums").collect():  # one row per block
        total[r["block"]] += np.frombuffer(r["sums"], np.int64)
    return scaled(total.reshape(BUCKETS, DIMENSIONS + 1))


def scaled(sums: np.ndarray) -> np.ndarray:
    """Context sums over counts, centred by the corpus mean, at unit length; unseen buckets are 0."""
    count = sums[:, -1:].astype(float)
    v = sums[:, :-1] / np.maximum(count, 1)
    v -= (v * count).sum(axis=0) / max(1.0, count.sum())
    v[count[:, 0] == 0] = 0
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(tokens: Tokens, vectors: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Mean and deviation of the word vectors of each text's tokens."""
    out = np.zeros((len(texts), 2 * DIMENSIONS), np.float32)
    for first, b, n in tokens.streams(texts):
        full = np.flatnonzero(n)
        if not len(full):
            continue
        starts = (np.cumsum(n) - n)[full]
        v = vectors[b]
        mean = np.add.reduceat(v, starts, axis=0) / n[full, None]
        square = np.add.reduceat(np.square(v, out=v), starts, axis=0) / n[full, None]
        out[first + full] = np.hstack([mean, np.sqrt(np.maximum(square - mean**2, 0))])
    return out


# ---- the network ---------------------------------------------------------------------

class Network:
    """x -> tanh(x W1 + b1) w2 + b2, divided by a temperature, through a logistic."""

    def __init__(self, shift, scale, w1, b1, w2, b2, temperature=1.0, constant=None):
        self.shift, self.scale, self.w1, self.b1, self.w2, self.b2 = shift, scale, w1, b1, w2, b2
        self.temperature, self.constant = temperature, constant

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4) -> Network:
    """Adam on the mean log loss, both classes at equal weight; every fourth row sets the temperature."""
    if not len(y) or y.min() == y.max():
        zero = np.zeros(1)
        return Network(zero, zero + 1, np.zeros((1, 1)), zero, zero, 0.0, constant=float(y.mean()) if len(y) else 0.5)
    rng = np.random.Generator(np.random.PCG64(7))
    held = np.arange(len(y)) % 4 == 3
    if any(len(np.unique(y[f])) < 2 for f in (held, ~held)):
        held[:] = False
    xt, yt = x[~held].astype(float), y[~held].astype(float)
    shift, scale = xt.mean(axis=0), xt.std(axis=0) + 1e-3
    xs = (xt - shift) / scale
    weight = np.where(yt > 0, 0.5 / yt.mean(), 0.5 / (1 - yt.mean()))
    params = [rng.normal(0, 1 / np.sqrt(xs.shape[1]), (xs.shape[1], hidden)), np.zeros(hidden),
              rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, s, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(yt))
        for a in range(0, len(order), 128):
            i = order[a:a + 128]
            w1, b1, w2, b2 = params
            h = np.tanh(xs[i] @ w1 + b1)
            p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -60, 60)))
            d = weight[i] * (p - yt[i]) / len(i)
            back = np.outer(d, w2) * (1 - h**2)
            grads = [xs[i].T @ back + decay * w1, back.sum(axis=0), h.T @ d + decay * w2, np.array([d.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(shift, scale, params[0], params[1], params[2], float(params[3][0]))
    use = held if held.any() else ~held
    z, yh = net.logits(x[use].astype(float)), y[use].astype(float)
    # the temperature with the least log loss, softened targets keep it away from 0
    grid = np.exp(np.linspace(np.log(0.25), np.log(20), 120))
    loss = [np.mean(np.logaddexp(0, z / g) - (0.99 * yh + 0.005) * z / g) for g in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


# ---- on Spark ------------------------------------------------------------------------

def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held: int = 1,
          per_class: int = SAMPLE_DOCS) -> tuple[np.ndarray, Network]:
    """Word vectors from all of ``docs`` and a network from a bounded labelled sample, chosen by a
    hash of the id; ids whose crc32 mod ``modulus`` is ``held`` are not used."""
    vectors = word_vectors(docs)
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
             .where(crc32_text(F.col("doc_id")) % modulus != held)
             .groupBy("doc_id").agg((F.min(label) > 0).cast("int").alias("__label")))
    known = known.join(docs.select(F.col("doc_id").alias("__id")).distinct(), F.col("doc_id") == F.col("__id"), "left_semi")
    picked = []
    for v in (0, 1):
        picked += least_hashes(known.where(F.col("__label") == v), per_class, "doc_id").collect()
    if not picked:
        return vectors, fit(np.zeros((0, 2 * DIMENSIONS)), np.zeros(0))
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in picked], known.select("doc_id", "__label").schema)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most 2 * per_class ids

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            x = pooled(tokens, vectors, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__label"),
                                              pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "__label", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = (sample.mapInArrow(tidy(vectorise), f"doc_id {kind}, __label int, x binary")
            .groupBy("doc_id", "__label").agg(F.min("x").alias("x")).collect())
    rows.sort(key=lambda r: zlib.crc32(str(r["doc_id"]).encode()))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    net = fit(x, np.array([r["__label"] for r in rows]))
    del rows, x
    release()
    return vectors, net


def scores(vectors: np.ndarray, net: Network):
    """Pandas UDF: probability that a text is good."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = Tokens()
        for batch in batches:
            yield pd.Series(net.probability(pooled(tokens, vectors, batch.tolist()).astype(float)))
        del tokens
        release()

    return score


def score_documents(docs: DataFrame, vectors: np.ndarray, net: Network, name: str = "score") -> DataFrame:
    return docs.withColumn(name, scores(vectors, net)(F.col("text")))


def reject_poor(docs: DataFrame, vectors: np.ndarray, net: Network, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their own columns."""
    return docs.where(scores(vectors, net)(F.col("text")) >= threshold)
