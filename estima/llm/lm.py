"""Language-model scores from a log-frequency Bloom filter (operator 11).

Counting. A token's key is its 96-bit digest, a pair's key 48 bits mixed from its tokens'
digests. Documents are cut into chunks of tokens; a chunk is one row with its tokens as numbers
into its own list of distinct digests, so a text is cut into tokens once. Every chunk counts
its distinct words and pairs, sorts them and hands them out by ranges of the key, its *segments*;
the number of segments follows the corpus. A segment's task adds the counts of all chunks: a
word or pair, however frequent, comes once from a chunk.

The filter. A count c is quantised to q = 1 + floor(log2 c), and q events (n-gram, 1) ..
(n-gram, q) set bits of the segment's Bloom filter, whose size follows its number of events.
To read a count, (n-gram, 1), (n-gram, 2), ... are probed until one is missing; the last hit
stands for the mean count of its class. Errors are one-sided (a count is never read too low)
and rare (``2 ** -PROBES`` a probe).

Scoring. p(w) = (c(w) + 1) / (N + V + 1), p(w | v) = (c(vw) + PRIOR p(w)) / (c(v) + PRIOR), with counts from
the filter, c(vw) at most c(v), N training tokens and V distinct ones; a text begins after a
start mark and ends with the end token. The filter is broadcast and every worker probes it,
where its size is proven to be at most ``SENT_BYTES`` (an event is a token or a pair at least,
so it has no more than 2 N events). Beyond that the segments stay where they are, answer the
probes of each chunk's distinct words and pairs, and the answers go to the chunks: the same
reads of the same bits, so the scores don't depend on the way. The exact counts behind the
add-one base score always go that way.

Defined cases: a null or empty text is one end token; without training documents every count is
0, and the scores are 0; a null id counts as the empty text where the held-out share is drawn;
repeated rows count and are scored each; a very long text is a chunk of its own and counts in
full; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.llm.common import crc32_text, release, tidy, written

#: Weight of a word's own probability beside its counts after a word.
PRIOR = 4.0
#: Bits an event sets; a probe errs with 2 ** -PROBES.
PROBES = 6
#: Tokens of a chunk, and of the corpus for each segment.
CHUNK = 1 << 19
SEGMENT = 1 << 20
#: Keys probed at a time.
SLICE = 1 << 16
#: A filter that is proven to have at most so many bytes is broadcast.
SENT_BYTES = 256 << 20

_END, _START = b"\n", b"\r"  # no token has whitespace; number 0 and 1 in every chunk
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def segment_of(key: np.ndarray, segments: int) -> np.ndarray:
    """Number of the segment that holds a 48-bit key; segments are ranges of the key."""
    return ((key >> np.uint64(16)) * np.uint64(segments)) >> np.uint64(32)


# ---- chunks --------------------------------------------------------------------------

def _packed(ids: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, compressed: the upper planes are nearly empty."""
    return pa.compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32).ravel()


class _Numbers(dict):
    """Numbers of tokens in the order they are met."""

    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


def _chunks(size: int):
    """Rows of documents as chunks of about ``size`` tokens: tokens as numbers into the chunk's distinct digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "held", "length", "ids", "digests"]

        def row(docs: list, held: list, length: list, ids: list, known: _Numbers) -> pa.RecordBatch:
            digests = b"".join([xxhash.xxh3_128_digest(t)[:12] for t in known])
            return pa.RecordBatch.from_arrays([
                pa.array([docs], pa.list_(kind)), pa.array([held], pa.list_(pa.bool_())), pa.array([length], pa.list_(pa.int64())),
                pa.array([_packed(np.concatenate(ids))], pa.binary()), pa.array([digests], pa.binary())], names)

        def fresh() -> tuple:
            known = _Numbers()
            _ = known[_END], known[_START]
            return [], [], [], [], known

        kind = pa.int64()
        docs, held, length, ids, known = fresh()
        tokens = 0
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            texts = batch.column("text")
            for i, (doc, out) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), strict=True)):
                words = (texts[i].as_py() or b"").lower().split()  # bytes: A-Z and ASCII whitespace only
                words.append(_END)
                ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                docs.append(doc), held.append(out), length.append(len(words))
                tokens += len(words)
                if tokens >= size:
                    yield row(docs, held, length, ids, known)
                    docs, held, length, ids, known = fresh()
                    tokens = 0
        if docs:
            yield row(docs, held, length, ids, known)
    return run


class Chunk:
    """One row of the table of chunks."""

    def __init__(self, held: list[bool], length: list[int], ids: bytes, digests: bytes):
        self.held, self.length = np.array(held, bool), np.array(length, np.int64)
        self.ids = _unpacked(ids, int(self.length.sum()))
        table = np.frombuffer(digests, np.uint8).reshape(-1, 12)
        self.high = np.ascontiguousarray(table[:, :8]).view(np.uint64).ravel()
        self.low = np.ascontiguousarray(table[:, 8:]).view(np.uint32).ravel()
        self.doc = np.repeat(np.arange(len(self.length), dtype=np.int32), self.length)
        self.counted = ~self.held[self.doc]
        # distinct words in the order of their keys, and each word's place there
        self.order = np.lexsort((self.low, self.high))
        self.place = np.empty(len(self.order), np.int32)
        self.place[self.order] = np.arange(len(self.order), dtype=np.int32)
        # the word before each token
        self.before = np.empty_like(self.ids)
        self.before[1:] = self.ids[:-1]
        self.before[np.cumsum(self.length) - self.length] = 1

    def words(self) -> np.ndarray:
        """How often training documents hold each distinct word, in order; the start mark once a document."""
        count = np.bincount(self.ids[self.counted], minlength=len(self.high))
        count[1] = (~self.held).sum()
        return count[self.order]

    def pairs(self) -> np.ndarray:
        """Key of the pair that ends at each token."""
        return _mixed(self.high[self.before] * _MIX[0] + self.high[self.ids]) >> np.uint64(16)


_CHUNK = ("held", "length", "ids", "digests")


# ---- counts and filters of segments --------------------------------------------------

def _pack(key: np.ndarray) -> bytes:
    """48-bit keys as six bytes each."""
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _coded(n: np.ndarray) -> bytes:
    """Counts as one byte each, the rare large ones in full behind."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype(np.int64).tobytes()


def _decoded(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data[:n], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:], np.int64)
    return out


def _handed_out(order: int, segments: int):
    """Every chunk's distinct words (``order`` 1) or pairs (2) and their training counts, by segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(*[batch.column(n)[i].as_py() for n in _CHUNK])
                if order == 1:
                    high, low, count = c.high[c.order], c.low[c.order], c.words()
                    key = high >> np.uint64(16)
                else:
                    key, inverse = np.unique(c.pairs(), return_inverse=True)
                    count = np.bincount(inverse[c.counted], minlength=len(key))
                cut = np.searchsorted(segment_of(key, segments), np.arange(segments + 1))
                full = np.flatnonzero(np.diff(cut))
                parts = [slice(cut[s], cut[s + 1]) for s in full]
                keys = [high[p].tobytes() + low[p].tobytes() if order == 1 else _pack(key[p]) for p in parts]
                yield pa.RecordBatch.from_arrays([
                    pa.array(full, pa.int64()), pa.array([batch.column("chunk")[i].as_py()] * len(full), pa.int64()),
                    pa.array(keys, pa.binary()), pa.array([_coded(count[p]) for p in parts], pa.binary())], ["segment", "chunk", "keys", "counts"])
    return run


def quantised(count: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count); 0 for 0."""
    return np.frexp(count.astype(np.float64))[1].astype(np.uint8)


#: The mean of the counts whose quantised count is q (0 for 0).
EXPECTED = np.concatenate([[0.0], (2.0 ** np.arange(64) + 2.0 ** np.arange(1, 65) - 1) / 2])


def _places(key: np.ndarray, level: int, bits: np.ndarray | int, probes: int) -> Iterator[np.ndarray]:
    """The bits of the event (n-gram, level) in filters of ``bits`` bits."""
    h = _mixed(key + np.uint64(level * int(_MIX[0]) % (1 << 64)))
    step = _mixed(h ^ _MIX[2]) | np.uint64(1)
    for _ in range(probes):
        # the upper 32 bits, scaled to the number of bits
        yield ((h >> np.uint64(32)) * np.asarray(bits, np.uint64)) >> np.uint64(32)
        h = h + step


def filter_bits(key: np.ndarray, level: np.ndarray, probes: int = PROBES) -> bytes:
    """A segment's filter: events (key, 1) .. (key, level)."""
    events = int(level.sum(dtype=np.int64))
    # bits a multiple of 8, at the size where half of them are set; below 2 ** 32 as segments are bounded
    bits = max(8, -(-int(events * probes / np.log(2)) // 8) * 8) if events else 0
    held = np.zeros(bits, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        for at in _places(key[level >= q], q, bits, probes):
            held[at] = 1
    return np.packbits(held, bitorder="little").tobytes()


def probe(key: np.ndarray, begin: np.ndarray | int, bits: np.ndarray | int, data: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """Quantised counts of ``key`` read from filters of ``bits`` bits that begin at bit ``begin`` of ``data``."""
    out = np.zeros(len(key), np.uint8)
    begin, bits = (np.broadcast_to(np.asarray(x, np.int64), key.shape) for x in (begin, bits))
    for a in range(0, len(key), SLICE):
        alive, level = a + np.flatnonzero(bits[a:a + SLICE]), 0
        while len(alive):
            level += 1
            hit = np.ones(len(alive), bool)
            for at in _places(key[alive], level, bits[alive], probes):
                at = at.astype(np.int64) + begin[alive]
                hit &= (data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
            out[alive] = level
    return out


def _merged(order: int, exact: bool, read: bool, probes: int):
    """A segment's sum over all chunks: its filter as one row (kind 0), and for each chunk the
    exact counts (kind 1) and the quantised counts read from the filter (kind 1 + order)."""
    def run(group: pa.Table) -> pa.Table:
        segment = group.column("segment")[0].as_py()
        keys, counts = group.column("keys").to_pylist(), group.column("counts").to_pylist()
        if order == 1:
            size = [len(k) // 12 for k in keys]
            high = np.concatenate([np.frombuffer(k[:8 * n], np.uint64) for k, n in zip(keys, size, strict=True)])
            low = np.concatenate([np.frombuffer(k[8 * n:], np.uint32) for k, n in zip(keys, size, strict=True)])
            by = np.lexsort((low, high))
            key, low = high[by], low[by]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1])])
            key = key[new] >> np.uint64(16)
        else:
            size = [len(k) // 6 for k in keys]
            key = np.concatenate([_unpack(k) for k in keys])
            by = np.argsort(key, kind="stable")
            key = key[by]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            key = key[new]
        inverse = np.empty(len(by), np.int64)
        inverse[by] = np.cumsum(new) - 1
        own = np.split(inverse, np.cumsum(size)[:-1])
        total = np.zeros(len(key), np.int64)
        for at, c in zip(own, counts, strict=True):  # a chunk holds a key once
            total[at] += _decoded(c, len(at))
        bits = filter_bits(key, quantised(total), probes)
        out = [(0, segment, None, int((total > 0).sum()), bits)]
        found = probe(key, 0, 8 * len(bits), np.frombuffer(bits, np.uint8), probes) if read else None
        for at, chunk in zip(own, group.column("chunk").to_pylist(), strict=True):
            if exact:
                out.append((1, segment, chunk, None, _coded(total[at])))
            if read:
                out.append((1 + order, segment, chunk, None, found[at].tobytes()))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        del by, key, new, inverse, own, total, keys, counts
        release()
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)],
                        names=["kind", "segment", "chunk", "words", "data"])
    return run


def merged_segments(chunks: DataFrame, order: int, segments: int, read: bool, probes: int = PROBES) -> DataFrame:
    rows = chunks.select("chunk", *_CHUNK).mapInArrow(tidy(_handed_out(order, segments)), "segment long, chunk long, keys binary, counts binary")
    return written(rows.groupBy("segment").applyInArrow(_merged(order, order == 1, read, probes), "kind int, segment long, chunk long, words long, data binary"),
                   f"lm-segments-{order}")


# ---- scores --------------------------------------------------------------------------

class Filters:
    """The filters of words and of pairs as they are broadcast: one after the other, and where each segment's begin."""

    def __init__(self, segments: int, parts: list[dict[int, bytes]], probes: int):
        self.segments, self.probes = segments, probes
        self.begin, self.bits = np.zeros((2, 2, segments), np.int64)
        data, at = [], 0
        for order, part in enumerate(parts):
            for s, b in sorted(part.items()):
                self.begin[order, s], self.bits[order, s] = 8 * at, 8 * len(b)
                data.append(b)
                at += len(b)
        self.data = np.frombuffer(b"".join(data), np.uint8)

    def read(self, order: int, key: np.ndarray) -> np.ndarray:
        s = segment_of(key, self.segments).astype(np.int64)
        return probe(key, self.begin[order - 1, s], self.bits[order - 1, s], self.data, self.probes)


def _scored(kind: pa.DataType, tokens: int, words: int, segments: int, sent):
    """A chunk's rows of scores, from its row and the segments' answers."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        answers: dict[int, list[tuple[int, bytes]]] = {}
        for k, s, d in zip(*[right.column(n).to_pylist() for n in ("kind", "segment", "data")], strict=True):
            answers.setdefault(k, []).append((s, d))
        answers = {k: [d for _, d in sorted(v)] for k, v in answers.items()}  # in the order of the keys
        for i in range(left.num_rows):
            c = Chunk(*[left.column(n)[i].as_py() for n in _CHUNK])
            pair, at = np.unique(c.pairs(), return_inverse=True)
            key = c.high[c.order] >> np.uint64(16)
            size = np.unique(segment_of(key, segments), return_counts=True)[1]
            exact = np.concatenate([_decoded(d, n) for d, n in zip(answers[1], size.tolist(), strict=True)])
            if sent is not None:
                word, two = sent.value.read(1, key), sent.value.read(2, pair)
            else:
                word, two = (np.frombuffer(b"".join(answers[k]), np.uint8) for k in (2, 3))
            known, count = exact[c.place][c.ids], EXPECTED[word][c.place]
            p = (count[c.ids] + 1) / (tokens + words + 1)
            before = count[c.before]
            p = (np.minimum(EXPECTED[two][at], before) + PRIOR * p) / (before + PRIOR)
            sums = [np.bincount(c.doc, weights=x, minlength=len(c.length)) for x in (known > 0, np.log10((known + 1) / (tokens + words + 1)), np.log10(p))]
            del pair, at, key, count, before
            parts.append(pa.table([
                left.column("doc_id")[i].values.cast(kind), pa.array(c.held), pa.array(c.length), pa.array(sums[0].astype(np.int64)),
                pa.array(np.full(len(c.length), tokens)), pa.array(sums[1]), pa.array(sums[2])],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        release()
        return pa.concat_tables(parts) if parts else pa.schema(list(zip(_SCORES, (kind, *_TYPES), strict=True))).empty_table()
    return run


_SCORES = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
_TYPES = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())


def language_model_scores(docs: DataFrame, modulus: int = 7, held: int = 2, probes: int = PROBES,
                          chunk: int = CHUNK, segment: int = SEGMENT, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of every
    document (doc_id, text); those whose id has a crc32 that leaves ``held`` are not learned from."""
    spark = docs.sparkSession
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    rows = docs.select("doc_id", (crc32_text(F.col("doc_id")) % modulus == held).alias("held"), F.col("text").cast("binary").alias("text"))
    chunks = written(rows.mapInArrow(tidy(_chunks(chunk)), f"doc_id array<{kind}>, held array<boolean>, length array<long>, ids binary, digests binary")
                     .withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks")
    counted = F.aggregate(F.zip_with("length", "held", lambda n, h: F.when(h, 0).otherwise(n)), F.lit(0).cast("long"), lambda a, n: a + n)
    docs_counted = F.size(F.filter("held", lambda h: ~h))
    total = chunks.select(F.aggregate("length", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"), counted.alias("counted"),
                          docs_counted.alias("docs")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "counted", "docs")]).first()
    tokens, segments = total["counted"], max(1, -(-total["n"] // segment))
    # a word or pair of count c has at most c events, so 2 N + documents events in all; each takes probes / ln 2 bits
    small = (2 * tokens + total["docs"]) * probes / np.log(2) / 8 <= sent_bytes
    one, two = (merged_segments(chunks, order, segments, read=not small, probes=probes) for order in (1, 2))
    words = (one.where("kind = 0").agg(F.sum("words")).first()[0] or 0) - (total["docs"] > 0)  # without the start mark
    sent = None
    if small:
        parts = [{r["segment"]: bytes(r["data"]) for r in t.where("kind = 0").select("segment", "data").collect()} for t in (one, two)]
        sent = spark.sparkContext.broadcast(Filters(segments, parts, probes))
    answers = one.where("kind > 0").unionByName(two.where("kind > 0")).select("chunk", "kind", "segment", "data")
    names = ", ".join(f"{n} {t}" for n, t in zip(_SCORES, (kind, "boolean", "long", "long", "long", "double", "double"), strict=True))
    of = rows.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored(of, tokens, words, segments, sent), names)
