"""Packing token sequences by non-negative least squares (operator 8).

Every document's ids, with an end id, are cut into full windows and a tail shorter than a
window. How the tails share windows is found on their length histogram alone:

1. All combinations of two or three lengths that fill a window exactly are enumerated
   (a bounded list: about window^2 / 12).
2. Their repeat counts are the non-negative least-squares solution against the histogram,
   by greedy coordinate descent: in each step the combination that lowers the squared error
   most moves to its best count.
3. The counts are rounded down to what the histogram still holds, largest first, then raised
   greedily.
4. The residual tails are packed greedily in order of length, one after the other, and cut at
   the window's end, so that only the very last sequence has padding.

Tails of one length are interchangeable: each gets its ordinal among them (numbered without
a window over a whole length), and intervals of ordinals map to a combination, a repeat and
an offset. The driver sees the histogram and the combinations, never a document.

Defined cases: a null or empty text is the end id alone; repeated rows and repeated ids are
packed as rows of their own; an empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.llm.common import numbered, tidy, written

WINDOW = 1024
END_ID = 0
#: Steps of the coordinate descent at most; what it leaves goes to the greedy stages.
STEPS = 20_000


# ---- tokens --------------------------------------------------------------------------

class Encoder:
    """Ids of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    The byte-level vocabulary is read as ranks by the faster of the two libraries, which gives
    the same ids. Texts that hold the name of a special token, or that it can't take, go to
    ``tokenizers`` itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            try:
                return np.asarray(self.fast.encode_ordinary(text), dtype=np.uint32)
            except (ValueError, OverflowError, RuntimeError, UnicodeError):
                pass
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def public_encoder(json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken") -> Encoder:
    import public_tokenizers
    return Encoder(public_tokenizers.path(json_name), public_tokenizers.path(ranks_name), public_tokenizers.PATTERN)


def ids_crc32(ids: np.ndarray) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def tokenised(docs: DataFrame, id_col: str, text_col: str, window: int, end_id: int, encoder=public_encoder) -> DataFrame:
    """Per row: __row, doc_id, tokens, full (crc32 of each full window), tail_len, tail_crc, tail (ids)."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            tokens, full, tail_len, tail_crc, tail = [], [], [], [], []
            for text in batch.column("text"):
                ids = np.append(encode(text.as_py()), np.uint32(end_id))
                whole = len(ids) // window * window
                tokens.append(len(ids))
                full.append([ids_crc32(ids[i:i + window]) for i in range(0, whole, window)])
                tail_len.append(len(ids) - whole)
                tail_crc.append(ids_crc32(ids[whole:]))
                tail.append(ids[whole:].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column("__row"), batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(full, pa.list_(pa.int64())),
                pa.array(tail_len, pa.int32()), pa.array(tail_crc, pa.int64()), pa.array(tail, pa.binary())],
                ["__row", "doc_id", "tokens", "full", "tail_len", "tail_crc", "tail"])

    schema = f"__row long, doc_id {kind}, tokens long, full array<long>, tail_len int, tail_crc long, tail binary"
    return written(rows.mapInArrow(tidy(run), schema), "pack-tokens")


# ---- combinations and their counts ---------------------------------------------------

def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c), a <= b <= c, of lengths that add up to ``window``; a is 0 for pairs."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    out = []
    for a in [0, *lengths[lengths <= window // 3].tolist()]:
        b = np.arange(max(a, 1), (window - a) // 2 + 1)
        c = window - a - b
        ok = there[b] & there[c]
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def least_squares(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS, tolerance: float = 0.5) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared error of what the combinations hold
    against ``histogram`` (index: length; entry 0 is 0)."""
    x = np.zeros(len(combos))
    if not len(combos):
        return x
    a, b, c = combos.T
    use = np.ones((len(combos), 3))
    use[a == 0, 0] = 0
    norm = np.zeros(len(combos))  # squared column norm: equal lengths add up first
    norm += np.where(a == b, 4, use[:, 0] + 1) + 1
    norm = np.where((a == b) & (b == c), 9, np.where(b == c, use[:, 0] + 4, norm))
    rest = histogram.astype(float).copy()
    rest[0] = 0
    for _ in range(steps):
        g = (use[:, 0] * rest[a] + rest[b] + rest[c]) / norm
        move = np.maximum(g, -x)
        gain = np.abs(move) * np.sqrt(norm)
        j = int(np.argmax(gain))
        if abs(move[j]) < tolerance:
            break
        x[j] += move[j]
        for n in combos[j]:
            if n:
                rest[n] -= move[j]
    return x


def rounded(combos: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeat counts that the histogram can serve, and what is left of the histogram."""
    left = histogram.astype(np.int64).copy()
    counts = np.zeros(len(combos), np.int64)
    for most in (np.floor(x + 1e-9), None):  # the rounded solution, then as many more as fit
        order = np.argsort(-x, kind="stable")
        for j in order if most is None else order[: int((x >= 1).sum())]:
            need: dict[int, int] = {}
            for n in combos[j].tolist():
                if n:
                    need[n] = need.get(n, 0) + 1
            k = min(int(left[n]) // m for n, m in need.items())
            if most is not None:
                k = min(k, int(most[j]))
            if k > 0:
                counts[j] += k
                for n, m in need.items():
                    left[n] -= k * m
    return counts, left


class Plan:
    """Where the i-th tail of each length goes. ``place(length, ordinal)`` is vectorised."""

    def __init__(self, histogram: np.ndarray, window: int, first_sequence: int):
        self.window = window
        combos = combinations(np.flatnonzero(histogram[:window]), window)
        counts, left = rounded(combos, least_squares(combos, histogram), histogram)
        low: dict[int, list[int]] = {}
        into: dict[int, list[tuple[int, int]]] = {}
        taken = np.zeros(window + 1, np.int64)
        sequence = first_sequence
        for j in np.flatnonzero(counts).tolist():
            k, offset = int(counts[j]), 0
            for n in combos[j].tolist():
                if n:
                    low.setdefault(n, []).append(int(taken[n]))
                    into.setdefault(n, []).append((sequence, offset))
                    taken[n] += k
                    offset += n
            sequence += k
        self.low = {n: np.array(v) for n, v in low.items()}
        self.into = {n: np.array(v) for n, v in into.items()}
        self.taken = taken
        self.residual_sequence = sequence
        # residual tails: longest first, one after the other
        amount = left * np.arange(window + 1)
        self.start = amount.sum() - np.cumsum(amount)
        self.residual_ids = int(amount.sum())

    def place(self, length: int, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the tails; a residual tail may reach past the window's end."""
        sequence, offset = np.empty(len(ordinal), np.int64), np.empty(len(ordinal), np.int64)
        packed = ordinal < self.taken[length]
        if packed.any():
            i = np.searchsorted(self.low[length], ordinal[packed], side="right") - 1
            sequence[packed] = self.into[length][i, 0] + ordinal[packed] - self.low[length][i]
            offset[packed] = self.into[length][i, 1]
        at = self.start[length] + (ordinal[~packed] - self.taken[length]) * length
        sequence[~packed] = self.residual_sequence + at // self.window
        offset[~packed] = at % self.window
        return sequence, offset


# ---- the operator --------------------------------------------------------------------

def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   end_id: int = END_ID, encoder=public_encoder) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = tokenised(docs, id_col, text_col, window, end_id, encoder)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    narrow = tokens.select("__row", "doc_id", "tokens", "full", "tail_len", "tail_crc")
    full = numbered(narrow.where(F.size("full") > 0).withColumn("n_full", F.size("full")), [], "first", "n_full")
    full = full.select("doc_id", "tokens", "first", F.posexplode("full").alias("k", "crc")).select(
        "doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
        (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # at most window - 1 rows reach the driver
    seen = tokens.groupBy("tail_len").agg(F.count("*").alias("n"), F.sum(F.size("full")).alias("full")).collect()
    histogram = np.zeros(window + 1, np.int64)
    for r in seen:
        histogram[r["tail_len"]] = r["n"] if r["tail_len"] else 0
    plan = Plan(histogram, window, sum(r["full"] for r in seen))

    tails = numbered(narrow.where("tail_len > 0").drop("full"), ["tail_len"], "ordinal")
    kind = dict(docs.dtypes)[id_col]
    schema = (f"__row long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ordinal = (batch.column(c).to_numpy() for c in ("tail_len", "ordinal"))
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for length in np.unique(n):
                at = np.flatnonzero(n == length)
                sequence[at], offset[at] = plan.place(int(length), ordinal[at])
            start = batch.column("tokens").to_numpy() - n
            yield pa.RecordBatch.from_arrays([
                batch.column("__row"), batch.column("doc_id"), pa.array(start, pa.int64()), pa.array(n.astype(np.int64)),
                batch.column("tail_crc"), batch.column("tokens"), pa.array(sequence), pa.array(offset)], ["__row", *names])

    placed = written(tails.mapInArrow(place, schema), "pack-tails")
    fits = placed.where(F.col("offset") + F.col("length") <= window).select(*names)
    # a residual tail that crosses the end of its window is cut there; only these need their ids
    crossing = placed.where(F.col("offset") + F.col("length") > window).join(tokens.select("__row", "tail"), "__row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, length, sequence, offset = (batch.column(c).to_numpy() for c in ("start", "length", "sequence_id", "offset"))
            first = window - offset
            crc = []
            for raw, k in zip(batch.column("tail"), first.tolist(), strict=True):
                ids = np.frombuffer(raw.as_py(), dtype="<u4")
                crc += [ids_crc32(ids[:k]), ids_crc32(ids[k:])]
            both = lambda x, y: pa.array(np.stack([x, y], axis=1).ravel())
            twice = pa.array(np.repeat(np.arange(len(start)), 2))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(twice), both(start, start + first), both(first, length - first),
                pa.array(crc, pa.int64()), batch.column("doc_tokens").take(twice), both(sequence, sequence + 1),
                both(offset, offset * 0)], names)

    return full.unionByName(fits).unionByName(crossing.mapInArrow(cut, schema.split(", ", 1)[1]))
