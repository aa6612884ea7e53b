"""Cuts of the slots of a vector column, for trees on histograms.

One pass finds the distinct values of every slot, as far as there are few, and counts values by the
first 16 bits of a code that keeps their order. The wanted ranks of a slot with many values lie in
few of these brackets; further passes count these brackets alone, by 10 more bits each, until they
hold few values, which are then sorted. So quantiles are exact after three passes as a rule, and
after 7 for any data (a code has 64 bits); what travels are counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.operators.ridge import entries, handed

#: Bits of the first pass and of each further one; values that are sorted on the driver; rows handled at a time.
FIRST_BITS = 16
MORE_BITS = 10
FEW_VALUES = 500_000
CHUNK_ROWS = 200_000
_TOP = np.uint64(1 << 63)


def row_table(column: pa.Array, slots: int) -> np.ndarray:
    """Rows x slots of a column from :func:`handed`."""
    if pa.types.is_list(column.type) and not column.null_count and not column.values.null_count and len(flat := column.flatten()) == len(column) * slots:
        return flat.to_numpy().reshape(-1, slots)  # all rows are whole
    row, slot, value = entries(column)
    x = np.zeros((len(column), slots))
    x[row, slot] = value
    return x


def code(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of ``x`` (no NaN; -0 is 0)."""
    u = (x + 0.0).view(np.uint64)
    return np.where(u & _TOP, ~u, u | _TOP)


def value(c: np.ndarray) -> np.ndarray:
    return np.where(c & _TOP, c & ~_TOP, ~c).view(np.float64)


def chunks(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[np.ndarray]:
    """Rows x slots of a task's column x, many rows at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.column("x"))
        size += batch.num_rows
        if size >= CHUNK_ROWS:
            yield row_table(pa.concat_arrays(held), slots)
            held, size = [], 0
    if size:
        yield row_table(pa.concat_arrays(held), slots)


class _Counts:
    """Counts by key, of one slot."""

    def __init__(self):
        self.key, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, key: np.ndarray, n: np.ndarray | None = None) -> None:
        if n is None:
            key, n = np.unique(key, return_counts=True)
        both = np.concatenate([self.key, key])
        self.key, at = np.unique(both, return_inverse=True)
        self.n = np.bincount(at, weights=np.concatenate([self.n, n]), minlength=len(self.key)).astype(np.int64)


_COUNTS = "slot int, keys binary, counts binary"


def _summed(rows: DataFrame, run) -> dict[int, _Counts]:
    """Counts per slot over all tasks: brackets of a few slots, so they fit the driver."""
    def add(group: pa.Table) -> pa.Table:
        c = _Counts()
        for k, n in zip(group.column("keys").to_pylist(), group.column("counts").to_pylist(), strict=True):
            c.add(np.frombuffer(k, np.uint64), np.frombuffer(n, np.int64))
        return pa.table({"slot": group.column("slot").slice(0, 1), "keys": pa.array([c.key.tobytes()], pa.binary()), "counts": pa.array([c.n.tobytes()], pa.binary())})

    out = {}
    for r in rows.mapInArrow(run, _COUNTS).groupBy("slot").applyInArrow(add, _COUNTS).collect():
        out[r["slot"]] = _Counts()
        out[r["slot"]].add(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.int64))
    return out


def _batch(found: dict[int, _Counts]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([c.key.tobytes() for c in found.values()], pa.binary()),
                                       pa.array([c.n.tobytes() for c in found.values()], pa.binary())], ["slot", "keys", "counts"])


def cut_points(df: DataFrame, features: str, bins: int) -> list[np.ndarray]:
    """Ascending cuts of each slot: between all distinct values of a slot with at most ``bins`` of them, else
    exact quantiles (interpolated); 0.5 for a 0/1 slot. NaN counts as missing."""
    meta = df.schema[features].metadata.get("ml_attr", {})
    attrs = meta.get("attrs", {})
    slots = meta.get("num_attrs") or (len(df.select(vector_to_array(features).alias("a")).head(1)[0]["a"]) if df.head(1) else 0)
    binary = {a["idx"] for a in attrs.get("binary", [])}
    out = [np.array([0.5])] * slots
    numbers = [i for i in range(slots) if i not in binary]
    if not numbers:
        return out
    rows = df.where(F.col(features).isNotNull()).select(handed(features, slots).alias("x"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # slots - 1 - i: the distinct values of slot i; more than ``bins`` in one task are enough to know
        found = {i: _Counts() for i in numbers} | {-1 - i: _Counts() for i in numbers}
        for x in chunks(batches, slots):
            for i in numbers:
                c = code(x[~np.isnan(x[:, i]), i])
                found[i].add(c >> np.uint64(64 - FIRST_BITS))
                own = found[-1 - i]
                if len(own.key) <= bins:
                    own.add(c)
                    own.key, own.n = own.key[: bins + 1], own.n[: bins + 1]
        yield _batch(found)

    seen = {k: _Counts() for i in numbers for k in (i, -1 - i)} | _summed(rows, first)
    probs = np.arange(1, bins) / bins
    many = {}
    for i in numbers:
        few = value(seen[-1 - i].key[: bins + 1])
        out[i] = (few[:-1] + few[1:]) / 2
        if len(few) > bins:
            many[i] = _Wanted(seen[i], probs)
    for i, v in _found(rows, slots, many).items():
        out[i] = np.unique(v)
    return out


class _Wanted:
    """The ranks around the quantiles of one slot, and the brackets that hold them."""

    def __init__(self, counts: _Counts, probs: Sequence[float]):
        n = int(counts.n.sum())
        self.h = (n - 1) * np.asarray(probs)
        low = np.floor(self.h).astype(np.int64)
        self.ranks = np.unique(np.concatenate([low, np.minimum(low + 1, n - 1)]))
        self.low, self.high = np.searchsorted(self.ranks, low), np.searchsorted(self.ranks, np.minimum(low + 1, n - 1))
        self.into(counts, np.zeros(len(self.ranks), np.uint64), np.zeros(len(self.ranks), np.int64), 0)

    def into(self, counts: _Counts, prefix: np.ndarray, below: np.ndarray, more: int) -> None:
        """Each rank's bracket among ``counts``: those of its own last bracket (``prefix``), ``more`` bits finer."""
        run = np.cumsum(counts.n) - counts.n
        start = np.searchsorted(counts.key, prefix << np.uint64(more)) if more else np.zeros(len(prefix), np.int64)
        base = below - run[start]
        at = np.searchsorted(run, self.ranks - base, side="right") - 1
        self.bracket, self.below = counts.key[at], run[at] + base
        _, which = np.unique(at, return_index=True)
        self.held = int(counts.n[at[which]].sum())

    def values(self, got: np.ndarray) -> np.ndarray:
        """The quantiles from the values at ``ranks``."""
        a, b = got[self.low], got[self.high]
        with np.errstate(invalid="ignore"):
            return np.where(a == b, a, a + (b - a) * (self.h - self.ranks[self.low]))


def _found(rows: DataFrame, slots: int, many: dict[int, _Wanted]) -> dict[int, np.ndarray]:
    bits, out = FIRST_BITS, {}
    while many:
        last = sum(w.held for w in many.values()) <= FEW_VALUES
        more = 64 - bits if last else min(MORE_BITS, 64 - bits)
        open_ = {i: np.unique(w.bracket) for i, w in many.items()}

        def finer(batches: Iterator[pa.RecordBatch], bits=bits, more=more, open_=open_) -> Iterator[pa.RecordBatch]:
            found = {i: _Counts() for i in open_}
            for x in chunks(batches, slots):
                for i, own in open_.items():
                    c = code(x[~np.isnan(x[:, i]), i])
                    b = c >> np.uint64(64 - bits)
                    at = np.minimum(np.searchsorted(own, b), len(own) - 1)
                    found[i].add(c[own[at] == b] >> np.uint64(64 - bits - more))
            yield _batch(found)

        for i, counts in _summed(rows, finer).items():
            many[i].into(counts, many[i].bracket, many[i].below, more)
        bits += more
        if bits == 64:
            return {i: w.values(value(w.bracket)) for i, w in many.items()}
    return out
