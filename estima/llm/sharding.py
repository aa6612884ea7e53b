"""Sharding: minimax contiguous partition of atomic groups (operator 6).

Documents with equal texts form one atomic group; groups are ordered by a 64-bit hash of
the text and cut into ``shards`` contiguous runs so that the largest run is as small as it
can be. The smallest feasible capacity is found by binary search; each capacity is checked
greedily (fill a shard, cut before the group that doesn't fit, go on).

The search needs the group sizes in order, but the driver never holds them all. It holds
the sizes of the bins of the hash's upper bits, at most ``BINS`` new ones a round. From
bounds on where a cut can fall for any capacity still possible it tells which bins can hold
a cut; only those are split further by the next bits (one distributed aggregate a round),
until they are single groups. All other bins stay as they are, so what the driver holds is
bounded by bins per round, whatever the rows.

Defined cases: a null text is the empty text of no bytes (size 16) and in the group of empty
texts; repeated rows are rows of their own; fewer groups than shards leave shards empty; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estima.llm.common import numbered, utf8_bytes, written

#: New bins per round on the driver (at most about twice as many).
BINS = 1 << 14
_TOP = 1 << 63


def order_key(text: Column) -> Column:
    """The group's place in the order: xxhash64 of the text (null: the empty text)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Cut positions (indices of the first unit of each further shard) when runs of at most
    ``capacity`` are filled greedily; None if more than ``shards`` are needed. ``ends`` are
    the running totals of the unit sizes."""
    cuts, at, base = [], 0, 0
    while True:
        nxt = bisect.bisect_right(ends, base + capacity, at)
        if nxt == len(ends):
            return cuts
        if nxt == at or len(cuts) + 1 == shards:
            return None
        cuts.append(nxt)
        at, base = nxt, ends[nxt - 1]


def smallest_capacity(ends: list[int], sizes: list[int], shards: int) -> int:
    """The least capacity for which :func:`greedy` needs at most ``shards`` runs."""
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _ends(sizes: list[int]) -> list[int]:
    out, total = [], 0
    for s in sizes:
        total += s
        out.append(total)
    return out


def _open_bins(bins: list[tuple[int, int, int, int, int]], shards: int) -> list[int]:
    """Indices of bins of more than one group in which a cut can fall for a capacity between
    the lower bound (no cut inside a bin is better than any cut anywhere) and the upper bound
    (cuts at bin edges only)."""
    sizes = [b[2] for b in bins]
    ends = _ends(sizes)
    upper = smallest_capacity(ends, sizes, shards)
    lower = max(-(-ends[-1] // shards), max(b[4] for b in bins))
    found: set[int] = set()
    early = late = 0
    for _ in range(shards - 1):
        # earliest cut: capacity `lower`, cut at the last edge at or before; a bin that holds
        # the limit may be cut inside, at least one of its groups short of the limit
        i = bisect.bisect_right(ends, early + lower)
        early = ends[i - 1] if i else 0
        late = min(late + upper, ends[-1])
        j = min(bisect.bisect_left(ends, late), len(bins) - 1)
        found.update(k for k in range(i, j + 1) if bins[k][3] > 1)
    return sorted(found)


def cut_keys(groups: DataFrame, shards: int, bins: int = BINS) -> tuple[list[int], int]:
    """``groups``: columns key (long) and size, one row per atomic group, read once a round.
    Returns the first key of each further shard (at most shards - 1) and the capacity."""
    # the key as an unsigned place: bin = upper bits, counted from the lowest long
    step = 64 - (bins.bit_length() - 1)

    def measured(df: DataFrame, by: Column) -> list:
        return df.groupBy(by.alias("b")).agg(
            F.sum("size").alias("s"), F.count("*").alias("n"), F.max("size").alias("m"),
            F.min("key").alias("first")).collect()

    # a bin: (lowest key in it, width in bits, size, groups, largest group)
    known = sorted((r["first"], step, r["s"], r["n"], r["m"]) for r in measured(groups, F.shiftright("key", step)))
    if not known:
        return [], 0
    while True:
        at = _open_bins(known, shards)
        if not at:
            break
        spread = max(1, (bins // len(at)).bit_length() - 1)
        parts: dict[int, int] = {}  # a bin's number at its own width
        for i in at:
            parts.setdefault(known[i][1], 0)
        fresh: list[tuple[int, int, int, int, int]] = []
        for width in parts:
            own = [known[i][0] >> width for i in at if known[i][1] == width]
            finer = max(0, width - spread)
            rows = measured(groups.where(F.shiftright("key", width).isin(own)), F.shiftright("key", finer))
            fresh += [(r["first"], finer, r["s"], r["n"], r["m"]) for r in rows]
        dropped = set(at)
        known = sorted([b for i, b in enumerate(known) if i not in dropped] + fresh)
    sizes = [b[2] for b in known]
    ends = _ends(sizes)
    capacity = smallest_capacity(ends, sizes, shards)
    return [known[i][0] for i in greedy(ends, capacity, shards)], capacity


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                    per_row: int = 16) -> DataFrame:
    """Per row: id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null), group_key.

    Each row's size is its UTF-8 bytes plus ``per_row``. The narrow row table is written once
    to the shared checkpoint folder; the cuts come from it and it is numbered per shard.
    """
    text = F.col(text_col)
    rows = written(docs.select(
        F.col(id_col).alias("doc_id"), (utf8_bytes(text) + per_row).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        order_key(text).alias("key"), F.monotonically_increasing_id().alias("__row")), "shard-rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    cuts, _ = cut_keys(groups, shards)
    # how many cuts lie at or before the key; at most shards - 1 comparisons, as one expression
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("key") >= F.lit(c).cast("long")).cast("int")
    out = numbered(rows.withColumn("shard", shard.cast("int")), ["shard"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), F.col("key").alias("group_key"))
