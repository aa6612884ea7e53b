"""Sharding: smallest capacity against brute force, whole groups, gapless slots, edge cases."""

import random
import zlib
from itertools import combinations

import pytest

from estima.llm.sharding import cut_keys, greedy, shard_documents, smallest_capacity


def ends_of(sizes):
    return [sum(sizes[: i + 1]) for i in range(len(sizes))]


def test_smallest_capacity_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([1, 2, 5, 9, 40]) for _ in range(rng.randint(1, 8))]
        shards = rng.randint(1, 4)
        best = min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes)), strict=True))
                   for n in range(min(shards, len(sizes))) for c in combinations(range(1, len(sizes)), n))
        ends = ends_of(sizes)
        assert smallest_capacity(ends, sizes, shards) == best
        assert len(greedy(ends, best, shards)) < shards


@pytest.mark.parametrize("hot", [0, 4000])
def test_refined_bins_equal_the_search_over_all_groups(spark, hot):
    rng = random.Random(2)
    rows = sorted((rng.randrange(-(1 << 63), 1 << 63), rng.randint(1, 400)) for _ in range(3000))
    if hot:
        rows[1234] = (rows[1234][0], hot * 50)
    groups = spark.createDataFrame(rows, "key long, size long")
    sizes = [s for _, s in rows]
    best = smallest_capacity(ends_of(sizes), sizes, 7)
    cuts, capacity = cut_keys(groups, 7, bins=64)
    assert capacity == best
    assert cuts == [rows[i][0] for i in greedy(ends_of(sizes), best, 7)]


def test_documents(spark):
    texts = [None, "", "", "é" * 5, *(f"text {i % 40} " * (1 + i % 9) for i in range(300)), "x" * 50_000]
    rows = [(i, t, "extra", 5) for i, t in enumerate(texts)] + [(None, "no id", "extra", 5), (7, texts[7], "extra", 5)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard string, size int"), shards=5).collect()
    assert len(got) == len(rows)
    by_crc = {}
    for r in got:
        by_crc.setdefault(r["text_crc32"], set()).add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 5
    assert all(len(s) == 1 for s in by_crc.values())
    for s in range(5):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}
    assert sizes[0] == (16, 0) and sizes[3] == (26, zlib.crc32("ééééé".encode()))


def test_empty(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
