"""BagMinHash: unbiased signatures, classes against brute force, edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from estima.llm import minhash


def plain_sets(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    n = min(5, len(words))
    return Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def alike(a, b):
    common = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 0.0


@pytest.mark.parametrize("weights", [([1, 1, 1, 1], [1, 1, 1, 0]), ([3, 1, 7, 0], [1, 1, 9, 2]), ([20, 1, 1, 5], [16, 0, 1, 5])])
def test_signatures_are_unbiased(weights):
    a, b = weights
    want = sum(map(min, a, b)) / sum(map(max, a, b))
    runs, registers = 150, 64
    owner, shingle, weight = [], [], []
    for r in range(runs):
        for side, w in enumerate((a, b)):
            for j, x in enumerate(w):
                if x:
                    owner.append(2 * r + side), shingle.append(r * 100 + j), weight.append(float(x))
    s = minhash.bagminhash(np.array(owner), minhash.mix(np.array(shingle, np.uint64)), np.array(weight), 2 * runs, registers)
    got = (s[0::2] == s[1::2]).mean()
    assert abs(got - want) < 4 * np.sqrt(want * (1 - want) / (runs * registers)) + 0.01


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(6, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    base = [word() for _ in range(24)]  # one group of near copies, each with one word changed
    for i in range(70):
        copy = list(base)
        copy[i % 24] = word()
        texts.append(" ".join(copy))
    hot = " ".join(word() for _ in range(40))
    texts += [hot] * 40 + [hot + " end"] + ["a b", "a b", "A, b!", "c", "", "", None, None, "!!!", "...", "x y z w v " * 3000]
    rng.shuffle(texts)
    return texts


def brute(texts):
    top = list(range(len(texts)))

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    sets = [plain_sets(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] is not None and texts[i] == texts[j]
            if same or (sets[i] and sets[j] and alike(sets[i], sets[j]) >= 0.8):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_classes_equal_brute_force(spark, monkeypatch):
    texts = corpus()
    want = brute(texts)
    rows = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, k int, class_id string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.duplicate_classes(rows).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = minhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_blocks_of_big_buckets_lose_no_link(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(24)]
    sets = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(24)] = f"v{rng.randrange(50)}"
        sets.append(minhash.Shingler().elements(" ".join(copy)))
    keys = [i.to_bytes(2, "big") for i in range(len(sets))]
    members = spark.createDataFrame([(1, k, keys[i % 7] if i < 40 else k) for i, k in enumerate(keys)], "bucket long, k binary, component binary")
    elements = spark.createDataFrame([(k, s.tobytes()) for k, s in zip(keys, sets, strict=True)], "k binary, elements binary")

    def joined(links):
        top = {k: k for k in keys}

        def find(v):
            while top[v] != v:
                v = top[v]
            return v

        for a, b in [(keys[i], keys[i % 7]) for i in range(40)] + links:
            a, b = find(bytes(a)), find(bytes(b))
            top[max(a, b)] = min(a, b)
        return [find(k) for k in keys]

    want = joined([(keys[i], keys[j]) for i in range(60) for j in range(i) if minhash.overlap(sets[i], sets[j]) >= 0.8])
    for block in (1000, 9):
        links = minhash._within_buckets(members, elements, 0.8, block).collect()
        assert joined([(r["a"], r["b"]) for r in links]) == want


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, "same words here to be found"), (1, "same words here to be found"), (None, "same words here to be found"), (2, None)],
                                 "doc_id long, text string")
    got = [(r["doc_id"], r["class_id"]) for r in minhash.duplicate_classes(rows).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 1), (None, 1), (2, 2)], key=str)
    assert minhash.keep_one(rows).count() == 2
    assert minhash.duplicate_classes(rows.limit(0)).count() == 0 and minhash.keep_one(rows.limit(0)).count() == 0


def test_classes_of_one_id_and_without_ids_are_kept_apart(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1]), (3, texts[1] + " more"), (None, texts[2]), (None, texts[3]), (None, texts[3]), (None, "no"), (None, None)]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, "no"), (None, None)]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_rows_without_a_match_make_no_rows_of_a_join(spark):
    from pyspark.sql import functions as F

    from estima.llm.common import join_matched, join_unique
    left = spark.createDataFrame([(1 if i < 50 else i, i) for i in range(200)] + [(None, 7)], "bucket long, k long")
    right = left.groupBy("bucket").agg(F.count("*").alias("n"), F.min("k").alias("hub")).where("n > 1 or bucket = 60")
    got = join_matched(left, right, "bucket", 201, "n")
    assert "Left" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = join_unique(left, right, "bucket", 201, "n").where("hub is not null")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 51
