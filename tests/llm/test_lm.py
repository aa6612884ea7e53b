"""Language model: exact base scores, the filter's reads, and scores against exact quantised counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from estima.llm import lm

SCHEMA = "doc_id long, score string, held int, text string"


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def mean_of_class(count):
    if not count:
        return 0.0
    q = count.bit_length()
    return (2 ** (q - 1) + 2**q - 1) / 2


def brute(rows):
    words, pairs = Counter(), Counter()
    for r in rows:
        if not held(r["doc_id"]):
            t = tokens(r["text"])
            words.update(t), pairs.update(zip([b"\r", *t[:-1]], t, strict=True))
            words[b"\r"] += 1
    total, kinds = sum(n for w, n in words.items() if w != b"\r"), len(set(words) - {b"\r"})
    out = []
    for r in rows:
        t, base, score = tokens(r["text"]), 0.0, 0.0
        for v, w in zip([b"\r", *t[:-1]], t, strict=True):
            base += math.log10((words[w] + 1) / (total + kinds + 1))
            before = mean_of_class(words[v])
            p = (mean_of_class(words[w]) + 1) / (total + kinds + 1)
            score += math.log10((min(mean_of_class(pairs[v, w]), before) + lm.PRIOR * p) / (before + lm.PRIOR))
        out.append((r["doc_id"], held(r["doc_id"]), len(t), sum(words[w] > 0 for w in t), total, base, score))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Über", "ÜBER", "über", "a b", "the", "THE"]
    odd = ["", None, " \t\n", "x" * 9000, "one", "w1 " * 3000]
    out = [Row(doc_id=None if i % 83 == 0 else i // 2 if i % 29 == 0 else i, score="clash", held=9,
               text=odd[i % 50] if i % 50 < len(odd) else " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(1, 80))))
           for i in range(500)]
    return out + out[60:61] * 40


def same(got, expected):
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 6))
    got, expected = sorted(got, key=key), sorted(expected, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in expected], rtol=1e-9)


@pytest.mark.parametrize("sent", [lm.SENT_BYTES, 0])
def test_both_ways_equal_exact_counts(spark, rows, sent):
    """With a filter that hardly ever errs, the scores are those of the exact quantised counts."""
    got = lm.language_model_scores(spark.createDataFrame(rows, SCHEMA).repartition(3), probes=30, chunk=700, segment=4000, sent_bytes=sent)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same([tuple(r) for r in got.collect()], brute(rows))


def test_filter_errs_to_one_side_and_rarely():
    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 1 << 48, 40_000, dtype=np.uint64))
    seen, unseen = key[::2], key[1::2]
    level = lm.quantised(rng.geometric(0.3, len(seen)))
    bits = lm.filter_bits(seen, level)
    data = np.frombuffer(bits, np.uint8)
    read = lm.probe(seen, 0, 8 * len(bits), data)
    assert (read >= level).all() and (read > level).mean() < 2.5 * 2**-lm.PROBES
    assert (lm.probe(unseen, 0, 8 * len(bits), data) > 0).mean() < 2.5 * 2**-lm.PROBES
    assert lm.quantised(np.array([0, 1, 2, 3, 4, 2**40])).tolist() == [0, 1, 2, 2, 3, 41]


def test_counts_are_coded_whole():
    n = np.array([0, 1, 254, 255, 256, 10**12])
    assert lm._decoded(lm._coded(n), len(n)).tolist() == n.tolist()
    key = np.array([0, 1, 2**48 - 1], np.uint64)
    assert lm._unpack(lm._pack(key)).tolist() == key.tolist()
    ids = np.array([0, 1, 255, 256, 70_000, 2**31 - 1], np.int32)
    assert lm._unpacked(lm._packed(ids), len(ids)).tolist() == ids.tolist()


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(60) if held(i)]
    got = lm.language_model_scores(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).collect()
    assert [tuple(r)[1:] for r in got] == [(True, 3, 0, 0, 0.0, 0.0)] * len(ids)
    assert lm.language_model_scores(spark.createDataFrame([], SCHEMA)).collect() == []


def test_known_text_scores_above_its_base(spark, rows):
    got = lm.language_model_scores(spark.createDataFrame(rows, SCHEMA)).where("not held_out and n_tokens > 20").collect()
    assert np.mean([r["score"] > r["base_score"] for r in got]) > 0.95
