"""Quality and toxicity: held-out accuracy on planted documents, kernels, edge cases."""

import random
import zlib

import numpy as np
import pytest

from estima.llm import quality, toxicity

SYLLABLES = ["an", "er", "in", "th", "on", "re", "at", "ou", "st", "nd", "ly", "ed"]


def prose(rng, n):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def documents(n=400):
    rng = random.Random(11)
    out = []
    for i in range(n):
        text, good, toxic = prose(rng, rng.randint(8, 60)), 1, 0
        kind = rng.random()
        if kind < 0.15:
            text, good = " ".join(w for x in text.split() for w in [x] * 5), 0
        elif kind < 0.3:
            text, good = "!! ".join(text.upper().split()), 0
        if rng.random() < 0.3:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["idiot", "scumbag", "zzmoron" + rng.choice(SYLLABLES)]))
            text, toxic = " ".join(words), 1
        out.append((i, text, good, toxic))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = documents()
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(None, 0, 1), (3, None, None), (99_999, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    return rows, docs, labels


def odd(spark):
    return spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "word " * 40_000, 5), (4, "x" * 100_000, 5), (4, "x" * 100_000, 5), (None, "some text", 5)],
                                 "doc_id long, text string, score int")


def held(i, modulus, rest):
    return zlib.crc32(str(i).encode()) % modulus == rest


def test_quality_held_out(spark, tables):
    rows, docs, labels = tables
    vectors, net = quality.train(docs, labels)
    got = {r["doc_id"]: r["p"] for r in quality.score_documents(docs, vectors, net, "p").collect()}
    own = [(got[i] >= 0.5) == bool(q) for i, _, q, _ in rows if held(i, 3, 1)]
    assert np.mean(own) > 0.95
    scored = quality.score_documents(odd(spark), vectors, net, "p").collect()
    assert len(scored) == 6 and all(0 <= r["p"] <= 1 for r in scored) and scored[0]["p"] == scored[1]["p"]
    kept = quality.reject_poor(odd(spark), vectors, net, threshold=0.0)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 6


def test_word_vectors_do_not_depend_on_partitions(spark, tables):
    _, docs, _ = tables
    a, b = quality.word_vectors(docs.repartition(1)), quality.word_vectors(docs.repartition(7))
    assert np.array_equal(a, b) and a.shape == (quality.BUCKETS, quality.DIMENSIONS)


def test_quality_without_labels_or_rows(spark, tables):
    _, docs, labels = tables
    vectors, net = quality.train(docs.limit(0), labels)
    assert quality.score_documents(docs.limit(0), vectors, net).count() == 0
    vectors, net = quality.train(docs, labels.where("quality = 1"))
    assert {r["score"] for r in quality.score_documents(docs, vectors, net).collect()} == {1.0}


def test_toxicity_held_out(spark, tables):
    rows, docs, labels = tables
    machine = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["p"] for r in toxicity.score_documents(docs, machine, "p").collect()}
    own = [(got[i] >= 0.5) == bool(x) for i, _, _, x in rows if held(i, 5, 0)]
    assert np.mean(own) > 0.9
    clean = "An there is nothing bad in this text at all."
    new = spark.createDataFrame([(1, clean + " You idi*ot."), (2, clean + " i d i o t you"), (3, clean), (4, clean + " zzmoronqq and zzmoronix")],
                                "doc_id long, text string")
    p = {r["doc_id"]: r["score"] for r in toxicity.score_documents(new, machine).collect()}
    assert p[3] < 0.5 and min(p[1], p[2], p[4]) > p[3] + 0.2
    scored = toxicity.score_documents(odd(spark), machine, "p").collect()
    assert len(scored) == 6 and all(0 <= r["p"] <= 1 for r in scored) and scored[0]["p"] == scored[1]["p"]
    kept = toxicity.reject_toxic(odd(spark), machine, threshold=1.1)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 6


def test_toxicity_without_labels_or_rows(spark, tables):
    _, docs, labels = tables
    machine = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_documents(docs, machine).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), machine).count() == 0


def test_kernel_equals_plain_subsequence_counts():
    from itertools import combinations

    def plain(a, b):
        def features(word):
            marked, out = "\x02" + word + "\x03", {}
            for n in toxicity.ORDERS:
                for at in combinations(range(len(marked)), n):
                    span = at[-1] - at[0] + 1
                    if span <= toxicity.SPAN:
                        key = "".join(marked[i] for i in at)
                        out[key] = out.get(key, 0) + toxicity.DECAY**span
            return out
        x, y = features(a), features(b)
        return sum(v * y.get(k, 0) for k, v in x.items())

    words, marks = ["idiot", "idxiot", "a", "banana", "été"], ["idiot", "moron", "anan"]
    got = toxicity.kernel(words, marks) * toxicity._norms(words)[:, None] * toxicity._norms(marks)[None, :]
    want = np.array([[plain(a, b) for b in marks] for a in words])
    assert np.allclose(got, want, rtol=1e-4, atol=1e-5)


def test_the_folded_table_equals_the_kernel_machine():
    marks = ["idiot", "moron", "clown", "flower"]
    alpha = np.array([1.0, 0.5, 0.7, -0.6])
    machine = toxicity.Machine(toxicity._table(marks, alpha), 0.1)
    words = ["idiots", "flowers", "clowns", "tree"]
    assert np.allclose(machine.margins(words), toxicity.kernel(words, marks) @ alpha + 0.1, atol=2e-2)
