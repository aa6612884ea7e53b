"""Segmentations: lattices and samples against enumeration, round trips, edge cases."""

from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from estima.llm import segment  # noqa: E402


@pytest.fixture(scope="module")
def vocabulary():
    return segment.Vocabulary(segment.public_model())


def every(vocabulary, text):
    """All segmentations with their log-probabilities."""
    pieces = {b.decode(): i for i, b in enumerate(vocabulary.bytes) if i > 258 and b}

    def of(word):
        if not word:
            return [((), 0.0)]
        out = []
        for n in range(1, len(word) + 1):
            if word[:n] in pieces:
                ids = (pieces[word[:n]],)
            elif n == 1:
                ids = tuple(int(vocabulary.byte_id[b]) for b in word[0].encode())
            else:
                continue
            out += [(ids + rest, sum(vocabulary.score[i] for i in ids) + p) for rest, p in of(word[n:])]
        return out

    total = of(" " + text)
    z = np.logaddexp.reduce([p for _, p in total])
    return {ids: p - z for ids, p in total}


@pytest.mark.parametrize("text", ["the no\nx", "ab  c", "é日 a"])
def test_samples_follow_the_enumeration(vocabulary, text):
    want, n = every(vocabulary, text), 6000
    lattices = segment.Lattices(vocabulary)
    first, second, weighted = Counter(), Counter(), Counter()
    by = {}
    for i, rank, ids, logp, value, inclusion in segment.sample(lattices, [text] * n, segment.mix(np.arange(n).astype(np.uint64)), 2):
        ids = tuple(ids.tolist())
        assert abs(want[ids] - logp) < 1e-6
        by.setdefault(i, []).append((ids, value))
        (first if rank == 1 else second)[ids] += 1
        weighted[ids] += np.exp(logp - inclusion)
    for got in by.values():
        assert len({x for x, _ in got}) == len(got) == min(2, len(want)) and [v for _, v in got] == sorted((v for _, v in got), reverse=True)
    p = {a: np.exp(b) for a, b in want.items()}
    for a in sorted(p, key=p.get)[-4:]:
        noise = lambda q: 5 * np.sqrt(q * (1 - q) / n) + 1e-3
        assert abs(first[a] / n - p[a]) < noise(p[a])
        q = sum(p[b] * p[a] / (1 - p[b]) for b in p if b != a)
        assert abs(second[a] / n - q) < noise(min(q, 1))
        assert abs(weighted[a] / n - p[a]) < 5 * noise(p[a])


def test_texts_come_back(spark):
    texts = ["", None, "a", "Plain words, here.\nAnd there.", "  two  spaces ", "日本語 😀 \t tab", "x" * 3000, "▁ already", "1234 5", "a\n\n\nb"]
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = segment.sampled_segmentations(rows, k=3)
    out = segment.decoded(got).collect()
    assert all(r["round_trip"] for r in out)
    for i, t in enumerate(texts):
        own = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["sample"])
        assert [r["sample"] for r in own] == list(range(1, len(own) + 1)) and len({tuple(r["ids"]) for r in own}) == len(own)
        assert len(own) == (1 if not t else 3) or len(every(segment.Vocabulary(segment.public_model()), t)) == len(own)
        assert {r["text"] for r in own} == {(t or "").replace("▁", " ")}
        assert all(r["log_inclusion"] <= 1e-9 and r["n_ids"] == len(r["ids"]) for r in own)


def test_samples_depend_on_the_key_only(spark):
    rows = spark.createDataFrame([(i, "some sampled words in a row " * 5) for i in (1, 2, 1)], "doc_id long, text string")
    a = sorted((r["doc_id"], r["sample"], r["ids_crc32"]) for r in segment.sampled_segmentations(rows.repartition(3), ids=False).collect())
    b = sorted((r["doc_id"], r["sample"], r["ids_crc32"]) for r in segment.sampled_segmentations(rows.coalesce(1), ids=False).collect())
    assert a == b and a[0] == a[1] and len({x[2] for x in a}) == 4
    assert segment.sampled_segmentations(rows.limit(0)).count() == 0


def test_decoding_and_splitting_in_bulk_equal_the_plain_way(vocabulary):
    import gc
    import re
    plain = re.compile(r" *[^\W\d_²]+| *\d| *(?:[^\w\s]|[_²]|[^\S \n])+| +|\n")
    text = " plain words, naïve Wörter ab²c x_y 12 ﬁn\n  end日本 q\u0301z"
    assert segment._FINE.findall(text) == plain.findall(text)
    lattices = segment.Lattices(vocabulary)
    words = ["a", "bc", "a", "de"]
    at = lattices.starts(words)
    assert at[0] == at[2] and len(set(at.tolist())) == 3 and (lattices.starts(["new", *words])[1:] == at).all()
    ids = list(range(300, 900))
    assert segment.decode_bytes(vocabulary, np.array(ids)) == b"".join(vocabulary.bytes[i] for i in ids)[1:]
    assert segment.decode_bytes(vocabulary, []) == b"" and gc.isenabled()


def test_the_query_returns_the_segmentations_themselves(spark, tmp_dir, vocabulary):
    import zlib

    from estima.llm.queries import op9_segmentations
    texts = {1: "Some plain words.\nAnd more", 2: "", 3: None, 4: "日本 x", 5: "a"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_dir}/documents.parquet")
    got = op9_segmentations(spark, tmp_dir).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        assert segment.decode(vocabulary, r["ids"]) == (texts[r["doc_id"]] or "") and len(r["ids"]) == r["n_ids"]
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
