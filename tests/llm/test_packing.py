"""Packing: ids equal the tokenizer's, each id in one piece, little padding, edge cases."""

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from estima.llm import packing  # noqa: E402


def reference_ids(text):
    from tokenizers import Tokenizer
    reference_ids.t = getattr(reference_ids, "t", None) or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return reference_ids.t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    encode = packing.public_encoder()
    texts = ["", " ", "Hello  world\n\n it's 12345", "é日本😀‍", "<|endoftext|> here", "a" * 5000, " " * 3000 + "x", "\x00\x01", "don't 'LL"]
    rng = random.Random(4)
    texts += ["".join(rng.choice("ab c'd\n1é<|>.") for _ in range(rng.randint(1, 80))) for _ in range(100)]
    for t in texts:
        assert encode(t).tolist() == reference_ids(t)


def check(docs, pieces, window):
    ids = {i: np.array(reference_ids(t) + [0], "<u4") for i, t in docs}
    held = {}
    for p in pieces:
        held.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        assert zlib.crc32(ids[p["doc_id"]][p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
    for i, want in ids.items():
        at = 0
        for start, length in sorted(held[i]):
            assert start == at and length > 0
            at += length
        assert at == len(want)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    total = sum(map(len, ids.values()))
    assert len(sequences) == -(-total // window) and sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("window", [16, 64])
def test_pieces(spark, window):
    rng = random.Random(window)
    docs = [(i, " ".join(rng.choice(["the", "quick", "é", "xylophone"]) for _ in range(rng.randint(0, 70)))) for i in range(150)]
    docs += [(200 + i, "same text") for i in range(60)] + [(300, None), (301, ""), (302, "long " * 3000)]
    rows = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, start int, length string")
    check(docs, packing.pack_documents(rows, window=window).collect(), window)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d")], "doc_id long, text string")
    got = packing.pack_documents(rows, window=16).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 2), (1, 4), (1, 4)]
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_least_squares_counts():
    histogram = np.zeros(17, np.int64)
    histogram[[4, 6, 10, 12, 5]] = [30, 20, 20, 10, 7]
    combos = packing.combinations(np.flatnonzero(histogram[:16]), 16)
    assert (combos.sum(axis=1) == 16).all()
    counts, left = packing.rounded(combos, packing.least_squares(combos, histogram), histogram)
    used = np.zeros(17, np.int64)
    for c, n in zip(combos, counts, strict=True):
        for x in c[c > 0]:
            used[x] += n
    assert (used + left == histogram).all() and (left >= 0).all()
    assert left.sum() <= 35  # the best is 27: 10 times 4 + 12 and 20 times 6 + 10
