"""Dual-tree search against plain scoring of every pair."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from estima.llm import ranking

DOCS = "doc_id long, text string, n long, row string"
ITEMS = "item_id long, text string, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    found = [(r["doc_id"], Counter(terms(r["text"]))) for r in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    count, length = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item in items:
        scores = []
        for i, c, n in found:
            m = 75 + 25 * n * count // length
            s = sum(r * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, r in Counter(terms(item["text"])).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item["item_id"], n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def texts(rng, n, words):
    odd = ["", None, "...", "Größe-ÄB größe\tÄb", "x" * 5000, "日本 語 x1_y2", " ".join(words * 30)]
    out = [odd[i % 40] if i % 40 < len(odd) else " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(1, 60)))
           for i in range(n)]
    return [out[i // 2] if i % 10 == 0 else t for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Größe", "ÄB", "日本", "X1", "The"]
    docs = [Row(doc_id=None if i % 97 == 0 else i // 2 if i % 31 == 0 else i, text=t, n=i, row="clash") for i, t in enumerate(texts(rng, 900, words))]
    items = [Row(item_id=None if i == 3 else i % 50, text=t, rank=1) for i, t in enumerate(texts(rng, 60, words))]
    return docs, items


def test_equals_scoring_every_pair(spark, tables):
    docs, items = tables
    got = ranking.ranked_documents(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(items, ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_blocks_of_items_give_the_same(spark, tables):
    docs, items = tables
    got = ranking.ranked_documents(spark.createDataFrame(docs[:300], DOCS), spark.createDataFrame(items[:12], ITEMS), k=3, most=5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs[:300], items[:12], k=3)


def test_empty_tables(spark, tables):
    docs, items = (spark.createDataFrame(rows, kind) for rows, kind in zip(tables, (DOCS, ITEMS), strict=True))
    assert ranking.ranked_documents(docs.limit(0), items).collect() == []
    assert ranking.ranked_documents(docs, items.limit(0)).collect() == []


def test_bounds_hold_and_prune():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    data = [" ".join(words[(i // 20) * 8 % 380:][:20]) + " " + rng.choice(words) for i in range(800)]
    items = ranking.Items(list(range(40)), [t.encode() for t in data[::20]])
    vocabulary = items.vocabulary
    counts = [Counter(ranking.terms(t.encode())) for t in data]
    items.weigh(len(data), np.array([sum(t in c for c in counts) for t in vocabulary]))
    rows = [sorted((vocabulary[t], 1000 + n) for t, n in c.items() if t in vocabulary) for c in counts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    impacts = ranking.Rows(starts, np.array([p for r in rows for p, _ in r]), np.array([v for r in rows for _, v in r]))
    scored = 0

    class Counted(ranking.Search):
        def score(self, docs, first, at, names):
            nonlocal scored
            scored += len(at) * ranking.FAN
            super().score(docs, first, at, names)

    search = Counted(items, np.zeros(40, np.int64), 5)
    search.documents(impacts, [(True, -i, -i) for i in range(800)])
    dense = np.zeros((800, len(vocabulary)), np.int64)
    for d, r in enumerate(rows):
        for p, v in r:
            dense[d, p] = v
    leaf = items.levels[0]
    for n in range(40):
        a, b = leaf.starts[n], leaf.starts[n + 1]
        scores = dense[:, leaf.places[a:b]] @ leaf.values[a:b]
        best = sorted(((int(s), True, -i, -i) for i, s in enumerate(scores)), reverse=True)[:5]
        assert sorted(search.best[n], reverse=True) == best
    assert scored < 0.5 * 800 * 40
