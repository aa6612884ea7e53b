"""Merkle manifest against a plain recomputation, and what tampering shows."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import Row

from estima.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(digests):
    """All levels from the leaves to one node."""
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def walk(levels, at, fold):
    proof = ""
    for level in levels[:-1]:
        run = level[at // 16 * 16:at // 16 * 16 + 16]
        left, right = "".join(run[:at % 16]), "".join(run[at % 16 + 1:])
        proof, fold, at = proof + left + right, h(left + fold + right), at // 16
    return proof, fold


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r, leaf_of(r, r["text"])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
    trees = {s: climb([x[1] for x in groups[s]]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (r, leaf) in enumerate(groups[s]):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            proof, fold = walk(trees[s], i, leaf_of(r, text))
            more, fold = walk(top, k, fold)
            out.append((r["doc_id"], leaf, trees[s][-1][0], top[-1][0], h(proof + more), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def rows_of(n):
    odd = ["Größe ÄB", "", None, "ABC " * 4000, "plain lower", "Tab\tNEW\nline"]
    sources = [None, "", "s", "é", "Z", "a"] + [f"x{i}" for i in range(30)]
    out = [Row(doc_id=i, text=odd[i % 6] if i % 7 else f"Text {i}", lang=None if i % 5 == 0 else "en", source=sources[0 if i % 3 == 0 else i % len(sources)],
               n_chars=None if i % 11 == 0 else i, leaf="clash", tree=1) for i in range(n)]
    if n > 50:
        out += [out[40]] * 20 + [out[40].asDict() | {"doc_id": None}] * 18 + [out[40].asDict() | {"text": "other"}]
    return [Row(**x) if isinstance(x, dict) else x for x in out]


@pytest.mark.parametrize("n", [1, 2, 17, 700])
def test_proofs_equal_recomputation(spark, n):
    rows = rows_of(n)
    got = merkle.merkle_proofs(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_hot_digests_take_the_other_join(spark, monkeypatch):
    rows = rows_of(700) + rows_of(60)[40:41] * 600
    expected = brute(rows)
    monkeypatch.setattr(merkle, "NARROW", 0)
    got = merkle.merkle_proofs(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected


def test_store_is_addressed_by_content(spark):
    rows = spark.range(64).selectExpr("cast(null as string) as g", "id", "cast(id % 16 as string) as d")
    m = merkle.manifest(rows, "g", "id", "d", [])
    [record] = m.store[1].collect()
    assert record["uses"] == 4 and record["children"] == [str(i) for i in range(16)]
    assert record["digest"] == h("".join(record["children"]))


def test_empty_table(spark):
    assert merkle.merkle_proofs(spark.createDataFrame([], SCHEMA)).collect() == []
