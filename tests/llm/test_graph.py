"""Components against a plain union-find."""

import random

import pytest

from estima.llm.graph import components


def plain(links):
    top = {}

    def find(v):
        top.setdefault(v, v)
        while top[v] != v:
            v = top[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {v: find(v) for v in list(top)}


@pytest.mark.parametrize("small", [0, 10**9])
def test_components_equal_union_find(spark, small, monkeypatch):
    monkeypatch.setattr("estima.llm.graph.NARROW", small)
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    star = [(5000, 5001 + i) for i in range(60)] + [(5005, 6000), (6000, 4000)]
    loose = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    links = chain[::-1] + star + loose + star[:5] + [(b, a) for a, b in chain[:7]]
    got = components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()
    want = plain([(a, b) for a, b in links if a != b])
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0
