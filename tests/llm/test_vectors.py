"""Neighbours and near-duplicate vectors against brute force, edge cases."""

import tracemalloc

import numpy as np
import pytest

from estima.llm import embed_dedup, embed_exact, neighbours


def planted(n=400, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, 120):  # near copies of a few vectors
        x[i] = x[200 + i % 12] + rng.normal(size=dim) * 0.08
    x[130:150] = x[129]
    return x.astype(np.float32).astype(float)


ODD = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16]


def rows_of(spark, x, labels):
    rows = [(i, v.tolist(), int(c), "n") for i, (v, c) in enumerate(zip(x, labels, strict=True))]
    rows += [(1000 + i, v, 1, "n") for i, v in enumerate(ODD)] + [(1050, [1.0, 2.0], 1, "n"), (1051, [1.0, 2.0], 1, "n"), (2000, x[0].tolist(), None, "n")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, k string")


def components(pairs, ids):
    top = {i: i for i in ids}

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("cell", [12_000, 60])
def test_duplicates_equal_brute_force(spark, cell, monkeypatch):
    x = planted()
    labels = np.arange(len(x)) % 3 % 2  # label 0 twice as often
    monkeypatch.setattr(embed_dedup, "SHARD", 80)
    searched = embed_dedup._searched
    monkeypatch.setattr(embed_dedup, "_searched", lambda *a: searched(*a, whole=cell, part=40 if cell == 60 else 3000))
    got = {r["vec_id"]: r for r in embed_dedup.duplicate_vectors(rows_of(spark, x, labels)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(hit, False)
    want = hit.sum(axis=1)
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert links.tolist() == want.tolist()
    comp = components([(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True)], range(len(x)))
    assert all(got[i]["component_id"] == comp[i] and got[i]["kept"] == (comp[i] == i) for i in range(len(x)))
    assert [got[1050]["n_links"], got[1051]["n_links"], got[1051]["component_id"]] == [1, 1, 1050]
    for i in [*range(1000, 1000 + len(ODD)), 2000]:
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]


def scattered(n=900, dim=16, seed=5):
    """Vectors without clusters, and for a third of them a partner a little above or below the threshold."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(n // 3):
        away = rng.normal(size=dim)
        away -= (away @ x[i]) * x[i]
        cosine = rng.uniform(0.925, 0.945)
        x[n // 2 + i] = cosine * x[i] + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away)
    return x


def truth(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.93
    np.fill_diagonal(hit, False)
    comp = components([(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True)], range(len(x)))
    return hit, [(i, int(hit[i].sum()), comp[i], comp[i] == i) for i in range(len(x))]


def skewed():
    x = scattered(n=800, seed=8)
    rng = np.random.default_rng(1)
    hot = x[0] + rng.normal(size=(400, 16)) * 0.02  # most of the links are within this group
    return np.vstack([x, hot])


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("make", [scattered, skewed])
def test_links_equal_brute_force_whatever_the_graph_misses(spark, make, monkeypatch):
    """Unclustered vectors, and single pairs beside a hot group, in small shards and pieces."""
    x = make()
    monkeypatch.setattr(embed_dedup, "SHARD", 200)
    searched, exact = embed_dedup._searched, embed_dedup.exact_links
    monkeypatch.setattr(embed_dedup, "_searched", lambda *a: searched(*a, whole=300, part=150))
    monkeypatch.setattr(embed_dedup, "exact_links", lambda *a: exact(*a, whole=300, part=100))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.duplicate_vectors(frame(spark, x)).collect())
    assert got == truth(x)[1]


def test_the_graph_alone_and_its_audit(spark, monkeypatch):
    """Clustered vectors: the graph finds at least nine tenths of the links, and the audit sees what it misses."""
    monkeypatch.setattr(embed_dedup, "SHARD", 100)
    x = planted(n=600, seed=6)
    nodes = embed_dedup._nodes(frame(spark, x), "vec_id", "embedding", "label")[1]
    found, (_, got, true) = embed_dedup.graph_links(nodes, 16, 0.93)
    assert true and got >= 0.9 * true
    lost = found.where("other is not null")
    missing, got, true = embed_dedup.audited(nodes, lost, 16, 0.93)
    assert missing and got == 0 and true > 0


@pytest.mark.parametrize("part", [30, 3000])
def test_all_pairs_lose_no_link(spark, part, monkeypatch):
    monkeypatch.setattr(embed_exact, "SHARD", 40)
    x = scattered()
    nodes = embed_dedup._nodes(frame(spark, x), "vec_id", "embedding", "label")[1]
    found = embed_exact.exact_links(nodes, 16, 0.93, 800, part)
    assert found.where("other is null").agg({"n": "sum"}).first()[0] == truth(x)[0].sum()


def test_building_prunes_a_node_few_times(monkeypatch):
    """A list is pruned again when it is full, not with every edge that leads back to it."""
    prune, pruned = embed_dedup.robust_prune, []
    monkeypatch.setattr(embed_dedup, "robust_prune", lambda x, nodes, *a: pruned.append(len(nodes)) or prune(x, nodes, *a))
    x = scattered(n=2000).astype(np.float32)
    lists, _ = embed_dedup.build(x)
    assert sum(pruned) < 8 * len(x)
    assert lists.shape == (2000, embed_dedup.DEGREE) and (lists >= 0).any(axis=1).all()
    for i, r in enumerate(lists):
        r = r[r >= 0]
        assert len(set(r.tolist())) == len(r) and i not in r


def test_a_search_holds_the_nodes_it_sees():
    """64 queries over 60,000 nodes on a ring: each sees its neighbourhood, whatever the number of nodes."""
    n, queries = 60_000, np.arange(64) * 900
    angle = 2 * np.pi * np.arange(n) / n
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1).astype(np.float32)
    lists = embed_dedup.both_ways(np.arange(n), (np.arange(n) + 1) % n, n)
    tracemalloc.start()
    seen = list(embed_dedup.greedy(x, x[queries], lists, np.array([0]), 3, 0.999999, queries))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * len(queries) * n
    met = {(int(a), int(b)) for r, w, _ in seen for a, b in zip(r, w, strict=True)}
    assert len(met) == sum(len(r) for r, _, _ in seen)  # each once
    reach = (x[queries] @ x.T > 0.999999 + 1e-6).nonzero()
    assert all((int(a), int(b)) in met for a, b in zip(*reach, strict=True) if b != queries[a])


def test_the_smallest_shard_of_both():
    a, b = np.array([[3, 1], [4, 2], [5, 6]], np.int32), np.array([[1, 3], [2, 7], [1, 2]], np.int32)
    assert embed_dedup.least_common(a, b).tolist() == [1, 2, np.iinfo(np.int32).max]


def test_duplicates_of_nothing(spark):
    assert embed_dedup.duplicate_vectors(rows_of(spark, planted(), np.zeros(400)).limit(0)).count() == 0


def test_neighbours(spark):
    x = planted()
    rows = rows_of(spark, x, np.zeros(len(x)))
    rows = rows.unionByName(spark.createDataFrame([(None, x[5].tolist(), 1, "n"), (100, x[100].tolist(), 1, "n")], rows.schema))
    got = {}
    for r in neighbours.nearest_neighbours(rows, centroids=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = total = 0
    for q in range(0, len(x), 50):
        if q == 100:
            continue
        best = sorted(got[q])
        assert [r for r, _, _ in best] == [1, 2, 3, 4, 5]
        scores = [s for _, _, s in best]
        assert scores == sorted(scores, reverse=True)
        for _, v, s in best:
            if v is not None and v < 1000:
                assert abs(u[q] @ u[v] - s) < 1e-12 and v != q
        s = np.delete(u @ u[q], q)
        true = np.sort(s)[::-1][:5]
        found += sum(x >= true[-1] - 1e-12 for x in scores)
        total += 5
    assert found / total >= 0.9
    assert len(got[100]) == 10 and max(s for _, _, s in got[100]) > 1 - 1e-9  # two rows, each the other's neighbour
    assert got[1050][0][1:] == (1051, pytest.approx(1.0)) and len(got[1050]) == 1
    assert not set(got) & {1000, 2001}


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0], 0) for i in range(0, 51)], "vec_id long, embedding array<double>, label int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest_neighbours(rows).collect()]
    assert sorted(got) == [(0, r, r) for r in range(1, 6)] + [(50, r, r - 1) for r in range(1, 6)]
    assert neighbours.nearest_neighbours(rows.limit(0)).count() == 0


def test_copies_in_several_parts_go_by_id(spark, monkeypatch):
    """200 copies of each vector, dealt out to parts: scores of copies are equal, so the ids decide."""
    monkeypatch.setattr(neighbours, "PART", 300)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 24))
    of = rng.permutation(np.repeat(np.arange(12), 200))
    ids = rng.permutation(2400)
    rows = spark.createDataFrame([(int(i), base[b].tolist(), 0) for i, b in zip(ids, of, strict=True)], "vec_id long, embedding array<double>, label int")
    got = {}
    for r in neighbours.nearest_neighbours(rows, centroids=4, recall=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    copies = {int(i): b for i, b in zip(ids, of, strict=True)}
    for q in range(0, 2400, 50):
        want = sorted(i for i, b in copies.items() if b == copies[q] and i != q)[:5]
        assert [v for _, v, _ in sorted(got[q])] == want
        assert len({s for _, _, s in got[q]}) == 1


def test_the_walk_is_in_order():
    rng = np.random.default_rng(0)
    index = neighbours.MultiIndex(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    d1, d2 = index.distances(rng.normal(size=(1, 6)))
    walk = list(index.walk(d1[0], d2[0]))
    sums = [d1[0][i] + d2[0][j] for i, j in walk]
    assert len(set(walk)) == 35 and sums == sorted(sums)
