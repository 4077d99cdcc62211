import numpy as np
import pytest

from helpers import roots
from talentflow.llm import pq_dedup as P
from talentflow.llm import queries as Q


def _brute(vectors, t=0.9):
    ids = [i for i, _ in vectors]
    x = np.array([v for _, v in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= t
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)))]
    return dict(zip(ids, near.sum(1) - 1)), roots(ids, links)


def _groups(n=400, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        c = rng.normal(size=dim)
        for _ in range(rng.choice([1, 1, 1, 3, 20])):
            out.append((len(out), (c + rng.normal(size=dim) * 0.1).astype(np.float32).tolist()))
    return out


@pytest.mark.parametrize("block", [1024, 32])
def test_recall_and_counts(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    v = _groups()
    got = {r.id: r for r in P.near_vectors(spark.createDataFrame(v, "vec_id long, embedding array<float>")).collect()}
    links, root = _brute(v)
    total = sum(links.values())
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(v) and 0.98 * total <= found <= total
    assert all(r.n_links <= links[i] for i, r in got.items())                 # no link below the threshold
    assert np.mean([r.component_id == root[i] for i, r in got.items()]) > 0.99


def test_links_below_the_threshold_are_never_made(spark):
    a, b, c = [1.0, 0.0], [0.9, 0.43588989435406744], [0.899, 0.43795]
    rows = {r.id: r.n_links for r in P.near_vectors(spark.createDataFrame([(1, a), (2, b), (3, c)], "vec_id long, embedding array<double>")).collect()}
    cos = [np.dot(a, x) / np.linalg.norm(x) for x in (b, c)]
    assert rows[1] == sum(x >= 0.9 for x in cos)


def test_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]),
            (8, [2.0, 0.0]), (9, [1.0]), (10, []), (None, [0.0, 1.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, n_links int")
    got = [(r.id, r.n_links, r.component_id, r.kept) for r in P.near_vectors(df).collect()]
    assert len(got) == len(rows)
    assert {x[1:] for x in got if x[0] in (1,)} == {(3, 1, True)} and {x[1:] for x in got if x[0] == 8} == {(3, 1, False)}
    assert {x[1:] for x in got if x[0] == 7} == {(3, 1, False)}
    for i in (2, 3, 4, 5, 6, 9, 10):
        assert [x for x in got if x[0] == i] == [(i, 0, i, True)]
    assert P.near_vectors(df.limit(0)).count() == 0
    assert P.near_vectors(df.filter("vec_id IN (2, 3)")).count() == 2


def test_query_recall(spark, table):
    v = [(r.vec_id, r.embedding) for r in table("embeddings").collect()]
    links, root = _brute(v)
    rows = Q.QUERIES["op9_pq_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(v) and sum(r.n_links for r in rows) >= 0.9 * sum(links.values())
    assert all(r.n_links <= links[r.vec_id] and r.kept == (r.vec_id == r.component_id) for r in rows)


def test_tiny_and_huge_vectors(spark):
    """Vectors whose squares vanish or overflow link by their direction and disturb no other."""
    v = [(i, [float(x) for x in vec]) for i, vec in _groups(120)]
    more = [(1000, [1e-200] * 16), (1001, [2e-200] * 15 + [1.9e-200]), (1002, [1e200] * 16), (1003, [5e-324] + [0.0] * 15),
            (1004, [1.7e308] + [0.0] * 15)]
    got = {r.id: (r.n_links, r.component_id) for r in P.near_vectors(spark.createDataFrame(v + more, "vec_id long, embedding array<double>")).collect()}
    alone = {r.id: (r.n_links, r.component_id) for r in P.near_vectors(spark.createDataFrame(v, "vec_id long, embedding array<double>")).collect()}
    links, _ = _brute(v)
    assert sum(n for n, _ in alone.values()) >= 0.98 * sum(links.values())
    assert sum(got[i][0] for i, _ in v) >= 0.98 * sum(links.values())
    assert got[1000][0] >= 2 and {got[i][1] for i in (1000, 1001, 1002)} == {got[1000][1]}
    assert got[1003][0] >= 1 and got[1003][1] == got[1004][1]
