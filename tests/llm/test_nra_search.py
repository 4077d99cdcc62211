import math
from collections import Counter

import numpy as np
from helpers import words
from hypothesis import given, settings
from hypothesis import strategies as st

from talentflow.llm import nra_search as S
from talentflow.llm import queries as Q

DOCS = [(1, "red fish blue fish", 1), (2, "red fish blue fish", 2), (3, None, 3), (4, "", 4), (5, "...", 5),
        (6, "Red ÉTÉ été 日本語 RED", 6), (7, "blue " * 3000, 7), (1, "red fish blue fish", 1), (None, "red fish blue fish", 9),
        (8, "green", 8), (9, "fish fish fish one two three", 9)]
ITEMS = [(1, "red fish"), (2, "RED fish red"), (3, None), (4, ""), (5, "nothing here"), (6, "blue été 日本語 green one"),
         (1, "red fish"), (None, "green")]


def brute(docs, items, k=10):
    """Rows ``(item, rank, doc, score)`` by plain Python."""
    bags = [(i, Counter(words(t))) for i, t in docs]
    N = sum(1 for _, b in bags if b)
    L = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            n, score = sum(b.values()), 0
            for t in set(words(text)) & set(b):
                w = math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + (90 * n * N) // L
                score += w * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_nra_keeps_the_best_and_exact_scores(data):
    """Random lists with many ties: whatever can be among the k best is returned, exactly."""
    rows = data.draw(st.integers(1, 60))
    n_terms = data.draw(st.integers(1, 6))
    posts = data.draw(st.lists(st.tuples(st.integers(0, n_terms - 1), st.integers(0, rows - 1), st.integers(1, 4)),
                               max_size=150, unique_by=lambda p: p[:2]))
    term, doc, tf = (np.array(x, np.int64) for x in (zip(*posts) if posts else ([], [], [])))
    size = np.bincount(doc, weights=tf, minlength=rows).astype(np.int64) + 1
    weight = np.array(data.draw(st.lists(st.integers(-3, 5), min_size=n_terms, max_size=n_terms)), np.int64).clip(0)
    lists = S.ImpactLists(term, doc, tf, size, rows, int(size.sum()), weight)
    full = np.zeros(rows, np.int64)
    np.add.at(full, lists.doc, lists.impact)
    k, floor = data.draw(st.integers(1, 8)), data.draw(st.integers(0, 3000))
    docs, scores, _ = S.nra(lists, np.arange(n_terms), k, floor, step=1)
    assert (full[docs] == scores).all()
    best = sorted(full[full >= max(floor, 1)].tolist(), reverse=True)
    bar = best[k - 1] if len(best) >= k else max(floor, 1)
    assert set(np.flatnonzero((full >= bar) & (full > 0)).tolist()) <= set(docs.tolist())


def test_reading_stops_early():
    """A rare term decides: the common list is not read to its end for those that are out."""
    n = 20_000
    doc = np.concatenate((np.arange(n), np.arange(20)))
    term = np.concatenate((np.zeros(n, np.int64), np.ones(20, np.int64)))
    tf = np.ones(n + 20, np.int64)
    lists = S.ImpactLists(term, doc, tf, np.arange(1, n + 1), n, int(np.arange(1, n + 1).sum()), np.array([1, 5000]))
    docs, scores, read = S.nra(lists, np.array([0, 1]), 10)
    assert set(range(10)) <= set(docs.tolist()) and read < n / 10


def test_odd_rows_equal_brute_force(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, score int").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute([r[:2] for r in DOCS], ITEMS)
    for segment, block in ((S.SEGMENT, S.BLOCK_TERMS), (8, 3)):
        assert got(S.search(df, items, segment=segment, block_terms=block)) == want
    assert got(S.search(df, items, k=2)) == brute([r[:2] for r in DOCS], ITEMS, 2)
    assert S.search(df.limit(0), items).count() == 0
    assert S.search(df, items.limit(0)).count() == 0


def test_query(spark, table):
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    want = brute(docs, [(r.item_id, r.text) for r in table("benchmark").collect()])
    rows = Q.QUERIES["op11_nra_search"](spark, "/root/testdata/sf0.001").select("item_id", "rank", "doc_id", "score")
    assert got(rows) == want
