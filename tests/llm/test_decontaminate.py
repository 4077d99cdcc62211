import hashlib

import pytest

from helpers import contamination, words
from talentflow.llm import decontaminate as D
from talentflow.llm import queries as Q

P = " ".join(f"w{i}" for i in range(40))
DOCS = [(1, f"before {P} after"), (2, None), (3, ""), (4, "!?"), (5, " ".join(f"w{i}" for i in range(12))),
        (6, "x " * 400 + " ".join(f"w{i}" for i in range(5, 18))), (7, "Short ITEM, here: twice short item"), (8, "ha " * 300),
        (9, f"before {P} after"), (9, f"before {P} after"), (None, f"{P}"), (11, "w0 w1 " + "long text " * 30000 + P)]
ITEMS = [(100, P), (101, "short item"), (102, None), (103, ""), (104, "ha " * 20), (100, P), (105, "item"), (20, P.upper())]


def _frames(spark, docs=DOCS, items=ITEMS):
    d = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in docs], "doc_id long, text string, item_id string, n_hit double")
    return d, spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    got = {(r.doc, r.n_words): (r.n_words, r.n_hit, r["items"]) for r in D.judge(*_frames(spark)).collect()}
    for i, t in DOCS:
        assert got[(i, len(words(t)))] == contamination([(i, t)], ITEMS)[i]
    assert D.judge(*_frames(spark)).count() == len(DOCS)


def test_spans_chain(spark):
    scan, hits = D.contamination(*_frames(spark))
    rid = scan.filter("doc = 1").first().rid
    s = D.spans(hits).filter(f"rid = {rid}").collect()
    assert [(r["first"], r["last"], r["words"]) for r in s] == [(1, 41, 40)]


def test_empty_tables(spark):
    d, b = _frames(spark)
    assert D.judge(d, b.limit(0)).filter("contaminated OR n_hit > 0").count() == 0
    assert D.judge(d.limit(0), b).count() == 0
    assert D.drop_contaminated(d, b.limit(0)).count() == len(DOCS)


def test_drop_keeps_clean_rows_and_columns(spark):
    d, b = _frames(spark)
    out = D.drop_contaminated(d, b)
    assert out.columns == d.columns
    assert {r.doc_id for r in out.collect()} == {2, 3, 4, 5, 6, 11}


@pytest.mark.parametrize("window,k", [(3, 2), (5, 5), (13, 5)])
def test_every_shared_span_is_found(spark, window, k):
    docs = [(i, " ".join("ab"[(i >> j) & 1] * (1 + j % 2) for j in range(12))) for i in range(0, 4000, 7)]
    items = [(1, docs[3][1]), (2, docs[100][1][4:])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    scan, hits = D.contamination(d, b, window=window, k=k)
    got = {r.doc for r in hits.join(scan, "rid").select("doc").distinct().collect()}
    assert got == {i for i, (n, hit, _) in contamination(docs, items, window).items() if hit}


def test_query(spark, table):
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    want = contamination(docs, [(r.item_id, r.text) for r in table("benchmark").collect()])
    rows = Q.QUERIES["op1_decontaminate"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hit, items = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(items))
        assert r.items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_dropping_shuffles_no_texts(spark):
    """Only marked rows reach the join with the contaminated ids; a null id is an id too."""
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (2, "all clean here"), (None, text), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, text)], "item_id long, text string")
    out = D.drop_contaminated(docs, items)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(2, "all clean here"), (3, None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and plan.count("ArrowEvalPython") >= 2
