import random

from helpers import near_duplicates, shingles
from talentflow.llm import ngram_join as N
from talentflow.llm import queries as Q


def _docs(n=40, seed=3):
    r = random.Random(seed)
    docs = []
    for g in range(n):
        base = [f"t{r.randrange(900)}" for _ in range(r.choice([4, 5, 30, 120, 300]))]
        for _ in range(r.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                w[r.randrange(len(w))] = f"n{r.randrange(9999)}"
            docs.append((len(docs), (", " if r.random() < 0.5 else " ").join(w)))
    return docs


def test_least_matches_is_a_posterior_tail():
    least = N.least_matches(0.8, 1e-7)
    assert len(least) == N.HASHES // N.ROUND and least == sorted(least) and 60 < least[-1] < 0.8 * N.HASHES
    assert N.least_matches(0.8, 0.01)[-1] > least[-1]


def test_against_brute_force(spark):
    docs = _docs() + [(900, None), (901, ""), (902, "?!"), (903, "one two"), (904, "One, TWO"), (905, "word " * 60000)]
    df = spark.createDataFrame([(i, t, i, "x") for i, t in docs], "doc_id long, text string, class_id long, rep string")
    judged, links = N.near_duplicates(df), N.similar_pairs(df)
    want = near_duplicates(docs)
    rows = judged.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_links, r.component_id) == want[r.doc], r.doc
        assert r.kept == (r.doc == r.component_id)
    sets = {i: shingles(t) for i, t in docs}
    pairs = links.collect()
    assert pairs and len({(r.a, r.b) for r in pairs}) == len(pairs)
    for r in pairs:
        x, y = sets[r.a], sets[r.b]
        assert x != y and abs(r.jaccard - len(x & y) / len(x | y)) < 1e-12
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc for r in rows if r.kept}


def test_many_copies_make_no_pairs(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "'the very same text of seven words' AS text")
    judged, links = N.near_duplicates(df), N.similar_pairs(df)
    assert links.count() == 0
    assert {(r.n_links, r.component_id) for r in judged.collect()} == {(2999, 0)}
    assert N.drop_near_duplicates(df).count() == 1


def test_a_large_group_of_near_copies_meet_in_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(base[:100] + [f"x{i}"] + base[101:])) for i in range(300)]   # more than BLOCK
    monkeypatch.setattr(N, "BLOCK", 64)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    judged, links = N.near_duplicates(df), N.similar_pairs(df)
    assert {(r.n_links, r.component_id) for r in judged.collect()} == {(299, 0)}
    assert links.count() == 300 * 299 // 2


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(5, "a b c d e f g"), (5, "a b c d e f g"), (7, "A B C d e f g"), (None, "lone row")], "doc_id long, text string")
    rows = N.near_duplicates(df).collect()
    assert sorted((r.doc, r.n_links, r.component_id, r.kept) for r in rows if r.doc) == [(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False)]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_query(spark, table):
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    want = near_duplicates(docs)
    got = {r.doc_id: (r.n_links, r.component_id) for r in Q.QUERIES["op6_ngram_jaccard_join"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want
