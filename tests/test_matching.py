from pyspark.sql import functions as F

from talentflow.operators import matching as MT
from talentflow.operators import tfidf as TF


def test_suitability_tiers(spark):
    df = spark.createDataFrame([(44.7,), (36.5,), (20.0,), (19.9,), (40.0,)], "s double")
    got = [r.t for r in df.select(MT.suitability("s").alias("t")).collect()]
    assert got == ["Highly Suitable", "Suitable", "Suitable", "Not Suitable", "Highly Suitable"]


def test_hybrid_score_rounding(spark):
    df = spark.createDataFrame([(0.5, 0.3333)], "t double, o double")
    assert df.select(MT.hybrid_score("t", "o").alias("s")).first().s == 45.0


def test_flagship_rank_starts_at_one(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.count() > 0
    bad = out.groupBy("doc_id").agg(F.min("rank").alias("m"), F.max("rank").alias("x"),
                                    F.count(F.lit(1)).alias("n")) \
             .filter("m != 1 or x != n").count()
    assert bad == 0
    assert out.filter("text_similarity < 0 or text_similarity > 1.000001").count() == 0


def test_topk_is_complete(spark):
    from talentflow.operators import tfidf as TF
    left = spark.createDataFrame([(1, "alpha beta gamma"), (2, "nothing shared"), (3, None)], "doc_id long, text string")
    right = spark.createDataFrame([(i, "alpha beta" if i == 30 else "gamma delta" if i == 7 else f"solo{i} words{i}")
                                   for i in (30, 7, 5, 11, 2, 40)], "item_id long, text string")
    _, (lw, rw) = TF.fit_transform([(left, "doc_id", "text"), (right, "item_id", "text")], min_df=1, max_df=1.0, unicode=False)
    top = MT.cosine_topk(lw, rw, "doc_id", "item_id", 4, left, right)
    got = {}
    for r in top.orderBy("doc_id", "text_rank").collect():
        got.setdefault(r.doc_id, []).append((r.item_id, r.text_similarity > 0))
    assert got[1] == [(30, True), (7, True), (2, False), (5, False)]
    assert got[2] == got[3] == [(2, False), (5, False), (7, False), (11, False)]
    assert MT.cosine_topk(lw, rw, "doc_id", "item_id", 50, left, right).count() == 18


def test_most_frequent_terms_by_histogram(spark):
    from talentflow.operators import tfidf as TF
    rows = [(f"t{i:03d}", 1, (i * 7919) % 23 + 1) for i in range(200)]
    stats = spark.createDataFrame(rows, "term string, df long, total long")
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    for n in (1, 5, 8, 9, 50, 199, 200, 500):
        assert {r.term for r in TF.most_frequent(stats, n).collect()} == {r[0] for r in order[:n]}


def test_nearest_over_several_groups_and_merged_ids(spark, monkeypatch):
    """Groups, blocks and terms cut small give the pairs of the plain join; rows of one id (or
    of none) are one document."""
    import numpy as np
    from pyspark.sql import functions as F
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    left = [(i, " ".join(rng.choice(words, 12))) for i in range(40)] + [(3, "w1 w2 w2"), (None, "w4 w5"), (None, "w6"), (77, ""), (78, None)]
    right = [(i, " ".join(rng.choice(words, 9))) for i in range(25)] + [(100, "w1 w2 w2"), (101, "w1 w2 w2")]
    l, r = (spark.createDataFrame(x, f"{c} long, text string") for x, c in ((left, "a"), (right, "b")))
    terms, (lw, rw), sizes = TF.fit_rows([(l, "a", "text"), (r, "b", "text")], min_df=2, max_df=1.0, unicode=False)
    assert sizes == [43, 27]
    for name, n in [("LEFT_GROUP", 7), ("RIGHT_GROUP", 5), ("LEFT_BLOCK", 3), ("RIGHT_TERMS", 10)]:
        monkeypatch.setattr(MT, name, n)
    got = {(x.a, x.text_rank): (x.b, round(x.text_similarity, 9)) for x in MT.cosine_topk(lw, rw, "a", "b", 4, n_left=43, n_right=27).collect()}
    tf = [TF.term_counts(d, c, "text", unicode=False) for d, c in ((l, "a"), (r, "b"))]
    both = tf[0].select(F.col("a").cast("string").alias("d"), "term", "tf").union(
        tf[1].select(F.concat(F.lit("r"), "b"), "term", "tf"))
    vocab = TF.fit_vocabulary(both, "d", 70, 2, 1.0)
    assert {(t.term, t.df) for t in vocab.collect()} == {(t.term, t.df) for t in terms.collect()}
    pairs = MT.cosine_pairs(TF.weigh(tf[0], vocab, "a"), TF.weigh(tf[1], vocab, "b"), "a", "b")
    want = {(x.a, x.text_rank): (x.b, round(x.text_similarity, 9))
            for x in MT.top_k(pairs, "a", [F.desc("text_similarity"), F.asc("b")], 4, "text_rank").collect()}
    assert got == want and any(a is None for a, _ in got)


def test_matching_sorts_no_terms(spark):
    """Neither pairs nor (document, term) rows are aggregated in the plan of the top-k join."""
    df = spark.createDataFrame([(1, "one two three"), (2, "two three four")], "a long, text string")
    _, (lw, rw), sizes = TF.fit_rows([(df, "a", "text"), (df.withColumnRenamed("a", "b"), "b", "text")], min_df=1, max_df=1.0)
    plan = MT.cosine_topk(lw, rw, "a", "b", 1, n_left=sizes[0], n_right=sizes[1])._jdf.queryExecution().executedPlan().toString()
    assert "term" not in plan and "SortMergeJoin" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_skill_gap_meets_the_matches_once(spark):
    """Named jobs, best matches, both for one candidate, repeats and NULLs, from one join with the matches."""
    m = spark.createDataFrame([(1, 10, 5.0), (1, 11, 9.0), (1, 11, 9.0), (2, 10, 3.0), (2, 12, 3.0), (3, None, 7.0), (3, 10, 1.0),
                               (None, 10, 9.0), (5, 10, 2.0)], "candidate_id long, job_id long, final_match_score double")
    m = m.selectExpr("*", "'t' job_title", "array('a') matching_skills", "array('b') missing_skills", "'x' suitability")
    jobs = spark.createDataFrame([(10, ["s"]), (11, None)], "job_id long, required_skills array<string>")
    req = spark.createDataFrame([(1, 11), (1, 11), (1, None), (2, None), (3, None), (None, 10), (4, 10), (5, 77)], "candidate_id long, job_id long")
    got = MT.skill_gap(m, jobs, req)
    rows = sorted((tuple(r) for r in got.select("candidate_id", "job_id", "match_score", "job_required_skills").collect()), key=str)
    assert rows == [(1, 11, 9.0, [])] * 3 + [(2, 10, 3.0, ["s"]), (3, None, 7.0, [])]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("'t' AS job_title") + \
        got._jdf.queryExecution().optimizedPlan().toString().count("t AS job_title") == 1
