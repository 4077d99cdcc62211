import uuid

import numpy as np
import pytest

from talentflow.operators import svd as SVD
from talentflow.operators import tfidf
from talentflow.session import checkpoint_dir

WORDS = "spark hive kafka java scala python docker linux cloud azure sales retail audit ledger nurse clinic".split()


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    topics = [WORDS[:8], WORDS[6:12], WORDS[10:]]
    return [(i, " ".join(rng.choice(topics[i % 3], 12)) + " " + " ".join(rng.choice(WORDS, 4))) for i in range(n)]


def dense(spark, df, terms):
    """The weight matrix, by the long-table weights."""
    tf = tfidf.term_counts(df.withColumnRenamed("text", "t"), "id", "t", 2, False)
    at = {r.term: r.idx for r in terms.collect()}
    x = np.zeros((df.count(), len(at)))
    for r in tfidf.weigh(tf, terms, "id").collect():
        x[r.id, at[r.term]] = r.w
    return x


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(corpus(150), "id long, text string").repartition(5)
    return df, SVD.fit(df, "text", k=6, min_df=2, max_df=1.0, unicode=False, rounds=8)


def test_against_numpy(spark, fitted):
    df, model = fitted
    x = dense(spark, df, model.terms)
    want = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(model.singular, want[:6], rtol=2e-3)
    assert abs(model.energy - (want[:6] ** 2).sum() / (want ** 2).sum()) < 2e-3
    v = np.zeros((x.shape[1], 6))
    for r in model.terms.collect():
        v[r.idx] = r.v
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-9)
    got = np.array([r.svd for r in SVD.transform(model, df, "text").orderBy("id").collect()])
    assert np.allclose(got, x @ v, atol=1e-9)
    # the columns of X V are orthogonal, their lengths the singular values
    assert np.allclose(got.T @ got, np.diag(np.square(model.singular)), atol=1e-6 * want[0] ** 2)


def test_unseen_null_and_saved(spark, fitted):
    _, model = fitted
    new = spark.createDataFrame([(1, "spark kafka java", 5), (2, None, 6), (3, "", 7), (4, "unheardof", 8),
                                 (1, "spark kafka java", 5)], "id long, text string, y int")
    path = f"{checkpoint_dir(spark)}/svd-{uuid.uuid4().hex}"
    model.save(path)
    again = SVD.TextSvd.load(spark, path)
    rows = {}
    for m in (model, again):
        rows[id(m)] = [(r.id, r.y, r.svd) for r in SVD.transform(m, new, "text").orderBy("y").collect()]
        assert len(rows[id(m)]) == 5
        for i, y, s in rows[id(m)]:
            assert (np.abs(s).sum() > 0) == (i == 1) and len(s) == 6
    assert np.allclose(*([s for _, _, s in r] for r in rows.values()))


def test_small_corpora(spark):
    empty = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    model = SVD.fit(empty, "text", min_df=1, max_df=1.0)
    assert model.k == 0 and [r.svd for r in SVD.transform(model, empty, "text").collect()] == [[], []]
    few = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "id long, text string")
    assert SVD.fit(few, "text", k=50, min_df=1, max_df=1.0).k == 2
    assert SVD.transform(SVD.fit(few, "text", min_df=1, max_df=1.0), few.limit(0), "text").count() == 0


def test_joined_text_is_the_text_of_both(spark, monkeypatch):
    """Texts that pairs share are cut once; terms, weights and components are those of the whole text."""
    from pyspark.sql import functions as F

    from talentflow.functions import text as TX
    monkeypatch.setattr(tfidf, "LEFT_SLICE", 3)
    left = spark.createDataFrame([(i, None if i == 3 else "" if i == 4 else t) for i, t in corpus(20)], "l long, lt string")
    right = spark.createDataFrame([(0, "spark spark nurse"), (1, "sales Clinic, the audit"), (2, None), (3, "é"), (4, "kafka")], "r long, rt string")
    pairs = spark.createDataFrame([(i, (i * j) % 7) for i in range(21) for j in range(3)], "l long, r long")  # some keys are nowhere
    pairs = pairs.unionByName(pairs.filter("l = 5")).withColumn("y", F.lit(1)).repartition(3).cache()
    joined = tfidf.JoinedText(left, "l", "lt", right, "r", "rt")
    whole = pairs.join(left, "l", "left").join(right, "r", "left").withColumn("t", TX.concat_text("lt", "rt"))
    for n in (1, 2):
        a = SVD.fit(pairs, joined, k=4, min_df=2, max_df=1.0, unicode=False, rounds=6, ngram_max=n)
        b = SVD.fit(whole, "t", k=4, min_df=2, max_df=1.0, unicode=False, rounds=6, ngram_max=n)
        vocab = [[(r.idx, r.term, r.df, r.idf) for r in m.terms.orderBy("idx").collect()] for m in (a, b)]
        assert vocab[0] == vocab[1] and len(vocab[0]) > 10
        assert np.allclose(a.singular, b.singular, rtol=1e-9) and abs(a.energy - b.energy) < 1e-9
        rows = [[(r.l, r.r, r.y, r.svd) for r in SVD.transform(a, x, t).orderBy("l", "r").collect()]
                for x, t in ((pairs, joined), (whole, "t"))]
        assert [x[:3] for x in rows[0]] == [x[:3] for x in rows[1]] and len(rows[0]) == 66
        assert np.allclose([x[3] for x in rows[0]], [x[3] for x in rows[1]], atol=1e-12)


def test_weights_of_a_shared_text_are_one_row(spark):
    """Ten documents of a left text repeat neither its terms nor its products; scales make each of length 1."""
    left = spark.createDataFrame(corpus(6), "l long, lt string")
    right = spark.createDataFrame([(j, f"spark nurse word{j} word{j}") for j in range(10)], "r long, rt string")
    pairs = left.crossJoin(right).select("l", "r", (left.l * 10 + right.r).alias("id"))
    joined = tfidf.JoinedText(left, "l", "lt", right, "r", "rt")
    terms, (rows,), (n,) = tfidf.fit_rows([(pairs, "id", joined)], 1, 1, 1.0, 100, unicode=False, unique=True)
    rows = rows.collect()
    assert n == 60 and len(rows) == 6 and sorted(i for r in rows for i in r.id) == list(range(60))
    names = {r.idx: r.term for r in terms.collect()}
    text, job = dict(corpus(6)), {j: f"spark nurse word{j} word{j}" for j in range(10)}
    idf = {r.term: r.idf for r in terms.collect()}
    for r in rows:
        ends = np.append(0, np.cumsum(r.n))
        assert len(r.more_idx) == ends[-1] == 30
        for i, a, b, scale in zip(r.id, ends, ends[1:], r.scale):
            got = {names[t]: w for t, w in zip(r.idx, r.w)}
            for t, w in zip(r.more_idx[a:b], r.more_w[a:b]):
                got[names[t]] = got.get(names[t], 0.0) + w
            words = (text[i // 10] + " " + job[i % 10]).split()
            want = {t: (1 + np.log(words.count(t))) * idf[t] for t in set(words)}
            size = np.sqrt(sum(w * w for w in want.values()))
            assert {t: round(w * scale, 12) for t, w in got.items()} == {t: round(w / size, 12) for t, w in want.items()}


def test_no_text_is_written_for_every_pair(spark):
    """The feature table names the parts of a pair's text; it does not hold the text ten times."""
    from talentflow.plans import queries_ml as Q
    root = f"{checkpoint_dir(spark)}/pairs-{uuid.uuid4().hex}"
    spark.createDataFrame(corpus(40), "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(f"b{i}", t) for i, t in corpus(12, 2)], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    table, text = Q.feature_table(spark, root)
    assert not {"combined_text", "resume_text", "job_text"} & set(table.columns)
    assert table.select(text.left_key, text.right_key).dropna().count() == table.count() == 10 * text.left.count() == 400


def test_components_of_pairs_are_not_joined(spark):
    """A pair's columns travel with its texts: nothing is shuffled once its components are there."""
    left, right = (spark.createDataFrame(corpus(n, s), f"{c} long, {c}t string") for n, s, c in ((30, 1, "l"), (9, 2, "r")))
    joined = tfidf.JoinedText(left, "l", "lt", right, "r", "rt")
    pairs = left.crossJoin(right).selectExpr("l", "r", "l * 0.5D y", "array(cast(l as string)) a")
    model = SVD.fit(pairs, joined, k=3, min_df=2, max_df=1.0, unicode=False)
    out = SVD.transform(model, pairs, joined)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Join" not in plan[:plan.index("MapInArrow")]
    assert out.columns == ["l", "r", "y", "a", "svd"] and out.count() == 270
    assert all(r.y == r.l * 0.5 and r.a == [str(r.l)] and len(r.svd) == 3 for r in out.collect())
