import numpy as np

from talentflow.llm import quality_rules as R
from talentflow.llm import queries as Q


def test_rules_learn_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] <= 0.4)).astype(float)
    m = R.fit_rules(x, y, ["a", "b", "c"])
    z = np.full(len(x), m.bias)
    at = {"a": 0, "b": 1, "c": 2}
    for rule, w in zip(m.rules, m.weights):
        z += w * np.all([(x[:, at[n]] > lo) & (x[:, at[n]] <= hi) for n, lo, hi in rule], axis=0)
    assert (((1 / (1 + np.exp(-z))) > 0.5) == y).mean() > 0.97


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, "Plain words here.", 0.5), (2, None, 0.1), (3, "", 0.2), (1, "Plain words here.", 0.5),
                                  (None, "no id", 0.0), (5, "very long " * 40000, 0.0)], "doc_id long, text string, words double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0), (1, 1)], "doc_id long, quality int")
    for labels in (none, one):
        m = R.fit(docs, labels)
        assert not m.rules
        out = R.score(docs, m)
        assert out.columns == docs.columns + ["score"]
        rows = out.collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        assert {r.words for r in rows} == {0.5, 0.1, 0.2, 0.0}
    assert R.score(docs.limit(0), m).count() == 0


def test_held_out_quality(spark, table):
    sf = "/root/testdata/sf0.01"
    rows = Q.QUERIES["op2_quality"](spark, sf).collect()
    label = {r.doc_id: r.quality for r in table("labels", sf).collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.9
    assert len(rows) == table("documents", sf).count() and all(r.predicted == (r.score >= 0.7) for r in rows)


def test_scoring_runs_no_python(spark, table):
    m = R.Rules(0.0, [[("upper", 0.1, np.inf), ("words", -np.inf, 9.0)]], [1.5])
    plan = R.score(table("documents"), m)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
