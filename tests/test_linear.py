import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from talentflow.operators import linear as LN
from talentflow.operators import ml as ML
from talentflow.operators import net as NET
from talentflow.plans import presets as P


@pytest.fixture(scope="module")
def data(spark):
    """Three classes of unlike size; features of unlike scale and place, one of them constant."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 5)) * [0.1, 1, 3, 1, 1] + [0, 4, 0, 0, 0]
    x[:, 4] = 2.5
    s = x[:, 0] * 10 + x[:, 1] + rng.normal(size=500) * 0.5
    y = np.digitize(s, np.quantile(s, [0.5, 0.85]))
    rows = [(i, i // 4 % 4, P.LABELS[c], float(c), Vectors.dense(v)) for i, (v, c) in enumerate(zip(x, y))]
    return ML.class_weights(spark.createDataFrame(rows, ["id", "fold", "suitability", "label_idx", "features"]), "suitability").cache()


def test_softmax_ends_where_the_estimator_does(data):
    est = ML.with_params(ML.classifiers()["logistic_regression"], {"maxIter": 12})
    want, got = est.fit(data), LN.fit([est], data)[0]
    assert type(got) is type(want) and got.getFeaturesCol() == "features"
    assert np.allclose(got.coefficientMatrix.toArray(), want.coefficientMatrix.toArray(), atol=1e-7)
    assert np.allclose(got.interceptVector.toArray(), want.interceptVector.toArray(), atol=1e-7)


def test_svm_ends_where_the_estimator_does(data):
    est = ML.classifiers()["linear_svm"]
    est = est.setClassifier(est.getClassifier().copy({est.getClassifier().maxIter: 6}))
    want, got = est.fit(data), LN.fit([est], data)[0]
    for a, b in zip(want.models, got.models):
        assert np.allclose(b.coefficients.toArray(), a.coefficients.toArray(), atol=1e-6) and abs(a.intercept - b.intercept) < 1e-6
    rows = [[r.prediction for r in m.transform(data).orderBy("id").collect()] for m in (want, got)]
    assert rows[0] == rows[1]


def test_models_share_their_passes(data, monkeypatch):
    """A grid on all folds reads the rows no oftener than its longest fit does."""
    passes, pass_over = [], LN._evaluate
    monkeypatch.setattr(LN, "_evaluate", lambda rows, fits, points: passes.append(len(fits)) or pass_over(rows, fits, points))
    est = ML.with_params(ML.classifiers()["logistic_regression"], {"maxIter": 5})
    scores = ML.cross_validate(data, {c: ML.with_params(est, {"regParam": c}) for c in (0.01, 0.1, 1.0)})
    assert len(scores) == 12 and passes[0] == 12 and len(passes) < 15
    assert all(s["n_train"] + s["n_valid"] == 500 and 0.3 < s["f1_macro"] <= 1 for s in scores)


def test_macro_f1_is_that_of_the_table(spark):
    y, p = [0, 0, 1, 1, 3, 3, 3], [0, 1, 1, 1, 0, 3, 1]
    counts = np.zeros((5, 5))
    np.add.at(counts, (y, p), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "label double, prediction double")
    assert LN.macro_f1(counts) == ML.macro_metrics(df).first().f1_macro


def test_net_counts_rows_instead_of_copying_them(spark, data):
    """The gradient is that of the repeated rows, and agrees with differences of the loss."""
    rng = np.random.default_rng(1)
    layers, x, y = [4, 5, 3, 3], rng.normal(size=(20, 4)), rng.integers(0, 3, 20)
    c, w = rng.integers(1, 5, 20).astype(float), rng.normal(size=4 * 5 + 5 + 5 * 3 + 3 + 3 * 3 + 3)
    loss, grad = NET.slope(x, y, c, NET.matrices(layers, w))
    again = NET.slope(np.repeat(x, c.astype(int), axis=0), np.repeat(y, c.astype(int)), np.ones(int(c.sum())), NET.matrices(layers, w))
    assert abs(loss - again[0]) < 1e-9 and np.allclose(grad, again[1])
    for i in range(0, len(w), 5):
        up, down = (NET.slope(x, y, c, NET.matrices(layers, w + s * 1e-6 * (np.arange(len(w)) == i)))[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - grad[i]) < 1e-4
    data.count()  # its own cache is there
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    model, history = ML.fit_mlp(data.filter("fold > 0"), data.filter("fold = 0"), hidden=(4,), step=3, max_iter=6)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before
    valid = ML.log_loss(model.transform(data.filter("fold = 0")))
    assert any(abs(h["valid_loss"] - valid) < 1e-9 and h["best"] for h in history)
    assert all(type(h[c]) is float for h in history for c in ("train_loss", "valid_loss"))  # as a table of them takes
