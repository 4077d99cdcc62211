import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from talentflow.operators import boosting as B
from talentflow.operators import ml as ML


def rows(n=900, seed=3):
    """Three classes of two features that one linear cut cannot tell apart, and two of noise."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 4))
    y = np.where(x[:, 0] * x[:, 1] > 0.15, 2, np.where(x[:, 0] * x[:, 1] < -0.15, 0, 1))
    return [(i, i // 3, Vectors.dense(v), float(c), 1.0, bool(i // 3 % 5 == 0)) for i, (v, c) in enumerate(zip(x, y))]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), ["id", "g", "features", "label_idx", "weight", "out"]).repartition(4).cache()


def test_best_split_by_hand():
    """One node, one feature, two classes: the gain of every cut, worked out in plain loops."""
    rng = np.random.default_rng(0)
    hist = np.concatenate((rng.normal(size=(1, 1, 5, 2)), rng.uniform(1, 3, (1, 1, 5, 2))), axis=3)
    f, cut, gain, left, right = B.best_splits(hist, 2, 3.0, 0.1, 0.0)[0]

    def worth(s):
        return sum(s[k] ** 2 / (s[2 + k] + 3.0) for k in range(2))
    want = [0.5 * (worth(hist[0, 0, :i + 1].sum(0)) + worth(hist[0, 0, i + 1:].sum(0)) - worth(hist[0, 0].sum(0))) - 0.1
            for i in range(4)]
    if max(want) > 0:
        assert (f, cut) == (0, int(np.argmax(want))) and abs(gain - max(want)) < 1e-12
        assert np.allclose(left, hist[0, 0, :cut + 1].sum(0)) and np.allclose(left + right, hist[0, 0].sum(0))
    else:
        assert f == -1


def test_histograms_equal_plain_sums(spark, data):
    edges = B.feature_edges(data, "features", 4, 8)
    table = B._table(data, "features", "label_idx", "weight", "out", edges, np.zeros(3))
    tree = B.Tree(np.array([0, -1, -1]), np.array([3, 0, 0]), np.zeros((4, 3)))
    hist, loss = B._level(table, [], tree, 1, 0, np.array([1, 3]), 4, 8, 3, 1.0)
    want = np.zeros((2, 2, 8, 6))
    n = 0
    for r in data.collect():
        if r.out:
            continue
        n += 1
        bins = [int(np.searchsorted(e, v, side="left")) for e, v in zip(edges, r.features.toArray())]
        g = np.full(3, 1 / 3) - np.eye(3)[int(r.label_idx)]
        for j, f in enumerate((1, 3)):
            want[j, int(bins[0] > 3), bins[f]] += np.concatenate((g, np.full(3, 4 / 9)))
    assert np.allclose(hist, want) and abs(loss[0] - n * np.log(3)) < 1e-9 and loss[1] == n


def test_learns_and_stops(spark, data):
    """On groups held out; a linear model cannot tell these classes apart."""
    test = data.filter("out")
    model = B.fit(data, 4, held_out="out", rounds=60, depth=3, rate=0.6, least=1.0, gamma=0.0, reg=1.0, patience=3)
    f1 = ML.macro_metrics(model.transform(test), "label_idx", "prediction").first().f1_macro
    linear = ML.classifiers()["logistic_regression"].fit(data.filter("not out"))
    assert f1 > 0.9 > 0.6 > ML.macro_metrics(linear.transform(test), "label_idx", "prediction").first().f1_macro
    losses = [h["held_out_loss"] for h in model.history]
    assert len(model.trees) < len(losses) < 61 and min(losses) == pytest.approx(losses[len(model.trees)], abs=1e-4)
    assert np.allclose(np.sum([r.probability for r in model.transform(test).collect()], axis=1), 1)
    assert model.importances(4)[:2].sum() > 0.7


def test_kept_scores_change_nothing(spark, data, monkeypatch):
    a = B.fit(data, 4, rounds=5, sample=1.0, columns=1.0)
    monkeypatch.setattr(B, "KEEP", 2)
    b = B.fit(data, 4, rounds=5, sample=1.0, columns=1.0)
    assert len(a.trees) == len(b.trees) == 5
    for s, t in zip(a.trees, b.trees):
        assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and np.allclose(s.value, t.value)


def test_places_are_those_of_a_walk():
    """Whole features are compared at once; each row ends where a walk from the root does."""
    rng = np.random.default_rng(2)
    for depth in (1, 4, 9):
        n = (1 << depth) - 1
        tree = B.Tree(rng.integers(-1, 6, n), rng.integers(0, 7, n), rng.normal(size=(n + 1, 3)))
        bins = rng.integers(0, 9, (6, 300)).astype(np.uint8)
        got = tree.places(bins, depth)
        for i in range(300):
            at = 0
            for _ in range(depth):
                f = tree.feature[at]
                at = 2 * at + 1 + int(f >= 0 and bins[f, i] > tree.cut[at])
            assert got[i] == at - n
        assert np.array_equal(tree.scores(bins), tree.value[got])
