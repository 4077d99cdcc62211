import numpy as np
import pytest

from talentflow.llm import langid_cnn as L
from talentflow.llm import queries as Q


def test_gradients_by_differences():
    net = L.ByteCNN(["a", "b", "c"], 3)
    for k in ("emb", "conv", "cbias", "dense", "dbias"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (4, 20)).astype(np.uint16), np.array([0, 1, 2, 1])

    def loss():
        return -net.forward(x)[0][np.arange(4), y].mean()
    state = {}
    before = {k: getattr(net, k).copy() for k in ("dense", "conv", "emb")}
    net.step(x, y, state, 1, 0.0)
    for k, v in before.items():
        setattr(net, k, v.astype(np.float64))
        i = np.unravel_index(np.argmax(np.abs(state[k][0])), v.shape)
        d = 1e-4
        getattr(net, k)[i] += d
        up = loss()
        getattr(net, k)[i] -= 2 * d
        slope = (up - loss()) / (2 * d)
        getattr(net, k)[i] += d
        assert abs(slope - state[k][0][i] * 10) < 1e-3 + 0.05 * abs(slope)


def test_windows_cover_whole_texts():
    data = np.arange(700, dtype=np.int64).astype(np.uint8)
    x, row = L._windows(data, np.array([0, 0, 300, 300, 700]), 256)
    assert row.tolist() == [1, 1, 3, 3]
    assert np.concatenate([w[w != L.PAD] for w in x]).astype(np.uint8).tolist() == data.tolist()


def test_defined_results(spark):
    rows = [(1, "the cat and the dog " * 20, "en", 0.3), (2, "le chat et le chien " * 20, "fr", 0.3), (3, None, "en", 0.3), (4, "", "fr", 0.3),
            (5, "12 !? 34", "en", 0.3), (6, "ééé", None, 0.3), (7, "日本", "fr", 0.3), (1, "the cat and the dog " * 20, "en", 0.3),
            (8, "the dog " * 30000, None, 0.3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    train = docs.filter("doc_id < 3")
    big = train
    for _ in range(5):
        big = big.union(big)
    model = L.fit(big)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "fr" and got[8][0] == "en"
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[6][0] in ("en", "fr") and got[7][0] in ("en", "fr")
    assert L.predict(docs, model).count() == len(rows)
    assert L.fit(docs.filter("lang IS NULL")) is None
    assert {r.lang_pred for r in L.predict(docs, None).collect()} == {"und"}
    assert L.predict(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark, table):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in table("documents", sf).select("doc_id", "lang").collect()}
    rows = Q.QUERIES["op3_language_id"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "hello there", 0.5, "x"), (2, None, 0.1, "y")], "doc_id long, text string, score double, Lang_pred string")
    with pytest.raises(ValueError):
        L.predict(df, None, keep=("doc_id", "score"))
    rows = L.predict(df, None, keep=tuple(df.columns), lang_out="l", score_out="s").orderBy("doc_id").collect()
    assert [(r.score, r.Lang_pred, r.l, r.s) for r in rows] == [(0.5, "x", "und", 0.0), (0.1, "y", "und", 0.0)]
