import hashlib
import math
import zlib
from collections import Counter

import numpy as np
from helpers import words
from hypothesis import given, settings
from hypothesis import strategies as st

from talentflow.llm import crc_resampling as R
from talentflow.llm import kernel as K
from talentflow.llm import queries as Q
import pyarrow as pa

ODD = [(1, "The cat sat on the mat " * 5, "x"), (2, None, None), (3, "", "x"), (4, " .,!\n", "x"),
       (5, "Ñandú ÉCOLE ecole 日本語 " * 6, "y"), (6, "word " * 4000 + "x" * 70000, "y"),
       (1, "The cat sat on the mat " * 5, "x"), (None, "a b c d e f g h i j k l m n o p q r s t u", "y"),
       (8, "a b c d e f g h i j k l m n o p q r s t u", None), (9, "one two", "z")]
TARGET = [(1, "the cat sat"), (2, None), (3, "a b c d école Ñandú")]


def features(text, n_max):
    w = words(text)
    return w, [" ".join(w[i:i + n]) for n in range(1, n_max + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, n_max=1, buckets=10_000, min_words=20, percent=10, seed="2024"):
    """Rows ``(id, n_words, n_features, weight, score, rank)`` by zlib and plain Python."""
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, n_max)[1])
    s, t = counts(x for _, x in docs), counts(x for _, x in target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        w, f = features(text, n_max)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        key = f"{seed}:{'' if i is None else i}"
        h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
        rows.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(fit[:percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abZ é,日", max_size=40), min_size=1, max_size=5), st.integers(1, 3))
def test_crcs_equal_zlib(texts, n_max):
    s = next(K.slices(pa.array(texts)))
    w, grams = R.feature_crcs(s.data, s.offsets, n_max)
    have = [Counter() for _ in texts]
    for row, crc in grams:
        for r, c in zip(row.tolist(), crc.tolist()):
            have[r][c] += 1
    assert have == [Counter(zlib.crc32(f.encode()) for f in features(t, n_max)[1]) for t in texts]


def test_shift_by_any_length():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, 40, dtype=np.uint32)
    n = np.array([0, 1, 2, 255, 256, 257, 511, 512, 65535, 70001] * 4)
    for a, k, y in zip(x.tolist(), n.tolist(), R.shift(x, n).tolist()):
        # the register after k zero bytes: zlib's start value is cancelled
        assert y == zlib.crc32(bytes(k), a ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def test_odd_rows_equal_brute_force(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, rank string").withColumn("score", R.F.lit(1))
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    docs = [(i, t) for i, t, _ in ODD]
    for n_max, buckets, percent in ((1, 10_000, 10), (3, 97, 60), (2, 1 << 16, 100)):
        assert got(R.resample(df, target, n_max=n_max, buckets=buckets, percent=percent)) == brute(
            docs, TARGET, n_max, buckets, percent=percent)
    assert R.resample(df.limit(0), target).count() == 0
    assert got(R.resample(df, target.limit(0))) == brute(docs, [])


def test_one_score_in_all_rows(spark):
    """Rows that tie in score and id are split and numbered through."""
    df = spark.createDataFrame([(7, "same text " * 20)] * 3000, "doc_id long, text string").repartition(7)
    rows = R.resample(df, df.limit(1), percent=50).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 1501)) and len(rows) == 3000


def test_query(spark, table):
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    want = [(i, n, w, s, k) for i, _, n, w, s, k in brute(docs, [(r.item_id, r.text) for r in table("benchmark").collect()])]
    assert got(Q.QUERIES["op13_crc_resampling"](spark, "/root/testdata/sf0.001")) == sorted(want, key=repr)
