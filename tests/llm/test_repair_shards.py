import uuid
import zlib
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from talentflow.llm import kernel as K
from talentflow.llm import queries as Q
from talentflow.llm import repair_shards as R

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(5, "Hello world"), (2, None), (3, ""), (4, " \n\t"), (9, "<|endoftext|>hi <|endoftext|> there,<|endoftext|>"),
       (6, "don't we'll 'tis it's 3's a'b"), (7, "é é  x\u0085 y　  z  w  v café au"), (8, "日本語 12345,67.8"),
       (1, "\U0001f600 ok  two   three \r\n x"), (10, "x" * 3000), (11, "word " * 50000), (5, "Hello world"),
       (None, "no id"), (12, "a, b; c. (d) [e] <f|g> h|i_j-k \x1c l\x1f m")]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def enc():
    with open(PATH, encoding="utf-8") as f:
        return R.UnitEncoder(f.read())


def brute(docs, tok):
    """``[(id, start, ids)]`` in id order, by the library."""
    rows = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]
    start = [0, *accumulate(map(len, ids))]
    return [(r[0], s, i) for r, s, i in zip(rows, start, ids)]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t \u0085　 \x1cabZé日1_'.,<|>-", max_size=40), min_size=1, max_size=4))
def test_units_are_encoded_alone(enc, tok, texts):
    s = next(K.slices(pa.array(texts)))
    ids, counts = enc.encode(s.data, s.offsets, 2)
    want = [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=60), min_size=1, max_size=5), st.integers(2, 4), st.sampled_from([3, 20, 70_000]))
def test_compression_is_lossless(docs, least, room):
    ids, counts = np.array(sum(docs, []), np.uint32), np.array([len(d) for d in docs])
    symbols, per, rules, lengths = R.compress(ids, counts, 4, room, least)
    g = R.Grammar(4, rules.astype(np.int64), lengths)
    assert g.expand(symbols).tolist() == ids.tolist() and len(rules) <= room
    # each document's symbols stand for its own ids
    ends = np.cumsum(per)
    assert [g.expand(symbols[a:z]).tolist() for a, z in zip(ends - per, ends)] == docs
    assert all(g.expand(np.array([4 + i])).size == n for i, n in enumerate(lengths))


def test_frequent_pairs_are_replaced():
    ids = np.tile(np.array([7, 8, 9, 7, 8, 5], np.uint32), 500)
    symbols, _, rules, _ = R.compress(ids, np.array([len(ids)]), 10, 1000)
    assert len(symbols) < len(ids) / 8 and (7, 8) in {tuple(r) for r in rules.tolist()}
    # a run of one id: pairs that do not overlap
    ones = np.full(4097, 3, np.uint32)
    symbols, _, rules, lengths = R.compress(ones, np.array([4097]), 10, 1000)
    assert R.Grammar(10, rules.astype(np.int64), lengths).expand(symbols).tolist() == ones.tolist() and len(symbols) < 400


def test_memo_is_bounded(tok):
    with open(PATH, encoding="utf-8") as f:
        e = R.UnitEncoder(f.read(), memo=3)
    for text in ("ab cd ef gh ab", "cd ij", "kl mn op", "ab cd"):
        s = next(K.slices(pa.array([text])))
        assert e.encode(s.data, s.offsets, 2)[0].tolist() == tok.encode(text).ids + [2]
        assert len(e.keys) <= 3 + 5


def test_file_round_trip_and_random_access(spark, tok):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("part", R.F.lit("x")).repartition(4)
    want = brute(ODD, tok)
    for shard in (R.SHARD, 5):
        path = R.new_path(spark, f"test-{uuid.uuid4().hex}")
        R.write(df, path, PATH, 2, shard=shard)
        got = sorted((r.start, r.doc, list(r.ids), r.n_tokens, r.ids_crc32) for r in R.read(spark, path).collect())
        assert got == [(s, i, ids, len(ids), crc(ids)) for i, s, ids in want]
        flat = sum((ids for _, _, ids in want), [])
        for lo, hi in ((0, 1), (3, 40), (len(flat) - 7, len(flat) + 5), (100, 50_010), (0, len(flat)), (9, 9)):
            rows = sorted((r.start, list(r.ids)) for r in R.token_range(spark, path, lo, hi).collect())
            assert sum((x for _, x in rows), []) == flat[lo:hi]
            assert not rows or rows[0][0] == lo
    assert R.write_and_read(df.limit(0), PATH, 2).count() == 0


def test_query(spark, table, tok):
    want = [(i, s, len(ids), crc(ids)) for i, s, ids in brute([(r.doc_id, r.text) for r in table("documents").collect()], tok)]
    rows = Q.QUERIES["op12_repair_shards"](spark, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(tuple(r) for r in rows.collect()) == sorted(want)
