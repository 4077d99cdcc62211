import public_tokenizers
from tokenizers import Tokenizer

from talentflow.llm import queries as Q
from talentflow.llm import token_counts as T

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Hello world", None, "", " \n\t", "<|endoftext|>hi<|startoftext|> there", "don't we'll 'tis", "é é", "a　b c",
       "日本語 12345", "\U0001f600 ok", "İSTANBUL ΣΑΣ", "x" * 3000, "word " * 50000, "Hello world"]


def test_against_the_library(spark):
    tok = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens int")
    got = {r.doc: (r.n_bytes, r.n_tokens) for r in T.token_counts(df, PATH).collect()}
    for i, t in enumerate(ODD):
        t = t or ""
        assert got[i] == (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)), t[:30]
    assert T.token_counts(df.limit(0), PATH).count() == 0


def test_memo_is_bounded():
    with open(PATH, encoding="utf-8") as f:
        c = T.PieceCounter(f.read(), memo=3)
    import numpy as np
    data = np.frombuffer(b"ab cd ef gh ab", np.uint8)
    s, e = np.array([0, 3, 6, 9, 12]), np.array([2, 5, 8, 11, 14])
    for part in (slice(0, 2), slice(2, 5), slice(0, 5)):
        h = np.array([1, 2, 3, 4, 1], np.uint64)[part]
        assert len(c.counts(data, s[part], e[part], h)) == len(h)
        assert len(c.keys) <= 3


def test_query(spark, table):
    tok = Tokenizer.from_file(PATH)
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) for r in table("documents").collect()}
    rows = Q.QUERIES["op10_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
