from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talentflow.llm import kernel as K
from talentflow.llm import queries as Q
from talentflow.llm import sp_sampling as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = S.Pieces(PATH)
TEXTS = ["Hello world", " lead", "a  b   c ", "", "\n\n x\n", "▁lit▁", "日本語テキスト 𝄞", "x" * 300, "tab\tq  ", "é" * 100 + " z", "\x00\x01", "   "]


def _round(texts, seeds=None):
    out, ids_of = [], []
    seeds = np.arange(len(texts), dtype=np.uint64) if seeds is None else seeds
    for s in K.slices(pa.array(texts, pa.string())):
        ids, off = S.sample(PIECES, s.data, s.offsets, K.mix(seeds[s.lo:s.hi]))
        d, o = S.join_pieces(PIECES, ids, off)
        out += [d[o[i]:o[i + 1]].tobytes().decode() for i in range(s.rows)]
        ids_of += [ids[off[i]:off[i + 1]].tolist() for i in range(s.rows)]
    return out, ids_of


def test_round_trip():
    assert _round(TEXTS)[0] == TEXTS


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁aeiou"), st.characters(exclude_categories=["Cs"])), max_size=80), max_size=6))
def test_round_trip_of_any_text(texts):
    assert _round(texts)[0] == texts


def _all_ways(word):
    raw = (" " + word).encode()
    known = {PIECES.raw[i]: i for i in PIECES.id}

    def ways(i):
        if i == len(raw):
            yield (), 0.0
        for j in range(i + 1, len(raw) + 1):
            if raw[i:j] in known:
                k = known[raw[i:j]]
                for rest, log in ways(j):
                    yield (k, *rest), log + PIECES.log[k]
    found = list(ways(0))
    z = np.exp(np.array([x for _, x in found]))
    return {w: p for (w, _), p in zip(found, z / z.sum())}


@pytest.mark.parametrize("limit", [48, 2])
def test_distribution_is_that_of_the_lattice(monkeypatch, limit):
    monkeypatch.setattr(S, "SHORT", limit)
    want, n = _all_ways("tation"), 8000 if limit == 2 else 30000
    got = Counter(map(tuple, _round(["tation"] * n)[1]))
    assert set(got) <= set(want)
    assert sum(abs(want[w] - got[w] / n) for w in want) / 2 < 0.02


def test_rows_are_reproducible_in_any_company():
    text = "The same row gives the same pieces in any batch"
    alone = _round([text], np.array([7], np.uint64))[1][0]
    among = _round([t + " other" for t in TEXTS] + [text], np.append(np.arange(len(TEXTS)), 7).astype(np.uint64))[1][-1]
    assert alone == among
    assert len({tuple(x) for x in _round([text] * 50)[1]}) > 1


def test_defined_results(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(99, None, 1), (None, "no key", 1), (0, TEXTS[0], 0), (50, "long " * 40000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    enc = S.encode(df, PATH, keep=("doc_id", "text"))
    dec = S.decode(enc, PATH)
    out = dec.collect()
    assert len(out) == len(rows) and all(r.decoded == r.text for r in out)
    assert [r.ids for r in out if r.doc_id == 99] == [None] and [r.ids for r in out if r.doc_id == 3] == [[]]
    twice = [r.ids for r in out if r.doc_id == 0]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert sorted(map(repr, S.encode(df.repartition(7), PATH, keep=("doc_id", "text")).collect())) == sorted(map(repr, enc.collect()))
    assert S.decode(S.encode(df.limit(0), PATH, keep=("doc_id",)), PATH).count() == 0


def test_query(spark, table):
    r = Q.QUERIES["op5_sentencepiece"](spark, "/root/testdata/sf0.001")
    assert r.count() == table("documents").count()
    assert r.filter(~F.col("lossless") | (F.size("ids") != F.col("n_pieces"))).count() == 0
