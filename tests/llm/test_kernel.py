import numpy as np
import pyarrow as pa
import pytest

from helpers import TOKEN, words
from talentflow.llm import kernel as K

TEXTS = ["Hello, World 42!", None, "", "é ß日本 x", "a", "ends", "starts", " - ", "tab\tq\x0b\x85z", "x" * 5000]


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_words_of_slices(limit):
    got = []
    for s in K.slices(pa.array(TEXTS), limit):
        low = K.LOWER[s.data]
        w = K.find_words(low, s.offsets, K.WORD_BYTES)
        got += [[low[a:b].tobytes().decode() for a, b, r in zip(w.starts, w.ends, w.row) if r == i] for i in range(s.rows)]
    assert got == [words(t) for t in TEXTS]


def test_tokens():
    s = next(K.slices(pa.array(TEXTS)))
    w = K.find_words(s.data, s.offsets, K.NON_SPACE)
    assert [s.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)] == [x for t in TEXTS for x in TOKEN.findall(t or "")]


def test_hashes_depend_on_bytes_only(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    cuts = np.unique(rng.integers(0, 5000, 900))
    a, b = cuts[:-1], cuts[1:]
    h = K.hash_spans(data, a, b)
    by = {}
    for x, y, z in zip(a, b, h):
        assert by.setdefault(data[x:y].tobytes(), z) == z
    assert len(set(by.values())) == len(by)
    monkeypatch.setattr(K, "_SEGMENT", 64)   # spans longer than a segment, and many segments
    assert (K.hash_spans(data, a, b) == h).all()


def test_sliding_and_ngrams():
    x = np.array([5, 3, 9, 1, 4, 8], np.uint64)
    for w in range(1, 7):
        assert K.sliding(x, w).tolist() == [min(x[i:i + w]) for i in range(len(x) - w + 1)]
    assert len(K.ngram_hashes(x, 7)) == 0
    assert K.ngram_hashes(np.tile(x, 2), 3)[0] == K.ngram_hashes(np.tile(x, 2), 3)[6]
