"""Language identification with a byte convolutional network (operator 3).

Bytes are embedded, filters of widths 2, 3 and 4 slide over them, each filter keeps its
largest response in a window, and a softmax layer names the language. The network is
trained in numpy on a bounded sample of labelled text and applied to fixed-length windows
that cover the whole text; a text's language is the one with the largest mean
log-probability over its windows, weighted by the letters in them.

Scale: one scan, no shuffle; the model is a few KB; memory is one slice of text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentflow.llm import kernel as K
from talentflow.llm.store import map_arrow

WINDOW = 256
EMBED, WIDTHS, FILTERS = 5, (2, 3, 4), 12
PAD = 256
MAX_PER_LANG, VIEWS, EPOCHS, RATE, BATCH = 2_000, 2, 3, 0.01, 64
UNKNOWN = "und"
SLICE = 1 << 18
_LETTERS = np.zeros(257, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[0xC0:256] = True


class ByteCNN:
    """Weights of the network; ``langs`` are the classes in order."""

    def __init__(self, langs: list[str], seed: int = 0):
        r = np.random.default_rng(seed)
        self.langs = langs
        wide, out = max(WIDTHS) * EMBED, len(WIDTHS) * FILTERS
        self.mask = np.zeros((wide, out), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[:w * EMBED, i * FILTERS:(i + 1) * FILTERS] = 1
        self.emb = r.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.emb[PAD] = 0
        self.conv = (r.normal(0, 0.4, (wide, out)) * self.mask).astype(np.float32)
        self.cbias = np.zeros(out, np.float32)
        self.dense = r.normal(0, 0.2, (out, len(langs))).astype(np.float32)
        self.dbias = np.zeros(len(langs), np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        n, length = x.shape
        wide = max(WIDTHS)
        padded = np.full((n, length + wide - 1), PAD, np.uint16)
        padded[:, :length] = x
        e = self.emb[padded]
        return np.concatenate([e[:, j:j + length] for j in range(wide)], axis=2).reshape(n * length, -1), padded

    def forward(self, x: np.ndarray):
        cols, padded = self._columns(x)
        act = (cols @ self.conv).reshape(len(x), x.shape[1], -1)
        top = act.max(axis=1) + self.cbias
        z = np.maximum(top, 0) @ self.dense + self.dbias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True)), (cols, padded, act, top)

    def step(self, x, y, state, t, rate):
        """One Adam step on a batch."""
        logp, (cols, padded, act, top) = self.forward(x)
        n, length = x.shape
        g = np.exp(logp)
        g[np.arange(n), y] -= 1
        g /= n
        grads = {"dense": np.maximum(top, 0).T @ g, "dbias": g.sum(0)}
        gt = (g @ self.dense.T) * (top > 0)
        grads["cbias"] = gt.sum(0)
        at = act.argmax(axis=1) + np.arange(n)[:, None] * length          # winning position per filter
        won = cols[at]                                                     # n x filters x wide
        grads["conv"] = np.einsum("nf,nfw->wf", gt, won, optimize=True) * self.mask
        back = gt[:, :, None] * self.conv.T[None]                          # n x filters x wide
        ge = np.zeros_like(self.emb)
        row, pos = at // length, at % length
        for j in range(max(WIDTHS)):
            np.add.at(ge, padded[row, pos + j].ravel(), back[:, :, j * EMBED:(j + 1) * EMBED].reshape(-1, EMBED))
        ge[PAD] = 0
        grads["emb"] = ge
        for k, gr in grads.items():
            m, v = state.setdefault(k, [np.zeros_like(gr), np.zeros_like(gr)])
            m += 0.1 * (gr - m)
            v += 0.001 * (gr * gr - v)
            step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
            setattr(self, k, (getattr(self, k) - step).astype(np.float32))

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 0) -> "ByteCNN":
        r, state, t = np.random.default_rng(seed), {}, 0
        total = EPOCHS * (-(-len(x) // BATCH))
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for i in range(0, len(x), BATCH):
                t += 1
                self.step(x[order[i:i + BATCH]], y[order[i:i + BATCH]], state, t, RATE * (1 - 0.9 * t / total))
        return self


def _windows(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the rows (the last of a row padded) and the row of each."""
    size = np.diff(offsets)
    per = -(-size // window)
    row = np.repeat(np.arange(len(size)), per)
    first = np.repeat(np.concatenate(([0], np.cumsum(per)[:-1])), per)
    begin = offsets[:-1][row] + (np.arange(len(row)) - first) * window
    at = begin[:, None] + np.arange(window)
    inside = at < offsets[1:][row][:, None]
    if not len(data):
        return np.zeros((0, window), np.uint16), row
    x = data[np.minimum(at, len(data) - 1)].astype(np.uint16)
    x[~inside] = PAD
    return x, row


def _has_letter(s: K.Slice) -> np.ndarray:
    """Rows with a letter of any script."""
    ascii_letter = ((s.data >= 65) & (s.data <= 90)) | ((s.data >= 97) & (s.data <= 122))
    run = np.concatenate(([0], np.cumsum(ascii_letter)))
    has = run[s.offsets[1:]] > run[s.offsets[:-1]]
    for i in np.flatnonzero(~has):
        part = s.data[s.offsets[i]:s.offsets[i + 1]]
        if len(part) and part.max() >= 128:
            has[i] = any(c.isalpha() for c in part.tobytes().decode("utf-8"))
    return has


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        max_per_lang: int = MAX_PER_LANG, seed: int = 0) -> ByteCNN | None:
    """Train on at most ``max_per_lang`` documents of each language (picked by a hash of the
    row), ``VIEWS`` windows of each at hashed positions. Rows without text or language are
    not used; without any usable row there is no model (``None``)."""
    known = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counts = {r[0]: r[1] for r in known.groupBy(F.col(lang_col)).count().collect()}  # one row per language
    if not counts:
        return None
    million = 1_000_000
    share = F.coalesce(*[F.when(F.col(lang_col) == k, F.lit(min(million, int(million * max_per_lang / n) + 1)))
                         for k, n in sorted(counts.items())])
    h = F.xxhash64(F.col(id_col), F.length(text_col), F.lit(seed))
    room = F.greatest(F.length(text_col) - WINDOW, F.lit(0)) + 1
    views = [F.substring(F.col(text_col), (F.pmod(F.xxhash64(h, F.lit(v)), room) + 1).cast("int"), F.lit(WINDOW)).alias(f"v{v}")
             for v in range(VIEWS)]
    rows = (known.filter(F.pmod(h, F.lit(million)) < share).select(F.col(lang_col).alias("lang"), *views)
            .limit(2 * max_per_lang * len(counts)).toPandas())
    rows = rows.sort_values(list(rows.columns))
    langs = sorted(counts)
    x, y = [], []
    for v in range(VIEWS):
        for text, lang in zip(rows[f"v{v}"], rows["lang"]):
            raw = K.LOWER[np.frombuffer(text.encode("utf-8"), np.uint8)[:WINDOW]]
            line = np.full(WINDOW, PAD, np.uint16)
            line[:len(raw)] = raw
            x.append(line)
            y.append(langs.index(lang))
    return ByteCNN(langs, seed).train(np.stack(x), np.asarray(y), seed)


def predict(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text",
            keep: tuple[str, ...] = (), lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` (columns ``keep``, or else ``id_col``) with ``lang_out`` and ``score_out``, which
    must be none of the kept columns.

    ``und`` with score 0 for a null text, a text without any letter, or without a model.
    Every window of a text counts; repeated rows are judged each."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = list(keep) or [id_col]
    if {lang_out.lower(), score_out.lower()} & {c.lower() for c in kept}:
        raise ValueError(f"{lang_out} or {score_out} is a kept column already: name others")
    at = kept.index(text_col) if text_col in kept else len(kept)

    def run(batches):
        net = held.value
        for b in batches:
            for s in K.slices(b.column(at), SLICE):
                lang, score = [UNKNOWN] * s.rows, np.zeros(s.rows)
                if net is not None and len(s.data):
                    x, row = _windows(K.LOWER[s.data], s.offsets, WINDOW)
                    total = np.zeros((s.rows, len(net.langs)))
                    weight = np.zeros(s.rows)
                    for i in range(0, len(x), 256):
                        logp, _ = net.forward(x[i:i + 256])
                        w = _LETTERS[x[i:i + 256]].sum(axis=1) + 1e-3
                        np.add.at(total, row[i:i + 256], logp * w[:, None])
                        np.add.at(weight, row[i:i + 256], w)
                    mean = total / np.maximum(weight, 1e-9)[:, None]
                    p = np.exp(mean - mean.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1)
                    for i in np.flatnonzero(_has_letter(s)):
                        lang[i], score[i] = net.langs[best[i]], p[i, best[i]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(j).slice(s.lo, s.rows) for j in range(len(kept))] +
                    [pa.array(lang, pa.string()), pa.array(score)], names=[*kept, lang_out, score_out])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    rows = docs.select(*kept, *([F.col(text_col).alias("__text")] if at == len(kept) else []))
    return map_arrow(rows, run, f"{fields}, `{lang_out}` string, `{score_out}` double")
