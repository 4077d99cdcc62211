"""SentencePiece sampling by forward filtering and backward sampling (operator 5).

A text's segmentations form a lattice over its bytes: an edge is a piece of the model (a
white-space mark stands for a blank; one blank is put in front of a text), or, for a
character that is no piece, a byte piece. Weights are ``exp(alpha * score)``; for a model
whose scores are merge ranks the score is ``-log(rank + 1)``. Forward filtering sums the
weights of all ways to each node; backward sampling draws a way from the end, edge by edge,
in proportion. Random numbers come from a hash of (seed, row key, pre-token, step): the same
row gives the same pieces in any batch, partition or retry.

No piece crosses from a non-blank to a blank, so that the lattice falls apart into
pre-tokens. Each distinct pre-token of a slice is filtered once; all occurrences are sampled
in step. Decoding joins the pieces' bytes and is lossless for every text: a literal U+2581
is written in byte pieces.

Scale: one scan, no shuffle; memory is one slice of text and the lattices of its distinct
pre-tokens; the model (the bounded vocabulary) is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentflow.llm import kernel as K
from talentflow.llm.store import map_arrow_frugal

ALPHA, BYTE_SCORE = 0.5, -14.0
SLICE = 1 << 19
SHORT = 48          # longer pre-tokens are filtered one by one, in logarithms
_MARK = "▁"
_U = np.uint64
_PREFIX = 1 << 21


class Pieces:
    """The pieces of a model file: bytes, weights, a look-up by hash."""

    def __init__(self, model_path: str, alpha: float = ALPHA):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        self.raw: list[bytes] = [b""] * size
        self.byte = np.full(256, -1)
        score = np.array([sp.get_score(i) for i in range(size)])
        normal = []
        for i in range(size):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(text[3:5], 16)] = i
                self.raw[i] = bytes([int(text[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.raw[i] = text.replace(_MARK, " ").encode("utf-8")
                normal.append(i)
        if (self.byte < 0).any():
            raise ValueError("the model has no byte pieces: not every text can be encoded")
        ids = np.array(normal)
        ranks = np.allclose(score[ids], np.round(score[ids])) and score[ids].min() < -1000
        log = np.full(size, BYTE_SCORE)
        log[ids] = -np.log1p(-score[ids] + 1) if ranks else score[ids]
        self.log = alpha * log
        blob = np.frombuffer(b"".join(self.raw[i] for i in ids), np.uint8)
        ends = np.cumsum([len(self.raw[i]) for i in ids])
        h = K.hash_spans(blob, np.concatenate(([0], ends[:-1])), ends)
        order = np.argsort(h)
        self.hash, self.id = h[order], ids[order]
        self.near = np.zeros(1 << 20, bool)
        self.near[(h & _U((1 << 20) - 1)).astype(np.int64)] = True
        self.lengths = np.array(sorted({len(self.raw[i]) for i in ids}))
        size, first = np.array([len(self.raw[i]) for i in ids]), np.concatenate(([0], ends[:-1]))
        self.starts = np.zeros(_PREFIX, bool)                   # marks the hashes of all beginnings of pieces
        pw, _ = K._powers()
        sums = np.zeros(len(ids), _U)
        for n in range(1, int(size.max()) + 1):
            go = size >= n
            size, first, sums = size[go], first[go], sums[go]
            sums += K._BYTE[blob[first + n - 1]] * pw[n - 1]
            self.starts[(_finish(sums, n) & _U(_PREFIX - 1)).astype(np.int64)] = True
        used = np.zeros(256, bool)
        used[blob] = True
        self.alone = ~used & (np.arange(256) < 128)             # ASCII bytes in no piece: always cut there
        self.cuts = all(b" " not in self.raw[i].lstrip(b" ") for i in ids)
        self.size = np.array([len(x) for x in self.raw])
        self.first = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        out = np.full(len(h), -1)
        some = np.flatnonzero(self.near[(h & _U((1 << 20) - 1)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.hash, h[some]), len(self.hash) - 1)
        same = self.hash[i] == h[some]
        out[some[same]] = self.id[i[same]]
        return out

    def edges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """All lattice edges ``(from, to, piece)`` of the (disjoint) spans of ``data``."""
        size = ends - starts
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        stop = np.repeat(ends, size)
        head = np.ones(len(data) + 1, bool)
        head[:-1] = (data & 0xC0) != 0x80
        head[ends] = True
        here = np.flatnonzero(head[at])
        s, stop_h = at[here].astype(np.int32), stop[here].astype(np.int32)
        pw, _ = K._powers()
        sums, a, b, p = np.zeros(len(s), _U), [], [], []
        for n in range(1, int(self.lengths[-1]) + 1):
            go = s + n <= stop_h
            s, stop_h, sums = s[go], stop_h[go], sums[go]
            if not len(s):
                break
            sums += K._BYTE[data[s + (n - 1)]] * pw[n - 1]
            h = _finish(sums, n)
            go = self.starts[(h & _U(_PREFIX - 1)).astype(np.int32)]      # places where some piece goes on
            s, stop_h, sums, h = s[go], stop_h[go], sums[go], h[go]
            whole = np.flatnonzero(head[s + n])
            got = self.find(h[whole])
            hit = got >= 0
            a.append(s[whole[hit]])
            b.append(a[-1] + np.int32(n))
            p.append(got[hit].astype(np.int32))
        # characters that are no piece of their own go byte by byte
        char_end = np.append(np.flatnonzero(head[at])[1:], len(at))
        width = char_end - here
        single = np.zeros(len(data) + 1, bool)
        if a:
            sa, sb = np.concatenate(a), np.concatenate(b)
            first = np.zeros(len(data) + 1, np.int64)
            first[at[here]] = width
            single[sa[first[sa] == sb - sa]] = True
        bare = np.repeat(~single[at[here]], width)
        x = at[bare]
        a.append(x.astype(np.int32))
        b.append((x + 1).astype(np.int32))
        p.append(self.byte[data[x]].astype(np.int32))
        return np.concatenate(a), np.concatenate(b), np.concatenate(p)


def _finish(sums: np.ndarray, n: int) -> np.ndarray:
    """The hash of spans of length ``n`` (as ``kernel.hash_spans``) from their weighted sums."""
    return K.mix(sums + _U(n * 0xA24BAED4963EE407 & K.MASK64))


def _uniform(seed: np.ndarray, word: np.ndarray, step: int) -> np.ndarray:
    x = K.mix(seed + word.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(step * 0xD1342543DE82EF95 & K.MASK64))
    return (x >> _U(11)).astype(np.float64) * 2.0 ** -53


def _lattice(pieces: Pieces, data, starts, ends):
    """Forward filtering of short spans. Nodes are byte places in ``data`` (a span's end is
    told from the next span's start by an extra place per span). Returns the node of each
    span's start and end, and edges sorted by the node they lead to, with cumulated
    probabilities."""
    size = ends - starts
    base = np.concatenate(([0], np.cumsum(size + 1)[:-1]))      # first node of each span
    a, b, p = pieces.edges(data, starts, ends)
    of = np.zeros(len(data), np.int32)                          # span of each place
    of[np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())] = np.repeat(
        np.arange(len(starts), dtype=np.int32), size)
    span = of[a]
    shift = base[span] - starts[span]
    order = np.argsort((b + shift).astype(np.int32), kind="stable")
    frm, to, p = (a + shift)[order].astype(np.int32), (b + shift)[order].astype(np.int32), p[order]
    level = (b - starts[span])[order].astype(np.int16)
    weight = np.exp(pieces.log)[p]
    mass = np.zeros(int(base[-1] + size[-1] + 1))
    mass[base] = 1.0
    by = np.argsort(level, kind="stable")
    cut = np.searchsorted(level[by], np.arange(1, int(size.max()) + 2))
    flow = np.zeros(len(p))
    for i in range(len(cut) - 1):
        e = by[cut[i]:cut[i + 1]]
        if len(e):
            flow[e] = mass[frm[e]] * weight[e]
            np.add.at(mass, to[e], flow[e])
    run = np.cumsum(flow / mass[to])
    new = np.concatenate(([True], to[1:] != to[:-1]))
    before = np.repeat((run - flow / mass[to])[new], np.diff(np.append(np.flatnonzero(new), len(to))))
    last = np.append(np.flatnonzero(new)[1:], len(to)) - 1
    cum = np.minimum(run - before, 1.0)
    cum[last] = 1.0
    return base, base + size, frm, to, p, cum


def _long(pieces: Pieces, data: np.ndarray, seed, word: int) -> np.ndarray:
    """Pieces of one long span, filtered in logarithms."""
    n = len(data)
    a, b, p = pieces.edges(data, np.array([0]), np.array([n]))
    order = np.lexsort((p, a, b))
    a, b, p = a[order], b[order], p[order]
    edge = np.searchsorted(b, np.arange(n + 2))
    total = np.full(n + 1, -np.inf)
    total[0] = 0.0
    log = pieces.log[p]
    for j in range(1, n + 1):
        s = slice(edge[j], edge[j + 1])
        if edge[j] < edge[j + 1]:
            v = total[a[s]] + log[s]
            m = v.max()
            if m > -np.inf:
                total[j] = m + np.log(np.exp(v - m).sum())
    out, j, step = [], n, 0
    seed, word = np.array([seed], _U), np.array([word])
    while j:
        s = slice(edge[j], edge[j + 1])
        c = np.cumsum(np.exp(total[a[s]] + log[s] - total[j]))
        u = float(_uniform(seed, word, step)[0]) * c[-1]
        k = edge[j] + min(int(np.searchsorted(c, u, side="right")), len(c) - 1)
        out.append(p[k])
        j, step = int(a[k]), step + 1
    return np.array(out[::-1])


def sample(pieces: Pieces, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray):
    """Sampled piece ids of all rows of a slice, and the offsets of each row in them."""
    rows = len(offsets) - 1
    full = np.flatnonzero(np.diff(offsets) > 0)
    text = np.insert(data, offsets[full], 32)
    off = offsets + np.concatenate(([0], np.cumsum(np.diff(offsets) > 0)))
    if not len(text):
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
    cut = np.zeros(len(text), bool)
    cut[off[full]] = True
    if pieces.cuts:
        blank = text == 32
        cut[1:] |= blank[1:] & ~blank[:-1]
    alone = pieces.alone[text]
    cut |= alone
    cut[1:] |= alone[:-1]
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(text))
    row = np.searchsorted(off[1:], starts, side="right")
    word = np.arange(len(starts)) - np.searchsorted(row, row)
    long = ends - starts > SHORT
    short = np.flatnonzero(~long)
    seq_occ, seq_piece, seq_step = [], [], []
    if len(short):
        h = K.hash_spans(text, starts[short], ends[short])
        _, at, back = np.unique(h, return_index=True, return_inverse=True)
        order = np.argsort(at)                                  # spans in order of place
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        at, back = short[at[order]], rank[back]
        first, last, frm, to, p, cum = _lattice(pieces, text, starts[at], ends[at])
        key = to + cum
        del cum
        place = np.argsort(back.astype(np.int32), kind="stable")   # equal pre-tokens side by side
        occ, back = short[place], back[place]
        node, goal = last[back], first[back]
        seed, step = seeds[row[occ]], 0
        begin = np.searchsorted(to, np.arange(int(last[-1]) + 2))
        while len(occ):
            e = np.searchsorted(key, node + _uniform(seed, word[occ], step), side="right")
            e = np.minimum(np.maximum(e, begin[node]), begin[node + 1] - 1)
            seq_occ.append(occ.astype(np.int32))
            seq_piece.append(p[e].astype(np.int32))
            seq_step.append(np.full(len(occ), step, np.int32))
            node = frm[e]
            go = node != goal
            occ, node, goal, seed = occ[go], node[go], goal[go], seed[go]
            step += 1
    for o in np.flatnonzero(long):
        got = _long(pieces, text[starts[o]:ends[o]], seeds[row[o]], int(word[o]))
        seq_occ.append(np.full(len(got), o))
        seq_piece.append(got)
        seq_step.append(np.arange(len(got))[::-1])
    occ, piece, step = (np.concatenate(x) for x in (seq_occ, seq_piece, seq_step))
    many = np.bincount(occ, minlength=len(starts))
    stop = np.cumsum(many)
    ids = np.empty(len(occ), np.int32)
    ids[stop[occ] - 1 - step] = piece
    per_row = np.bincount(row, many, rows).astype(np.int64)
    return ids, np.concatenate(([0], np.cumsum(per_row)))


def join_pieces(pieces: Pieces, ids: np.ndarray, offsets: np.ndarray):
    """Bytes of decoded rows and their offsets (the blank in front of a text taken off)."""
    size = pieces.size[ids]
    to = np.concatenate(([0], np.cumsum(size)))
    src = np.repeat(pieces.first[ids] - to[:-1], size) + np.arange(to[-1])
    data = pieces.bytes[src]
    off = to[offsets]
    full = np.diff(off) > 0
    return np.delete(data, off[:-1][full]), off - np.concatenate(([0], np.cumsum(full)))


def encode(docs: DataFrame, model_path: str, key_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA,
           seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``ids array<int>``: a sampled segmentation of every whole text.

    A null text has null ids, an empty one none; repeated rows (equal keys) get equal ids.
    The model file is read on the driver."""
    held = docs.sparkSession.sparkContext.broadcast(Pieces(model_path, alpha))
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        pieces = held.value
        for b in batches:
            keys, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            for s in K.slices(texts, SLICE):
                ids, off = sample(pieces, s.data, s.offsets, K.mix(keys[s.lo:s.hi].astype(np.int64).view(_U)))
                null = texts.slice(s.lo, s.rows).is_null()
                out = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()),
                                               mask=null if null.true_count else None)
                yield pa.RecordBatch.from_arrays([b.column(2 + i).slice(s.lo, s.rows) for i in range(len(names))] + [out],
                                                 names=[*names, "ids"])

    rows = docs.select(F.xxhash64(F.col(key_col), F.lit(seed)), F.col(text_col).cast("string"),
                       *[F.col(c).alias(n) for c, n in zip(keep, names)])
    kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(keep, names))
    return map_arrow_frugal(rows, run, kinds + "ids array<int>").withColumnsRenamed(dict(zip(names, keep)))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text that the ids stand for; null ids give null, no ids an empty text."""
    held = rows.sparkSession.sparkContext.broadcast(Pieces(model_path))
    names = [f"k{i}" for i in range(len(rows.columns))]
    at = rows.columns.index(ids_col)

    def run(batches):
        pieces = held.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                col = part.column(at)
                counts = np.diff(np.asarray(col.offsets))
                data, off = join_pieces(pieces, np.asarray(col.flatten()), np.concatenate(([0], np.cumsum(
                    np.where(np.asarray(col.is_valid()), counts, 0)))))
                text = pa.LargeStringArray.from_buffers(len(col), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data.tobytes()))
                import pyarrow.compute as pc
                text = pc.if_else(col.is_valid(), text, pa.scalar(None, pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*names, "decoded"])

    kinds = "".join(f"{n} {rows.schema[c].dataType.simpleString()}, " for c, n in zip(rows.columns, names))
    return (map_arrow_frugal(rows.toDF(*names), run, kinds + "decoded string")
            .withColumnsRenamed(dict(zip([*names, "decoded"], [*rows.columns, out_col]))))
