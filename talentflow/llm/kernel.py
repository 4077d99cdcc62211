"""Vectorised word scanning over Arrow string columns, for use inside ``mapInArrow``.

Texts are UTF-8 bytes; a slice of rows (bounded in bytes, one row at least) is
handled at a time, so that memory follows the slice and the longest text, not the
Arrow batch. Hashes are 64-bit polynomial hashes of a random byte table; they find
candidates and group equal words inside a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: bytes of text, and of powers, that a processor's cache holds together with the arrays made of them
SLICE_BYTES = 1 << 18
_SEGMENT = 1 << 16
_U = np.uint64
MASK64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for base in (_P, _P_INV):
            p = np.full(_SEGMENT, base, dtype=_U)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
#: bytes of words [^\x20\x09-\x0D]+
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False


@dataclass
class Slice:
    """Rows ``lo:hi`` of a batch: their bytes and the offsets of each row in them."""
    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo


@dataclass
class Words:
    """Byte spans of words and the row (in the slice) each lies in; rows in order."""
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into runs of rows of at most ``max_bytes`` (or one row).
    A null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    off = raw[column.offset:column.offset + len(column) + 1].astype(np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield Slice(lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        lo = hi


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Maximal runs of bytes marked in ``table``, never across two rows."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, z)
    inside = table[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return Words(starts, ends, row)


def _hash_long(data: np.ndarray, lo: int, hi: int) -> int:
    pw, _ = _powers()
    total, base = 0, 1
    for a in range(lo, hi, _SEGMENT):
        b = min(hi, a + _SEGMENT)
        part = int((_BYTE[data[a:b]] * pw[:b - a]).sum(dtype=_U))
        total = (total + part * base) & MASK64
        base = base * pow(_P, b - a, 1 << 64) & MASK64
    return total


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (ordered, disjoint) byte span; equal bytes, equal hash."""
    out = np.empty(len(starts), dtype=_U)
    pw, inv = _powers()
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + _SEGMENT - 1, side="right"))
        if j <= i:
            out[i] = _hash_long(data, lo, int(ends[i]))
            i += 1
            continue
        hi = int(ends[j - 1])
        run = np.zeros(hi - lo + 1, dtype=_U)
        np.cumsum(_BYTE[data[lo:hi]] * pw[:hi - lo], out=run[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (run[e] - run[s]) * inv[s]
        i = j
    return mix(out + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes (length ``len(words) - k + 1``)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    h = np.zeros(n, dtype=_U)
    for j in range(k):
        h = h * _U(0xD6E8FEB86659FD93) + words[j:j + n]
    return mix(h + _U(k))


def sliding(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """``op`` over each run of ``w`` values (length ``len(x) - w + 1``)."""
    have, y = 1, x
    while have < w:
        step = min(have, w - have)
        y = op(y[:-step], y[step:]) if len(y) > step else y[:0]
        have += step
    return y


def rows_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
