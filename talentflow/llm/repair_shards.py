"""Token ids in Re-Pair compressed shards (operator 12).

Documents are brought into ascending id order by a range partitioning, encoded with a
byte-level BPE file of the ``tokenizers`` library, and written shard by shard. Re-Pair
replaces frequent pairs of adjacent ids by new symbols, again and again: each round counts
all pairs, takes the frequent ones as rules and replaces their occurrences (where two
overlap, the more frequent pair wins), until no pair is frequent or a round gains little.
Pairs never reach across documents, so that each document can be read alone.

File format: a Parquet table, one row a shard. ``part, shard`` number the shards in document
order; ``docs`` are the document ids; ``n_symbols`` and ``n_tokens`` count each document's
symbols and ids; ``tokens`` is the shard's number of ids; ``base`` is the first rule symbol.
``rules`` holds two symbols a rule, ``lengths`` each rule's expansion length (unsigned 32-bit),
``symbols`` the documents' symbols one after another; symbols are little-endian unsigned
integers of ``width`` bytes. The expansion lengths lead to any id without decoding those
before it (``token_range``).

Encoding: a text is cut before each ASCII white space that follows a character which is not
white space, and before each ASCII mark that follows an ASCII letter or digit. The
pre-tokenizer never builds a pre-token across such a place, so that these units are encoded
alone, each distinct one once (a memo of at most ``MEMO`` units stays with the worker).

Scale: the texts are shuffled once; memory is one shard (``SHARD`` ids, or one document) and
one slice of text. Shard offsets are prefix sums within each part and over the parts.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentflow.llm import kernel as K
from talentflow.llm.store import map_arrow, new_path

SHARD = 1 << 21
SLICE = 4 << 20
MEMO = 3 << 20
MIN_COUNT = 24      # occurrences in a shard that make a pair frequent
PER_ROUND = 4096    # rules a round adds at most
MIN_GAIN = 1 / 16   # share of the symbols that a round must save for another one
_SLOTS = 16
_SPACE = ~K.NON_SPACE
_ALNUM = K.WORD_BYTES & (np.arange(256) < 128)
_ALNUM[65:91] = True
_ENCODERS: dict[tuple, "UnitEncoder"] = {}


def unit_starts(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where units begin: at each text's start, at each ASCII white space after a character
    that is surely not white space, and at each of ``marks`` after an ASCII letter or digit."""
    gap = _SPACE[data]
    gap[1:] &= data[:-1] > 32
    gap[:1] = False
    at = np.flatnonzero(gap & np.concatenate((np.zeros(1, bool), data[:-1] >= 128)) if len(data) else gap)
    # U+0085, U+00A0 and those of the blocks U+1680, U+180E, U+20xx, U+30xx that hold white space
    two, three = data[np.maximum(at - 2, 0)].astype(np.int32), data[np.maximum(at - 3, 0)].astype(np.int32)
    wide = (three << 8) | two
    blank = (two == 0xC2) | np.isin(wide, (0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380))
    gap[at[blank]] = False
    gap[1:] |= marks[data[1:]] & _ALNUM[data[:-1]]
    gap[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(gap)


class UnitEncoder:
    """Ids of texts by way of their units; distinct units are encoded once."""

    def __init__(self, spec: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.base = self.tok.get_vocab_size(with_added_tokens=True)
        # ASCII marks that end a pre-token of letters or digits and are in no special string
        special = {ord(c) for t in self.tok.get_added_tokens_decoder().values() for c in t.content if ord(c) < 128}
        self.marks = np.array([33 <= c < 127 and not _ALNUM[c] and c not in special for c in range(256)])
        self.memo = memo
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known units
        self.at = np.zeros(0, np.int32)     # where in the pool their ids begin
        self.n = np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        ids = [e.ids for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(n.sum())
        if self.used + total > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), self.used + total), np.uint32)
            grown[:self.used] = self.pool[:self.used]
            self.pool = grown
        self.pool[self.used:self.used + total] = np.fromiter((i for e in ids for i in e), np.uint32, total)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, (self.used + np.cumsum(n) - n).astype(np.int32))
        self.n = np.insert(self.n, place, n.astype(np.int32))
        self.used += total

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all texts, ids of each text)``; each text ends with ``end_id``."""
        starts = unit_starts(data, offsets, self.marks)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        keys, one, back = np.unique(K.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.memo or self.used > 1 << 30:
            self._clear()
        where = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[where] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            blob = data.tobytes()
            self._learn(keys[new], [blob[starts[j]:ends[j]].decode("utf-8", "replace") for j in one[new]])
            where = np.searchsorted(self.keys, keys)
        n = self.n[where][back].astype(np.int64)
        row = np.searchsorted(offsets[1:], starts, side="right")
        count = np.bincount(row, weights=n, minlength=len(offsets) - 1).astype(np.int64) + 1
        out = np.full(int(count.sum()), end_id, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(count) - 1] = False
        out[inner] = self.pool[ranges(self.at[where][back], n)]
        return out, count


def encoder(spec: str, memo: int = MEMO) -> UnitEncoder:
    """The worker's encoder, with what it learnt in earlier tasks."""
    key = (hash(spec), memo)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = UnitEncoder(spec, memo)
    return _ENCODERS[key]


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``lo[i], lo[i] + 1, ...`` (``n[i]`` of them) for each i."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Grammar:
    """Rules of a shard: symbol ``base + i`` stands for the pair ``rules[i]``."""

    def __init__(self, base: int, rules: np.ndarray, lengths: np.ndarray):
        self.base, self.rules, self.lengths = base, rules, lengths.astype(np.int64)
        flat = np.arange(base, base + len(rules))
        while True:
            big = flat >= base
            if not big.any():
                break
            pair = rules[flat[big] - base]
            flat = np.repeat(flat, 1 + big)
            first = np.flatnonzero(big) + np.arange(len(pair))
            flat[first], flat[first + 1] = pair[:, 0], pair[:, 1]
        #: the ids of all terminals, then of all rules
        self.pool = np.concatenate((np.arange(base), flat)).astype(np.uint32)
        self.size = np.concatenate((np.ones(base, np.int64), self.lengths))
        self.at = np.cumsum(self.size) - self.size

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.pool[ranges(self.at[symbols], self.size[symbols])]


def _frequent(key: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The (at most ``most``) most frequent keys with ``least`` occurrences, rising."""
    key = np.sort(key)
    edge = np.flatnonzero(np.concatenate((np.ones(1, bool), key[1:] != key[:-1], np.ones(1, bool))))
    count = np.diff(edge)
    held = np.flatnonzero(count >= least)
    order = held[np.argsort(count[held], kind="stable")][-most:]
    return key[edge[:-1][order]], count[order]


def compress(ids: np.ndarray, counts: np.ndarray, base: int, room: int, least: int = MIN_COUNT):
    """Re-Pair: ``(symbols, symbols of each document, rules, expansion lengths)``.

    ``room`` bounds the rules. A pair met fewer than ``least`` times is left as it is."""
    sym = ids.astype(np.uint32)
    last = np.zeros(len(sym), bool)
    last[np.cumsum(counts) - 1] = True
    bits = np.uint64((base + room - 1).bit_length())
    wide = np.uint32 if base + room <= 1 << 16 else np.uint64
    bits = wide(16 if wide is np.uint32 else bits)
    rules, lengths = np.zeros((0, 2), np.uint32), np.ones(base, np.int64)
    while len(rules) < room and len(sym) > 1:
        key = (sym[:-1].astype(wide) << bits) | sym[1:]
        pairs, _ = _frequent(key[~last[:-1]], least, min(PER_ROUND, room - len(rules)))
        if not len(pairs):
            break
        # a table of the frequent pairs: the more frequent one keeps a slot that two want
        slot = _slot(pairs)
        held = np.zeros(1 << _SLOTS, wide)
        rank = np.zeros(1 << _SLOTS, np.uint16)
        held[slot], rank[slot] = pairs, np.arange(1, len(pairs) + 1)
        slot = _slot(key)
        at = np.flatnonzero((held[slot] == key) & ~last[:-1])
        at = at[rank[slot[at]] > 0]  # an empty slot looks like the pair of two zeros
        prio = rank[slot[at]]
        # a place wins over its neighbours by rank; within a run of one pair every second does
        beside = at[1:] == at[:-1] + 1
        win = np.ones(len(at), bool)
        win[1:] &= ~(beside & (prio[:-1] > prio[1:]))
        win[:-1] &= ~(beside & (prio[1:] > prio[:-1]))
        same = np.flatnonzero(beside & (prio[1:] == prio[:-1])) + 1
        if len(same):
            head = np.concatenate((np.ones(1, bool), same[1:] != same[:-1] + 1))
            inside = np.arange(len(same)) - np.maximum.accumulate(np.where(head, np.arange(len(same)), 0))
            win[same[inside % 2 == 0]] = False
        at, prio = at[win], prio[win]
        kept = np.bincount(prio, minlength=len(pairs) + 1) >= max(least // 2, 2)
        at, prio = at[kept[prio]], prio[kept[prio]]
        if not len(at):
            break
        number = np.cumsum(kept) - 1 + base + len(rules)
        chosen = pairs[np.flatnonzero(kept[1:])]
        left, right = (chosen >> bits).astype(np.uint32), (chosen & wide((1 << int(bits)) - 1)).astype(np.uint32)
        rules = np.concatenate((rules, np.stack((left, right), axis=1)))
        lengths = np.concatenate((lengths, lengths[left] + lengths[right]))
        sym[at] = number[prio]
        last[at] = last[at + 1]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        before = len(sym)
        sym, last = sym[stay], last[stay]
        if before - len(sym) < before * MIN_GAIN:
            break
    ends = np.flatnonzero(last) + 1
    return sym, np.diff(ends, prepend=0), rules, lengths[base:]


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key * key.dtype.type(0x9E3779B1)) >> key.dtype.type(32 - _SLOTS)) & key.dtype.type((1 << _SLOTS) - 1)


def _width(base: int) -> tuple[int, int]:
    """Bytes of a symbol and the room for rules: 2 bytes if they leave room."""
    return (2, (1 << 16) - base) if base <= 60_000 else (4, 1 << 16)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
          shard: int = SHARD) -> None:
    """Write the ids of all documents to ``path`` in ascending id order.

    Null and empty texts are written as the end id alone; a null id comes first; rows of one
    id stay rows of their own, in the order of the input. Other columns are not read. An empty
    table gives no shards. The tokenizer file is read on the driver and sent to the tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(spec.value)
        width, room = _width(enc.base)
        ids, counts, names, part, number = [], [], [], 0, 0

        def flush():
            symbols, per, rules, lengths = compress(np.concatenate(ids), np.concatenate(counts), enc.base, room)
            kind = np.dtype(f"<u{width}")
            n = np.concatenate(counts)
            cells = [part, number, int(n.sum()), enc.base, width, lengths.astype("<u4").tobytes(),
                     rules.astype(kind).tobytes(), symbols.astype(kind).tobytes()]
            flat = [pa.array([c], t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(),
                                                             pa.binary(), pa.binary(), pa.binary()))]
            lists = [_one(pa.concat_arrays(names)), _one(pa.array(per, pa.int64())), _one(pa.array(n))]
            return pa.RecordBatch.from_arrays(flat + lists, names=_FIELDS)

        for b in batches:
            for s in K.slices(b.column(2), SLICE):
                out, n = enc.encode(s.data, s.offsets, end_id)
                part = b.column(0)[s.lo].as_py()
                ids.append(out)
                counts.append(n)
                names.append(b.column(1).slice(s.lo, s.rows))
                if sum(map(len, ids)) >= shard:
                    yield flush()
                    ids, counts, names, number = [], [], [], number + 1
        if counts:
            yield flush()

    order = [F.col("doc").asc_nulls_first(), F.col("row")]
    rows = (docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
            .repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc", "text"))
    map_arrow(rows, run, "part int, shard int, tokens long, base int, width int, lengths binary, rules binary, symbols binary, "
                         f"docs array<{kind}>, n_symbols array<bigint>, n_tokens array<bigint>").write.parquet(path)


_FIELDS = ["part", "shard", "tokens", "base", "width", "lengths", "rules", "symbols", "docs", "n_symbols", "n_tokens"]


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, shard, tokens, start``: the ids before each shard. Only the counts are read."""
    shards = spark.read.parquet(path).select("part", "shard", "tokens")
    # one row a part of the file; within a part, one row a shard
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("tokens")
    return shards.withColumn("within", within).join(before, "part").select(
        "part", "shard", "tokens", (F.col("before") + F.col("within")).alias("start"))


def _open(row: dict) -> tuple[Grammar, np.ndarray]:
    kind = np.dtype(f"<u{row['width']}")
    rules = np.frombuffer(row["rules"], kind).reshape(-1, 2).astype(np.int64)
    return Grammar(row["base"], rules, np.frombuffer(row["lengths"], "<u4")), np.frombuffer(row["symbols"], kind)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Every document of the file: ``doc, start, n_tokens, ids_crc32`` and, if asked for, its
    ``ids``. ``ids_crc32`` is taken over the ids as little-endian unsigned 32-bit integers."""
    shards = spark.read.parquet(path).select(*_FIELDS)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {f: b.column(f)[i].as_py() for f in _FIELDS[:8]}
                grammar, symbols = _open(row)
                docs, n_symbols, n = (b.column(f).slice(i, 1).flatten() for f in _FIELDS[8:])
                flat = grammar.expand(symbols).astype("<u4")
                to = np.cumsum(n.to_numpy())
                at = to - n.to_numpy()
                view = memoryview(flat)
                crc = np.fromiter((zlib.crc32(view[a:z]) for a, z in zip(at, to)), np.int64, len(at))
                cells = [pa.array(np.full(len(at), row["part"]), pa.int32()), pa.array(np.full(len(at), row["shard"]), pa.int32()),
                         docs, pa.array(at), n, pa.array(crc)]
                if ids:
                    cells.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)), pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cells, names=names)

    names = ["part", "shard", "doc", "at", "n_tokens", "ids_crc32"] + ["ids"] * ids
    kind = shards.schema["docs"].dataType.elementType.simpleString()
    rows = map_arrow(shards, run, f"part int, shard int, doc {kind}, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    starts = shard_starts(spark, path).drop("tokens")
    return rows.join(starts, ["part", "shard"]).withColumn("start", F.col("start") + F.col("at")).select(
        "doc", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def token_range(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """Random access: the ids at the places ``lo`` to ``hi - 1`` of the file, as ``start, ids``,
    one row a shard. Only the symbols whose expansions reach into the range are decoded."""
    wanted = shard_starts(spark, path).filter((F.col("start") < hi) & (F.col("start") + F.col("tokens") > lo)).drop("tokens")
    shards = spark.read.parquet(path).select(*_FIELDS[:8]).join(wanted, ["part", "shard"])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                grammar, symbols = _open(row)
                a, z = max(lo - row["start"], 0), min(hi - row["start"], row["tokens"])
                reach = np.cumsum(grammar.size[symbols])
                i, j = np.searchsorted(reach, [a, z - 1], side="right")
                skip = a - (int(reach[i - 1]) if i else 0)
                found = grammar.expand(symbols[i:j + 1])[skip:skip + z - a]
                yield pa.RecordBatch.from_arrays([pa.array([row["start"] + a]), _one(pa.array(found.astype(np.int32)))], names=["start", "ids"])

    return map_arrow(shards, run, "start long, ids array<int>")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                   ids: bool = False) -> DataFrame:
    """``write`` into the shared checkpoint folder, then ``read``."""
    path = new_path(docs.sparkSession, "token-shards")
    write(docs, path, tokenizer_path, end_id, id_col, text_col)
    return read(docs.sparkSession, path, ids)
