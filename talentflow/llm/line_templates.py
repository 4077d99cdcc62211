"""Line dedup with a log-template tree (operator 7).

Lines are cut into tokens (white space apart, A-Z lower-cased, tokens that hold a digit are
one variable field). The tree has a fixed depth: token count first, then the leading
``DEPTH`` tokens; lines of one leaf share a template, whose field at each position is the
token of most of the leaf's documents, or variable where none is. A line belongs to its
leaf's template if at least ``SIMILARITY`` of its tokens agree with it, and is a template of
its own otherwise. Templates that recur in ``MIN_DOCS`` documents or more are dropped.

Copies of a document make all of its lines recur without any of them being a template:
carriers are therefore counted by near-duplicate class (``ngram_join``, among the texts that
carry a line whose template recurs), each class once. Copies of one document are left whole
that way - they are the business of near-duplicate detection - and lose only lines which
other documents carry too. How much of a text recurs is of no matter.

Scale: two scans of the texts; lines travel as hashes. A line's tokens leave the second scan
only if its leaf may hold several lines that recur (a bitmap of fixed size, then an exact
join), and from one text each. Carriers are picked by a bitmap on a further scan and sketched there. Everything else
is partial aggregates and equi-joins on hashes; the last join brings the numbers of dropped
lines back to the texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentflow.llm import kernel as K
from talentflow.llm import ngram_join
from talentflow.llm.store import bitmap, drop_tables, map_arrow_frugal, marked, materialise
from talentflow.session import ship_package

DEPTH, SIMILARITY, MIN_DOCS, MIN_TOKENS, MIN_LETTERS = 4, 0.75, 3, 3, 20
#: up to so many distinct dropped lines (8 bytes each) go to the tasks; beyond, texts are joined
HELD_LINES = 1 << 21
PART_BYTES = 1 << 20  # of texts that are cut and handed on together
_FIELD = np.uint64(0x6A09E667F3BCC909)  # stands for a token that holds a digit


def _word_of(w: K.Words, bytes_: np.ndarray) -> np.ndarray:
    """The word that each marked byte, none of them white space, lies in."""
    return np.searchsorted(w.starts, np.flatnonzero(bytes_), side="right") - 1


def _lines(s: K.Slice, depth: int, letters: list | None = None):
    """Lines with a token: row, number in the row, token count, leaf, line hash; the token
    hashes of all of them and where each line's begin. Into ``letters``: the characters of each
    line's tokens, without those that hold a digit (they are a field)."""
    low = K.LOWER[s.data]
    w = K.find_words(low, s.offsets, K.NON_SPACE)
    h = K.hash_spans(low, w.starts, w.ends)
    field = np.zeros(len(w), bool)
    field[_word_of(w, low - np.uint8(48) < 10)] = True
    h[field] = _FIELD
    breaks = np.flatnonzero(low == 10)
    at = np.unique(np.searchsorted(w.starts, np.concatenate((s.offsets[:-1], breaks))))
    at = at[at < len(w)]
    size = np.diff(np.append(at, len(w)))
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64), h, at
    row = w.row[at]
    number = np.searchsorted(breaks, w.starts[at]) - np.searchsorted(breaks, s.offsets[row])
    if letters is not None:
        n = w.ends - w.starts
        if low.max() >= 128:
            n = n - np.bincount(_word_of(w, (low & 0xC0) == 0x80), minlength=len(w))
        n[field] = 0
        letters.append(np.add.reduceat(n, at))
    place = np.arange(len(w)) - np.repeat(at, size)
    line = K.mix(np.add.reduceat(K.mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at))
    leaf = size.astype(np.uint64)
    for j in range(depth):
        tok = np.where(size > j, h[np.minimum(at + j, len(h) - 1)], np.uint64(0))
        leaf = K.mix(leaf * np.uint64(0xD6E8FEB86659FD93) + tok)
    return row, number, size, leaf, line, h, at


def _ragged(rows, n):
    return pa.array(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))), pa.int32())


def _i64(x):
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def scan_lines(rows: DataFrame, depth: int, min_tokens: int = MIN_TOKENS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """``th, lines`` for rows ``(th, text)``; ``long`` marks lines of ``min_tokens`` tokens, or of
    ``min_letters`` characters: a passage without blanks is one token."""
    kinds = [("idx", pa.int32()), ("long", pa.bool_()), ("leaf", pa.int64()), ("line", pa.int64())]

    def run(batches):
        for b in batches:
            for s in K.slices(b.column(1)):
                letters: list = []
                row, number, size, leaf, line, _, _ = _lines(s, depth, letters)
                long = size >= min_tokens
                if letters:
                    long = long | (letters[0] >= min_letters)
                items = pa.StructArray.from_arrays([pa.array(number, pa.int32()), pa.array(long), _i64(leaf),
                                                    _i64(line)], fields=[pa.field(*k) for k in kinds])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.lo, s.rows),
                                                  pa.ListArray.from_arrays(_ragged(row, s.rows), items)], names=["th", "lines"])

    return map_arrow_frugal(rows, run, "th long, lines array<struct<idx:int,long:boolean,leaf:long,line:long>>")


def _marked_rows(words: np.ndarray, hashes: pa.Array) -> np.ndarray:
    return np.flatnonzero(marked(words, hashes.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))


def _only(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """The rows whose ``th`` is marked in a bitmap; hashes alone go to Python for that."""
    ship_package(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def hit(th: pd.Series) -> pd.Series:
        return pd.Series(marked(held.value, th.to_numpy(np.int64).view(np.uint64)))

    return rows.filter(hit("th"))


def scan_tokens(rows: DataFrame, words: np.ndarray, depth: int) -> DataFrame:
    """``leaf, line, n, tokens`` of the lines whose leaf is marked in the bitmap ``words``."""
    held = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        leaves = held.value
        for b in batches:
            for s in K.slices(b.column(1)):
                _, _, size, leaf, line, h, at = _lines(s, depth)
                _, first = np.unique(line, return_index=True)
                ok = first[marked(leaves, leaf[first])]
                off = np.concatenate(([0], np.cumsum(size[ok])))
                take = np.repeat(at[ok] - off[:-1], size[ok]) + np.arange(off[-1])
                yield pa.RecordBatch.from_arrays(
                    [_i64(leaf[ok]), _i64(line[ok]), pa.array(size[ok], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(off, pa.int32()), _i64(h[take]))], names=["leaf", "line", "n", "tokens"])

    return map_arrow_frugal(rows, run, "leaf long, line long, n int, tokens array<long>")


def _generalise(texts: DataFrame, lines: DataFrame, min_docs: int, similarity: float, depth: int):
    """``leaf, line`` of the lines that belong to their leaf's template, and the tables it reads."""
    support = lines.select("leaf", "line", "th").distinct().groupBy("leaf", "line").agg(F.count("*").alias("d"), F.min("th").alias("holder"))
    support = materialise(support, "line-support")
    leaves = (support.groupBy("leaf").agg(F.sum("d").alias("docs"), F.count("*").alias("variants"))
              .filter((F.col("variants") > 1) & (F.col("docs") >= min_docs)))
    leaves = materialise(leaves, "leaves")
    holders = bitmap(support.join(leaves, "leaf", "left_semi"), "holder")  # one text of each line is enough
    tokens = (scan_tokens(_only(texts, holders), bitmap(leaves, "leaf"), depth).dropDuplicates(["leaf", "line"])
              .join(support, ["leaf", "line"]).join(leaves.select("leaf", "docs"), "leaf"))
    tokens = materialise(tokens.select("leaf", "line", "n", "d", "docs", "tokens"), "leaf-tokens")
    each = tokens.select("leaf", "line", "n", "d", "docs", F.posexplode("tokens").alias("pos", "tok"))
    votes = each.groupBy("leaf", "pos", "tok").agg(F.sum("d").alias("v"), F.first("docs").alias("docs"))
    field = (votes.groupBy("leaf", "pos").agg(F.max(F.struct("v", "tok")).alias("top"), F.first("docs").alias("docs"))
             .filter(F.col("top.v") * 2 > F.col("docs")).select("leaf", "pos", F.col("top.tok").alias("tok")))
    return (each.join(field, ["leaf", "pos", "tok"]).groupBy("leaf", "line").agg(F.count("*").alias("same"), F.first("n").alias("n"))
            .filter(F.col("same") >= F.lit(similarity) * F.col("n")).select("leaf", "line")), (support, leaves, tokens)


def _copy_classes(texts: DataFrame, carriers: DataFrame) -> DataFrame:
    """``th, root`` for the texts in ``carriers``: near-duplicates among them have one root."""
    carriers = materialise(carriers, "carriers")
    some = _only(texts, bitmap(carriers, "th")).select("th", "t")
    judged = ngram_join.near_duplicates(some, "th", "t", among=carriers)
    return materialise(judged.select(F.col("doc").alias("th"), F.col("component_id").alias("root")).distinct(), "copy-classes")


def _dropped(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS,
             min_letters: int = MIN_LETTERS, similarity: float = SIMILARITY, depth: int = DEPTH) -> DataFrame:
    """``th`` (hash of a text), ``idx`` (number of a line in it, from 0) and ``line`` for every
    line of a distinct text whose template recurs."""
    texts = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("t"))
    texts = texts.filter(F.length("t") > 0)
    scanned = scan_lines(texts, depth, min_tokens, min_letters)
    lines = materialise(scanned.select("th", F.explode("lines").alias("l")).select("th", "l.*").distinct(), "lines")
    general, reads = _generalise(texts, lines, min_docs, similarity, depth)
    template = F.when(F.col("g").isNotNull(), F.col("leaf")).otherwise(F.col("line"))
    named = materialise(lines.join(general.withColumn("g", F.lit(1)), ["leaf", "line"], "left")
                        .filter("long").select("th", "idx", "line", template.alias("template")), "named-lines")
    drop_tables(lines, *reads)

    def recurring(rows, carrier):
        return (rows.select("template", carrier).distinct().groupBy("template").agg(F.count("*").alias("c"))
                .filter(F.col("c") >= min_docs).select("template"))
    first = materialise(recurring(named, "th"), "recurring")
    carried = materialise(named.join(first, "template", "left_semi"), "carried")
    drop_tables(named, first)
    classes = _copy_classes(texts, carried.select("th").distinct())
    last = materialise(recurring(carried.join(classes, "th"), "root"), "templates")
    return carried.join(last, "template", "left_semi").select("th", "idx", "line")


def recurring_lines(docs: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """``th`` (hash of a text) and ``drop`` (numbers of its lines, from 0) for every distinct
    text with a line whose template recurs."""
    return _dropped(docs, text_col, **params).groupBy("th").agg(F.array_sort(F.collect_list("idx")).alias("drop"))


def _cut(docs: DataFrame, text_col: str, lines: np.ndarray, carriers: np.ndarray, depth: int, out_col: str) -> DataFrame:
    """Cut the given lines (sorted hashes) out of the texts on a scan; a text whose hash is not
    marked in ``carriers`` has none of them."""
    held = docs.sparkSession.sparkContext.broadcast((lines, carriers))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)

    def run(batches):
        gone, texts = held.value
        for b in batches:
            for part in K.slices(b.column(at), PART_BYTES):
                columns = [b.column(i).slice(part.lo, part.rows) for i in range(len(names))]
                rows = _marked_rows(texts, b.column(len(names)).slice(part.lo, part.rows))
                some, many, cut_texts = columns[at].take(pa.array(rows)), np.zeros(part.rows, np.int32), []
                for s in K.slices(some):
                    row, number, _, _, line, _, _ = _lines(s, depth)
                    hit = np.zeros(len(line), bool)
                    if len(gone):
                        hit = gone[np.minimum(np.searchsorted(gone, line), len(gone) - 1)] == line
                    of_row = np.bincount(row[hit], minlength=s.rows)
                    many[rows[s.lo:s.hi]] = of_row
                    for r in np.flatnonzero(of_row):
                        lo, hi = np.searchsorted(row, [r, r + 1])
                        cut = set(number[lo:hi][hit[lo:hi]].tolist())
                        kept = [x for i, x in enumerate(some[s.lo + int(r)].as_py().split("\n")) if i not in cut]
                        cut_texts.append("\n".join(kept))
                if cut_texts:
                    columns[at] = pc.replace_with_mask(columns[at], pa.array(many > 0), pa.array(cut_texts, columns[at].type))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(many, pa.int32())], names=[*names, "cut"])

    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))
    rows = docs.toDF(*names).select("*", F.xxhash64(f"c{at}").alias("th"))
    return map_arrow_frugal(rows, run, kinds + ", cut int").toDF(*docs.columns, out_col)


def drop_recurring_lines(docs: DataFrame, text_col: str = "text", out_col: str = "__dropped", **params) -> DataFrame:
    """``docs`` with recurring lines cut out of ``text_col``, and ``out_col`` (how many), which
    must be no column of ``docs``.

    Lines end at ``\\n``; kept lines, their order and the other columns stay as they were.
    Null and empty texts, blank lines and lines of fewer than ``min_tokens`` tokens and
    ``min_letters`` characters are never touched; repeated rows are changed alike. A text all of whose lines recur becomes empty.
    """
    if out_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"{out_col} is a column already: name another out_col")
    dropped = materialise(_dropped(docs, text_col, **params), "dropped-lines")
    lines = materialise(dropped.select("line").distinct(), "distinct-dropped-lines")
    if lines.count() <= HELD_LINES:  # whether a line goes depends on the line alone: no text is moved
        known = np.sort(lines.toPandas()["line"].to_numpy(np.int64).view(np.uint64))
        return _cut(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col, known,
                    bitmap(dropped, "th"), params.get("depth", DEPTH), out_col)
    drops = dropped.groupBy("th").agg(F.array_sort(F.collect_list("idx")).alias("drop"))
    drops = materialise(drops, "drops").withColumnsRenamed({"th": "__th", "drop": "__drop"})
    kept = F.filter(F.split(F.col(text_col).cast("string"), "\n", -1), lambda x, i: ~F.array_contains("__drop", i))
    text = F.when(F.col("__drop").isNull(), F.col(text_col).cast("string")).otherwise(F.array_join(kept, "\n"))
    joined = docs.withColumn("__th", F.xxhash64(F.col(text_col).cast("string"))).join(drops, "__th", "left")
    return joined.select(*[(text.alias(c) if c == text_col else F.col(c)) for c in docs.columns],
                         F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).alias(out_col))
