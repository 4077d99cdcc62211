"""Benchmark decontamination by winnowing (operator 1).

A text's words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A
*window* is a run of 13 benchmark words (an item with fewer words, but not none, is one
window). Winnowing hashes every run of ``k`` words and keeps, of each 13-word window, the
smallest hash: any span of 13 or more words that a document shares with an item therefore
has a kept fingerprint in common with it. Document fingerprints are joined with the
benchmark's, and each hit is extended: the windows which the fingerprint stands for are
compared word by word, and adjacent windows chain into spans.

Scale: the documents are scanned once. What leaves the scan are the windows whose
fingerprint is marked in a bitmap of the benchmark's fingerprints - of fixed size
(``BITMAP_BITS`` bits, 1 MB), whatever the benchmark's; a fuller bitmap lets more windows
through to the join and never drops one. The join on (fingerprint, words) is an ordinary
equi-join of two shared tables, which Spark broadcasts or shuffles by their size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentflow.llm import kernel as K
from talentflow.llm.store import BITMAP_BITS, bitmap, map_arrow, marked, materialise

WINDOW = 13
K_WORDS = 5


def _scan(data: np.ndarray, offsets: np.ndarray, window: int, k: int):
    """Words of a slice, their hashes, and each full window's start and fingerprint."""
    low = K.LOWER[data]
    w = K.find_words(low, offsets, K.WORD_BYTES)
    h = K.hash_spans(low, w.starts, w.ends)
    n = len(w) - window + 1
    if n <= 0:
        return low, w, h, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = K.ngram_hashes(h, k)
    prints = K.sliding(grams, window - k + 1)
    whole = np.flatnonzero(w.row[:n] == w.row[window - 1:])
    return low, w, h, whole, prints[whole]


def _text(low, w, i, n) -> str:
    return b" ".join(low[w.starts[j]:w.ends[j]].tobytes() for j in range(i, i + n)).decode("utf-8")


def _ragged(rows: np.ndarray, n: int) -> pa.Array:
    counts = np.bincount(rows, minlength=n)
    return pa.array(np.concatenate(([0], np.cumsum(counts))), type=pa.int32())


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                      window: int = WINDOW, k: int = K_WORDS) -> DataFrame:
    """``item, n (words in the window), win (its words), fp``, distinct. Items that are
    null or have no words give no row; repeated items and windows give one."""
    def run(batches):
        for b in batches:
            ids = b.column(0)
            for s in K.slices(b.column(1)):
                low, w, h, at, fp = _scan(s.data, s.offsets, window, k)
                size = np.bincount(w.row, minlength=s.rows)
                first = np.concatenate(([0], np.cumsum(size)[:-1]))
                rows, ns, wins, fps = list(w.row[at]), [window] * len(at), [_text(low, w, i, window) for i in at], list(fp)
                for r in np.flatnonzero((size > 0) & (size < window)):
                    n, i = int(size[r]), int(first[r])
                    rows.append(r)
                    ns.append(n)
                    wins.append(_text(low, w, i, n))
                    fps.append(K.ngram_hashes(h[i:i + n], n)[0])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.asarray(rows, np.int64) + s.lo)), pa.array(ns, pa.int32()),
                     pa.array(wins, pa.string()), pa.array(np.asarray(fps, np.uint64).view(np.int64))],
                    names=["item", "n", "win", "fp"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, f"item {kind}, n int, win string, fp long").distinct()


def candidate_windows(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str,
                      window: int = WINDOW, k: int = K_WORDS, bits: int = BITMAP_BITS) -> DataFrame:
    """Scan the documents: ``rid, doc, n_words, cand`` with one row per input row; ``cand``
    holds the windows (position, words, fingerprint) that the bitmap lets through."""
    spark = docs.sparkSession
    full = bitmap(windows.filter(F.col("n") == window), "fp", bits)
    part = bitmap(windows.filter(F.col("n") < window), "fp", bits)
    short = [r.n for r in windows.filter(F.col("n") < window).select("n").distinct().collect()]  # < window rows
    maps = spark.sparkContext.broadcast((full, part, sorted(short)))
    item = pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("win", pa.string()), ("fp", pa.int64())])

    def run(batches):
        full, part, short = maps.value
        for b in batches:
            for s in K.slices(b.column(2)):
                low, w, h, at, fp = _scan(s.data, s.offsets, window, k)
                size = np.bincount(w.row, minlength=s.rows)
                first = np.concatenate(([0], np.cumsum(size)[:-1]))
                hit = marked(full, fp)
                found = [(at[hit], np.full(int(hit.sum()), window), fp[hit])]
                for n in short:
                    g = K.ngram_hashes(h, n)
                    ok = np.flatnonzero((w.row[:len(g)] == w.row[n - 1:n - 1 + len(g)]) & marked(part, g))
                    found.append((ok, np.full(len(ok), n), g[ok]))
                at, ns, fps = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(w.row[at], kind="stable")
                at, ns, fps = at[order], ns[order], fps[order]
                rows = w.row[at]
                cand = pa.StructArray.from_arrays(
                    [pa.array(at - first[rows], pa.int32()), pa.array(ns, pa.int32()),
                     pa.array([_text(low, w, i, n) for i, n in zip(at, ns)], pa.string()),
                     pa.array(fps.astype(np.uint64).view(np.int64))], fields=list(item))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.lo, s.rows), b.column(1).slice(s.lo, s.rows), pa.array(size, pa.int64()),
                     pa.ListArray.from_arrays(_ragged(rows, s.rows), cand)], names=["rid", "doc", "n_words", "cand"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc"),
                       F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, f"rid long, doc {kind}, n_words long, "
                                "cand array<struct<pos:int,n:int,win:string,fp:long>>")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  k: int = K_WORDS) -> tuple[DataFrame, DataFrame]:
    """The scanned documents and their verified hits.

    Returns ``(scan, hits)``: ``scan`` has ``rid, doc, n_words`` for every input row;
    ``hits`` has ``rid, pos, n, item`` for every occurrence of an item's window. Null and
    empty texts have no words and no hits; a repeated id or row is a row of its own (``rid``);
    other columns are not read.
    """
    windows = materialise(benchmark_windows(items, item_col, item_text_col, window, k), "bench-windows")
    scan = materialise(candidate_windows(docs, windows, id_col, text_col, window, k), "doc-windows")
    hits = (scan.select("rid", F.explode("cand").alias("c")).select("rid", "c.*")
            .join(windows, ["fp", "n", "win"]).select("rid", "pos", "n", "item"))
    return scan.select("rid", "doc", "n_words"), materialise(hits, "window-hits")


def spans(hits: DataFrame) -> DataFrame:
    """Chain overlapping or adjacent windows: ``rid, first, last (exclusive), words``."""
    by = Window.partitionBy("rid").orderBy("pos", "end")
    occ = hits.select("rid", "pos", (F.col("pos") + F.col("n")).alias("end")).distinct()
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = (F.col("pos") > F.coalesce(reach, F.lit(-1))).cast("int")
    runs = occ.withColumn("cut", cut).withColumn("run", F.sum("cut").over(by))
    return (runs.groupBy("rid", "run").agg(F.min("pos").alias("first"), F.max("end").alias("last"))
            .select("rid", "first", "last", (F.col("last") - F.col("first")).alias("words")))


def judge(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", share: int = 20) -> DataFrame:
    """One row per document: ``rid, doc, n_words, n_hit, items (sorted as strings),
    contaminated`` - contaminated if any word is hit and ``share * n_hit >= n_words``."""
    scan, hits = contamination(docs, items, id_col, text_col, item_col, item_text_col)
    words = spans(hits).groupBy("rid").agg(F.sum("words").cast("long").alias("n_hit"))
    found = (hits.select("rid", F.col("item").cast("string").alias("item")).distinct()
             .groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items")))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (scan.join(words.join(found, "rid"), "rid", "left")
            .select("rid", "doc", "n_words", n_hit.alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, all columns as they were."""
    bad = materialise(judge(docs, items, id_col, text_col).filter("contaminated")
                      .select(F.col("doc").alias("__bad")).distinct(), "contaminated")
    # a bitmap of fixed size lets most rows pass; only those that it marks are joined, so that
    # the texts of the others are not shuffled
    maps = docs.sparkSession.sparkContext.broadcast(bitmap(bad.select(F.xxhash64("__bad").alias("h")), "h"))

    @F.pandas_udf("boolean")
    def suspect(h: pd.Series) -> pd.Series:
        return pd.Series(marked(maps.value, h.to_numpy().view(np.uint64)))

    ask = suspect(F.xxhash64(id_col))
    # an id is dropped as a whole: rows that share an id are the same document
    held = docs.filter(ask)
    return docs.filter(~ask).unionByName(held.join(bad, held[id_col].eqNullSafe(bad["__bad"]), "left_anti"))
