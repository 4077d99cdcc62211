"""Ranked lexical search without random access, NRA (operator 11).

Terms are the maximal runs of bytes 0-9, A-Z, a-z and above 0x7F, A-Z lower-cased. A term's
weight is ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``; its impact in a document is
``w * ((10^9 tf) div (1000 tf + 8 m))`` with ``m = 10 + (90 n N) div L``, and a document's
score is the sum of the impacts of the query's distinct terms.

1. One scan of the texts writes posting segments: for the documents of one slice of text,
   the postings (term, document, tf) of the terms that any query holds, and each document's
   length. N and L are sums over them; df is counted per term.
2. One scan of the segments: impacts are computed, and each term's postings sorted by
   falling impact. Every query then reads its lists in that order only, round by round. A
   document that was met has a lower bound (what was read of it) and an upper one (plus the
   next impact of each list in which it was not met). Documents whose upper bound is below
   the k-th best lower one are out; those not met yet are bounded by all the next impacts
   together. Reading goes on until nothing unmet can enter and each document still in has
   equal bounds, so that membership, ties and scores are all exact.
3. Each task keeps the k best documents of every query over its segments - whose k-th score
   also prunes the next segments - and the k best of all tasks are taken at the end.

Scale: no posting is shuffled; memory is one segment (``SEGMENT`` bytes of text, or one
document) and the queries of one block (``BLOCK_TERMS`` distinct (query, term) pairs, or one
query). More queries are taken in more blocks, each a pass of its own. Terms are matched by
64-bit hashes of their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentflow.llm import kernel as K
from talentflow.llm.store import drop, map_arrow, materialise

SEGMENT = 16 << 20
BLOCK_TERMS = 1 << 20
_SHIFT = np.int64(1 << 32)


def _terms(data: np.ndarray, offsets: np.ndarray):
    low = K.LOWER[data]
    w = K.find_words(low, offsets, K.WORD_BYTES)
    return w, K.hash_spans(low, w.starts, w.ends)


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``q, item, term``: the distinct term hashes of each query row ``q``."""
    def run(batches):
        for b in batches:
            for s in K.slices(b.column(2)):
                w, h = _terms(s.data, s.offsets)
                pairs = np.unique(np.stack((w.row.astype(np.uint64), h)), axis=1)
                at = pa.array(pairs[0].astype(np.int64) + s.lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at),
                                                  pa.array(pairs[1].view(np.int64))], names=["q", "item", "term"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("item"),
                        F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, f"q long, item {kind}, term long")


@dataclass
class Queries:
    """A block of queries: ``terms`` are sorted hashes; query ``k`` holds the term numbers
    ``held[first[k]:first[k + 1]]``."""
    items: list
    terms: np.ndarray
    first: np.ndarray
    held: np.ndarray


def _collect(pairs: DataFrame) -> Queries:
    """One block of queries (bounded by the block's size)."""
    rows = pairs.groupBy("q").agg(F.first("item").alias("item"), F.collect_list("term").alias("terms")).collect()
    rows.sort(key=lambda r: r.q)
    flat = np.array([t for r in rows for t in r.terms], np.int64).view(np.uint64)
    terms, held = np.unique(flat, return_inverse=True)
    first = np.concatenate(([0], np.cumsum([len(r.terms) for r in rows]))).astype(np.int64)
    return Queries([r.item for r in rows], terms, first, held)


def _lookup(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Number of each hash in the sorted ``known``, -1 if absent."""
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def write_segments(docs: DataFrame, queries, id_col: str, text_col: str, segment: int) -> DataFrame:
    """Posting segments: ``docs`` (ids), ``size`` (terms of each document), and the postings
    ``term, doc, tf`` ordered by term."""
    def run(batches):
        known = queries.value.terms
        for b in batches:
            for s in K.slices(b.column(1), segment):
                parts, size = [], np.zeros(s.rows, np.int64)
                for t in _runs(s):
                    w, h = _terms(t.data, t.offsets)
                    size[t.lo:t.hi] = np.bincount(w.row, minlength=t.rows)
                    if len(known):
                        term = _lookup(known, h)
                        hit = term >= 0
                        parts.append(np.unique(term[hit] * _SHIFT + w.row[hit] + t.lo, return_counts=True))
                key = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
                tf = np.concatenate([p[1] for p in parts]) if parts else key
                order = np.argsort(key)
                key, tf = key[order], tf[order]
                yield pa.RecordBatch.from_arrays(
                    [_one(b.column(0).slice(s.lo, s.rows)), _one(pa.array(size)), _one(pa.array(key >> 32, pa.int32())),
                     _one(pa.array(key & (_SHIFT - 1), pa.int32())), _one(pa.array(tf, pa.int32()))],
                    names=["docs", "size", "term", "doc", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, f"docs array<{kind}>, size array<bigint>, term array<int>, doc array<int>, tf array<int>")


def _runs(s: K.Slice):
    """A segment in pieces of bounded size, rows counted within the segment."""
    lo = 0
    while lo < s.rows:
        hi = int(np.searchsorted(s.offsets, s.offsets[lo] + K.SLICE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), s.rows)
        yield K.Slice(lo, hi, s.data[s.offsets[lo]:s.offsets[hi]], s.offsets[lo:hi + 1] - s.offsets[lo])
        lo = hi


def _one(values: pa.Array) -> pa.Array:
    """One row that holds all the values as a list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _totals(segments: DataFrame, n_terms: int):
    """N, L and df of each query term."""
    sizes = F.filter("size", lambda x: x > 0)
    t = segments.agg(F.sum(F.size(sizes)).alias("n"), F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            df += np.bincount(b.column(0).flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], names=["term", "df"])

    # one row a term of the block
    rows = map_arrow(segments.select("term"), run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(n_terms, np.int64)
    for r in rows:
        df[r.term] = r.df
    return t.n or 0, t.l or 0, df


class ImpactLists:
    """The postings of a segment, each term's by falling impact (ties by document)."""

    def __init__(self, term, doc, tf, size, n_docs: int, n_terms: int, weight: np.ndarray):
        m = 10 + (90 * size * n_docs) // max(n_terms, 1)
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.ends = np.cumsum(np.bincount(term, minlength=len(weight)))
        self.rows = len(size)

    def spans(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hi = self.ends[terms]
        return np.where(terms > 0, self.ends[terms - 1], 0), hi


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Integer sums by position; float64 sums are exact below 2^53, else slower ones."""
    if len(values) and int(values.max()) * len(values) >= 1 << 53:
        out = np.zeros(n, np.int64)
        np.add.at(out, at, values)
        return out
    return np.bincount(at, weights=values, minlength=n).astype(np.int64)


def nra(lists: ImpactLists, terms: np.ndarray, k: int, floor: int = 0, step: int = 256) -> tuple[np.ndarray, np.ndarray, int]:
    """``(documents, scores, postings read)``: every document that may be among the k best of
    score above 0 and not below ``floor``, with its exact score.

    ``step`` postings of each list are read in the first round, twice as many in each next."""
    lo, hi = lists.spans(terms)
    at, terms = lo.copy(), np.arange(len(lo))
    lower = np.zeros(lists.rows, np.int64)
    read_doc, read_term = [], []
    alive, n_read = None, 0
    while True:
        to = np.minimum(at + step, hi)
        step *= 2
        pick = _ranges(at, to)
        d, t, v = lists.doc[pick], np.repeat(terms, to - at), lists.impact[pick]
        n_read += len(pick)
        at = to
        if alive is not None:  # later rounds only serve those still in
            kept = alive[d]
            d, t, v = d[kept], t[kept], v[kept]
        lower += _sums(d, v, lists.rows)
        read_doc.append(d)
        read_term.append(t)
        coming = np.where(at < hi, lists.impact[np.minimum(at, len(lists.impact) - 1)], 0) if len(lists.impact) else np.zeros(len(at), np.int64)
        rest = int(coming.sum())
        bar = max(floor, 1)
        if np.count_nonzero(lower) >= k:
            bar = max(bar, int(np.partition(lower, -k)[-k]))
        if alive is None and rest >= bar:
            continue  # a document not met yet may still enter
        # the next impacts of the lists in which a document was not met
        met = _sums(np.concatenate(read_doc), coming[np.concatenate(read_term)], lists.rows)
        alive = lower + (rest - met) >= bar
        alive &= lower > 0
        if not np.any(alive & (met < rest)):
            docs = np.flatnonzero(alive)
            return docs, lower[docs], n_read


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))


def _best(docs: pa.Array, scores: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """The k best by score, ties to the smaller id, a null id last."""
    order = pa.compute.sort_indices(pa.table([pa.array(scores), docs], names=["s", "d"]),
                                    sort_keys=[("s", "descending"), ("d", "ascending")], null_placement="at_end")[:k]
    return docs.take(order), scores[order.to_numpy()]


def search_segments(segments: DataFrame, queries, weight: np.ndarray, n_docs: int, n_terms: int, k: int, item_kind: str) -> DataFrame:
    """``item, q, doc, score``: the k best documents of each query in each task."""
    import pyarrow.compute  # noqa: F401
    kind = segments.schema["docs"].dataType.elementType.simpleString()
    item_type = segments.sparkSession.createDataFrame([], f"item {item_kind}").toArrow().schema.field(0).type

    def run(batches):
        import pyarrow.compute  # noqa: F401
        block = queries.value
        best: dict[int, tuple[pa.Array, np.ndarray]] = {}
        for b in batches:
            for i in range(b.num_rows):
                ids, size, term, doc, tf = (b.column(c).slice(i, 1).flatten() for c in range(5))
                if not len(term):
                    continue
                lists = ImpactLists(term.to_numpy(), doc.to_numpy(), tf.to_numpy().astype(np.int64), size.to_numpy(),
                                    n_docs, n_terms, weight)
                for q in range(len(block.items)):
                    terms = block.held[block.first[q]:block.first[q + 1]]
                    have = best.get(q)
                    floor = int(have[1][-1]) if have is not None and len(have[1]) >= k else 0
                    found, scores, _ = nra(lists, terms, k, floor)
                    if not len(found):
                        continue
                    docs = ids.take(pa.array(found))
                    if have is not None:
                        docs, scores = pa.concat_arrays([have[0], docs]), np.concatenate((have[1], scores))
                    best[q] = _best(docs, scores, k)
        if best:
            n = [len(v[1]) for v in best.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(list(best)), n), pa.int64()),
                 pa.array([block.items[q] for q, c in zip(best, n) for _ in range(c)], item_type),
                 pa.concat_arrays([v[0] for v in best.values()]), pa.array(np.concatenate([v[1] for v in best.values()]))],
                names=["q", "item", "doc", "score"])

    return map_arrow(segments, run, f"q long, item {item_kind}, doc {kind}, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", k: int = 10, segment: int = SEGMENT, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item, rank, doc, score``: the k best documents of each item with a score above 0.

    Equal scores are ranked by ascending id, a null id last. Null and empty texts have no
    terms: such documents are not counted in N and never found, such items have no rows. A
    repeated row is a document, or an item, of its own. An empty table on either side gives no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    item_kind = items.schema[item_col].dataType.simpleString()
    pairs = materialise(query_terms(items, item_col, item_text_col), "query-terms")
    blocks = max(-(-pairs.count() // block_terms), 1)
    out = None
    for i in range(blocks):
        mine = pairs.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i) if blocks > 1 else pairs
        block = _collect(mine)
        held = spark.sparkContext.broadcast(block)
        segments = materialise(write_segments(docs, held, id_col, text_col, segment), "postings")
        n_docs, n_terms, df = _totals(segments, len(block.terms))
        # a term of no document is read nowhere; its weight does not matter
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        found = search_segments(segments, held, weight, n_docs, n_terms, k, item_kind)
        by = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
        top = materialise(found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
                          .select("item", "rank", "doc", "score"), "found")
        drop(spark, segments.stored_at)
        out = top if out is None else out.unionByName(top)
    return out
