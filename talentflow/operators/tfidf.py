"""Relational TF-IDF (L1-L4).

A document-term matrix is a long table ``(id, term, tf)``; the fitted model is
a vocabulary DataFrame ``(term, df, idf)``. The formulas follow the common
"smooth idf + optional sublinear tf + L2 norm" definition:

    idf(t) = ln((1 + n) / (1 + df(t))) + 1
    w(d,t) = (1 + ln tf) * idf    (sublinear)   |   tf * idf
    w      = w / ||w(d, .)||_2

Scale notes: tokenisation is a projection (no shuffle); term counts are one
``groupBy(id, term)`` with map-side partial aggregation; the vocabulary is cut
to ``max_features`` rows by a global top-k, so broadcasting it is bounded by
that parameter; the L2 norm is a window per document.

``fit_rows`` does the same without a long table: texts are gathered by id, cut
into tokens by Spark, and a map step counts the terms of a slice of documents
at a time. Fitting sends one partial count per term and slice to the shuffle;
weighing looks terms up in the broadcast vocabulary and returns one row
``(id, idx, w)`` per document, so that no step sorts or aggregates its terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentflow.plans import presets as P

UNICODE_TOKEN = r"(?U)\b\w\w+\b"
ASCII_TOKEN = r"[a-z0-9_]{2,}"   # same tokens as \b\w\w+\b with ASCII classes


def token_array(text: str | Column, unicode: bool = True, stop_words=None) -> Column:
    """L1 (unigrams): lower-case word tokens of >= 2 word chars minus stop words."""
    t = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    toks = F.regexp_extract_all(t, F.lit(UNICODE_TOKEN if unicode else ASCII_TOKEN), 0)
    sw = list(P.spark_stop_words() if stop_words is None else stop_words)
    return F.filter(toks, lambda x: ~x.isin(sw)) if sw else toks


def with_ngrams(tokens: str, ngram_max: int = 2) -> Column:
    """L1: unigrams followed by space-joined bigrams of a materialised token column."""
    toks = F.col(tokens)
    if ngram_max < 2:
        return toks
    bi = F.transform(F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0))),
                     lambda x, i: F.concat(F.get(toks, i), F.lit(" "), x))
    return F.concat(toks, bi)


def term_counts(df: DataFrame, id_col: str, text_col: str, ngram_max: int = 2,
                unicode: bool = True, stop_words=None, keep: list[str] | None = None,
                colocate: bool = True, doc_marker: bool = False) -> DataFrame:
    """L1: ``(id, [keep...], term, tf)`` for every document with text.

    ``colocate``: hash-partition the raw rows by ``id`` first (one shuffle of
    the compact text instead of the exploded terms). Every later per-document
    step -- term counts, the L2-norm window, the pair aggregation and the
    top-k window of the similarity join -- is then satisfied by this
    partitioning and needs no further exchange.
    """
    keep = keep or []
    src = df.repartition(id_col) if colocate else df
    toks = src.select(id_col, *keep, token_array(text_col, unicode, stop_words).alias("__tok"))
    grams = with_ngrams("__tok", ngram_max)
    if doc_marker:
        # one extra row per document with a NULL term: the document count then
        # falls out of the per-term statistics pass (no separate text scan)
        grams = F.concat(grams, F.array(F.lit(None).cast("string")))
    terms = toks.select(id_col, *keep, F.explode(grams).alias("term"))
    return terms.groupBy(id_col, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_vocabulary(tf: DataFrame, id_col: str, n_docs: int, min_df: int = P.TFIDF_MIN_DF,
                   max_df: float = P.TFIDF_MAX_DF,
                   max_features: int | None = P.TFIDF_MAX_FEATURES) -> DataFrame:
    """L2: ``(term, df, idf)`` after min_df / max_df / max_features.

    ``min_df``/``max_df`` accept an absolute count (int) or a share (float).
    ``max_features`` keeps the terms with the largest corpus count (ties by term).
    """
    return vocabulary_from_stats(term_stats(tf), n_docs, min_df, max_df, max_features)


def term_stats(tf: DataFrame) -> DataFrame:
    """``(term, df, total)``: documents containing each term and its corpus count."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def vocabulary_from_stats(stats: DataFrame, n_docs: int, min_df=P.TFIDF_MIN_DF,
                          max_df=P.TFIDF_MAX_DF,
                          max_features: int | None = P.TFIDF_MAX_FEATURES) -> DataFrame:
    """L2 on precomputed ``term_stats``: min_df / max_df / max_features and idf."""
    lo = min_df if isinstance(min_df, int) else min_df * n_docs
    hi = max_df if isinstance(max_df, int) else max_df * n_docs
    stats = stats.filter((F.col("df") >= lo) & (F.col("df") <= hi))
    if max_features:
        stats = most_frequent(stats, max_features)
    return stats.select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def most_frequent(stats: DataFrame, n: int) -> DataFrame:
    """The ``n`` terms with the largest ``total`` (ties by term).

    A histogram of totals, first by power of two and then inside the bin that holds the cut,
    tells the total at the cut; terms above it pass a filter, and only terms with exactly
    that total are ordered.
    """
    bin_ = F.floor(F.log2("total")).cast("int")

    def cut(counts):
        """Rows above the cut, and the value at it (None if all fit)."""
        above = 0
        for value, c in sorted(counts, reverse=True):
            if above + c > n:
                return above, value
            above += c
        return above, None
    bins = [(r.b, r.c) for r in stats.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()]
    above, b = cut(bins)
    if b is None:
        return stats
    inside = stats.filter(bin_ == b).groupBy("total").agg(F.count(F.lit(1)).alias("c")).collect()
    above, total = cut([(r.total, r.c) for r in inside] + [(float("inf"), above)] * (above > 0))
    ties = stats.filter(F.col("total") == total).orderBy("term").limit(n - above)
    return stats.filter(F.col("total") > total).unionByName(ties)


def weigh(tf: DataFrame, vocab: DataFrame, id_col: str, sublinear: bool = True,
          digits: int | None = None) -> DataFrame:
    """L3/L4 transform: ``(id, term, w)`` with L2-normalised weights. Spark broadcasts the
    vocabulary or not by its size.
    """
    v = vocab
    tfc = (1.0 + F.log(F.col("tf"))) if sublinear else F.col("tf").cast("double")
    raw = tf.join(v.select("term", "idf"), "term").withColumn("w", tfc * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    w = F.col("w") / norm
    if digits is not None:
        w = F.round(w, digits)
    return raw.select(id_col, "term", w.alias("w"))


def fit_transform(corpus_parts: list[tuple[DataFrame, str, str]], ngram_max: int = 2,
                  min_df=P.TFIDF_MIN_DF, max_df=P.TFIDF_MAX_DF,
                  max_features=P.TFIDF_MAX_FEATURES, sublinear: bool = True,
                  unicode: bool = True, stop_words=None, materialize: bool = True):
    """L4: fit one vocabulary on the union of several text sets, weigh each set.

    ``corpus_parts`` is ``[(df, id_col, text_col), ...]``; returns
    ``(vocab, [weights per part])``. Fitting is eager (like an MLlib
    estimator): the vocabulary is checkpointed into the shared folder.
    """
    if materialize and max_features:
        terms, parts, _ = fit_rows(corpus_parts, ngram_max, min_df, max_df, max_features, sublinear, unicode, stop_words)
        return terms.select("term", "df", "idf"), [
            long_weights(rows, terms, idc) for rows, (_, idc, _) in zip(parts, corpus_parts)]
    from talentflow.session import checkpoint_dir, cut_lineage
    checkpoint_dir(corpus_parts[0][0].sparkSession)
    tfs = [term_counts(df, idc, txt, ngram_max, unicode, stop_words, doc_marker=materialize)
           for df, idc, txt in corpus_parts]
    union = None
    for tfp, (_, idc, _) in zip(tfs, corpus_parts):
        part = tfp.select(F.col(idc).cast("string").alias("__doc"), "term", "tf")
        union = part if union is None else union.unionByName(part)
    if materialize:
        # one pass over the text: per-term statistics plus the document count
        # (the NULL marker term), written once; the table has one row per
        # distinct term, far smaller than the text it replaces a scan of
        st = term_stats(union)
        if isinstance(min_df, int):     # an absolute min_df needs no n_docs: cut the tail first
            st = st.filter(F.col("term").isNull() | (F.col("df") >= min_df))
        stats = cut_lineage(st)
        marker = stats.filter(F.col("term").isNull()).select("df").collect()
        n_docs = int(marker[0]["df"]) if marker else 0
        vocab = vocabulary_from_stats(stats.filter(F.col("term").isNotNull()), n_docs,
                                      min_df, max_df, max_features)
    else:
        n_docs = sum(df.count() for df, _, _ in corpus_parts)
        vocab = fit_vocabulary(union, "__doc", n_docs, min_df, max_df, max_features)
    # the fitted model: materialised once (bounded by max_features rows) so every
    # transform reads it instead of re-deriving it from the corpus
    vocab = vocab.checkpoint(eager=True) if materialize else vocab
    # the inner join on term drops the NULL marker rows
    weights = [weigh(tfp, vocab, idc, sublinear)
               for tfp, (_, idc, _) in zip(tfs, corpus_parts)]
    return vocab, weights


#: documents counted or weighed at a time, and left texts of ``JoinedText`` with theirs
SLICE, LEFT_SLICE = 1024, 128


@dataclass
class JoinedText:
    """The text of documents that are pairs: that of a row of ``left`` and that of a row of
    ``right``, which the document names by their keys, with white space between. A text that
    many documents share is cut into tokens once for those of one left row (which meet in one
    task, so that a left row is for few documents, as of a top-k join)."""
    left: DataFrame
    left_key: str
    left_text: str
    right: DataFrame
    right_key: str
    right_text: str

    def token_rows(self, df: DataFrame, id_col: str, unicode: bool = True, stop_words=None) -> DataFrame:
        """``id, toks, more``, a row for each left row: its tokens, and the ids and right tokens of its documents."""
        right = self.right.select(self.right_key, token_array(self.right_text, unicode, stop_words).alias("__more"))
        empty = F.array().cast("array<string>")
        groups = (df.select(id_col, self.left_key, self.right_key).join(right, self.right_key, "left")
                  .groupBy(self.left_key).agg(F.collect_list(F.struct(F.col(id_col).alias("id"), F.coalesce("__more", empty).alias("more"))).alias("__g")))
        texts = self.left.select(self.left_key, F.col(self.left_text).alias("__text"))
        return groups.join(texts, self.left_key, "left").select(
            F.col("__g.id").alias(id_col), token_array("__text", unicode, stop_words).alias("toks"), F.col("__g.more").alias("more"))


def token_rows(df: DataFrame, id_col: str, text_col: str | JoinedText, unicode: bool = True, stop_words=None,
               unique: bool = False) -> DataFrame:
    """``id, toks``: the tokens of each text of an id, an array a text. Rows that share an id
    (or its absence) are one document; ``unique`` says that no two do (as it must be for a ``JoinedText``)."""
    if isinstance(text_col, JoinedText):
        return text_col.token_rows(df, id_col, unicode, stop_words)
    if unique:
        return df.select(F.col(id_col), F.array(token_array(text_col, unicode, stop_words)).alias("toks"))
    texts = df.groupBy(id_col).agg(F.collect_list(F.coalesce(text_col, F.lit(""))).alias("__texts"))
    return texts.select(id_col, F.transform("__texts", lambda t: token_array(t, unicode, stop_words)).alias("toks"))


def _text_grams(texts: pa.ListArray, ngram_max: int):
    """``(text, term)`` of every unigram and bigram of arrays of tokens, one a text."""
    flat = texts.flatten()
    text = np.repeat(np.arange(len(texts)), np.diff(texts.offsets.to_numpy()))
    if ngram_max < 2 or len(flat) < 2:
        return text, flat
    inside = text[:-1] == text[1:]
    pairs = pc.binary_join_element_wise(flat[:-1].filter(pa.array(inside)), flat[1:].filter(pa.array(inside)), " ")
    return np.concatenate([text, text[:-1][inside]]), pa.concat_arrays([flat, pairs])


def _grams(b: pa.RecordBatch, ngram_max: int):
    """``(document of every gram, its code, grams by code)`` of a slice of ``token_rows``."""
    toks = b.column("toks")
    text, terms = _text_grams(toks.flatten(), ngram_max)
    coded = terms.dictionary_encode()
    return (np.repeat(np.arange(len(toks)), np.diff(toks.offsets.to_numpy()))[text],
            coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


def _joined_grams(b: pa.RecordBatch, ngram_max: int):
    """``(left row of every document, (left row, code) of the left texts' grams, (document, code)
    of the grams that a document has besides, grams by code)`` of a slice of ``JoinedText``."""
    toks, more = b.column("toks"), b.column("more").flatten()
    of = np.repeat(np.arange(len(toks)), np.diff(b.column("more").offsets.to_numpy()))
    left, left_terms = _text_grams(toks, ngram_max)
    right, right_terms = _text_grams(more, ngram_max)
    # the bigram of the last left and the first right token
    n_left, n_right = np.diff(toks.offsets.to_numpy()), np.diff(more.offsets.to_numpy())
    both = np.flatnonzero((n_left[of] > 0) & (n_right > 0) & (ngram_max > 1))
    between = pc.binary_join_element_wise(toks.flatten().take(pa.array(np.cumsum(n_left)[of[both]] - 1)),
                                          more.flatten().take(pa.array((np.cumsum(n_right) - n_right)[both])), " ")
    coded = pa.concat_arrays([left_terms, right_terms, between]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return of, (left, code[:len(left)]), (np.concatenate([right, both]), code[len(left):]), coded.dictionary


def _counted(key: np.ndarray):
    """The distinct keys in order, and how often each occurs."""
    key = np.sort(key)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    return key[first], np.diff(np.append(first, len(key)))


def _find(key: np.ndarray, among: np.ndarray):
    """Where each key is in an ordered array, and whether it is there."""
    at = np.minimum(np.searchsorted(among, key), max(len(among) - 1, 0))
    return at, among[at] == key if len(among) else np.zeros(len(key), bool)


def _slices(batches):
    for b in batches:
        size = LEFT_SLICE if "more" in b.schema.names else SLICE
        for lo in range(0, b.num_rows, size):
            yield b.slice(lo, size)


def partial_stats(tokens: DataFrame, ngram_max: int, part: int) -> DataFrame:
    """``term, part, df, total`` of slices of documents; the documents themselves are counted
    as ``df`` of a null term of this ``part``."""
    def plain(b):
        rows, code, grams = _grams(b, ngram_max)
        n = max(len(grams), 1)
        return b.num_rows, grams, np.bincount(_counted(rows * n + code)[0] % n, minlength=n), np.bincount(code, minlength=n)

    def joined(b):
        of, (left, code), (doc, more), grams = _joined_grams(b, ngram_max)
        n = max(len(grams), 1)
        docs = np.bincount(of, minlength=b.num_rows)
        held, tf = _counted(left * n + code)
        key = _counted(doc * n + more)[0]
        new = key[~_find(of[key // n] * n + key % n, held)[1]] % n     # not in the left text, too
        # sums of whole numbers, exact as doubles
        return (len(of), grams, np.bincount(held % n, docs[held // n], n) + np.bincount(new, minlength=n),
                np.bincount(held % n, docs[held // n] * tf, n) + np.bincount(more, minlength=n))

    def run(batches):
        for b in _slices(batches):
            docs, grams, df, total = (joined if "more" in b.schema.names else plain)(b)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([grams, pa.nulls(1, pa.string())]),
                 pa.concat_arrays([pa.nulls(len(grams), pa.int32()), pa.array([part], pa.int32())]),
                 pa.array(np.append(df[:len(grams)], docs).astype(np.int64)),
                 pa.array(np.append(total[:len(grams)], 0).astype(np.int64))],
                names=["term", "part", "df", "total"])
    return tokens.select(*[c for c in ("toks", "more") if c in tokens.columns]).mapInArrow(run, "term string, part int, df long, total long")


def _lists(size: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(values))


def weight_rows(tokens: DataFrame, terms: DataFrame, id_col: str, ngram_max: int = 2,
                sublinear: bool = True) -> DataFrame:
    """L3/L4 transform: ``id, idx, w``, the L2-normalised weights of each document that holds a
    known term; ``terms`` is ``(term, idf, idx)`` of at most ``max_features`` rows.

    For a ``JoinedText`` a row is a left text with all its documents: the ids (an array), the left
    text's ``idx, w``, and for each document its ``scale``, the number ``n`` of its further terms,
    and (one after the other) their ``more_idx, more_w``. A document's weights are the left
    text's, its own added to them, times its scale (0 if it holds no known term)."""
    from talentflow.session import ship_package
    spark = tokens.sparkSession
    ship_package(spark)
    known = terms.select("term", "idf", "idx").toArrow().combine_chunks().sort_by("idx")
    held = spark.sparkContext.broadcast((known.column("term").combine_chunks(), known.column("idf").to_numpy(),
                                         known.column("idx").to_numpy()))

    def places(grams, vocab):
        return pc.fill_null(pc.index_in(grams, value_set=vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def weight(tf, idf):
        return (1.0 + np.log(tf) if sublinear else tf.astype(float)) * idf

    def plain(b):
        vocab, idf, idx = held.value
        n = max(len(vocab), 1)
        rows, code, grams = _grams(b, ngram_max)
        at = places(grams, vocab)[code]
        key, tf = _counted(rows[at >= 0] * n + at[at >= 0])
        row, term = key // n, key % n
        w = weight(tf, idf[term]) if len(key) else np.zeros(0)
        w = w / np.sqrt(np.bincount(row, w * w, minlength=b.num_rows))[row]
        size = np.bincount(row, minlength=b.num_rows)
        some = np.flatnonzero(size)
        return [b.column(0).take(pa.array(some)), _lists(size[some], idx[term].astype(np.int32)), _lists(size[some], w)]

    def shared(b):
        vocab, idf, idx = held.value
        n = max(len(vocab), 1)
        of, (left, code), (doc, more), grams = _joined_grams(b, ngram_max)
        place = places(grams, vocab)
        code, more = place[code], place[more]
        key, tf = _counted(left[code >= 0] * n + code[code >= 0])
        row, term = key // n, key % n
        w = weight(tf, idf[term]) if len(key) else np.zeros(0)
        mine, own_tf = _counted(doc[more >= 0] * n + more[more >= 0])
        doc, own = mine // n, mine % n
        at, same = _find(of[doc] * n + own, key)
        old, had = np.zeros(len(mine)), np.zeros(len(mine), np.int64)
        old[same], had[same] = w[at[same]], tf[at[same]]
        new = weight(had + own_tf, idf[own]) if len(mine) else np.zeros(0)
        square = np.bincount(row, w * w, minlength=b.num_rows)[of] + np.bincount(doc, new * new - old * old, minlength=len(of))
        scale = np.divide(1.0, np.sqrt(square), out=np.zeros(len(of)), where=square > 0)
        docs, size, more_size = (np.bincount(x, minlength=m) for x, m in ((of, b.num_rows), (row, b.num_rows), (doc, len(of))))
        in_row = np.bincount(of, more_size, b.num_rows).astype(np.int64)
        return [b.column(0), _lists(size, idx[term].astype(np.int32)), _lists(size, w), _lists(docs, scale),
                _lists(docs, more_size.astype(np.int32)), _lists(in_row, idx[own].astype(np.int32)), _lists(in_row, new - old)]

    joined = "more" in tokens.columns
    ints, doubles = T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType())
    kind = T.StructType().add(id_col, tokens.schema[id_col].dataType).add("idx", ints).add("w", doubles)
    if joined:
        kind = kind.add("scale", doubles).add("n", ints).add("more_idx", ints).add("more_w", doubles)
    names = kind.names

    def run(batches):
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays((shared if joined else plain)(b), names=names)

    return tokens.select(id_col, "toks", *(["more"] if joined else [])).mapInArrow(run, kind)


def long_weights(rows: DataFrame, terms: DataFrame, id_col: str) -> DataFrame:
    """``(id, term, w)`` of ``weight_rows``."""
    e = rows.select(id_col, F.explode(F.arrays_zip("idx", "w")).alias("e")).select(id_col, "e.idx", "e.w")
    return e.join(F.broadcast(terms.select("idx", "term")), "idx").select(id_col, "term", "w")


def numbered(vocab: DataFrame) -> DataFrame:
    """The vocabulary with ``idx`` from 0 in the order of terms: at most ``max_features`` rows."""
    return vocab.withColumn("idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))


def fit_rows(corpus_parts: list[tuple[DataFrame, str, str | JoinedText]], ngram_max: int = 2, min_df=P.TFIDF_MIN_DF,
             max_df=P.TFIDF_MAX_DF, max_features: int = P.TFIDF_MAX_FEATURES, sublinear: bool = True,
             unicode: bool = True, stop_words=None, unique: bool = False):
    """L4 by rows: ``(terms, [weight rows per part], [documents per part])``; ``terms`` is
    ``(term, df, idf, idx)``; rows of a ``JoinedText`` are those of its left texts (``weight_rows``).
    Fitting is eager, the terms lie in the shared folder."""
    from talentflow.session import cut_lineage, ship_package
    ship_package(corpus_parts[0][0].sparkSession)
    tokens = [token_rows(df, idc, txt, unicode, stop_words, unique) for df, idc, txt in corpus_parts]
    stats = None
    for i, t in enumerate(tokens):
        part = partial_stats(t, ngram_max, i)
        stats = part if stats is None else stats.unionByName(part)
    st = stats.groupBy("term", "part").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    if isinstance(min_df, int):     # an absolute min_df needs no n_docs: cut the tail first
        st = st.filter(F.col("term").isNull() | (F.col("df") >= min_df))
    st = cut_lineage(st)
    sizes = {r.part: r.df for r in st.filter(F.col("term").isNull()).select("part", "df").collect()}
    sizes = [sizes.get(i, 0) for i in range(len(tokens))]
    vocab = vocabulary_from_stats(st.filter(F.col("term").isNotNull()).drop("part"), sum(sizes), min_df, max_df, max_features)
    terms = cut_lineage(numbered(vocab))
    return terms, [weight_rows(t, terms, idc, ngram_max, sublinear)
                   for t, (_, idc, _) in zip(tokens, corpus_parts)], sizes
