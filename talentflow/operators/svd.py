"""Truncated SVD of a TF-IDF corpus (M3), fitted once and applied to unseen texts.

The fitted model is one table, ``(term, df, idf, idx, v)``: the vocabulary with each
term's row of V. Fitting is a randomised range finder on the term side: a block of
``k + OVERSAMPLE`` directions is multiplied by X'X again and again and made orthonormal in
between, then a Rayleigh-Ritz step on that small space gives the singular values and V.

Scale: a document's weights are one row ``(idx, w)``, or those of a text that documents share
one row with what each of them adds, and a shared text is multiplied once for all its
documents. A pass reads these rows once and each
task returns its sum of ``x (x Q)'`` over its documents, one array for ``SUMMED`` terms, which
Spark adds up by their place. What travels - Q to the tasks, their sums, V - has at most ``max_features``
rows of ``k + OVERSAMPLE`` numbers, whatever the corpus (20 MB with the preset). The dense
products are numpy (BLAS) inside the tasks; terms, counts, weights and norms stay in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentflow.operators import tfidf
from talentflow.plans import presets as P
from talentflow.session import cut_lineage

OVERSAMPLE = 10
ROUNDS = 4
BLOCK, LEFT_BLOCK = 16, 8  # documents and shared texts multiplied at a time
SUMMED = 256  # terms whose sums travel as one array


@dataclass
class TextSvd:
    """``terms`` holds V by term; ``singular`` the singular values, ``energy`` the share of
    the squared weights that the components keep. ``unicode``, ``ngram_max``: how texts are cut."""
    terms: DataFrame
    singular: list[float]
    energy: float
    unicode: bool = True
    ngram_max: int = 2
    _held: list = field(default_factory=list, repr=False)

    @property
    def k(self) -> int:
        return len(self.singular)

    def _v(self):
        """V and its broadcast, read once: rows in the order of ``idx``."""
        if not self._held:
            rows = self.terms.select("idx", "v").toArrow().combine_chunks()  # at most max_features rows
            v = _placed(rows, len(rows), self.k)
            self._held.append(self.terms.sparkSession.sparkContext.broadcast(v))
        return self._held[0]

    def save(self, path: str) -> None:
        spark = self.terms.sparkSession
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        spark.createDataFrame([(self.singular, self.energy, self.unicode, self.ngram_max)],
                              "singular array<double>, energy double, unicode boolean, ngram_max int"
                              ).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextSvd:
        m = spark.read.parquet(f"{path}/model").first()
        return TextSvd(spark.read.parquet(f"{path}/terms"), list(m.singular), m.energy, m.unicode, m.ngram_max)


def _placed(rows: pa.Table, n: int, width: int) -> np.ndarray:
    """The arrays of a table ``(idx, array)`` as rows of a matrix of ``n`` rows."""
    out = np.zeros((n, width))
    if len(rows) and width:
        out[rows.column(0).to_numpy()] = rows.column(1).combine_chunks().flatten().to_numpy().reshape(-1, width)
    return out


def _blocks(batch: pa.RecordBatch, at: int, n_terms: int, size: int = BLOCK):
    """Dense blocks of the weight rows: ``(first row, columns held, rows x columns)``."""
    place, met = np.zeros(n_terms, np.int64), np.zeros(n_terms, bool)
    for lo in range(0, batch.num_rows, size):
        part = batch.slice(lo, size)
        n = np.diff(part.column(at).offsets.to_numpy())
        terms = part.column(at).flatten().to_numpy()
        met[terms] = True
        cols = np.flatnonzero(met)
        met[cols], place[cols] = False, np.arange(len(cols))
        x = np.zeros((part.num_rows, len(cols)))
        x[np.repeat(np.arange(part.num_rows), n), place[terms]] = part.column(at + 1).flatten().to_numpy()
        yield lo, cols, x


def _shared(batch: pa.RecordBatch, n_terms: int):
    """Blocks of the weight rows of left texts: ``(row of each document, scale of each, columns
    held, left texts x columns, blocks of what the documents add)`` and the documents' ids if
    they are there."""
    b = {c: batch.column(c) for c in batch.schema.names}
    ids = b.pop("__row", None)
    at = batch.schema.get_field_index("idx")
    for lo, cols, x in _blocks(batch, at, n_terms, LEFT_BLOCK):
        part = {c: v.slice(lo, len(x)) for c, v in b.items()}
        of = np.repeat(np.arange(len(x)), np.diff(part["scale"].offsets.to_numpy()))
        ends = pa.array(np.append(0, np.cumsum(part["n"].flatten().to_numpy())).astype(np.int32))
        own = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, part[c].flatten()) for c in ("more_idx", "more_w")],
                                         names=["idx", "w"])
        yield (of, part["scale"].flatten().to_numpy()[:, None], cols, x, list(_blocks(own, 0, n_terms)),
               None if ids is None else ids.slice(lo, len(x)).flatten())


def gram_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """``X'X q`` for the weight rows; what comes back has the shape of ``q``."""
    held = rows.sparkSession.sparkContext.broadcast(q)
    joined = "scale" in rows.columns

    def run(batches):
        q, total = held.value, np.zeros_like(held.value)
        for b in batches:
            for _, cols, x in () if joined else _blocks(b, 0, len(q)):
                total[cols] += x.T @ (x @ q[cols])
            for of, scale, cols, x, own, _ in _shared(b, len(q)) if joined else ():
                left = x @ q[cols]
                back = np.zeros_like(left)
                for lo, more, e in own:
                    at = slice(lo, lo + len(e))
                    y = scale[at] * scale[at] * (left[of[at]] + e @ q[more])
                    total[more] += e.T @ y
                    back += (of[at] == np.arange(len(x))[:, None]).astype(float) @ y
                total[cols] += x.T @ back
        for lo in range(0, len(total), SUMMED):
            part = total[lo:lo + SUMMED].ravel()
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lo], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))],
                    names=["lo", "y"])

    # a task returns as much as ``q`` whatever it read: no more tasks than keep the cores busy
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() // 4)
    sums = (rows.select(*rows.columns[1:]).coalesce(tasks).mapInArrow(run, "lo int, y array<double>")
            .groupBy("lo").agg(vector_to_array(Summarizer.sum(array_to_vector("y"))).alias("y")).toArrow())
    held.unpersist()
    out = np.zeros_like(q)
    for lo, y in zip(sums.column("lo").to_pylist(), sums.column("y")):
        out[lo:lo + SUMMED] = y.values.to_numpy().reshape(-1, q.shape[1])
    return out


def _upright(v: np.ndarray) -> np.ndarray:
    """Each component's largest entry made positive, so that signs do not depend on chance."""
    top = np.abs(v).argmax(axis=0)
    return v * np.where(v[top, np.arange(v.shape[1])] < 0, -1.0, 1.0)


def fit(docs: DataFrame, text_col: str | tfidf.JoinedText, k: int = P.SVD_COMPONENTS, max_features: int = P.CLASSIFIER_MAX_FEATURES,
        min_df=P.TFIDF_MIN_DF, max_df=P.TFIDF_MAX_DF, ngram_max: int = 2, unicode: bool = True,
        rounds: int = ROUNDS, seed: int = P.SEED) -> TextSvd:
    """M3 fit: TF-IDF on ``docs`` alone, then the ``k`` largest components (fewer if there are
    fewer terms or documents). Null and empty texts count as documents without terms. A corpus
    without a known term gives a model of no components."""
    spark = docs.sparkSession
    docs = docs.withColumn("__row", F.monotonically_increasing_id())
    terms, (rows,), (n_docs,) = tfidf.fit_rows([(docs, "__row", text_col)], ngram_max, min_df, max_df, max_features,
                                               unicode=unicode, unique=True)
    rows = cut_lineage(rows)
    n_terms = terms.count()
    # a document with a known term has weights of length 1
    square = (F.size(F.filter("scale", lambda x: x > 0)).cast("double") if "scale" in rows.columns
              else F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x))
    energy = rows.agg(F.sum(square).alias("e")).first().e or 0.0
    k = min(k, n_terms, n_docs)
    size = min(k + OVERSAMPLE, n_terms)
    if energy == 0.0:
        return TextSvd(terms.withColumn("v", F.array().cast("array<double>")), [], 0.0, unicode, ngram_max)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, size)))[0]
    for _ in range(rounds - 1):
        q = np.linalg.qr(gram_times(rows, q))[0]
    value, turn = np.linalg.eigh(q.T @ gram_times(rows, q))
    order = np.argsort(-value, kind="stable")[:k]
    order = order[value[order] > energy * 1e-12]
    v = _upright(q @ turn[:, order])
    ends = np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]
    table = spark.createDataFrame(pa.table({"idx": pa.array(np.arange(len(v)), pa.int32()),
                                            "v": pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel()))}))
    terms = cut_lineage(terms.join(table, "idx").select("term", "df", "idf", "idx", "v"))
    return TextSvd(terms, np.sqrt(value[order]).tolist(), float(value[order].sum() / energy), unicode, ngram_max)


def transform(model: TextSvd, docs: DataFrame, text_col: str | tfidf.JoinedText, out_col: str = "svd") -> DataFrame:
    """M3 / M21 transform: ``docs`` with ``out_col``, the document's weights times V
    (``array<double>``). Seen or unseen texts; one without a known term has zeros.

    For a ``JoinedText`` the columns of a document travel with its texts, so that its components,
    many times their size, are not shuffled to it."""
    joined = isinstance(text_col, tfidf.JoinedText)
    if joined:
        keys = [F.col(f"`{c}`") for c in (text_col.left_key, text_col.right_key)]
        docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *keys)
    else:
        docs = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()))
    tokens = tfidf.token_rows(docs, "__row", text_col, model.unicode, unique=True)
    held, k = model._v(), model.k

    def batch(ids, y):
        ends = np.arange(len(y) + 1, dtype=np.int32) * k
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel()))], names=["__row", "__y"])

    def run(batches):
        v = held.value
        for b in batches:
            if "scale" not in b.schema.names:
                for lo, cols, x in _blocks(b, 1, len(v)):
                    yield batch(b.column(0).slice(lo, len(x)), x @ v[cols])
                continue
            for of, scale, cols, x, own, ids in _shared(b, len(v)):
                y = scale * (x @ v[cols])[of]
                for lo, more, e in own:
                    y[lo:lo + len(e)] += scale[lo:lo + len(e)] * (e @ v[more])
                yield batch(ids, y)

    kind = T.StructType().add("__row", docs.schema["__row"].dataType).add("__y", T.ArrayType(T.DoubleType()))
    y = tfidf.weight_rows(tokens, model.terms, "__row", model.ngram_max).mapInArrow(run, kind)
    if joined:  # each left text names all its documents
        return y.select("__row.*", F.col("__y").alias(out_col))
    zero = F.array_repeat(F.lit(0.0), k)
    return docs.join(y, "__row", "left").withColumn(out_col, F.coalesce("__y", zero)).drop("__row", "__y")
