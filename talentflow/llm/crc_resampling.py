"""Target-distribution importance resampling by prefix CRCs (operator 13).

A text's words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; its
features are all runs of 1 to ``n_max`` consecutive words joined by one space, and a
feature's bucket is the CRC-32 of its bytes modulo ``buckets``. Each text is rewritten once
as its words with one separator after each, and scanned once: the running CRC register is
kept, and the CRC of any feature follows from the registers at its two ends. The CRC
without its start and end values is linear over GF(2), so that the register at the start,
shifted by the feature's length in zero bytes, cancels whatever came before it.

The corpus and the target give bucket counts; the logarithm of their smoothed ratio is a
bucket's gain, a document's weight is the mean gain of its features, and the documents
with the highest weight plus Gumbel noise (from a hash of the id) are drawn: sampling
without replacement in proportion to the exponential of the weight.

Scale: two scans of the texts. A task returns its bucket counts (``buckets`` rows at most)
from the first, so that what is shuffled does not depend on the texts; the gains (one
number a bucket) go to all tasks of the second. The draw orders narrow rows by a range
partitioning on (score, id, row) - rows of equal score or id are split too - and numbers
them by the partitions' sizes, so that no task sorts all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentflow.llm import kernel as K
from talentflow.llm.store import map_arrow, materialise

POLYNOMIAL = 0xEDB88320  # CRC-32, reflected
LANE = 256
_FULL = np.uint32(0xFFFFFFFF)
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step by a byte ``(256,)``; shifts by 0..LANE-1 zero bytes ``(LANE, 4, 256)`` and by
    2^k zero bytes ``(48, 4, 256)``, each as one look-up for each byte of the register."""
    if not _TABLES:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
        near = np.empty((LANE, 4, 256), np.uint32)
        near[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
        for n in range(1, LANE):
            near[n] = step[near[n - 1] & 255] ^ (near[n - 1] >> 8)
        far = np.empty((48, 4, 256), np.uint32)
        far[0] = near[1]
        for k in range(1, len(far)):
            far[k] = _look_up(far[k - 1], far[k - 1])
        _TABLES.extend((step, near, far))
    return tuple(_TABLES)


def _look_up(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (table[0][x & 255] ^ table[1][(x >> 8) & 255]
            ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24])


def shift(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each register after ``n`` zero bytes."""
    _, near, far = _tables()
    flat, at = near.ravel(), (n & (LANE - 1)) * 1024
    out = (flat[at + (x & 255)] ^ flat[at + 256 + ((x >> 8) & 255)]
           ^ flat[at + 512 + ((x >> 16) & 255)] ^ flat[at + 768 + (x >> 24)])
    more = np.flatnonzero(n >= LANE)
    if len(more):
        y, left = out[more], n[more]
        for k in range(LANE.bit_length() - 1, int(left.max()).bit_length()):
            bit = (left >> k) & 1 == 1
            y[bit] = _look_up(far[k], y[bit])
        out[more] = y
    return out


class RunningCrc:
    """The CRC register (start value 0) before every byte of ``data``; one pass, in lanes
    that are joined afterwards."""

    def __init__(self, data: np.ndarray):
        step, _, far = _tables()
        lanes = len(data) // LANE + 1
        cells = np.zeros(lanes * LANE, np.uint8)
        cells[:len(data)] = data
        cells = np.ascontiguousarray(cells.reshape(lanes, LANE).T)
        self.local = np.zeros((LANE + 1, lanes), np.uint32)
        for k in range(LANE):
            c = self.local[k]
            self.local[k + 1] = step[(c ^ cells[k]) & 255] ^ (c >> 8)
        whole, d = self.local[LANE].copy(), 1
        while d < lanes:
            k = (d * LANE).bit_length() - 1
            joined = whole[d:] ^ _look_up(far[k], whole[:-d])
            whole[d:] = joined
            d *= 2
        self.head = np.concatenate((np.zeros(1, np.uint32), whole[:-1]))

    def at(self, pos: np.ndarray) -> np.ndarray:
        lane, off = pos // LANE, pos % LANE
        return shift(self.head[lane], off) ^ self.local[off, lane]


def feature_crcs(data: np.ndarray, offsets: np.ndarray, n_max: int):
    """``(words, [(row, crc) for each n])`` of a slice of texts: the CRC-32 of every run of
    1 to ``n_max`` words of one row."""
    step, _, _ = _tables()
    low = K.LOWER[data]
    w = K.find_words(low, offsets, K.WORD_BYTES)
    size = w.ends - w.starts
    first = np.concatenate((np.zeros(1, np.int64), np.cumsum(size + 1)))
    norm = np.full(int(first[-1]), 32, np.uint8)
    letter = np.ones(len(norm), bool)
    letter[first[1:] - 1] = False
    norm[letter] = low[K.WORD_BYTES[low]]
    del letter, low
    end = RunningCrc(norm).at(first[1:] - 1)             # before the separator of each word
    start = np.zeros_like(end)
    start[1:] = (step[(end ^ 32) & 255] ^ (end >> 8))[:-1]
    out = []
    for n in range(1, n_max + 1):
        k = max(len(w) - n + 1, 0)
        lo = np.flatnonzero(w.row[:k] == w.row[n - 1:n - 1 + k])
        hi = lo + n - 1
        length = first[hi] + size[hi] - first[lo]
        out.append((w.row[lo], end[hi] ^ shift(start[lo] ^ _FULL, length) ^ _FULL))
    return w, out


def bucket_counts(df: DataFrame, text_col: str, n_max: int, buckets: int) -> DataFrame:
    """``bucket, n``: the features of all texts by bucket (buckets without a feature are
    absent)."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for s in K.slices(b.column(0)):
                for _, crc in feature_crcs(s.data, s.offsets, n_max)[1]:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    rows = df.select(F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """``floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))`` for each of the B buckets."""
    zero = F.lit(0).cast("long")
    both = materialise(raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
            .join(raw.withColumnRenamed("n", "s"), "bucket", "left")
            .join(target.withColumnRenamed("n", "t"), "bucket", "left")
            .select("bucket", F.coalesce("s", zero).cast("double").alias("s"), F.coalesce("t", zero).cast("double").alias("t")), "bucket-counts")
    total = both.agg(F.sum("s").alias("of_raw"), F.sum("t").alias("of_target")).first()
    ratio = ((F.col("t") + 1) * F.lit(total.of_raw + buckets)
             / ((F.col("s") + 1) * F.lit(total.of_target + buckets)))
    rows = both.select("bucket", F.floor(1000 * F.log(ratio)).alias("g")).collect()  # one row a bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.g
    return out


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, n_max: int) -> DataFrame:
    """``doc, n_words, n_features, weight`` for every row: the floored mean gain, 0 without
    features."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = held.value
        for b in batches:
            for s in K.slices(b.column(1)):
                w, grams = feature_crcs(s.data, s.offsets, n_max)
                n = np.zeros(s.rows, np.int64)
                total = np.zeros(s.rows, np.int64)
                for row, crc in grams:
                    n += np.bincount(row, minlength=s.rows)
                    # exact: the sums stay far below 2^53
                    total += np.bincount(row, weights=gain[crc % np.uint32(len(gain))], minlength=s.rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.lo, s.rows), pa.array(np.bincount(w.row, minlength=s.rows), pa.int64()),
                     pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, f"doc {kind}, n_words long, n_features long, weight long")


def with_ranks(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) in ``order``, which must leave no ties: one range
    partitioning, then each partition's places begin after those of the ones before it."""
    spark = rows.sparkSession
    mask = (1 << 33) - 1  # the low bits of monotonically_increasing_id count a partition's rows
    placed = materialise(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit(mask))), "placed")
    ends = sorted((r["__part"], r.n) for r in placed.groupBy("__part").agg(F.max("__at").alias("n")).collect())  # one row a partition
    before, table = 0, []
    for part, n in ends:
        table.append((part, before))
        before += n + 1
    offsets = spark.createDataFrame(table, "__part int, __before long")
    return (placed.join(F.broadcast(offsets), "__part")
            .withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", n_max: int = 1, buckets: int = 10_000, min_words: int = 20,
             percent: int = 10, seed: str = "2024") -> DataFrame:
    """One row per document: ``doc, n_words, n_features, weight, score, rank``.

    Of the N documents with at least ``min_words`` words the ``floor(percent * N / 100)``
    with the highest score are drawn; ``rank`` is their order (ties to the smaller id), null
    for all others. Null and empty texts have no words: weight 0, never drawn. A repeated row
    is a document of its own; a null id is hashed as an empty one and comes last among ties.
    An empty corpus gives no row, an empty target equal counts. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, n_max, buckets),
                 bucket_counts(target, target_text_col, n_max, buckets), buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = materialise(weigh(docs, gain, id_col, text_col, n_max)
                         .withColumn("score", F.col("weight") + gumbel)
                         .withColumn("__fit", F.col("n_words") >= min_words)
                         .withColumn("__row", F.monotonically_increasing_id()), "scored")
    quota = scored.agg(F.count_if("__fit").alias("n")).first().n * percent // 100
    placed = with_ranks(scored, [F.col("__fit").desc(), F.col("score").desc(), F.col("doc").asc_nulls_last(), F.col("__row")])
    return placed.select("doc", "n_words", "n_features", "weight", "score",
                         F.when(F.col("place") <= quota, F.col("place")).alias("rank"))
