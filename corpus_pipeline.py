"""A corpus pipeline: each stage reads what its predecessor kept.

``run(spark, sf_dir)`` applies the stages to ``documents``; between two stages the documents
are written as Parquet in the shared checkpoint folder and read again. All stages but the
last return the columns of ``documents``:

1. language ID: documents to which the network gives no language (no text, no letter) go;
2. line dedup: lines whose template recurs across documents are cut out of the texts;
3. n-gram Jaccard join: of each group of near-duplicates the smallest id stays;
4. benchmark decontamination: contaminated documents go;
5. SentencePiece encoding and decoding: sampled ids and the text that they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentflow.llm import decontaminate, langid_cnn, line_templates, ngram_join, sp_sampling
from talentflow.llm.store import drop_tables, free_name, materialise

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to which the network, trained on their ``lang``, gives a language, however
    close a second one comes. Null texts and texts without a letter go."""
    model = langid_cnn.fit(docs)
    lang, score = free_name(docs, "__lang"), free_name(docs, "__score")
    seen = langid_cnn.predict(docs, model, keep=tuple(docs.columns), lang_out=lang, score_out=score)
    return seen.filter(F.col(lang) != langid_cnn.UNKNOWN).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without recurring lines; ``n_chars`` follows the text."""
    gone = free_name(docs, "__dropped")
    cut = line_templates.drop_recurring_lines(docs, out_col=gone)
    n_chars = F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similarity 0.8 or more: the smallest id."""
    return ngram_join.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with ``benchmark``."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_chars``, the sampled ``ids`` and the ``text`` they decode to."""
    # written between the two, so that a task holds one Python worker at a time
    ids = materialise(sp_sampling.encode(docs, PIECE_MODEL, keep=("doc_id", "lang", "source", "n_chars")), "piece-ids")
    return sp_sampling.decode(ids, PIECE_MODEL, out_col="text")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: the stages hold a trained network and sampled segmentations, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_tables(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
