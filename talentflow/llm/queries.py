"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentflow.llm import (crc_resampling, decontaminate, gru_lm, langid_cnn, line_templates, ngram_join, nra_search,
                             pq_dedup, quality_rules, repair_shards, sp_sampling, token_counts, url_redirects)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = decontaminate.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return j.select(F.col("doc").alias("doc_id"), "n_words", "n_hit",
                    F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    c = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return c.select(F.col("doc").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def _fold(of: int):
    """crc32 of the document's id as text, modulo ``of``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of))


@_query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    train = docs.filter(_fold(4) != 2)
    model = quality_rules.fit(train, _table(spark, sf_dir, "labels"))
    return quality_rules.score(docs, model).select(
        "doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid_cnn.fit(docs.filter(_fold(3) != 1))
    return langid_cnn.predict(docs, model).select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@_query
def op4_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = url_redirects.judge(_table(spark, sf_dir, "pages"))
    return j.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


@_query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))
    return judged.withColumnRenamed("doc", "doc_id")


@_query
def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs).withColumnRenamed("__dropped", "n_dropped")


@_query
def op9_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_vectors(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@_query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = gru_lm.fit(docs, F.coalesce(_fold(7) != 2, F.lit(True)))
    return gru_lm.score(docs, model).withColumnRenamed("doc", "doc_id").select(
        "doc_id", F.coalesce(_fold(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score")


@_query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("was"))
    ids = sp_sampling.encode(docs, model, keep=("doc_id", "was"))
    return sp_sampling.decode(ids, model).select(
        "doc_id", F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_pieces"), "ids",
        (F.xxhash64("decoded") == F.col("was")).alias("lossless"))


@_query
def op11_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nra_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


@_query
def op12_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    rows = repair_shards.write_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return rows.withColumnRenamed("doc", "doc_id")


@_query
def op13_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = crc_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("doc").alias("doc_id"), "n_features", "weight", "score", "rank")


ORACLES["op4_url_redirects"] = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
named AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
rules(rule, own, rank) AS (VALUES ('org/', 'allow', 4), ('example.org/es/', 'block', 15), ('example.org/en/1', 'block', 16),
                                  ('com/fr/', 'allow', 7), ('com/de/', 'block', 7)),
fits AS (
  SELECT n.page_id, r.rule, r.own, row_number() OVER (PARTITION BY n.page_id ORDER BY r.rank DESC, r.rule) AS k
  FROM named n JOIN rules r ON (n.host = split_part(r.rule, '/', 1) OR ends_with(n.host, '.' || split_part(r.rule, '/', 1)))
                           AND starts_with(n.path, substr(r.rule, strpos(r.rule, '/'))))
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.own, 'allow') AS verdict
FROM named n LEFT JOIN fits f ON n.page_id = f.page_id AND f.k = 1
-- no page of these tables has a canonical link or a refresh, so that every alias class is one url
"""

ORACLES["op11_nra_search"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM documents),
tf AS (
  SELECT doc_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf
  FROM words GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS cn, sum(n)::BIGINT AS cl FROM docs),
wanted AS (
  SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * cn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, cn),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * cn) // cl))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN docs USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
