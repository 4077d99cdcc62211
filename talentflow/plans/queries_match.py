"""TF-IDF, similarity matching and dedup bindings.

Left side ("resumes") = ``documents``, right side ("jobs") = ``benchmark``.
Oracle-bound runs use ASCII token classes so RE2 and Java agree.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talentflow.functions import extract as X
from talentflow.operators import dedup as DD
from talentflow.operators import matching as MT
from talentflow.operators import tfidf as TF
from talentflow.plans import presets as P
from talentflow.plans.catalog import query
from talentflow.plans.oracle_text import (block_pairs_sql, dict_sql, sql_str, tfidf_corpus_sql,
                                          topk_sql)
from talentflow.session import cut_lineage
from talentflow.sources import io

# Word dictionary for the skill side of the hybrid score on invented prose
# (whole words, explicit ASCII boundaries so Java and RE2 agree).
WORDS = ["the", "and", "with", "that", "this", "les", "des", "que", "der", "und", "los", "por"]
WORD_PATTERNS = {w: X.ascii_word_pattern(w) for w in WORDS}
CORPUS = [("d", "documents", "doc_id", "text"), ("b", "benchmark", "item_id", "text")]


def _docs(spark, d):
    return io.read_table(spark, d, "documents").select("doc_id", "text").filter(F.col("text").isNotNull())


def _bench(spark, d):
    return io.read_table(spark, d, "benchmark").select("item_id", "text").filter(F.col("text").isNotNull())


def _corpus(spark, d):
    return [(_docs(spark, d), "doc_id", "text"), (_bench(spark, d), "item_id", "text")]


def _weights(spark, d):
    return TF.fit_transform(_corpus(spark, d), unicode=False)


@query("tfidf_weights", f"""WITH {tfidf_corpus_sql(CORPUS)}
SELECT id AS doc_id, term, round(w, 6) AS w FROM wn WHERE side = 'd'""")
def tfidf_weights(spark, d):
    _, (dw, _) = _weights(spark, d)
    return dw.select("doc_id", "term", F.round("w", 6).alias("w"))


@query("tfidf_vocabulary", f"""WITH {tfidf_corpus_sql(CORPUS)}
SELECT term, df, round(idf, 6) AS idf FROM vocab""")
def tfidf_vocabulary(spark, d):
    vocab, _ = _weights(spark, d)
    return vocab.select("term", "df", F.round("idf", 6).alias("idf"))


@query("match_topk", f"""WITH {tfidf_corpus_sql(CORPUS)},
{topk_sql('d', 'b', 'doc_id', 'item_id')}
SELECT doc_id, item_id, round(text_similarity, 6) AS text_similarity, text_rank FROM topk""")
def match_topk(spark, d):
    _, (dw, bw), sizes = TF.fit_rows(_corpus(spark, d), unicode=False)
    top = MT.cosine_topk(dw, bw, "doc_id", "item_id", P.TOP_K, _docs(spark, d), _bench(spark, d), *sizes)
    return top.withColumn("text_similarity", F.round("text_similarity", 6))


HYBRID_SQL = f"""WITH {tfidf_corpus_sql(CORPUS)},
{topk_sql('d', 'b', 'doc_id', 'item_id')},
dsk AS (SELECT doc_id, {dict_sql('text', WORD_PATTERNS)} AS rs FROM documents WHERE text IS NOT NULL),
bsk AS (SELECT item_id, {dict_sql('text', WORD_PATTERNS)} AS js FROM benchmark WHERE text IS NOT NULL),
sc AS (
  SELECT t.doc_id, t.item_id, t.text_similarity,
         coalesce(dsk.rs, []::VARCHAR[]) AS rs, coalesce(bsk.js, []::VARCHAR[]) AS js
  FROM topk t LEFT JOIN dsk ON t.doc_id = dsk.doc_id LEFT JOIN bsk ON t.item_id = bsk.item_id),
sc2 AS (
  SELECT doc_id, item_id, text_similarity,
         list_sort(list_intersect(rs, js)) AS matching_skills,
         list_sort(list_filter(js, lambda x: NOT list_contains(rs, x))) AS missing_skills,
         CASE WHEN len(js) > 0 THEN round(len(list_intersect(rs, js))::DOUBLE / len(js), 4)
              ELSE 0.0::DOUBLE END AS skill_overlap
  FROM sc),
sc3 AS (
  SELECT *, round(100.0::DOUBLE * (0.7::DOUBLE * text_similarity + 0.3::DOUBLE * skill_overlap), 1)
              AS final_match_score,
         round(text_similarity * 100.0::DOUBLE, 1) AS text_match_pct,
         round(skill_overlap * 100.0::DOUBLE, 1) AS skill_overlap_pct
  FROM sc2),
hm AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY final_match_score DESC,
                               text_similarity DESC, item_id) AS rank,
         CASE WHEN final_match_score >= 40 THEN 'Highly Suitable'
              WHEN final_match_score >= 20 THEN 'Suitable' ELSE 'Not Suitable' END AS suitability
  FROM sc3)"""


def _hybrid(spark, d):
    docs = _docs(spark, d)
    skills = docs.select("doc_id", X.dict_extract("text", WORD_PATTERNS, unicode=False).alias("skill_set"))
    return MT.hybrid_match(docs, _bench(spark, d), "doc_id", "item_id", "text", "text", skills,
                           WORD_PATTERNS, k=P.TOP_K, unicode=False)


@query("hybrid_match", HYBRID_SQL + "\nSELECT * REPLACE (round(text_similarity, 6) AS text_similarity) FROM hm")
def hybrid_match(spark, d):
    return _hybrid(spark, d).withColumn("text_similarity", F.round("text_similarity", 6))


@query("best_match", HYBRID_SQL + """
SELECT doc_id, item_id, final_match_score, suitability FROM hm WHERE rank = 1""")
def best_match(spark, d):
    return MT.best_match(_hybrid(spark, d).withColumnRenamed("doc_id", "candidate_id")) \
             .select(F.col("candidate_id").alias("doc_id"), "item_id", "final_match_score", "suitability")


@query("match_summary", HYBRID_SQL + """
SELECT count(DISTINCT doc_id) AS n_candidates_matched, count(*) AS n_pairs,
       round(avg(final_match_score), 2) AS avg_final_match_score,
       count(*) FILTER (WHERE suitability = 'Highly Suitable') AS highly_suitable,
       count(*) FILTER (WHERE suitability = 'Suitable') AS suitable,
       count(*) FILTER (WHERE suitability = 'Not Suitable') AS not_suitable
FROM hm""")
def match_summary(spark, d):
    s = MT.match_summary(_hybrid(spark, d).withColumnRenamed("doc_id", "candidate_id"))
    m = F.col("suitability_counts")
    return s.select("n_candidates_matched", "n_pairs", "avg_final_match_score",
                    F.coalesce(m["Highly Suitable"], F.lit(0)).alias("highly_suitable"),
                    F.coalesce(m["Suitable"], F.lit(0)).alias("suitable"),
                    F.coalesce(m["Not Suitable"], F.lit(0)).alias("not_suitable"))


@query("display_view", HYBRID_SQL + """
SELECT doc_id AS "Candidate", item_id AS "Job Role", final_match_score AS "Match Score(%)", rank,
       suitability FROM hm ORDER BY doc_id, rank LIMIT 50""")
def display_view(spark, d):
    h = _hybrid(spark, d).withColumnRenamed("doc_id", "candidate_id") \
                         .withColumn("job_title", F.col("item_id"))
    return MT.display_view(h, 50)


@query("candidates_for_item", f"""WITH {tfidf_corpus_sql(CORPUS)},
shared AS (
  SELECT l.id AS doc_id, r.id AS item_id, round(sum(l.w * r.w), 12) AS s
  FROM wn l JOIN wn r ON l.term = r.term AND l.side = 'd' AND r.side = 'b' GROUP BY l.id, r.id),
pairs AS (
  SELECT a.doc_id, b.item_id, coalesce(s, 0) AS text_similarity
  FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) a
  CROSS JOIN (SELECT item_id FROM benchmark WHERE text IS NOT NULL) b
  LEFT JOIN shared ON shared.doc_id = a.doc_id AND shared.item_id = b.item_id),
short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id
            ORDER BY text_similarity DESC, doc_id) AS s FROM pairs) x WHERE s <= 15),
dsk AS (SELECT doc_id, {dict_sql('text', WORD_PATTERNS)} AS rs FROM documents WHERE text IS NOT NULL),
bsk AS (SELECT item_id, {dict_sql('text', WORD_PATTERNS)} AS js FROM benchmark WHERE text IS NOT NULL),
sc AS (SELECT s.doc_id, s.item_id, s.text_similarity,
         coalesce(dsk.rs, []::VARCHAR[]) AS rs, coalesce(bsk.js, []::VARCHAR[]) AS js
       FROM short s LEFT JOIN dsk ON s.doc_id = dsk.doc_id LEFT JOIN bsk ON s.item_id = bsk.item_id),
sc2 AS (SELECT doc_id, item_id, text_similarity,
         CASE WHEN len(js) > 0 THEN round(len(list_intersect(rs, js))::DOUBLE / len(js), 4)
              ELSE 0.0::DOUBLE END AS skill_overlap FROM sc),
sc3 AS (SELECT *, round(100.0::DOUBLE * (0.7::DOUBLE * text_similarity + 0.3::DOUBLE * skill_overlap), 1)
          AS final_match_score FROM sc2)
SELECT doc_id, item_id, final_match_score, rank,
       CASE WHEN final_match_score >= 40 THEN 'Highly Suitable'
            WHEN final_match_score >= 20 THEN 'Suitable' ELSE 'Not Suitable' END AS suitability
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final_match_score DESC,
        text_similarity DESC, doc_id) AS rank FROM sc3) x WHERE rank <= 5""")
def candidates_for_item(spark, d):
    """Every document scored on demand against every requested job (here:
    all benchmark items), shortlist 3n by text, blend with skills, keep 5."""
    _, (dw, bw), _ = TF.fit_rows(_corpus(spark, d), unicode=False)
    docs, bench = _docs(spark, d), _bench(spark, d)
    req = bench.select("item_id")
    ls = docs.select("doc_id", X.dict_extract("text", WORD_PATTERNS, unicode=False).alias("skill_set"))
    js = bench.join(req, "item_id", "left_semi").select(
        "item_id", X.dict_extract("text", WORD_PATTERNS, unicode=False).alias("job_skill_set"))
    out = MT.candidates_for_job(dw, bw, req, ls, js, "doc_id", "item_id", top_n=5)
    return out.select("doc_id", "item_id", "final_match_score", "rank", "suitability")


# --------------------------------------------------------------------- dedup

@query("dedup_exact", """SELECT doc_id, source, n_chars FROM documents
WHERE text IS NULL OR doc_id IN (SELECT min(doc_id) FROM documents WHERE text IS NOT NULL GROUP BY text)""")
def dedup_exact(spark, d):
    docs = io.read_table(spark, d, "documents").select("doc_id", "text", "source", "n_chars")
    return DD.dedup_exact(docs, "text", "doc_id").select("doc_id", "source", "n_chars")


PARTIAL_KEYS = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@query("dedup_partial", """SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_custkey IS NULL OR o_orderstatus IS NULL OR o_orderpriority IS NULL
   OR o_orderkey IN (SELECT min(o_orderkey) FROM orders
                     WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL
                     GROUP BY o_custkey, o_orderstatus, o_orderpriority)""")
def dedup_partial(spark, d):
    o = io.read_table(spark, d, "orders").select("o_orderkey", *PARTIAL_KEYS)
    return DD.dedup_keys(o, PARTIAL_KEYS, "o_orderkey")


DISTINCT_SQL = """dx AS (
  SELECT * FROM documents WHERE text IS NULL
     OR doc_id IN (SELECT min(doc_id) FROM documents WHERE text IS NOT NULL GROUP BY text))"""


def _distinct_docs(spark, d):
    docs = io.read_table(spark, d, "documents").select("doc_id", "text", "source")
    return DD.dedup_exact(docs, "text", "doc_id")


@query("semantic_dups", f"""WITH {DISTINCT_SQL},
{block_pairs_sql('dx', 'doc_id', 'text', 'source')}
SELECT * FROM bpairs""")
def semantic_dups(spark, d):
    """J3 on what exact deduplication leaves, as the pipeline runs it."""
    return DD.near_duplicate_pairs(_distinct_docs(spark, d), "doc_id", "text", "source", "doc_id", unicode=False)


@query("semantic_dedup", f"""WITH {DISTINCT_SQL},
{block_pairs_sql('dx', 'doc_id', 'text', 'source')}
SELECT doc_id, source FROM dx WHERE doc_id NOT IN (SELECT duplicate_id FROM bpairs)""")
def semantic_dedup(spark, d):
    exact = cut_lineage(_distinct_docs(spark, d))  # read for the pairs and for the result
    pairs = DD.near_duplicate_pairs(exact, "doc_id", "text", "source", "doc_id", unicode=False)
    return DD.drop_duplicate_ids(exact, pairs, "doc_id").select("doc_id", "source")


@query("lsh_links", f"""WITH {DISTINCT_SQL},
{block_pairs_sql('dx', 'doc_id', 'text', 'source')}
SELECT doc_id, count(*) AS n_links FROM (
  SELECT doc_id FROM bpairs UNION ALL SELECT duplicate_id FROM bpairs) x GROUP BY doc_id""")
def lsh_links(spark, d):
    """J5 on the documents of J3; a pair at the threshold is missed with probability 1e-5."""
    members, pairs = DD.lsh_classes(
        DD.block_weights(_distinct_docs(spark, d), "doc_id", "text", "source", "doc_id", unicode=False,
                         threshold=P.SEMANTIC_THRESHOLD, by_row=True), "doc_id", recall=1 - 1e-5, block="source")
    return DD.link_counts(members, pairs, "doc_id")


@query("latest_snapshot", """SELECT event_id, ts, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS FIRST, event_id DESC) AS r
  FROM events WHERE user_id IS NOT NULL) x WHERE r = 1""")
def latest_snapshot(spark, d):
    ev = io.read_table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return DD.latest_per_key(ev, "user_id", "ts", ["event_id"])


@query("keep_first_flag", """SELECT event_id, user_id, event_type,
  event_id <> min(event_id) OVER (PARTITION BY user_id, event_type) AS is_duplicate FROM events""")
def keep_first_flag(spark, d):
    ev = io.read_table(spark, d, "events").select("event_id", "user_id", "event_type")
    return DD.flag_duplicates(ev, ["user_id", "event_type"], "event_id")
