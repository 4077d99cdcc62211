"""SQL builders shared by the text / TF-IDF / dedup oracle queries (DuckDB).

They spell out in SQL exactly the formulas the Spark operators implement, so
the oracle is an independent, brute-force re-computation (all pairs that share
a term, plain window functions) of the same result.
"""

from __future__ import annotations

from talentflow.plans import presets as P

ASCII_TOKEN = "[a-z0-9_]{2,}"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(sql_str(x) for x in items) + "]::VARCHAR[]"


def stop_words_sql() -> str:
    return sql_list(P.spark_stop_words())


def tokens_sql(text: str) -> str:
    """ASCII unigram tokens of lower(text) minus Spark's English stop words."""
    return (f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '{ASCII_TOKEN}'), "
            f"lambda x: NOT list_contains({stop_words_sql()}, x))")


def ngrams_sql(t: str) -> str:
    """Unigrams followed by space-joined bigrams of token list ``t``."""
    return f"list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


def tfidf_corpus_sql(parts: list[tuple[str, str, str, str]], min_df=P.TFIDF_MIN_DF,
                     max_df=P.TFIDF_MAX_DF, max_features=P.TFIDF_MAX_FEATURES) -> str:
    """CTEs ``corpus, tf, vocab, wn`` for a vocabulary fitted on all parts.

    ``parts``: ``[(side_tag, table, id_col, text_col)]``; ``wn`` holds
    ``(side, id, term, w)`` with sublinear, smooth-idf, L2-normalised weights.
    """
    union = "\n    UNION ALL ".join(
        f"SELECT {sql_str(tag)} AS side, {idc} AS id, {txt} AS text FROM {tbl} WHERE {txt} IS NOT NULL"
        for tag, tbl, idc, txt in parts)
    lo = min_df if isinstance(min_df, int) else f"{min_df} * n"
    hi = max_df if isinstance(max_df, int) else f"{max_df} * n"
    lim = f"LIMIT {max_features}" if max_features else ""
    return f"""corpus AS (
    {union}),
toks AS (SELECT side, id, {tokens_sql('text')} AS t FROM corpus),
terms AS (SELECT side, id, unnest({ngrams_sql('t')}) AS term FROM toks),
tf AS (SELECT side, id, term, count(*) AS tf FROM terms GROUP BY side, id, term),
ncount AS (SELECT count(*)::DOUBLE AS n FROM corpus),
vocab AS (
  SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM (
    SELECT s.term, s.df, s.total, ncount.n FROM (
      SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term) s, ncount
    WHERE s.df >= {lo} AND s.df <= {hi}
    ORDER BY s.total DESC, s.term {lim}) v),
w0 AS (SELECT side, id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term)),
wn AS (SELECT side, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS w FROM w0)"""


def topk_sql(left: str, right: str, lid: str, rid: str, k: int = P.TOP_K) -> str:
    """CTEs ``pairs, topk`` (needs ``corpus``, ``wn``): every left text has k rows, or as many as
    there are right texts; a pair that shares no term has similarity 0."""
    return f"""shared AS (
  SELECT l.id AS {lid}, r.id AS {rid}, round(sum(l.w * r.w), 12) AS s
  FROM wn l JOIN wn r ON l.term = r.term AND l.side = {sql_str(left)} AND r.side = {sql_str(right)}
  GROUP BY l.id, r.id),
pairs AS (
  SELECT a.id AS {lid}, b.id AS {rid}, coalesce(s, 0) AS s
  FROM (SELECT DISTINCT id FROM corpus WHERE side = {sql_str(left)}) a
  CROSS JOIN (SELECT DISTINCT id FROM corpus WHERE side = {sql_str(right)}) b
  LEFT JOIN shared ON shared.{lid} = a.id AND shared.{rid} = b.id),
topk AS (
  SELECT {lid}, {rid}, s AS text_similarity, text_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY {lid} ORDER BY s DESC, {rid}) AS text_rank FROM pairs) x
  WHERE text_rank <= {k})"""


def dict_sql(text: str, patterns: dict[str, str]) -> str:
    """Sorted names whose case-insensitive pattern is found in ``text``."""
    hits = ", ".join(f"CASE WHEN regexp_matches({text}, {sql_str(p)}, 'i') THEN {sql_str(n)} END"
                     for n, p in patterns.items())
    return f"coalesce(list_sort(list_filter([{hits}], lambda x: x IS NOT NULL)), []::VARCHAR[])"


def block_pairs_sql(src: str, idc: str, txt: str, blk: str, thr: float = P.SEMANTIC_THRESHOLD) -> str:
    """CTEs ``bd .. bpairs``: brute-force per-block TF-IDF cosine pairs >= thr."""
    return f"""bd AS (SELECT {idc} AS id, {blk} AS blk, {txt} AS text FROM {src}
        WHERE {txt} IS NOT NULL AND {blk} IS NOT NULL),
bsz AS (SELECT blk, count(*) AS n FROM bd GROUP BY blk HAVING count(*) >= 2),
btoks AS (SELECT bd.id, bd.blk, bsz.n, {tokens_sql('bd.text')} AS t FROM bd JOIN bsz USING (blk)),
bterms AS (SELECT id, blk, n, unnest({ngrams_sql('t')}) AS term FROM btoks),
btf AS (SELECT id, blk, n, term, count(*) AS tf FROM bterms GROUP BY id, blk, n, term),
bw0 AS (SELECT id, blk, term,
          tf * (ln((1 + n) / (1 + count(*) OVER (PARTITION BY blk, term))) + 1) AS w FROM btf),
bw AS (SELECT id, blk, term, w / sqrt(sum(w * w) OVER (PARTITION BY blk, id)) AS w FROM bw0),
bpairs AS (
  SELECT a.id AS {idc}, b.id AS duplicate_id, round(sum(a.w * b.w), 4) AS similarity
  FROM bw a JOIN bw b ON a.blk = b.blk AND a.term = b.term AND a.id < b.id
  GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= {thr})"""
