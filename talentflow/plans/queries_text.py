"""Text (C1-C13) and extraction (D1-D11) bindings.

Oracle-bound runs use ``unicode=False`` (ASCII classes, as RE2 has) and skip
the entity/NFKC step, which DuckDB cannot do; ``light_clean_html`` and the
full 73/100-pattern dictionaries (look-ahead) are rows-only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talentflow.functions import extract as X
from talentflow.functions import text as TX
from talentflow.operators import nlp
from talentflow.plans import presets as P
from talentflow.plans.catalog import query
from talentflow.plans.oracle_text import dict_sql, sql_list, sql_str, stop_words_sql
from talentflow.sources import io


def light_clean_sql(t: str, header: bool = False, contacts: bool = False) -> str:
    """DuckDB twin of ``TX.light_clean(unescape=False, unicode=False)``."""
    x = f"CASE WHEN regexp_matches({t}, '^\\s*$') THEN NULL ELSE {t} END"
    x = f"regexp_replace({x}, {sql_str(P.HTML_TAG_PATTERN)}, ' ', 'g')"
    if header:
        x = f"regexp_replace({x}, {sql_str(P.JD_HEADER_PATTERN)}, '', 'i')"
    if contacts:
        x = contacts_sql(x)
    x = f"regexp_replace({x}, '[\\r\\n\\t]', ' ', 'g')"
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    return f"nullif(trim({x}), '')"


def contacts_sql(x: str) -> str:
    x = f"regexp_replace({x}, {sql_str(P.URL_PATTERN)}, ' ', 'gi')"
    x = f"regexp_replace({x}, {sql_str(P.EMAIL_PATTERN)}, ' ', 'g')"
    return f"regexp_replace({x}, {sql_str(P.PHONE_PATTERN)}, ' ', 'g')"


def _docs(spark, d):
    return io.read_table(spark, d, "documents").select("doc_id", "text")


@query("light_clean_text", f"""SELECT doc_id, {light_clean_sql('text', header=True)} AS text_clean
FROM documents""")
def light_clean_text(spark, d):
    return _docs(spark, d).select("doc_id", TX.light_clean("text", strip_header=True, unescape=False,
                                                           unicode=False).alias("text_clean"))


@query("strip_contacts", f"""SELECT doc_id, {light_clean_sql('text', contacts=True)} AS text_clean
FROM documents""")
def strip_contacts(spark, d):
    return _docs(spark, d).select("doc_id", TX.light_clean("text", drop_contact=True, unescape=False,
                                                           unicode=False).alias("text_clean"))


@query("light_clean_html")
def light_clean_html(spark, d):
    """C1 + C1a on raw HTML: entities, NFKC, tags, contacts (rows only)."""
    p = io.read_table(spark, d, "pages").select("page_id", "html")
    return p.select("page_id", TX.light_clean("html", drop_contact=True).alias("text_clean"),
                    TX.lower_clean("html").alias("text_lower"))


@query("norm_category", f"""SELECT o_orderkey,
  nullif(trim(regexp_replace(lower({light_clean_sql('o_orderpriority')}), '[^a-z0-9]+', '_', 'g'), '_'), '')
    AS priority_clean,
  nullif(trim(regexp_replace(lower(CASE WHEN regexp_matches(o_orderstatus, '^\\s*$') THEN NULL
    ELSE o_orderstatus END), '[^a-z0-9]+', '_', 'g'), '_'), '') AS status_clean
FROM orders""")
def norm_category(spark, d):
    o = io.read_table(spark, d, "orders")
    return o.select("o_orderkey",
                    TX.norm_category("o_orderpriority", unescape=False, unicode=False).alias("priority_clean"),
                    TX.norm_category("o_orderstatus", clean_first=False, unicode=False).alias("status_clean"))


def _title_sql(t: str) -> str:
    x = f"lower({light_clean_sql(t)})"
    for pat, rep in P.TITLE_ABBREVIATIONS:
        x = f"regexp_replace({x}, {sql_str(pat)}, {sql_str(rep)}, 'g')"
    x = f"regexp_replace({x}, '[^a-z0-9+#/.\\s-]', ' ', 'g')"
    return f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


def _skill_sql(t: str) -> str:
    x = f"replace(lower({light_clean_sql(t)}), '&', ' and ')"
    x = f"regexp_replace({x}, '[^a-z0-9+#. /-]', ' ', 'g')"
    x = f"regexp_replace({x}, '[\\s/]+', '_', 'g')"
    return f"nullif(trim({x}, '_'), '')"


@query("norm_title_skill", f"""SELECT p_partkey,
  {_title_sql("p_name || ' sr. mgr/' || p_brand")} AS title_clean,
  {_skill_sql("p_type || ' & ' || p_brand || '/' || p_name")} AS skill_clean
FROM part""")
def norm_title_skill(spark, d):
    p = io.read_table(spark, d, "part")
    title = F.concat("p_name", F.lit(" sr. mgr/"), "p_brand")
    skill = F.concat("p_type", F.lit(" & "), "p_brand", F.lit("/"), "p_name")
    return p.select("p_partkey", TX.norm_title(title, unescape=False, unicode=False).alias("title_clean"),
                    TX.norm_skill(skill, unescape=False, unicode=False).alias("skill_clean"))


@query("first_email_phone", f"""SELECT doc_id,
  nullif(regexp_extract(text, {sql_str(P.EMAIL_PATTERN)}, 0), '') AS candidate_email,
  nullif(regexp_extract(text, {sql_str(P.PHONE_PATTERN)}, 0), '') AS candidate_phone
FROM documents""")
def first_email_phone(spark, d):
    return _docs(spark, d).select("doc_id", TX.first_email("text", unicode=False).alias("candidate_email"),
                                  TX.first_phone("text", unicode=False).alias("candidate_phone"))


@query("text_lengths", """SELECT doc_id, length(coalesce(text, '')) AS char_count,
  len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS word_count FROM documents""")
def text_lengths(spark, d):
    return _docs(spark, d).select("doc_id", TX.char_count("text").alias("char_count"),
                                  TX.word_count("text", unicode=False).alias("word_count"))


def _nlp_tokens_sql(t: str) -> str:
    x = f"lower(coalesce({t}, ''))"
    x = f"regexp_replace({x}, '<.*?>', ' ', 'g')"
    x = f"regexp_replace({x}, 'http\\S+|www\\S+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\S+@\\S+', ' ', 'g')"
    x = f"regexp_replace({x}, '[\\n\\r]', ' ', 'g')"
    x = f"regexp_replace({x}, '[^a-z0-9 ]', ' ', 'g')"
    return (f"list_filter(list_filter(string_split({x}, ' '), lambda w: w <> ''), "
            f"lambda w: NOT list_contains({stop_words_sql()}, w))")


@query("nlp_clean", f"""SELECT conv_id, turn, array_to_string({_nlp_tokens_sql('text')}, ' ') AS clean_text
FROM conversations""")
def nlp_clean(spark, d):
    c = io.read_table(spark, d, "conversations")
    return c.select("conv_id", "turn", TX.nlp_clean("text").alias("clean_text"))


LEMMA_SQL = f"""WITH toks AS (SELECT conv_id, turn, {_nlp_tokens_sql('text')} AS t FROM conversations),
lem AS (SELECT DISTINCT w AS form, w[1:len(w) - 1] AS lemma
        FROM (SELECT unnest(t) AS w FROM toks) x WHERE len(w) > 3 AND w LIKE '%s'),
pos AS (SELECT conv_id, turn, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS p FROM toks),
agg AS (SELECT conv_id, turn, string_agg(coalesce(lem.lemma, pos.w), ' ' ORDER BY p) AS s
        FROM pos LEFT JOIN lem ON pos.w = lem.form GROUP BY conv_id, turn)
SELECT toks.conv_id, toks.turn, coalesce(agg.s, '') AS lemma_text
FROM toks LEFT JOIN agg ON toks.conv_id = agg.conv_id AND toks.turn = agg.turn"""


@query("lemma_lookup", LEMMA_SQL)
def lemma_lookup(spark, d):
    """Lemma replacement through a (form, lemma) table derived from the corpus
    (forms ending in 's', longer than 3 chars -> without the 's')."""
    c = io.read_table(spark, d, "conversations").select("conv_id", "turn", TX.nlp_tokens("text").alias("t"))
    forms = c.select(F.explode("t").alias("form")).distinct() \
             .filter((F.length("form") > 3) & F.col("form").endswith("s"))
    lemmas = forms.select("form", F.expr("substring(form, 1, length(form) - 1)").alias("lemma"))
    out = nlp.lemmatize(c, ["conv_id", "turn"], "t", lemmas)
    return out.select("conv_id", "turn", F.array_join("t", " ").alias("lemma_text"))


@query("text_scalars", """SELECT o.o_orderkey,
  lower(coalesce(o.o_orderpriority, '')) AS title_lower,
  coalesce(o.o_orderstatus, '') || ' ' || coalesce(o.o_orderpriority, '') AS combined_text,
  length(o.o_orderpriority || '|' || o.o_orderstatus)
    - length(replace(o.o_orderpriority || '|' || o.o_orderstatus, '|', '')) + 1 AS delimiter_count,
  round(o.o_custkey * 100.0 / nullif(o.o_orderkey, 0), 2) AS price_pct,
  least(round(o.o_totalprice / 100000.0, 2), 1.0::DOUBLE) AS capped_ratio,
  CAST(o.o_orderdate AS DATE) AS order_date
FROM orders o""")
def text_scalars(spark, d):
    """C9-C13 on orders."""
    o = io.read_table(spark, d, "orders")
    return o.select("o_orderkey", TX.title_lower("o_orderpriority").alias("title_lower"),
                    TX.concat_text("o_orderstatus", "o_orderpriority").alias("combined_text"),
                    TX.delimiter_count(F.concat("o_orderpriority", F.lit("|"), "o_orderstatus"))
                    .alias("delimiter_count"),
                    TX.pct(F.col("o_custkey"), F.col("o_orderkey")).alias("price_pct"),
                    F.least(F.round(F.col("o_totalprice") / 100000.0, 2), F.lit(1.0)).alias("capped_ratio"),
                    F.to_date("o_orderdate").alias("order_date"))


# ------------------------------------------------------------------ extraction

PART_WORDS = ["ring", "bolt", "gear", "widget", "gizmo", "red", "blue", "small", "hot"]
PART_PATTERNS = {w: X.ascii_word_pattern(w) for w in PART_WORDS}
DOC_WORDS = {w: X.ascii_word_pattern(w) for w in
             ["the", "and", "with", "that", "les", "des", "que", "der", "und", "los", "por", "token"]}


@query("dict_extract", f"""SELECT p_partkey, {dict_sql('p_name', PART_PATTERNS)} AS part_words,
  (SELECT {dict_sql('d.text', DOC_WORDS)} FROM documents d WHERE d.doc_id = p.p_partkey) AS doc_words
FROM part p""")
def dict_extract(spark, d):
    p = io.read_table(spark, d, "part").select("p_partkey", X.dict_extract("p_name", PART_PATTERNS,
                                                                          unicode=False).alias("part_words"))
    docs = io.read_table(spark, d, "documents").select(
        F.col("doc_id").alias("p_partkey"), X.dict_extract("text", DOC_WORDS, unicode=False).alias("doc_words"))
    return p.join(docs, "p_partkey", "left")


@query("dict_extract_full")
def dict_extract_full(spark, d):
    """D1 with the 73-pattern preset (look-ahead patterns; rows only)."""
    return _docs(spark, d).select("doc_id", X.dict_extract("text", P.SKILL_PATTERNS).alias("skills"))


@query("dict_extract_upload")
def dict_extract_upload(spark, d):
    """D1b with the 100-pattern upload dictionary (rows only)."""
    return _docs(spark, d).select("doc_id", X.dict_extract("text", P.all_upload_skill_patterns())
                                  .alias("skills"))


def _substr_sql(t: str, words) -> str:
    hits = ", ".join(f"CASE WHEN contains(lower(coalesce({t}, '')), {sql_str(w)}) THEN {sql_str(w)} END"
                     for w in words)
    return f"list_filter([{hits}], lambda x: x IS NOT NULL)"


@query("substring_extract", f"""SELECT p_partkey, {_substr_sql('p_name', PART_WORDS)} AS skills,
  len({_substr_sql('p_name', PART_WORDS)}) AS skill_count FROM part""")
def substring_extract(spark, d):
    p = io.read_table(spark, d, "part")
    s = X.substring_extract("p_name", PART_WORDS)
    return p.select("p_partkey", s.alias("skills"), F.size(s).alias("skill_count"))


LEVELS = {"small": "small", "medium": "medium", "large": "large", "promo": "promo",
          "economy": "economy", "standard": "standard"}
LEVEL_RANK = {"economy": 1, "small": 2, "standard": 3, "medium": 4, "large": 5, "promo": 6}


@query("ordinal_levels", f"""WITH x AS (SELECT p_partkey,
  list_transform(list_sort(list_filter([{", ".join(
      f"CASE WHEN regexp_matches(p_type || ' ' || p_name, {sql_str(p)}, 'i') THEN {{'r': {LEVEL_RANK[n]}, 'n': {sql_str(n)}}} END"
      for n, p in LEVELS.items())}], lambda s: s IS NOT NULL)), lambda s: s.n) AS levels
  FROM part)
SELECT p_partkey, levels, CASE WHEN len(levels) > 0 THEN levels[-1] END AS highest_level,
  coalesce(CASE CASE WHEN len(levels) > 0 THEN levels[-1] END {" ".join(
      f"WHEN {sql_str(k)} THEN {v}" for k, v in LEVEL_RANK.items())} END, 0) AS level_rank
FROM x""")
def ordinal_levels(spark, d):
    p = io.read_table(spark, d, "part")
    lv = X.ordinal_levels(F.concat("p_type", F.lit(" "), "p_name"), LEVELS, LEVEL_RANK, unicode=False)
    out = p.select("p_partkey", lv.alias("levels"))
    out = out.withColumn("highest_level", X.highest_level("levels"))
    return out.withColumn("level_rank", X.level_rank("highest_level", LEVEL_RANK))


@query("education_cascade")
def education_cascade(spark, d):
    """D4b cascade on raw text (rows only: Java and RE2 differ on \\b)."""
    return _docs(spark, d).select("doc_id", X.level_cascade("text").alias("education_level"))


@query("max_first_number", """SELECT e.event_id,
  list_max(list_filter(list_transform(regexp_extract_all(e.props, '(\\d{1,2})', 1),
                                      lambda x: TRY_CAST(x AS INTEGER)), lambda v: v > 0 AND v <= 50))
    AS max_number,
  coalesce(TRY_CAST(nullif(regexp_extract(e.props, '(?i)"k": (\\d{1,2})', 1), '') AS DOUBLE), 5.0)
    AS first_number,
  CASE WHEN nullif(regexp_extract(e.props, '(?i)"k": (\\d{1,2})', 1), '') IS NULL THEN 0 ELSE 1 END
    AS number_known
FROM events e""")
def max_first_number(spark, d):
    ev = io.read_table(spark, d, "events")
    first, known = X.first_number("props", r'"k": (\d{1,2})')
    return ev.select("event_id", X.max_number("props", r"(\d{1,2})").alias("max_number"),
                     first.alias("first_number"), known.alias("number_known"))


@query("set_overlap", """WITH s AS (SELECT p_partkey,
  list_filter(list_filter(string_split(replace(p_name, ' ', '|'), '|'), lambda x: x <> ''),
              lambda x, i: list_position(list_filter(string_split(replace(p_name, ' ', '|'), '|'),
                                                     lambda y: y <> ''), x) = i) AS sk FROM part)
SELECT a.p_partkey, list_sort(list_intersect(a.sk, b.sk)) AS matching,
  list_sort(list_filter(b.sk, lambda x: NOT list_contains(a.sk, x))) AS missing,
  len(list_intersect(a.sk, b.sk)) AS n_matching,
  CASE WHEN len(b.sk) > 0 THEN round(len(list_intersect(a.sk, b.sk))::DOUBLE / len(b.sk), 4)
       ELSE 0.0::DOUBLE END AS overlap,
  b.sk[1] AS first_item
FROM s a JOIN s b ON b.p_partkey = a.p_partkey + 1""")
def set_overlap(spark, d):
    """D6-D10 on the word sets of consecutive parts."""
    p = io.read_table(spark, d, "part").select("p_partkey", X.pipe_to_set(F.replace(
        F.col("p_name"), F.lit(" "), F.lit("|"))).alias("sk"))
    a = p.alias("a")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("sk").alias("sk_b"))
    j = a.join(b, "p_partkey")
    return j.select("p_partkey", X.set_intersect("sk", "sk_b").alias("matching"),
                    X.set_minus("sk_b", "sk").alias("missing"),
                    X.safe_size(F.array_intersect("sk", "sk_b")).alias("n_matching"),
                    X.overlap_ratio("sk", "sk_b").alias("overlap"),
                    X.first_item("sk_b").alias("first_item"))


@query("skill_frequency", """SELECT w AS skill, count(*) AS job_count
FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) x GROUP BY w""")
def skill_frequency(spark, d):
    p = io.read_table(spark, d, "part").select(F.split("p_name", " ").alias("words"))
    return X.item_frequency(p, "words")


# ------------------------------------------------------------------ pipelines

@query("resume_master")
def resume_master(spark, d):
    """Resume pipeline (C1, C3, C6, C7, D1, D3-D5, J1, K2, K3, K5) on documents with the
    production presets (Unicode classes, 73-pattern dictionary; rows only)."""
    from talentflow.plans.pipelines import resume_pipeline
    raw = io.read_table(spark, d, "documents")
    kept, _, _ = resume_pipeline(raw, "doc_id", "text", "source")
    return kept.drop("resume_clean")


@query("resume_audit")
def resume_audit(spark, d):
    """Resume pipeline audit counts (F17) on documents (rows only)."""
    from talentflow.plans.pipelines import resume_pipeline
    _, _, audit = resume_pipeline(io.read_table(spark, d, "documents"), "doc_id", "text", "source")
    return audit
