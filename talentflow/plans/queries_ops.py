"""Sources/sinks (A), coercion (B), joins (E), aggregation/profile (F) and
validation (K) bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentflow.functions import coerce as B
from talentflow.functions import extract as X
from talentflow.functions import text as TX
from talentflow.operators import matching as MT
from talentflow.operators import profile as PR
from talentflow.operators import resolve as RS
from talentflow.plans import testbind as TB
from talentflow.plans.catalog import query
from talentflow.plans.oracle_views import with_views as W
from talentflow.session import cut_lineage
from talentflow.sources import io

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@query("row_counts", "\nUNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in TABLES))
def row_counts(spark, d):
    return io.row_counts({t: io.read_table(spark, d, t) for t in TABLES})


@query("serialize_lists", """SELECT l_orderkey,
  array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS return_flags,
  array_to_string(list_sort(list(DISTINCT l_linestatus)), '|') AS line_status
FROM lineitem GROUP BY l_orderkey""")
def serialize_lists(spark, d):
    li = io.read_table(spark, d, "lineitem")
    a = RS.sorted_set_per_key(li, "l_orderkey", "l_returnflag", "return_flags")
    b = RS.sorted_set_per_key(li, "l_orderkey", "l_linestatus", "line_status")
    return io.serialize_lists(a.join(b, "l_orderkey"))


@query("collect_sorted_set", """SELECT l_orderkey, list_sort(list(DISTINCT CAST(l_shipdate AS DATE))) AS ship_dates
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY l_orderkey""")
def collect_sorted_set(spark, d):
    li = io.read_table(spark, d, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    return RS.sorted_set_per_key(li, "l_orderkey", "d", "ship_dates")


@query("joined_unique", """SELECT l_orderkey, string_agg(v, ', ' ORDER BY o, v) AS codes FROM (
  SELECT l_orderkey, l_returnflag || l_linestatus AS v, min(l_linenumber) AS o FROM lineitem
  WHERE l_returnflag || l_linestatus IS NOT NULL GROUP BY 1, 2) x GROUP BY l_orderkey""")
def joined_unique(spark, d):
    li = io.read_table(spark, d, "lineitem").withColumn("v", F.concat("l_returnflag", "l_linestatus"))
    return RS.joined_unique(li, "l_orderkey", "v", "l_linenumber", "codes")


@query("warehouse_restrict", W("""SELECT job_id, skill_name FROM job_skills
WHERE job_id IN (SELECT job_id FROM matches)""", "job_skills", "matches"))
def warehouse_restrict(spark, d):
    best = TB.matches(spark, d)
    js = TB.job_skills(spark, d)
    wh = io.build_warehouse(best, js, js, jobs=TB.jobs(spark, d))
    return wh["job_skills"]


@query("slim_jobs", W("""WITH base AS (
  SELECT job_id, arg_min(job_title, match_rank * 100000000 + candidate_id) AS title,
         arg_min(company_name, match_rank * 100000000 + candidate_id) AS company_name
  FROM matches GROUP BY job_id),
req AS (SELECT job_id, list_sort(list(DISTINCT skill_name)) AS required_skills FROM job_skills
        WHERE skill_name IS NOT NULL AND skill_name <> '' GROUP BY job_id)
SELECT b.job_id, b.title, b.company_name, lower(coalesce(b.title, '')) AS title_clean,
       coalesce(r.required_skills, []::VARCHAR[]) AS required_skills,
       len(coalesce(r.required_skills, []::VARCHAR[])) AS required_skill_count,
       NULL::BIGINT AS company_id, NULL::VARCHAR AS company_industry, NULL::VARCHAR AS company_size,
       NULL::BIGINT AS employee_count_latest, NULL::VARCHAR AS description_clean,
       NULL::VARCHAR AS experience_required, NULL::VARCHAR[] AS industries, NULL::VARCHAR AS work_type,
       NULL::VARCHAR AS location, NULL::VARCHAR AS location_clean, NULL::DOUBLE AS min_salary,
       NULL::DOUBLE AS max_salary, NULL::DOUBLE AS normalized_salary_clean, NULL::BOOLEAN AS has_salary,
       NULL::VARCHAR AS pay_period, NULL::VARCHAR AS currency, NULL::VARCHAR[] AS benefits,
       NULL::BOOLEAN AS remote_allowed_bool, NULL::TIMESTAMP AS listed_time_dt,
       NULL::TIMESTAMP AS expiry_dt, NULL::INTEGER AS description_word_count,
       NULL::DOUBLE AS jd_completeness_score, NULL::DOUBLE AS job_quality_score
FROM base b LEFT JOIN req r ON b.job_id = r.job_id""", "matches", "job_skills"))
def slim_jobs(spark, d):
    m = TB.matches(spark, d)
    js = TB.job_skills(spark, d).withColumnRenamed("skill_name", "skill_clean")
    return io.slim_jobs(m, js)


# ------------------------------------------------------------------ coercion

@query("coerce_types", """SELECT l_orderkey, l_linenumber,
  TRY_CAST(CASE WHEN isinf(TRY_CAST(q AS DOUBLE)) THEN NULL ELSE TRY_CAST(q AS DOUBLE) END AS BIGINT) AS quantity
FROM (SELECT l_orderkey, l_linenumber,
        CASE l_linenumber WHEN 3 THEN 'abc' WHEN 5 THEN 'inf' WHEN 6 THEN NULL
             ELSE CAST(l_quantity AS VARCHAR) END AS q FROM lineitem) x""")
def coerce_types(spark, d):
    li = io.read_table(spark, d, "lineitem")
    q = (F.when(F.col("l_linenumber") == 3, F.lit("abc")).when(F.col("l_linenumber") == 5, F.lit("inf"))
          .when(F.col("l_linenumber") == 6, F.lit(None)).otherwise(F.col("l_quantity").cast("string")))
    return li.select("l_orderkey", "l_linenumber", B.to_long(q).alias("quantity"))


@query("epoch_to_ts", """SELECT event_id, epoch_ms(CAST(ms AS VARCHAR)::BIGINT) AS ts_dt, ms AS ts_ms
FROM (SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM events) x""")
def epoch_to_ts(spark, d):
    ev = io.read_table(spark, d, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return ev.select("event_id", B.epoch_ms_to_ts(ms.cast("string")).cast("timestamp_ntz").alias("ts_dt"),
                     ms.alias("ts_ms"))


@query("standardize_names", "SELECT r_regionkey AS r_region_key, r_name AS region_name FROM region")
def standardize_names(spark, d):
    r = io.read_table(spark, d, "region").toDF(" R_Region Key", "Region Name ")
    return B.standardize_column_names(r)


@query("fill_rules", """SELECT n_nationkey,
  coalesce(CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END, 'unknown_industry_' || n_nationkey) AS name_filled,
  coalesce(CASE WHEN CASE WHEN n_nationkey % 7 = 0 THEN '-' WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END
                     NOT IN ('0', '-')
                THEN CASE WHEN n_nationkey % 7 = 0 THEN '-' WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END END,
           'Not Specified') AS city_clean,
  coalesce(CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey END, 0) AS region_filled
FROM nation""")
def fill_rules(spark, d):
    """B4 + B8 + B9 on nation with some names nulled / replaced by sentinels."""
    n = io.read_table(spark, d, "nation")
    k = F.col("n_nationkey")
    n = n.select("n_nationkey",
                 F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("n_name")).alias("name_raw"),
                 F.when(k % 7 == 0, F.lit("-")).when(k % 4 == 0, F.lit(None))
                  .otherwise(F.col("n_name")).alias("city_raw"),
                 F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("n_regionkey")).alias("region_filled"))
    n = B.fill_defaults(n, {"region_filled": 0})
    return n.select("n_nationkey", B.fill_from_key("name_raw", "n_nationkey").alias("name_filled"),
                    B.replace_sentinels("city_raw").alias("city_clean"), "region_filled")


@query("date_parts", """SELECT o_orderkey, year(o_orderdate) AS listing_year, month(o_orderdate) AS listing_month,
  day(o_orderdate) AS listing_day FROM orders""")
def date_parts(spark, d):
    o = io.read_table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return B.date_parts(o, "o_orderdate", "listing").drop("o_orderdate")


@query("flags_outliers", """SELECT l_orderkey, l_linenumber,
  coalesce(nullif(l_discount, 0), nullif(l_tax, 0)) IS NOT NULL AS has_salary,
  coalesce(CASE WHEN l_returnflag = 'R' THEN 1.0 END = 1, false) AS remote_allowed_bool,
  l_extendedprice IS NOT NULL AND (l_extendedprice <= 0 OR l_extendedprice > 100000) AS salary_outlier,
  CASE WHEN l_extendedprice > 0 AND l_extendedprice <= 100000 THEN l_extendedprice END AS salary_clean
FROM lineitem""")
def flags_outliers(spark, d):
    li = io.read_table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     B.any_present(F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0)))
                     .alias("has_salary"),
                     B.strict_bool(F.when(F.col("l_returnflag") == "R", F.lit(1.0))).alias("remote_allowed_bool"),
                     B.outlier_flag("l_extendedprice", 100000).alias("salary_outlier"),
                     B.mask_outlier("l_extendedprice", 100000).alias("salary_clean"))


@query("median_impute", """SELECT c_custkey,
  CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END AS balance_known,
  coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END,
           (SELECT quantile_cont(c_acctbal, 0.5) FROM customer WHERE c_acctbal >= 0)) AS balance,
  coalesce(CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_nationkey END, 0) AS nation_filled
FROM customer""")
def median_impute(spark, d):
    c = io.read_table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_nationkey") % 4 == 0, F.lit(None)).otherwise(F.col("c_nationkey")).alias("nation_filled"))
    c = B.median_impute(c, "balance", known_flag="balance_known")
    return B.zero_fill(c, ["nation_filled"])


@query("sample_rows")
def sample_rows(spark, d):
    """Exactly 50 pseudo-random orders (the limit is the feature)."""
    return B.sample_rows(io.read_table(spark, d, "orders"), 50, order_key="o_orderkey")


# ------------------------------------------------------------------ joins

@query("lookup_join", """SELECT c.c_custkey, n.n_name, r.r_name FROM customer c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def lookup_join(spark, d):
    """Code -> name via fixed-size dimensions (25 nations, 5 regions)."""
    c = io.read_table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = io.read_table(spark, d, "nation")
    r = io.read_table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    out = RS.lookup(c, n, "n_nationkey", ["n_name", "n_regionkey"])
    out = RS.lookup(out, r, "n_regionkey", ["r_name"])
    return out.select("c_custkey", "n_name", "r_name")


@query("enrich_left", """SELECT c.c_custkey, c.c_name, o.n_orders, o.total_spent, l.n_lines
FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_spent
           FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           GROUP BY o_custkey) l ON c.c_custkey = l.o_custkey""")
def enrich_left(spark, d):
    """Left enrichment chain with sides pre-aggregated to one row per key."""
    c = io.read_table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    o = io.read_table(spark, d, "orders")
    li = io.read_table(spark, d, "lineitem").select("l_orderkey")
    per_o = o.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total_spent"))
    per_l = (li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey)
               .groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n_lines")))
    return RS.enrich(c, [(per_o, "k"), (per_l, "k")]).withColumnRenamed("k", "c_custkey")


@query("orphan_split", """SELECT l_orderkey, l_linenumber,
  l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey IS NOT NULL)
    AS is_orphan
FROM lineitem""")
def orphan_split(spark, d):
    """Lineitem rows whose order is not a valid (non-pending) parent."""
    li = io.read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    valid = io.read_table(spark, d, "orders").filter(F.col("o_orderstatus") != "P") \
              .select(F.col("o_orderkey").alias("l_orderkey"))
    kept, orphans = RS.split_orphans(li, valid, "l_orderkey")
    return kept.withColumn("is_orphan", F.lit(False)).unionByName(orphans.withColumn("is_orphan", F.lit(True)))


@query("orphan_counts", """SELECT count(*) FILTER (WHERE l_orderkey IN (SELECT o_orderkey FROM orders
  WHERE o_orderstatus <> 'P')) AS kept, count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey
  FROM orders WHERE o_orderstatus <> 'P')) AS orphans FROM lineitem""")
def orphan_counts(spark, d):
    """K1 audit: kept / quarantined counts (the quarantine sink is io.write_table)."""
    li = io.read_table(spark, d, "lineitem").select("l_orderkey")
    valid = io.read_table(spark, d, "orders").filter(F.col("o_orderstatus") != "P") \
              .select(F.col("o_orderkey").alias("l_orderkey"))
    kept, orphans = RS.split_orphans(li, valid, "l_orderkey")
    return PR.issue_counts(kept.withColumn("k", F.lit(True)).unionByName(
        orphans.withColumn("k", F.lit(False))), {"kept": F.col("k"), "orphans": ~F.col("k")})


# ------------------------------------------------------------ aggregation / profile

@query("value_counts", """SELECT o_orderstatus, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM orders GROUP BY o_orderstatus""")
def value_counts(spark, d):
    """F3 + F4: counts and normalised shares (window over the aggregate)."""
    from pyspark.sql import Window
    c = io.read_table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


JOB_NULL_COLS = ["job_id", "title", "title_clean", "company_name", "company_industry",
                 "experience_required", "has_salary", "normalized_salary_clean", "remote_allowed_bool",
                 "description_word_count", "required_skills", "company_id", "listed_time_dt",
                 "expiry_dt", "location_clean", "required_skill_count", "jd_completeness_score",
                 "job_quality_score"]


@query("null_profile", W("SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE * 100.0, 2) "
    f"AS null_pct FROM jobs" for c in JOB_NULL_COLS) + ") x WHERE null_pct > 0", "jobs"))
def null_profile(spark, d):
    return PR.null_profile(TB.jobs(spark, d).select(*JOB_NULL_COLS))


def _qr_sql(name: str, src: str, cols: list[str]) -> str:
    nulls = ", ".join(f"CASE WHEN count(*) FILTER (WHERE {c} IS NULL) > 0 THEN '{c} (' || "
                      f"count(*) FILTER (WHERE {c} IS NULL) || ')' END" for c in cols)
    return (f"SELECT '{name}' AS dataset, count(*) AS \"rows\", {len(cols)} AS \"columns\", "
            f"CASE WHEN concat_ws(', ', {nulls}) = '' THEN 'No Missing Data' ELSE concat_ws(', ', {nulls}) END "
            f"AS columns_with_nulls, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(cols)} "
            f"FROM {src}) q) AS duplicate_rows FROM {src}")


@query("quality_report", W("\nUNION ALL ".join([
    _qr_sql("nation", "nation", ["n_nationkey", "n_name", "n_regionkey"]),
    _qr_sql("flags", "lineitem", ["l_returnflag", "l_linestatus"]),
    _qr_sql("jobs", "jobs", ["job_id", "experience_required", "normalized_salary_clean"])]), "jobs"))
def quality_report(spark, d):
    """F12 + F13."""
    return PR.quality_report({
        "nation": io.read_table(spark, d, "nation"),
        "flags": io.read_table(spark, d, "lineitem").select("l_returnflag", "l_linestatus"),
        "jobs": TB.jobs(spark, d).select("job_id", "experience_required", "normalized_salary_clean")})


COVERAGE_SQL = W("""WITH m AS (SELECT count(*) AS n_jobs,
  round(avg(CASE WHEN title_clean IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE * 100.0, 1) AS title_coverage_pct,
  round(avg(CASE WHEN listed_time_dt IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE * 100.0, 1) AS description_coverage_pct,
  round(avg(CASE WHEN experience_required IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE * 100.0, 1) AS experience_coverage_pct,
  round(avg(CASE WHEN coalesce(required_skill_count > 0, false) THEN 1.0 ELSE 0.0 END)::DOUBLE * 100.0, 1) AS skill_coverage_pct,
  round(avg(CASE WHEN coalesce(has_salary, false) THEN 1.0 ELSE 0.0 END)::DOUBLE * 100.0, 1) AS salary_coverage_pct,
  count(DISTINCT company_id) AS n_companies
  FROM jobs)
SELECT *, CAST(round_even(0.5 * description_coverage_pct + 0.5 * title_coverage_pct, 0) AS INTEGER) AS data_quality,
  CAST(round_even(1.0 * description_coverage_pct, 0) AS INTEGER) AS nlp_readiness,
  CAST(round_even(0.6 * description_coverage_pct + 0.4 * skill_coverage_pct, 0) AS INTEGER) AS ml_readiness,
  CAST(round_even(0.4 * skill_coverage_pct + 0.3 * description_coverage_pct + 0.3 * experience_coverage_pct, 0)
       AS INTEGER) AS matching_readiness
FROM m""", "jobs")


@query("coverage_scores", COVERAGE_SQL)
def coverage_scores(spark, d):
    """F14 + F15 (readiness integers round half to even)."""
    j = TB.jobs(spark, d)
    m = PR.coverage(j, nonnull={"title_coverage_pct": "title_clean",
                                "description_coverage_pct": "listed_time_dt",
                                "experience_coverage_pct": "experience_required"},
                    predicates={"skill_coverage_pct": F.col("required_skill_count") > 0,
                                "salary_coverage_pct": F.col("has_salary")},
                    distinct={"n_companies": "company_id"}, n_name="n_jobs")
    return PR.readiness(m)


@query("describe_numeric", """SELECT 'c_acctbal' AS "column", avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS std,
  min(c_acctbal)::DOUBLE AS "min", quantile_cont(c_acctbal, 0.5)::DOUBLE AS median, max(c_acctbal)::DOUBLE AS "max"
FROM customer
UNION ALL SELECT 'c_nationkey', avg(c_nationkey), stddev_samp(c_nationkey), min(c_nationkey)::DOUBLE,
  quantile_cont(c_nationkey, 0.5)::DOUBLE, max(c_nationkey)::DOUBLE FROM customer""")
def describe_numeric(spark, d):
    return PR.describe_numeric(io.read_table(spark, d, "customer"), ["c_acctbal", "c_nationkey"])


@query("rows_sharing_key", """SELECT o_orderkey, o_custkey, o_orderdate FROM orders
WHERE (o_custkey, o_orderdate) IN (SELECT (o_custkey, o_orderdate) FROM orders GROUP BY 1 HAVING count(*) > 1)""")
def rows_sharing_key(spark, d):
    o = io.read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return PR.rows_sharing_key(o, ["o_custkey", "o_orderdate"])


# ------------------------------------------------------------------ validation

DOC_WORDS = {w: X.ascii_word_pattern(w) for w in ["the", "and", "les", "der", "los", "token"]}


@query("quarantine_quality", """SELECT doc_id,
  text IS NULL OR length(coalesce(text, '')) < 50 AS quarantined,
  len(regexp_extract_all(coalesce(text, ''), '\\S+')) < 50 AS is_low_quality FROM documents""")
def quarantine_quality(spark, d):
    """K2 + K3: quarantine NULL / short texts, flag the rest by word count."""
    docs = io.read_table(spark, d, "documents").select("doc_id", "text")
    kept, bad = PR.quarantine_split(docs, "text")
    flag = PR.low_quality(TX.word_count("text", unicode=False))
    return (kept.select("doc_id", F.lit(False).alias("quarantined"), flag.alias("is_low_quality"))
                .unionByName(bad.select("doc_id", F.lit(True).alias("quarantined"),
                                        flag.alias("is_low_quality"))))


@query("key_checks", W("""SELECT 'jobs.job_id unique' AS check_name,
  (SELECT count(*) FROM (SELECT job_id FROM jobs GROUP BY job_id HAVING count(*) > 1 OR job_id IS NULL) x) AS violations
UNION ALL SELECT 'matches rank starts at 1',
  (SELECT count(*) FROM (SELECT candidate_id FROM matches GROUP BY candidate_id HAVING min(match_rank) <> 1) x)
UNION ALL SELECT 'matches.job_id -> jobs',
  (SELECT count(*) FROM matches WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE job_id IS NOT NULL))
UNION ALL SELECT 'lineitem.l_orderkey -> orders',
  (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL))
UNION ALL SELECT 'jobs.company_id -> supplier',
  (SELECT count(*) FROM jobs WHERE company_id IS NULL OR company_id NOT IN (SELECT s_suppkey FROM supplier))
UNION ALL SELECT 'matches.job_title not null',
  (SELECT count(*) FROM matches WHERE job_title IS NULL)
UNION ALL SELECT 'even and odd orders share a customer',
  (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0
                         INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1) x WHERE o_custkey IS NOT NULL)""",
                         "jobs", "matches"))
def key_checks(spark, d):
    """K4 + K8: uniqueness, rank-starts-at-1, foreign keys, non-null; one count per check."""
    jobs, m = cut_lineage(TB.jobs(spark, d)), cut_lineage(TB.matches(spark, d))  # each read by several checks
    li, o = io.read_table(spark, d, "lineitem"), io.read_table(spark, d, "orders")
    sup = io.read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("company_id"))
    checks = {
        "jobs.job_id unique": PR.unique_violations(jobs, "job_id"),
        "matches rank starts at 1": PR.rank_start_violations(m, "candidate_id", "match_rank"),
        "matches.job_id -> jobs": PR.fk_violations(m, jobs, "job_id"),
        "lineitem.l_orderkey -> orders": PR.fk_violations(
            li.select("l_orderkey"), o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey"),
        "jobs.company_id -> supplier": PR.fk_violations(jobs.select("company_id"), sup, "company_id"),
        "matches.job_title not null": PR.nonnull_violations(m, ["job_title"], "candidate_id"),
        "even and odd orders share a customer": PR.disjoint_violations(
            o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), "o_custkey"),
    }
    parts = [v.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(k).alias("check_name"), "violations")
             for k, v in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("completeness_scores", """WITH x AS (SELECT doc_id,
  len(coalesce(list_filter([""" + ", ".join(
    f"CASE WHEN regexp_matches(text, '{p}', 'i') THEN '{n}' END" for n, p in DOC_WORDS.items()) + """],
    lambda s: s IS NOT NULL), [])) AS skill_count,
  nullif(regexp_extract(text, '\\b[\\w.+-]+@[\\w-]+\\.[\\w.-]+\\b', 0), '') AS email,
  len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS words,
  list_max(list_filter(list_transform(regexp_extract_all(text, '(\\d{1,2})', 1),
           lambda v: TRY_CAST(v AS INTEGER)), lambda v: v > 0 AND v <= 50)) AS years
  FROM documents)
SELECT doc_id, round(0.4 * (skill_count > 0)::INT + 0.25 * (email IS NOT NULL)::INT
  + 0.2 * (words >= 100)::INT + 0.15 * (years IS NOT NULL)::INT, 3)::DOUBLE AS resume_completeness_score,
  CASE WHEN words < 50 THEN 0.25 WHEN words BETWEEN 50 AND 150 THEN 0.6 WHEN words > 150 THEN 1.0
       ELSE 0.5 END::DOUBLE AS jd_completeness_score,
  round(0.6 * CASE WHEN words < 50 THEN 0.25 WHEN words BETWEEN 50 AND 150 THEN 0.6 WHEN words > 150 THEN 1.0
       ELSE 0.5 END + 0.4 * least(skill_count / 5.0, 1.0), 3)::DOUBLE AS job_quality_score
FROM x""")
def completeness_scores(spark, d):
    """K5 + K6 + K7 on documents (skills = word dictionary, education = e-mail found)."""
    docs = io.read_table(spark, d, "documents").select("doc_id", "text")
    x = docs.select("doc_id",
                    F.size(X.dict_extract("text", DOC_WORDS, unicode=False)).alias("skill_count"),
                    TX.first_email("text", unicode=False).alias("email"),
                    TX.word_count("text", unicode=False).alias("words"),
                    X.max_number("text", r"(\d{1,2})").alias("years"))
    return x.select("doc_id",
                    PR.resume_completeness("skill_count", "email", "words", "years")
                    .alias("resume_completeness_score"),
                    PR.jd_completeness("words").alias("jd_completeness_score"),
                    PR.job_quality(PR.jd_completeness("words"), "skill_count").alias("job_quality_score"))


@query("column_rules", """SELECT o_orderkey AS order_id, o_custkey AS customer, o_orderstatus AS status FROM orders
WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND nullif(trim(o_orderstatus), '') IS NOT NULL""")
def column_rules(spark, d):
    """B5-B7 + B16: drop rows with a null key and rows without text, drop columns, project with new names."""
    o = B.drop_null_keys(io.read_table(spark, d, "orders"), ["o_custkey", "o_orderstatus"])
    o = B.drop_columns(o.filter(B.has_text(F.nullif(F.trim("o_orderstatus"), F.lit("")))), ["o_totalprice", "no_such_column"])
    return B.project(o, {"o_orderkey": "order_id", "o_custkey": "customer", "o_orderstatus": "status"})


@query("stored_matches", W("""SELECT candidate_id, job_id, match_rank AS rank, final_match_score FROM matches
WHERE match_rank <= 10 AND candidate_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""", "matches"))
def stored_matches(spark, d):
    """The ten best stored matches of the requested candidates (customers with a finished order)."""
    asked = io.read_table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("candidate_id"))
    m = MT.jobs_for_candidate(TB.matches(spark, d).withColumnRenamed("match_rank", "rank"), asked)
    return m.select("candidate_id", "job_id", "rank", "final_match_score")
