"""The job feed and the match as whole pipelines (``plans.pipelines``) on the test tables.

Postings are the ``benchmark`` texts with the title and price of the part of the same number;
companies are suppliers, whose industries, specialities and head counts come from the parts
they ship; child tables are derived from ``part`` and ``lineitem``, so that many of their rows
are orphans. All feeds hold strings, as raw files do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentflow.plans import pipelines
from talentflow.plans.catalog import query
from talentflow.plans.testbind import t
from talentflow.session import cut_lineage, release


def _strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def job_feeds(spark, d) -> dict[str, DataFrame]:
    part, supplier, nation = t(spark, d, "part"), t(spark, d, "supplier"), t(spark, d, "nation")
    shipped = t(spark, d, "lineitem")
    made = shipped.join(part, F.col("l_partkey") == F.col("p_partkey"))
    text = t(spark, d, "benchmark").select(F.col("item_id").alias("job_id"), F.col("text").alias("description"))
    none = F.lit(None).cast("string")
    postings = text.join(part, F.col("job_id") == F.col("p_partkey"), "left").select(
        "job_id", F.col("p_name").alias("title"), F.col("p_brand").alias("company_name"),
        F.col("p_size").cast("double").alias("company_id"), F.col("p_type").alias("location"),
        F.lit("Full-time").alias("formatted_work_type"), F.lit("Entry level").alias("formatted_experience_level"),
        F.lit("YEARLY").alias("pay_period"), F.lit("USD").alias("currency"),
        F.col("p_retailprice").alias("min_salary"), none.alias("max_salary"), none.alias("med_salary"),
        (F.col("p_retailprice") * 100).alias("normalized_salary"),
        F.when(F.col("p_size") > 25, F.lit("1.0")).alias("remote_allowed"),
        none.alias("listed_time"), none.alias("expiry"), "description")
    tables = {
        "postings": postings,
        "jobs/job_skills": part.select(F.col("p_partkey").alias("job_id"), F.col("p_type").alias("skill_abr")),
        "jobs/job_industries": part.select(F.col("p_partkey").alias("job_id"), F.col("p_size").alias("industry_id")),
        "jobs/benefits": shipped.select(F.col("l_partkey").alias("job_id"), F.col("l_returnflag").alias("type")),
        "jobs/salaries": shipped.select(F.col("l_orderkey").alias("salary_id"), F.col("l_partkey").alias("job_id")),
        "companies/companies": supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
            F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("name"),
            F.concat("s_name", F.lit(" ships <b>parts</b>")).alias("description"),
            F.col("s_nationkey").alias("company_size"), none.alias("city"), none.alias("state"), F.col("n_name").alias("country")),
        "companies/company_industries": made.select(F.col("l_suppkey").alias("company_id"), F.col("p_type").alias("industry")),
        "companies/company_specialities": made.select(F.col("l_suppkey").alias("company_id"), F.col("p_brand").alias("speciality")),
        "companies/employee_counts": shipped.groupBy(F.col("l_suppkey").alias("company_id"), F.col("l_orderkey").alias("time_recorded"))
        .agg(F.sum("l_quantity").cast("long").alias("employee_count"), F.max("l_partkey").alias("follower_count")),
        "mappings/skills": part.select(F.col("p_type").alias("skill_abr"), F.lower("p_type").alias("skill_name")).distinct(),
        "mappings/industries": nation.select(F.col("n_nationkey").alias("industry_id"),
                                             F.when(F.col("n_regionkey") != 0, F.col("n_name")).alias("industry_name")),
    }
    return {name: _strings(df) for name, df in tables.items()}


@query("feed_job_master")
def feed_job_master(spark, d):
    """The job feed from raw strings to the master table (rows only: Unicode cleaning and
    near-duplicate removal); the cleaned text is left out of the result."""
    return pipelines.job_pipeline(job_feeds(spark, d))["job_master"].drop("description_clean")


@query("feed_company_master", """
WITH made AS (SELECT l_suppkey, p_type, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
ind AS (SELECT l_suppkey, list_sort(list(DISTINCT p_type)) AS industries FROM made WHERE p_type IS NOT NULL GROUP BY 1),
spec AS (SELECT l_suppkey, list_sort(list(DISTINCT p_brand)) AS specialities FROM made WHERE p_brand IS NOT NULL GROUP BY 1),
counts AS (SELECT l_suppkey, l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS e, max(l_partkey) AS f FROM lineitem GROUP BY 1, 2),
emp AS (SELECT l_suppkey, arg_max(e, l_orderkey) AS employee_count_latest, arg_max(f, l_orderkey) AS follower_count_latest
        FROM counts GROUP BY 1)
SELECT s_suppkey AS company_id, s_name AS name, s_name || ' ships parts' AS company_description_clean,
       CAST(s_nationkey AS VARCHAR) AS company_size, n_name AS country, industries, specialities,
       employee_count_latest, follower_count_latest, industries[1] AS company_industry
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN ind ON s_suppkey = ind.l_suppkey LEFT JOIN spec ON s_suppkey = spec.l_suppkey
LEFT JOIN emp ON s_suppkey = emp.l_suppkey""")
def feed_company_master(spark, d):
    return pipelines.job_pipeline(job_feeds(spark, d))["company_master"].drop("city", "state")


@query("feed_industries_resolved", """
SELECT p_partkey AS job_id, CAST(p_size AS BIGINT) AS industry_id,
       CASE WHEN n_nationkey IS NOT NULL THEN coalesce(CASE WHEN n_regionkey <> 0 THEN n_name END,
                                                       'unknown_industry_' || n_nationkey) END AS industry_name
FROM part LEFT JOIN nation ON p_size = n_nationkey
WHERE p_partkey IN (SELECT item_id FROM benchmark)""")
def feed_industries_resolved(spark, d):
    return pipelines.job_pipeline(job_feeds(spark, d))["job_industries_resolved"]


@query("feed_orphans", """
WITH child AS (
  SELECT 'salaries' AS child, l_partkey AS job_id FROM lineitem UNION ALL
  SELECT 'benefits', l_partkey FROM lineitem UNION ALL
  SELECT 'job_skills', p_partkey FROM part UNION ALL
  SELECT 'job_industries', p_partkey FROM part)
SELECT child, count(*) AS orphans FROM child
WHERE job_id IS NULL OR job_id NOT IN (SELECT item_id FROM benchmark) GROUP BY child""")
def feed_orphans(spark, d):
    """Rows of each child table whose job is no posting (H2)."""
    out = pipelines.job_pipeline(job_feeds(spark, d))
    counts = [df.groupBy(F.lit(name.removeprefix("orphan_")).alias("child")).agg(F.count("*").alias("orphans"))
              for name, df in out.items() if name.startswith("orphan_")]
    first, *rest = counts
    for df in rest:
        first = first.unionByName(df)
    return first


@query("feed_matches")
def feed_matches(spark, d):
    """Raw resumes (``documents``) and raw postings to the ranked, labelled match table."""
    resumes, _, _ = pipelines.resume_pipeline(t(spark, d, "documents"), "doc_id", "text", "source")
    # both sides are read several times: cleaned and freed of duplicates once
    resumes = cut_lineage(resumes.select("candidate_id", "resume_clean", "extracted_skills", "role_applied"))
    jobs = pipelines.job_pipeline(job_feeds(spark, d))["job_master"]
    jobs = cut_lineage(jobs.select("job_id", "title", "company_name", "description_clean"))
    release(spark)
    return pipelines.match_pipeline(resumes, jobs)
