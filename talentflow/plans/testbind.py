"""Bindings of the recruitment operators to the driver's test tables.

The test tables (TPC-H-like star schema plus documents/pages/...) hold no
resumes or jobs, so the warehouse tables the analytics and lookups expect are
*derived* from them with Spark; everything grows with the input:

* ``matches``   (M): candidate = customer, job = part, one row per
  (o_custkey, l_partkey) over lineitem ⋈ orders; scores from the line prices.
* ``jobs``      : one row per part, with supplier/nation/shipdate aggregates.
* ``candidates``: one row per customer.
* ``companies`` : one row per supplier.
* ``job_skills``: exploded ``jobs.required_skills``.

Every derivation has a line-by-line SQL twin in ``plans.oracle`` (DuckDB).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentflow.functions import extract as X
from talentflow.operators import matching as MT
from talentflow.operators import profile as PR
from talentflow.sources import io

EDU_BY_MOD7 = ["high_school", "diploma", "associate", "bachelor", "master", "doctorate"]
SALARY_CAP_BIND = 99000.0


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return io.read_table(spark, d, name)


def job_skill_array() -> F.Column:
    """Sorted distinct p_name words + lower(p_type) + brand token."""
    return F.array_sort(F.array_distinct(F.concat(
        F.split(F.lower("p_name"), " "),
        F.array(F.lower("p_type"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")))))))


def candidate_skills(spark: SparkSession, d: str) -> DataFrame:
    """(candidate_id, skill_set): part types the customer bought + segment."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    p = t(spark, d, "part").select("p_partkey", "p_type")
    bought = (li.join(o, li.l_orderkey == o.o_orderkey)
                .join(p, li.l_partkey == p.p_partkey)
                .groupBy(F.col("o_custkey").alias("candidate_id"))
                .agg(F.collect_set(F.lower("p_type")).alias("types")))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("candidate_id"), "c_mktsegment")
    return (c.join(bought, "candidate_id", "left")
             .select("candidate_id", F.array_sort(F.array_distinct(F.concat(
                 F.coalesce("types", F.array().cast("array<string>")),
                 F.array(F.lower("c_mktsegment"))))).alias("skill_set")))


def matches(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice",
                                        "l_discount", "l_tax")
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    pairs = (li.join(o, li.l_orderkey == o.o_orderkey)
               .groupBy(F.col("o_custkey").alias("candidate_id"), F.col("l_partkey").alias("job_id"))
               .agg(F.round(F.max("l_extendedprice") / 1000.0, 1).alias("final_match_score"),
                    F.round(F.max("l_discount") * 1000.0, 1).alias("text_match_pct"),
                    F.round(F.max("l_tax") * 1000.0, 1).alias("skill_overlap_pct")))
    part = t(spark, d, "part").select(F.col("p_partkey").alias("job_id"),
                                      F.col("p_name").alias("job_title"),
                                      F.col("p_brand").alias("company_name"),
                                      job_skill_array().alias("job_skill_set"))
    cust = t(spark, d, "customer").select(F.col("c_custkey").alias("candidate_id"),
                                          F.lower("c_mktsegment").alias("candidate_role"))
    cs = candidate_skills(spark, d)
    m = (pairs.join(part, "job_id", "left").join(cust, "candidate_id", "left")
              .join(cs, "candidate_id", "left"))
    empty = F.array().cast("array<string>")
    js, rs = F.coalesce("job_skill_set", empty), F.coalesce("skill_set", empty)
    w = Window.partitionBy("candidate_id").orderBy(F.desc("final_match_score"),
                                                   F.desc("text_match_pct"), F.asc("job_id"))
    return (m.withColumn("matching_skills", X.set_intersect(rs, js))
             .withColumn("missing_skills", X.set_minus(js, rs))
             .withColumn("match_rank", F.row_number().over(w))
             .withColumn("suitability", MT.suitability("final_match_score"))
             .select("candidate_id", "candidate_role", "job_id", "job_title", "company_name",
                     "text_match_pct", "skill_overlap_pct", "final_match_score", "match_rank",
                     "matching_skills", "missing_skills", "suitability"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem")
    per_part = li.groupBy(F.col("l_partkey").alias("job_id")).agg(
        F.min("l_suppkey").alias("company_id"),
        F.min("l_shipdate").alias("listed_time_dt"),
        F.max("l_shipdate").alias("expiry_dt"))
    sup = t(spark, d, "supplier").select(F.col("s_suppkey").alias("company_id"), "s_nationkey")
    nat = t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"),
                                       F.lower("n_name").alias("location_clean"))
    p = t(spark, d, "part")
    has_sal = F.pmod(F.col("p_size"), F.lit(4)) != 0
    sal = F.col("p_retailprice") * 100.0
    wc = F.col("p_size") * 5
    base = p.select(
        F.col("p_partkey").alias("job_id"), F.col("p_name").alias("title"),
        F.lower("p_name").alias("title_clean"), F.col("p_brand").alias("company_name"),
        F.col("p_type").alias("company_industry"),
        F.when(F.col("p_size") >= 10, F.concat(F.lit("level_"),
               (F.col("p_size") / 10).cast("int").cast("string"))).alias("experience_required"),
        has_sal.alias("has_salary"),
        F.when(has_sal & (sal > 0) & (sal <= SALARY_CAP_BIND), sal).alias("normalized_salary_clean"),
        (F.col("p_size") > 25).alias("remote_allowed_bool"),
        wc.alias("description_word_count"),
        job_skill_array().alias("required_skills"))
    j = (base.join(per_part, "job_id", "left").join(sup, "company_id", "left")
             .join(nat, "s_nationkey", "left").drop("s_nationkey"))
    j = (j.withColumn("required_skill_count", X.safe_size("required_skills"))
          .withColumn("jd_completeness_score", PR.jd_completeness("description_word_count"))
          .withColumn("job_quality_score",
                      PR.job_quality("jd_completeness_score", "required_skill_count")))
    return j


def candidates(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    edu = F.lit(None).cast("string")
    for i in reversed(range(len(EDU_BY_MOD7))):
        edu = F.when(F.pmod(F.col("c_nationkey"), F.lit(7)) == i, F.lit(EDU_BY_MOD7[i])).otherwise(edu)
    return c.select(F.col("c_custkey").alias("candidate_id"),
                    F.lower("c_mktsegment").alias("category_clean"),
                    F.lower("c_mktsegment").alias("role_applied"),
                    edu.alias("highest_education"),
                    F.round(F.abs(F.col("c_acctbal")) / 10000.0, 3).alias("resume_completeness_score"),
                    (F.col("c_acctbal") < 0).alias("is_low_quality"))


def companies(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("name"),
                    F.concat(F.lit("size_"), F.pmod(F.col("s_nationkey"), F.lit(5)).cast("string"))
                    .alias("company_size"))


def job_skills(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).select("job_id", F.explode("required_skills").alias("skill_name"))
