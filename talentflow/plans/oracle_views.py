"""DuckDB SQL twins of the test-table bindings in ``plans.testbind``.

``with_views(body, ...)`` prefixes a query with the CTEs it needs (and their
dependencies) so every oracle query is self-contained ANSI/DuckDB SQL over the
driver's pre-registered views.
"""

from __future__ import annotations

JOB_SKILL_SQL = ("list_sort(list_distinct(list_concat(string_split(lower(p_name), ' '), "
                 "[lower(p_type), lower(replace(p_brand, '#', '_'))])))")

VIEWS: dict[str, tuple[list[str], str]] = {
    "cand_skills": ([], f"""
  SELECT c.c_custkey AS candidate_id,
         list_sort(list_distinct(list_concat(coalesce(b.types, []::VARCHAR[]),
                                             [lower(c.c_mktsegment)]))) AS skill_set
  FROM customer c LEFT JOIN (
    SELECT o_custkey, list(DISTINCT lower(p_type)) AS types
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    GROUP BY o_custkey) b ON c.c_custkey = b.o_custkey"""),
    "matches": (["cand_skills"], f"""
  SELECT candidate_id, candidate_role, job_id, job_title, company_name, text_match_pct,
         skill_overlap_pct, final_match_score,
         row_number() OVER (PARTITION BY candidate_id ORDER BY final_match_score DESC,
                            text_match_pct DESC, job_id ASC) AS match_rank,
         list_sort(list_intersect(rs, js)) AS matching_skills,
         list_sort(list_filter(js, lambda x: NOT list_contains(rs, x))) AS missing_skills,
         CASE WHEN final_match_score >= 40 THEN 'Highly Suitable'
              WHEN final_match_score >= 20 THEN 'Suitable' ELSE 'Not Suitable' END AS suitability
  FROM (
    SELECT pr.*, pt.p_name AS job_title, pt.p_brand AS company_name,
           lower(c.c_mktsegment) AS candidate_role,
           coalesce(pt.js, []::VARCHAR[]) AS js, coalesce(cs.skill_set, []::VARCHAR[]) AS rs
    FROM (SELECT o_custkey AS candidate_id, l_partkey AS job_id,
                 round(max(l_extendedprice) / 1000.0, 1) AS final_match_score,
                 round(max(l_discount) * 1000.0, 1) AS text_match_pct,
                 round(max(l_tax) * 1000.0, 1) AS skill_overlap_pct
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) pr
    LEFT JOIN (SELECT p_partkey, p_name, p_brand, {JOB_SKILL_SQL} AS js FROM part) pt
           ON pr.job_id = pt.p_partkey
    LEFT JOIN customer c ON pr.candidate_id = c.c_custkey
    LEFT JOIN cand_skills cs ON pr.candidate_id = cs.candidate_id) x"""),
    "jobs": ([], f"""
  SELECT j.*, len(required_skills) AS required_skill_count,
         CASE WHEN description_word_count < 50 THEN 0.25::DOUBLE
              WHEN description_word_count BETWEEN 50 AND 150 THEN 0.6::DOUBLE
              WHEN description_word_count > 150 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END
           AS jd_completeness_score,
         round(0.6::DOUBLE * CASE WHEN description_word_count < 50 THEN 0.25::DOUBLE
              WHEN description_word_count BETWEEN 50 AND 150 THEN 0.6::DOUBLE
              WHEN description_word_count > 150 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END
           + 0.4::DOUBLE * least(len(required_skills) / 5.0::DOUBLE, 1.0::DOUBLE), 3)
           AS job_quality_score
  FROM (
    SELECT p.p_partkey AS job_id, p.p_name AS title, lower(p.p_name) AS title_clean,
           p.p_brand AS company_name, p.p_type AS company_industry,
           CASE WHEN p.p_size >= 10 THEN 'level_' || CAST(p.p_size // 10 AS VARCHAR) END
             AS experience_required,
           (p.p_size % 4) <> 0 AS has_salary,
           CASE WHEN (p.p_size % 4) <> 0 AND p.p_retailprice * 100.0 > 0
                 AND p.p_retailprice * 100.0 <= 99000.0 THEN p.p_retailprice * 100.0 END
             AS normalized_salary_clean,
           p.p_size > 25 AS remote_allowed_bool,
           p.p_size * 5 AS description_word_count,
           {JOB_SKILL_SQL.replace('p_name', 'p.p_name').replace('p_type', 'p.p_type').replace('p_brand', 'p.p_brand')} AS required_skills,
           pp.company_id, pp.listed_time_dt, pp.expiry_dt, lower(n.n_name) AS location_clean
    FROM part p
    LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS company_id, min(l_shipdate) AS listed_time_dt,
                      max(l_shipdate) AS expiry_dt FROM lineitem GROUP BY l_partkey) pp
           ON p.p_partkey = pp.l_partkey
    LEFT JOIN supplier s ON s.s_suppkey = pp.company_id
    LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey) j"""),
    "candidates": ([], """
  SELECT c_custkey AS candidate_id, lower(c_mktsegment) AS category_clean,
         lower(c_mktsegment) AS role_applied,
         CASE c_nationkey % 7 WHEN 0 THEN 'high_school' WHEN 1 THEN 'diploma'
              WHEN 2 THEN 'associate' WHEN 3 THEN 'bachelor' WHEN 4 THEN 'master'
              WHEN 5 THEN 'doctorate' END AS highest_education,
         round(abs(c_acctbal) / 10000.0, 3) AS resume_completeness_score,
         c_acctbal < 0 AS is_low_quality
  FROM customer"""),
    "companies": ([], """
  SELECT s_suppkey AS company_id, s_name AS name,
         'size_' || CAST(s_nationkey % 5 AS VARCHAR) AS company_size
  FROM supplier"""),
    "job_skills": (["jobs"], """
  SELECT job_id, unnest(required_skills) AS skill_name FROM jobs"""),
}


def with_views(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order)
    b = body.lstrip()
    if b[:4].upper() == "WITH":
        return f"WITH {ctes},\n{b[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
