from pyspark.sql import functions as F

from talentflow.plans.pipelines import job_pipeline, resume_pipeline


def S(spark, cols, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))


def test_resume_pipeline_quarantine_and_dups(spark):
    rows = [("1", "Python developer with 5 years of SQL and AWS. " * 5, "INFORMATION-TECHNOLOGY"),
            ("2", "Python developer with 5 years of SQL and AWS. " * 5, "INFORMATION-TECHNOLOGY"),
            ("3", "   ", "HR"),
            ("4", "Nurse, registered nurse, patient care, Bachelor's degree, 60 years", "HEALTHCARE")]
    raw = S(spark, ["ID", "Resume_str", "Category"], rows)
    kept, quar, audit = resume_pipeline(raw)
    k = {r.candidate_id: r for r in kept.collect()}
    assert sorted(k) == [1, 4]
    assert [r.candidate_id for r in quar.collect()] == [3]
    assert k[1].category_clean == "information_technology"
    assert k[1].years_experience == 5 and "python" in k[1].extracted_skills
    assert k[4].years_experience is None and k[4].highest_education == "bachelor"
    assert audit.first().dup_resumes_removed == 1


def test_job_pipeline_small_fixture(spark):
    post_cols = ["job_id", "title", "company_name", "company_id", "location", "formatted_work_type",
                 "formatted_experience_level", "pay_period", "currency", "min_salary", "max_salary",
                 "med_salary", "normalized_salary", "remote_allowed", "listed_time", "expiry",
                 "description"]
    desc = "Job description: We need a Python engineer for data pipelines and SQL. " * 3
    posts = [
        ("10", "Sr. Data Engineer", "Acme", "1.0", "Toronto", "Full-time", "Mid-Senior level", "YEARLY",
         "USD", None, None, None, "120000", "1.0", "1700000000000", "1710000000000", desc),
        ("11", "Data Engineer", "Acme", "1.0", "Toronto", "Full-time", None, None, None, None, None,
         None, "0", None, "1700000000000", None, desc),
        ("12", "Nurse", "Care", None, "Seattle", "Part-time", "Entry level", None, None, None, None,
         None, "1000001", None, "abc", None, "Patient care &amp; nursing shifts"),
    ]
    t = {
        "postings": S(spark, post_cols, posts),
        "jobs/job_skills": S(spark, ["job_id", "skill_abr"], [("10", "IT"), ("99", "IT"), ("12", "HCPR")]),
        "jobs/job_industries": S(spark, ["job_id", "industry_id"], [("10", "4"), ("12", "431")]),
        "jobs/benefits": S(spark, ["job_id", "type"], [("10", "401K"), ("10", "Dental")]),
        "jobs/salaries": S(spark, ["salary_id", "job_id"], [("1", "10"), ("2", None)]),
        "companies/companies": S(spark, ["company_id", "name", "description", "company_size", "city",
                                         "state", "country"],
                                 [("1", "Acme", "We build <b>things</b>", "3", "Toronto", "ON", "CA"),
                                  ("2", "Care", None, "1", "Seattle", "WA", "US")]),
        "companies/company_industries": S(spark, ["company_id", "industry"], [("1", "Software")]),
        "companies/company_specialities": S(spark, ["company_id", "speciality"], [("1", "AI")]),
        "companies/employee_counts": S(spark, ["company_id", "employee_count", "follower_count",
                                               "time_recorded"],
                                       [("1", "10", "5", "1"), ("1", "20", "6", None), ("2", "7", "1", "9"), ("2", "8", "2", "10")]),
        "mappings/skills": S(spark, ["skill_abr", "skill_name"], [("IT", "Information Technology"),
                                                                 ("HCPR", "Health Care Provider")]),
        "mappings/industries": S(spark, ["industry_id", "industry_name"], [("4", "Software"),
                                                                           ("431", None)]),
    }
    out = job_pipeline(t)
    jm = {r.job_id: r for r in out["job_master"].collect()}
    assert sorted(jm) == [10, 12]            # 11 is an exact description duplicate of 10
    assert jm[10].title_clean == "senior. data engineer"   # \.? backtracks before \b
    assert jm[10].required_skills == ["information_technology"]
    assert jm[10].remote_allowed_bool is True and jm[12].remote_allowed_bool is False
    assert jm[12].normalized_salary_clean is None and jm[12].listed_time_dt is None
    assert jm[10].employee_count_latest == 20   # NULL time_recorded sorts last and wins
    heads = {r.company_id: r.employee_count_latest for r in out["company_master"].collect()}
    assert heads == {1: 20, 2: 8}               # recorded at 10, after 9: numbers, not text
    assert out["orphan_job_skills"].count() == 1 and out["orphan_salaries"].count() == 1
    ind = {r.job_id: r.industry_name for r in out["job_industries_resolved"].collect()}
    assert ind[12] == "unknown_industry_431"
    assert jm[12].description_clean == "Patient care & nursing shifts"


def test_job_side_texts_lose_the_header(spark):
    from talentflow.functions import text as TX
    df = spark.createDataFrame([("Job description writer",)], "t string")
    assert df.select(TX.norm_title("t", strip_header=True)).first()[0] == "writer"
    assert df.select(TX.norm_title("t")).first()[0] == "job description writer"


def test_lookup_takes_the_last_row_of_a_code(spark):
    from talentflow.operators import resolve as RS
    dim = spark.createDataFrame([("a", "first"), ("b", "only"), ("a", "last")], "code string, name string").coalesce(1)
    got = RS.lookup(spark.createDataFrame([("a",), ("c",)], "code string"), dim, "code", ["name"]).collect()
    assert {r.code: r.name for r in got} == {"a": "last", "c": None}


def test_exact_median_by_ranges(spark):
    import random
    import statistics
    from talentflow.functions import coerce as B
    r = random.Random(1)
    for values in ([], [3.0], [1.0, 2.0], [r.gauss(0, 1) ** 3 for _ in range(2001)], [1e9, -5.0, *[7.0] * 500], [0.25] * 64):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        want = statistics.median(values) if values else None
        assert B.median(df, "v") == want
        if values:
            assert B.kth_value(df, "v", len(values) // 2, small=4, buckets=8) == sorted(values)[len(values) // 2]


def test_kth_value_over_extreme_ranges(spark):
    from talentflow.functions import coerce as B
    top = 1.7976931348623157e308
    for values in ([-1e308, 0.0, 1e308] * 5, [0.0, 5e-324, 1e-323] * 5, [-top, top, 1.0, 2.0, 3.0, -5e-324, 0.0] * 3,
                   [1e15 + i / 8 for i in range(9)] * 3):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for k in (0, len(values) // 2):
            assert B.kth_value(df, "v", k, small=2, buckets=64) == sorted(values)[k]


def test_flag_duplicates_with_clashing_names(spark):
    from talentflow.operators import dedup
    df = spark.createDataFrame([("x", 1, 7, True), ("x", 2, 8, False), ("y", 3, 9, True)], "k string, o int, __at int, __FIRST boolean")
    rows = dedup.flag_duplicates(df, ["k"], "o").orderBy("o").collect()
    assert [(r["__at"], r["__FIRST"], r.is_duplicate) for r in rows] == [(7, True, False), (8, False, True), (9, True, False)]
    again = df.withColumnRenamed("__at", "__dup")
    assert dedup.dedup_exact(again, "k", "o").columns == again.columns and dedup.dedup_exact(again, "k", "o").count() == 2
