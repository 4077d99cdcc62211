"""The twenty analytic queries (N1-N20) over the warehouse tables.

Each query is a DataFrame function of the tables it reads, parameterised by
column names (recruitment names are the defaults) and by the values the source
queries hard-coded (labels, hubs, skills, as-of date). Orderings always carry
a unique tie-breaker so LIMIT results are deterministic.

Shape notes for scale: group counts use partial aggregation; window queries
partition by their group key (never an unpartitioned window over raw rows:
the running total is taken over the per-day aggregate, which has one row per
day); top-n uses ``row_number`` so Spark plans a ``WindowGroupLimit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentflow.functions import text as TX
from talentflow.plans import presets as P
from talentflow.session import cut_lineage

HIGH = ["Highly Suitable", "Perfect Match"]


def n01_jobs_per_level(jobs: DataFrame, level: str = "experience_required",
                       job_id: str = "job_id") -> DataFrame:
    """Jobs per experience level (NULL level kept as its own group)."""
    return (jobs.groupBy(level).agg(F.count(job_id).alias("total_jobs"))
                .orderBy(F.desc("total_jobs"), F.asc_nulls_last(level)))


def n02_top_remote_industries(jobs: DataFrame, industry: str = "company_industry",
                              flag: str = "remote_allowed_bool", job_id: str = "job_id",
                              n: int = 5) -> DataFrame:
    """Top ``n`` industries by remote jobs."""
    return (jobs.filter(F.col(flag)).groupBy(industry)
                .agg(F.count(job_id).alias("remote_job_count"))
                .orderBy(F.desc("remote_job_count"), F.asc_nulls_last(industry)).limit(n))


def n03_completeness_by_education(cands: DataFrame, edu: str = "highest_education",
                                  score: str = "resume_completeness_score",
                                  low: str = "is_low_quality") -> DataFrame:
    """Average completeness per education level, low-quality rows excluded."""
    return (cands.filter(~F.col(low)).groupBy(edu)
                 .agg(F.round(F.avg(score), 2).alias("avg_completeness"))
                 .orderBy(F.desc("avg_completeness"), F.asc_nulls_last(edu)))


def n04_salary_listed(jobs: DataFrame, flag: str = "has_salary") -> DataFrame:
    """Jobs with / without a listed salary."""
    return jobs.groupBy(flag).agg(F.count(F.lit(1)).alias("job_count"))


def n05_best_companies(jobs: DataFrame, companies: DataFrame, min_jobs: int = 5,
                       n: int = 10) -> DataFrame:
    """Companies with more than ``min_jobs`` jobs, best average quality first."""
    stats = (jobs.groupBy("company_id")
                 .agg(F.count("job_id").alias("jobs_posted"),
                      F.avg("job_quality_score").alias("__avg"))
                 .filter(F.col("jobs_posted") > min_jobs))
    return (stats.join(companies.select("company_id", "name", "company_size"), "company_id")
                 .orderBy(F.desc("__avg"), F.asc("company_id")).limit(n)
                 .select("name", "company_size", "jobs_posted",
                         F.round("__avg", 3).alias("avg_quality")))


def n06_skill_demand(job_skills: DataFrame, jobs: DataFrame, title_terms=("data", "machine learning"),
                     n: int = 10) -> DataFrame:
    """Skill demand of jobs whose clean title contains any of ``title_terms``."""
    cond = None
    for term in title_terms:
        c = F.col("title_clean").like(f"%{term}%")
        cond = c if cond is None else (cond | c)
    sel = jobs.filter(cond).select("job_id")
    return (job_skills.join(sel, "job_id").groupBy("skill_name")
                      .agg(F.count("job_id").alias("demand_count"))
                      .orderBy(F.desc("demand_count"), F.asc_nulls_last("skill_name")).limit(n))


def n07_missing_skills(matches: DataFrame, cands: DataFrame,
                       labels=("Not Suitable", "Suitable"), more_than: int = 3) -> DataFrame:
    """Candidates whose match misses more than ``more_than`` skills.

    ``missing_skills`` may be an array (counted with ``size``) or a pipe string
    (counted with the source's LENGTH/REPLACE formula).
    """
    m = matches.filter(F.col("suitability").isin(*labels))
    if dict(m.dtypes)["missing_skills"].startswith("array"):
        ms = F.array_join("missing_skills", "|")
    else:
        ms = F.col("missing_skills")
    out = (m.join(cands.select("candidate_id", "role_applied"), "candidate_id")
            .select("candidate_id", "role_applied", "job_title", ms.alias("missing_skills"),
                    TX.delimiter_count(ms).alias("missing_skill_count")))
    return out.filter(F.col("missing_skill_count") > more_than)


def n08_salary_in_hubs(jobs: DataFrame, hubs=("Toronto", "San Francisco", "New York", "Seattle"),
                       loc: str = "location_clean") -> DataFrame:
    """Average salary of jobs with salary in the named hubs (case-insensitive)."""
    return (jobs.filter(F.lower(F.col(loc)).isin(*[h.lower() for h in hubs]) & F.col("has_salary"))
                .groupBy(loc).agg(F.count("job_id").alias("total_roles"),
                                  F.round(F.avg("normalized_salary_clean"), 2).alias("avg_market_salary"))
                .orderBy(F.desc("avg_market_salary"), F.asc(loc)))


def n09_top3_per_job(matches: DataFrame, n: int = 3) -> DataFrame:
    """Top ``n`` candidates of every job (ties by candidate id)."""
    w = Window.partitionBy("job_id").orderBy(F.desc("final_match_score"), F.asc("candidate_id"))
    return (matches.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
                   .select("job_id", "candidate_id", "final_match_score", "suitability"))


def rank_desc(df: DataFrame, part: str, value: str, tie: str, out: str = "__rank", total: str = "__n",
              after: str | None = None) -> DataFrame:
    """Exact rank (1 = largest ``value``, NULLs last, ties by ``tie``) inside ``part``, the number
    of its rows and, in the column ``after`` if named, the value of the next rank.

    Rows are dealt by sampled ranges of (part, value, tie), so that neither a large part nor a
    value that most rows of a part share is sorted in one task; a table of row counts by part
    and range gives each range's offset and the first value of the one behind it. The dealt
    rows are written once, so that ranks and counts see the same ranges.
    """
    from talentflow.session import cut_lineage
    x = cut_lineage(df.repartitionByRange(F.col(part), F.desc_nulls_last(value), F.asc(tie))
                      .withColumn("__b", F.spark_partition_id()))
    upto = Window.partitionBy(part).orderBy("__b")
    counts = x.groupBy(part, "__b").agg(F.count(F.lit(1)).alias("__c"), F.max(value).alias("__top"))
    counts = counts.select(part, "__b", "__c", F.lead("__top").over(upto).alias("__behind"),
                           F.coalesce(F.sum("__c").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
                           F.sum("__c").over(Window.partitionBy(part)).alias(total))
    inside = Window.partitionBy(part, "__b").orderBy(F.desc_nulls_last(value), F.asc(tie))
    x = x.withColumn("__r", F.row_number().over(inside))
    if after:
        x = x.withColumn("__next", F.lead(value).over(inside))
    keep = [F.col(f"a.{c}") for c in df.columns] + [(F.col("__off") + F.col("__r")).alias(out), F.col(total)]
    if after:
        keep.append(F.when(F.col("__r") < F.col("__c"), F.col("__next")).otherwise(F.col("__behind")).alias(after))
    same = F.col(f"a.{part}").eqNullSafe(F.col(f"b.{part}")) & (F.col("a.__b") == F.col("b.__b"))
    return x.alias("a").join(counts.alias("b"), same).select(*keep)


def n10_salary_quartile(jobs: DataFrame, part: str = "company_industry", tiles: int = 4) -> DataFrame:
    """Salary quartile inside each industry, best first (ties by job id): the first
    ``n % 4`` tiles hold one row more."""
    x = rank_desc(jobs.filter(F.col("has_salary")).select("job_id", "title_clean", part, "normalized_salary_clean"),
                  part, "normalized_salary_clean", "job_id")
    small = F.floor(F.col("__n") / tiles)
    more = F.col("__n") % tiles
    edge = more * (small + 1)
    tile = F.when(F.col("__rank") <= edge, F.ceil(F.col("__rank") / (small + 1))) \
        .otherwise(more + F.ceil(F.try_divide(F.col("__rank") - edge, small)))
    return x.select("job_id", "title_clean", part, "normalized_salary_clean", tile.cast("int").alias("salary_quartile"))


def n11_running_postings(jobs: DataFrame, ts: str = "listed_time_dt") -> DataFrame:
    """Daily postings and their running total (over the per-day aggregate)."""
    daily = (jobs.filter(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("list_date"))
                 .agg(F.count("job_id").alias("daily_jobs")))
    # one row per day: the unpartitioned window sees only the day aggregate
    w = Window.orderBy("list_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn("running_total_jobs", F.sum("daily_jobs").over(w))


def n12_above_company_avg(jobs: DataFrame) -> DataFrame:
    """Jobs paying more than their own company's average salary."""
    avg = (jobs.filter(F.col("has_salary")).groupBy("company_id")
               .agg(F.avg("normalized_salary_clean").alias("__avg")))
    j = jobs.join(avg, "company_id")
    return (j.filter(F.col("normalized_salary_clean") > F.col("__avg"))
             .select("job_id", "title_clean", "company_name", "normalized_salary_clean",
                     F.round("__avg", 2).alias("company_avg")))


def n13_score_gap(matches: DataFrame, max_rank: int = 2) -> DataFrame:
    """% gap between each match's score and the job's next best one, among top-``max_rank``
    matches."""
    t = rank_desc(matches.filter(F.col("match_rank") <= max_rank).select("job_id", "candidate_id", "final_match_score"),
                  "job_id", "final_match_score", "candidate_id", after="next_best_score")
    gap = F.round(F.try_divide(F.col("final_match_score") - F.col("next_best_score"),
                               F.col("next_best_score")) * 100.0, 2)
    return (t.filter(F.col("next_best_score").isNotNull())
             .select("job_id", F.col("candidate_id").alias("top_candidate"), "final_match_score",
                     "next_best_score", gap.alias("score_gap_pct")))


def n14_top_education_per_category(cands: DataFrame, cat: str = "category_clean",
                                   edu: str = "highest_education") -> DataFrame:
    """Most frequent education level per category (ties and NULL kept)."""
    counts = cands.groupBy(cat, edu).agg(F.count(F.lit(1)).alias("ed_count"))
    w = Window.partitionBy(cat).orderBy(F.desc("ed_count"))
    return counts.withColumn("__rk", F.rank().over(w)).filter(F.col("__rk") == 1).drop("__rk")


def n15_suitability_funnel(matches: DataFrame, label: str = "suitability") -> DataFrame:
    """Suitability counts with their share of all matches."""
    counts = matches.groupBy(label).agg(F.count(F.lit(1)).alias("total_matches"))
    # window over the tier aggregate (a handful of rows)
    total = F.sum("total_matches").over(Window.partitionBy())
    return (counts.withColumn("percentage_of_total",
                              F.round(F.col("total_matches") * 100.0 / total, 2))
                  .orderBy(F.desc("total_matches"), F.asc(label)))


def n16_shared_talent(matches: DataFrame, labels=tuple(HIGH), n: int = 10, light: int = 64,
                      seeds: int = 32) -> DataFrame:
    """Company pairs sharing highly suitable candidates, the ``n`` best (ties by name).

    A candidate of at most ``light`` companies contributes its pairs. Those of more companies
    are bits: each company has a bitmap of them by word of 64, and two companies share as
    many as the words they have in common have equal bits. Pairs of some leading companies give
    the n-th best count; a pair can only reach it if its light count plus the smaller of both
    bitmap counts does, so that only those pairs are formed from the bitmaps.
    """
    cc = cut_lineage(matches.filter(F.col("suitability").isin(*labels))
                     .select("candidate_id", "company_name").distinct())
    sizes = cc.groupBy("candidate_id").agg(F.count("*").alias("size"))
    some = cc.join(sizes.filter(F.col("size") <= light), "candidate_id")
    a, b = (some.select("candidate_id", F.col("company_name").alias(c)) for c in ("company_a", "company_b"))
    pairs = (a.join(b, "candidate_id").filter(F.col("company_a") < F.col("company_b"))
              .groupBy("company_a", "company_b").agg(F.count("*").alias("light")))
    best = [F.desc("shared_candidates"), F.asc("company_a"), F.asc("company_b")]
    # candidate ids stay a join key of their own: number the heavy ones, then drop the ids
    heavy = cut_lineage(sizes.filter(F.col("size") > light).select("candidate_id", F.monotonically_increasing_id().alias("at")))
    if heavy.isEmpty():
        return pairs.withColumnRenamed("light", "shared_candidates").orderBy(*best).limit(n)
    pairs = cut_lineage(pairs)
    bit = F.expr("shiftleft(1L, int(at & 63))")
    words = cc.join(heavy, "candidate_id").groupBy("company_name", F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    count = words.groupBy("company_name").agg(F.sum(F.bit_count("bits")).alias("h"))
    words = cut_lineage(words.join(count, "company_name"))
    count = words.select("company_name", "h").distinct()

    def side(x):
        return words.select("word", *[F.col(c).alias(f"{d}_{x}") for c, d in (("company_name", "company"), ("bits", "bits"), ("h", "h"))])

    def from_bits(keep):
        """Pairs that share a heavy candidate and pass ``keep``, with their whole count."""
        both = (side("a").join(side("b"), "word").filter((F.col("company_a") < F.col("company_b")) & keep)
                .groupBy("company_a", "company_b").agg(F.sum(F.bit_count(F.expr("bits_a & bits_b"))).alias("heavy")).filter("heavy > 0"))
        return both.join(pairs, ["company_a", "company_b"], "left").select(
            "company_a", "company_b", (F.col("heavy") + F.coalesce("light", F.lit(0))).alias("shared_candidates"))

    totals = cc.groupBy("company_name").agg(F.count("*").alias("d"))
    lead = {r.company_name for order in ([F.desc("d"), F.asc("company_name")], [F.asc("company_name")])
            for r in totals.filter(F.col("company_name").isNotNull()).orderBy(*order).limit(seeds).collect()}
    known = F.col("company_a").isin(*lead) & F.col("company_b").isin(*lead)
    leading = (from_bits(known).unionByName(pairs.filter(known).withColumnRenamed("light", "shared_candidates"))
               .groupBy("company_a", "company_b").agg(F.max("shared_candidates").alias("shared_candidates"))
               .orderBy(*best).limit(n).collect())
    bar, name = (leading[-1].shared_candidates, leading[-1].company_a) if len(leading) == n else (0, None)

    def may(bound):
        return (bound > bar) | ((bound == bar) & (F.col("company_a") <= F.lit(name)))
    # pairs with a light candidate in common, completed where the bitmaps can lift them to the bar
    h = [count.select(F.col("company_name").alias(f"company_{x}"), F.col("h").alias(f"h_{x}")) for x in "ab"]
    bounded = pairs.join(h[0], "company_a", "left").join(h[1], "company_b", "left").na.fill(0, ["h_a", "h_b"])
    open_ = bounded.filter(may(F.col("light") + F.least("h_a", "h_b"))).select("company_a", "company_b", "light")
    shared = (open_.join(side("a"), "company_a").join(side("b"), ["company_b", "word"])
              .groupBy("company_a", "company_b").agg(F.sum(F.bit_count(F.expr("bits_a & bits_b"))).alias("heavy")))
    lifted = open_.join(shared, ["company_a", "company_b"], "left").select(
        "company_a", "company_b", (F.col("light") + F.coalesce("heavy", F.lit(0))).alias("shared_candidates"))
    return (lifted.unionByName(from_bits(may(F.least("h_a", "h_b"))))
            .groupBy("company_a", "company_b").agg(F.max("shared_candidates").alias("shared_candidates"))
            .orderBy(*best).limit(n))


def n17_text_match_by_completeness(jobs: DataFrame, matches: DataFrame) -> DataFrame:
    """Average text match per description-completeness value."""
    return (jobs.select("job_id", "jd_completeness_score")
                .join(matches.select("job_id", "text_match_pct"), "job_id")
                .groupBy("jd_completeness_score")
                .agg(F.round(F.avg("text_match_pct"), 2).alias("avg_text_match"))
                .orderBy(F.desc_nulls_last("jd_completeness_score")))


def n18_salary_per_skill(job_skills: DataFrame, jobs: DataFrame,
                         skills=("Python", "SQL", "GitLab", "Vertex AI")) -> DataFrame:
    """Average and max salary of jobs requiring each listed skill."""
    j = jobs.filter(F.col("has_salary")).select("job_id", "normalized_salary_clean")
    return (job_skills.filter(F.col("skill_name").isin(*skills)).join(j, "job_id")
                      .groupBy("skill_name")
                      .agg(F.round(F.avg("normalized_salary_clean"), 2).alias("avg_salary"),
                           F.max("normalized_salary_clean").alias("max_salary")))


def n19_expired_best_matches(matches: DataFrame, jobs: DataFrame, cands: DataFrame,
                             as_of: str | Column | None = None) -> DataFrame:
    """Rank-1 matches whose job expired before ``as_of`` (default: today)."""
    day = F.current_date() if as_of is None else (F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of)
    m = matches.filter(F.col("match_rank") == 1).select("candidate_id", "job_id")
    j = jobs.filter(F.col("expiry_dt") < day).select("job_id", "title_clean", "expiry_dt")
    c = cands.select("candidate_id", "role_applied")
    return m.join(j, "job_id").join(c, "candidate_id").select(
        "candidate_id", "role_applied", "title_clean", "expiry_dt")


def n20_jobs_without_high(jobs: DataFrame, matches: DataFrame, labels=tuple(HIGH)) -> DataFrame:
    """Jobs with no highly suitable candidate (anti join)."""
    hi = matches.filter(F.col("suitability").isin(*labels)).select("job_id")
    return jobs.join(hi, "job_id", "left_anti").select("job_id", "title_clean", "company_name")
