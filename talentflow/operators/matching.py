"""Similarity join, hybrid scoring, ranking and lookups.

The cosine of every left document with every right document is the sparse
product of their weight tables: an equi-join on ``term`` followed by
``groupBy(pair).sum(w_l * w_r)``. Only pairs sharing a term are produced
(the zero-score pairs never exist), the heaviest terms are removed by
``max_df`` when the vocabulary is fitted, and a hot term is split by AQE's
skew-join handling.

The top-k join (``nearest``) writes no pairs out: weight rows, one a document,
are dealt into groups of left and of right documents, every left group meets
every right group in a cogroup, and the task keeps the ``k`` best of its right
documents per left one. What is shuffled grows with the documents, a task holds
one group of each side, and the exact top-k of the groups' candidates is a
``row_number`` filter that Spark plans as a ``WindowGroupLimit``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentflow.functions import extract as X
from talentflow.plans import presets as P


def cosine_pairs(left_w: DataFrame, right_w: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """``(left_id, right_id, text_similarity)`` for pairs sharing a term.

    One plan at every size: an equi-join on ``term``, which Spark broadcasts or shuffles by
    the measured size of its sides (AQE splits a hot term), and pair sums that are partially
    aggregated before their shuffle. The similarity is rounded to 12 digits, so that equal
    texts tie whatever the order of summation; presentation rounds further.
    """
    l = left_w.select(F.col(left_id), "term", F.col("w").alias("__wl"))
    r = right_w.select(F.col(right_id), "term", F.col("w").alias("__wr"))
    sim = F.round(F.sum(F.col("__wl") * F.col("__wr")), 12)
    return l.join(r, "term").groupBy(left_id, right_id).agg(sim.alias("text_similarity"))


def fill_pairs(found: DataFrame, ids: DataFrame, others: DataFrame, left_id: str, right_id: str,
               k: int) -> DataFrame:
    """Zero-similarity pairs for every id of ``ids`` with fewer than ``k`` pairs in ``found``.

    The ``k`` smallest unmatched ids of ``others`` are among its ``2 k`` smallest, so that no
    more than these are looked at; ids with ``k`` pairs or more get none.
    """
    first = [r[0] for r in others.select(right_id).distinct().orderBy(right_id).limit(2 * k).collect()]
    if not first:
        return found.limit(0)
    kind = f"array<{others.schema[right_id].dataType.simpleString()}>"
    near = F.lit(first).cast(kind)
    have = found.groupBy(left_id).agg(F.count(F.lit(1)).alias("__n"), F.collect_set(
        F.when(F.col(right_id).isin(first), F.col(right_id))).alias("__seen"))
    short = (ids.select(left_id).distinct().join(have, left_id, "left")
                .filter(F.coalesce("__n", F.lit(0)) < k))
    rest = F.slice(F.array_except(near, F.coalesce("__seen", F.array().cast(kind))), 1, k)
    return (short.select(left_id, F.explode(rest).alias(right_id))
                 .withColumn("text_similarity", F.lit(0.0)).select(*found.columns))


def top_k(df: DataFrame, part: str | list[str], order: list[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows per group by an explicit total order."""
    w = Window.partitionBy(*([part] if isinstance(part, str) else part)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


#: documents of a left and of a right group, left ones multiplied and right terms held at a time
LEFT_GROUP, RIGHT_GROUP, LEFT_BLOCK, RIGHT_TERMS = 2048, 2048, 64, 1 << 15


def _flat(t: pa.Table, key: str, weight: str):
    """``(keys, weights, sizes)`` of a table of weight rows."""
    k, w = t.column(key).combine_chunks(), t.column(weight).combine_chunks()
    return k.flatten().to_numpy(), w.flatten().to_numpy(), np.diff(k.offsets.to_numpy())


def _best(left: pa.Table, right: pa.Table, k: int):
    """``(left row, right row, similarity)`` of the ``k`` best right rows of each left row, ties
    to the earlier right row; only rows that share a term."""
    lk, lw, ln = _flat(left, "lk", "lw")
    rk, rw, rn = _flat(right, "rk", "rw")
    terms, place = np.unique(rk, return_inverse=True)
    at = np.searchsorted(terms, lk)
    at[at == len(terms)] = 0
    row = np.repeat(np.arange(len(ln)), ln)
    hit = terms[at] == lk
    at, lw, row = at[hit], lw[hit], row[hit]
    first = np.append(0, np.cumsum(rn))
    cuts = [0]                                     # right rows of at most RIGHT_TERMS terms, one at least
    while cuts[-1] < len(rn):
        cuts.append(max(int(np.searchsorted(first, first[cuts[-1]] + RIGHT_TERMS, "right")) - 1, cuts[-1] + 1))
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for lo in range(0, len(ln), LEFT_BLOCK):
        n = min(LEFT_BLOCK, len(ln) - lo)
        mine = slice(*np.searchsorted(row, [lo, lo + n]))
        dense = np.zeros((len(terms), n))
        dense[at[mine], row[mine] - lo] = lw[mine]
        sims = np.concatenate([np.add.reduceat(
            dense[place[first[a]:first[b]]] * rw[first[a]:first[b], None], first[a:b] - first[a], axis=0)
            for a, b in zip(cuts, cuts[1:])])
        shared = sims > 0
        sims = np.round(sims, 12)
        least = np.partition(sims, -k, axis=0)[-k] if len(sims) > k else np.zeros(n)
        doc, item = np.nonzero((shared & (sims >= least)).T)
        s = sims[item, doc]
        order = np.lexsort((item, -s, doc))
        doc, item, s = doc[order], item[order], s[order]
        kept = np.arange(len(doc)) - np.searchsorted(doc, doc) < k
        out.append((doc[kept] + lo, item[kept], s[kept]))
    return [np.concatenate(x) for x in zip(*out)]


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int,
            n_left: int | None = None, n_right: int | None = None) -> DataFrame:
    """``(left_id, right_id, text_similarity)``: at least the ``k`` best right documents of each
    left one (those of every right group) that share a term with it, from weight rows
    ``(id, idx, w)`` of positive weights, a document a row. ``n_left`` and ``n_right``, their
    numbers, set the number of groups."""
    from talentflow.session import ship_package
    ship_package(left.sparkSession)

    def groups(n, rows, size):
        return max(-(-(rows.count() if n is None else n) // size), 1)

    g_left, g_right = groups(n_left, left, LEFT_GROUP), groups(n_right, right, RIGHT_GROUP)
    l = left.select(F.col(left_id).alias("__l"), F.col("idx").cast("array<long>").alias("lk"), F.col("w").alias("lw"),
                    F.pmod(F.xxhash64(left_id), F.lit(g_left)).alias("__gl"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g_right - 1).cast("long"))).alias("__gr"))
    r = right.select(F.col(right_id).alias("__r"), F.col("idx").cast("array<long>").alias("rk"), F.col("w").alias("rw"),
                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g_left - 1).cast("long"))).alias("__gl"),
                     F.pmod(F.xxhash64(right_id), F.lit(g_right)).alias("__gr"))
    names = [left_id, right_id, "text_similarity"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if len(a) and len(b):
            b = b.take(pc.sort_indices(b, sort_keys=[("__r", "ascending")], null_placement="at_start"))
            i, j, s = _best(a, b, k)
        else:
            i, j, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return pa.table([a.column("__l").take(pa.array(i)), b.column("__r").take(pa.array(j)), pa.array(s)], names=names)

    kinds = [t.schema[c].dataType.simpleString() for t, c in ((left, left_id), (right, right_id))]
    return (l.groupBy("__gl", "__gr").cogroup(r.groupBy("__gl", "__gr"))
            .applyInArrow(run, f"`{left_id}` {kinds[0]}, `{right_id}` {kinds[1]}, text_similarity double"))


def _as_rows(w: DataFrame, id_col: str) -> DataFrame:
    """Weight rows of a long table ``(id, term, w)``, its terms by their hash."""
    if "term" not in w.columns:
        return w
    e = F.array_sort(F.collect_list(F.struct(F.xxhash64("term").alias("idx"), "w")))
    return w.groupBy(id_col).agg(e.alias("e")).select(id_col, F.col("e.idx").alias("idx"), F.col("e.w").alias("w"))


def cosine_topk(left_w: DataFrame, right_w: DataFrame, left_id: str, right_id: str,
                k: int = P.TOP_K, left_ids: DataFrame | None = None,
                right_ids: DataFrame | None = None, n_left: int | None = None,
                n_right: int | None = None) -> DataFrame:
    """Top-k right documents per left document (ties by right id), from long weights or
    weight rows.

    With the tables of all ids every left document gets ``min(k, right documents)`` rows:
    pairs that share no term count with similarity 0, by smallest right id.
    """
    from talentflow.session import cut_lineage
    order = [F.desc("text_similarity"), F.asc(right_id)]
    near = nearest(_as_rows(left_w, left_id), _as_rows(right_w, right_id), left_id, right_id, k, n_left, n_right)
    best = top_k(near, left_id, order, k, "text_rank")
    if left_ids is None or right_ids is None:
        return best
    best = cut_lineage(best.drop("text_rank"))
    fill = fill_pairs(best, left_ids, right_ids, left_id, right_id, k)
    return top_k(best.unionByName(fill), left_id, order, k, "text_rank")


def skill_fields(pairs: DataFrame, left_skills: DataFrame, right_skills: DataFrame,
                 left_id: str, right_id: str, left_col: str = "skill_set",
                 right_col: str = "job_skill_set") -> DataFrame:
    """L6 + D7 + D9: matching / missing skills and the overlap ratio per pair.

    Missing skill sets count as empty.
    """
    empty = F.array().cast("array<string>")
    j = (pairs.join(left_skills.select(left_id, left_col), left_id, "left")
              .join(right_skills.select(right_id, right_col), right_id, "left"))
    rs = F.coalesce(F.col(left_col), empty)
    js = F.coalesce(F.col(right_col), empty)
    return (j.withColumn("matching_skills", X.set_intersect(rs, js))
             .withColumn("missing_skills", X.set_minus(js, rs))
             .withColumn("skill_overlap", X.overlap_ratio(rs, js))
             .drop(left_col, right_col))


def hybrid_score(text_sim: str | Column = "text_similarity", overlap: str | Column = "skill_overlap",
                 w_text: float = P.W_TEXT, w_skill: float = P.W_SKILL) -> Column:
    """round(100 * (w_text * text + w_skill * overlap), 1)."""
    t = F.col(text_sim) if isinstance(text_sim, str) else text_sim
    o = F.col(overlap) if isinstance(overlap, str) else overlap
    return F.round(100.0 * (w_text * t + w_skill * o), 1)


def suitability(score: str | Column = "final_match_score", high: float = P.HIGHLY_SUITABLE_MIN,
                mid: float = P.SUITABLE_MIN) -> Column:
    """Tier from the (already rounded) score."""
    s = F.col(score) if isinstance(score, str) else score
    return (F.when(s >= high, F.lit(P.LABELS[2])).when(s >= mid, F.lit(P.LABELS[1]))
             .otherwise(F.lit(P.LABELS[0])))


def score_and_rank(scored: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """L7 + L8 + L9: hybrid score, percent columns, rank inside the left id, tier.

    Rank order: final score desc, text similarity desc, right id asc.
    """
    out = (scored.withColumn("final_match_score", hybrid_score())
                 .withColumn("text_match_pct", F.round(F.col("text_similarity") * 100.0, 1))
                 .withColumn("skill_overlap_pct", F.round(F.col("skill_overlap") * 100.0, 1)))
    w = Window.partitionBy(left_id).orderBy(F.desc("final_match_score"),
                                             F.desc("text_similarity"), F.asc(right_id))
    return (out.withColumn("rank", F.row_number().over(w))
               .withColumn("suitability", suitability()))


def hybrid_match(left_text: DataFrame, right_text: DataFrame, left_id: str, right_id: str,
                 left_txt: str, right_txt: str, left_skills: DataFrame, skill_patterns: dict,
                 k: int = P.TOP_K, unicode: bool = True, ascii_words: bool = False,
                 **tfidf_kw) -> DataFrame:
    """L4-L9 end to end: TF-IDF fit on both sides, top-k cosine, skills on the
    matched right documents only (left_semi before extraction), hybrid rank.

    ``left_skills`` is ``(left_id, skill_set)``.
    """
    from talentflow.operators import tfidf
    _, (lw, rw), sizes = tfidf.fit_rows([(left_text, left_id, left_txt),
                                         (right_text, right_id, right_txt)],
                                        unicode=unicode, **tfidf_kw)
    pairs = cosine_topk(lw, rw, left_id, right_id, k, left_text, right_text, *sizes).drop("text_rank")
    # used twice (matched-job filter and scoring): written once (n_left x k rows)
    from talentflow.session import cut_lineage
    pairs = cut_lineage(pairs)
    matched = right_text.join(pairs.select(right_id).distinct(), right_id, "left_semi")
    job_sk = matched.select(right_id, X.dict_extract(right_txt, skill_patterns, unicode=unicode)
                            .alias("job_skill_set"))
    scored = skill_fields(pairs, left_skills, job_sk, left_id, right_id)
    return score_and_rank(scored, left_id, right_id)


def jobs_for_candidate(matches: DataFrame, candidate_ids: DataFrame | None = None,
                       top_n: int = 10, cand: str = "candidate_id") -> DataFrame:
    """Best ``top_n`` stored matches of each requested candidate."""
    m = matches if candidate_ids is None else matches.join(candidate_ids.select(cand).distinct(),
                                                           cand, "left_semi")
    return m.filter(F.col("rank") <= top_n)


def candidates_for_job(left_w: DataFrame, right_w: DataFrame, job_ids: DataFrame,
                       left_skills: DataFrame, job_skills: DataFrame, left_id: str,
                       right_id: str, top_n: int = 5) -> DataFrame:
    """Score every left document against the requested jobs, shortlist
    3·n by text similarity, blend with skill overlap, keep n (H4).

    ``job_ids`` are known jobs and ``left_skills`` has a row for every left document:
    documents that share no term with a job count with similarity 0.
    """
    rw = right_w.join(job_ids.select(right_id).distinct(), right_id, "left_semi")
    short = cosine_topk(rw, left_w, right_id, left_id, 3 * top_n, job_ids, left_skills).drop("text_rank")
    scored = skill_fields(short, left_skills, job_skills, left_id, right_id)
    scored = (scored.withColumn("final_match_score", hybrid_score())
                    .withColumn("text_match_pct", F.round(F.col("text_similarity") * 100.0, 1))
                    .withColumn("skill_overlap_pct", F.round(F.col("skill_overlap") * 100.0, 1)))
    out = top_k(scored, right_id, [F.desc("final_match_score"), F.desc("text_similarity"),
                                   F.asc(left_id)], top_n)
    return out.withColumn("suitability", suitability())


def best_match(matches: DataFrame) -> DataFrame:
    """Rank-1 match per candidate, best first."""
    return matches.filter(F.col("rank") == 1).orderBy(F.desc("final_match_score"),
                                                       F.asc("candidate_id"))


def display_view(matches: DataFrame, n: int = 50) -> DataFrame:
    """Renamed columns, first ``n`` rows in (candidate, rank) order."""
    return (matches.orderBy("candidate_id", "rank").limit(n)
                   .select(F.col("candidate_id").alias("Candidate"),
                           F.col("job_title").alias("Job Role"),
                           F.col("final_match_score").alias("Match Score(%)"),
                           "rank", "suitability"))


def match_summary(matches: DataFrame, top_k_used: int = P.TOP_K) -> DataFrame:
    """One-row summary (F18 + F3 as a map of tier counts)."""
    tier_counts = F.create_map(*[x for lab in P.LABELS for x in
                                 (F.lit(lab), F.count_if(F.col("suitability") == lab))])
    return (matches.agg(F.count_distinct("candidate_id").alias("n_candidates_matched"),
                        F.count(F.lit(1)).alias("n_pairs"),
                        F.round(F.avg("final_match_score"), 2).alias("avg_final_match_score"),
                        F.map_filter(tier_counts, lambda k, v: v > 0).alias("suitability_counts"))
                   .withColumn("top_k", F.lit(top_k_used))
                   .withColumn("w_text", F.lit(P.W_TEXT)).withColumn("w_skill", F.lit(P.W_SKILL)))


# ---------------------------------------------------------------- lookups O1-O3

def skill_gap(matches: DataFrame, jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """O1: for (candidate_id, job_id|NULL) requests, matching / missing skills of
    that job or of the candidate's best match, plus the job's required skills.
    Unknown candidates or jobs give no row."""
    m = matches.select("candidate_id", "job_id", "job_title", "matching_skills",
                       "missing_skills", "final_match_score", "suitability")
    # one row a candidate, so that the matches are met once, by candidate alone
    asked = (requests.groupBy(F.col("candidate_id").alias("__c"))
             .agg(F.collect_set("job_id").alias("__jobs"), F.max(F.col("job_id").isNull()).alias("__any")))
    named = F.coalesce(F.array_contains("__jobs", F.col("job_id")), F.lit(False))
    first = F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("final_match_score"), F.asc("job_id"))) == 1
    # a row counts once as a job that was named and once more as the best one
    rows = (m.join(asked, F.col("candidate_id") == F.col("__c")).filter(F.col("__any") | named)
            .withColumn("__times", named.cast("int") + (F.col("__any") & first).cast("int")).filter(F.col("__times") > 0)
            .withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times"))))
            .drop("__c", "__jobs", "__any", "__times", "__time"))
    req = jobs.select("job_id", F.coalesce(F.col("required_skills"),
                                           F.array().cast("array<string>")).alias("job_required_skills"))
    return (rows.join(req, "job_id", "left")
                .withColumn("job_required_skills",
                            F.coalesce("job_required_skills", F.array().cast("array<string>")))
                .select("candidate_id", "job_id", "job_title",
                        F.col("matching_skills").alias("has_skills"), "missing_skills",
                        "job_required_skills", F.col("final_match_score").alias("match_score"),
                        "suitability"))


def recommend_candidates(matches: DataFrame, candidates: DataFrame, jobs: DataFrame,
                         top_n: int = 5) -> DataFrame:
    """O2: best ``top_n`` stored candidates per job, with role and job title."""
    top = top_k(matches.select("job_id", "candidate_id", "final_match_score", "suitability",
                               "matching_skills", "missing_skills"),
                "job_id", [F.desc("final_match_score"), F.asc("candidate_id")], top_n, "position")
    return (top.join(candidates.select("candidate_id", "role_applied"), "candidate_id", "left")
               .join(jobs.select("job_id", F.col("title").alias("job_title")), "job_id", "left"))


def recommend_jobs(matches: DataFrame, candidates: DataFrame, top_n: int = 5) -> DataFrame:
    """O3: best ``top_n`` stored jobs per candidate, with the candidate's role."""
    top = top_k(matches.select("candidate_id", "job_id", "job_title", "company_name",
                               "final_match_score", "suitability", "matching_skills",
                               "missing_skills"),
                "candidate_id", [F.desc("final_match_score"), F.asc("job_id")], top_n, "position")
    return top.join(candidates.select("candidate_id", "role_applied"), "candidate_id", "left")
