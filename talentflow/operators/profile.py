"""Profiling, data quality and validation operators.

Every profile is one aggregation pass (partial aggregation per partition,
one small final merge); nothing is collected to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentflow.functions.coerce import median
from talentflow.plans import presets as P


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_profile(df: DataFrame, digits: int = 2) -> DataFrame:
    """``(column, null_pct)`` for columns with nulls, most missing first."""
    aggs = [F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"c{i}")
            for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    stacked = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.round(F.col(f"c{i}") * 100.0, digits).alias("null_pct"))
        for i, c in enumerate(df.columns)])).alias("s")).select("s.*")
    return stacked.filter(F.col("null_pct") > 0).orderBy(F.desc("null_pct"), F.asc("column"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """number of rows that repeat an earlier identical row (NULLs equal)."""
    return (df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
              .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))


def rows_sharing_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """every row whose key occurs more than once (keep=False).

    Key counts are a partially aggregated ``groupBy`` (a hot key collapses
    map-side) joined back with a semi join, rather than a window that would
    hold a hot key's rows in one task.
    """
    multi = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1).drop("__n")
    return df.join(multi, keys, "left_semi")


def quality_report(tables: dict[str, DataFrame]) -> DataFrame:
    """per table rows, columns, duplicate rows and a "col (nulls)" list."""
    parts = []
    for name, df in tables.items():
        counts = df.agg(F.count(F.lit(1)).alias("rows"),
                        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}")
                          for i, c in enumerate(df.columns)])
        items = [F.when(F.col(f"n{i}") > 0, F.format_string(f"{c} (%d)", F.col(f"n{i}")))
                 for i, c in enumerate(df.columns)]
        missing = F.concat_ws(", ", *items)
        summ = counts.select(F.lit(name).alias("dataset"), "rows",
                             F.lit(len(df.columns)).alias("columns"),
                             F.when(missing == "", F.lit("No Missing Data")).otherwise(missing)
                             .alias("columns_with_nulls"))
        dup = duplicate_rows(df)
        # both are one-row aggregates of the same table; combine by name
        parts.append(summ.join(dup.withColumn("dataset", F.lit(name)), "dataset"))
    return reduce(DataFrame.unionByName, parts)


def coverage(df: DataFrame, nonnull: dict[str, str] | None = None,
             predicates: dict[str, Column] | None = None, means: dict[str, str] | None = None,
             distinct: dict[str, str] | None = None, digits: int = 1,
             n_name: str = "n") -> DataFrame:
    """one-row coverage metrics.

    ``nonnull``: {metric: column} -> % non-null; ``predicates``: {metric: bool
    Column} -> % true; ``means``: {metric: column} -> mean; ``distinct``:
    {metric: column} -> exact distinct count.
    """
    aggs = [F.count(F.lit(1)).alias(n_name)]
    for m, c in (nonnull or {}).items():
        aggs.append(F.round(F.avg(F.col(c).isNotNull().cast("double")) * 100.0, digits).alias(m))
    for m, p in (predicates or {}).items():
        aggs.append(F.round(F.avg(F.coalesce(p, F.lit(False)).cast("double")) * 100.0, digits).alias(m))
    for m, c in (means or {}).items():
        aggs.append(F.avg(c).alias(m))
    for m, c in (distinct or {}).items():
        aggs.append(F.count_distinct(c).alias(m))
    return df.agg(*aggs)


def readiness(metrics: DataFrame, weights: dict[str, dict[str, float]] = P.JOB_READINESS) -> DataFrame:
    """weighted sums of rounded coverages -> int, rounding half to even."""
    cols = [F.bround(reduce(lambda a, b: a + b, [F.col(m) * w for m, w in parts.items()]), 0)
            .cast("int").alias(name) for name, parts in weights.items()]
    return metrics.select("*", *cols)


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """F16: (column, mean, std, min, median, max): one aggregation pass, and the exact medians
    by range counts."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"mean{i}"), F.stddev_samp(c).alias(f"std{i}"),
                 F.min(c).cast("double").alias(f"min{i}"), F.max(c).cast("double").alias(f"max{i}")]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"mean{i}").alias("mean"),
                 F.col(f"std{i}").alias("std"), F.col(f"min{i}").alias("min"),
                 F.lit(median(df, c)).cast("double").alias("median"), F.col(f"max{i}").alias("max"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")


def issue_counts(df: DataFrame, issues: dict[str, Column]) -> DataFrame:
    """one-row conditional counts."""
    return df.agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(n) for n, p in issues.items()])


def quarantine_split(df: DataFrame, text: str, min_chars: int = P.MIN_CHARS_KEEP):
    """K2: (kept, quarantined): quarantined = NULL text or < min_chars chars."""
    bad = F.col(text).isNull() | (F.length(F.coalesce(F.col(text), F.lit(""))) < min_chars)
    return df.filter(~bad), df.filter(bad)


def low_quality(words: str | Column, min_words: int = P.MIN_WORDS) -> Column:
    """K3: fewer than ``min_words`` words."""
    return _c(words) < min_words


def unique_violations(df: DataFrame, key: str | list[str]) -> DataFrame:
    """K4/K8 primary key: keys that are NULL or occur more than once."""
    keys = [key] if isinstance(key, str) else key
    null_any = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    dup = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
             .filter((F.col("n") > 1) | null_any)
             .withColumn("violation", F.when(null_any, F.lit("null_key")).otherwise(F.lit("duplicate_key"))))
    return dup


def nonnull_violations(df: DataFrame, cols: list[str], id_col: str) -> DataFrame:
    """K4: rows with NULL in a required column."""
    cond = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return df.filter(cond).select(id_col)


def rank_start_violations(df: DataFrame, group: str, rank: str = "rank") -> DataFrame:
    """K4: groups whose smallest rank is not 1."""
    return df.groupBy(group).agg(F.min(rank).alias("min_rank")).filter(F.col("min_rank") != 1)


def disjoint_violations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """K4: keys present on both sides (split leak)."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "inner")


def fk_violations(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """K8 foreign key: child rows whose key has no parent (NULL keys included)."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def resume_completeness(skill_count: str, highest_edu: str, words: str, years: str,
                        w=P.RESUME_COMPLETENESS) -> Column:
    """K5."""
    return F.round(w["skills"] * (F.col(skill_count) > 0).cast("double")
                   + w["education"] * F.col(highest_edu).isNotNull().cast("double")
                   + w["words_100"] * (F.col(words) >= 100).cast("double")
                   + w["years"] * F.col(years).isNotNull().cast("double"), 3)


def jd_completeness(words: str | Column, bands=P.JD_COMPLETENESS_BANDS) -> Column:
    """K6: <50 words -> .25, 50..150 -> .60, >150 -> 1.0 (NULL -> .50)."""
    w = _c(words)
    return (F.when(w < 50, F.lit(bands[0])).when(w.between(50, 150), F.lit(bands[1]))
             .when(w > 150, F.lit(bands[2])).otherwise(F.lit(0.5)))


def job_quality(completeness: str | Column, skill_count: str | Column) -> Column:
    """K7: round(0.6*completeness + 0.4*min(skills/5, 1), 3)."""
    return F.round(0.6 * _c(completeness) + 0.4 * F.least(_c(skill_count) / 5.0, F.lit(1.0)), 3)
