"""Type coercion, null handling and row-flag Column helpers."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentflow.plans import presets as P


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_long(c: str | Column) -> Column:
    """B1: text/float -> nullable long; '12.0' -> 12, 'abc'/'inf' -> NULL."""
    d = _c(c).try_cast("double")
    # non-finite doubles do not fit a long
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d.try_cast("long"))


def coerce_longs(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """B1 over every listed column present in ``df``."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: to_long(c) for c in present}) if present else df


def epoch_ms_to_ts(c: str | Column) -> Column:
    """B2: epoch milliseconds -> timestamp, bad -> NULL."""
    return F.timestamp_millis(to_long(c))


def add_epoch_timestamps(df: DataFrame, cols: Iterable[str], suffix: str = "_dt") -> DataFrame:
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c + suffix: epoch_ms_to_ts(c) for c in present}) if present else df


def standardize_column_names(df: DataFrame) -> DataFrame:
    """Strip, lower, spaces -> '_' for every column name."""
    return df.toDF(*[re.sub(r" ", "_", c.strip().lower()) for c in df.columns])


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Per-column default values."""
    return df.fillna(defaults)


def drop_null_keys(df: DataFrame, subset: list[str]) -> DataFrame:
    """B5."""
    return df.na.drop(subset=subset)


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Missing names are ignored."""
    return df.drop(*cols)


def project(df: DataFrame, mapping: dict[str, str] | list[str]) -> DataFrame:
    """Projection with rename ({old: new} or a list of names)."""
    if isinstance(mapping, dict):
        return df.select(*[F.col(o).alias(n) for o, n in mapping.items()])
    return df.select(*mapping)


def replace_sentinels(c: str | Column, sentinels=tuple(P.SCRAPE_SENTINELS),
                      default: str = P.NOT_SPECIFIED) -> Column:
    """Scraping sentinels and NULL -> default."""
    c = _c(c)
    return F.coalesce(F.when(~c.isin(*sentinels), c), F.lit(default))


def fill_from_key(name: str | Column, key: str | Column,
                  prefix: str = P.UNKNOWN_INDUSTRY_PREFIX) -> Column:
    """Missing lookup name -> prefix || key."""
    return F.coalesce(_c(name), F.concat(F.lit(prefix), _c(key).cast("string")))


def date_parts(df: DataFrame, ts: str, prefix: str) -> DataFrame:
    """Year / month / day columns."""
    t = F.col(ts)
    return df.withColumns({f"{prefix}_year": F.year(t), f"{prefix}_month": F.month(t),
                           f"{prefix}_day": F.dayofmonth(t)})


def any_present(*cols: str | Column) -> Column:
    """True when any of the columns is non-null."""
    return F.coalesce(*[_c(c) for c in cols]).isNotNull()


def strict_bool(c: str | Column) -> Column:
    """Nullable 1.0 -> boolean (NULL -> False)."""
    return F.coalesce(_c(c) == 1, F.lit(False))


def outlier_flag(c: str | Column, cap: float = P.SALARY_CAP) -> Column:
    """Non-null and (<= 0 or > cap)."""
    c = _c(c)
    return c.isNotNull() & ((c <= 0) | (c > cap))


def mask_outlier(c: str | Column, cap: float = P.SALARY_CAP) -> Column:
    """The value when it lies in (0, cap], else NULL."""
    c = _c(c)
    return F.when((c > 0) & (c <= cap), c)


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def kth_value(df: DataFrame, col: str, k: int, small: int = 10_000, buckets: int = 1024):
    """The ``k``-th smallest (from 0) finite value of a numeric column, exactly.

    Each pass counts the values per equal range of the current interval (``buckets`` rows come
    to the driver) and goes on with the range that holds the rank, until it holds one value
    or at most ``small`` rows. An interval whose length overflows is measured in halves; one too
    short to be divided holds at most ``buckets`` different values, which are counted singly.
    """
    v = F.col(col).cast("double")
    rows = df.filter(_finite(v)).select(v.alias("v"))
    while True:
        lo, hi, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
        if lo == hi:
            return lo
        if n <= small:
            return sorted(r.v for r in rows.collect())[k]
        half = 1.0 if abs(hi - lo) < float("inf") else 0.5
        width = (hi * half - lo * half) / buckets
        if width:
            part = F.least(F.floor((F.col("v") * half - F.lit(lo * half)) / F.lit(width)), F.lit(buckets - 1)).cast("double")
        else:
            part = F.col("v")
        for b, c in sorted((r.b, r.c) for r in rows.groupBy(part.alias("b")).agg(F.count("*").alias("c")).collect()):
            if k < c:
                rows = rows.filter(part == b)
                break
            k -= c


def median(df: DataFrame, col: str):
    """The exact median (mean of the two middle values), or None without values."""
    v = F.col(col).cast("double")
    n = df.filter(_finite(v)).count()
    if not n:
        return None
    low = kth_value(df, col, (n - 1) // 2)
    return low if n % 2 else 0.5 * low + 0.5 * kth_value(df, col, n // 2)


def median_impute(df: DataFrame, col: str, known_flag: str | None = None) -> DataFrame:
    """Fill NULL with the column's exact median (plus an optional known-flag).

    The median is found by range counts (``kth_value``): no task sees more than a range of
    values. ``df`` is read once per pass: hand over a stored table if it is costly.
    """
    med = median(df, col)
    out = df
    if known_flag:
        out = out.withColumn(known_flag, F.col(col).isNotNull().cast("int"))
    return out.withColumn(col, F.coalesce(F.col(col).cast("double"), F.lit(med).cast("double")))


def zero_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """B15."""
    return df.fillna(0, subset=cols)


def has_text(c: str | Column) -> Column:
    """Non-null (empty text is read as NULL)."""
    return _c(c).isNotNull()


def sample_rows(df: DataFrame, n: int, seed: int = 42, order_key: str | None = None) -> DataFrame:
    """Exactly ``n`` pseudo-random rows (a sampling operator).

    Random order by a hash of the row key keeps it deterministic; the limit
    is the feature here.
    """
    key = F.xxhash64(F.col(order_key), F.lit(seed)) if order_key else F.rand(seed)
    return df.orderBy(key).limit(n)
