"""Dictionary extraction and array functions.

The dictionaries are plain ``{name: regex}`` mappings expanded into one
``rlike`` per entry inside a single projection, so the whole extraction stays
in whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentflow.plans import presets as P


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once per row (bound to a lambda
    variable). Generated code does not share a subexpression referenced from
    many conditional branches, so a lower-cased text used by one guard per
    dictionary entry would otherwise be recomputed for every entry."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _rx(pattern: str, ignore_case: bool, unicode: bool) -> str:
    f = ("i" if ignore_case else "") + ("U" if unicode else "")
    return (f"(?{f})" if f else "") + pattern


def ascii_word_pattern(word: str) -> str:
    """Whole-word pattern with explicit ASCII boundaries (same in Java and RE2)."""
    return f"(^|[^A-Za-z0-9_])(?:{word})([^A-Za-z0-9_]|$)"


_ASCII_WORD = re.compile(r"^\(\^\|\[\^A-Za-z0-9_\]\)\(\?:([A-Za-z0-9 ]+)\)\(\[\^A-Za-z0-9_\]\|\$\)$")


_WB_LITERAL = re.compile(r"^\\b([A-Za-z0-9][A-Za-z0-9 ]*)\\b$")


def _java_fast(pattern: str, unicode: bool = False) -> str:
    """Same matches, faster in Java: whole-word alternatives become
    literal-first with look-arounds, so the engine can skip ahead on the
    literal instead of testing a boundary at every position. A pattern of
    ``ascii_word_pattern`` is rewritten with ASCII classes; with ``unicode``
    (``(?U)``, where ``\\b`` and ``\\w`` agree) every ``\\bliteral\\b``
    alternative is rewritten. RE2 has no look-arounds, so SQL twins keep the
    original form."""
    m = _ASCII_WORD.match(pattern)
    if m:
        w = m.group(1)
        return f"{w}(?<![A-Za-z0-9_]{w})(?![A-Za-z0-9_])"
    if not unicode:
        return pattern
    alts = []
    for a in _split_top(pattern):
        m = _WB_LITERAL.match(a)
        alts.append(f"{m.group(1)}(?<!\\w{m.group(1)})(?!\\w)" if m else a)
    return "|".join(alts)


def _split_top(p: str) -> list[str]:
    """Top-level alternatives of a regex (``|`` outside groups / classes)."""
    out, depth, cls, cur, i = [], 0, False, "", 0
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            cur += p[i:i + 2]
            i += 2
            continue
        if cls:
            cls = ch != "]"
        elif ch == "[":
            cls = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            out.append(cur)
            cur = ""
            i += 1
            continue
        cur += ch
        i += 1
    return out + [cur]


def _longest_literal(alt: str) -> str:
    """Longest run of plain characters every match of ``alt`` must contain."""
    runs, cur, i = [], [], 0
    while i < len(alt):
        ch = alt[i]
        if ch == "\\" and i + 1 < len(alt):
            nxt = alt[i + 1]
            if nxt.isalnum():           # \b \s \d \w ...: not a literal
                runs.append(cur)
                cur = []
            else:
                cur.append(nxt)
            i += 2
        elif ch in "([":
            runs.append(cur)
            cur = []
            depth, j = 0, i
            close = ")" if ch == "(" else "]"
            while j < len(alt):          # skip the whole group / class
                if alt[j] == "\\":
                    j += 2
                    continue
                if alt[j] == ch:
                    depth += 1
                elif alt[j] == close:
                    depth -= 1
                    if depth == 0:
                        break
                j += 1
            i = j + 1
            if i < len(alt) and alt[i] in "?*+{":
                i += 1
        elif ch in "?*{":
            if cur:
                cur.pop()               # the quantified char is optional
            runs.append(cur)
            cur = []
            if ch == "{":
                while i < len(alt) and alt[i] != "}":
                    i += 1
            i += 1
        elif ch == "+":
            runs.append(cur)            # one copy is required, keep it
            cur = []
            i += 1
        elif ch in "^$.":
            runs.append(cur)
            cur = []
            i += 1
        else:
            cur.append(ch)
            i += 1
    runs.append(cur)
    best = max(("".join(r) for r in runs), key=len)
    return best


def required_literals(pattern: str) -> list[str] | None:
    """One literal per top-level alternative that any match must contain, or
    None when some alternative has none (then no pre-filter is used)."""
    lits = [_longest_literal(a).lower() for a in _split_top(pattern)]
    return lits if all(lits) else None


def dict_extract(c: str | Column, patterns: dict[str, str], ignore_case: bool = True,
                 unicode: bool = True, sort: bool = True, prefilter: bool = True,
                 rewrite: bool = True) -> Column:
    """Every name whose pattern is found in the text (sorted; NULL -> []).

    ``prefilter``: each regex is guarded by a cheap ``contains`` of the
    literal(s) its matches must include (on the lower-cased text), so the
    regex engine only runs on rows that can match.
    """
    t = _c(c)

    def fast(p):
        return _java_fast(p, unicode) if rewrite else p

    def guard(p, low):
        lits = required_literals(fast(p)) if prefilter else None
        if not lits:
            return F.lit(True)
        g = None
        for lit in lits:
            x = low.contains(lit)
            g = x if g is None else (g | x)
        return g

    def hits(low):
        return F.array_compact(F.array(*[
            F.when(guard(p, low) & t.rlike(_rx(fast(p), ignore_case, unicode)), F.lit(name))
            for name, p in patterns.items()]))

    arr = once(F.lower(t), hits) if prefilter else hits(None)
    arr = F.coalesce(arr, F.array().cast("array<string>"))
    return F.array_sort(arr) if sort else arr


def substring_extract(c: str | Column, words: list[str] = P.SUBSTRING_SKILLS) -> Column:
    """Dictionary words contained in lower(text), in dictionary order."""
    return once(F.lower(F.coalesce(_c(c), F.lit(""))),
                lambda t: F.array_compact(F.array(*[F.when(t.contains(w), F.lit(w)) for w in words])))


def ordinal_levels(c: str | Column, patterns: dict[str, str] = P.EDUCATION_PATTERNS,
                   rank: dict[str, int] = P.EDUCATION_RANK, ignore_case: bool = True,
                   unicode: bool = True) -> Column:
    """D3: levels found, ordered by their ordinal rank."""
    t = _c(c)
    hits = [F.when(t.rlike(_rx(p, ignore_case, unicode)),
                   F.struct(F.lit(rank[name]).alias("r"), F.lit(name).alias("n")))
            for name, p in patterns.items()]
    arr = F.array_sort(F.array_compact(F.array(*hits)))
    return F.coalesce(F.transform(arr, lambda s: s["n"]), F.array().cast("array<string>"))


def highest_level(levels: str | Column) -> Column:
    """Last (highest) level, NULL when none."""
    return F.try_element_at(_c(levels), F.lit(-1))


def level_rank(level: str | Column, rank: dict[str, int] = P.EDUCATION_RANK) -> Column:
    """Stored level -> ordinal, unknown -> 0."""
    m = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, _c(level)), F.lit(0))


def level_cascade(c: str | Column, cascade=P.UPLOAD_EDUCATION_CASCADE) -> Column:
    """First matching rule on lower(text) wins, else 0."""
    def rules(t):
        out = F.lit(0)
        for r, p in reversed(cascade):
            out = F.when(t.rlike(p), F.lit(r)).otherwise(out)
        return out
    return once(F.lower(F.coalesce(_c(c), F.lit(""))), rules)


def max_number(c: str | Column, pattern: str = P.YEARS_PATTERN,
               lo_exclusive: int = P.YEARS_MIN_EXCLUSIVE, hi: int = P.YEARS_MAX,
               ignore_case: bool = True) -> Column:
    """Max of all captured numbers with lo < n <= hi, else NULL."""
    vals = F.transform(F.regexp_extract_all(_c(c), F.lit(_rx(pattern, ignore_case, False)), 1),
                       lambda x: x.try_cast("int"))
    return F.array_max(F.filter(vals, lambda v: (v > lo_exclusive) & (v <= hi)))


def first_number(c: str | Column, pattern: str = P.UPLOAD_YEARS_PATTERN,
                 default: float = P.UPLOAD_DEFAULT_YEARS, ignore_case: bool = True):
    """(first captured number or default, known flag 1/0)."""
    v = F.nullif(F.regexp_extract(F.coalesce(_c(c), F.lit("")),
                                  _rx(pattern, ignore_case, False), 1), F.lit("")).try_cast("double")
    return F.coalesce(v, F.lit(float(default))), v.isNotNull().cast("int")


def pipe_to_set(c: str | Column, delim: str = "|") -> Column:
    """D6: 'a|b||a' -> [a, b] (NULL/blank -> [])."""
    parts = F.split(F.coalesce(_c(c), F.lit("")), "\\" + delim if delim in "|.^$*+?()[]{}\\" else delim)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def set_intersect(a: str | Column, b: str | Column) -> Column:
    """Sorted a ∩ b."""
    return F.array_sort(F.array_intersect(_c(a), _c(b)))


def set_minus(a: str | Column, b: str | Column) -> Column:
    """Sorted a − b."""
    return F.array_sort(F.array_except(_c(a), _c(b)))


def safe_size(c: str | Column) -> Column:
    """Size with NULL -> 0."""
    return F.coalesce(F.size(_c(c)), F.lit(0))


def overlap_ratio(resume: str | Column, job: str | Column, digits: int = 4) -> Column:
    """|r ∩ j| / |j| rounded, 0 when j is empty."""
    j = _c(job)
    inter = F.size(F.array_intersect(_c(resume), j))
    return F.when(safe_size(j) > 0, F.round(inter / F.size(j), digits)).otherwise(F.lit(0.0))


def first_item(c: str | Column) -> Column:
    """First element or NULL."""
    return F.try_element_at(_c(c), F.lit(1))


def item_frequency(df: DataFrame, array_col: str, item: str = "skill",
                   count: str = "job_count") -> DataFrame:
    """Explode lists and count, most frequent first (ties by item)."""
    return (df.select(F.explode(array_col).alias(item))
              .groupBy(item).agg(F.count(F.lit(1)).alias(count))
              .orderBy(F.desc(count), F.asc(item)))
