"""Text scalar functions (C1-C13), all Column -> Column.

Every function keeps the work inside the JVM (``regexp_replace`` & co.) except
``unescape_nfkc`` (C1a), which has no Spark builtin and is one Arrow-batched
UDF with a vectorised fast path for rows that need no change.

``unicode=True`` gives Python-``re``-like Unicode classes (``(?U)``); with
``unicode=False`` the same patterns run with ASCII classes, which is what the
RE2-based DuckDB oracle implements.
"""

from __future__ import annotations

import ctypes
import html
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentflow.plans import presets as P


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _flags(unicode: bool, ignore_case: bool = False) -> str:
    f = ("i" if ignore_case else "") + ("U" if unicode else "")
    return f"(?{f})" if f else ""


def blank_to_null(c: str | Column, unicode: bool = True) -> Column:
    """NULL or whitespace-only -> NULL."""
    c = _c(c)
    return F.when(~c.rlike(_flags(unicode) + r"^\s*$"), c)


@F.arrow_udf(T.StringType())
def unescape_nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """HTML entity unescape, then Unicode NFKC, then U+FFFD -> space.

    A batch may hold megabytes a row: only a few rows at a time are Python strings, and a task
    that ends hands its free memory back, as its worker lives on.
    """
    try:
        for batch in batches:
            done = [pa.array([], pa.string())]
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64).cast(pa.string())
                # rows that are pure ASCII and carry no '&' are unchanged by both steps
                need = pc.or_(pc.match_substring(part, "&"), pc.invert(pc.string_is_ascii(part)))
                if pc.any(need).as_py():
                    part = pa.array([unicodedata.normalize("NFKC", html.unescape(v.as_py())).replace("\ufffd", " ")
                                     if n.as_py() else v.as_py() for v, n in zip(part, need)], pa.string())
                done.append(part)
            yield pa.concat_arrays(done)
            del batch, done
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def light_clean(c: str | Column, drop_contact: bool = False, strip_header: bool = False,
                unescape: bool = True, unicode: bool = True) -> Column:
    """Meaning-preserving clean; keeps case and punctuation; blank -> NULL.

    Order: unescape+NFKC -> tags -> (header) -> (URL, e-mail, phone) ->
    CR/LF/TAB -> collapse whitespace -> trim -> '' -> NULL.
    """
    u = _flags(unicode)
    t = blank_to_null(c, unicode)
    if unescape:
        t = unescape_nfkc(t)
    t = F.regexp_replace(t, P.HTML_TAG_PATTERN, " ")
    if strip_header:
        t = F.regexp_replace(t, _flags(unicode, True) + P.JD_HEADER_PATTERN, "")
    if drop_contact:
        t = strip_contacts(t, unicode=unicode)
    t = F.regexp_replace(t, "[\r\n\t]", " ")
    t = F.regexp_replace(t, u + r"\s+", " ")
    t = F.trim(t)
    return F.nullif(t, F.lit(""))


def strip_contacts(c: str | Column, unicode: bool = True) -> Column:
    """C1d: URL, then e-mail, then phone -> space."""
    t = F.regexp_replace(_c(c), _flags(unicode, True) + P.URL_PATTERN, " ")
    t = F.regexp_replace(t, _flags(unicode) + P.EMAIL_PATTERN, " ")
    return F.regexp_replace(t, _flags(unicode) + P.PHONE_PATTERN, " ")


def lower_clean(c: str | Column, **kw) -> Column:
    """Lower-cased light clean (location keys)."""
    return F.lower(light_clean(c, **kw))


def norm_category(c: str | Column, clean_first: bool = True, **kw) -> Column:
    """C3: 'Full-time' -> 'full_time'; '' -> NULL.

    The job variant light-cleans first, the resume variant only blanks.
    """
    t = light_clean(c, **kw) if clean_first else blank_to_null(c, kw.get("unicode", True))
    t = F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_")
    return F.nullif(F.btrim(t, F.lit("_")), F.lit(""))


def norm_title(c: str | Column, **kw) -> Column:
    """C4: lower, expand sr/jr/mgr/assoc/dir, keep [a-z0-9+#/.\\s-], collapse."""
    u = _flags(kw.get("unicode", True))
    t = F.lower(light_clean(c, **kw))
    for pat, rep in P.TITLE_ABBREVIATIONS:
        t = F.regexp_replace(t, u + pat, rep)
    t = F.regexp_replace(t, u + r"[^a-z0-9+#/.\s-]", " ")
    t = F.trim(F.regexp_replace(t, u + r"\s+", " "))
    return F.nullif(t, F.lit(""))


def norm_skill(c: str | Column, **kw) -> Column:
    """C5: 'Art/Creative' -> 'art_creative'."""
    u = _flags(kw.get("unicode", True))
    t = F.lower(light_clean(c, **kw))
    t = F.replace(t, F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(t, r"[^a-z0-9+#. /-]", " ")
    t = F.regexp_replace(t, u + r"[\s/]+", "_")
    return F.nullif(F.btrim(t, F.lit("_")), F.lit(""))


def first_match(c: str | Column, pattern: str, unicode: bool = True,
                ignore_case: bool = False) -> Column:
    """First regex match on the raw text, else NULL."""
    return F.nullif(F.regexp_extract(_c(c), _flags(unicode, ignore_case) + pattern, 0), F.lit(""))


def first_email(c: str | Column, unicode: bool = True) -> Column:
    return first_match(c, P.EMAIL_PATTERN, unicode)


def first_phone(c: str | Column, unicode: bool = True) -> Column:
    return first_match(c, P.PHONE_PATTERN, unicode)


def char_count(c: str | Column) -> Column:
    """Characters, NULL -> 0."""
    return F.length(F.coalesce(_c(c), F.lit("")))


def word_count(c: str | Column, unicode: bool = True) -> Column:
    """Whitespace-separated words, NULL -> 0 (no array is materialised)."""
    return F.coalesce(F.regexp_count(_c(c), F.lit(_flags(unicode) + r"\S+")), F.lit(0))


def nlp_tokens(c: str | Column, stop_words=None) -> Column:
    """C8 + C8a: alternate cleaner up to stop-word removal, as a token array.

    Lower-cases first (the source forgot to and deleted every capital).
    """
    t = F.lower(F.coalesce(_c(c), F.lit("")))
    t = F.regexp_replace(t, r"<.*?>", " ")
    t = F.regexp_replace(t, r"http\S+|www\S+", " ")
    t = F.regexp_replace(t, r"\S+@\S+", " ")
    t = F.regexp_replace(t, r"[\n\r]", " ")
    t = F.regexp_replace(t, r"[^a-z0-9 ]", " ")
    toks = F.filter(F.split(t, " "), lambda x: x != "")
    sw = list(stop_words if stop_words is not None else P.spark_stop_words())
    return F.filter(toks, lambda x: ~x.isin(sw)) if sw else toks


def nlp_clean(c: str | Column, stop_words=None) -> Column:
    """C8 without lemmas: tokens joined by one space."""
    return F.array_join(nlp_tokens(c, stop_words), " ")


def title_lower(c: str | Column) -> Column:
    """lower(title), NULL -> ''."""
    return F.lower(F.coalesce(_c(c), F.lit("")))


def concat_text(a: str | Column, b: str | Column, sep: str = " ") -> Column:
    """Null-safe concatenation that always keeps the separator."""
    return F.concat(F.coalesce(_c(a), F.lit("")), F.lit(sep), F.coalesce(_c(b), F.lit("")))


def delimiter_count(c: str | Column, delim: str = "|") -> Column:
    """C11: LENGTH(x) - LENGTH(REPLACE(x, d, '')) + 1 (an empty string counts 1)."""
    c = _c(c)
    return F.length(c) - F.length(F.replace(c, F.lit(delim), F.lit(""))) + 1


def pct(num: Column, den: Column, digits: int = 2) -> Column:
    """Rounded percentage, NULL on a zero denominator."""
    return F.round(F.try_divide(num * 100.0, den), digits)
