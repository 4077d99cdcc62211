"""URL filter with redirect equivalence (operator 4), DataFrame operations only.

Rules ``(host, path) -> allow | block`` judge a url; the longest that fits wins. Redirects
(``<meta http-equiv=refresh>``, or a given table) and canonical links of the pages are edges
between url keys (scheme, fragment and tracking parameters dropped); the connected
components of these edges are alias classes. A page that no rule fits takes the decision of
its class: allowed if any alias is explicitly allowed, else blocked if any is blocked, else
allowed.

Scale: the pages' html is read only to find edges and never shuffled; components run on the
(few) urls that have an edge; a class's decision is a partial aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentflow.llm.graph import components
from talentflow.llm.store import materialise

#: (rule, verdict)
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block")]
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key(url: Column) -> Column:
    """Identity of a url: lower-cased host, path and query, without tracking parameters,
    scheme and fragment. Null without ``://``."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike("^(utm_[a-z]+|fbclid|gclid)=") & (p != "")), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), path(url), F.lit("?"), kept))


def matching_rule(h: Column, p: Column, rules=tuple(RULES)) -> Column:
    """The longest rule that fits a host (or one above it) and the start of the path."""
    def fits(rule):
        rh, _, rp = rule.partition("/")
        return ((h == rh) | h.endswith("." + rh)) & p.startswith("/" + rp)
    ordered = sorted((r for r, _ in rules), key=lambda r: (-len(r), r))
    return F.coalesce(*[F.when(fits(r), F.lit(r)) for r in ordered], F.lit(None).cast("string"))


def _without_dots(url: Column) -> Column:
    """An absolute url whose path has no ``.`` and ``..`` segments."""
    segments = F.split(F.regexp_extract(url, r"^[^?#]*?://[^/?#]*/([^?#]*)", 1), "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(segments, none, lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))
                       .when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    kept = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    plain = F.concat(F.regexp_extract(url, r"^[^?#]*?://[^/?#]*/", 0), F.array_join(kept, "/"), F.regexp_extract(url, r"(?s)[?#].*$", 0))
    return F.when(url.rlike(r"^[^?#]*?://[^/?#]*/(?:[^?#]*/)?\.\.?(?:[/?#]|$)"), plain).otherwise(url)


def _absolute(target: Column, url: Column) -> Column:
    """A link target as an absolute url, as seen from ``url``."""
    scheme = F.concat(F.regexp_extract(url, r"^([^:]*)://", 1), F.lit("://"))
    base = F.regexp_extract(url, r"^([^?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    base = F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))
    return (F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"^([^:]*):", 1), F.lit(":"), target))
            .when(target.startswith("/"), F.concat(scheme, host(url), target))
            .otherwise(F.concat(base, target)))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``a, b``: url keys that a canonical link or a refresh of the page ties together."""
    html, url = F.col(html_col), F.col(url_col)
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<(?:link|meta)\b[^>]*(?:canonical|refresh)[^>]*>)"), F.lit(1))
    tag = F.regexp_replace(F.col("tag"), "(?i)&(?:amp|#38|#x26);", "&")
    rel = r"""(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))"""
    href = F.regexp_extract(tag, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    to = F.regexp_extract(tag, r"(?i)\burl\s*=\s*['\"]?([^\"'\s>;]+)", 1)
    target = (F.when(tag.rlike(r"(?is)^<link\b.*\brel\s*=\s*" + rel), href)
              .when(tag.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"), to))
    found = (pages.filter(html.rlike("(?i)canonical|refresh"))
             .select(url.alias("__url"), F.explode(tags).alias("tag"))
             .select(F.col("__url"), target.alias("__to")).filter("__to <> ''"))
    return found.select(key(F.col("__url")).alias("a"), key(_without_dots(_absolute(F.col("__to"), F.col("__url")))).alias("b"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          rules=tuple(RULES), redirects: DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """One row per page: ``id, host, path, rule, component, verdict``.

    A null url, or one without ``://``, has an empty host and path, fits no rule and has no
    aliases: the default verdict. Repeated rows are judged each. ``redirects`` may hold
    further edges as urls in its first two columns."""
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        x, y = redirects.columns[:2]
        edges = edges.union(redirects.select(key(F.col(x)), key(F.col(y))))
    classes = components(edges, "a", "b")
    url = F.col(url_col)
    verdict_of = reduce(lambda c, r: c.when(F.col("rule") == r[0], F.lit(r[1])), rules, F.when(F.lit(False), F.lit("")))
    seen = (pages.select(F.col(id_col).alias("id"), host(url).alias("host"), path(url).alias("path"), key(url).alias("node"))
            .withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("own", verdict_of))
    seen = materialise(seen.join(classes, "node", "left")
                       .withColumn("component", F.coalesce("component", "node")).drop("node"), "judged-urls")
    by_class = (seen.filter("component IS NOT NULL AND own IS NOT NULL").groupBy("component")
                .agg(F.bool_or(F.col("own") == "allow").alias("allowed")))
    from_class = F.when(F.col("allowed"), F.lit("allow")).when(~F.col("allowed"), F.lit("block")).otherwise(F.lit(default))
    return (seen.join(by_class, "component", "left")
            .select("id", "host", "path", "rule", "component", F.coalesce("own", from_class).alias("verdict")))
