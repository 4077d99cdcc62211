import duckdb
import pytest

from helpers import roots
from talentflow.llm import graph
from talentflow.llm import queries as Q
from talentflow.llm import url_redirects as U


@pytest.mark.parametrize("edges", [
    [], [(1, 1), (2, None)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)],
    [(3, 1), (2, 4), (3, 4), (9, 8), (8, 9), (9, 8)], [((i * 37) % 101, (i * 53 + 11) % 101) for i in range(70)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    want = roots({x for e in real for x in e}, real)
    assert {r.node: r.component for r in graph.components(df, "a", "b").collect()} == want
    assert graph.components(df, "a", "b").count() == len(want)


PAGES = [
    (1, "https://X.Example.ORG/es/1", ""), (2, "http://a.example.org/en/17?q#f", None), (3, "https://b.example.com/fr/1", ""),
    (4, "https://b.example.com/de/1", ""), (5, None, "<p>"), (6, "nourl", ""), (7, "https://example.org?x=/es/", ""),
    (8, "https://alias.net/a#top", '<link rel="canonical" href="https://b.example.com/de/9">'),
    (9, "https://alias.net/b", '<meta http-equiv="refresh" content="0; url=/a">'),
    (10, "https://mix.net/1", '<LINK HREF="https://c.example.com/de/2" REL=canonical>'),
    (11, "https://mix.net/2?utm_source=z", "<link rel='canonical' href='//site.org/x'><link rel=canonical href='1'>"),
    (12, "https://b.example.com/de/9", ""), (13, "https://notexample.org/es/", ""), (13, "https://notexample.org/es/", ""),
    (14, "ftp://org", ""), (15, "https://plain.net/", '<a href="https://b.example.com/de/1">canonical</a>')]


def test_rules_and_classes(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, host string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df).collect()}
    assert got[1] == ("x.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("a.example.org", "/en/17", "example.org/en/1", "block")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7] == ("example.org", "", None, "allow") and got[14] == ("org", "", None, "allow")
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "block")      # alias of a blocked page, and its alias
    assert got[10][2:] == (None, "allow") and got[11][2:] == (None, "allow")    # blocked and allowed aliases: allowed
    assert got[12][3] == "block" and got[13][2:] == ("org/", "allow") and got[15][2:] == (None, "allow")
    assert U.judge(df).count() == len(PAGES) and U.judge(df.limit(0)).count() == 0


def test_given_redirects(spark):
    df = spark.createDataFrame([(1, "https://a.net/1", ""), (2, "https://q.com/de/1", "")], "page_id long, url string, html string")
    moves = spark.createDataFrame([("https://a.net/1", "https://t.net/"), ("http://t.net/", "https://q.com/de/1"), (None, "x")], "f string, t string")
    assert {r.id: r.verdict for r in U.judge(df, redirects=moves).collect()} == {1: "block", 2: "block"}


def test_edges_of_any_valid_markup(spark):
    pages = [(1, "https://a.net/x/y/1", '<link\n rel="canonical"\n href="/n">', "a.net/n?"),
             (2, "https://a.net/2", '<meta\nhttp-equiv="refresh"\ncontent="0; url=/m?a=1&amp;b=2">', "a.net/m?a=1&b=2"),
             (3, "https://a.net/3", '<link rel="canonical" href="https://b.net/q?a=1&amp;b=2">', "b.net/q?a=1&b=2"),
             (4, "https://a.net/4", "<link href='/r' rel='alternate canonical'>", "a.net/r?"),
             (5, "https://a.net/x/y/5", '<link rel=canonical href="../z/./w?p=../1">', "a.net/x/z/w?p=../1"),
             (6, "https://a.net/x/y/6", '<link rel=canonical href="../../../..">', "a.net/?"),
             (7, "https://a.net/7", '<link rel="non-canonical" href="/none">', None)]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r.a: r.b for r in U.link_edges(df).collect()}
    assert got == {u.split("://")[1] + "?": b for _, u, _, b in pages if b}


def test_no_python_in_the_plan(spark, table):
    plan = U.judge(table("pages"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_oracle(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM read_parquet('/root/testdata/sf0.001/pages.parquet')")
    rows = con.execute(Q.ORACLES["op4_url_redirects"])
    cols = [c[0] for c in rows.description]
    want = sorted(rows.fetchall(), key=repr)
    got = [tuple(r[c] for c in cols) for r in Q.QUERIES["op4_url_redirects"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=repr) == want
