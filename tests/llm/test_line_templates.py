import pytest

from talentflow.llm import line_templates as T
from talentflow.llm import queries as Q


def _text(i, *lines):
    return "\n".join([f"opening of document number{i} alpha{i}x beta{i}y", *lines, f"closing words q{i}z stand here alone z{i}z",
                      " ".join(f"{i}{w}own" for w in "abcdefghijklmnopqrstuvwxyzabcdefgh")])


@pytest.fixture(params=[T.HELD_LINES, -1], autouse=True)
def _either_way(request, monkeypatch):
    monkeypatch.setattr(T, "HELD_LINES", request.param)


def _run(spark, docs, **params):
    df = spark.createDataFrame([(i, t, i, "x") for i, t in docs], "doc_id long, text string, n long, drop string")
    out = T.drop_recurring_lines(df, **params)
    assert out.columns == df.columns + ["__dropped"]
    return {r.doc_id: (r.text, r["__dropped"]) for r in out.collect()}


def test_recurring_templates_are_dropped(spark):
    letters = "abcdefghijkl"
    docs = [(i, _text(c, "All rights reserved.", f"Page {i} of 12 printed on day {i * 3}", f"the quick brown fox saw {c}{c}{c} and went on to sleep",
                      f"only{c} this{c} document{c} has{c} that{c} line{c}")) for i, c in enumerate(letters)]
    got = _run(spark, docs)
    for i, c in enumerate(letters):
        text, n = got[i]
        assert n == 3 and text.count("\n") == 3
        assert "rights" not in text and "Page" not in text and "fox" not in text and f"only{c}" in text


def test_texts_of_mostly_recurring_lines_lose_them(spark):
    """The texts of the test above without a long line of their own: 22 of 41 tokens recur."""
    docs = [(i, "\n".join([f"opening of document number{c} alpha{c}x beta{c}y", "All rights reserved.", f"Page {i} of 12 printed on day {i * 3}",
                           f"the quick brown fox saw {c}{c}{c} and went on to sleep", f"only{c} this{c} document{c} has{c} that{c} line{c}",
                           f"closing words q{c}z stand here alone z{c}z"])) for i, c in enumerate("abcdefghijkl")]
    got = _run(spark, docs)
    for i, c in enumerate("abcdefghijkl"):
        text, n = got[i]
        assert n == 3 and text.count("\n") == 2
        assert "rights" not in text and "Page" not in text and "fox" not in text and f"only{c}" in text


def test_passage_carried_by_shorter_texts_only(spark):
    passage = "this notice of nine words recurs in all texts"
    docs = [(i, f"{c}a {c}b {c}c {c}d {c}e {c}f\n{passage}") for i, c in enumerate("pqrst")]
    assert _run(spark, docs) == {i: (t.split("\n")[0], 1) for i, t in docs}


def test_templates_need_documents_and_similarity(spark):
    docs = [(i, _text(c, "shared by two documents only" if i < 2 else f"o{c} p{c} q{c}", "a b c d " + " ".join(f"{c}{j}x" * 2 for j in "pqrstuvw")))
            for i, c in enumerate("abcdefg")]
    got = _run(spark, docs)
    assert {i: t for i, (t, n) in got.items()} == dict(docs) and not any(n for _, n in got.values())


def test_copies_are_left_whole(spark):
    body = "\n".join(f"line {w} of a text that was copied {w} times {w}" for w in ["one", "two", "three", "four", "five"])
    copies = [(i, body + f"\nending {w}") for i, w in enumerate(["aa", "bb", "cc", "dd", "ee"])] + [(50 + i, body) for i in range(4)]
    others = [(100 + i, _text(c, "Some notice that all of them carry.")) for i, c in enumerate("abcdefgh")]
    got = _run(spark, copies + others + [(200, body + "\nSome notice that all of them carry.")])
    for i, t in copies:
        assert got[i] == (t, 0)
    assert all(got[i][1] == 1 for i, _ in others) and got[200] == (body, 1)


def test_defined_results(spark):
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "  \n x"), (5, "word " * 50000), (6, "a b c\n" * 3), (6, "a b c\n" * 3)]
    notice = [(10 + i, f"own text {c}{c} here\n\nThis notice recurs.\n") for i, c in enumerate("abcd")]
    got = _run(spark, docs + notice)
    assert {k: got[k] for k in (1, 2, 3, 4, 5, 6)} == {i: (t, 0) for i, t in docs}
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.drop_recurring_lines(df).count() == 0


def test_min_docs_counts_texts_not_rows(spark):
    same = [(i, "just one notice in here\nand words of the same text, every time") for i in range(9)]
    assert all(n == 0 for _, n in _run(spark, same).values())


def test_query(spark, table):
    docs = {r.doc_id: r.text for r in table("documents").collect()}
    rows = Q.QUERIES["op7_line_templates"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        kept, was = r.text.split("\n"), iter(docs[r.doc_id].split("\n"))
        assert all(any(x == y for y in was) for x in kept) or not r.text       # a subsequence of the lines
        assert docs[r.doc_id].count("\n") - r.text.count("\n") in (r.n_dropped, r.n_dropped - 1)


def test_lines_without_blanks_and_clashing_names(spark):
    notice = "本サイトの文章の無断転載を固く禁じますのでご了承ください"
    rows = [(i, f"{own}\n{notice}\n短い\n{i}234567890123456789012345", i) for i, own in enumerate(
        ["春の海は静かで広い", "山の道を一人で歩いた朝", "新しい本を買って読む", "友達と話した夜の町", "雨の音だけが聞こえる", "古い家に猫が三匹いる"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, __dropped int")
    out = T.drop_recurring_lines(df, out_col="gone").orderBy("doc_id").collect()
    assert [r.gone for r in out] == [1] * 6 and [r["__dropped"] for r in out] == list(range(6))
    # the short line and the number, which is a field, stay
    assert all(notice not in r.text and "短い" in r.text and r.text.endswith("012345") for r in out)
    with pytest.raises(ValueError):
        T.drop_recurring_lines(df)
