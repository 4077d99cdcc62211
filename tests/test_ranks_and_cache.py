import random

from pyspark.sql import functions as F

from talentflow.operators import dedup as DD
from talentflow.plans import analytics as A
from talentflow.sources import io


def test_ranks_with_one_hot_value(spark):
    """Nine tenths of a part share one value: ranks are exact and no range holds that value whole."""
    r = random.Random(3)
    rows = [("hot", 5.0 if i % 10 else float(r.randrange(9)), i) for i in range(4000)]
    rows += [("small", None, 1), ("small", 2.0, 2), ("small", 2.0, 0), (None, 1.0, 7), (None, None, 8)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "p string, v double, t long").repartition(8)
    ranked = A.rank_desc(df, "p", "v", "t", after="nxt").collect()
    got = {(x["p"], x["t"]): (x["__rank"], x["__n"], x["nxt"]) for x in ranked}
    want = {}
    for p in ("hot", "small", None):
        part = sorted((x for x in rows if x[0] == p), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        for i, x in enumerate(part):
            want[p, x[2]] = (i + 1, len(part), part[i + 1][1] if i + 1 < len(part) else None)
    assert got == want


def test_ranks_of_an_empty_table(spark):
    assert A.rank_desc(spark.createDataFrame([], "p string, v double, t long"), "p", "v", "t").count() == 0


def test_cache_computes_only_what_is_new(spark, tmp_path):
    seen = []

    def embed(some):
        seen.append(sorted(r.id for r in some.collect()))
        return some.select("id", F.array(F.length("text").cast("double")).alias("vec"))

    def run(rows):
        df = spark.createDataFrame(rows, "id long, text string")
        return {r.id: r.vec for r in io.embedding_cache(df, "id", "vec", str(tmp_path / "c"), "text", embed).collect()}
    rows = [(1, "a"), (2, "bb"), (2, "bb"), (None, "zz")]
    assert run(rows) == {1: [1.0], 2: [2.0]} and seen == [[1, 2]]
    assert run(rows) == {1: [1.0], 2: [2.0]} and len(seen) == 1          # nothing new, nothing written
    assert run([(1, "a"), (2, "ccc"), (3, "dddd")]) == {1: [1.0], 2: [3.0], 3: [4.0]} and seen[1] == [2, 3]
    assert run(rows) == {1: [1.0], 2: [2.0]} and len(seen) == 2          # the former content is still there
    (tmp_path / "c" / "batch-torn").mkdir()                              # a run that was lost
    assert run(rows) == {1: [1.0], 2: [2.0]}
    assert run([]) == {}


def test_cache_of_given_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None)], "id long, v array<double>")
    for path in (None, str(tmp_path / "v"), str(tmp_path / "v")):
        assert {r.id: r.v for r in io.embedding_cache(df, "id", "v", path).collect()} == {1: [1.0, 2.0], 2: None}


def test_lsh_reaches_its_recall_without_a_vocabulary(spark):
    """Planted pairs just above the threshold among unrelated texts; copies form classes."""
    r = random.Random(1)
    rows, want = [], set()

    def unit(terms):
        n = sum(w * w for w in terms.values()) ** 0.5
        return {t: w / n for t, w in terms.items()}
    for i in range(0, 600, 2):
        a = {f"w{r.randrange(10 ** 9)}": 1.0 for _ in range(60)}
        b = dict(a)
        for t in r.sample(sorted(a), 2):                                  # 58 of 60 terms shared: 0.967
            del b[t]
            b[f"x{r.randrange(10 ** 9)}"] = 1.0
        rows += [(i, t, w) for t, w in unit(a).items()] + [(i + 1, t, w) for t, w in unit(b).items()]
        want.add((i, i + 1))
    rows += [(j, t, w) for j in (900, 901, 902) for i, t, w in rows if i == 0]
    df = spark.createDataFrame(rows, "id long, term string, w double")
    members, pairs = DD.lsh_classes(df, "id", 0.95)
    found = {(x.a, x.b) for x in pairs.collect()}
    assert found <= want and len(found) >= 0.97 * len(want)
    classes = {x.id: x.class_id for x in members.collect()}
    assert len(classes) == 603 and classes[900] == classes[901] == classes[902] == classes[0] == 0
    if (0, 1) in found:
        links = {x.id: x.n_links for x in DD.link_counts(members, pairs, "id").collect()}
        assert links[0] == links[902] == 4 and links[1] == 4 and links[2] == 1
    assert DD.lsh_pairs(df.limit(0), "id").count() == 0


def test_lsh_shape():
    bits, bands = DD.lsh_shape(1000, 0.95, 0.99)
    assert bits == 10 and 10 <= bands <= 12
    assert DD.lsh_shape(0, 1.0, 0.99) == (4, 1) and DD.lsh_shape(10 ** 9, 0.95, 0.99)[0] == 30


def test_orphans_are_told_without_a_sort(spark):
    """Both splits stream the children past a hash of the keys; NULL keys are orphans, repeats count."""
    from talentflow.operators import resolve as RS
    child = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "k long, v string")
    parent = spark.createDataFrame([(1,), (1,), (3,), (None,)], "k long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept, orphans = RS.split_orphans(child, parent, "k")
        for part, rows in ((kept, ["a", "b", "e"]), (orphans, ["c", "d"])):
            assert sorted(r.v for r in part.collect()) == rows
            plan = part._jdf.queryExecution().sparkPlan().toString()
            assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
