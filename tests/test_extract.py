from talentflow.functions import extract as X
from talentflow.plans import presets as P


def _one(spark, value, col):
    return spark.createDataFrame([(value,)], "t string").select(col.alias("o")).first()["o"]


def test_java_vs_javascript(spark):
    assert "java" not in _one(spark, "JavaScript developer", X.dict_extract("t", P.SKILL_PATTERNS))
    got = _one(spark, "Java and javascript, SQL Server, c++", X.dict_extract("t", P.SKILL_PATTERNS))
    assert got == sorted(["c++", "java", "javascript", "sql", "sql_server"])


def test_null_text_gives_empty(spark):
    assert _one(spark, None, X.dict_extract("t", P.SKILL_PATTERNS)) == []


def test_years(spark):
    assert _one(spark, "3+ years of Python, 60 years old, 12 yrs", X.max_number("t")) == 3
    assert _one(spark, "no numbers", X.max_number("t")) is None
    assert _one(spark, "8 years here and 9 years there", X.max_number("t")) == 9


def test_education_order_and_highest(spark):
    lv = _one(spark, "PhD in CS, Bachelor's degree, high school", X.ordinal_levels("t"))
    assert lv == ["high_school", "bachelor", "doctorate"]
    df = spark.createDataFrame([(lv,), ([],)], "l array<string>")
    got = [r.h for r in df.select(X.highest_level("l").alias("h")).collect()]
    assert got == ["doctorate", None]


def test_set_ops(spark):
    df = spark.createDataFrame([("a|b||c", "b|c|d|d")], "r string, j string")
    r = df.select(X.pipe_to_set("r").alias("r"), X.pipe_to_set("j").alias("j")) \
          .select(X.set_intersect("r", "j").alias("m"), X.set_minus("j", "r").alias("x"),
                  X.overlap_ratio("r", "j").alias("o")).first()
    assert r.m == ["b", "c"] and r.x == ["d"] and r.o == round(2 / 3, 4)


def test_substring_extract_order(spark):
    got = _one(spark, "Spark, SQL and Python", X.substring_extract("t"))
    assert got == ["python", "sql", "spark"]
