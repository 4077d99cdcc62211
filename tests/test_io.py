import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentflow.operators import dedup as DD
from talentflow.operators import tfidf as TF
from talentflow.sources import io


def test_text_files_drop_invalid_bytes(spark):
    d = tempfile.mkdtemp(prefix="tf-txt-")
    with open(os.path.join(d, "a.txt"), "wb") as fh:
        fh.write(b"Python \xff\xfe developer\n")
    got = io.read_text_files(spark, d).first().text
    assert got == "Python  developer\n"


def test_csv_roundtrip_arrays_and_warehouse_load(spark):
    out = tempfile.mkdtemp(prefix="tf-csv-")
    df = spark.createDataFrame([(1, ["a", "b"], None, True), (2, None, "2024-01-01 00:00:00", False)],
                               "job_id long, skills array<string>, expiry_dt string, has_salary boolean")
    io.write_table(df, os.path.join(out, "jobs.csv"), fmt="csv")
    schema = T.StructType([T.StructField("job_id", T.LongType()),
                           T.StructField("skills", T.ArrayType(T.StringType())),
                           T.StructField("expiry_dt", T.TimestampType()),
                           T.StructField("has_salary", T.BooleanType())])
    back = io.load_warehouse(spark, out, {"jobs": schema})["jobs"]
    rows = {r.job_id: r for r in back.collect()}
    assert rows[1].skills == ["a", "b"] and rows[2].skills == []
    assert rows[1].expiry_dt is None and rows[2].expiry_dt is not None
    assert rows[1].has_salary is True and rows[2].has_salary is False


def test_row_counts(spark):
    a = spark.range(5)
    b = spark.range(3)
    got = {r.table: r.n_rows for r in io.row_counts({"a": a, "b": b}).collect()}
    assert got == {"a": 5, "b": 3}


def test_lsh_pairs_are_verified(spark):
    texts = ["spark shuffles joins partitions executors tasks stages",
             "spark shuffles joins partitions executors tasks stages again",
             "completely unrelated words about cooking pasta tomatoes"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    tf = TF.term_counts(df, "id", "t", unicode=False)
    w = TF.weigh(tf, TF.fit_vocabulary(tf, "id", 3, 1, 1.0, None), "id")
    pairs = {(r.a, r.b): r.similarity for r in DD.lsh_pairs(w, "id", threshold=0.5).collect()}
    assert set(pairs) == {(0, 1)} and 0.5 <= pairs[(0, 1)] < 1


def test_discover_csv_and_row_counts(spark, tmp_path):
    (tmp_path / "jobs").mkdir()
    (tmp_path / "postings.csv").write_text('job_id,title\n1,"two\nlines"\n2,x\n')
    (tmp_path / "jobs" / "skills.csv").write_text("job_id,skill\n1,a\n")
    (tmp_path / "notes.txt").write_text("no table")
    t = io.discover_csv(spark, str(tmp_path))
    assert list(t) == ["jobs/skills", "postings"]
    assert {r.table: r.n_rows for r in io.row_counts(t).collect()} == {"jobs/skills": 1, "postings": 2}


def test_write_report(spark, tmp_path):
    io.write_report(spark.createDataFrame([(1, 0.5)], "n int, f1 double"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().f1 == 0.5
