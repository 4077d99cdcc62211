import tempfile

from talentflow.streaming.clean_stream import clean_text_stream, run_to_parquet


def test_stream_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="tf-stream-src-")
    out = tempfile.mkdtemp(prefix="tf-stream-out-")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(4).write.mode("overwrite").parquet(src)     # a folder the stream can watch
    s = clean_text_stream(spark, src, "doc_id long, text string, lang string, source string, n_chars long",
                          "doc_id", "text", max_files_per_trigger=2)
    run_to_parquet(s, out, "docs_test_" + out.rsplit("-", 1)[-1])
    got = spark.read.parquet(out)
    assert got.count() == docs.count()
