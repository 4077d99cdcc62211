import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline as C  # noqa: E402
from helpers import contamination, near_duplicates  # noqa: E402
from talentflow.llm.store import materialise  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_on_its_own_input(spark, table):
    assert [n for n, _ in C.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination",
                                        "SentencePiece encoding and decoding"]
    steps = [table("documents")]
    for name, stage in C.STAGES:
        steps.append(materialise(stage(spark, steps[-1], SF), "stage"))
    for s in steps[:-1]:
        assert s.columns == COLUMNS
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    lang, lines, near, clean, last = rows[1:]
    assert len(lang) >= 0.98 * len(rows[0]) and all(lang[i] == rows[0][i] for i in lang)
    assert set(lines) == set(lang) and all(len(lines[i].text) <= len(lang[i].text) for i in lines)
    assert all(r.n_chars == len(r.text) for r in lines.values())
    want = near_duplicates([(i, r.text) for i, r in lines.items()])
    assert set(near) == {i for i, (_, root) in want.items() if root == i}
    bench = [(r.item_id, r.text) for r in table("benchmark").collect()]
    judged = contamination([(i, r.text) for i, r in near.items()], bench)
    assert set(clean) == {i for i, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)}
    assert {i: r.text for i, r in last.items()} == {i: r.text for i, r in clean.items()}
    assert all(len(r.ids) > 0 for r in last.values() if r.text)


def test_odd_rows(spark, table):
    odd = spark.createDataFrame([(None, "words with no id at all", "en", None, None), (10 ** 7, None, None, None, 3), (10 ** 7 + 1, "", "en", "s", 0),
                                 (10 ** 7 + 2, "123", "en", "s", 3)], table("documents").schema)
    docs = table("documents").limit(60).union(odd)
    for name, stage in C.STAGES:
        docs = materialise(stage(spark, docs, SF), "stage")
    ids = {r.doc_id for r in docs.collect()}
    assert 10 ** 7 not in ids and 10 ** 7 + 2 not in ids and None in ids


def test_language_with_a_low_score_stays(spark, table, monkeypatch):
    def predict(docs, model, keep, lang_out, score_out):
        return docs.select(*keep, F.when(F.col("doc_id") % 2 == 0, "und").otherwise("en").alias(lang_out), F.lit(0.3).alias(score_out))
    monkeypatch.setattr(C.langid_cnn, "fit", lambda docs: None)
    monkeypatch.setattr(C.langid_cnn, "predict", predict)
    docs = table("documents")
    assert {r.doc_id for r in C.language_id(spark, docs, SF).collect()} == {r.doc_id for r in docs.collect() if r.doc_id % 2}


def test_run_equals_its_stages(spark):
    assert C.ORACLE_SQL is None
    out = C.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "text"] and out.count() > 150
