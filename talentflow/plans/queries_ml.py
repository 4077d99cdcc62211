"""Classifier bindings.

SQL-checked: split / folds / weights / metrics / scaling on ``labels ⋈
documents`` (the hash replaced by an integer formula DuckDB can evaluate).
Rows-only: model training and scoring on the feature table built from the
hybrid matches of ``documents`` against ``benchmark`` (M1), exactly the
pipeline shape of the source (pairs + resume features + job features).
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentflow.functions import extract as X
from talentflow.functions import text as TX
from talentflow.operators import boosting as BO
from talentflow.operators import linear as LN
from talentflow.operators import ml as ML
from talentflow.operators import profile as PR
from talentflow.operators import svd as SVD
from talentflow.operators import tfidf as TF
from talentflow.plans import presets as P
from talentflow.plans.catalog import query
from talentflow.session import checkpoint_dir, cut_lineage, release
from talentflow.sources import io

LABEL_SQL = """CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'Highly Suitable'
                    WHEN l.quality = 1 THEN 'Suitable' ELSE 'Not Suitable' END"""
PRED_SQL = """CASE WHEN d.n_chars > 5000 THEN 'Highly Suitable'
                   WHEN d.n_chars > 1000 THEN 'Suitable' ELSE 'Not Suitable' END"""
LD_SQL = f"""ld AS (SELECT l.doc_id, d.source, d.n_chars, {LABEL_SQL} AS suitability, {PRED_SQL} AS predicted
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _ld(spark, d):
    lab = io.read_table(spark, d, "labels")
    docs = io.read_table(spark, d, "documents").select("doc_id", "source", "n_chars")
    y = (F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("Highly Suitable"))
          .when(F.col("quality") == 1, F.lit("Suitable")).otherwise(F.lit("Not Suitable")))
    yhat = (F.when(F.col("n_chars") > 5000, F.lit("Highly Suitable"))
             .when(F.col("n_chars") > 1000, F.lit("Suitable")).otherwise(F.lit("Not Suitable")))
    return lab.join(docs, "doc_id").select("doc_id", "source", "n_chars", y.alias("suitability"),
                                           yhat.alias("predicted"))


def int_hash(c):
    """Integer stand-in for the group hash that DuckDB can evaluate too."""
    return F.pmod(c * 7919 + 13, F.lit(1000003))


@query("group_split", f"""WITH {LD_SQL},
g AS (SELECT doc_id, (doc_id * 7919 + 13) % 1000003 AS h FROM (SELECT DISTINCT doc_id FROM ld) x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS rk, count(*) OVER () AS n FROM g)
SELECT ld.doc_id, ld.suitability, r.rk <= ceil(r.n * 0.2) AS is_test FROM ld JOIN r ON ld.doc_id = r.doc_id""")
def group_split(spark, d):
    ld = _ld(spark, d)
    out = ML.group_split(ld, "doc_id", P.TEST_SHARE, h=int_hash(F.col("doc_id")), shift=8)
    return out.select("doc_id", "suitability", "is_test")


@query("stratified_folds", f"""WITH {LD_SQL},
lab AS (SELECT source, suitability, count(*) AS n FROM ld GROUP BY 1, 2),
dom AS (SELECT source, suitability AS dom FROM (SELECT *, row_number() OVER (PARTITION BY source
          ORDER BY n DESC, suitability) AS r FROM lab) x WHERE r = 1),
rk AS (SELECT source, dom, row_number() OVER (PARTITION BY dom ORDER BY
          (CAST(substr(source, 4) AS BIGINT) * 7919 + 13) % 1000003, source) AS k FROM dom)
SELECT ld.doc_id, ld.source, CAST((rk.k - 1) % 4 AS INTEGER) AS fold FROM ld JOIN rk ON ld.source = rk.source""")
def stratified_folds(spark, d):
    ld = _ld(spark, d)
    h = int_hash(F.substring("source", 4, 100).cast("long"))
    out = ML.stratified_group_folds(ld, "source", "suitability", 4, h=h, shift=8)
    return out.select("doc_id", "source", "fold")


@query("class_weights", f"""WITH {LD_SQL},
c AS (SELECT suitability, count(*) AS c FROM ld GROUP BY 1)
SELECT ld.doc_id, ld.suitability,
  round((SELECT sum(c) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * c.c), 6) AS weight
FROM ld JOIN c ON ld.suitability = c.suitability""")
def class_weights(spark, d):
    w = ML.class_weights(_ld(spark, d), "suitability")
    return w.select("doc_id", "suitability", F.round("weight", 6).alias("weight"))


METRICS_SQL = f"""WITH {LD_SQL},
cm AS (SELECT suitability AS y, predicted AS p, count(*) AS n FROM ld GROUP BY 1, 2),
cls AS (SELECT y AS c FROM cm UNION SELECT p FROM cm),
per AS (SELECT c,
  coalesce((SELECT sum(n) FROM cm WHERE y = c AND p = c), 0) AS tp,
  coalesce((SELECT sum(n) FROM cm WHERE p = c), 0) AS pp,
  coalesce((SELECT sum(n) FROM cm WHERE y = c), 0) AS ap FROM cls),
per2 AS (SELECT c, tp, pp, ap,
  CASE WHEN pp > 0 THEN tp::DOUBLE / pp ELSE 0.0 END AS pr,
  CASE WHEN ap > 0 THEN tp::DOUBLE / ap ELSE 0.0 END AS rc FROM per),
per3 AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM per2)"""


@query("macro_metrics", METRICS_SQL + """
SELECT round(sum(tp)::DOUBLE / sum(ap), 4) AS accuracy, round(avg(pr), 4) AS precision_macro,
  round(avg(rc), 4) AS recall_macro, round(avg(f1), 4) AS f1_macro FROM per3""")
def macro_metrics(spark, d):
    return ML.macro_metrics(_ld(spark, d), "suitability", "predicted")


@query("class_report", METRICS_SQL + """
SELECT c AS class, round(pr, 4) AS precision, round(rc, 4) AS recall, round(f1, 4) AS f1, ap AS support
FROM per3""")
def class_report(spark, d):
    return ML.per_class_report(_ld(spark, d), "suitability", "predicted")


@query("confusion", f"""WITH {LD_SQL}
SELECT suitability, count(*) FILTER (WHERE predicted = 'Not Suitable') AS "Not Suitable",
  count(*) FILTER (WHERE predicted = 'Suitable') AS "Suitable",
  count(*) FILTER (WHERE predicted = 'Highly Suitable') AS "Highly Suitable"
FROM ld GROUP BY suitability""")
def confusion(spark, d):
    return ML.confusion(_ld(spark, d), "suitability", "predicted")


@query("label_distribution", f"""WITH {LD_SQL}
SELECT suitability, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1)::DOUBLE AS pct
FROM ld GROUP BY suitability""")
def label_distribution(spark, d):
    """Label counts and shares (feature missingness is ``null_profile``)."""
    from pyspark.sql import Window
    c = _ld(spark, d).groupBy("suitability").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))


@query("scale_features", """SELECT doc_id,
  round((n_chars - avg(n_chars) OVER ()) / stddev_samp(n_chars) OVER (), 6) AS z_n_chars,
  round((wc - avg(wc) OVER ()) / stddev_samp(wc) OVER (), 6) AS z_words
FROM (SELECT doc_id, n_chars, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS wc FROM documents) x""")
def scale_features(spark, d):
    docs = io.read_table(spark, d, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        TX.word_count("text", unicode=False).cast("double").alias("words"))
    z = ML.scale(docs, ["n_chars", "words"])
    return z.select("doc_id", F.round("z_n_chars", 6).alias("z_n_chars"), F.round("z_words", 6).alias("z_words"))


# ------------------------------------------------------------- model training (rows only)

def feature_table(spark, d):
    """M1: hybrid-match pairs + resume-side and job-side features (no leak columns), and the
    combined text of a pair, whose two parts lie in the shared folder once for all pairs."""
    from talentflow.plans.queries_match import WORD_PATTERNS, _hybrid
    pairs = _hybrid(spark, d).select("doc_id", "item_id", "matching_skills", "missing_skills", "suitability")
    docs = io.read_table(spark, d, "documents").select("doc_id", F.col("text").alias("resume_text"))
    res = docs.select(
        "doc_id",
        F.size(X.dict_extract("resume_text", WORD_PATTERNS, unicode=False)).alias("skill_count"),
        X.max_number("resume_text", r"(\d{1,2})").alias("years_experience"),
        X.level_cascade("resume_text").alias("education_level"),
        TX.word_count("resume_text").alias("resume_word_count"), "resume_text")
    res = (res.withColumn("__edu", F.when(F.col("education_level") > 0, F.lit(1)))
              .withColumn("resume_completeness_score", PR.resume_completeness(
                  "skill_count", "__edu", "resume_word_count", "years_experience")).drop("__edu"))
    bench = io.read_table(spark, d, "benchmark").select("item_id", F.col("text").alias("job_text"))
    res = cut_lineage(res.withColumn("resume_row", F.monotonically_increasing_id()))
    job = bench.select("item_id",
                       F.size(X.dict_extract("job_text", WORD_PATTERNS, unicode=False)).alias("required_skill_count"),
                       TX.word_count("job_text").alias("description_word_count"), "job_text")
    job = cut_lineage(job.withColumn("job_row", F.monotonically_increasing_id()))
    text = TF.JoinedText(res.select("resume_row", "resume_text"), "resume_row", "resume_text",
                         job.select("job_row", "job_text"), "job_row", "job_text")
    df = pairs.join(res.drop("resume_text"), "doc_id", "left").join(job.drop("job_text"), "item_id", "left")
    df = (df.withColumn("n_matching_skills", X.safe_size("matching_skills"))
            .withColumn("n_missing_skills", X.safe_size("missing_skills")))
    from talentflow.functions.coerce import median_impute, zero_fill
    df = cut_lineage(df)  # read several times by the median
    df = median_impute(df, "years_experience", known_flag="has_experience_info")
    df = zero_fill(df.withColumns({c: F.col(c).cast("double") for c in P.NUM_FEATURES}), P.NUM_FEATURES)
    return df.drop("matching_skills", "missing_skills"), text


def _split(spark, d):
    # iterative fits re-read their input many times: materialise the feature
    # table once in the shared checkpoint folder (survives executor loss)
    ft, text = feature_table(spark, d)
    ft = cut_lineage(ft)
    sp = ML.group_split(ft, "doc_id").withColumn("label_idx", ML.label_index_col("suitability"))
    return ML.class_weights(sp.filter(~F.col("is_test")), "suitability"), sp.filter(F.col("is_test")), text


@dataclass
class Matrix:
    """The pairs of both splits with their text, the training pairs with their groups' folds and
    inner held-out part, what was fitted on the training split, and by these the feature matrix
    (numerics and text components) of both splits, written when it is first read."""
    dealt: DataFrame
    parts: tuple[DataFrame, DataFrame]
    text: TF.JoinedText
    scaler: PipelineModel
    svd: SVD.TextSvd

    def rows(self, pairs: DataFrame, *keep: str) -> DataFrame:
        return ML.add_features(pairs, self.scaler, self.svd, self.text).select(
            "doc_id", "item_id", "suitability", "label_idx", "features", *keep)

    @cached_property
    def train(self) -> DataFrame:
        return cut_lineage(self.rows(self.dealt, "weight", "fold", "inner"))

    @cached_property
    def test(self) -> DataFrame:
        return cut_lineage(self.rows(self.parts[1]))

    def once(self) -> DataFrame:
        """The training matrix for a reader that goes through it once: not written for it."""
        return self.train if "train" in self.__dict__ else self.rows(self.dealt, "weight", "fold", "inner")


_MATRICES: dict[tuple[str, str], Matrix] = {}


def matrix(spark, d) -> Matrix:
    """M3-M5: fitted once per application and input."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MATRICES:
        train, test, text = _split(spark, d)
        train = cut_lineage(train)
        release(spark)  # the matching
        scaler, svd = ML.fit_features(train, P.NUM_FEATURES, text, unicode=False)
        release(spark)  # the weights of the texts
        folds = ML.stratified_group_folds(train.select("doc_id", "suitability"), "doc_id", "suitability").select("doc_id", "fold").distinct()
        inner = (ML.group_split(train.select("doc_id").distinct(), "doc_id", P.INNER_SHARE, h=ML.group_hash("doc_id", P.SEED + 1))
                 .withColumnRenamed("is_test", "inner"))
        _MATRICES[key] = Matrix(train.join(folds, "doc_id").join(inner, "doc_id"), (train, test), text, scaler, svd)
    return _MATRICES[key]


def fit_named(name: str, m: Matrix, params: dict | None = None):
    """One model on the training split."""
    if name == "mlp":
        return ML.fit_mlp(m.train.filter(~F.col("inner")), m.train.filter("inner"))[0]
    if name == "boosted_trees":
        return BO.fit(m.train, m.svd.k + len(P.NUM_FEATURES), held_out="inner", rounds=BOOST_ROUNDS, rate=BOOST_RATE)
    est = ML.with_params(ML.classifiers()[name], params or {})
    if LN.supported(est):
        return LN.fit([est], m.once())[0]
    if name == "gbt":  # 350 trees a class: on the numerics alone
        numerics = VectorSlicer(inputCol="features", outputCol="numerics", indices=list(range(len(P.NUM_FEATURES))))
        return Pipeline(stages=[numerics, est.copy({est.featuresCol: "numerics"})]).fit(m.train)
    return est.fit(m.train)


#: fewer and larger steps than the library's defaults (350 of 0.07): early stopping decides
BOOST_ROUNDS, BOOST_RATE = 60, 0.3


def _train(name):
    def run(spark, d):
        m = matrix(spark, d)
        return ML.predict(fit_named(name, m), m.test).select("doc_id", "item_id", "suitability", "predicted")
    run.__doc__ = f"M7-M11: {name} on numerics and text components, grouped split; test predictions (rows only)."
    return run


for _name, _key in [("train_lr", "logistic_regression"), ("train_svm", "linear_svm"), ("train_rf", "random_forest"),
                    ("train_gbt", "boosted_trees"), ("train_gbt_ovr", "gbt"), ("train_mlp", "mlp")]:
    query(_name)(_train(_key))


def _tuned(name):
    def run(spark, d):
        m = matrix(spark, d)
        est = ML.classifiers()[name]
        points = {p: ML.with_params(est, v) for p, v in ML.grid(name, m.dealt.count()).items()}
        scores = ML.cross_validate(m.once() if LN.supported(est) else m.train, points)
        best = ML.best_point(scores)
        return spark.createDataFrame([(name, s["point"], s["fold"], s["n_train"], s["n_valid"], s["f1_macro"], s["train_f1"],
                                       s["point"] == best) for s in scores],
                                     "model string, point string, fold int, n_train long, n_valid long, f1_macro double, "
                                     "train_f1 double, best boolean")
    run.__doc__ = f"M13: {name}, every grid point on every grouped fold by macro-F1 (rows only)."
    return run


for _name, _key in [("tuned_lr", "logistic_regression"), ("tuned_svm", "linear_svm"), ("tuned_rf", "random_forest")]:
    query(_name)(_tuned(_key))


@query("mlp_history")
def mlp_history(spark, d):
    """Losses of each training round of the feature net, and the round that was kept."""
    m = matrix(spark, d)
    _, history = ML.fit_mlp(m.train.filter(~F.col("inner")), m.train.filter("inner"))
    return spark.createDataFrame([tuple(h[c] for c in ("round", "iterations", "train_loss", "valid_loss", "best")) for h in history],
                                 "round int, iterations int, train_loss double, valid_loss double, best boolean")


@query("train_embeddings")
def train_embeddings(spark, d):
    """Classifier on concatenated pre-computed embeddings of pair members.

    Pairs (vec_id, next vec_id) take the left vector's label (mod 3) as class.
    """
    table = io.read_table(spark, d, "embeddings")
    emb = io.embedding_cache(table, "vec_id", "embedding", os.path.join(checkpoint_dir(spark), "embedding-cache"))
    pairs = table.select(F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"),
                       F.element_at(F.array(*[F.lit(x) for x in P.LABELS]),
                                    F.pmod("label", F.lit(3)) + 1).alias("suitability"))
    feats = ML.embedding_features(pairs, emb, "left_id", "right_id", "vec_id", "embedding")
    feats = ML.class_weights(feats, "suitability").withColumn("label_idx", ML.label_index_col("suitability"))
    sp = ML.group_split(feats, "left_id")
    tr, te = sp.filter(~F.col("is_test")), sp.filter(F.col("is_test"))
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    lr = LogisticRegression(featuresCol="emb_vec", labelCol="label_idx", weightCol="weight",
                            family="multinomial", regParam=0.01, maxIter=100)
    model = Pipeline(stages=[lr]).fit(tr)
    return model.transform(te).select("left_id", "suitability",
                                      ML.index_to_label("prediction").alias("predicted"))


@query("model_comparison")
def model_comparison(spark, d):
    """M16 + M19: train and test metrics of all five models, best macro-F1 first."""
    m = matrix(spark, d)
    rows, _ = None, m.train  # written before the first fit: all models read it
    for key in ["logistic_regression", "linear_svm", "random_forest", "boosted_trees", "mlp"]:
        model = fit_named(key, m)
        scores = ML.macro_metrics(ML.predict(model, m.test), "suitability", "predicted")
        fitted = ML.macro_metrics(ML.predict(model, m.train), "suitability", "predicted").first().f1_macro
        r = scores.withColumns({"model": F.lit(key), "train_f1": F.lit(fitted)})
        rows = r if rows is None else rows.unionByName(r)
    return rows.withColumn("gap_f1", F.round(F.col("train_f1") - F.col("f1_macro"), 4)) \
               .orderBy(F.desc("f1_macro"), F.asc("model"))


@query("importances")
def importances(spark, d):
    """Random-forest importances of the numerics and the text components."""
    m = matrix(spark, d)
    names = P.NUM_FEATURES + [f"svd_{i}" for i in range(m.svd.k)]
    imp = fit_named("random_forest", m).featureImportances.toArray().tolist()
    return spark.createDataFrame(sorted(zip(names, imp), key=lambda t: (-t[1], t[0])), "feature string, importance double")


@query("learning_curve")
def learning_curve(spark, d):
    """Train and validation macro-F1 of logistic regression on every fold at 5 shares of
    its training groups."""
    m = matrix(spark, d)
    groups = m.dealt.select("doc_id", "fold").distinct()
    # the training groups of each fold, in one hash order
    ranked = [ML.rank_in_hash_order(groups.filter(F.col("fold") != f), "doc_id", ML.group_hash("doc_id", 7))
              .select("doc_id", F.lit(f).alias("of"), "hash_rank", "n_in_part") for f in range(4)]
    places = reduce(DataFrame.unionByName, ranked).groupBy("doc_id").agg(
        *[F.max(F.when(F.col("of") == f, F.col(c))).alias(f"{c}_{f}") for f in range(4) for c in ("hash_rank", "n_in_part")])
    extra = [c for c in places.columns if c != "doc_id"]
    rows = m.rows(m.dealt.join(places, "doc_id"), "fold", *extra)
    tasks = [(s, f) for s in (0.2, 0.4, 0.6, 0.8, 1.0) for f in range(4)]
    parts = [(F.col(f"hash_rank_{f}") <= F.ceil(F.col(f"n_in_part_{f}") * s), F.col("fold") == f) for s, f in tasks]
    scores = ML.validate(rows, {"lr": ML.classifiers()["logistic_regression"]}, parts)
    out = [(*task, s["n_train"], s["train_f1"], s["f1_macro"]) for task, s in zip(tasks, scores)]
    return spark.createDataFrame(out, "train_fraction double, fold int, n_train long, train_f1 double, f1_macro double")


@query("batch_score")
def batch_score(spark, d):
    """M20 + M21: persist scaler, text components and classifier in a folder of this run below
    the shared checkpoint folder, reload them, and score (resume text, job text) pairs with the upload rules
    (100-pattern skills, first 'N years', education cascade, completeness 0.8)."""
    m = matrix(spark, d)
    path = os.path.join(checkpoint_dir(spark), f"models-{uuid.uuid4().hex}")
    PipelineModel([fit_named("logistic_regression", m)]).write().save(f"{path}/classifier")
    m.scaler.write().save(f"{path}/scaler")
    m.svd.save(f"{path}/text")
    model, scaler = PipelineModel.load(f"{path}/classifier"), PipelineModel.load(f"{path}/scaler")
    svd = SVD.TextSvd.load(spark, f"{path}/text")
    from talentflow.plans.queries_match import _hybrid
    feats, text = upload_table(spark, d, _hybrid(spark, d).select("doc_id", "item_id"))
    scored = model.transform(ML.add_features(feats, scaler, svd, text))
    return scored.select("doc_id", "item_id", ML.index_to_label("prediction").alias("suitability"),
                         ML.match_probability_score().alias("match_score"),
                         "matching_skills", "missing_skills")


def upload_table(spark, d, pairs):
    """The features of (resume text, job text) pairs by the upload rules, and their text. What a
    text says of itself is extracted once, not for each of its pairs."""
    docs = io.read_table(spark, d, "documents").select("doc_id", F.col("text").alias("resume_text"))
    bench = io.read_table(spark, d, "benchmark").select("item_id", F.col("text").alias("jd_text"))
    pats = P.all_upload_skill_patterns()
    years, known = X.first_number("resume_text")
    docs = cut_lineage(docs.select(
        "doc_id", "resume_text", X.dict_extract("resume_text", pats).alias("rs"), years.alias("years_experience"),
        known.cast("double").alias("has_experience_info"), X.level_cascade("resume_text").cast("double").alias("education_level"),
        TX.word_count("resume_text").cast("double").alias("resume_word_count"), F.monotonically_increasing_id().alias("resume_row")))
    bench = cut_lineage(bench.select(
        "item_id", "jd_text", X.dict_extract("jd_text", pats).alias("js"),
        TX.word_count("jd_text").cast("double").alias("description_word_count"), F.monotonically_increasing_id().alias("job_row")))
    text = TF.JoinedText(docs.select("resume_row", "resume_text"), "resume_row", "resume_text",
                         bench.select("job_row", "jd_text"), "job_row", "jd_text")
    x = pairs.join(docs.drop("resume_text"), "doc_id").join(bench.drop("jd_text"), "item_id")
    return x.select(
        "doc_id", "item_id", "resume_row", "job_row", X.set_intersect("rs", "js").alias("matching_skills"),
        X.set_minus("js", "rs").alias("missing_skills"),
        F.size(X.set_intersect("rs", "js")).cast("double").alias("n_matching_skills"),
        F.size(X.set_minus("js", "rs")).cast("double").alias("n_missing_skills"),
        F.size("rs").cast("double").alias("skill_count"), "years_experience", "has_experience_info", "education_level",
        "resume_word_count", F.lit(P.UPLOAD_COMPLETENESS).alias("resume_completeness_score"),
        F.size("js").cast("double").alias("required_skill_count"), "description_word_count"), text


@query("svd_features")
def svd_features(spark, d):
    """M3: TF-IDF (fit on train) -> truncated SVD components of the combined pair text."""
    m = matrix(spark, d)
    return reduce(DataFrame.unionByName, [SVD.transform(m.svd, x.select("doc_id", "item_id", m.text.left_key, m.text.right_key), m.text)
                                          .select("doc_id", "item_id", "svd") for x in m.parts])


@query("svd_energy")
def svd_energy(spark, d):
    """M3: singular values of the training text, and the share of the squared weights kept."""
    svd = matrix(spark, d).svd
    total = sum(x * x for x in svd.singular) or 1.0
    return spark.createDataFrame([(i, x, svd.energy * x * x / total) for i, x in enumerate(svd.singular)],
                                 "component int, singular_value double, energy double")
