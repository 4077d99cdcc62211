"""Suitability classification on Spark MLlib.

Exact, distributed group ranking
--------------------------------
The leak-free split (M2) and the stratified group folds (M13) need the exact
rank of every group in a hash order. An unpartitioned window would sort all
groups in one task, so the rank is assembled from two bounded pieces: the
hash is cut into 2^k ordered buckets; a per-(stratum, bucket) count table
(at most strata x 2^k rows) gives each bucket's offset, and a window
partitioned by (stratum, bucket) ranks the groups inside one bucket.
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentflow.operators import linear as LN
from talentflow.operators import net as NET
from talentflow.operators import svd as SVD
from talentflow.operators.tfidf import JoinedText
from talentflow.plans import presets as P


def group_hash(col: str, seed: int = P.SEED) -> Column:
    """Default hash order of groups."""
    return F.xxhash64(F.col(col), F.lit(seed))


def rank_in_hash_order(df: DataFrame, id_col: str, h: Column, part: list[str] | None = None,
                       shift: int = 52) -> DataFrame:
    """Exact 1-based rank of each row by (h, id) inside ``part`` (see module doc)."""
    part = part or []
    x = df.withColumn("__h", h).withColumn("__b", F.shiftright(F.col("__h"), shift))
    counts = x.groupBy(*part, "__b").agg(F.count(F.lit(1)).alias("__c"))
    wcum = Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    wtot = Window.partitionBy(*part)
    counts = (counts.withColumn("__off", F.coalesce(F.sum("__c").over(wcum), F.lit(0)))
                    .withColumn("__n", F.sum("__c").over(wtot)).drop("__c"))
    w = Window.partitionBy(*part, "__b").orderBy("__h", id_col)
    x = x.withColumn("__r", F.row_number().over(w))
    return (x.join(counts, [*part, "__b"])
             .withColumn("hash_rank", F.col("__off") + F.col("__r"))
             .withColumnRenamed("__n", "n_in_part")
             .drop("__h", "__b", "__off", "__r"))


def group_split(df: DataFrame, group: str, test_share: float = P.TEST_SHARE,
                h: Column | None = None, shift: int = 52) -> DataFrame:
    """M2: ``df`` + ``is_test``; exactly ceil(share x n_groups) groups are test."""
    groups = df.select(group).distinct()
    r = rank_in_hash_order(groups, group, h if h is not None else group_hash(group), shift=shift)
    flag = r.select(group, (F.col("hash_rank") <= F.ceil(F.col("n_in_part") * test_share)).alias("is_test"))
    return df.join(flag, group)


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int = 4,
                           h: Column | None = None, shift: int = 52) -> DataFrame:
    """``df`` + ``fold``; each group goes to one fold, groups are dealt
    round-robin in hash order inside their dominant label."""
    lab = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("__n"))
    dom = Window.partitionBy(group).orderBy(F.desc("__n"), F.asc(label))
    g = (lab.withColumn("__r", F.row_number().over(dom)).filter(F.col("__r") == 1)
            .select(group, F.col(label).alias("__dom")))
    r = rank_in_hash_order(g, group, h if h is not None else group_hash(group), ["__dom"], shift)
    folds = r.select(group, F.pmod(F.col("hash_rank") - 1, F.lit(k)).cast("int").alias("fold"))
    return df.join(folds, group)


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """M6: balanced weight n / (k * count_c) per row (class table is tiny)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    allw = Window.partitionBy()
    c = c.select(label, (F.sum("__c").over(allw) / (F.count(F.lit(1)).over(allw) * F.col("__c"))).alias(out))
    return df.join(F.broadcast(c), label)   # one row per class


def macro_metrics(pred: DataFrame, y: str = "label", yhat: str = "prediction", digits: int = 4) -> DataFrame:
    """Accuracy and macro precision / recall / F1 (zero_division = 0) over
    the labels present in either column, from one confusion aggregation."""
    cm = pred.groupBy(y, yhat).agg(F.count(F.lit(1)).alias("n"))
    tp = cm.filter(F.col(y) == F.col(yhat)).select(F.col(y).alias("c"), F.col("n").alias("tp"))
    pp = cm.groupBy(F.col(yhat).alias("c")).agg(F.sum("n").alias("pp"))
    ap = cm.groupBy(F.col(y).alias("c")).agg(F.sum("n").alias("ap"))
    per = (ap.join(pp, "c", "full").join(tp, "c", "left").fillna(0, ["tp", "pp", "ap"]))
    prec = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0)
    rec = F.when(F.col("ap") > 0, F.col("tp") / F.col("ap")).otherwise(0.0)
    per = per.withColumn("p", prec).withColumn("r", rec)
    per = per.withColumn("f", F.when(F.col("p") + F.col("r") > 0,
                                     2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    return per.agg(F.round(F.sum("tp") / F.sum("ap"), digits).alias("accuracy"),
                   F.round(F.avg("p"), digits).alias("precision_macro"),
                   F.round(F.avg("r"), digits).alias("recall_macro"),
                   F.round(F.avg("f"), digits).alias("f1_macro"))


def confusion(pred: DataFrame, y: str = "label", yhat: str = "prediction",
              labels: list[str] = P.LABELS) -> DataFrame:
    """Confusion matrix in a fixed label order."""
    return pred.groupBy(y).pivot(yhat, labels).count().fillna(0)


def per_class_report(pred: DataFrame, y: str = "label", yhat: str = "prediction",
                     digits: int = 4) -> DataFrame:
    """Precision / recall / F1 / support per class."""
    cm = pred.groupBy(y, yhat).agg(F.count(F.lit(1)).alias("n"))
    tp = cm.filter(F.col(y) == F.col(yhat)).select(F.col(y).alias("class"), F.col("n").alias("tp"))
    pp = cm.groupBy(F.col(yhat).alias("class")).agg(F.sum("n").alias("pp"))
    ap = cm.groupBy(F.col(y).alias("class")).agg(F.sum("n").alias("support"))
    r = ap.join(pp, "class", "full").join(tp, "class", "left").fillna(0, ["tp", "pp", "support"])
    p = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0)
    rc = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return (r.withColumn("precision", F.round(p, digits)).withColumn("recall", F.round(rc, digits))
             .withColumn("f1", F.round(F.when(p + rc > 0, 2 * p * rc / (p + rc)).otherwise(0.0), digits))
             .select("class", "precision", "recall", "f1", "support"))


def scale(df: DataFrame, cols: list[str], out_prefix: str = "z_") -> DataFrame:
    """M4: standardise columns (mean 0, sample std 1) with MLlib's scaler."""
    va = VectorAssembler(inputCols=cols, outputCol="__v", handleInvalid="keep")
    sc = StandardScaler(inputCol="__v", outputCol="__z", withMean=True, withStd=True)
    model = Pipeline(stages=[va, sc]).fit(df)
    z = model.transform(df).withColumn("__za", vector_to_array("__z"))
    return z.select(*df.columns, *[F.col("__za")[i].alias(out_prefix + c) for i, c in enumerate(cols)])


def feature_pipeline(num_cols: list[str], extra_vec: list[str] | None = None) -> list:
    """M4 + M5: scaled numerics (+ optional vector columns) -> ``features``."""
    va = VectorAssembler(inputCols=num_cols, outputCol="__num", handleInvalid="keep")
    sc = StandardScaler(inputCol="__num", outputCol="__numz", withMean=True, withStd=True)
    fa = VectorAssembler(inputCols=["__numz", *(extra_vec or [])], outputCol="features")
    return [va, sc, fa]


def label_index_col(label: str = "suitability", labels: list[str] = P.LABELS) -> Column:
    """Label -> 0..k-1 in the fixed order (no fitted state needed)."""
    m = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(float(i)))])
    return F.element_at(m, F.col(label))


def classifiers(seed: int = P.SEED) -> dict:
    """M7-M10 estimators of MLlib, weighted; the net is ``fit_mlp``, the softmax boosted trees
    are ``operators.boosting``."""
    return {
        "logistic_regression": LogisticRegression(featuresCol="features", labelCol="label_idx",
                                                  weightCol="weight", family="multinomial",
                                                  regParam=0.01, standardization=False, maxIter=100),
        "linear_svm": OneVsRest(classifier=LinearSVC(featuresCol="features", labelCol="label_idx",
                                                     weightCol="weight", regParam=0.01, maxIter=50),
                                featuresCol="features", labelCol="label_idx", weightCol="weight",
                                parallelism=3),
        "random_forest": RandomForestClassifier(featuresCol="features", labelCol="label_idx",
                                                weightCol="weight", numTrees=400, maxDepth=10,
                                                minInstancesPerNode=5, featureSubsetStrategy="sqrt",
                                                seed=seed),
        "gbt": OneVsRest(classifier=GBTClassifier(featuresCol="features", labelCol="label_idx",
                                                  weightCol="weight", maxIter=350, maxDepth=4,
                                                  stepSize=0.07, subsamplingRate=0.8, seed=seed),
                         featuresCol="features", labelCol="label_idx", weightCol="weight",
                         parallelism=3),
    }


def grid(name: str, n_rows: int) -> dict[str, dict]:
    """M7-M9: the tuning grid of one estimator, ``{label: parameters}``. With balanced weights
    (which sum to the number of rows) a cost C is the penalty 1 / (C * rows)."""
    if name in P.TUNING_COSTS:
        return {f"C={c:g}": {"regParam": 1.0 / (c * max(n_rows, 1))} for c in P.TUNING_COSTS[name]}
    return {f"depth={d},leaf={m}": {"maxDepth": d, "minInstancesPerNode": m}
            for d in P.TUNING_DEPTHS for m in P.TUNING_LEAVES}


def cross_validate(folded: DataFrame, points: dict, label: str = "suitability", fold: str = "fold", k: int = 4,
                   parallel: int = 4) -> list[dict]:
    """Every estimator of ``points`` (``{name: estimator}``) on every fold of a feature
    table, as ``{point, fold, n_train, n_valid, f1_macro, train_f1}`` (see ``validate``)."""
    scores = validate(folded, points, [(F.col(fold) != f, F.col(fold) == f) for f in range(k)], label, parallel)
    return [{"fold" if c == "part" else c: v for c, v in s.items()} for s in scores]


def validate(df: DataFrame, points: dict, parts: list[tuple[Column, Column]], label: str = "suitability",
             parallel: int = 4) -> list[dict]:
    """Every estimator of ``points`` on every part ``(training rows, validation rows)`` of a
    feature table, as ``{point, part, n_train, n_valid, f1_macro, train_f1}``. Class weights are
    those of the part's training rows. Linear models share their passes over the rows, which
    are evaluated once; fits of others run side by side, and read the table each."""
    if all(LN.supported(e) for e in points.values()):
        scores = LN.validate(df, points, parts)
        if scores is not None:
            return scores

    def one(task):
        name, i = task
        train = class_weights(df.filter(parts[i][0]).drop("weight"), label)
        valid = df.filter(parts[i][1])
        model = points[name].fit(train)
        n, m = train.count(), valid.count()
        scores = [macro_metrics(model.transform(x), "label_idx", "prediction").first().f1_macro for x in (valid, train)]
        return {"point": name, "part": i, "n_train": n, "n_valid": m, "f1_macro": scores[0], "train_f1": scores[1]}

    tasks = [(name, i) for i in range(len(parts)) for name in points]
    spark = df.sparkSession
    with ThreadPool(min(parallel, len(tasks))) as pool:
        return pool.map(inheritable_thread_target(spark)(one), tasks)


def best_point(scores: list[dict]) -> str:
    """The grid point with the best mean macro-F1 over the folds (ties by name)."""
    mean: dict[str, list[float]] = {}
    for s in scores:
        mean.setdefault(s["point"], []).append(s["f1_macro"])
    return min(mean, key=lambda p: (-sum(mean[p]) / len(mean[p]), p))


def log_loss(pred: DataFrame, label: str = "label_idx", weight: str = "weight", prob: str = "probability") -> float:
    """Weighted mean cross-entropy of a prediction table."""
    p = F.element_at(vector_to_array(prob), F.col(label).cast("int") + 1)
    r = pred.agg(F.sum(-F.col(weight) * F.log(F.greatest(p, F.lit(1e-15)))).alias("l"), F.sum(weight).alias("w")).first()
    return r.l / r.w if r.w else 0.0


def fit_mlp(train: DataFrame, valid: DataFrame, hidden: tuple = (128, 64), n_classes: int = 3, step: int = 10,
            max_iter: int = 100, patience: int = 3, min_delta: float = 1e-4, seed: int = P.SEED):
    """The feature net with early stopping; ``(model, history)``.

    Training goes on from the last weights, ``step`` iterations a round, until the held-out
    loss has not fallen by ``min_delta`` for ``patience`` rounds; the best round's model is
    returned. A row counts as often as its weight holds the least one. The steps are those of MLlib's
    estimator, taken by ``net``; what is returned is MLlib's model."""
    least = train.agg(F.min("weight").alias("w")).first().w or 1.0
    n = train.select("features").head()
    size = len(n.features) if n else 1
    copies = F.greatest(F.round(F.col("weight") / least), F.lit(1)).cast("int")
    layers = [size, *hidden, n_classes]
    one = train.sparkSession.createDataFrame([(Vectors.dense([0.0] * size), 0.0)], ["features", "label_idx"])

    def model(weights=None):
        """MLlib's model of these weights, or of its own first ones: no iteration changes them."""
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label_idx", layers=layers, seed=seed,
                                              maxIter=0, initialWeights=weights).fit(one)

    cols = ["features", "label_idx", "weight"]
    both = train.select(*cols, F.lit(0).alias("part")).unionByName(valid.select(*cols, F.lit(1).alias("part")))
    rows, weights, best, history = NET.pack_rows(train, copies), model().weights.toArray(), None, []
    for i in range(max(max_iter // step, 1)):
        weights = NET.descend(rows, layers, weights, step)
        losses = NET.log_losses(both, F.col("part"), layers, weights)
        history.append({"round": i + 1, "iterations": (i + 1) * step, "train_loss": losses.get(0, 0.0), "valid_loss": losses.get(1, 0.0)})
        if best is None or history[-1]["valid_loss"] < history[best[0]]["valid_loss"] - min_delta:
            best = (i, weights)
        elif i - best[0] >= patience:
            break
    for i, h in enumerate(history):
        h["best"] = i == best[0]
    return model(Vectors.dense(best[1])), history


def index_to_label(col: str, labels: list[str] = P.LABELS) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.col(col).cast("int") + 1)


def fit_features(train: DataFrame, num_cols: list[str], text_col: str | JoinedText, unicode: bool = True) -> tuple[PipelineModel, SVD.TextSvd]:
    """M3-M5 fit on the training part alone: scaler of the numerics and SVD of the text."""
    svd = SVD.fit(train, text_col, unicode=unicode)
    # fitting runs the stages up to the scaler; the text's components join after it
    return Pipeline(stages=feature_pipeline(num_cols, ["svd_vec"])).fit(train), svd


def add_features(df: DataFrame, model: PipelineModel, svd: SVD.TextSvd, text_col: str | JoinedText) -> DataFrame:
    """M5: ``df`` with ``features``: the scaled numerics, then the text's components."""
    # the vector's size as metadata: the assembler would look for it in a first row, a job over all texts
    size = {"ml_attr": {"num_attrs": svd.k}}
    rows = SVD.transform(svd, df, text_col, "__svd").withColumn("svd_vec", array_to_vector("__svd").alias("svd_vec", metadata=size))
    return model.transform(rows).drop("__svd", "svd_vec", "__num", "__numz")


def predict(model, df: DataFrame) -> DataFrame:
    """Predictions of a fitted classifier, with the label's name as ``predicted``."""
    return model.transform(df).withColumn("predicted", index_to_label("prediction"))


def with_params(est, params: dict):
    """A copy of an estimator with parameters set (of the inner one for one-vs-rest)."""
    inner = est.getClassifier() if isinstance(est, OneVsRest) else est
    inner = inner.copy({inner.getParam(k): v for k, v in params.items()})
    return est.copy({est.classifier: inner}) if isinstance(est, OneVsRest) else inner


def generalisation_gap(train_pred: DataFrame, test_pred: DataFrame, y: str = "suitability") -> DataFrame:
    """Metrics on both splits and their F1 gap."""
    a = macro_metrics(train_pred, y, "predicted").select(F.col("f1_macro").alias("train_f1"),
                                                         F.col("accuracy").alias("train_accuracy"))
    b = macro_metrics(test_pred, y, "predicted").select(F.col("f1_macro").alias("test_f1"),
                                                        F.col("accuracy").alias("test_accuracy"))
    return a.unionByName(b, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ["train_f1", "train_accuracy", "test_f1", "test_accuracy"]]) \
        .withColumn("gap_f1", F.round(F.col("train_f1") - F.col("test_f1"), 4))


def feature_importances(model: PipelineModel, names: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) of a fitted tree model, most important first."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(names, imp[:len(names)]), key=lambda t: (-t[1], t[0]))


def embedding_features(df: DataFrame, emb: DataFrame, left_key: str, right_key: str,
                       emb_id: str, emb_col: str) -> DataFrame:
    """Concatenated left + right embeddings as one vector column."""
    le = emb.select(F.col(emb_id).alias(left_key), F.col(emb_col).alias("__el"))
    re_ = emb.select(F.col(emb_id).alias(right_key), F.col(emb_col).alias("__er"))
    j = df.join(le, left_key).join(re_, right_key)
    return j.withColumn("emb_vec", array_to_vector(F.concat(
        F.transform("__el", lambda x: x.cast("double")),
        F.transform("__er", lambda x: x.cast("double"))))).drop("__el", "__er")


def match_probability_score(prob: str = "probability", weights=P.UPLOAD_SCORE_WEIGHTS) -> Column:
    """100 * sum(p_i * w_i), rounded to 1."""
    arr = vector_to_array(F.col(prob))
    terms = [arr[i] * w for i, w in enumerate(weights)]
    return F.round(reduce(lambda a, b: a + b, terms) * 100.0, 1)
