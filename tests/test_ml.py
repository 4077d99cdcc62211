import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from talentflow.operators import ml as ML
from talentflow.plans import presets as P


def test_group_split_exact_share_and_disjoint(spark):
    rows = [(g, i) for g in range(101) for i in range(3)]
    df = spark.createDataFrame(rows, "g long, i long")
    s = ML.group_split(df, "g", 0.2, shift=60)
    test_groups = {r.g for r in s.filter("is_test").select("g").distinct().collect()}
    train_groups = {r.g for r in s.filter("not is_test").select("g").distinct().collect()}
    assert len(test_groups) == 21 and not (test_groups & train_groups)
    assert len(test_groups | train_groups) == 101


def test_rank_in_hash_order_matches_sort(spark):
    df = spark.range(500).withColumnRenamed("id", "g")
    h = F.xxhash64("g", F.lit(3))
    r = ML.rank_in_hash_order(df, "g", h, shift=58).select("g", "hash_rank").collect()
    ref = df.select("g", h.alias("h")).collect()
    order = [x.g for x in sorted(ref, key=lambda x: (x.h, x.g))]
    assert {x.g: x.hash_rank for x in r} == {g: i + 1 for i, g in enumerate(order)}


def test_macro_metrics_by_hand(spark):
    y = ["a", "a", "b", "b", "c", "c"]
    p = ["a", "b", "b", "b", "a", "c"]
    df = spark.createDataFrame(list(zip(y, p)), "label string, prediction string")
    m = ML.macro_metrics(df).first()
    # per class precision: a 1/2, b 2/3, c 1; recall: a 1/2, b 1, c 1/2
    prec = (0.5 + 2 / 3 + 1) / 3
    rec = (0.5 + 1 + 0.5) / 3
    f1 = (0.5 + 0.8 + 2 / 3) / 3
    assert m.accuracy == round(4 / 6, 4)
    assert m.precision_macro == round(prec, 4) and m.recall_macro == round(rec, 4)
    assert m.f1_macro == round(f1, 4)


def test_folds_keep_groups_together(spark):
    rows = [(g, i, ["x", "y", "z"][g % 3]) for g in range(40) for i in range(2)]
    df = spark.createDataFrame(rows, "g long, i long, y string")
    f = ML.stratified_group_folds(df, "g", "y", 4)
    per_group = f.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count()
    assert per_group == 0
    assert f.select("fold").distinct().count() == 4


def _points(spark, n=240, seed=5):
    """Two informative features, three classes, groups of four rows."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.digitize(x[:, 0] + x[:, 1], [-0.7, 0.9])
    rows = [(i, i // 4, P.LABELS[c], float(c), Vectors.dense(v)) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["id", "g", "suitability", "label_idx", "features"])


def test_grid_penalties():
    assert ML.grid("logistic_regression", 50) == {"C=0.3": {"regParam": 1 / 15}, "C=1": {"regParam": 0.02}, "C=3": {"regParam": 1 / 150}}
    assert ML.grid("random_forest", 50)["depth=16,leaf=12"] == {"maxDepth": 16, "minInstancesPerNode": 12}


def test_cross_validation_keeps_groups_apart(spark):
    df = ML.stratified_group_folds(_points(spark), "g", "suitability", 4).cache()
    lr = ML.classifiers()["logistic_regression"]
    points = {p: ML.with_params(lr, v) for p, v in ML.grid("logistic_regression", 180).items()}
    points["none"] = ML.with_params(lr, {"regParam": 50.0})
    scores = ML.cross_validate(df, points)
    assert len(scores) == 16 and {s["fold"] for s in scores} == {0, 1, 2, 3}
    sizes = {r.fold: r["count"] for r in df.groupBy("fold").count().collect()}
    groups = {r.fold: {x for x in r.g} for r in df.groupBy("fold").agg(F.collect_set("g").alias("g")).collect()}
    assert not any(groups[a] & groups[b] for a in groups for b in groups if a < b)
    assert all(s["n_valid"] == sizes[s["fold"]] and s["n_train"] == 240 - s["n_valid"] for s in scores)
    best = ML.best_point(scores)
    mean = {p: np.mean([s["f1_macro"] for s in scores if s["point"] == p]) for p in points}
    assert mean[best] == max(mean.values()) > 0.8 > mean["none"]
    # one fold by hand
    one = next(s for s in scores if s["point"] == best and s["fold"] == 2)
    model = points[best].fit(ML.class_weights(df.filter("fold <> 2"), "suitability"))
    assert ML.macro_metrics(model.transform(df.filter("fold = 2")), "label_idx", "prediction").first().f1_macro == one["f1_macro"]


def test_net_stops_on_a_plateau(spark):
    df = ML.class_weights(_points(spark, 400), "suitability").cache()
    rng = np.random.default_rng(0)
    # held-out labels by chance: their loss soon rises, and an early round is kept
    noise = [(Vectors.dense(v), float(c), 1.0) for v, c in zip(rng.normal(size=(80, 3)), rng.integers(0, 3, 80))]
    valid = spark.createDataFrame(noise, ["features", "label_idx", "weight"])
    model, history = ML.fit_mlp(df.filter("g % 5 > 0"), valid, hidden=(8, 4), step=5, max_iter=200, patience=2)
    losses = [h["valid_loss"] for h in history]
    kept = next(i for i, h in enumerate(history) if h["best"])
    assert len(history) == kept + 3 < 40 and min(losses) > losses[kept] - 1e-4
    assert abs(ML.log_loss(model.transform(valid)) - losses[kept]) < 1e-9
    # a part that is told well: goes on for longer and learns
    model, history = ML.fit_mlp(df.filter("g % 5 > 0"), df.filter("g % 5 = 0"), hidden=(8, 4), step=10, max_iter=60)
    assert history[-1]["valid_loss"] < history[0]["valid_loss"]
    assert ML.macro_metrics(model.transform(df.filter("g % 5 = 0")), "label_idx", "prediction").first().f1_macro > 0.8


def test_features_of_unseen_pairs(spark):
    rows = [(i, float(i % 7), f"spark kafka {'java' if i % 2 else 'scala'} engineer {'cloud' if i % 3 else 'nurse'}") for i in range(40)]
    train = spark.createDataFrame(rows, "id long, x double, t string")
    scaler, svd = ML.fit_features(train, ["x"], "t", unicode=False)
    new = spark.createDataFrame([(1, 3.0, "scala nurse"), (2, 3.0, None)], "id long, x double, t string")
    out = {r.id: r.features.toArray() for r in ML.add_features(new, scaler, svd, "t").collect()}
    assert len(out[1]) == svd.k + 1 and abs(out[1][0]) < 0.2  # 3 is the middle of 0 to 6
    assert np.abs(out[1][1:]).sum() > 0 and not out[2][1:].any()


def test_features_are_joined_without_a_first_row(spark, monkeypatch):
    """The text components' number is known: the assembler computes no row to look for it."""
    from pyspark.ml import Pipeline

    from talentflow.operators import svd as SVD
    df = spark.createDataFrame([(1, 2.0), (2, 4.0)], "id long, a double")
    scaler = Pipeline(stages=ML.feature_pipeline(["a"], ["svd_vec"])).fit(df)
    for bad in (True, False):
        def transform(model, docs, text_col, out_col):
            x = F.raise_error(F.lit("computed")).cast("double") if bad else F.lit(0.5)
            return docs.withColumn(out_col, F.array(x, F.col("a")))
        monkeypatch.setattr(SVD, "transform", transform)
        out = ML.add_features(df, scaler, SVD.TextSvd(None, [2.0, 1.0], 1.0), "t")
    assert sorted(r.features.toArray().round(4).tolist() for r in out.collect()) == [[-0.7071, 0.5, 2.0], [0.7071, 0.5, 4.0]]
    monkeypatch.setattr(SVD, "transform", lambda model, docs, text_col, out_col: docs.withColumn(out_col, F.array().cast("array<double>")))
    assert [len(r.features) for r in ML.add_features(df, scaler, SVD.TextSvd(None, [], 0.0), "t").collect()] == [1, 1]
