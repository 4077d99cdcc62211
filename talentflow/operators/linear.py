"""Linear classifiers fitted side by side (M7, M8, M13): multinomial logistic regression and
one-vs-rest linear SVM.

The models of a grid, of folds and of classes share their passes over the rows: one pass
computes the losses and gradients of all that still go on, as products of dense blocks (BLAS) in the
tasks. Objective, scaling, minimiser and stopping are those of MLlib's estimators, and what is
returned are MLlib's models. A row is one binary value of all its features, read where it was
written; no model keeps a copy of its own. What travels is a few numbers a feature and model.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, OneVsRestModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentflow.operators import lbfgs
from talentflow.operators.packed import pack, unpack
from talentflow.session import cut_lineage, ship_package


def inner(est):
    return est.getClassifier() if isinstance(est, OneVsRest) else est


def supported(est) -> bool:
    """Whether ``fit`` can stand in for the estimator's own."""
    e = inner(est)
    if isinstance(est, OneVsRest):
        return isinstance(e, LinearSVC) and e.getRegParam() > 0 and e.getFitIntercept()
    return (isinstance(e, LogisticRegression) and e.getFamily() == "multinomial" and e.getElasticNetParam() == 0
            and e.getRegParam() > 0 and e.getFitIntercept()
            and not any(p.name.endswith(("OnCoefficients", "OnIntercepts")) and e.isDefined(p) for p in e.params))


@dataclass
class Rows:
    """``x, y, m, w``: features, class, the sets that hold the row (bits) and its weight."""
    table: DataFrame
    tasks: int
    sets: int

    def sums(self, run) -> dict[int, np.ndarray]:
        """The sums by ``k`` of the arrays ``(k, v)`` that ``run`` makes of the batches of a task."""
        got = (self.table.coalesce(self.tasks).mapInArrow(run, "k int, v array<double>")
               .groupBy("k").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect())
        return {r.k: np.array(r.v) for r in got}


def pack_rows(df: DataFrame, sets: list[Column], features: str = "features", label: str = "label_idx", weight: str | None = None) -> Rows:
    """The rows of a feature table, each evaluated once; ``sets`` are at most 62 conditions."""
    ship_package(df.sparkSession)
    bits = [F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(sets)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"), mask.alias("m"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False)
            if any(c.null_count for c in b.columns) or not np.isfinite(x).all():
                raise ValueError("a row without label, weight or finite features")
            yield pa.RecordBatch.from_arrays([pack(x.reshape(b.num_rows, -1)), *b.columns[1:]], names=["x", "y", "m", "w"])

    table = cut_lineage(rows.mapInArrow(run, "x binary, y int, m long, w double"))
    # a task returns as much whatever it read: no more tasks than keep the cores busy
    return Rows(table, max(df.sparkSession.sparkContext.defaultParallelism, table.rdd.getNumPartitions() // 4), len(sets))


def _columns(b: pa.RecordBatch):
    return unpack(b.column(0), np.float64), *(b.column(i).to_numpy() for i in (1, 2, 3))


def _batch(k: int, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["k", "v"])


@dataclass
class Moments:
    """By class (first axis) and set: rows, sums of weights and of their squares, of the features and
    of their squares."""
    n: np.ndarray
    w: np.ndarray
    ww: np.ndarray
    x: np.ndarray
    xx: np.ndarray


def moments(rows: Rows) -> Moments:
    sets = rows.sets

    def run(batches):
        sums = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, y, m, w = _columns(b)
            held = ((m[:, None] >> np.arange(sets)) & 1).astype(float)
            for c in np.unique(y):
                at = y == c
                k = held[at]
                kw = k * w[at, None]
                part = np.concatenate([k.sum(0), kw.sum(0), (kw * w[at, None]).sum(0), (kw.T @ x[at]).ravel(), (kw.T @ (x[at] * x[at])).ravel()])
                sums[c] = sums.get(c, 0.0) + part
        for c, v in sums.items():
            yield _batch(c, v)

    got = rows.sums(run)
    if not got or min(got) < 0:
        raise ValueError("no rows, or a negative class")
    size = (len(next(iter(got.values()))) - 3 * sets) // (2 * sets)
    flat = np.array([got.get(c, np.zeros((3 + 2 * size) * sets)) for c in range(max(got) + 1)])
    cut = np.split(flat, [sets, 2 * sets, 3 * sets, (3 + size) * sets], axis=1)
    return Moments(*cut[:3], *(a.reshape(len(flat), sets, size) for a in cut[3:]))


class Fit:
    """One minimisation: the softmax of all classes, or the hinge loss of class ``positive``.

    ``number`` is the set to learn from, ``factor`` the weight of a class besides that of its rows."""

    def __init__(self, est, m: Moments, number: int, factor: np.ndarray, positive: int | None = None):
        e = inner(est)
        self.number, self.factor, self.positive = number, factor, positive
        self.max_iter, self.tol = e.getMaxIter(), e.getTol()
        hist = factor * m.w[:, number]
        self.total = hist.sum()
        self.mean = (factor @ m.x[:, number]) / self.total
        square = (factor @ m.xx[:, number]) / self.total
        var = square - self.mean ** 2
        var[var < 1e-12 * square] = 0.0                          # a constant feature, but for rounding
        free = self.total - (factor * factor) @ m.ww[:, number] / self.total
        std = np.sqrt(var * self.total / free) if free > 0 else np.zeros_like(var)
        self.inverse = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
        # the penalty is on the coefficients of scaled or of plain features; both are fitted scaled
        self.penalty = e.getRegParam() * (np.ones_like(std) if e.getStandardization() else self.inverse ** 2)
        self.width = len(factor) if positive is None else 1
        self.start = np.zeros((len(std) + 1, self.width))
        if positive is None:
            self.start[-1] = np.log1p(hist) - np.log1p(hist).mean()

    def plain(self, point: np.ndarray):
        """Coefficients (a row a feature) and intercepts for the features as they are."""
        t = point.reshape(-1, self.width)
        w = t[:-1] * self.inverse[:, None]
        return w, t[-1] - self.mean @ w

    def answer(self, point: np.ndarray, loss: float, g: np.ndarray, r: np.ndarray):
        t = point.reshape(-1, self.width)
        pull = self.penalty[:, None] * t[:-1]
        grad = np.concatenate([self.inverse[:, None] * (g - self.mean[:, None] * r) / self.total + pull, r[None] / self.total])
        return loss / self.total + 0.5 * (t[:-1] * pull).sum(), grad.ravel()


def _evaluate(rows: Rows, fits: list[Fit], points: list[np.ndarray]) -> list:
    """Value and gradient of every fit at its point, from one pass."""
    order = sorted(range(len(fits)), key=lambda i: fits[i].positive is not None)     # softmax fits first
    some = [fits[i] for i in order]
    placed = [fits[i].plain(points[i]) for i in order]
    coef, bias = np.concatenate([w for w, _ in placed], axis=1), np.concatenate([b for _, b in placed])
    soft = sum(f.positive is None for f in some)
    classes, edge = len(some[0].factor), soft * len(some[0].factor)
    factor, number = np.array([f.factor for f in some]), np.array([f.number for f in some])
    positive = np.array([f.positive for f in some[soft:]])

    def run(batches):
        loss, g, r = np.zeros(len(number)), np.zeros_like(coef), np.zeros_like(bias)
        for b in batches:
            if not b.num_rows:
                continue
            x, y, m, w = _columns(b)
            every = np.arange(len(y))
            z = x @ coef + bias
            on = w[:, None] * factor[:, y].T * ((m[:, None] >> number) & 1)
            if soft:
                s = z[:, :edge].reshape(len(y), soft, classes)
                s = s - s.max(axis=2, keepdims=True)
                own = s[every, :, y]
                np.exp(s, out=s)
                total = s.sum(axis=2)
                loss[:soft] += (on[:, :soft] * (np.log(total) - own)).sum(axis=0)
                s /= total[:, :, None]
                s[every, :, y] -= 1
                s *= on[:, :soft, None]
                z[:, :edge] = s.reshape(len(y), edge)
            if len(positive):
                side = np.where(y[:, None] == positive, 1.0, -1.0)
                short = 1 - side * z[:, edge:]
                hit = on[:, soft:] * (short > 0)
                loss[soft:] += (hit * short).sum(axis=0)
                z[:, edge:] = -side * hit
            g += x.T @ z
            r += z.sum(axis=0)
        yield _batch(0, np.concatenate([loss, g.ravel(), r]))

    v = rows.sums(run)[0]
    g, r = v[len(fits):len(fits) + coef.size].reshape(coef.shape), v[len(fits) + coef.size:]
    out, at = {}, 0
    for i, f, loss in zip(order, some, v):
        own = slice(at, at + f.width)
        out[i], at = f.answer(points[i], loss, g[:, own], r[own]), own.stop
    return out


def solve(rows: Rows, fits: list[Fit]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Coefficients and intercepts of every fit."""
    def answer(asked):
        keys = list(asked)
        found = _evaluate(rows, [fits[i] for i in keys], [asked[i] for i in keys])
        return {keys[i]: v for i, v in found.items()}

    runs = {i: lbfgs.minimise(f.start.ravel(), f.max_iter, f.tol, f.positive is not None) for i, f in enumerate(fits)}
    ends = lbfgs.together(runs, answer)
    out = []
    for i, f in enumerate(fits):
        w, b = f.plain(ends[i])
        out.append((w, b - b.mean() if f.positive is None else b))
    return out


def _fits(est, m: Moments, number: int, factor: np.ndarray) -> list[Fit]:
    """One softmax, or a hinge loss a class."""
    return [Fit(est, m, number, factor, k) for k in (range(len(factor)) if isinstance(est, OneVsRest) else [None])]


def _whole(m: Moments, numbers) -> bool:
    """Whether every set has rows of all classes, and there are two or more."""
    return len(m.n) > 1 and bool((m.w[:, list(numbers)] > 0).all())


def fit(ests: list, df: DataFrame) -> list:
    """The models that the estimators' own ``fit`` returns, from shared passes."""
    first = ests[0]
    if not all(map(supported, ests)):
        return [est.fit(df) for est in ests]
    rows = pack_rows(df, [F.lit(True)], first.getFeaturesCol(), first.getLabelCol(),
                     first.getWeightCol() if first.isDefined(first.weightCol) else None)
    m = moments(rows)
    if not _whole(m, [0]):
        return [est.fit(df) for est in ests]
    fits = [_fits(est, m, 0, np.ones(len(m.n))) for est in ests]
    ends, out = solve(rows, [f for some in fits for f in some]), []
    for est, some in zip(ests, fits):
        out.append(_model(df.sparkSession, est, ends[:len(some)]))
        ends = ends[len(some):]
    return out


def _model(spark, est, ends: list[tuple[np.ndarray, np.ndarray]]):
    """MLlib's model of these coefficients."""
    made, sc = spark.sparkContext._jvm.org.apache.spark.ml.classification, spark.sparkContext
    e = inner(est)

    def one(w, b):
        if isinstance(e, LogisticRegression):
            matrix = DenseMatrix(w.shape[1], w.shape[0], w.ravel().tolist())
            java = made.LogisticRegressionModel(e.uid, _py2java(sc, matrix), _py2java(sc, Vectors.dense(b)), len(b), True)
        else:
            java = made.LinearSVCModel(e.uid, _py2java(sc, Vectors.dense(w[:, 0])), float(b[0]))
        return e._copyValues(e._create_model(java))
    if not isinstance(est, OneVsRest):
        return one(*ends[0])
    e = e.copy({e.featuresCol: est.getFeaturesCol()})
    return est._copyValues(OneVsRestModel(models=[one(*x) for x in ends]))


def macro_f1(counts: np.ndarray, digits: int = 4) -> float:
    """Macro-F1 of a confusion table (a row a class, a column a prediction) over the classes in either."""
    tp, said, there = np.diag(counts), counts.sum(axis=0), counts.sum(axis=1)
    p = np.divide(tp, said, out=np.zeros(len(tp)), where=said > 0)
    r = np.divide(tp, there, out=np.zeros(len(tp)), where=there > 0)
    f = np.divide(2 * p * r, p + r, out=np.zeros(len(tp)), where=p + r > 0)[said + there > 0]
    return float(Decimal(repr(float(f.sum() / len(f)))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def validate(df: DataFrame, points: dict, parts: list[tuple[Column, Column]]) -> list[dict] | None:
    """Every estimator of ``points`` on every part ``(training rows, validation rows)``, training
    rows weighted so that classes balance: ``{point, part, n_train, n_valid, f1_macro, train_f1}``.
    None if a part lacks a class."""
    first = inner(next(iter(points.values())))
    rows = pack_rows(df, [c for part in parts for c in part], first.getFeaturesCol(), first.getLabelCol())
    m = moments(rows)
    if not _whole(m, range(0, rows.sets, 2)):
        return None
    tasks = [(name, i) for i in range(len(parts)) for name in points]
    fits = []
    for name, i in tasks:
        n = m.n[:, 2 * i]
        fits.append(_fits(points[name], m, 2 * i, n.sum() / (len(n) * n)))
    ends = solve(rows, [f for some in fits for f in some])
    models = []
    for some in fits:
        models.append([np.concatenate(a, axis=-1) for a in zip(*ends[:len(some)])])
        ends = ends[len(some):]
    counts = _confusions(rows, models, [2 * i for _, i in tasks])
    return [{"point": name, "part": i, "n_train": int(m.n[:, 2 * i].sum()), "n_valid": int(m.n[:, 2 * i + 1].sum()),
             "f1_macro": macro_f1(valid), "train_f1": macro_f1(train)} for (name, i), (train, valid) in zip(tasks, counts)]


def _confusions(rows: Rows, models: list, first: list[int]) -> np.ndarray:
    """``(model, 2, class, prediction)``: counts on the set ``first`` of each model and the next one."""
    coef, bias = (np.concatenate(a, axis=-1) for a in zip(*models))
    classes = len(models[0][1])

    def run(batches):
        counts = np.zeros((len(first), 2, classes * classes))
        for b in batches:
            if not b.num_rows:
                continue
            x, y, m, _ = _columns(b)
            said = (x @ coef + bias).reshape(len(y), len(first), classes).argmax(axis=2)
            for j, k in enumerate(first):
                for s in (0, 1):
                    on = ((m >> (k + s)) & 1).astype(bool)
                    counts[j, s] += np.bincount(y[on] * classes + said[on, j], minlength=classes * classes)
        yield _batch(0, counts.ravel())

    return rows.sums(run)[0].reshape(len(first), 2, classes, classes)
