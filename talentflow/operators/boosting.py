"""One softmax boosted-tree model for all classes (M10), grown from histograms.

Every round grows one tree whose leaves hold one value a class; a split is chosen by the
second-order gain summed over the classes. Features are cut into at most ``bins`` ranges by
approximate percentiles. A level of a tree is one Spark job: each task adds the gradients and
curvatures of its rows by (node, feature, range, class), Spark sums these histograms over
the tasks, and the driver, which sees ``features x nodes x bins x classes`` numbers and no
row, picks the splits. Rows marked as held out only serve the loss: training stops after
``patience`` rounds without a better one, and the trees after the best round are dropped.

Scale: rows are one byte a feature and stay where they are; scores of finished trees are
written to the shared folder every ``KEEP`` rounds, so that a pass evaluates few trees.
Row sampling is by a hash of the row number, so that a task that runs again draws alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentflow.operators.packed import pack, unpack
from talentflow.plans import presets as P
from talentflow.session import cut_lineage, ship_package

KEEP = 25


@dataclass
class Tree:
    """A complete tree: node ``i`` has the children ``2i + 1`` and ``2i + 2``. A row goes right
    if its range of ``feature[i]`` is above ``cut[i]``; a node without a split (-1) sends all left."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray  # one row a leaf, one column a class

    def places(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The place among the nodes of its level of each row after ``depth`` levels; ``bins`` has a
        row a feature. Every split is a comparison of whole features: no row is looked up."""
        at = np.zeros(bins.shape[1], np.uint8 if depth <= 8 else np.int64)
        for level in range(depth):
            right = np.zeros(len(at), bool)
            for place in range(1 << level):
                f, cut = (int(a[(1 << level) - 1 + place]) for a in (self.feature, self.cut))
                if f >= 0:
                    right |= (at == place) & (bins[f] > cut)
            at = 2 * at + right
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.places(bins, int(np.log2(len(self.value))))]


@dataclass
class BoostedModel:
    edges: list[np.ndarray]
    base: np.ndarray
    trees: list[Tree]
    history: list[dict]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        bins, score = np.ascontiguousarray(_cut(x, self.edges).T), np.tile(self.base, (len(x), 1))
        for t in self.trees:
            score += t.scores(bins)
        return _softmax(score)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with ``probability`` (array of doubles) and ``prediction`` (class number)."""
        held = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(list(held.value.probabilities(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

        out = df.withColumn("probability", score(vector_to_array(features)))
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

    def importances(self, n: int) -> np.ndarray:
        """Share of the splits that use each of the ``n`` features."""
        used = np.bincount(np.concatenate([t.feature[t.feature >= 0] for t in self.trees] or [np.zeros(0, np.int64)]), minlength=n)
        return used / max(used.sum(), 1)


def _softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _cut(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.searchsorted(e, x[:, f], side="left")
    return out


def _mixed(row: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each row and salt."""
    x = row.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0 ** 64


def feature_edges(df: DataFrame, features: str, n: int, bins: int) -> list[np.ndarray]:
    """Upper edges of each feature's ranges, by approximate percentiles in one pass."""
    share = [i / bins for i in range(1, bins)]
    x = df.select(vector_to_array(features).alias("x"))
    row = x.agg(*[F.percentile_approx(F.col("x")[i], share, 2000).alias(f"c{i}") for i in range(n)]).first()
    return [np.unique(np.array(e, float)) if e else np.zeros(0) for e in row]


def _table(df: DataFrame, features: str, label: str, weight: str, held_out: str | None, edges, base) -> DataFrame:
    rows = df.select(F.monotonically_increasing_id().alias("row"), vector_to_array(features).alias("x"),
                     F.col(label).cast("int").alias("y"), F.col(weight).cast("double").alias("w"),
                     (F.col(held_out) if held_out else F.lit(False)).alias("out"))
    held = df.sparkSession.sparkContext.broadcast(edges)
    ship_package(df.sparkSession)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            cells = _cut(x, held.value)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pack(cells), b.column(2), b.column(3), b.column(4),
                 pa.array([base.tolist()] * b.num_rows, pa.list_(pa.float64()))], names=["row", "x", "y", "w", "out", "score"])

    return cut_lineage(rows.mapInArrow(run, "row long, x binary, y int, w double, out boolean, score array<double>"))


def _arrays(b: pa.RecordBatch, trees: list[Tree], n_features: int):
    """Row numbers, ranges (a row a feature), labels, weights, held-out marks and scores of a batch."""
    row, y, w, out = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
    bins = np.ascontiguousarray(unpack(b.column(1), np.uint8).T)
    score = b.column(5).flatten().to_numpy().reshape(len(row), -1).copy()
    for t in trees:
        score += t.scores(bins)
    return row, bins, y, w, out.astype(bool), score


def _level(table: DataFrame, trees: list[Tree], tree: Tree, depth: int, number: int, columns: np.ndarray,
           n_features: int, bins: int, classes: int, sample: float):
    """The histograms ``(feature, node, range, gradients then curvatures)`` of one level, and the
    losses ``(training, weight, held out, weight)``."""
    state = table.sparkSession.sparkContext.broadcast((trees, tree, columns))

    def run(batches):
        trees, tree, columns = state.value
        shape = (len(columns), 2 * classes, bins << depth)
        total, loss = np.zeros(shape), np.zeros(4)
        for b in batches:
            if not b.num_rows:
                continue
            row, x, y, w, out, score = _arrays(b, trees, n_features)
            p = _softmax(score)
            lost = -w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-15))
            loss += lost[~out].sum(), w[~out].sum(), lost[out].sum(), w[out].sum()
            bag = ~out & (_mixed(row, number) < sample)
            x, y, w, p = x[:, bag], y[bag], w[bag], p[bag]
            g = p.copy()
            g[np.arange(len(y)), y] -= 1
            both = np.ascontiguousarray((np.concatenate((g, 2 * p * (1 - p)), axis=1) * w[:, None]).T)
            first = tree.places(x, depth).astype(np.int64) * bins
            for j, f in enumerate(columns):
                key = first + x[f]
                for k in range(2 * classes):
                    total[j, k] += np.bincount(key, weights=both[k], minlength=shape[2])
        total = total.transpose(0, 2, 1).reshape(len(columns), -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(len(columns))], pa.int32()), pa.array([loss.tolist(), *total.tolist()], pa.list_(pa.float64()))],
            names=["f", "h"])

    # a task returns as much whatever it read: no more tasks than keep the cores busy
    tasks = max(table.sparkSession.sparkContext.defaultParallelism, table.rdd.getNumPartitions() // 4)
    sums = (table.coalesce(tasks).mapInArrow(run, "f int, h array<double>").groupBy("f")
            .agg(vector_to_array(Summarizer.sum(array_to_vector("h"))).alias("h")).collect())
    state.unpersist()
    hist = np.zeros((len(columns), 1 << depth, bins, 2 * classes))
    loss = np.zeros(4)
    for r in sums:
        if r.f < 0:
            loss = np.array(r.h)
        else:
            hist[r.f] = np.reshape(r.h, hist.shape[1:])
    return hist, loss


def best_splits(hist: np.ndarray, classes: int, reg: float, gamma: float, least: float):
    """For each node ``(column, cut, gain)`` of the best split, column -1 if none gains, with
    the sums ``(left, right)`` of gradients and curvatures."""
    def worth(s):
        return (s[..., :classes] ** 2 / (s[..., classes:] + reg)).sum(axis=-1)
    left = np.cumsum(hist, axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    gain = 0.5 * (worth(left) + worth(right) - worth(total)) - gamma
    few = np.minimum(left[..., classes:].sum(axis=-1), right[..., classes:].sum(axis=-1)) < least
    gain[few] = -np.inf
    gain[:, :, -1] = -np.inf
    out = []
    for node in range(hist.shape[1]):
        f, cut = np.unravel_index(np.argmax(gain[:, node]), gain[:, node].shape)
        if gain[f, node, cut] > 0:
            out.append((int(f), int(cut), float(gain[f, node, cut]), left[f, node, cut], right[f, node, cut]))
        else:
            out.append((-1, 0, 0.0, total[0, node, 0], np.zeros(2 * classes)))
    return out


def fit(df: DataFrame, n_features: int, classes: int = 3, features: str = "features", label: str = "label_idx",
        weight: str = "weight", held_out: str | None = None, rounds: int = 350, depth: int = 4, rate: float = 0.07,
        reg: float = 3.0, gamma: float = 0.5, least: float = 5.0, sample: float = 0.8, columns: float = 0.8,
        bins: int = 32, patience: int = 10, seed: int = P.SEED) -> BoostedModel:
    """M10 fit. ``held_out`` names a boolean column; without it all rounds are grown.

    ``least`` is the curvature that each side of a split must hold, ``sample`` and ``columns``
    the shares of rows and features of a round. Rows need a label and no null feature."""
    train = df.filter(~F.col(held_out)) if held_out else df
    edges = feature_edges(train, features, n_features, bins)
    share = {r.y: r.w for r in train.groupBy(F.col(label).cast("int").alias("y")).agg(F.sum(weight).alias("w")).collect()}  # one row a class
    base = np.log(np.array([max(share.get(c, 0.0), 1e-9) for c in range(classes)]) / max(sum(share.values()), 1e-9))
    table = _table(df, features, label, weight, held_out, edges, base)
    rng = np.random.default_rng(seed)
    trees, fresh, history, best, best_at = [], [], [], np.inf, 0
    for number in range(rounds + 1):
        mine = np.sort(rng.permutation(n_features)[:max(int(columns * n_features), 1)])
        tree = Tree(np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth, classes)))
        for level in range(depth if number < rounds else 1):
            hist, loss = _level(table, fresh, tree, level, number, mine, n_features, bins, classes, sample)
            if level == 0:
                now = loss[2] / loss[3] if loss[3] > 0 else loss[0] / max(loss[1], 1e-9)
                history.append({"round": number, "train_loss": loss[0] / max(loss[1], 1e-9),
                                "held_out_loss": loss[2] / loss[3] if loss[3] > 0 else None})
                if now < best - 1e-4:
                    best, best_at = now, number
                if number == rounds or (loss[3] > 0 and number - best_at >= patience):
                    return BoostedModel(edges, base, trees[:best_at] if loss[3] > 0 else trees, history)
            first = (1 << level) - 1
            for i, (f, cut, _, left, right) in enumerate(best_splits(hist, classes, reg, gamma, least)):
                if f >= 0:
                    tree.feature[first + i], tree.cut[first + i] = mine[f], cut
                # the leaves below the left and the right child; deeper levels write theirs anew
                span = 1 << (depth - level - 1)
                for side, s in ((0, left), (1, right)):
                    at = (2 * i + side) * span
                    tree.value[at:at + span] = -rate * s[:classes] / (s[classes:] + reg)
        trees.append(tree)
        fresh.append(tree)
        if len(fresh) == KEEP:
            table, fresh = _with_scores(table, fresh, n_features), []
    return BoostedModel(edges, base, trees, history)


def _with_scores(table: DataFrame, trees: list[Tree], n_features: int) -> DataFrame:
    def run(batches):
        for b in batches:
            score = _arrays(b, trees, n_features)[5] if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(score.tolist(), pa.list_(pa.float64()))], names=b.schema.names)

    return cut_lineage(table.mapInArrow(run, table.schema))
