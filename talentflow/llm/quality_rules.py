"""Quality classifier as a sparse rule ensemble (operator 2).

Statistics of a whole text (length, shares of letters, marks and repeated words, ...) are
Spark columns. Small boosted trees are grown on a bounded sample of labelled rows; every
path from a root to a node is a conjunctive rule over the statistics; a logistic model with
an L1 penalty picks and weighs the rules; what is left is compiled into one Spark column.

Scale: scoring is a projection - one scan, no shuffle, no Python. For the fit at most
``max_rows`` labelled rows (chosen by a hash of their id, whatever the table's size) are
joined and only their statistics come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 20_000
TREES, DEPTH, BINS, MIN_LEAF, SHRINK = 40, 3, 32, 15, 0.3
L1, STEPS = 0.002, 400


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; null counts as empty and every share of an empty text is 0."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.length(t).cast("double")
    words = F.filter(F.split(t, r"[ \t\r\n]+"), lambda w: w != "")
    n_words = F.size(words).cast("double")

    def per_char(pattern):
        return F.when(n > 0, F.regexp_count(t, F.lit(pattern)) / n).otherwise(0.0)
    return {
        "chars": n,
        "words": n_words,
        "word_length": F.when(n_words > 0, n / n_words).otherwise(0.0),
        "distinct_words": F.when(n_words > 0, F.size(F.array_distinct(words)) / n_words).otherwise(0.0),
        "upper": per_char("[A-Z]"),
        "digits": per_char("[0-9]"),
        "wide": per_char(r"[^\x00-\x7F]"),
        "commas": per_char("[,;:]"),
        "stops": per_char("[.]"),
        "shouts": per_char("[!?]"),
        "bars": per_char("[|]"),
        "symbols": per_char(r"[#$%&*+<=>@\\^_`{}~\[\]/]"),
        "lines": per_char(r"\n"),
    }


@dataclass
class Rules:
    """``score = sigmoid(bias + sum of the weights of the rules that hold)``; a rule is a
    list of ``(statistic, low, high)`` meaning ``low < value <= high``."""
    bias: float
    rules: list[list[tuple[str, float, float]]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self, stats: dict[str, Column]) -> Column:
        z = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights):
            parts = []
            for name, lo, hi in rule:
                if np.isfinite(lo):
                    parts.append(stats[name] > F.lit(float(lo)))
                if np.isfinite(hi):
                    parts.append(stats[name] <= F.lit(float(hi)))
            holds = parts[0]
            for p in parts[1:]:
                holds = holds & p
            z = z + F.when(holds, F.lit(float(weight))).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(binned, grad, hess, cuts, rng):
    """One regression tree on gradients; returns its leaves' values per row and all paths
    ``{feature: [low bin, high bin]}`` of its nodes."""
    n, d = binned.shape
    value, paths = np.zeros(n), []
    todo = [(np.arange(n), {}, 0)]
    while todo:
        rows, box, depth = todo.pop()
        if box:
            paths.append(box)
        best = None
        if depth < DEPTH and len(rows) >= 2 * MIN_LEAF:
            g0, h0 = grad[rows].sum(), hess[rows].sum()
            for f in rng.permutation(d)[: max(3, (2 * d) // 3)]:
                b = binned[rows, f]
                g = np.cumsum(np.bincount(b, grad[rows], BINS))
                h = np.cumsum(np.bincount(b, hess[rows], BINS))
                c = np.cumsum(np.bincount(b, minlength=BINS))
                ok = (c >= MIN_LEAF) & (len(rows) - c >= MIN_LEAF)
                gain = np.where(ok, g ** 2 / (h + 1) + (g0 - g) ** 2 / (h0 - h + 1) - g0 ** 2 / (h0 + 1), 0)
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = gain[k], f, k
        if best is None:
            value[rows] = grad[rows].sum() / (hess[rows].sum() + 1)
            continue
        _, f, k = best
        left = binned[rows, f] <= k
        lo, hi = box.get(f, (-1, BINS))
        todo.append((rows[left], box | {f: (lo, min(hi, k))}, depth + 1))
        todo.append((rows[~left], box | {f: (max(lo, k), hi)}, depth + 1))
    return value, paths


def _lasso(x: np.ndarray, y: np.ndarray, l1: float, steps: int) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradient."""
    n, d = x.shape
    lip = 0.25 * (np.linalg.norm(x, 2) ** 2 / n + 1)
    w, v, b, vb, t = np.zeros(d), np.zeros(d), 0.0, 0.0, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(x @ v + vb))) - y
        w2 = v - x.T @ r / n / lip
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - l1 / lip, 0)
        b2 = vb - r.mean() / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return float(b), w


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 0) -> Rules:
    """Grow trees, turn their paths into rules, weigh these. With no rows, or rows of one
    class only, the result is the (smoothed) share of label 1, without rules."""
    prior = (y.sum() + 1) / (len(y) + 2)
    empty = Rules(float(np.log(prior / (1 - prior))))
    if len(y) < 2 * MIN_LEAF or y.min() == y.max():
        return empty
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    z, seen = np.full(len(y), empty.bias), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        part = rng.random(len(y)) < 0.7
        value, paths = _grow(binned, np.where(part, y - p, 0), np.where(part, p * (1 - p), 0) + 1e-9, cuts, rng)
        z += SHRINK * value
        for box in paths:
            seen.setdefault(tuple(sorted(box.items())), None)
    rules, columns = [], []
    for box in seen:
        rule, holds = [], np.ones(len(y), bool)
        for f, (lo, hi) in box:
            c = cuts[f]
            low = c[lo] if 0 <= lo < len(c) else -np.inf
            high = c[hi] if hi < len(c) else np.inf
            holds &= (x[:, f] > low) & (x[:, f] <= high)
            if np.isfinite(low) or np.isfinite(high):
                rule.append((names[f], float(low), float(high)))
        if rule and MIN_LEAF <= holds.sum() < len(y):
            rules.append(rule)
            columns.append(holds)
    if not rules:
        return empty
    bias, w = _lasso(np.stack(columns, axis=1).astype(float), y, L1, STEPS)
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    return Rules(bias, [rules[i] for i in keep], [float(w[i]) for i in keep])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", max_rows: int = MAX_ROWS, seed: int = 0) -> Rules:
    """Fit on at most about ``max_rows`` labelled documents, picked by a hash of their id.
    Rows without a label or an id are not used; of a repeated label one is."""
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y")))
    n = known.count()
    keep = min(1.0, max_rows / max(n, 1))
    pick = F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1_000_000)) < int(keep * 1_000_000)
    some = known.filter(pick).limit(max_rows)  # the documented bound of the fit
    stats = statistics(F.col(text_col))
    names = list(stats)
    rows = (docs.join(F.broadcast(some), docs[id_col] == some["__id"])
            .select(*[c.alias(k) for k, c in stats.items()], F.col("__y").cast("double").alias("__y"))
            .limit(2 * max_rows).toPandas())
    rows = rows.sort_values([*names, "__y"])  # the same fit in whatever order rows arrive
    return fit_rules(rows[names].to_numpy(float), rows["__y"].to_numpy(float), names, seed)


def score(docs: DataFrame, model: Rules, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the column ``score_col`` (0 to 1); null and empty texts get the score of
    an empty text; columns that clash with the statistics' names are left alone."""
    stats = {k: c.alias(f"__stat_{k}") for k, c in statistics(F.col(text_col)).items()}
    with_stats = docs.select("*", *stats.values())
    return (with_stats.withColumn(score_col, model.column({k: F.col(f"__stat_{k}") for k in stats}))
            .drop(*[f"__stat_{k}" for k in stats]))
