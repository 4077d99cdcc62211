"""The feature net's training in numpy (M11): MLlib's layers (sigmoid, softmax at the end), weights and
minimiser, on rows that are repeated by a number instead of being written several times.

A row is one binary value of 32-bit floats. A pass returns one gradient a task, whatever it read;
products are dense blocks (BLAS).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentflow.operators import lbfgs
from talentflow.operators.linear import Rows, _batch
from talentflow.operators.packed import pack, unpack
from talentflow.session import cut_lineage, ship_package


def pack_rows(df: DataFrame, copies: Column, features: str = "features", label: str = "label_idx") -> Rows:
    ship_package(df.sparkSession)
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"), copies.cast("double").alias("c"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pack(x.astype(np.float32)), *b.columns[1:]], names=["x", "y", "c"])

    table = cut_lineage(rows.mapInArrow(run, "x binary, y int, c double"))
    return Rows(table, max(df.sparkSession.sparkContext.defaultParallelism, table.rdd.getNumPartitions() // 4), 0)


def matrices(layers: list[int], flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The weights (inputs x outputs) and offsets of each layer, in MLlib's order."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def forward(x: np.ndarray, mats: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Inputs of every layer, and the log-probabilities of the classes."""
    held = [x]
    for w, b in mats[:-1]:
        z = held[-1] @ w + b
        np.negative(z, out=z)
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
        z += 1
        held.append(np.reciprocal(z, out=z))
    z = held[-1] @ mats[-1][0] + mats[-1][1]
    z -= z.max(axis=1, keepdims=True)
    return held, z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def slope(x: np.ndarray, y: np.ndarray, c: np.ndarray, mats: list) -> tuple[float, np.ndarray]:
    """The sum over the rows, ``c`` times each, of the cross-entropy, and its gradient."""
    held, logp = forward(x, mats)
    every = np.arange(len(y))
    loss = -(c * logp[every, y]).sum(dtype=float)
    d = np.exp(logp)
    d[every, y] -= 1
    d *= c[:, None]
    parts = []
    for i in range(len(mats) - 1, -1, -1):
        parts.append(np.concatenate([(held[i].T @ d).ravel(), d.sum(axis=0)]))
        if i:
            d = d @ mats[i][0].T
            d *= held[i] * (1 - held[i])
    return loss, np.concatenate(parts[::-1])


def descend(rows: Rows, layers: list[int], weights: np.ndarray, steps: int, tol: float = 1e-6) -> np.ndarray:
    """The weights after at most ``steps`` steps from ``weights``."""
    def answer(asked):
        mats = matrices(layers, asked[0].astype(np.float32))

        def run(batches):
            total = np.zeros(2 + len(weights))
            for b in batches:
                if b.num_rows:
                    c = b.column(2).to_numpy()
                    loss, grad = slope(unpack(b.column(0), np.float32), b.column(1).to_numpy(), c.astype(np.float32), mats)
                    total[0] += c.sum()
                    total[1] += loss
                    total[2:] += grad
            yield _batch(0, total)
        v = rows.sums(run)[0]
        return {0: (v[1] / v[0], v[2:] / v[0])}

    return lbfgs.together({0: lbfgs.minimise(weights, steps, tol)}, answer)[0]


def log_losses(df: DataFrame, groups: Column, layers: list[int], weights: np.ndarray, features: str = "features",
               label: str = "label_idx", weight: str = "weight") -> dict[int, float]:
    """``ml.log_loss`` of the net with these weights, by group (a whole number a row)."""
    mats = matrices(layers, weights)
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"),
                     F.col(weight).cast("double").alias("w"), groups.cast("int").alias("g"))

    def run(batches):
        sums = {}
        for b in batches:
            if b.num_rows:
                y, w, g = (b.column(i).to_numpy() for i in (1, 2, 3))
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                lost = w * -np.maximum(forward(x, mats)[1][np.arange(len(y)), y], np.log(1e-15))
                for k in np.unique(g):
                    sums[k] = sums.get(k, 0.0) + np.array([lost[g == k].sum(), w[g == k].sum()])
        for k, v in sums.items():
            yield _batch(k, v)

    return {k: float(v[0] / v[1]) if v[1] else 0.0 for k, v in Rows(rows, rows.rdd.getNumPartitions(), 0).sums(run).items()}
