"""Embedding near-duplicates with product quantisation (operator 9).

Unit vectors are put in the inverted list of their nearest coarse centroid; what is left
over (the residual) is quantised in ``SUBSPACES`` parts of 256 codes. A vector probes the
``PROBES`` lists nearest to it; distances to the codes come from table look-ups (the query's
side is exact). Each code keeps its quantisation error, so that a look-up distance less that
error is a lower bound: no pair of a probed list is lost by the codes. What passes is judged
by the exact cosine in double precision.

Equal vectors form one class and are never paired. A pair found from either side counts for
both: an index row carries its own probes, so a query knows whether the other side will
find the pair by itself. Tasks therefore return, per vector, a count and the root of the
links they saw - never pairs.

Scale: centroids and codes are fitted on a bounded sample (``SAMPLE`` vectors by hash) and
every vector is indexed; the number of lists grows with the square root of the vectors. Lists
and the queries of a list are split into blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentflow.llm.graph import components
from talentflow.llm.store import map_arrow, materialise
from talentflow.session import ship_package

THRESHOLD = 0.9
SAMPLE, MAX_LISTS, PROBES, SUBSPACES, CODES = 20_000, 4096, 8, 8, 256
BLOCK = 1024
_PAIRS = 1 << 17


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T * -2 + (c * c).sum(1)).argmin(1)


def kmeans(x: np.ndarray, k: int, seed: int, steps: int = 8) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster takes a random row."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        a = _nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[r.integers(0, len(x), len(c))])
    return c


class Quantiser:
    """Coarse centroids and residual codebooks of unit vectors."""

    def __init__(self, x: np.ndarray, lists: int, seed: int = 0):
        self.coarse = kmeans(x, lists, seed)
        rest = x - self.coarse[_nearest(x, self.coarse)]
        self.parts = [p for p in np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))]
        self.books = [kmeans(rest[:, p], CODES, seed + 1 + i) for i, p in enumerate(self.parts)]

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        d = x @ self.coarse.T * -2 + (self.coarse ** 2).sum(1)
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def encode(self, x: np.ndarray, lst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the distance of each vector from what its codes stand for."""
        rest = x - self.coarse[lst]
        codes = np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.books)], axis=1).astype(np.uint8)
        back = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((rest - back) ** 2).sum(1))

    def distances(self, q: np.ndarray, lst: int, codes: np.ndarray) -> np.ndarray:
        """Look-up distances of queries (rows) from codes of one list (columns)."""
        rest = q - self.coarse[lst]
        total = np.zeros((len(q), len(codes)), np.float32)
        for i, (p, b) in enumerate(zip(self.parts, self.books)):
            table = ((rest[:, p] ** 2).sum(1)[:, None] - 2 * rest[:, p] @ b.T + (b * b).sum(1)).astype(np.float32)
            total += table[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0))


def _units(rows) -> np.ndarray:
    """Unit vectors. A power of two takes very small or large ones to a range where their
    squares neither vanish nor overflow; for others it changes no digit."""
    x = np.asarray(rows, dtype=np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, for links ``a - b`` among ``n`` nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                 probes: int = PROBES, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """One row per input row: ``id, n_links, component_id, kept``.

    A vector that is null, zero, holds a null or a non-finite component, or is of another
    length than most vectors, links with nothing: 0 links, its own component, kept. Equal
    vectors are linked. Rows that repeat an id are taken as one vector; other columns are
    not read.
    """
    spark = vectors.sparkSession
    v = F.col(vec_col)
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(F.coalesce(usable, F.lit(False)), v.cast("array<double>")).alias("vec"))
    length = rows.filter("vec IS NOT NULL").groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = length.d if length else 0
    classes = (rows.filter(F.size("vec") == d).filter("vec IS NOT NULL").groupBy("vec")
               .agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    classes = materialise(classes, "vector-classes")
    n = classes.count()
    nothing = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return nothing
    share = min(1.0, 1.2 * sample / n)
    some = (classes.filter(F.pmod(F.xxhash64("vec", F.lit(seed)), F.lit(1_000_000)) <= int(share * 1_000_000))
            .select("rep", "vec").limit(sample).toPandas().sort_values("rep"))  # the documented bound of the fit
    if some.empty:
        some = classes.select("rep", "vec").limit(sample).toPandas()
    lists = int(min(MAX_LISTS, max(1, round(n ** 0.5)), max(1, len(some) // 4)))
    held = spark.sparkContext.broadcast(Quantiser(_units(some["vec"].tolist()), lists, seed))
    probes = min(probes, lists)

    def assign(batches):
        model = held.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _units(np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1))
            near = model.probes(x, probes)
            codes, err = model.encode(x, near[:, 0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * probes, pa.int32()), pa.array(near.ravel(), pa.int32())),
                 pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(err)],
                names=["rep", "copies", "vec", "near", "codes", "err"])

    kind = rows.schema["id"].dataType.simpleString()
    index = materialise(map_arrow(classes.select("rep", "vec", "copies"), assign,
                                  f"rep {kind}, copies long, vec binary, near array<int>, codes binary, err double"), "index")
    own = index.withColumn("lst", F.col("near")[0])
    asked = index.select("rep", "copies", "vec", F.col("near")[0].alias("home"), F.explode("near").alias("lst"))
    blocks = (own.groupBy("lst").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ib"))
              .join(asked.groupBy("lst").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qb")), "lst"))
    blocks = F.broadcast(materialise(blocks, "list-blocks"))  # one row per list: MAX_LISTS at most

    def part(of):
        return F.pmod(F.xxhash64("rep"), F.col(of)).cast("int")

    def all_of(of):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = own.join(blocks, "lst").withColumn("i", part("ib")).withColumn("q", all_of("qb"))
    right = asked.join(blocks, "lst").withColumn("q", part("qb")).withColumn("i", all_of("ib"))
    reach = np.sqrt(2 - 2 * threshold) + 1e-5

    def search(key, y: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"rep": [], "links": [], "root": []})
        model, lst = held.value, int(key[0])
        x = x.rename(columns=lambda c: c.removeprefix("q_"))
        xs, ys = (np.frombuffer(b"".join(t["vec"]), np.float64).reshape(len(t), -1) for t in (x, y))
        codes = np.frombuffer(b"".join(y["codes"]), np.uint8).reshape(len(y), -1)
        xr, yr = x["rep"].to_numpy(), y["rep"].to_numpy()
        near, home = np.stack(y["near"].to_numpy()), x["home"].to_numpy()
        low = model.distances(xs, lst, codes) - y["err"].to_numpy(np.float32)[None]
        a, b = np.nonzero((low <= reach) & (xr[:, None] != yr[None]))
        good = np.zeros(len(a), bool)
        for i in range(0, len(a), _PAIRS):
            s = slice(i, i + _PAIRS)
            good[s] = np.einsum("ij,ij->i", xs[a[s]], ys[b[s]]) >= threshold
        a, b = a[good], b[good]
        back = np.ones(len(a), bool)
        for i in range(0, len(a), _PAIRS):
            s = slice(i, i + _PAIRS)
            back[s] = ~(near[b[s]] == home[a[s]][:, None]).any(axis=1)
        nodes, at = np.unique(np.concatenate((xr, yr)), return_inverse=True)
        ai, bi = at[:len(xr)][a], at[len(xr):][b]
        links = np.bincount(ai, y["copies"].to_numpy()[b], len(nodes)) + np.bincount(bi[back], x["copies"].to_numpy()[a[back]], len(nodes))
        root = nodes[_roots(len(nodes), ai, bi)]
        seen = np.unique(np.concatenate((ai, bi)))
        return pd.DataFrame({"rep": nodes[seen], "links": links[seen].astype(np.int64), "root": root[seen]})

    ship_package(spark)
    queries = right.select(*[F.col(c).alias(f"q_{c}") for c in ("lst", "i", "q", "rep", "copies", "vec", "home")])
    found = materialise(left.groupBy("lst", "i", "q").cogroup(queries.groupBy("q_lst", "q_i", "q_q"))
                        .applyInPandas(search, f"rep {kind}, links long, root {kind}"), "found")
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found, "rep", "root").withColumnRenamed("node", "rep")
    info = classes.join(degree, "rep", "left").join(roots, "rep", "left").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    return (rows.join(info, "vec", "left")
            .select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
            .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))
