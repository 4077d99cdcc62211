"""N-gram Jaccard join with Bayesian candidate pruning (operator 6).

A document's set is its runs of five words (as in ``decontaminate``; a text with fewer
words, but not none, is one run). Documents with the same set form a class; classes are
joined, copies never are. 128 MinHash values a class make 32 bands of four; classes that
share a band are candidates (a pair at the threshold is missed with probability 5e-8). MinHash values of a candidate are compared 16 at a time:
with a uniform prior the posterior of ``P(similarity >= t)`` after m matches of n is
``P(Bin(n + 1, t) <= m)``; a pair below the tolerance is dropped. The rest is verified on
the exact sets.

Scale: one scan builds the sketches; bands that hold one class only (most) are counted by
their key and go no further. Classes that share bands are put into blocks of bounded size, and
meet block by block; a task returns, per class, the number of links it saw and the smallest id
that they reach - never pairs, so that a group of n similar texts costs n rows a block. Sets
are built again for the classes in blocks only: a bitmap of fixed size picks their texts on a
scan, and texts are never shuffled.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentflow.llm import kernel as K
from talentflow.llm.graph import components
from talentflow.llm.store import bitmap, drop_tables, hand_back, map_arrow_frugal, marked, materialise
from talentflow.session import ship_package

SHINGLE, THRESHOLD = 5, 0.8
HASHES, ROWS = 128, 4
ROUND, TOLERANCE = 16, 1e-7
BLOCK, BLOCK_RUNS = 512, 400_000
_A = K.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = K.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def least_matches(t: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each round: the fewest matches with which a pair stays."""
    out = []
    for n in range(ROUND, HASHES + 1, ROUND):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _sets(s: K.Slice, k: int):
    """Sorted distinct run hashes of each row of a slice, one after the other."""
    low = K.LOWER[s.data]
    w = K.find_words(low, s.offsets, K.WORD_BYTES)
    h = K.hash_spans(low, w.starts, w.ends)
    size = np.bincount(w.row, minlength=s.rows)
    first = np.concatenate(([0], np.cumsum(size)))
    grams = K.ngram_hashes(h, k)
    for r in range(s.rows):
        a, b = first[r], first[r + 1]
        if b - a >= k:
            yield np.unique(grams[a:b - k + 1])
        elif b > a:
            yield K.ngram_hashes(h[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _name(x: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return (int(K.mix(x).sum(dtype=np.uint64)).to_bytes(8, "big")
                + int(np.bitwise_xor.reduce(K.mix(x ^ np.uint64(0x5851F42D4C957F2D)))).to_bytes(8, "big"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``doc, n (distinct runs), cls, sig`` for every row; ``cls`` and ``sig`` are null for
    a text without words."""
    def run(batches):
        for b in batches:
            for s in K.slices(b.column(1)):
                sets = list(_sets(s, k))
                n = np.fromiter((len(x) for x in sets), np.int64, len(sets))
                full = np.flatnonzero(n)
                sig = np.zeros((len(full), HASHES), np.uint32)
                if len(full):
                    x = np.concatenate([sets[i] for i in full])
                    at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    for j in range(HASHES):
                        sig[:, j] = np.minimum.reduceat((x * _A[j] + _B[j]) >> np.uint64(32), at)
                names, sigs = [None] * len(sets), [None] * len(sets)
                for i, r in enumerate(full):
                    names[r], sigs[r] = _name(sets[r]), sig[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.lo, s.rows), pa.array(n), pa.array(names, pa.binary()),
                     pa.array(sigs, pa.binary())], names=["doc", "n", "cls", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return map_arrow_frugal(rows, run, f"doc {kind}, n long, cls binary, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    """``c8, band, key``: 64 bits of a class's name stand for it until sets are joined. Two
    classes of one number would only share their blocks."""
    width = 4 * ROWS
    keys = [F.xxhash64(F.lit(i), F.substring(F.col("sig"), width * i + 1, width)) for i in range(HASHES // ROWS)]
    return classes.select("c8", F.posexplode(F.array(*keys)).alias("band", "key"))


def _blocks(classes: DataFrame) -> DataFrame:
    """``lo, hi, c8, block``: the block pairs in which each class has to be, so that any two classes
    that share a band meet in exactly one of them (``lo`` and ``hi`` are their blocks).

    A class's lead is the smallest class that it shares a band with; classes of one lead lie in
    one block, or in several if they exceed ``BLOCK`` classes or ``BLOCK_RUNS`` runs. Classes
    that share no band with another are left out."""
    crowded = (_bands(classes).groupBy("key").agg(F.count("*").alias("c"), F.min("c8").alias("first"))
               .filter("c > 1").select("key", "first"))
    crowded = materialise(crowded, "crowded-bands")
    shared = materialise(_bands(classes).join(crowded, "key").select("key", "c8", "first"), "shared-bands")
    lead = shared.groupBy("c8").agg(F.min("first").alias("lead")).join(classes.select("c8", "n"), "c8")
    lead = materialise(lead, "leads")
    sums = lead.agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    few = int(max(1, sums.c // BLOCK, sums.n // BLOCK_RUNS))
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_RUNS)).cast("int")
    of_lead = lead.groupBy("lead").agg(parts.alias("parts"))
    block = F.when(F.col("parts") > 1, F.xxhash64("lead", F.pmod(F.xxhash64("c8"), F.col("parts")))) \
        .otherwise(F.pmod(F.xxhash64("lead"), F.lit(few)))
    placed = materialise(shared.join(lead.join(of_lead, "lead").select("c8", block.alias("block")), "c8")
                         .select("key", "c8", "block"), "placed")
    of_key = placed.select("key", F.col("block").alias("other")).distinct()
    pairs = placed.join(of_key, "key").select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "c8", "block")
    out = materialise(pairs.distinct(), "block-members")
    drop_tables(crowded, shared, lead, placed)
    return out


def _pairs(t: pd.DataFrame, lo, hi, width: int, least: list[int], threshold: float):
    """Linked rows ``(a, b, similarity)`` of a block pair: every two rows (of the two blocks, or
    of the one) that share a band, are not pruned, and whose sets are similar enough."""
    sig = np.frombuffer(b"".join(t["sig"]), np.uint32).reshape(len(t), HASHES)
    bands = np.ascontiguousarray(sig).view(np.dtype((np.void, width))).reshape(len(t), -1)
    bands = np.stack([np.unique(bands[:, i], return_inverse=True)[1] for i in range(bands.shape[1])], axis=1)
    sets = [np.frombuffer(g, np.uint64) for g in t["grams"]]
    n = t["n"].to_numpy()
    _, runs = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    block = t["block"].to_numpy()
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    mark = np.zeros(len(runs), bool)
    for a in left:
        b = right[right > a] if lo == hi else right
        b = b[(bands[b] == bands[a]).any(axis=1) & (np.minimum(n[b], n[a]) >= threshold * np.maximum(n[b], n[a]) - 1e-9)]
        matches = np.zeros(len(b), np.int64)
        for i, m in enumerate(least):
            if not len(b):
                break
            part = slice(i * ROUND, (i + 1) * ROUND)
            matches = matches + (sig[b, part] == sig[a, part]).sum(axis=1)
            b, matches = b[matches >= m], matches[matches >= m]
        if not len(b):
            continue
        mark[runs[edge[a]:edge[a + 1]]] = True
        both = np.array([np.count_nonzero(mark[runs[edge[x]:edge[x + 1]]]) for x in b])
        mark[runs[edge[a]:edge[a + 1]]] = False
        j = both / (n[a] + n[b] - both)
        ok = j >= threshold
        yield a, b[ok], j[ok]


def _join(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, k: int, threshold: float,
          tolerance: float, pairs: bool) -> DataFrame:
    """Run every block pair. ``pairs``: the links ``a, b, jaccard`` between class ids; else, per
    class and block pair, ``rep, links`` (documents linked there) and ``root`` (the smallest id
    that these links reach)."""
    classes = classes.filter("rep IS NOT NULL").withColumn("c8", F.xxhash64("cls"))
    members = _blocks(classes.select("c8", "n", "sig"))
    wanted = members.select("c8").distinct().join(classes, "c8")
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("rep").alias("h")), "h"))

    def build(batches):
        """Sets of the documents which the bitmap lets through; the join on the class's name
        sorts out what is not asked for."""
        for b in batches:
            ok = marked(held.value, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            for s in K.slices(b.column(1).filter(pa.array(ok))):
                got = [x for x in _sets(s, k) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in got], pa.binary()),
                                                  pa.array([x.tobytes() for x in got], pa.binary())], names=["cls", "grams"])

    texts = docs.select(F.xxhash64(id_col).alias("h"), F.col(text_col).cast("string").alias("t"))
    sets = map_arrow_frugal(texts, build, "cls binary, grams binary").dropDuplicates(["cls"])  # rows may repeat an id
    full = materialise(wanted.join(sets, "cls"), "class-sets")
    rows = members.join(full, "c8").select("lo", "hi", "block", "rep", "copies", "n", "sig", "grams")
    least, width = least_matches(threshold, tolerance), 4 * ROWS
    kind = classes.schema["rep"].dataType.simpleString()

    def run(key, t):
        hand_back()  # of the group before
        t = t.sort_values("rep", ignore_index=True)
        rep, copies = t["rep"].to_numpy(), t["copies"].to_numpy()
        found = list(_pairs(t, key[0], key[1], width, least, threshold))
        if pairs:
            out = [(rep[a], rep[x], y) for a, b, j in found for x, y in zip(b, j)]
            return pd.DataFrame(out, columns=["a", "b", "jaccard"])
        links, root = np.zeros(len(t), np.int64), np.arange(len(t))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x
        for a, b, _ in found:
            links[a] += copies[b].sum()
            links[b] += copies[a]
            for x in b:
                p, q = find(a), find(x)
                root[max(p, q)] = min(p, q)  # rows are in order of their id
        seen = np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[seen], "links": links[seen], "root": rep[[find(x) for x in seen]]})

    ship_package(docs.sparkSession)
    schema = f"a {kind}, b {kind}, jaccard double" if pairs else f"rep {kind}, links long, root {kind}"
    out = rows.groupBy("lo", "hi").applyInPandas(run, schema)
    out.reads = (members, full)
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and one row per distinct set: ``cls, rep, copies, n, sig``."""
    seen = sketches(docs, id_col, text_col, k)
    if among is not None:
        seen = seen.join(among.select(F.col(among.columns[0]).alias("doc")), "doc", "left_semi")
    seen = materialise(seen, "sketches")
    classes = seen.filter("cls IS NOT NULL").groupBy("cls").agg(
        F.min("doc").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialise(classes, "classes")
    rows = materialise(seen.select("doc", "n", "cls"), "document-classes")
    drop_tables(seen)  # the sketches go on with the classes
    return rows, classes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                    threshold: float = THRESHOLD, tolerance: float = TOLERANCE, among: DataFrame | None = None) -> DataFrame:
    """One row per input row: ``doc``, ``class_id`` (smallest id with the same set of runs),
    ``n_links`` (other documents linked, its class's others included), ``component_id``
    (smallest id reachable by links) and ``kept`` (``doc = component_id``).

    Null texts, texts without words and sets that only rows without an id have link with
    nothing but their copies; texts without words are kept; rows that repeat an id are the same
    document; other columns are not read. With ``among``: only rows whose id is in its first
    column take part.
    """
    seen, classes = _classes(docs, id_col, text_col, k, among)
    links = _join(docs, classes, id_col, text_col, k, threshold, tolerance, pairs=False)
    seen_links = materialise(links, "links")
    drop_tables(*links.reads)
    degree = seen_links.groupBy("rep").agg(F.sum("links").alias("linked"))
    roots = components(seen_links, "rep", "root").withColumnRenamed("node", "rep")
    info = (classes.select("cls", "rep", "copies").join(degree, "rep", "left").join(roots, "rep", "left")
            .select("cls", "rep", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"),
                    F.coalesce("component", "rep").alias("root")))
    out = seen.select("doc", "n", "cls").join(info, "cls", "left").select(
        "doc", F.coalesce("rep", "doc").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "doc").alias("component_id"))
    return out.withColumn("kept", F.col("doc").eqNullSafe(F.col("component_id")))


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                  threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The links themselves, ``a, b, jaccard`` between class ids: as many rows as there are links
    between different sets. ``near_duplicates`` counts them without writing them out."""
    _, classes = _classes(docs, id_col, text_col, k)
    return _join(docs, classes, id_col, text_col, k, threshold, tolerance, pairs=True)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that another, kept one stands for; columns as they were."""
    judged = near_duplicates(docs, id_col, text_col)
    gone = judged.filter(~F.col("kept")).select(F.col("doc").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
