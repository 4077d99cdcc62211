"""Connected components over an edge table, with DataFrame operations only.

Alternating stars: every node hooks its larger neighbours to the smallest node it can see,
then its smaller ones. The minima are partial aggregates and come back by an equi-join, so
that a node with very many edges is split like any skewed join key. Each round is written
to the shared folder; the number of rounds grows with the logarithm of the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentflow.llm.store import drop, materialise


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
            .union(low.select("u", "m")).distinct())


def _mark(e: DataFrame):
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of an edge; loops,
    repeated edges and edges with a null end are ignored."""
    spark = edges.sparkSession
    e = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        after = materialise(_small(_large(e)), "edges")
        new = _mark(after)
        drop(spark, e.stored_at)
        e = after
        if new == mark:
            break
        mark = new
    # every edge now leads from a node to the root of its star
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
