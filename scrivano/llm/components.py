"""Connected components by alternating large-star and small-star steps, all distributed.

Edges are (u, v) longs. Every step writes its edges to the shared folder, so lineage stays short and executors may be lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large) or smaller neighbours to the least node of its neighbourhood."""
    if large:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of every node that has an edge."""
    now = materialize(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    before = _mark(now)
    while before[0]:
        now = materialize(_stars(_stars(now, True), False), "stars")
        after = _mark(now)
        if after == before:
            break
        before = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
