"""Connected components of an edge table with DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    Alternates large-star and small-star steps: each node hands the smallest neighbour it knows to its other
    neighbours. The number of rounds grows with the logarithm of a component's size. A node with very many neighbours
    is no bottleneck: minima are aggregated before the shuffle, and the joins that hand them out have no more rows than
    there are edges and are split by adaptive execution where a node is hot. Every round is written to the shared
    scratch folder; the driver sees two sums a round. Nulls and loops are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(MAX_ROUNDS):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the join's sides are plain exchanges, which adaptive execution can split where a node is hot
        first = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(first, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        done, e = (e, large, low), stored(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "edges")
        dropped(*done, first)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
