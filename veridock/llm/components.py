"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, component) for every node on an edge of edges(a, b), two columns of one orderable type.

    component is the smallest node that is reachable. Only minima per node are grouped (combined on the map side),
    and each join reads two checkpoints, so adaptive execution may split a node with very many neighbours.
    Each round is checkpointed; the number of rounds grows with the logarithm of the longest chain.
    Nulls and loops are ignored; no edges give no rows.

    After most_rounds, if given, it stops early: equal components are connected then, but connected nodes may still have different ones.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen, rounds = _state(e), 0
    while seen[0] and rounds != most_rounds:
        rounds += 1
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        e = cut(e)
        least = cut(e.groupBy("hi").agg(F.min("lo").alias("m")))
        small = e.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        e = cut(small.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct())
        if rounds == most_rounds:
            return cut(e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")))
        now = _state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
