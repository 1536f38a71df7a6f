"""Connected components of an edge table by hooking in a random order and contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored

DEEP = 6


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); the component is its smallest node.

    Each level orders nodes anew by a hash, points every node at the first of itself and its neighbours and from there
    one step on, and keeps the edges between different targets.  In a random order a fixed share of the nodes is nobody's
    target, so levels are few whatever the shape, long chains of rising numbers too.  Levels are written tables: no
    lineage grows, and a hub with very many edges is one aggregate with a partial result on each side.  Null or equal
    ends are no edges."""
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    whole = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node"))
    level = 0
    while not left.isEmpty():

        def place(c: str) -> Column:
            return F.struct(F.xxhash64(c, F.lit(level)).alias("h"), F.col(c).alias("v"))  # noqa: B023

        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.min(place("b")).alias("m")).select(F.col("a").alias("node"), F.least(place("a"), F.col("m"))["v"].alias("to")), "steps")
        on = step.select(F.col("node").alias("to"), F.col("to").alias("top"))
        top = stored(step.join(on, "to").select("node", "top"), "level")
        ends = [top.select(F.col("node").alias(c), F.col("top").alias(f"p{c}")) for c in "ab"]
        moved = left.join(ends[0], "a").join(ends[1], "b").where("pa <> pb")
        left = stored(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        whole = whole.join(top.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        level += 1
        if level % DEEP == 0:
            whole = stored(whole, "labels")
    whole = stored(whole, "labels")
    least = whole.groupBy("component").agg(F.min("node").alias("least"))
    return whole.join(least, "component").select("node", F.col("least").alias("component"))
