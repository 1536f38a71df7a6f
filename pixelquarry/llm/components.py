"""Connected components of an edge table by repeated hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); the component is its smallest node.

    Each level points every node at its smallest neighbour and keeps the edges between different targets; every node
    that has an edge left takes part, so levels are few.  Levels are written tables: no lineage grows, and a hub with
    very many edges is one aggregate with a partial sum on each side.  Null or equal ends are no edges."""
    left = edges.where("a <> b").select("a", "b")
    levels: list[DataFrame] = []
    while not levels or not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent")), "level")
        levels.append(parent)
        pa, pb = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        left = left.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        left = stored(left, "edges")
    whole = levels[0].select("node", F.col("parent").alias("component"))
    for parent in levels[1:]:
        step = parent.select(F.col("node").alias("component"), "parent")
        whole = whole.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
    return stored(whole, "labels") if levels[1:] else whole
