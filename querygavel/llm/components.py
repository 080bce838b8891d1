"""Connected components of a table of edges, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygavel.llm.common import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's larger (or not larger) neighbours to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = (
            tied.where("v < u")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        )
    return out.where("a != b").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component: the least node that each node of an edge can reach. ``edges`` has bigint columns a and b.

    Each round ends in a table of the shared folder; the next starts from there. Nodes without edges have no row.
    """
    current = scratch.table(edges.where("a != b").select("a", "b").distinct(), "edges")
    known = None
    while True:
        following = scratch.table(_stars(_stars(current, large=True), large=False), "edges")
        found = following.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum("b")).first()
        scratch.drop(current)
        current = following
        if found == known or found[0] == 0:
            break
        known = found
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
