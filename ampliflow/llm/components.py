"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliflow.llm.common import materialize
from ampliflow.operators.staging import join_group


def _least(edges: DataFrame) -> DataFrame:
    """(u, v) with the least of u and its neighbours. The edges of a hub are dealt out."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")).select("u", F.least("u", "m").alias("m"), "size")
    return join_group(edges, materialize(least, "least"), ["u"]).drop("size")


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of these."""
    found = _least(edges)
    own = found.select("u", F.col("m").alias("v"))
    others = found.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(others)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of all nodes with an edge: the least node that can be reached.

    ``edges`` has long columns u and v; loops and repeated edges do no harm. Each round is written to the shared folder.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = materialize(edges, name)
    before = None
    while True:
        seen = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        state = materialize(large_star(state).distinct(), name)
        state = materialize(small_star(state).distinct(), name)
    members = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component")).distinct()
