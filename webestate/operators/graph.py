"""Connected components of large graphs by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webestate.session import materialise


def _with_least(edges: DataFrame) -> DataFrame:
    """``u, v, m``: each edge with the least neighbour of ``u``, itself included.

    The least neighbour is found with partial aggregates; the edges of a node with very many are split by adaptive execution.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u").select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges`` (``a``, ``b`` of one type); a component is its least node.

    Large stars link the larger neighbours of a node to its least one, small stars the smaller neighbours and the node
    itself; a few rounds of both leave one star for each component. Every round is a written table.
    """
    pairs = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        pairs = materialise(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        state = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
