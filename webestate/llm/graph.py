"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webestate.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``links`` (``a, b``); the component is its smallest id.

    Every id hooks to its smallest smaller neighbour, chains of hooks are halved until they end in roots, links are
    rewritten to roots and the rest goes on; a star takes one round. Each step is a written table, so lineage stays
    short, and only counts reach the driver. Null ends and self-links are ignored.
    """
    def roots(hooks: DataFrame) -> DataFrame:
        while True:
            up = hooks.select(F.col("id").alias("u"), F.col("to").alias("top"))
            jumped = hooks.join(up, F.col("to") == F.col("u"), "left")
            hooks = materialise(jumped.select("id", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved")), "roots")
            if hooks.where("moved").isEmpty():
                return hooks.select("id", "to")

    pairs = links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    pairs = materialise(pairs, "links")
    known = None
    while not pairs.isEmpty():
        hooks = roots(materialise(pairs.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("to")), "hooks"))
        low, high = (hooks.select(F.col("id").alias(k), F.col("to").alias(v)) for k, v in (("i1", "lo_root"), ("i2", "hi_root")))
        pairs = (pairs.join(low, F.col("lo") == F.col("i1"), "left").join(high, F.col("hi") == F.col("i2"), "left")
                 .select(F.coalesce("lo_root", "lo").alias("x"), F.coalesce("hi_root", "hi").alias("y")).where("x <> y")
                 .select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct())
        pairs = materialise(pairs, "links")
        if known is None:
            known = hooks
        else:  # earlier roots that now hang below another root
            moved = hooks.select(F.col("id").alias("u"), F.col("to").alias("top"))
            known = materialise(known.join(moved, F.col("to") == F.col("u"), "left").select("id", F.coalesce("top", "to").alias("to")).unionByName(hooks), "known")
    if known is None:
        return pairs.select(F.col("lo").alias("id"), F.col("hi").alias("component"))
    tops = known.select(F.col("to").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return known.select("id", F.col("to").alias("component")).unionByName(tops)
