"""Mixing sources to target weights by systematic sampling of whole documents.

Every document of a source has the same expected number of copies, target / source size. Documents are ranked inside
their source by size class, the expected copies are prefix-summed along that rank, one pseudo-random offset per source
is added, and a document is emitted once per integer boundary that its step crosses. Since neighbours in rank have about
the same size, the words taken miss the target by about one document.

The prefix sum is made in three steps, so no task holds a source: counts per (source, size class), counts per (source,
size class, block of ids), and a row number inside one such block.

Cases: a null text has size 0; a null source is a source of its own, last in order; a source without words has target 0;
an empty table gives an empty result. Equal rows are separate documents. Equal input gives equal output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webestate.llm.common import WORD, wrapped
from webestate.session import materialise

BLOCKS = 1021


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    In order of cap / weight the capped sources come first, and the level that the rest shares is the largest of
    (what earlier caps leave) / (weight that is left).
    """
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("place") % len(weights) + 1)
    placed = (sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
              .withColumn("weight", cycle.cast("long")).withColumn("most", F.col("source_size") * cap))
    every = Window.orderBy((F.col("most") / F.col("weight")), "place")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = placed.withColumn("level", left.cast("double") / share.cast("double"))
    level = F.max("level").over(whole)
    return levels.select("source", "source_size", F.least(F.col("most").cast("double"), level * F.col("weight").cast("double")).alias("target"))


def _ranked(docs: DataFrame, sized: DataFrame, weights: Sequence[int], cap: int, seed: str) -> DataFrame:
    """``docs`` (any columns, with ``_source _size _id``) and ``_copies _source_size _target``; ``sized`` holds the same three columns."""
    def classed(df: DataFrame) -> DataFrame:
        bits = F.length(F.bin("_size"))
        return (df.withColumn("_bits", bits).withColumn("_class", F.expr("_bits * 32 + shiftright(shiftleft(_size, 4), _bits - 1)"))
                .withColumn("_block", F.coalesce(F.pmod("_id", F.lit(BLOCKS)), F.lit(-1))).drop("_bits"))

    blocks = classed(sized).groupBy("_source", "_class", "_block").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("words"))
    classes = blocks.groupBy("_source", "_class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    ahead = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("_source", "_class", F.coalesce(F.sum("n").over(ahead("_source").orderBy("_class")), F.lit(0)).alias("class_at"))
    targets = source_targets(
        blocks.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size")), weights, cap)
    targets = targets.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    places = (blocks.select("_source", "_class", "_block", F.coalesce(F.sum("n").over(ahead("_source", "_class").orderBy("_block")), F.lit(0)).alias("block_at"))
              .join(classes.withColumnsRenamed({"_source": "_s2", "_class": "_c2"}), F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("_class") == F.col("_c2")))
              .join(targets, F.col("_source").eqNullSafe(F.col("_s")))
              .select(F.col("_source").alias("_s3"), F.col("_class").alias("_c3"), F.col("_block").alias("_b3"),
                      (F.col("class_at") + F.col("block_at")).alias("_at"), "_source_size", "_target"))
    inside = Window.partitionBy("_source", "_class", "_block").orderBy("_size", "_id")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("_source", F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size").cast("double")).otherwise(0.0)
    return (classed(docs).withColumn("_nth", F.row_number().over(inside))
            .join(places, F.col("_source").eqNullSafe(F.col("_s3")) & (F.col("_class") == F.col("_c3")) & (F.col("_block") == F.col("_b3")))
            .withColumn("_nth", F.col("_nth") + F.col("_at"))
            .withColumn("_rate", rate).withColumn("_offset", offset)
            .withColumn("_copies", F.least(F.lit(cap).cast("long"), F.floor(F.col("_rate") * F.col("_nth").cast("double") + F.col("_offset"))
                                           - F.floor(F.col("_rate") * (F.col("_nth") - 1).cast("double") + F.col("_offset")))))


def mix_digest(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` and ``source, copies``. Texts are read once."""
    sized = materialise(docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), text_size(F.col("text")).alias("_size")), "mix-sizes")
    return _ranked(sized, sized, weights, cap, seed).select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as it is taken. A row without words is taken by the same rule."""
    sized = docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), text_size(F.col("text")).alias("_size"))
    rows = wrapped(docs, "doc_id", "source", "text").select("_row", F.col("doc_id").alias("_id"), F.col("source").alias("_source"), text_size(F.col("text")).alias("_size"))
    taken = _ranked(rows, sized, weights, cap, seed).where(F.col("_copies") > 0)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")
