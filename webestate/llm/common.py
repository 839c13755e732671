"""Shared pieces of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every operator here: runs of anything but ASCII white space. ``bytes.split()`` splits alike.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the caller's statement of how far to spread the work."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def wide_hash(*cols: Column | str) -> list[Column]:
    """128 bits as two longs with different seeds; equal content gives equal pairs."""
    return [F.xxhash64(F.lit(17), *cols), F.xxhash64(F.lit(91), *cols)]


def wrapped(docs: DataFrame, *names: str) -> DataFrame:
    """Whole rows as ``_row`` beside the columns ``names``, so that no other column of ``docs`` can clash with one that an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *names)
