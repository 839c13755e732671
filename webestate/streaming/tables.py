"""Keyed tables that a stream keeps current: rows in a fixed number of buckets, two copies of each, and a committed version.

A batch rewrites the buckets it touches into their other copy and then commits a manifest, one small file that names the
copy of every bucket that counts. So storage is at most twice the table, whatever the number of batches. Manifests alternate
between two places: a batch that runs again after a failure starts from the version before it and gives the same result, and readers
always see one whole version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "epoch bigint, bucket int, copy int"
BUCKETS = 16


def _version(spark: SparkSession, path: str, before: int | None = None) -> tuple[int | None, int, dict[int, int]]:
    """Epoch, place and copies of the newest manifest, or of the newest one before an epoch."""
    newest: tuple[int | None, int, dict[int, int]] = (None, 1, {})
    for place in (0, 1):
        try:
            rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/place={place}").collect()  # one row per bucket
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if rows and (before is None or rows[0]["epoch"] < before) and (newest[0] is None or rows[0]["epoch"] > newest[0]):
            newest = rows[0]["epoch"], place, {r["bucket"]: r["copy"] for r in rows}
    return newest


def _read(spark: SparkSession, path: str, schema: StructType | str, copies: dict[int, int]) -> DataFrame:
    if not copies:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/rows/copy={c}/bucket={b}" for b, c in sorted(copies.items())])


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The committed rows."""
    return _read(spark, path, schema, _version(spark, path)[2])


def merge_into(batch: DataFrame, path: str, epoch: int, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Merge a batch into a table by ``merge(stored, batch)``, for the buckets of its keys only.

    ``merge`` has the columns of ``batch`` and keeps every key of the batch. The number of buckets of a table must not change.
    """
    spark = batch.sparkSession
    _, place, copies = _version(spark, path, before=epoch)
    dealt = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
    try:
        touched = [r[0] for r in dealt.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        stored = _read(spark, path, batch.schema, {b: copies[b] for b in touched if b in copies})
        target = {b: 1 - copies.get(b, 1) for b in touched}
        rows = merge(stored, dealt.drop("_bucket")).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        to = F.element_at(F.create_map(*[F.lit(x) for b, c in target.items() for x in (b, c)]), F.col("bucket"))
        (rows.withColumn("copy", to).repartition("copy", "bucket").write.partitionBy("copy", "bucket").mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").parquet(f"{path}/rows"))
        manifest = spark.createDataFrame([(epoch, b, c) for b, c in {**copies, **target}.items()], MANIFEST)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/place={1 - place}")
    finally:
        dealt.unpersist()


def upsert(batch: DataFrame, path: str, epoch: int, keys: list[str], buckets: int = BUCKETS) -> None:
    """Rows of the batch replace stored rows of equal keys."""
    merge_into(batch, path, epoch, keys, lambda stored, new: new.unionByName(stored.join(new.select(*keys), keys, "left_anti")), buckets)
