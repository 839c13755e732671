"""JSONL record scans and sidecar files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webestate.operators.quality import record_violations
from webestate.schemas import ddl


def read_records(spark: SparkSession, path: str, entity: str, mode: str = "strict") -> DataFrame:
    """Typed records of a JSONL path; blank lines are ignored, a missing path is an empty set.

    An unparsable line stops the job in both modes. A record that breaks its
    constraints stops it in strict mode and is dropped in lenient mode. The test
    runs in the scan itself, so strictness costs no second pass.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"unknown mode {mode}")
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], ddl(entity))
        raise
    judged = lines.filter(F.trim("value") != "").withColumn("bad", record_violations(entity))
    if mode == "lenient":
        good = judged.filter(F.size("bad") == 0)
    else:
        message = F.concat(F.lit(f"invalid {entity} record: "), F.array_join("bad", ", "))
        good = judged.filter(F.when(F.size("bad") == 0, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    return good.select(F.from_json("value", ddl(entity)).alias("r")).select("r.*")


def read_sidecars(spark: SparkSession, path: str, entity: str, key: str) -> tuple[DataFrame, DataFrame]:
    """One JSON record per file, named after its id: records, and (file, file_key, parse_error) rows."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            none = spark.createDataFrame([], ddl(entity))
            return none, spark.createDataFrame([], "file string, file_key string, parse_error string")
        raise
    return judge_sidecars(files.select("value", F.col("_metadata.file_name").alias("file")), entity, key)


def judge_sidecars(files: DataFrame, entity: str, key: str) -> tuple[DataFrame, DataFrame]:
    named = files.withColumn("file_key", F.regexp_replace("file", r"\.json$", ""))
    parsed = named.withColumn("ok", F.try_parse_json("value").isNotNull())
    bad = F.when(~F.col("ok"), F.array(F.lit("not valid JSON"))).otherwise(record_violations(entity, "if(ok, value, '{}')"))
    inner = F.get_json_object("value", f"$.{key}")
    judged = parsed.withColumn("bad", bad).withColumn("error", F.when(F.size("bad") > 0, F.array_join("bad", ", ")).when(
        inner != F.col("file_key"), F.concat(F.lit("file name does not match "), F.lit(key))))
    records = judged.filter("error IS NULL").select(F.from_json("value", ddl(entity)).alias("r")).select("r.*")
    return records, judged.filter("error IS NOT NULL").select("file", "file_key", F.col("error").alias("parse_error"))
