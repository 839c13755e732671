"""Write-once run snapshots with a current pointer, and file exports."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webestate.operators import publish
from webestate.session import materialise

POINTER = "current"


def write_snapshot(frames: dict[str, DataFrame], root: str, run_id: str, overwrite: bool = False) -> None:
    """Write each table of a run below its own run partition; the pointer moves last.

    An existing run is refused unless ``overwrite`` is set. The pointer is an
    append-only table whose newest row counts, so readers see the old run or the
    new one and never a half-written state.
    """
    spark = next(iter(frames.values())).sparkSession
    if not overwrite:
        for name in frames:
            if _exists(spark, f"{root}/{name}/run_id={run_id}"):
                raise FileExistsError(f"run {run_id} exists in {root}/{name}")
    for name, df in frames.items():
        body = df.drop("run_id") if "run_id" in df.columns else df
        body.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{root}/{name}/run_id={run_id}")
    switch = spark.createDataFrame([(run_id, time.time_ns())], "run_id string, switched_at bigint")
    switch.coalesce(1).write.mode("append").parquet(f"{root}/{POINTER}")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def current_run(spark: SparkSession, root: str) -> str:
    try:
        pointer = spark.read.schema("run_id string, switched_at bigint").parquet(f"{root}/{POINTER}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no current run in {root}") from e
        raise
    row = pointer.agg(F.max_by("run_id", "switched_at").alias("run_id")).first()
    if row is None or row["run_id"] is None:
        raise FileNotFoundError(f"no current run in {root}")
    return row["run_id"]


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current run. Only its folder is read, and the run id stays the text it is."""
    run_id = current_run(spark, root)
    return spark.read.parquet(f"{root}/{name}/run_id={run_id}").withColumn("run_id", F.lit(run_id))


def known_portal_ids(spark: SparkSession, root: str, name: str = "portals") -> tuple[DataFrame | None, bool]:
    """Distinct portal ids of the current run, and whether an inventory is available at all."""
    try:
        return read_current(spark, root, name).select("portal_id").distinct(), True
    except FileNotFoundError:
        return None, False


def export_csv(assessments: DataFrame, path: str) -> None:
    """20-column CSV with CRLF ends. Line breaks inside cells become blanks."""
    rows = publish.csv_rows(assessments)
    flat = rows.select(*(F.regexp_replace(c, r"[\r\n]+", " ").alias(c) for c in rows.columns))
    flat.write.option("header", True).option("lineSep", "\r\n").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def export_json(summary: DataFrame, assessments: DataFrame, findings: DataFrame, path: str) -> None:
    """Summary, portals and findings as three JSON datasets; ``portal_id`` ties findings to their portal."""
    summary.write.json(f"{path}/summary")
    assessments.write.json(f"{path}/portals")
    findings.write.json(f"{path}/findings")


#: JSON characters of findings that one row of a nested export holds.
NESTED_CHARS = 1 << 20


def nested_parts(findings: DataFrame, most: int = NESTED_CHARS) -> DataFrame:
    """``portal_id, part, findings``: each portal's findings as arrays of at most ``most`` JSON characters, a longer finding alone in one.

    Parts are numbered from 0 within a portal. Findings are dealt into groups of about sixteen parts by a hash first, from counts per portal; a
    running length then cuts each group. So no task sorts or holds more of a portal than one group.
    """
    item = F.struct(*[F.col(c) for c in findings.columns if c != "portal_id"])
    sized = findings.select("portal_id", item.alias("finding"), (F.length(F.to_json(item)) + 1).alias("chars"), F.xxhash64(item).alias("hash"))
    groups = sized.groupBy("portal_id").agg(F.ceil(F.sum("chars") / (16 * most)).alias("groups"))
    dealt = sized.join(groups, "portal_id").withColumn("group", F.pmod("hash", "groups"))
    # First fit in order: a part ends where the next finding would pass the limit; two halves of a limit never share a part.
    order = Window.partitionBy("portal_id", "group").orderBy("hash", "finding").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = dealt.withColumn("end", F.sum("chars").over(order)).withColumn("slot", F.floor((F.col("end") - 1) / F.lit(most // 2)))
    cut = cut.withColumn("long", F.when(F.col("chars") > most // 2, F.col("hash")))
    packs = cut.groupBy("portal_id", "group", "slot", "long").agg(F.array_sort(F.collect_list("finding")).alias("findings"))
    number = Window.partitionBy("portal_id").orderBy("group", "slot", "long")
    return packs.select("portal_id", (F.row_number().over(number) - 1).alias("part"), "findings")


def export_nested(summary: DataFrame, assessments: DataFrame, findings: DataFrame, path: str, most: int = NESTED_CHARS) -> None:
    """The nested document ``{summary, portals[]}`` as JSON lines: ``summary``, one object per portal in ``portals`` with its first
    ``findings`` and ``more_parts``, and further ``{portal_id, part, findings}`` rows in ``parts`` for portals whose findings pass ``most`` characters.
    """
    packs = materialise(nested_parts(findings, most), "parts")
    first = packs.groupBy("portal_id").agg(F.max("part").alias("more_parts"))
    inner = packs.where("part = 0").select("portal_id", "findings").join(first, "portal_id")
    kind = packs.schema["findings"].dataType
    portals = assessments.join(inner, "portal_id", "left").withColumns({
        "findings": F.coalesce("findings", F.array().cast(kind)), "more_parts": F.coalesce("more_parts", F.lit(0))})
    summary.write.json(f"{path}/summary")
    portals.write.json(f"{path}/portals")
    packs.where("part > 0").write.json(f"{path}/parts")
