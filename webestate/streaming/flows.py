"""The submission flow and incremental analysis as Structured Streaming jobs.

Earlier rows that a step needs are engine state (admission, duplicates, running aggregates) or keyed tables of bounded
size with a committed version (:mod:`webestate.streaming.tables`). A batch that runs again after a failure gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from webestate.functions import checks
from webestate.operators import experience as ex
from webestate.operators.rules import RuleContext, run_rules
from webestate.operators.rules.base import address_partials, entry_partials, merged_addresses, merged_entry, select_rules, skip_facts
from webestate.streaming import tables


def run_available(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Process all input there is now, then stop."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def read_epochs(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/epoch=*")


def _write(df: DataFrame, path: str, epoch: int) -> DataFrame:
    target = f"{path}/epoch={epoch}"
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def admission(requests: DataFrame, out: str, lateness: str = "30 days") -> DataStreamWriter:
    """Admission control with keyed state: the accepted requests of the last day, at most five per key.

    Rows of a key are decided in time order inside a batch. A row older than what its key has already seen in an earlier
    batch can no longer be decided like a clock would have; it is not admitted and marked ``late``. The watermark ends
    the state of a key a day after its last request; rows that are later than ``lateness`` are counted and dropped by
    the engine.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["t", "request_id"], kind="stable")
        times, portals, seen = state.get if state.exists else ([], [], None)
        late = rows["t"].to_numpy() < seen if seen is not None else np.zeros(len(rows), dtype=bool)
        names, t = rows["portal_id"].astype(str).to_numpy(dtype=object), rows["t"].to_numpy()
        accepted = list(zip(times, portals, strict=True))
        ok = np.zeros(len(rows), dtype=bool)
        ok[~late] = ex.walk(t[~late], names[~late], accepted)
        newest = max(int(t[-1]), seen if seen is not None else int(t[-1]))
        state.update(([a for a, _ in accepted], [p for _, p in accepted], newest))
        state.setTimeoutTimestamp(max(newest // 1000 + ex.DAY // 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[["request_id", "portal_id"]].assign(key=key[0], accepted=ok, late=late)[["request_id", "key", "portal_id", "accepted", "late"]]

    timed = requests.select("request_id", "key", "portal_id", F.col("created_at").cast("timestamp").alias("at"), ex.seconds("created_at").alias("t")).withWatermark("at", lateness)
    decided = timed.groupBy("key").applyInPandasWithState(
        step, f"request_id {kinds['request_id']}, key {kinds['key']}, portal_id {kinds['portal_id']}, accepted boolean, late boolean",
        "times array<bigint>, portals array<string>, seen bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return decided.writeStream.format("parquet").option("path", out).outputMode("append")


WIDTH = ex.DUPLICATE_MINUTES * 60 * 1_000_000
#: Time that one group of candidates spans.
SPAN = 6 * WIDTH
#: Times of a key that answer whether there was an event in the minutes before any moment.
ACTIVITY_STATE = "times array<bigint>, newest bigint"


def _sorted_rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["t", "submission_id"], kind="stable")


def _sparse(times: np.ndarray) -> np.ndarray:
    """Sorted times without those between two that are at most ``WIDTH`` apart: for any moment, the same answer, from at most two a ``WIDTH``."""
    kept: list[int] = []
    for t in times.tolist():
        if len(kept) > 1 and t - kept[-2] <= WIDTH:
            kept[-1] = t
        else:
            kept.append(t)
    return np.asarray(kept, dtype=np.int64)


def _expire(state: GroupState, newest: int) -> None:
    state.setTimeoutTimestamp(max((newest + WIDTH) // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def activity_gate(requests: DataFrame, out: str, lateness: str = "1 day") -> DataStreamWriter:
    """Requests with ``active``: whether their key had an earlier event on their portal in the ten minutes before.

    State per (key, portal): the times that the watermark can still need, thinned out to a few for each ten minutes. A request that
    comes after a later one of its key and portal was decided is decided by what is known, and marked ``late``: earlier answers
    did not know of it. Requests behind the watermark are dropped by the engine and counted in its progress.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    columns = [c for c in requests.columns if c not in ("key", "portal_id")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _sorted_rows(frames)
        t = rows["t"].to_numpy()
        known, newest = state.get if state.exists else ([], None)
        times = np.unique(np.concatenate((np.asarray(known, dtype=np.int64), t)))
        before = np.searchsorted(times, t) - 1
        active = (before >= 0) & (t - times[np.maximum(before, 0)] <= WIDTH)
        late = t < newest if newest is not None else np.zeros(len(t), dtype=bool)
        needed = times[times >= state.getCurrentWatermarkMs() * 1000 - WIDTH]
        newest = max(int(t[-1]), newest if newest is not None else int(t[-1]))
        state.update((_sparse(needed).tolist(), newest))
        _expire(state, newest)
        yield rows[columns].assign(key=key[0], portal_id=key[1], active=active, late=late)[[*columns, "key", "portal_id", "active", "late"]]

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in columns), f"key {kinds['key']}", f"portal_id {kinds['portal_id']}", "active boolean", "late boolean"])
    timed = requests.select("*", F.col("created_at").cast("timestamp").alias("at"), ex.seconds("created_at").alias("t")).withWatermark("at", lateness)
    decided = timed.groupBy("key", "portal_id").applyInPandasWithState(step, schema, ACTIVITY_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return decided.writeStream.format("parquet").option("path", out).outputMode("append")


def duplicate_marks(gated: DataFrame, out: str, lateness: str = "1 day") -> DataStreamWriter:
    """``submission_id, duplicate_of, late`` from the rows of :func:`activity_gate`.

    State per (portal, task, outcome, content) and hour: time and id of the usable rows of the hour and of the ten minutes before it that the
    watermark can still need. So what a task holds follows the rows of an hour, not of all time: a row goes to its own hour, and at the edge
    also to the next one as a candidate or to the one before as news. The earliest of the trailing ten minutes is found by binary search.
    ``late``: late in the gate, or a later row of its content, of the same hour or the ten minutes after it, was decided in a batch before.
    """
    kinds = {f.name: f.dataType.simpleString() for f in gated.schema}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _sorted_rows(frames)
        times, ids, newest = state.get if state.exists else ([], [], None)
        usable = rows[rows["usable"] & (rows["hour"] <= key[4])]
        known = pd.DataFrame({"t": np.concatenate((np.asarray(times, dtype=np.int64), usable["t"].to_numpy())),
                              "submission_id": np.concatenate((np.asarray(ids, dtype=usable["submission_id"].dtype), usable["submission_id"].to_numpy()))})
        known = known.drop_duplicates().sort_values(["t", "submission_id"], kind="stable")
        last, rows = int(rows["t"].iloc[-1]), rows[rows["hour"] == key[4]]
        kt, ki, t, own = known["t"].to_numpy(), known["submission_id"].to_numpy(), rows["t"].to_numpy(), rows["submission_id"].to_numpy()
        place = np.searchsorted(kt, t - WIDTH)
        inside = np.minimum(place, max(len(kt) - 1, 0))
        earlier = (place < len(kt)) & rows["active"].to_numpy() if len(kt) else np.zeros(len(t), dtype=bool)
        if len(kt):
            earlier &= (kt[inside] < t) | ((kt[inside] == t) & (ki[inside] < own))
        late = (t < newest if newest is not None else np.zeros(len(t), dtype=bool)) | rows["late"].to_numpy()
        newest = max(last, newest if newest is not None else last)
        needed = known[known["t"] >= state.getCurrentWatermarkMs() * 1000 - WIDTH]
        state.update((needed["t"].tolist(), needed["submission_id"].tolist(), newest))
        _expire(state, newest)
        if len(t):
            found = pd.array([int(ki[i]) if e else None for i, e in zip(inside, earlier, strict=True)], dtype="Int64")
            yield pd.DataFrame({"submission_id": own, "duplicate_of": found, "late": late})

    timed = gated.select(
        "submission_id", "portal_id", "task_type", "outcome", F.sha2("content_key", 256).alias("content"), "active", "late",
        F.coalesce(F.col("status").isin("pending", "approved"), F.lit(False)).alias("usable"),
        F.col("created_at").cast("timestamp").alias("at"), ex.seconds("created_at").alias("t")).withWatermark("at", lateness)
    number, t = kinds["submission_id"], F.col("t")
    hours = F.array_distinct(F.array(*(F.floor(x / SPAN) for x in (t, t - WIDTH, t + WIDTH))))
    dealt = timed.withColumn("hour", F.floor(t / SPAN)).withColumn("group", F.explode(hours))
    decided = dealt.groupBy("portal_id", "task_type", "outcome", "content", "group").applyInPandasWithState(
        step, f"submission_id {number}, duplicate_of {number}, late boolean", f"times array<bigint>, ids array<{number}>, newest bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return decided.writeStream.format("parquet").option("path", out).outputMode("append")


MARKS = "submission_id bigint, duplicate_of bigint, late boolean"


def run_duplicates(requests: DataFrame, out: str, lateness: str = "1 day") -> DataFrame:
    """Both steps over all input there is now: the marks below ``out``. Each step is a query of its own, the second reads what the first wrote.

    Submission ids are whole numbers. A later call with the same ``out`` goes on where the last one ended.
    """
    spark = requests.sparkSession
    gate = activity_gate(requests, f"{out}/gated", lateness)
    run_available(gate, f"{out}/checkpoint-gate")
    schema = StructType([*requests.schema.fields, StructField("active", BooleanType()), StructField("late", BooleanType())])
    gated = spark.readStream.schema(schema).parquet(f"{out}/gated")  # whole batches of the gate: its files are committed together
    run_available(duplicate_marks(gated, f"{out}/marks", lateness), f"{out}/checkpoint-marks")
    return spark.read.schema(MARKS).parquet(f"{out}/marks")


def enriched(submissions: DataFrame, out: str) -> DataStreamWriter:
    """Normalised text and privacy flags: a stateless projection into files."""
    return ex.enrich(submissions).writeStream.format("parquet").option("path", out).outputMode("append")


def append_pending(submissions: DataFrame, portals: DataFrame, out: str) -> DataStreamWriter:
    """Reports about known portals with a pending moderation row each; the others go to rejects."""

    def step(batch: DataFrame, epoch: int) -> None:
        good, bad = ex.split_known_portals(batch, portals)
        kept = _write(good, f"{out}/submissions", epoch)
        none = F.lit(None).cast("string")
        _write(kept.select(
            "submission_id", F.lit("pending").alias("status"), F.lit(None).cast("timestamp_ntz").alias("moderated_at"),
            none.alias("reason_code"), none.alias("public_text")), f"{out}/moderation", epoch)
        _write(bad, f"{out}/rejects", epoch)

    return submissions.writeStream.foreachBatch(step)


def live_summary(visible: DataFrame, out: str) -> DataStreamWriter:
    """Running experience summary: an aggregate in engine state; the rows that a batch changed are merged into a keyed table."""
    when = F.coalesce("occurred_on", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    def held(theme: str) -> Column:
        return F.sum(F.size(F.filter("themes", lambda x: x == theme))).alias(f"theme_{theme}")

    running = visible.groupBy("portal_id").agg(
        F.count("*").alias("experiences"), *(F.count_if(F.col("outcome") == o).alias(o) for o in checks.OUTCOMES),
        F.count("rating").alias("rating_count"), F.round(F.avg("rating"), 2).alias("average_rating"),
        F.min(when).alias("earliest"), F.max(when).alias("latest"), *map(held, checks.THEMES))
    counts = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, checks.THEMES)), F.array(*(F.col(f"theme_{t}") for t in checks.THEMES))), lambda _, n: n > 0)
    running = running.withColumn("theme_counts", counts).drop(*(f"theme_{t}" for t in checks.THEMES)).withColumn(
        "small_sample", F.col("experiences") < ex.DISPLAY_THRESHOLD)

    def step(batch: DataFrame, epoch: int) -> None:
        tables.upsert(batch, out, epoch, ["portal_id"])

    return running.writeStream.outputMode("update").foreachBatch(step)


def _run_folder(run_id: str) -> str:
    return "run_id=" + quote(run_id, safe="")


def _once(made: DataFrame, path: str) -> DataFrame:
    """Rows that an earlier batch wrote to ``path``, else written now; a write that did not end does not count."""
    spark = made.sparkSession
    try:
        done = not spark.read.schema("done boolean").parquet(f"{path}/done").isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        done = False
    if not done:
        made.write.mode("overwrite").parquet(f"{path}/rows")
        spark.range(1).select(F.lit(True).alias("done")).coalesce(1).write.mode("overwrite").parquet(f"{path}/done")
    return spark.read.schema(made.schema).parquet(f"{path}/rows")


def incremental_findings(
    observations: DataFrame, context: Callable[[DataFrame, str], RuleContext], out: str, checks_list: list[dict] | None = None
) -> DataStreamWriter:
    """Findings per run, kept right while parts of a run arrive in any order.

    Each run has keyed tables of partial sums: one row per portal of its entry checks and one per (portal, address). A batch is summed up,
    merged into the tables of the runs it holds, and nothing else is read: observations are stored by run for evidence and not
    looked at again. Findings of table rules and sums of skips do not depend on the batch: with a ``version`` of the context they are made once for it.
    Rules over the profile are evaluated on the merged sums; rules over single checks only on the batch, and their findings are
    kept per batch. Only the names of a batch's runs reach the driver.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        stored = _write(batch, f"{out}/observations", epoch)
        for run_id in sorted(r[0] for r in stored.select("run_id").distinct().collect()):
            folder, ctx = _run_folder(run_id), context(stored.filter(F.col("run_id") == run_id), run_id)
            sums = {"entry": (entry_partials(ctx.entry_rows), ["portal_id"], merged_entry), "addresses": (address_partials(ctx.pages), ["portal_id", "requested_url"], merged_addresses)}
            merged = {}
            for name, (part, keys, merge) in sums.items():
                tables.merge_into(part, f"{out}/{name}/{folder}", epoch, keys[:1], lambda old, new, merge=merge: merge(old.unionByName(new)))
                merged[name] = tables.read_table(spark, f"{out}/{name}/{folder}", part.schema)
            given = None if ctx.version is None else f"{out}/given/{folder}/version={quote(ctx.version, safe='')}"
            skipped = _once(skip_facts(ctx.skips), f"{given}/skips") if given else None
            whole = replace(ctx, stored_entry=merged["entry"], stored_addresses=merged["addresses"], stored_skips=skipped)
            kinds = {r.kind for r, _ in select_rules(checks_list)[0]}
            frames = [run_rules(whole, checks_list, kinds=("portal",))] if "portal" in kinds else []
            if "table" in kinds:
                tabled = run_rules(ctx, checks_list, kinds=("table",))
                frames.append(_once(tabled, f"{given}/findings") if given else tabled)
            if "row" in kinds:
                run_rules(ctx, checks_list, kinds=("row",)).write.mode("overwrite").parquet(f"{out}/row-findings/{folder}/epoch={epoch}")
                frames.append(spark.read.parquet(f"{out}/row-findings/{folder}").drop("epoch"))
            found = reduce(DataFrame.unionByName, frames)
            found.write.mode("overwrite").parquet(f"{out}/findings/{folder}")

    return observations.writeStream.foreachBatch(step)
