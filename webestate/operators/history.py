"""Change over time between dated run snapshots: interval history, changes per run, and as-of lookup.

A run does not look at every portal, so a finding that is missing from a run is resolved only if its portal was looked at.
Runs of a portal are numbered (``visit``); a finding that is absent from one visit and present in a later one is reopened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def visits(coverage: DataFrame, runs: DataFrame, owner: str) -> DataFrame:
    """``run_id, owner, visit, run_at, next_at``: the runs that looked at each portal, in order of time.

    A portal has at most as many rows as there are runs. Runs at the same time are ordered by id.
    """
    order = Window.partitionBy(owner).orderBy("run_at", "run_id")
    return coverage.select("run_id", owner).distinct().join(runs.select("run_id", "run_at"), "run_id").select(
        "run_id", owner, F.row_number().over(order).alias("visit"), "run_at", F.lead("run_at").over(order).alias("next_at"))


def interval_history(states: DataFrame, coverage: DataFrame, runs: DataFrame, owner: str, keys: list[str], values: list[str]) -> DataFrame:
    """Versions of every subject over any number of runs, as SCD2 rows.

    ``states`` has ``run_id, owner, *keys, *values``: what each run found. ``coverage`` has ``run_id, owner``: what each run
    looked at; a state is proof of it too. ``runs`` has ``run_id, run_at``. Result: ``owner, *keys, version, *values,
    valid_from, valid_to, first_run, last_run, n_runs, opened_by`` (appeared, reopened, changed) and ``closed_by``
    (resolved, changed, or null while open, then ``valid_to`` is null too). Of several states of one subject in one run the
    smallest ``values`` count, nulls first. States of unknown runs have no time and are left out.

    Coverage is copied to ``SALTS`` rows, so one portal with most findings is spread over tasks; everything after that join
    is keyed by subject and holds at most one row for each run.
    """
    subject = [owner, *keys]
    salt = F.pmod(F.xxhash64(*subject), F.lit(SALTS))
    seen = coverage.select("run_id", owner).unionByName(states.select("run_id", owner))
    times = visits(seen, runs, owner).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = F.col(f"s.{owner}").eqNullSafe(F.col(f"t.{owner}"))
    dated = (states.select("run_id", *subject, *values, salt.alias("_salt")).alias("s")
             .join(times.alias("t"), (F.col("s.run_id") == F.col("t.run_id")) & (F.col("s._salt") == F.col("t._salt")) & mine)
             .select(*[F.col(f"s.{c}").alias(c) for c in ("run_id", *subject, *values)], "visit", "run_at", "next_at"))
    one = (dated.repartition(*subject).groupBy(*subject, "visit")
           .agg(F.min(F.struct(*values)).alias("value"), F.first("run_id").alias("run_id"), F.first("run_at").alias("run_at"), F.first("next_at").alias("next_at")))
    order = Window.partitionBy(*subject).orderBy("visit")
    gap = F.col("visit") - F.lag("visit").over(order)
    opened = (F.when(gap.isNull(), "appeared").when(gap > 1, "reopened")
              .when(~F.lag("value").over(order).eqNullSafe(F.col("value")), "changed"))
    marked = one.withColumn("opened", opened)
    numbered = marked.withColumn("version", F.count("opened").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    versions = numbered.groupBy(*subject, "version").agg(
        F.first("value").alias("value"), F.min("visit").alias("from_visit"), F.max("visit").alias("to_visit"), F.min("run_at").alias("valid_from"),
        F.min_by("run_id", "visit").alias("first_run"), F.max_by("run_id", "visit").alias("last_run"), F.max_by("next_at", "visit").alias("next_at"),
        F.count(F.lit(1)).alias("n_runs"), F.min("opened").alias("opened_by"))
    ranked = Window.partitionBy(*subject).orderBy("version")
    replaced = F.lead("from_visit").over(ranked) == F.col("to_visit") + 1
    return versions.select(
        *subject, "version", *[F.col(f"value.{v}").alias(v) for v in values], "valid_from", F.col("next_at").alias("valid_to"), "first_run", "last_run", "n_runs",
        "opened_by", F.when(F.col("next_at").isNotNull(), F.when(replaced, "changed").otherwise("resolved")).alias("closed_by"))


def changes_per_run(history: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``at, *by, appeared, reopened, changed, resolved, open_after``: what each run's time changed, in counts.

    ``open_after`` is a running total; a group has one row for each time at which something changed.
    """
    by = by or []
    begins = history.select(*by, F.col("valid_from").alias("at"), F.col("opened_by").alias("what"))
    ends = history.where("closed_by = 'resolved'").select(*by, F.col("valid_to").alias("at"), F.lit("resolved").alias("what"))
    counts = begins.unionByName(ends).groupBy(*by, "at").agg(*(F.count_if(F.col("what") == w).alias(w) for w in ("appeared", "reopened", "changed", "resolved")))
    running = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("open_after", F.sum(F.col("appeared") + F.col("reopened") - F.col("resolved")).over(running))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], days: int = 30) -> DataFrame:
    """``left`` with ``values`` of the last ``right`` row of the same keys at or before ``left_at``, null where there is none.

    Time is cut into buckets of ``days`` days. A row looks at its own bucket first; what a bucket inherits is carried over from
    the last row of each earlier one, found on one row per key and bucket. So a key with most rows is spread over as many
    tasks as it has buckets, and no task holds more than one bucket of one key. Of right rows at one time the largest
    ``values`` count. Null keys match null keys; a null time on either side matches nothing.
    """
    def cut(at: str) -> Column:
        return F.floor(F.unix_date(F.col(at).cast("date")) / days)

    row = F.struct(F.col(right_at).alias("at"), F.struct(*values).alias("v"))
    known = right.where(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_at"), cut(right_at).alias("_cell"), row.alias("_row"))
    asked = left.select(*keys, F.col(left_at).alias("_at"), cut(left_at).alias("_cell"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"))
    cells = (asked.where("_cell IS NOT NULL").select(*keys, "_cell", F.lit(None).cast(known.schema["_row"].dataType).alias("_row"))
             .unionByName(known.select(*keys, "_cell", "_row")).groupBy(*keys, "_cell").agg(F.max("_row").alias("_last")))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(*keys, "_cell", F.last("_last", ignorenulls=True).over(earlier).alias("_row")).where("_row IS NOT NULL")
    # What is carried into a bucket stands before all its rows, so one window serves both.
    stream = (asked.withColumn("_row", F.lit(None).cast(known.schema["_row"].dataType))
              .unionByName(known, allowMissingColumns=True)
              .unionByName(carried.withColumn("_at", F.col("_row.at")), allowMissingColumns=True))
    order = Window.partitionBy(*keys, "_cell").orderBy(F.col("_at").asc_nulls_first(), F.col("_left").isNotNull(), "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = stream.select("_left", F.when(F.col("_cell").isNotNull(), F.last("_row", ignorenulls=True).over(order)).alias("_row")).where("_left IS NOT NULL")
    return found.select(*[F.col(f"_left.`{c}`") for c in left.columns], *[F.col(f"_row.v.{v}").alias(v) for v in values])


def open_at(history: DataFrame, at: Column) -> DataFrame:
    """Versions in force at a time: the state of every subject as a run of that time saw it."""
    return history.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
