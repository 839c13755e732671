"""Visitor reports: joins, duplicates, rate limits, summaries, moderation, retention."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webestate.functions import checks, text

# Limits of the submission flow.
KEY_LIMIT, PORTAL_LIMIT, WINDOW_HOURS = 5, 2, 24
DUPLICATE_MINUTES = 10
REJECTED_DAYS = 90
DISPLAY_THRESHOLD = 5
TOP_THEMES = 5
PAGE_SIZE, MAX_PAGE_SIZE, QUEUE_LIMIT = 10, 50, 50


def with_moderation(submissions: DataFrame, moderation: DataFrame) -> DataFrame:
    return submissions.join(moderation, "submission_id")


def with_optional_moderation(submissions: DataFrame, moderation: DataFrame) -> DataFrame:
    return submissions.join(moderation, "submission_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def publicly_visible(joined: DataFrame) -> DataFrame:
    return joined.filter("status = 'approved' AND consent")


def experience_summary(visible: DataFrame) -> DataFrame:
    """Per portal: counts, dense outcome counts, rating mean, date span, small-sample flag.

    Dates are compared as text on purpose: a month is smaller than its days.
    """
    when = F.coalesce("occurred_on", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    per = visible.groupBy("portal_id").agg(
        F.count("*").alias("experiences"),
        *(F.count_if(F.col("outcome") == o).alias(o) for o in checks.OUTCOMES),
        F.count("rating").alias("rating_count"),
        F.round(F.avg("rating"), 2).alias("average_rating"),
        F.min(when).alias("earliest"), F.max(when).alias("latest"),
    )
    return per.withColumn("small_sample", F.col("experiences") < DISPLAY_THRESHOLD)


def theme_counts(visible: DataFrame) -> DataFrame:
    """One row per (portal, theme); each array element counts."""
    return visible.select("portal_id", F.explode("themes").alias("theme")).groupBy("portal_id", "theme").agg(F.count("*").alias("n"))


def theme_map(counts: DataFrame) -> DataFrame:
    """The same as one map per portal; the theme vocabulary bounds its size."""
    entries = F.array_sort(F.collect_list(F.struct("theme", "n")))
    known = counts.filter(F.col("theme").isin(*checks.THEMES))
    return known.groupBy("portal_id").agg(F.map_from_entries(entries).alias("theme_counts"))


def top_themes(counts: DataFrame, limit: int = TOP_THEMES) -> DataFrame:
    """Most frequent known themes per portal. The window sees at most one row per theme."""
    known = counts.filter(F.col("theme").isin(*checks.THEMES))
    place = F.row_number().over(W.partitionBy("portal_id").orderBy(F.desc("n"), "theme"))
    return known.withColumn("place", place).filter(F.col("place") <= limit)


# Rolling windows --------------------------------------------------------------------


def seconds(ts: str | Column) -> Column:
    """Event time as microseconds since the epoch."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def bucketed(df: DataFrame, at: str, width_micros: int) -> DataFrame:
    """Copy every row into its own time bucket and the next one.

    A trailing window no wider than a bucket then lies inside one bucket, so a
    window function partitioned by (key, bucket) replaces one partitioned by the
    key alone: a key with very many rows is spread over its buckets.
    """
    own = F.floor(F.col("__t") / width_micros)
    return df.withColumn("__t", seconds(at)).withColumn("__bucket", F.explode(F.array(own, own + 1))).withColumn(
        "__own", F.floor(F.col("__t") / width_micros) == F.col("__bucket"))


def rolling_counts(events: DataFrame, keys: list[str], at: str, hours: float, out: str) -> DataFrame:
    """Rows of the same keys in the trailing window, both ends included."""
    width = int(hours * 3600 * 1_000_000)
    w = W.partitionBy(*keys, "__bucket").orderBy("__t").rangeBetween(-width, 0)
    return bucketed(events, at, width).withColumn(out, F.count("*").over(w)).filter("__own").drop("__t", "__bucket", "__own")


def active_count(events: DataFrame, keys: list[str], now: str, hours: float) -> DataFrame:
    """Rows per key with created_at >= now - hours."""
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(hours * 3600))
    return events.filter((F.col("created_at") >= since) & (F.col("created_at") <= F.lit(now).cast("timestamp_ntz"))).groupBy(*keys).agg(F.count("*").alias("n"))


def mark_duplicates(requests: DataFrame, activity: DataFrame | None = None) -> DataFrame:
    """``duplicate_of``: earliest row of the same portal, task, outcome and content in the
    preceding ten minutes that is pending or approved, if the same key was active on the
    portal in that time.

    No pairs are formed: the earliest candidate is a minimum over a trailing window.
    """
    width = DUPLICATE_MINUTES * 60 * 1_000_000
    content = ["portal_id", "task_type", "outcome", "content_key"]
    rows = requests.withColumn("content_key", F.sha2(F.col("content_key"), 256))
    usable = F.col("status").isin("pending", "approved")
    frame = W.partitionBy(*content, "__bucket").orderBy("__t").rangeBetween(-width, 0)
    wide = bucketed(rows, "created_at", width)
    first = F.min(F.when(usable, F.struct("__t", "submission_id"))).over(frame)
    prior = F.struct(F.col("__t"), F.col("submission_id"))
    marked = wide.withColumn("__first", first).filter("__own").withColumn(
        "__candidate", F.when(F.col("__first") < prior, F.col("__first.submission_id")))
    marked = marked.drop("__t", "__bucket", "__own", "__first")
    if activity is None:
        return marked.withColumnRenamed("__candidate", "duplicate_of")
    gate = recently_active(marked.select("submission_id", "key", "portal_id", "created_at"), activity)
    return marked.join(gate, "submission_id", "left").withColumn(
        "duplicate_of", F.when(F.coalesce("active", F.lit(False)), F.col("__candidate"))).drop("__candidate", "active")


def recently_active(requests: DataFrame, activity: DataFrame) -> DataFrame:
    """Whether the key had an earlier event on the portal in the last ten minutes."""
    width = DUPLICATE_MINUTES * 60 * 1_000_000
    asks = requests.select("submission_id", "key", "portal_id", "created_at", F.lit(1).alias("kind"))
    acts = activity.select(F.lit(None).cast("bigint").alias("submission_id"), "key", "portal_id", "created_at", F.lit(0).alias("kind"))
    both = bucketed(asks.unionByName(acts), "created_at", width)
    # An event at the very moment of the request belongs to the request itself.
    w = W.partitionBy("key", "portal_id", "__bucket").orderBy("__t").rangeBetween(-width, -1)
    hit = F.coalesce(F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(w), F.lit(0)) > 0
    return both.withColumn("active", hit).filter("__own AND kind = 1").select("submission_id", "active")


# Admission ------------------------------------------------------------------------------

HOUR = 3600 * 1_000_000
DAY = WINDOW_HOURS * HOUR


def walk(t: np.ndarray, portal: np.ndarray, accepted: list[tuple[int, object]]) -> np.ndarray:
    """Greedy decisions for one key's rows in time order. ``accepted`` holds (time, portal) of the day before, at most
    ``KEY_LIMIT`` entries, and is updated; rows that no entry's expiry can help are skipped without being looked at."""
    ok, i, n = np.zeros(len(t), dtype=bool), 0, len(t)
    while i < n:
        accepted[:] = [a for a in accepted if a[0] >= t[i] - DAY]
        taken = [a[1] for a in accepted]
        full = [p for p in set(taken) if taken.count(p) >= PORTAL_LIMIT]
        if len(taken) < KEY_LIMIT and portal[i] not in full:
            ok[i] = True
            accepted.append((int(t[i]), portal[i]))
            i += 1
            continue
        freed = int(np.searchsorted(t, accepted[0][0] + DAY, "right"))  # the oldest entry counts until then
        i += 1
        if len(taken) >= KEY_LIMIT:
            i = max(i, freed)
        while i < freed and i < n and portal[i] in full:
            other = ~np.isin(portal[i:min(i + 4096, freed)], full)
            i += int(other.argmax()) if other.any() else len(other)
    return ok


def _timed(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", "key", "portal_id", seconds("created_at").alias("t"))


def admit(requests: DataFrame) -> DataFrame:
    """Accepted and rejected requests: at most 5 accepted per key and 2 per key and portal
    in 24 hours; rejected requests never count.

    The rule is sequential inside a key. Rows are sorted by key and time in their partitions and streamed; a task
    remembers the five entries of the key it is at, whatever the number of its rows.
    """
    timed = _timed(requests)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepted: list[tuple[int, object]] = []
        last: tuple = ()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, t = batch.column("key"), batch.column("t").to_numpy()
            portal = np.asarray(batch.column("portal_id").to_pylist(), dtype=object)
            code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            ok = np.zeros(len(code), dtype=bool)
            for a, b in zip(edges, edges[1:], strict=False):
                if (now := (keys[a].as_py(),)) != last:
                    accepted, last = [], now
                ok[a:b] = walk(t[a:b], portal[a:b], accepted)
            yield pa.RecordBatch.from_arrays([batch.column("request_id"), keys, batch.column("portal_id"), pa.array(ok)], ["request_id", "key", "portal_id", "accepted"])

    kinds = {f.name: f.dataType.simpleString() for f in timed.schema}
    return (_spread(timed).sortWithinPartitions("key", "t", "request_id")
            .mapInArrow(decide, f"request_id {kinds['request_id']}, key {kinds['key']}, portal_id {kinds['portal_id']}, accepted boolean"))


def _spread(rows: DataFrame) -> DataFrame:
    """Partition by key with the session's shuffle width. Runtime merging of small
    partitions goes by bytes; Python work per row is what costs here."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")


# Moderation and retention ----------------------------------------------------------------


def moderation_queue(joined: DataFrame, limit: int = QUEUE_LIMIT) -> DataFrame:
    """Pending reports, oldest first."""
    return joined.filter("status = 'pending'").orderBy("created_at", "submission_id").limit(limit).select(
        "submission_id", "portal_id", "created_at", "task_type", "outcome", "themes",
        text.moderation_preview(F.col("free_text")).alias("preview"), "consent")


def page_bounds(page: str | None, size: str | None) -> tuple[int, int]:
    """Page and size from request text; bad input falls back to the defaults."""
    def number(raw: str | None, fallback: int) -> int:
        digits = (raw or "").strip()
        sign = digits[:1] in "+-" and digits[:1] != ""
        body = digits[1:] if sign else digits
        lead = ""
        for ch in body:
            if not ch.isdigit():
                break
            lead += ch
        value = int(lead) if lead else fallback
        value = -value if lead and digits[:1] == "-" else value
        return value if value >= 1 else fallback

    return number(page, 1), min(number(size, PAGE_SIZE), MAX_PAGE_SIZE)


def approved_page(visible: DataFrame, portal, page: str | None = None, size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One page of a portal's public reports, newest first, and the total."""
    number, per_page = page_bounds(page, size)
    rows = visible.filter(F.col("portal_id") == F.lit(portal))
    items = rows.orderBy(F.desc("created_at"), "submission_id").offset((number - 1) * per_page).limit(per_page)
    return items, rows.agg(F.count("*").alias("total"))


def expired_submissions(moderation: DataFrame, now: str, days: int = REJECTED_DAYS) -> DataFrame:
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    return moderation.filter((F.col("status") == "rejected") & (F.col("moderated_at") < cutoff)).select("submission_id")


def apply_retention(submissions: DataFrame, moderation: DataFrame, now: str, days: int = REJECTED_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables without long-rejected reports, and the number of reports removed."""
    gone = expired_submissions(moderation, now, days)
    kept_s = submissions.join(gone, "submission_id", "left_anti")
    kept_m = moderation.join(gone, "submission_id", "left_anti")
    removed = submissions.join(gone, "submission_id", "left_semi").agg(F.count("*").alias("rejected_submissions_deleted"))
    return kept_s, kept_m, removed


def write_retained(submissions: DataFrame, moderation: DataFrame, now: str, path: str, days: int = REJECTED_DAYS) -> dict[str, int]:
    """Write both tables without long-rejected reports below ``path``; counts of what stayed and went are observed on the written plans.

    Each table is read once more than its ids: for the write. Counts are ``submissions``, ``moderation`` (rows kept) and
    ``rejected_submissions_deleted``.
    """
    gone = expired_submissions(moderation, now, days).distinct().withColumn("__gone", F.lit(True))
    counts = {}
    for name, rows in (("submissions", submissions), ("moderation", moderation)):
        seen = Observation(name)
        marked = rows.join(gone, "submission_id", "left").observe(seen, F.count_if(F.col("__gone").isNull()).alias("kept"), F.count("__gone").alias("gone"))
        marked.where("__gone IS NULL").drop("__gone").write.parquet(f"{path}/{name}")
        counts[name] = seen.get["kept"]
        if name == "submissions":
            counts["rejected_submissions_deleted"] = seen.get["gone"]
    return counts


def drop_expired_keys(events: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    old = F.col("expires_at") < F.lit(now).cast("timestamp_ntz")
    return events.filter(~old), events.agg(F.count_if(old).alias("expired_keys_deleted"))


def apply_decisions(moderation: DataFrame, submissions: DataFrame, decisions: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Moderation rows after a batch of decisions, and the decisions refused.

    Approval without public text publishes the report's own text; needs_redaction
    requires a public text; an unknown report is an error. Of several valid
    decisions about one report the last one counts, in order of ``decided_at`` if
    there is such a column, else of the batch as it is read.
    """
    at = F.col("decided_at") if "decided_at" in decisions.columns else F.monotonically_increasing_id()
    known = decisions.withColumn("__at", at).join(submissions.select("submission_id", "free_text"), "submission_id", "left").join(
        moderation.select("submission_id", F.lit(True).alias("known")), "submission_id", "left")
    error = F.when((F.col("decision") == "needs_redaction") & (F.coalesce("public_text", F.lit("")) == ""), "needs_redaction requires public text").when(
        F.col("known").isNull(), "submission not found")
    judged = known.withColumn("error", error)
    good = judged.filter("error IS NULL").select(
        "submission_id", F.col("decision").alias("d_status"), F.col("reason_code").alias("d_reason"),
        F.when((F.col("decision") == "approved") & F.col("public_text").isNull(), F.col("free_text")).otherwise(F.col("public_text")).alias("d_text"),
        F.lit(True).alias("hit"), "__at")
    fields = ("d_status", "d_reason", "d_text", "hit")
    good = good.groupBy("submission_id").agg(F.max_by(F.struct(*fields), F.struct("__at", *fields)).alias("d")).select("submission_id", "d.*")
    merged = moderation.join(good, "submission_id", "left")
    hit = F.coalesce("hit", F.lit(False))
    after = merged.select(
        "submission_id", F.when(hit, F.col("d_status")).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("moderated_at")).alias("moderated_at"),
        F.when(hit, F.col("d_reason")).otherwise(F.col("reason_code")).alias("reason_code"),
        F.when(hit, F.col("d_text")).otherwise(F.col("public_text")).alias("public_text"))
    return after, judged.filter("error IS NOT NULL").select("submission_id", "decision", "error")


def enrich(submissions: DataFrame, description: str | None = None, free_text: str = "free_text") -> DataFrame:
    """Normalised text, union of privacy flags, status pending. Works on a stream too."""
    body = text.normalize_bounded_text(F.col(free_text))
    if description is None:
        flags = text.privacy_flags(body)
        return submissions.withColumn("privacy_flags", flags).withColumn(free_text, body).withColumn("status", F.lit("pending"))
    task = text.normalize_bounded_text(F.col(description))
    flags = text.merge_flags(text.privacy_flags(task), text.privacy_flags(body))
    return submissions.withColumn("privacy_flags", flags).withColumns({free_text: body, description: task, "status": F.lit("pending")})


def split_known_portals(submissions: DataFrame, portals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports about known portals, and the rest. Works stream against static."""
    known = portals.select("portal_id").distinct()
    return submissions.join(known, "portal_id", "left_semi"), submissions.join(known, "portal_id", "left_anti")
