"""Queries over sources, sinks, data quality and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from webestate.operators import publish, quality, review, rollup
from webestate.operators.rules import RuleContext
from webestate.plans import beds
from webestate.plans import report_queries as reports
from webestate.plans import rollup_queries as runs
from webestate.plans import rule_queries as rq
from webestate.plans.catalog import plain, query
from webestate.plans.sql_beds import B2, B3, B4, B6, B7, PORTALS
from webestate.session import TABLES, materialise, scratch_path, table
from webestate.sources import listings, records, snapshots
from webestate.streaming import flows, tables


def observation_records(spark, sf):
    """B2 as JSON records in the stated field names; every 40th breaks a constraint."""
    n = F.col("seq")
    at = F.date_format("checked_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    row = F.struct(
        F.col("observation_id").alias("id"), F.lit("1.0.0").alias("schemaVersion"), F.lit("run-1").alias("runId"),
        F.concat(F.lit("p"), "portal_id").alias("portalId"), F.col("requested_url").alias("requestedUrl"), F.col("final_url").alias("finalUrl"),
        F.when(n % 40 == 7, F.lit("yesterday")).otherwise(at).alias("checkedAt"),
        F.when(n % 40 == 5, F.lit(0)).otherwise(F.col("attempt")).alias("attempt"),
        F.when(n % 40 == 3, F.lit("telepathy")).otherwise(F.col("fetch_mode")).alias("fetchMode"),
        F.col("http_status").alias("httpStatus"), F.col("redirect_chain").alias("redirectChain"), F.col("error_code").alias("errorCode"),
        F.when(n % 40 != 9, F.lit("allowed")).alias("robotsDecision"), F.array().cast("array<string>").alias("artifactRefs"),
        F.when(n % 40 == 1, F.lit("x")).alias("surprise"))
    return beds.page_observations(spark, sf).select("seq", F.to_json(row).alias("value"))


@query("dq01_record_violations", f"""WITH {B2} SELECT seq, CASE seq % 40 WHEN 7 THEN 'format:checkedAt' WHEN 5 THEN 'range:attempt' WHEN 3 THEN 'enum:fetchMode' WHEN 9 THEN 'missing:robotsDecision' WHEN 1 THEN 'unknown:surprise' END AS violation
  FROM b2 WHERE seq % 40 IN (1, 3, 5, 7, 9)""")
def dq01(spark, sf):
    rows = observation_records(spark, sf)
    return rows.select("seq", F.explode_outer(quality.record_violations("page_observation")).alias("violation")).filter("violation IS NOT NULL")


@query("src01_strict_scan", f"WITH {B2} SELECT fetch_mode, count(*) AS rows, CAST(sum(attempt) AS BIGINT) AS attempts FROM b2 WHERE seq % 40 NOT IN (1, 3, 5, 7, 9) GROUP BY 1")
def src01(spark, sf):
    path = scratch_path(spark, "strict")
    observation_records(spark, sf).filter("seq % 40 NOT IN (1, 3, 5, 7, 9)").select("value").write.text(path)
    rows = records.read_records(spark, path, "page_observation")
    return rows.groupBy(F.col("fetchMode").alias("fetch_mode")).agg(F.count("*").alias("rows"), F.sum("attempt").alias("attempts"))


@query("src02_lenient_scan", f"WITH {B2} SELECT fetch_mode, count(*) AS rows, CAST(sum(attempt) AS BIGINT) AS attempts FROM b2 WHERE seq % 40 NOT IN (1, 3, 5, 7, 9) GROUP BY 1")
def src02(spark, sf):
    path = scratch_path(spark, "lenient")
    observation_records(spark, sf).select("value").write.text(path)
    rows = records.read_records(spark, path, "page_observation", mode="lenient")
    return rows.groupBy(F.col("fetchMode").alias("fetch_mode")).agg(F.count("*").alias("rows"), F.sum("attempt").alias("attempts"))


LISTING = """lst AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '' ELSE 'Site ' || page_id || ', "quoted"' END AS name, CASE WHEN page_id % 6 = 0 THEN '' ELSE url END AS url,
    'DEPT_' || (page_id % 7) AS department FROM pages)"""


def listing_rows(spark, sf):
    n = F.col("page_id")
    return table(spark, sf, "pages").select(
        n, F.when(n % 9 == 0, "").otherwise(F.concat(F.lit("Site "), n, F.lit(', "quoted"'))).alias("name"),
        F.when(n % 6 == 0, "").otherwise(F.col("url")).alias("url"), F.concat(F.lit("DEPT_"), n % 7).alias("department"))


def both_channels(good, rejects):
    return good.select("name", "url", "department", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        rejects.select("name", "url", "department", "reject_reason"))


@query("src03_csv_listing", f"""WITH {LISTING} SELECT coalesce(name, '') AS name, url, department, CASE WHEN name = '' THEN 'row missing a usable ''name''' WHEN url = '' THEN 'row missing a usable ''url''' END AS reject_reason FROM lst""")
def src03(spark, sf):
    path = scratch_path(spark, "csv")
    listing_rows(spark, sf).select(F.col("name").alias(" Name "), F.col("url").alias("URL"), "department").write.option(
        "header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    good, rejects = listings.read_listing_csv(spark, path, "dir")
    out = both_channels(good, rejects)
    return out.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("name", "url")), "department", "reject_reason")


@query("src04_json_listing", """SELECT CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 9 = 0 THEN '' ELSE 'Site ' || page_id END AS name, CASE WHEN page_id % 11 <> 0 THEN url END AS url,
  CASE WHEN page_id % 11 <> 0 AND page_id % 4 = 0 THEN 'directory' END AS portal_type, CASE WHEN page_id % 11 <> 0 AND page_id % 5 <> 0 THEN 'a|b' END AS tags,
  CASE WHEN page_id % 11 = 0 THEN 'entry is not an object' WHEN page_id % 9 = 0 THEN 'entry missing a usable ''name''' END AS reject_reason FROM pages""")
def src04(spark, sf):
    n = F.col("page_id")
    entry = F.to_json(F.struct(
        F.when(n % 9 == 0, " ").otherwise(F.concat(F.lit("Site "), n)).alias("name"), "url",
        F.when(n % 4 == 0, "directory").otherwise("palace").alias("portalType"), F.array(F.lit("a"), F.lit("b")).alias("tags")))
    entry = F.when(n % 11 == 0, F.lit("17")).when(n % 5 == 0, F.replace(entry, F.lit('["a","b"]'), F.lit('["a",2]'))).otherwise(entry)
    doc = F.when(n % 2 == 0, F.concat(F.lit("["), entry, F.lit("]"))).otherwise(F.concat(F.lit('{"entries":['), entry, F.lit("]}")))
    good, rejects = listings.read_listing_json(table(spark, sf, "pages").select(doc.alias("body")), "body", "dir")
    out = good.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejects)
    return plain(out.select("name", "url", "portal_type", "tags", "reject_reason"))


def sidecar_files(spark, sf):
    """Decision files as (file, value): some broken, some misnamed."""
    d = F.col("doc_id")
    body = F.to_json(F.struct(
        F.lit("1.0.0").alias("schemaVersion"), F.concat(F.lit("f"), d).alias("findingId"),
        F.when(F.col("toxic") == 1, "reject").otherwise("publish").alias("decision"), F.lit("2024-01-01T00:00:00Z").alias("reviewedAt"),
        F.lit("desk").alias("reviewer"), F.when(d % 23 == 0, "").otherwise("seen").alias("rationale")))
    value = F.when(d % 19 == 0, F.lit("{oops")).otherwise(body)
    name = F.when(d % 17 == 0, F.concat(F.lit("g"), d)).otherwise(F.concat(F.lit("f"), d))
    return table(spark, sf, "labels").select(value.alias("value"), F.concat(name, F.lit(".json")).alias("file"))


SIDECAR_ERRORS = """CASE WHEN doc_id % 19 = 0 THEN 'not valid JSON' WHEN doc_id % 23 = 0 THEN 'empty:rationale' WHEN doc_id % 17 = 0 THEN 'file name does not match findingId' END"""


@query("src06_sidecars", f"SELECT count(*) AS files, count(*) FILTER ({SIDECAR_ERRORS} IS NULL) AS records, count(*) FILTER ({SIDECAR_ERRORS} IS NOT NULL) AS errors FROM labels")
def src06(spark, sf):
    good, errors = records.judge_sidecars(sidecar_files(spark, sf), "review_decision", "findingId")
    tagged = good.select(F.lit(0).alias("bad")).unionAll(errors.select(F.lit(1).alias("bad")))
    return tagged.agg(F.count("*").alias("files"), F.count_if(F.col("bad") == 0).alias("records"), F.count_if(F.col("bad") == 1).alias("errors"))


@query("rv09_invalid_files", f"SELECT 'invalid_review_decision_file' AS code, CASE WHEN doc_id % 17 = 0 THEN 'g' ELSE 'f' END || doc_id AS finding_id, {SIDECAR_ERRORS} AS detail FROM labels WHERE {SIDECAR_ERRORS} IS NOT NULL")
def rv09(spark, sf):
    _, errors = records.judge_sidecars(sidecar_files(spark, sf), "review_decision", "findingId")
    return review.sidecar_issues("invalid_review_decision_file", errors)


def snapshot_root(spark, sf):
    """Two runs of the portal table, the second one current."""
    root = scratch_path(spark, "snapshot")
    portals = beds.portals(spark, sf).select("portal_id", "name", "official_status")
    snapshots.write_snapshot({"portals": portals.filter("portal_id % 2 = 0")}, root, "run-0")
    snapshots.write_snapshot({"portals": portals}, root, "run-1")
    return root


@query("snk01_snapshot_runs", f"WITH {PORTALS} SELECT 'run-0' AS run_id, count(*) AS rows FROM portals WHERE portal_id % 2 = 0 UNION ALL SELECT 'run-1', count(*) FROM portals")
def snk01(spark, sf):
    return spark.read.parquet(f"{snapshot_root(spark, sf)}/portals").groupBy("run_id").agg(F.count("*").alias("rows"))


@query("src07_current_snapshot", f"WITH {PORTALS} SELECT portal_id, name, official_status, 'run-1' AS run_id FROM portals")
def src07(spark, sf):
    return snapshots.read_current(spark, snapshot_root(spark, sf), "portals")


@query("src08_known_portals", f"WITH {PORTALS} SELECT portal_id FROM portals")
def src08(spark, sf):
    return snapshots.known_portal_ids(spark, snapshot_root(spark, sf))[0]


@query("snk03_nested_export", runs.ASM + f"SELECT portal_id, technical_health, (SELECT count(*) FROM fnd WHERE fnd.portal_id = asm.portal_id AND {runs.PUB}) AS findings FROM asm")
def snk03(spark, sf):
    """The nested document, read back: one object per portal with its findings, and the parts of those that have more."""
    findings = runs.stored_findings(spark, sf)
    path = scratch_path(spark, "export")
    published = findings.filter(F.col("review_status").isin(*publish.PUBLISHABLE))
    asm = materialise(runs.assessments(spark, sf, findings), "assessments")
    summary = rollup.publication_summary(asm, runs.audit_run(spark, sf), "2024-02-02 00:00:00", ["Ids are digests."])
    snapshots.export_nested(summary, asm, published, path, most=20_000)
    inner = "findings array<struct<rule_id:string>>"
    parts = spark.read.schema(f"portal_id bigint, {inner}").json(f"{path}/parts").groupBy("portal_id").agg(F.sum(F.size("findings")).alias("more"))
    portals = spark.read.schema(f"portal_id bigint, technical_health string, {inner}").json(f"{path}/portals")
    return portals.join(parts, "portal_id", "left").select("portal_id", "technical_health", (F.size("findings") + F.coalesce("more", F.lit(0))).cast("bigint").alias("findings"))


@query("dq02_run_violations", f"""WITH {B2}, st AS (SELECT portal_id, CASE WHEN arg_min(error_code IS NOT NULL, seq) THEN 'failed' WHEN bool_or(error_code IS NOT NULL) THEN 'partial' ELSE 'succeeded' END AS status FROM b2 GROUP BY 1),
  t AS (SELECT count(*) AS n, count(*) FILTER (status = 'succeeded') AS good FROM st)
  SELECT 'claimed-completed' AS run_id, 'completed_needs_all' AS violation FROM t WHERE NOT (good = n AND n > 0) UNION ALL SELECT 'claimed-failed', 'failed_needs_none' FROM t WHERE NOT (good = 0 AND n > 0)
  UNION ALL SELECT 'claimed-partial', 'partial_needs_a_mix' FROM t WHERE good IN (0, n) UNION ALL SELECT 'open-ended', 'terminal_without_completion' FROM t UNION ALL SELECT 'miscounted', 'counts_do_not_add_up' FROM t
  UNION ALL SELECT 'open-ended', 'partial_needs_a_mix' FROM t WHERE good IN (0, n) UNION ALL SELECT 'miscounted', 'partial_needs_a_mix' FROM t WHERE good IN (0, n)""")
def dq02(spark, sf):
    run = runs.audit_run(spark, sf).drop("run_id", "status")
    out = None
    for name, change in {
        "claimed-completed": {"status": F.lit("completed")}, "claimed-failed": {"status": F.lit("failed")}, "claimed-partial": {"status": F.lit("partial")},
        "open-ended": {"status": F.lit("partial"), "completed_at": F.lit(None).cast("timestamp_ntz")},
        "miscounted": {"status": F.lit("partial"), "portals_failed": F.col("portals_failed") + 1},
    }.items():
        part = run.withColumns(change).withColumn("run_id", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return quality.violation_rows(out, "run_id", quality.RUN_RULES)


@query("dq03_finding_violations", f"WITH {B7} SELECT finding_id, 'overlap_without_comparison' AS violation FROM rf WHERE category = 'possible_overlap' AND comparison_id IS NULL UNION ALL SELECT finding_id, 'not_assessable_without_limitation' FROM rf WHERE finding_id % 6 = 0")
def dq03(spark, sf):
    rows = beds.review_findings(spark, sf).withColumns({
        "check_status": F.when(F.col("finding_id") % 3 == 0, "not_assessable").otherwise("fail"), "review_status": F.lit("pending_review"),
        "limitations": F.when(F.col("finding_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))})
    return quality.violation_rows(rows, "finding_id", quality.FINDING_RULES)


@query("dq04_link_violations", f"WITH {B3} SELECT source_page, 'not_assessable_without_code' AS violation FROM b3 WHERE status = 'not_assessable'")
def dq04(spark, sf):
    return quality.violation_rows(beds.link_observations(spark, sf), "source_page", quality.LINK_RULES)


@query("dq05_comparison_violations", "SELECT 'cmp-' || s_suppkey AS comparison_id, 'same_portal' AS violation FROM supplier WHERE s_suppkey % 53 = (s_suppkey + 9) % 50 UNION ALL SELECT 'cmp-' || s_suppkey, 'no_evidence' FROM supplier WHERE s_suppkey % 10 = 0")
def dq05(spark, sf):
    rows = beds.overlap_comparisons(spark, sf)
    bare = F.regexp_extract("comparison_id", r"(\d+)", 1).cast("bigint") % 10 == 0
    rows = rows.withColumn("evidence_refs", F.when(bare, F.array().cast("array<string>")).otherwise(F.col("evidence_refs")))
    return quality.violation_rows(rows, "comparison_id", quality.COMPARISON_RULES)


@query("dq06_assessment_violations", runs.ASM + """, sv AS (SELECT portal_id, count(*) AS n FROM fnd WHERE review_status = 'reviewed' AND severity IN ('critical', 'significant') GROUP BY 1)
  SELECT portal_id, 'healthy_with_severe_finding' AS violation FROM asm JOIN sv USING (portal_id) WHERE portal_id % 4 = 0 OR technical_health = 'healthy'
  UNION ALL SELECT portal_id, 'not_assessable_without_note' FROM asm WHERE technical_health = 'not_assessable' AND portal_id % 4 <> 0 AND portal_id % 3 = 0""")
def dq06(spark, sf):
    findings = runs.stored_findings(spark, sf)
    rows = quality.with_severe_counts(runs.assessments(spark, sf, findings), findings).withColumns({
        "technical_health": F.when(F.col("portal_id") % 4 == 0, "healthy").otherwise(F.col("technical_health")),
        "coverage_note": F.when(F.col("portal_id") % 3 == 0, " ").otherwise(F.col("coverage_note"))})
    return quality.violation_rows(rows, "portal_id", quality.ASSESSMENT_RULES)


@query("rv11_publication_check", runs.ASM + """, sv AS (SELECT portal_id FROM fnd WHERE review_status = 'reviewed' AND severity IN ('critical', 'significant'))
  SELECT count(*) AS violations FROM asm WHERE (technical_health = 'healthy' AND portal_id IN (SELECT portal_id FROM sv)) OR (technical_health = 'not_assessable' AND trim(coverage_note) = '')""")
def rv11(spark, sf):
    findings = runs.stored_findings(spark, sf)
    rows = quality.with_severe_counts(runs.assessments(spark, sf, findings), findings)
    return quality.violation_rows(rows, "portal_id", quality.ASSESSMENT_RULES).agg(F.count("*").alias("violations"))


@query("dq07_submission_violations", f"""WITH {B4} SELECT submission_id, 'outcome' AS violation FROM subs WHERE outcome = 'other' UNION ALL SELECT submission_id, 'device_type' FROM subs WHERE device_type = 'kiosk'
  UNION ALL SELECT o_orderkey // 2, 'moderation_not_unique' FROM orders GROUP BY 1 HAVING count(*) > 1""")
def dq07(spark, sf):
    rows = quality.violation_rows(beds.submissions(spark, sf), "submission_id", quality.SUBMISSION_RULES)
    halved = beds.moderation(spark, sf).withColumn("submission_id", F.expr("submission_id div 2"))
    return rows.unionByName(quality.not_unique(halved, "submission_id", "moderation_not_unique"))


@query("dq08_request_errors", f"""WITH {B4} SELECT submission_id, concat_ws('|', CASE WHEN outcome = 'other' THEN 'outcome: unknown outcome' END, CASE WHEN device_type = 'kiosk' THEN 'deviceType: unknown device type' END) AS errors
  FROM subs WHERE outcome = 'other' OR device_type = 'kiosk'""")
def dq08(spark, sf):
    rows = quality.field_errors(beds.submissions(spark, sf), quality.REQUEST_RULES).filter("size(errors) > 0")
    return rows.select("submission_id", F.array_join(F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "|").alias("errors"))


# Streams ------------------------------------------------------------------------------


def stream(spark, sf, name):
    return spark.readStream.schema(TABLES[name]).parquet(f"{sf}/{name}.parquet*")


def request_stream(spark, sf):
    return stream(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("key"), F.col("event_type").alias("portal_id"), F.col("ts").alias("created_at"))


@query("st01_admission_stream", reports.ADMISSION_SQL)
def st01_stream(spark, sf):
    out = scratch_path(spark, "admission-stream")
    flows.run_available(flows.admission(request_stream(spark, sf), f"{out}/decisions"), f"{out}/checkpoint")
    return spark.read.schema("request_id bigint, key bigint, portal_id string, accepted boolean").parquet(f"{out}/decisions")


@query("st02_duplicate_stream", reports.ORACLES["jn09_duplicates"])
def st02(spark, sf):
    out = scratch_path(spark, "duplicate-stream")
    n = F.col("event_id")
    rows = stream(spark, sf, "events").select(
        n.alias("submission_id"), F.col("user_id").alias("key"), F.lit("p").alias("portal_id"), (F.col("user_id") % 3).alias("task_type"),
        F.lit("completed").alias("outcome"), F.col("ts").alias("created_at"), F.concat(F.lit("note "), n % 2).alias("content_key"),
        F.when(n % 7 == 0, "rejected").when(n % 2 == 0, "pending").otherwise("approved").alias("status"))
    return flows.run_duplicates(rows, out, lateness="31 days").select("submission_id", "duplicate_of")


@query("st03_enrichment_stream", "SELECT conv_id, turn, nullif(trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), '') AS text, 'pending' AS status FROM conversations")
def st03(spark, sf):
    out = scratch_path(spark, "enrichment")
    rows = stream(spark, sf, "conversations").withColumnRenamed("text", "free_text")
    flows.run_available(flows.enriched(rows, f"{out}/rows"), f"{out}/checkpoint")
    done = spark.read.schema("conv_id bigint, turn bigint, free_text string, status string").parquet(f"{out}/rows")
    return done.select("conv_id", "turn", F.col("free_text").alias("text"), "status")


def order_stream(spark, sf):
    return stream(spark, sf, "orders").select(
        F.col("o_orderkey").alias("submission_id"), F.col("o_custkey").alias("portal_id"), F.col("o_orderdate").alias("created_at"))


KNOWN = "known AS (SELECT c_custkey AS portal_id FROM customer WHERE c_mktsegment <> 'BUILDING')"


def known_customers(spark, sf):
    return table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("portal_id"))


@query("st04_known_portal_stream", f"WITH {KNOWN} SELECT o_orderkey AS submission_id, o_custkey IN (SELECT portal_id FROM known) AS accepted FROM orders")
def st04(spark, sf):
    out = scratch_path(spark, "known-portals")
    flows.run_available(flows.append_pending(order_stream(spark, sf), known_customers(spark, sf), out), f"{out}/checkpoint")
    yes = flows.read_epochs(spark, f"{out}/submissions", "submission_id bigint").withColumn("accepted", F.lit(True))
    return yes.unionByName(flows.read_epochs(spark, f"{out}/rejects", "submission_id bigint").withColumn("accepted", F.lit(False)))


@query("snk09_pending_rows", f"WITH {KNOWN} SELECT o_orderkey AS submission_id, 'pending' AS status FROM orders WHERE o_custkey IN (SELECT portal_id FROM known)")
def snk09(spark, sf):
    out = scratch_path(spark, "pending-rows")
    flows.run_available(flows.append_pending(order_stream(spark, sf), known_customers(spark, sf), out), f"{out}/checkpoint")
    return flows.read_epochs(spark, f"{out}/moderation", "submission_id bigint, status string")


LIVE = "portal_id bigint, experiences bigint, completed bigint, partially_completed bigint, not_completed bigint, information_only bigint, rating_count bigint, average_rating double, earliest string, latest string, theme_counts map<string,bigint>, small_sample boolean"


@query("st08_live_summary", f"""SELECT a.*, t.themes FROM ({reports.ORACLES['ag10_experience_summary']}) a LEFT JOIN ({reports.ORACLES['ag10_theme_map']}) t USING (portal_id)""")
def st08(spark, sf):
    out = scratch_path(spark, "live-summary")
    approved = stream(spark, sf, "orders").filter("o_orderstatus = 'F'")
    flows.run_available(flows.live_summary(beds.submissions_from(approved).filter("consent"), out), f"{out}-checkpoint")
    rows = tables.read_table(spark, out, LIVE)
    themes = F.array_join(F.array_sort(F.transform(F.map_entries("theme_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return rows.withColumn("themes", themes).drop("theme_counts")


@query("st09_incremental_findings", reports.ORACLES["se02_all_findings"])
def st09(spark, sf):
    """One run whose observations arrive in several micro-batches, under all rules."""
    base = scratch_path(spark, "runs")
    rows = beds.page_observations(spark, sf).withColumn("run_id", F.lit("run-1"))
    for part in range(2):
        rows.filter(F.col("seq") % 2 == part).write.parquet(f"{base}/incoming/{part}")
    incoming = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 8).parquet(f"{base}/incoming")

    def context(pages, run_id):
        return RuleContext(
            run_id=run_id, analyzed_at=beds.ANALYZED_AT, portals=beds.portals(spark, sf), sources=beds.portal_sources(spark, sf),
            pages=pages, links=beds.link_observations(spark, sf), skips=beds.skip_log(spark, sf), version="given")

    flows.run_available(flows.incremental_findings(incoming, context, base), f"{base}/checkpoint")
    found = spark.read.parquet(f"{base}/findings/run_id=run-1")
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("findings"), F.count_distinct("portal_id").alias("portals"))
