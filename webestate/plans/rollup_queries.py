"""Queries over the findings of a whole run: health, counts, assessments, read side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webestate.functions import checks
from webestate.operators import publish, review, rollup
from webestate.operators.rules import materialise_findings, rule_severities, run_rules
from webestate.operators.rules.availability import entry_evidence
from webestate.operators.rules.base import effective_attempts
from webestate.operators.rules.links import broken_link_sources
from webestate.plans import beds
from webestate.plans import rule_queries as rq
from webestate.plans.catalog import plain, query
from webestate.plans.sql_beds import B2, B3, B7, ENTRY, PORTALS, SKIPS
from webestate.session import materialise, scratch_path
from webestate.sources import snapshots

# Inputs ----------------------------------------------------------------------


def run_findings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """B5: materialised findings of all rules, most of them reviewed, and their artifacts."""
    records, artifacts = materialise_findings(run_rules(rq.context(spark, sf)), beds.RUN_ID, beds.ANALYZED_AT)
    status = (
        F.when((F.length("summary") + F.col("portal_id")) % 10 == 0, "rejected")
        .when((F.col("rule_id") == "availability.automation-blocked.v1") & (F.col("portal_id") % 20 == 5), "not_assessable")
        .otherwise("reviewed")
    )
    return records.withColumn("review_status", status), artifacts


def stored_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The findings as a written table, for queries that read them more than once."""
    return materialise(run_findings(spark, sf)[0], "findings")


def assessments(spark: SparkSession, sf: str, findings: DataFrame | None = None) -> DataFrame:
    portals = beds.portals(spark, sf)
    findings = run_findings(spark, sf)[0] if findings is None else findings
    coverage = rollup.crawl_coverage(beds.page_observations(spark, sf), beds.link_observations(spark, sf))
    comparisons = beds.overlap_comparisons(spark, sf)
    reviewed = review.effective_privacy(beds.review_artifacts(spark, sf), beds.privacy_overlays(spark, sf))
    chosen = rollup.select_comparison(comparisons, portals, review.unreviewed_refs(comparisons, reviewed), beds.RUN_ID)
    return rollup.assess_portals(
        portals, findings.withColumn("publishable", F.col("review_status").isin(*publish.PUBLISHABLE)),
        coverage, chosen, beds.RUN_ID, beds.ANALYZED_AT,
    )


def audit_run(spark: SparkSession, sf: str) -> DataFrame:
    """E3: the run manifest, with totals computed from the observations."""
    return rollup.run_totals(rollup.portal_run_status(beds.page_observations(spark, sf))).withColumns({
        "geography": F.lit("estate"), "methodology_version": F.lit("1.0.0"),
        "limitations": F.array(F.lit("One run only."), F.lit("No browser checks.")),
    })


ASSESSMENT_COLUMNS = (
    "portal_id", "name", "canonical_url", "department", "portal_type", "official_status", "technical_health", "continuing_role",
    "suggested_action", "critical_count", "significant_count", "advisory_count", "reviewed_finding_count", "pages_attempted",
    "pages_observed", "links_checked", "browser_fallback_used", "coverage_note", "last_checked_at", "audit_run_id",
)

# SQL twins of the inputs -------------------------------------------------------


def _branch(group: str, where: str, select: str) -> tuple[str, str]:
    return rq.entry_group(where).replace("g AS", f"{group} AS", 1), select.replace(" FROM g", f" FROM {group}", 1)


_GROUPS, _SELECTS = [], []
for _i, (_where, _select) in enumerate((
    (rq.FAILED, rq.RU01), (rq.SERVER, rq.RU02), (rq.MISSING, rq.RU03),
    ("error_code = 'AUTOMATION_BLOCKED'", rq.RU05), (rq.RESTRICTED, rq.RU06),
    ("error_code IN ('TLS_CERT_EXPIRED','TLS_HOST_MISMATCH')", rq.RU08), ("error_code IS NULL", rq.RU10),
)):
    _g, _s = _branch(f"g{_i}", _where, _select)
    _GROUPS.append(_g)
    _SELECTS.append(_s)
_SELECTS += [rq.RU04, rq.RU07, rq.RU09, rq.RU11, rq.RU12, rq.RU13, rq.RU14]

FINDINGS = ", ".join([B2, SKIPS, B3, PORTALS, ENTRY, *_GROUPS, rq.BROKEN, rq.COVERAGE, rq.CRITICAL, rq.DISAGREE]) + (
    ", drafts AS (" + " UNION ALL ".join(_SELECTS) + """), fnd AS (
  SELECT * REPLACE (CASE WHEN (length(summary) + portal_id) % 10 = 0 THEN 'rejected'
      WHEN rule_id = 'availability.automation-blocked.v1' AND portal_id % 20 = 5 THEN 'not_assessable' ELSE 'reviewed' END AS review_status),
    'finding-' || substr(sha256('run-1|' || portal_id || '|' || rule_id || '|' || subject), 1, 32) AS finding_id FROM drafts)"""
)
SEV_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'significant' THEN 1 ELSE 2 END"
ACT_RANK = "CASE suggested_action WHEN 'review_retirement' THEN 0 WHEN 'repair' THEN 1 WHEN 'review_consolidation' THEN 2 WHEN 'manual_assessment' THEN 3 ELSE 4 END"
HEALTH_SQL = """CASE WHEN bool_or({0} AND severity = 'critical' AND rule_id IN ('availability.unavailable.v1','availability.not-found.v1','availability.server-error.v1')) THEN 'unavailable'
  WHEN bool_or({0} AND severity IN ('critical','significant') AND rule_id NOT IN ('availability.automation-blocked.v1','availability.access-restricted.v1')) THEN 'degraded'
  WHEN bool_or({0} AND rule_id IN ('availability.automation-blocked.v1','availability.access-restricted.v1')) THEN 'not_assessable' ELSE 'healthy' END"""
CHOSEN = """okc AS (SELECT * FROM cmp WHERE run_id = 'run-1' AND portal_a IN (SELECT {0} FROM {1}) AND portal_b IN (SELECT {0} FROM {1})
    AND NOT EXISTS (SELECT 1 FROM cref c LEFT JOIN art a ON a.artifact_id = c.ref WHERE c.comparison_id = cmp.comparison_id AND NOT coalesce(a.reviewed, false))),
  chosen AS (SELECT portal_id, min(comparison_id) AS comparison_id, arg_min(conclusion, comparison_id) AS conclusion FROM (
    SELECT portal_a AS portal_id, comparison_id, conclusion FROM okc UNION ALL SELECT portal_b, comparison_id, conclusion FROM okc WHERE portal_a <> portal_b) GROUP BY 1)"""
COVER = """pc AS (SELECT portal_id, count(*) AS pages_attempted, count(*) FILTER (error_code IS NULL) AS pages_observed, bool_or(fetch_mode = 'browser') AS browser FROM b2 GROUP BY 1),
  lc AS (SELECT portal_id, count(*) AS links_checked FROM b3 GROUP BY 1)"""
PUB = "review_status IN ('reviewed', 'not_assessable')"
NOTE = """CASE WHEN coalesce(pages_attempted, 0) = 0 THEN 'No pages were attempted for this portal in the referenced crawl run.'
  ELSE pages_observed || ' of ' || pages_attempted || ' attempted page check(s) returned a response; ' || coalesce(links_checked, 0) || ' link(s) checked'
    || CASE WHEN browser THEN '; browser rendering fallback was used for at least one page' ELSE '' END || '.' END"""
ASSESS = f"""{FINDINGS}, {B7}, {CHOSEN.format('portal_id', 'portals')}, {COVER},
  per AS (SELECT portal_id, {HEALTH_SQL.format("review_status = 'reviewed'")} AS technical_health,
    count(*) FILTER ({PUB} AND severity = 'critical') AS critical_count, count(*) FILTER ({PUB} AND severity = 'significant') AS significant_count,
    count(*) FILTER ({PUB} AND severity = 'advisory') AS advisory_count, count(*) FILTER ({PUB}) AS reviewed_finding_count,
    coalesce(arg_min(suggested_action, {ACT_RANK}) FILTER ({PUB}), 'maintain') AS suggested_action,
    coalesce(max(last_observed_at) FILTER ({PUB}), '2024-02-01 00:00:00') AS last_checked_at FROM fnd GROUP BY 1),
  asm AS (SELECT p.portal_id, p.name, p.canonical_url, p.department, p.portal_type, p.official_status, p.host, technical_health,
    CASE WHEN conclusion IS NULL THEN 'not_reviewed' WHEN conclusion IN ('possible_overlap', 'distinct') THEN conclusion ELSE 'unclear' END AS continuing_role,
    suggested_action, critical_count, significant_count, advisory_count, reviewed_finding_count, coalesce(pages_attempted, 0) AS pages_attempted,
    coalesce(pages_observed, 0) AS pages_observed, coalesce(links_checked, 0) AS links_checked, coalesce(browser, false) AS browser_fallback_used,
    {NOTE} AS coverage_note, last_checked_at, 'run-1' AS audit_run_id
    FROM portals p JOIN per USING (portal_id) LEFT JOIN pc USING (portal_id) LEFT JOIN lc USING (portal_id) LEFT JOIN chosen USING (portal_id))"""
ASM = f"WITH {ASSESS} "

# Rules together ----------------------------------------------------------------


@query("dv01_portal_health", f"""WITH {FINDINGS} SELECT p.portal_id, p.name, coalesce(h.health, 'healthy') AS health, coalesce(c, 0) AS critical_count,
  coalesce(s, 0) AS significant_count, coalesce(a, 0) AS advisory_count FROM portals p LEFT JOIN (SELECT portal_id, {HEALTH_SQL.format('true')} AS health,
  count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'significant') AS s, count(*) FILTER (severity = 'advisory') AS a FROM fnd GROUP BY 1) h USING (portal_id)""")
def dv01(spark, sf):
    portals = beds.portals(spark, sf)
    health = rollup.portal_health(portals, rule_severities(rq.context(spark, sf)))
    return health.join(portals.select("portal_id", "name"), "portal_id").orderBy(
        checks.rank(F.col("health"), checks.HEALTH_ORDER), "name")


@query("se02_all_findings", f"WITH {FINDINGS} SELECT rule_id, severity, count(*) AS findings, count(DISTINCT portal_id) AS portals FROM fnd GROUP BY 1, 2")
def se02(spark, sf):
    return rule_severities(rq.context(spark, sf)).groupBy("rule_id", "severity").agg(
        F.count("*").alias("findings"), F.count_distinct("portal_id").alias("portals"))


@query("ru16_materialised_findings", f"""WITH {FINDINGS} SELECT portal_id, rule_id, finding_id, 'evidence-' || finding_id || '-1' AS evidence_refs,
  'run-1' AS run_id, false AS privacy_reviewed, 64 AS digest_chars FROM fnd""")
def ru16(spark, sf):
    records, artifacts = run_findings(spark, sf)
    kept = artifacts.select("finding_id", "privacy_reviewed", F.length("content_digest").alias("digest_chars"))
    return plain(records.join(kept, "finding_id"), "portal_id", "rule_id", "finding_id", "evidence_refs", "run_id", "privacy_reviewed", "digest_chars")


@query("rv02_unresolved_evidence", f"WITH {FINDINGS} SELECT finding_id, 'evidence-' || finding_id || '-1' AS ref FROM fnd WHERE portal_id % 7 = 3")
def rv02(spark, sf):
    records, artifacts = run_findings(spark, sf)
    return review.unresolved_evidence(records, artifacts.filter("portal_id % 7 <> 3"))


@query("fn34_entry_evidence", f"""WITH {B2}, {PORTALS}, {ENTRY} SELECT portal_id, seq, observation_id, rule_id,
  concat_ws(', ', 'attempt ' || attempt, 'checkedAt ' || checked_at, 'fetchMode ' || fetch_mode, 'httpStatus ' || http_status, 'errorCode ' || error_code) AS observation_summary
  FROM (SELECT entry.*, unnest(list_filter([CASE WHEN {rq.FAILED} THEN 'availability.unavailable.v1' END, CASE WHEN {rq.SERVER} THEN 'availability.server-error.v1' END,
    CASE WHEN {rq.MISSING} THEN 'availability.not-found.v1' END, CASE WHEN error_code = 'AUTOMATION_BLOCKED' THEN 'availability.automation-blocked.v1' END,
    CASE WHEN {rq.RESTRICTED} THEN 'availability.access-restricted.v1' END,
    CASE WHEN error_code IN ('TLS_CERT_EXPIRED','TLS_HOST_MISMATCH') THEN 'https.certificate-failure.v1' END], lambda x: x IS NOT NULL)) AS rule_id FROM entry)""")
def fn34(spark, sf):
    return entry_evidence(rq.context(spark, sf))


@query("ru07_source_pages", f"""WITH {B3} SELECT portal_id, destination, source_page, count(*) AS link_rows, CAST(max(attempts) AS INTEGER) AS attempts
  FROM b3 WHERE status IN ('fail', 'not_assessable') GROUP BY 1, 2, 3""")
def ru07_sources(spark, sf):
    return broken_link_sources(beds.link_observations(spark, sf))


@query("ag02_broken_groups", f"""WITH {B3} SELECT portal_id, destination, count(DISTINCT source_page) AS source_pages, count(*) AS link_rows, bool_or(attempts > 1) AS retried,
  CAST(min(checked_at) AS VARCHAR) AS first_checked, CAST(max(checked_at) AS VARCHAR) AS last_checked FROM b3 WHERE status IN ('fail', 'not_assessable') GROUP BY 1, 2""")
def ag02(spark, sf):
    from webestate.operators.rules.links import broken_destinations

    return plain(broken_destinations(beds.link_observations(spark, sf)).drop("codes"))


@query("ag03_effective_attempts", f"""WITH {B2}, {PORTALS}, {ENTRY} SELECT portal_id,
  greatest(count(*) FILTER ({rq.FAILED}), coalesce(max(attempt) FILTER ({rq.FAILED}), 0)) AS failed_attempts,
  greatest(count(*) FILTER ({rq.SERVER}), coalesce(max(attempt) FILTER ({rq.SERVER}), 0)) AS server_attempts FROM entry GROUP BY 1""")
def ag03(spark, sf):
    return rq.context(spark, sf).entry.select(
        "portal_id", F.expr(effective_attempts("failed")).alias("failed_attempts"), F.expr(effective_attempts("server")).alias("server_attempts"))


@query("ag04_crawl_coverage", f"""WITH {B2}, {B3}, {COVER} SELECT portal_id, coalesce(pages_attempted, 0) AS pages_attempted, coalesce(pages_observed, 0) AS pages_observed,
  coalesce(links_checked, 0) AS links_checked, coalesce(browser, false) AS browser_fallback_used, {NOTE} AS coverage_note FROM pc FULL JOIN lc USING (portal_id)""")
def ag04(spark, sf):
    return rollup.crawl_coverage(beds.page_observations(spark, sf), beds.link_observations(spark, sf))


@query("ag05_coverage_facts", f"""WITH {B2}, {SKIPS} SELECT portal_id, coalesce(pages, 0) AS pages_observed, coalesce(n, 0) AS skipped, coalesce(robots, 0) AS robots_skips, coalesce(budget, false) AS budget_cut,
  coalesce(deep, false) AS depth_reached FROM (SELECT portal_id, count(DISTINCT requested_url) AS pages FROM b2 GROUP BY 1) FULL JOIN (SELECT portal_id, count(*) AS n,
  count(*) FILTER (reason ILIKE '%robots%') AS robots, bool_or(regexp_matches(reason, 'max ?pages|budget', 'i')) AS budget, bool_or(regexp_matches(reason, 'max ?depth', 'i')) AS deep FROM skips GROUP BY 1) USING (portal_id)""")
def ag05(spark, sf):
    return rq.context(spark, sf).coverage.select("portal_id", "pages_observed", "skipped", "robots_skips", "budget_cut", "depth_reached")


@query("ag06_severity_per_portal", f"""WITH {FINDINGS} SELECT portal_id, count(*) FILTER (severity = 'critical') AS critical_count,
  count(*) FILTER (severity = 'significant') AS significant_count, count(*) FILTER (severity = 'advisory') AS advisory_count FROM fnd GROUP BY 1""")
def ag06(spark, sf):
    return rule_severities(rq.context(spark, sf)).groupBy("portal_id").agg(*rollup.severity_count_columns())


@query("ag07_health_counts", ASM + """SELECT technical_health, (SELECT count(*) FROM asm WHERE asm.technical_health = v.technical_health) AS portals
  FROM (VALUES ('healthy'), ('degraded'), ('unavailable'), ('not_assessable')) v(technical_health)""")
def ag07(spark, sf):
    return rollup.health_counts(assessments(spark, sf))


@query("ag08_severity_counts", ASM + """SELECT 'critical' AS severity, CAST(sum(critical_count) AS BIGINT) AS findings FROM asm UNION ALL
  SELECT 'significant', CAST(sum(significant_count) AS BIGINT) FROM asm UNION ALL SELECT 'advisory', CAST(sum(advisory_count) AS BIGINT) FROM asm""")
def ag08(spark, sf):
    return rollup.severity_counts(assessments(spark, sf))


@query("ag09_action_counts", ASM + """SELECT suggested_action, (SELECT count(*) FROM asm WHERE asm.suggested_action = v.suggested_action) AS portals
  FROM (VALUES ('maintain'), ('repair'), ('review_consolidation'), ('review_retirement'), ('manual_assessment')) v(suggested_action)""")
def ag09(spark, sf):
    return rollup.action_counts(assessments(spark, sf))


@query("ag11_findings_by_category", f"""WITH {FINDINGS} SELECT portal_id, category, count(*) AS findings, CAST(min({SEV_RANK}) AS INTEGER) AS first_rank,
  arg_min(finding_id, ({SEV_RANK}) || finding_id) AS first_finding_id FROM fnd WHERE {PUB} GROUP BY 1, 2""")
def ag11(spark, sf):
    return publish.findings_by_category(run_findings(spark, sf)[0])


@query("ag12_departments", f"WITH {PORTALS} SELECT DISTINCT coalesce(nullif(trim(department), ''), 'Unspecified') AS department FROM portals")
def ag12(spark, sf):
    return publish.department_options(beds.portals(spark, sf))


STATUS = """st AS (SELECT portal_id, CASE WHEN arg_min(error_code IS NOT NULL, seq) THEN 'failed' WHEN bool_or(error_code IS NOT NULL) THEN 'partial'
  ELSE 'succeeded' END AS status FROM b2 GROUP BY 1)"""


@query("ag13_portal_status", f"WITH {B2}, {STATUS} SELECT portal_id, status FROM st")
def ag13(spark, sf):
    return rollup.portal_run_status(beds.page_observations(spark, sf)).select("portal_id", "status")


@query("ag14_run_status", f"""WITH {B2}, {STATUS} SELECT count(*) AS portal_count, count(*) FILTER (status = 'succeeded') AS portals_succeeded,
  count(*) FILTER (status = 'failed') AS portals_failed, count(*) FILTER (status = 'partial') AS portals_partial,
  CASE WHEN count(*) > 0 AND bool_and(status = 'succeeded') THEN 'completed' WHEN count(*) FILTER (status = 'succeeded') = 0 THEN 'failed' ELSE 'partial' END AS status FROM st""")
def ag14(spark, sf):
    totals = rollup.run_totals(rollup.portal_run_status(beds.page_observations(spark, sf)))
    return totals.select("portal_count", "portals_succeeded", "portals_failed", "portals_partial", "status")


@query("ag15_urgent_action", f"WITH {FINDINGS} SELECT portal_id, arg_min(suggested_action, {ACT_RANK}) AS suggested_action FROM fnd WHERE {PUB} GROUP BY 1")
def ag15(spark, sf):
    return publish.publishable_findings(run_findings(spark, sf)[0]).groupBy("portal_id").agg(
        rollup.most_urgent_action().alias("suggested_action"))


@query("ag16_last_checked", f"WITH {FINDINGS} SELECT portal_id, coalesce(max(last_observed_at) FILTER ({PUB}), '2024-02-01 00:00:00') AS last_checked_at FROM fnd GROUP BY 1")
def ag16(spark, sf):
    return plain(assessments(spark, sf), "portal_id", "last_checked_at")


@query("ag17_publication_summary", ASM + f""", st0 AS (SELECT min(checked_at) AS lo, max(checked_at) AS hi FROM b2) SELECT 'run-1' AS run_id, '2024-02-02 00:00:00' AS published_at,
  (SELECT CAST(hi AS VARCHAR) FROM st0) AS audit_date, '1.0.0' AS methodology_version, 'One run only.|No browser checks.|Ids are digests.' AS limitations, count(*) AS portal_count,
  (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT technical_health AS k, count(*) AS n FROM asm GROUP BY 1)) AS health,
  'advisory=' || sum(advisory_count) || ',critical=' || sum(critical_count) || ',significant=' || sum(significant_count) AS severity,
  (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT suggested_action AS k, count(*) AS n FROM asm GROUP BY 1)) AS actions FROM asm""")
def ag17(spark, sf):
    def text(name):
        return F.array_join(F.array_sort(F.transform(
            F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")

    s = rollup.publication_summary(assessments(spark, sf), audit_run(spark, sf), "2024-02-02 00:00:00", ["Ids are digests."])
    return plain(s.select(
        "run_id", "published_at", "audit_date", "methodology_version", "limitations", "portal_count",
        text("technical_health_counts").alias("health"), text("severity_counts").alias("severity"), text("suggested_action_counts").alias("actions")))


@query("dv02_reviewed_health", f"WITH {FINDINGS} SELECT p.portal_id, coalesce(h, 'healthy') AS health FROM portals p LEFT JOIN (SELECT portal_id, {HEALTH_SQL.format('true')} AS h FROM fnd WHERE review_status = 'reviewed' GROUP BY 1) USING (portal_id)")
def dv02(spark, sf):
    return rollup.portal_health(
        beds.portals(spark, sf), run_findings(spark, sf)[0].filter("review_status = 'reviewed'")).select("portal_id", "health")


@query("dv06_assessments", ASM + "SELECT " + ", ".join(ASSESSMENT_COLUMNS) + " FROM asm")
def dv06(spark, sf):
    return plain(assessments(spark, sf), *ASSESSMENT_COLUMNS)


@query("jn04_scoped_portals", f"WITH {B2}, {PORTALS} SELECT portal_id, name FROM portals WHERE portal_id IN (SELECT portal_id FROM b2)")
def jn04(spark, sf):
    from webestate.operators.rules import scoped_portals

    return scoped_portals(beds.portals(spark, sf), beds.page_observations(spark, sf)).select("portal_id", "name")


@query("jn03_official_portals", f"WITH {PORTALS} SELECT portal_id FROM portals WHERE source_type IN ('official_directory', 'official_page')")
def jn03(spark, sf):
    from webestate.operators.rules.links import officially_sourced

    return officially_sourced(beds.portals(spark, sf), beds.portal_sources(spark, sf))


@query("jn05_portal_facts", f"""WITH {B2}, {B3}, {SKIPS}, {PORTALS} SELECT portal_id, coalesce(a, 0) AS page_rows, coalesce(b, 0) AS link_rows, coalesce(c, 0) AS skip_rows FROM portals
  LEFT JOIN (SELECT portal_id, count(*) AS a FROM b2 GROUP BY 1) USING (portal_id) LEFT JOIN (SELECT portal_id, count(*) AS b FROM b3 GROUP BY 1) USING (portal_id)
  LEFT JOIN (SELECT portal_id, count(*) AS c FROM skips GROUP BY 1) USING (portal_id)""")
def jn05(spark, sf):
    out = beds.portals(spark, sf).select("portal_id")
    for name, facts in (("page_rows", beds.page_observations), ("link_rows", beds.link_observations), ("skip_rows", beds.skip_log)):
        out = out.join(facts(spark, sf).groupBy("portal_id").agg(F.count("*").alias(name)), "portal_id", "left")
    return out.fillna(0)


@query("flt01_entry_rows", f"WITH {B2}, {PORTALS}, {ENTRY} SELECT portal_id, observation_id, requested_url FROM entry")
def flt01(spark, sf):
    return rq.context(spark, sf).entry_rows.select("portal_id", "observation_id", "requested_url")


@query("wn01_first_last_check", f"""WITH {B2} SELECT portal_id, arg_min(observation_id, seq) AS first_observation, arg_max(observation_id, seq) AS last_observation,
  arg_max(http_status IS NULL, seq) AS last_without_status FROM b2 GROUP BY 1""")
def wn01(spark, sf):
    return beds.page_observations(spark, sf).groupBy("portal_id").agg(
        F.min_by("observation_id", "seq").alias("first_observation"), F.max_by("observation_id", "seq").alias("last_observation"),
        F.max_by(F.col("http_status").isNull(), "seq").alias("last_without_status"))


# Read side ---------------------------------------------------------------------


@query("flt03_publishable", f"WITH {FINDINGS} SELECT finding_id, CAST({SEV_RANK} AS INTEGER) AS severity_rank FROM fnd WHERE {PUB}")
def flt03(spark, sf):
    return publish.publishable_findings(run_findings(spark, sf)[0]).select("finding_id", "severity_rank")


@query("flt04_facets", ASM + """SELECT portal_id, name, technical_health FROM asm WHERE technical_health = 'degraded' AND suggested_action = 'repair' AND significant_count > 0
  AND portal_type = 'service' AND technical_health <> 'not_assessable'""")
def flt04(spark, sf):
    facets = publish.Facets(health="degraded", action="repair", severity="significant", portal_type="service", assessable="assessable")
    return publish.filter_inventory(assessments(spark, sf), facets).select("portal_id", "name", "technical_health")


@query("flt05_search", f"""WITH {PORTALS} SELECT portal_id, name FROM portals WHERE contains(lower(name || ' ' || coalesce(department, '') || ' ' || canonical_url || ' ' || host || ' http://' || host || '/'), 'p1')""")
def flt05(spark, sf):
    return publish.filter_inventory(beds.portals(spark, sf), publish.Facets(q="  P1 ")).select("portal_id", "name")


@query("tk01_priority", f"""WITH {FINDINGS} SELECT finding_id, portal_id, name AS portal_name, severity, last_observed_at FROM (SELECT * FROM fnd WHERE review_status = 'reviewed'
  ORDER BY {SEV_RANK}, CAST(last_observed_at AS TIMESTAMP) DESC, finding_id LIMIT 5) JOIN portals USING (portal_id)""")
def tk01(spark, sf):
    return plain(publish.priority_findings(run_findings(spark, sf)[0], beds.portals(spark, sf)),
                 "finding_id", "portal_id", "portal_name", "severity", "last_observed_at")


@query("tk02_critical", f"WITH {FINDINGS} SELECT finding_id, portal_id, title FROM fnd WHERE severity = 'critical'")
def tk02(spark, sf):
    return publish.critical_findings(run_findings(spark, sf)[0]).select("finding_id", "portal_id", "title")


@query("tk03_directory_mismatches", f"""WITH {FINDINGS}, hit AS (SELECT * FROM fnd WHERE category = 'directory_mismatch' AND review_status = 'reviewed')
  SELECT * FROM (SELECT 'shown' AS part, finding_id AS k, portal_id AS n FROM hit ORDER BY portal_id, finding_id LIMIT 5)
  UNION ALL SELECT 'total', '', count(*) FROM hit UNION ALL SELECT 'hidden', '', count(*) - least(count(*), 5) FROM hit""")
def tk03(spark, sf):
    first, totals = publish.directory_mismatches(run_findings(spark, sf)[0])
    shown = first.select(F.lit("shown").alias("part"), F.col("finding_id").alias("k"), F.col("portal_id").alias("n"))
    return shown.unionByName(totals.unpivot([], ["total", "hidden"], "part", "n").withColumn("k", F.lit("")))


@query("tk04_not_assessable", ASM + "SELECT portal_id, name, coverage_note FROM asm WHERE technical_health = 'not_assessable'")
def tk04(spark, sf):
    return publish.not_assessable_portals(assessments(spark, sf))


@query("tk05_quick_switch", f"WITH {PORTALS} SELECT portal_id, name, host FROM portals WHERE portal_id <> 3 AND (contains(lower(name), '0000') OR contains(host, '0000')) ORDER BY portal_id LIMIT 8")
def tk05(spark, sf):
    return publish.quick_switch(beds.portals(spark, sf), " 0000", 3).select("portal_id", "name", "host")


@query("tk07_headline", ASM + f""", w AS (SELECT portal_id, CASE WHEN min({SEV_RANK}) <= 1 THEN arg_min(finding_id, ({SEV_RANK}) || finding_id) END AS finding_id,
    count(*) FILTER (category = 'broken_link') AS broken FROM fnd WHERE {PUB} GROUP BY 1)
  SELECT a.portal_id, w.finding_id, CASE WHEN w.finding_id IS NOT NULL AND length(w.finding_id) > 0 AND (SELECT (length(summary) + portal_id) % 3 <> 0 FROM fnd f WHERE f.finding_id = w.finding_id)
    THEN 'evidence-' || w.finding_id || '-1' END AS artifact_id,
    coalesce(broken, 0) AS broken_destinations, links_checked, CASE WHEN links_checked > 0 THEN round(least(coalesce(broken, 0) / links_checked, 1.0), 6) ELSE 0.0 END AS broken_share
  FROM asm a LEFT JOIN w USING (portal_id)""")
def tk07(spark, sf):
    findings = stored_findings(spark, sf)
    evidence = findings.filter((F.length("summary") + F.col("portal_id")) % 3 != 0).select(
        "finding_id", F.posexplode("evidence_refs").alias("pos", "artifact_id"))
    return publish.headline(assessments(spark, sf, findings), findings, evidence)


for _key, _order in {
    "name": "name, portal_id",
    "health": "CASE technical_health WHEN 'unavailable' THEN 0 WHEN 'degraded' THEN 1 WHEN 'not_assessable' THEN 2 ELSE 3 END, portal_id",
    "severity": "CASE WHEN critical_count > 0 THEN 0 WHEN significant_count > 0 THEN 1 WHEN advisory_count > 0 THEN 2 ELSE 3 END, portal_id",
    "lastChecked": "last_checked_at DESC, portal_id",
}.items():
    # All rows; the order itself is tested apart.
    @query(f"so01_by_{_key.lower()}", ASM + f"SELECT portal_id, name, technical_health FROM asm ORDER BY {_order}")
    def _so01(spark, sf, key=_key):
        return publish.sort_inventory(assessments(spark, sf), key).select("portal_id", "name", "technical_health")


@query("fn33_highest_severity", ASM + """SELECT portal_id, CASE WHEN critical_count > 0 THEN 'critical' WHEN significant_count > 0 THEN 'significant' WHEN advisory_count > 0 THEN 'advisory' END AS highest_severity,
  critical_count + significant_count + advisory_count AS reviewed_findings FROM asm""")
def fn33(spark, sf):
    c, s, a = (F.col(f"{x}_count") for x in checks.SEVERITY)
    return assessments(spark, sf).select(
        "portal_id", checks.highest_severity(c, s, a).alias("highest_severity"), (c + s + a).alias("reviewed_findings"))


# Exports -------------------------------------------------------------------------

_CSV = {
    "portalId": "CAST(portal_id AS VARCHAR)", "name": "name", "canonicalUrl": "canonical_url", "department": "coalesce(department, '')", "portalType": "portal_type",
    "officialStatus": "official_status", "technicalHealth": "technical_health", "continuingRole": "continuing_role", "suggestedAction": "suggested_action",
    "criticalFindingCount": "CAST(critical_count AS VARCHAR)", "significantFindingCount": "CAST(significant_count AS VARCHAR)", "advisoryFindingCount": "CAST(advisory_count AS VARCHAR)",
    "reviewedFindingCount": "CAST(reviewed_finding_count AS VARCHAR)", "pagesAttempted": "CAST(pages_attempted AS VARCHAR)", "pagesObserved": "CAST(pages_observed AS VARCHAR)",
    "linksChecked": "CAST(links_checked AS VARCHAR)", "browserFallbackUsed": "CAST(browser_fallback_used AS VARCHAR)", "coverageNote": "coverage_note",
    "lastCheckedAt": "last_checked_at", "auditRunId": "audit_run_id",
}


@query("snk02_flat_export", ASM + "SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in _CSV.items()) + " FROM asm")
def snk02(spark, sf):
    """The written file, read back."""
    path = scratch_path(spark, "csv-export")
    snapshots.export_csv(assessments(spark, sf), path)
    rows = spark.read.option("header", True).option("lineSep", "\r\n").option("quote", '"').option("escape", '"').csv(path)
    return rows.fillna("")


@query("snk04_portals_export", ASM + """SELECT portal_id AS id, name, canonical_url AS "canonicalUrl", department, portal_type AS "portalType", official_status AS "officialStatus",
  technical_health AS "technicalHealth", continuing_role AS "continuingRole", suggested_action AS "suggestedAction", critical_count AS "criticalFindingCount",
  significant_count AS "significantFindingCount", advisory_count AS "advisoryFindingCount", last_checked_at AS "lastCheckedAt" FROM asm""")
def snk04(spark, sf):
    return plain(publish.portal_rows(assessments(spark, sf)))


@query("snk05_findings_export", f"""WITH {FINDINGS} SELECT portal_id AS "portalId", finding_id AS "findingId", severity, category, title, summary, confidence, review_status AS "reviewStatus",
  first_observed_at AS "firstObservedAt", last_observed_at AS "lastObservedAt", affected_urls AS "affectedUrls" FROM fnd WHERE {PUB}""")
def snk05(spark, sf):
    return plain(publish.finding_rows(run_findings(spark, sf)[0]))


@query("snk06_run_export", f"""WITH {B2}, {STATUS} SELECT 'run-1' AS "auditRunId", 'estate' AS geography, (SELECT CAST(min(checked_at) AS VARCHAR) FROM b2) AS "startedAt",
  (SELECT CAST(max(checked_at) AS VARCHAR) FROM b2) AS "completedAt", CASE WHEN bool_and(status = 'succeeded') THEN 'completed' WHEN count(*) FILTER (status = 'succeeded') = 0 THEN 'failed' ELSE 'partial' END AS status,
  '1.0.0' AS "methodologyVersion", count(*) AS "portalCount", count(*) FILTER (status = 'succeeded') AS "portalsSucceeded", count(*) FILTER (status = 'failed') AS "portalsFailed",
  count(*) FILTER (status = 'partial') AS "portalsPartial", 'One run only.|No browser checks.' AS limitations, '2024-02-02 00:00:00' AS "generatedAt" FROM st""")
def snk06(spark, sf):
    return plain(publish.run_rows(audit_run(spark, sf), "2024-02-02 00:00:00"))


@query("snk07_report", ASM + """SELECT part, k, v FROM (
  SELECT 'health' AS part, technical_health AS k, CAST(count(*) AS VARCHAR) AS v FROM asm GROUP BY 2 UNION ALL
  SELECT 'actions', suggested_action, CAST(count(*) AS VARCHAR) FROM asm GROUP BY 2 UNION ALL
  SELECT 'severity', 'critical', CAST(sum(critical_count) AS VARCHAR) FROM asm UNION ALL SELECT 'severity', 'significant', CAST(sum(significant_count) AS VARCHAR) FROM asm UNION ALL
  SELECT 'severity', 'advisory', CAST(sum(advisory_count) AS VARCHAR) FROM asm UNION ALL
  SELECT 'critical', finding_id, name || ': ' || title FROM fnd JOIN portals USING (portal_id) WHERE severity = 'critical' AND review_status = 'reviewed' UNION ALL
  SELECT 'limitations', CAST(i AS VARCHAR), (['One run only.', 'No browser checks.', 'Ids are digests.'])[i + 1] FROM range(3) t(i) UNION ALL
  SELECT 'portals', CAST(portal_id AS VARCHAR), technical_health || '/' || continuing_role || '/' || suggested_action FROM asm UNION ALL
  SELECT 'run', 'run-1', CAST(count(*) AS VARCHAR) FROM asm)""")
def snk07(spark, sf):
    # A report reads the published tables of its run, so they are written first.
    findings = stored_findings(spark, sf)
    asm = materialise(assessments(spark, sf, findings), "assessments")
    summary = rollup.publication_summary(asm, audit_run(spark, sf), "2024-02-02 00:00:00", ["Ids are digests."])
    frames = publish.report_frames(summary, asm, findings.filter("review_status = 'reviewed'"))
    cells = {
        "run": ("run_id", "portal_count"), "health": ("status", "n"), "severity": ("severity", "n"), "actions": ("action", "n"),
        "critical": ("finding_id", F.concat("name", F.lit(": "), "title")), "limitations": ("pos", "limitation"),
        "portals": ("portal_id", F.concat_ws("/", "technical_health", "continuing_role", "suggested_action")),
    }
    out = None
    for part, (k, v) in cells.items():
        value = F.col(v) if isinstance(v, str) else v
        rows = frames[part].select(F.lit(part).alias("part"), F.col(k).cast("string").alias("k"), value.cast("string").alias("v"))
        out = rows if out is None else out.unionByName(rows)
    return out
