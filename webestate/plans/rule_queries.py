"""Queries over the audit rules, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webestate.operators.rules import REGISTRY, Rule, RuleContext, run_rules
from webestate.operators.rules.availability import text
from webestate.operators.rules.base import draft, emit
from webestate.plans import beds
from webestate.plans.catalog import plain, query
from webestate.plans.sql_beds import B2, B3, ENTRY, PORTALS, SKIPS

COLUMNS = (
    "portal_id", "rule_id", "subject", "category", "title", "summary", "severity", "confidence", "check_status",
    "review_status", "first_observed_at", "last_observed_at", "affected_urls", "suggestion_rule_id", "suggested_action",
)


def context(spark: SparkSession, sf: str) -> RuleContext:
    return RuleContext(
        run_id=beds.RUN_ID, analyzed_at=beds.ANALYZED_AT,
        portals=beds.portals(spark, sf), sources=beds.portal_sources(spark, sf),
        pages=beds.page_observations(spark, sf), links=beds.link_observations(spark, sf), skips=beds.skip_log(spark, sf),
    )


def only(*rule_ids: str):
    checks = [{"rule_id": r} for r in rule_ids]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return plain(run_rules(context(spark, sf), checks).filter(f"rule_id = '{rule_ids[-1]}'"), *COLUMNS)

    return run


BASE = f"WITH {B2}, {PORTALS}, {ENTRY}"


def finding_select(source: str, **c: str) -> str:
    """SELECT list of one finding in the common column order."""
    values = {"subject": "''", "review_status": "'pending_review'", **c}
    return "SELECT portal_id, " + ", ".join(
        f"CAST({values[name]} AS VARCHAR) AS {name}" for name in COLUMNS[1:]
    ) + f" FROM {source}"


def entry_group(where: str) -> str:
    return f"""g AS (SELECT portal_id, any_value(canonical_url) AS url, greatest(count(*), max(attempt)) AS n, count(*) AS row_count,
      arg_min(http_status, seq) AS first_status, arg_min(coalesce(CAST(http_status AS VARCHAR), error_code), seq) AS shown, arg_min(error_code, seq) AS first_code,
      arg_min(checked_at, seq) AS lo, arg_max(checked_at, seq) AS hi,
      (SELECT count(*) FROM entry e2 WHERE e2.portal_id = entry.portal_id) AS entries,
      array_to_string(list_sort(list_distinct(list(strftime(checked_at, '%Y-%m-%d')))), ', ') AS dates
      FROM entry WHERE {where} GROUP BY portal_id)"""


FAILED = "error_code IN ('DNS_FAILURE','CONNECT_TIMEOUT','READ_TIMEOUT','TOO_MANY_REDIRECTS','INTERNAL_AUDIT_ERROR','SSRF_BLOCKED')"
SERVER = "error_code = 'HTTP_SERVER_ERROR'"
MISSING = "http_status IN (404, 410)"
SPAN = dict(first_observed_at="lo", last_observed_at="hi", affected_urls="url")
REPAIR = dict(suggestion_rule_id="'suggestion.repeatedly-unavailable.v1'", suggested_action="'repair'")
MANUAL = dict(suggestion_rule_id="'suggestion.manual-verification.v1'", suggested_action="'manual_assessment'")
MISMATCH = dict(suggestion_rule_id="'suggestion.directory-mismatch.v1'", suggested_action="'manual_assessment'")

RU01 = finding_select(
    "g WHERE n >= 3", rule_id="'availability.unavailable.v1'", category="'availability'", title="'Portal entry point unavailable'",
    summary="'Unavailable during ' || n || ' checks on ' || dates || '.'", severity="'critical'", confidence="'high'", check_status="'fail'", **SPAN, **REPAIR)
query("ru01_unavailable", f"{BASE}, {entry_group(FAILED)} {RU01}")(only("availability.unavailable.v1"))

RU02 = finding_select(
    "g WHERE n >= 2", rule_id="'availability.server-error.v1'", category="'availability'",
    title="CASE WHEN n > 2 THEN 'Sustained server errors on entry point' ELSE 'Repeated server errors on entry point' END",
    summary="'The entry page returned a server error (5xx) on ' || n || ' of ' || entries || ' check(s) (' || dates || ').'",
    severity="CASE WHEN n > 2 THEN 'critical' ELSE 'significant' END", confidence="'high'", check_status="'fail'", **SPAN, **REPAIR)
query("ru02_server_error", f"{BASE}, {entry_group(SERVER)} {RU02}")(only("availability.server-error.v1"))

RU03 = finding_select(
    "g WHERE n >= 2", rule_id="'availability.not-found.v1'", category="'availability'", title="'Entry URL not found'",
    summary="'The official entry URL returned ' || first_status || ' on ' || n || ' of ' || entries || ' check(s) (' || dates || ').'",
    severity="'critical'", confidence="'high'", check_status="'fail'", **SPAN, **REPAIR)
query("ru03_not_found", f"{BASE}, {entry_group(MISSING)} {RU03}")(only("availability.not-found.v1"))

RU04 = finding_select(
    "entry WHERE final_url IS NOT NULL AND regexp_extract(final_url, '//([^/]+)/', 1) <> 'p' || portal_id || '.example.org'",
    rule_id="'redirect.cross-domain.v1'", subject="observation_id", category="'availability'", title="'Redirect leaves the portal''s registered hosts'",
    summary="'The entry URL ' || requested_url || ' finally resolved to ' || final_url || ', outside the portal''s registered hostnames.'",
    severity="'advisory'", confidence="'medium'", check_status="'warning'", first_observed_at="checked_at", last_observed_at="checked_at",
    affected_urls="requested_url || '|' || final_url", **MISMATCH)
query("ru04_cross_domain", f"{BASE} {RU04}")(only("redirect.cross-domain.v1"))

RU05 = finding_select(
    "g", rule_id="'availability.automation-blocked.v1'", category="'availability'", title="'Automated check was blocked'",
    summary="'The automated crawler was blocked (bot-block or CAPTCHA) while checking ' || url || '; this is not evidence the page is broken for a human visitor.'",
    severity="'advisory'", confidence="'low'", check_status="'not_assessable'", review_status="'not_assessable'", **SPAN, **MANUAL)
query("ru05_automation_blocked", f"{BASE}, {entry_group('error_code = ' + chr(39) + 'AUTOMATION_BLOCKED' + chr(39))} {RU05}")(only("availability.automation-blocked.v1"))

RESTRICTED = "error_code = 'AUTH_REQUIRED' OR (error_code = 'HTTP_CLIENT_ERROR' AND http_status = 403)"
RU06 = finding_select(
    "g", rule_id="'availability.access-restricted.v1'", category="'availability'", title="'Entry page requires authentication or restricts access'",
    summary="'The entry page returned ' || shown || ' while checking ' || url || '; this may reflect a legitimate access restriction rather than a broken page.'",
    severity="'advisory'", confidence="'low'", check_status="'not_assessable'", **SPAN, **MANUAL)
query("ru06_access_restricted", f"{BASE}, {entry_group(RESTRICTED)} {RU06}")(only("availability.access-restricted.v1"))

BROKEN = """br AS (SELECT b3.portal_id, destination, count(DISTINCT source_page) AS pages, bool_or(attempts > 1) AS retried,
    min(checked_at) AS lo, max(checked_at) AS hi, array_to_string(list_sort(list_distinct(list(CASE WHEN status = 'fail' THEN CASE WHEN l_linenumber % 4 <> 2 THEN 'HTTP_CLIENT_ERROR' WHEN l_partkey % 2 = 0 THEN '404' ELSE '410' END ELSE status END))), ', ') AS codes,
    any_value(source_type) IN ('official_directory', 'official_page') AS official
  FROM b3 JOIN portals p ON p.portal_id = b3.portal_id WHERE status IN ('fail', 'not_assessable') GROUP BY b3.portal_id, destination)"""
RU07 = finding_select(
    "br", rule_id="'broken_link.repeated-failure.v1'", subject="destination", category="'broken_link'", title="'Broken link destination'",
    summary="'The destination ' || destination || ' failed from ' || pages || ' source page(s) on this portal (' || codes || ').'",
    severity="CASE WHEN official THEN 'critical' WHEN pages >= 3 THEN 'significant' ELSE 'advisory' END",
    confidence="CASE WHEN retried THEN 'high' ELSE 'medium' END", check_status="'fail'", first_observed_at="lo", last_observed_at="hi",
    affected_urls="destination", suggestion_rule_id="CASE WHEN official THEN 'suggestion.official-link-dead.v1' ELSE 'suggestion.broken-navigation.v1' END",
    suggested_action="'repair'")
query("ru07_broken_destinations", f"WITH {B3}, {PORTALS}, {BROKEN} {RU07}")(only("broken_link.repeated-failure.v1"))

RU08 = finding_select(
    "g", rule_id="'https.certificate-failure.v1'", category="'https'",
    title="CASE WHEN first_code = 'TLS_CERT_EXPIRED' THEN 'Certificate expired' ELSE 'Certificate hostname mismatch' END",
    summary="'Accessing ' || url || ' produced a certificate error (' || first_code || ') as observed by the client.'",
    severity="'significant'", confidence="'high'", check_status="'fail'", **SPAN, suggestion_rule_id="'suggestion.certificate-failure.v1'", suggested_action="'repair'")
query("ru08_certificate_failure", f"{BASE}, {entry_group('error_code IN (' + repr('TLS_CERT_EXPIRED') + ',' + repr('TLS_HOST_MISMATCH') + ')')} {RU08}")(only("https.certificate-failure.v1"))

RU09 = finding_select(
    "entry WHERE error_code IS NULL AND final_url LIKE 'http:%'",
    rule_id="'https.no-tls-upgrade.v1'", subject="observation_id", category="'https'", title="'Entry page is not served over HTTPS'",
    summary="'The final destination for ' || requested_url || ' (' || final_url || ') does not use HTTPS.'",
    severity="'advisory'", confidence="'medium'", check_status="'warning'", first_observed_at="checked_at", last_observed_at="checked_at",
    affected_urls="final_url", suggestion_rule_id="'suggestion.certificate-failure.v1'", suggested_action="'manual_assessment'")
query("ru09_no_tls_upgrade", f"{BASE} {RU09}")(only("https.no-tls-upgrade.v1"))

RU10 = finding_select(
    "g", rule_id="'freshness.no-signal.v1'", category="'freshness'", title="'No freshness signal detected'",
    summary="'No recent update signal was detected in the sampled pages.'", severity="'advisory'", confidence="'low'", check_status="'not_applicable'",
    first_observed_at="lo", last_observed_at="lo", affected_urls="url", suggestion_rule_id="'suggestion.potential-staleness.v1'", suggested_action="'manual_assessment'")
query("ru10_no_freshness_signal", f"{BASE}, {entry_group('error_code IS NULL')} {RU10}")(only("freshness.no-signal.v1"))

COVERAGE = """cov AS (SELECT p.portal_id, p.canonical_url AS url, coalesce(o.pages, 0) AS pages, coalesce(o.row_count, 0) AS row_count, coalesce(s.n, 0) AS n,
    coalesce(s.robots, 0) AS robots, coalesce(s.budget, false) AS budget, coalesce(s.deep, false) AS deep, o.lo, o.hi
  FROM portals p LEFT JOIN (SELECT portal_id, count(DISTINCT requested_url) AS pages, count(*) AS row_count, min(checked_at) AS lo, max(checked_at) AS hi FROM b2 GROUP BY 1) o ON o.portal_id = p.portal_id
  LEFT JOIN (SELECT portal_id, count(*) AS n, count(*) FILTER (reason ILIKE '%robots%') AS robots, bool_or(regexp_matches(reason, 'max ?pages|budget', 'i')) AS budget,
     bool_or(regexp_matches(reason, 'max ?depth', 'i')) AS deep FROM skips GROUP BY 1) s ON s.portal_id = p.portal_id
  WHERE o.portal_id IS NOT NULL OR s.portal_id IS NOT NULL)"""
RU11 = finding_select(
    "cov", rule_id="'crawl_coverage.summary.v1'", category="'crawl_coverage'", title="'Crawl coverage summary'",
    summary="""concat_ws(' ', pages || ' page(s) observed (configured maximum: 40).',
      CASE WHEN pages >= 40 OR budget THEN 'The per-portal page budget was reached; deeper coverage was not attempted.' END,
      CASE WHEN deep THEN 'The configured maximum crawl depth (2) was reached.' END,
      CASE WHEN robots > 0 THEN robots || ' URL(s) were not fetched because robots.txt disallowed them.' END,
      CASE WHEN n > 0 THEN n || ' URL(s) in total were not fetched this run (see evidence for reasons).' END)""",
    severity="'advisory'", confidence="'high'", check_status="CASE WHEN pages >= 40 OR budget OR deep OR robots > 0 THEN 'warning' ELSE 'not_applicable' END",
    review_status="'automated_observation'", first_observed_at="coalesce(lo, TIMESTAMP '2024-02-01 00:00:00')",
    last_observed_at="coalesce(hi, TIMESTAMP '2024-02-01 00:00:00')", affected_urls="url",
    suggestion_rule_id="'suggestion.no-action.v1'", suggested_action="'maintain'")
query("ru11_coverage_summary", f"WITH {B2}, {SKIPS}, {PORTALS}, {COVERAGE} {RU11}")(only("crawl_coverage.summary.v1"))

# Effective attempts of the three rules that can make an availability finding critical.
CRITICAL = f"""att AS (SELECT portal_id,
    greatest(count(*) FILTER ({FAILED}), coalesce(max(attempt) FILTER ({FAILED}), 0)) AS a1,
    greatest(count(*) FILTER ({SERVER}), coalesce(max(attempt) FILTER ({SERVER}), 0)) AS a2,
    greatest(count(*) FILTER ({MISSING}), coalesce(max(attempt) FILTER ({MISSING}), 0)) AS a3 FROM entry GROUP BY 1),
  crit AS (SELECT p.*, concat_ws(', ', CASE WHEN a1 >= 3 THEN 'availability.unavailable.v1' END, CASE WHEN a2 > 2 THEN 'availability.server-error.v1' END,
    CASE WHEN a3 >= 2 THEN 'availability.not-found.v1' END) AS rules FROM portals p JOIN att USING (portal_id))"""
RU12 = finding_select(
    "crit WHERE rules <> '' AND source_type = 'official_directory'", rule_id="'directory_mismatch.unavailable-destination.v1'", subject="source_id",
    category="'directory_mismatch'", title="'Directory entry points to an unavailable destination'",
    summary="'The official directory linked to a destination that returned an availability failure (' || rules || ').'",
    severity="'advisory'", confidence="'medium'", check_status="'fail'", first_observed_at="TIMESTAMP '2024-01-15 00:00:00'",
    last_observed_at="TIMESTAMP '2024-02-01 00:00:00'", affected_urls="source_url || '|' || canonical_url", **MISMATCH)
query("ru12_unavailable_destination", f"{BASE}, {CRITICAL} {RU12}")(only(
    "availability.unavailable.v1", "availability.server-error.v1", "availability.not-found.v1", "directory_mismatch.unavailable-destination.v1"))

DISAGREE = """dis AS (SELECT p.*, 'dir' || r_regionkey || '.example.org' AS lhost,
    (SELECT regexp_extract(arg_min(coalesce(final_url, ''), seq), '//([^/]+)/', 1) FROM entry e WHERE e.portal_id = p.portal_id) AS seen
  FROM portals p WHERE source_type = 'official_directory')"""
RU13 = finding_select(
    "dis", rule_id="'directory_mismatch.listed-vs-observed.v1'", subject="source_id", category="'directory_mismatch'",
    title="'Directory listing disagrees with observed destination'",
    summary="""'The official directory listing for this portal disagrees with what was observed: ' || concat_ws('; ',
      'the directory''s listed URL host (' || lhost || ') differs from the portal''s canonical URL host (' || host || ')',
      CASE WHEN seen <> '' THEN 'the directory''s listed URL host (' || lhost || ') differs from where the portal''s entry page was ultimately observed (' || seen || ')' END) || '.'""",
    severity="'advisory'", confidence="'low'", check_status="'warning'", first_observed_at="TIMESTAMP '2024-01-15 00:00:00'",
    last_observed_at="TIMESTAMP '2024-02-01 00:00:00'", affected_urls="source_url || '|' || canonical_url", **MISMATCH)
query("ru13_listed_vs_observed", f"{BASE}, {DISAGREE} {RU13}")(only("directory_mismatch.listed-vs-observed.v1"))

RU14 = finding_select(
    "portals WHERE official_status = 'verified' AND source_type <> 'official_directory'", rule_id="'directory_mismatch.official-portal-not-listed.v1'",
    category="'directory_mismatch'", title="'Verified portal absent from official directory'",
    summary="name || ' is a verified official portal but is not backed by any official_directory-typed source in this inventory.'",
    severity="'advisory'", confidence="'medium'", check_status="'warning'", first_observed_at="TIMESTAMP '2024-02-01 00:00:00'",
    last_observed_at="TIMESTAMP '2024-02-01 00:00:00'", affected_urls="canonical_url", **MISMATCH)
query("ru14_official_not_listed", f"WITH {PORTALS} {RU14}")(only("directory_mismatch.official-portal-not-listed.v1"))


# A rule from outside the package, run next to the built-in ones --------------------------


def unsteady_entry(ctx: RuleContext, parameters: dict, prior: str) -> str:
    """Entry pages that failed in some checks and answered in others."""
    return emit("failed_n > 0 AND clean_n > 0", draft(
        "availability.unsteady-entry.v1", "availability", "suggestion.manual-verification.v1",
        title="'Entry point answers unsteadily'",
        summary=text("{failed_n} of {entries} entry checks failed, {clean_n} answered; {n} earlier finding(s).", n=f"size({prior})"),
        severity="'advisory'", confidence="'low'", check_status="'warning'",
        first_observed_at="failed_first.checked_at", last_observed_at="failed_last", affected_urls="array(canonical_url)",
        limitations="array('One run only.')", evidence_type="'text_excerpt'", evidence_description="'counts'",
        evidence_source_url="canonical_url", related_observation_id="NULL", evidence_content="to_json(struct(failed_n, clean_n))",
    ))


UNSTEADY = Rule("availability.unsteady-entry.v1", "availability", "Mixed results on the entry page.", portal_findings=unsteady_entry)


@query("ux01_custom_rule", f"""{BASE}, u AS (SELECT portal_id, count(*) AS n, count(*) FILTER ({FAILED}) AS bad, count(*) FILTER (error_code IS NULL) AS good,
    greatest(count(*) FILTER ({FAILED}), coalesce(max(attempt) FILTER ({FAILED}), 0)) AS a FROM entry GROUP BY 1)
  SELECT portal_id, bad || ' of ' || n || ' entry checks failed, ' || good || ' answered; ' || CASE WHEN a >= 3 THEN 1 ELSE 0 END || ' earlier finding(s).' AS summary FROM u WHERE bad > 0 AND good > 0""")
def ux01(spark, sf):
    checks = [{"rule_id": "availability.unavailable.v1"}, {"rule_id": UNSTEADY.rule_id}]
    found = run_rules(context(spark, sf), checks, [*REGISTRY, UNSTEADY])
    return found.filter(f"rule_id = '{UNSTEADY.rule_id}'").select("portal_id", "summary")
