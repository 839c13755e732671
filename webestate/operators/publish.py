"""Read side of a published run: filters, search, top-k, sorts, exports and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webestate.functions.checks import HEALTH_ORDER, SEVERITY_ORDER, highest_severity, rank
from webestate.functions.text import csv_cell, department_label
from webestate.functions.urls import host_of

PUBLISHABLE = ("reviewed", "not_assessable")


def severity_rank(column: str | Column = "severity", missing: int | None = None) -> Column:
    return rank(F.col(column) if isinstance(column, str) else column, SEVERITY_ORDER, missing)


def publishable_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("review_status").isin(*PUBLISHABLE)).withColumn("severity_rank", severity_rank())


@dataclass(frozen=True)
class Facets:
    """Inventory filters; 'all' and blank switch one off."""

    q: str = ""
    health: str = "all"
    action: str = "all"
    severity: str = "all"
    department: str = "all"
    portal_type: str = "all"
    assessable: str = "all"


def search_predicate(query: str) -> Column:
    """Case-insensitive substring over name, department, addresses and host names."""
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    text = F.concat_ws(
        " ", "name", F.coalesce("department", F.lit("")), "canonical_url", "hostnames", "alternate_urls"
    )
    return F.lower(text).contains(needle)


def filter_inventory(assessments: DataFrame, facets: Facets) -> DataFrame:
    """All facets combine with AND; severity means at least one finding at that severity."""
    tests = [search_predicate(facets.q)]
    if facets.health != "all":
        tests.append(F.col("technical_health") == facets.health)
    if facets.action != "all":
        tests.append(F.col("suggested_action") == facets.action)
    if facets.severity != "all":
        tests.append(F.col(f"{facets.severity}_count") > 0)
    if facets.department != "all":
        tests.append(department_label(F.col("department")) == facets.department)
    if facets.portal_type != "all":
        tests.append(F.col("portal_type") == facets.portal_type)
    if facets.assessable != "all":
        clear = F.col("technical_health") != "not_assessable"
        tests.append(clear if facets.assessable == "assessable" else ~clear)
    for test in tests:
        assessments = assessments.filter(test)
    return assessments


def sort_inventory(assessments: DataFrame, key: str) -> DataFrame:
    """Sort by name (locale), health, severity or lastChecked; portal id breaks ties."""
    if key == "name":
        return assessments.orderBy(F.collate("name", "UNICODE"), "portal_id")
    if key == "health":
        return assessments.orderBy(rank(F.col("technical_health"), HEALTH_ORDER), "portal_id")
    if key == "severity":
        worst = highest_severity(F.col("critical_count"), F.col("significant_count"), F.col("advisory_count"))
        return assessments.orderBy(severity_rank(worst, missing=3), "portal_id")
    if key == "lastChecked":
        return assessments.orderBy(F.desc("last_checked_at"), "portal_id")
    return assessments


def department_options(assessments: DataFrame) -> DataFrame:
    """Distinct department labels, 'Unspecified' last."""
    labels = assessments.select(department_label(F.col("department")).alias("department")).distinct()
    return labels.orderBy(F.col("department") == "Unspecified", "department")


def priority_findings(findings: DataFrame, portals: DataFrame, limit: int = 5) -> DataFrame:
    """Most severe, most recently seen reviewed findings. Top-k first, then the name lookup."""
    ranked = findings.filter("review_status = 'reviewed'").withColumn("severity_rank", severity_rank())
    order = ("severity_rank", F.desc("last_observed_at"), "finding_id")
    top = ranked.orderBy(*order).limit(limit)
    return top.join(portals.select("portal_id", F.col("name").alias("portal_name")), "portal_id").orderBy(*order)


def critical_findings(findings: DataFrame) -> DataFrame:
    return findings.filter("severity = 'critical'").orderBy("finding_id")


def directory_mismatches(findings: DataFrame, shown: int = 5) -> tuple[DataFrame, DataFrame]:
    """First reviewed directory findings, and one row with the total and the hidden count."""
    hits = findings.filter("category = 'directory_mismatch' AND review_status = 'reviewed'")
    total = F.count("*")
    return (
        hits.orderBy("portal_id", "finding_id").limit(shown),
        hits.agg(total.alias("total"), (total - F.least(total, F.lit(shown))).alias("hidden")),
    )


def not_assessable_portals(assessments: DataFrame) -> DataFrame:
    return assessments.filter("technical_health = 'not_assessable'").select("portal_id", "name", "coverage_note")


def quick_switch(portals: DataFrame, query: str, current) -> DataFrame:
    """First 8 portals whose name or host contains the text; first 6 when it is blank."""
    rows = portals.filter(F.col("portal_id") != F.lit(current)).withColumn("host", host_of(F.col("canonical_url")))
    needle = query.strip().lower()
    if not needle:
        return rows.orderBy("portal_id").limit(6)
    hit = F.lower("name").contains(needle) | F.lower("host").contains(needle)
    return rows.filter(hit).orderBy("portal_id").limit(8)


def findings_by_category(findings: DataFrame, group: str = "portal_id") -> DataFrame:
    """Per portal and category: count and the place of the category's first finding,
    findings being taken most severe first."""
    place = F.struct(severity_rank().alias("r"), F.col("finding_id").alias("id"))
    per = publishable_findings(findings).groupBy(group, "category").agg(
        F.count("*").alias("findings"), F.min(place).alias("first")
    )
    return per.select(group, "category", "findings", F.col("first.r").alias("first_rank"), F.col("first.id").alias("first_finding_id"))


def headline(assessments: DataFrame, findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Headline finding of a portal, its first reviewed evidence, and the broken-link share.

    ``evidence`` holds (finding_id, pos, artifact_id) of reviewed artifacts only.
    """
    place = F.struct(severity_rank().alias("r"), F.col("finding_id").alias("id"))
    worst = publishable_findings(findings).groupBy("portal_id").agg(
        F.min(place).alias("first"), F.count_if(F.col("category") == "broken_link").alias("broken_destinations")
    )
    worst = worst.select(
        "portal_id", "broken_destinations",
        F.when(F.col("first.r") <= 1, F.col("first.id")).alias("finding_id"),
    )
    first_evidence = evidence.groupBy("finding_id").agg(F.min_by("artifact_id", "pos").alias("artifact_id"))
    links = F.col("links_checked")
    share = F.when(links > 0, F.least(F.col("broken_destinations") / links, F.lit(1.0))).otherwise(0.0)
    return (
        assessments.select("portal_id", "links_checked")
        .join(worst, "portal_id", "left").fillna({"broken_destinations": 0})
        .join(first_evidence, "finding_id", "left")
        .select("portal_id", "finding_id", "artifact_id", "broken_destinations", "links_checked", F.round(share, 6).alias("broken_share"))
    )


# The flat export columns, in order.
EXPORT_COLUMNS = {
    "portalId": "portal_id", "name": "name", "canonicalUrl": "canonical_url", "department": "department",
    "portalType": "portal_type", "officialStatus": "official_status", "technicalHealth": "technical_health",
    "continuingRole": "continuing_role", "suggestedAction": "suggested_action",
    "criticalFindingCount": "critical_count", "significantFindingCount": "significant_count",
    "advisoryFindingCount": "advisory_count", "reviewedFindingCount": "reviewed_finding_count",
    "pagesAttempted": "pages_attempted", "pagesObserved": "pages_observed", "linksChecked": "links_checked",
    "browserFallbackUsed": "browser_fallback_used", "coverageNote": "coverage_note",
    "lastCheckedAt": "last_checked_at", "auditRunId": "audit_run_id",
}
PORTAL_EXPORT = (
    "name", "canonicalUrl", "department", "portalType", "officialStatus", "technicalHealth", "continuingRole",
    "suggestedAction", "criticalFindingCount", "significantFindingCount", "advisoryFindingCount", "lastCheckedAt",
)


def csv_rows(assessments: DataFrame) -> DataFrame:
    """The 20 flat columns as guarded text, sorted by portal id."""
    return assessments.orderBy("portal_id").select(
        *(csv_cell(F.col(source)).alias(name) for name, source in EXPORT_COLUMNS.items())
    )


def portal_rows(assessments: DataFrame) -> DataFrame:
    return assessments.orderBy("portal_id").select(
        F.col("portal_id").alias("id"), *(F.col(EXPORT_COLUMNS[n]).alias(n) for n in PORTAL_EXPORT)
    )


def finding_rows(findings: DataFrame) -> DataFrame:
    return publishable_findings(findings).orderBy("portal_id", "finding_id").select(
        F.col("portal_id").alias("portalId"), F.col("finding_id").alias("findingId"), "severity", "category", "title",
        "summary", "confidence", F.col("review_status").alias("reviewStatus"), F.col("first_observed_at").alias("firstObservedAt"),
        F.col("last_observed_at").alias("lastObservedAt"), F.col("affected_urls").alias("affectedUrls"),
    )


def run_rows(run: DataFrame, generated_at: str) -> DataFrame:
    return run.select(
        F.col("run_id").alias("auditRunId"), "geography", F.col("started_at").alias("startedAt"),
        F.col("completed_at").alias("completedAt"), "status", F.col("methodology_version").alias("methodologyVersion"),
        F.col("portal_count").alias("portalCount"), F.col("portals_succeeded").alias("portalsSucceeded"),
        F.col("portals_failed").alias("portalsFailed"), F.col("portals_partial").alias("portalsPartial"), "limitations",
        F.lit(generated_at).alias("generatedAt"),
    )


def report_frames(summary: DataFrame, assessments: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
    """The seven tables behind a run report."""
    def counts(column: str, key: str) -> DataFrame:
        return summary.select(F.explode(column).alias(key, "n")).orderBy(key)

    return {
        "run": summary.select("run_id", "published_at", "audit_date", "methodology_version", "portal_count"),
        "health": counts("technical_health_counts", "status"),
        "severity": counts("severity_counts", "severity"),
        "actions": counts("suggested_action_counts", "action"),
        "critical": critical_findings(findings).join(assessments.select("portal_id", "name"), "portal_id").select(
            "finding_id", "name", "title", "summary").orderBy("finding_id"),
        "limitations": summary.select(F.posexplode("limitations").alias("pos", "limitation")).orderBy("pos"),
        "portals": assessments.orderBy("portal_id").select(
            "portal_id", "name", "technical_health", "continuing_role", "suggested_action",
            "critical_count", "significant_count", "advisory_count"),
    }
