"""Broken-destination rule over link checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webestate.functions.checks import VERIFYING_SOURCE_TYPES
from webestate.operators.rules.availability import (
    certificate_failure, coverage_summary, no_freshness_signal, no_tls_upgrade, text,
)
from webestate.operators.rules.base import Rule, RuleContext, draft, findings_from, quoted, register_rule
from webestate.operators.rules.wording import SUMMARIES, TITLES

FAILURE_STATUSES = ("fail", "not_assessable")


def broken_destinations(links: DataFrame) -> DataFrame:
    """Failing links per (portal, destination): distinct source pages, retries, time span.

    Only failing rows reach the shuffle. A popular destination is first summed up per source page, and its distinct failures
    are found apart, so that no row carries a set. A failure is named by its error code, else its HTTP status, else its check status.
    """
    keys = ["portal_id", "destination"]
    http = F.col("http_status").cast("string") if "http_status" in links.columns else F.lit(None).cast("string")
    failing = links.filter(F.col("status").isin(*FAILURE_STATUSES))
    per_page = failing.groupBy(*keys, "source_page").agg(
        F.count("*").alias("n"), F.max(F.col("attempts") > 1).alias("again"), F.min("checked_at").alias("lo"), F.max("checked_at").alias("hi"))
    counts = per_page.groupBy(*keys).agg(
        F.count("source_page").alias("source_pages"), F.sum("n").alias("link_rows"), F.max("again").alias("retried"),
        F.min("lo").alias("first_checked"), F.max("hi").alias("last_checked"))
    kinds = failing.select(*keys, F.coalesce("error_code", http, "status").alias("code")).distinct()
    codes = kinds.groupBy(*(F.col(k).alias(f"code_{k}") for k in keys)).agg(F.array_sort(F.collect_list("code")).alias("codes"))
    same = [F.col(k).eqNullSafe(F.col(f"code_{k}")) for k in keys]
    return counts.join(codes, same).drop(*(f"code_{k}" for k in keys))


def officially_sourced(portals: DataFrame, sources: DataFrame) -> DataFrame:
    """Portals with at least one official directory or page among their sources."""
    refs = portals.select("portal_id", F.explode("source_refs").alias("source_id"))
    official = sources.filter(F.col("source_type").isin(*VERIFYING_SOURCE_TYPES))
    return refs.join(official, "source_id", "left_semi").select("portal_id").distinct()


def broken_links(ctx: RuleContext, parameters: dict) -> DataFrame:
    flags = ctx.portals.select("portal_id").join(
        officially_sourced(ctx.portals, ctx.sources).withColumn("official", F.lit(True)), "portal_id", "left"
    ).fillna({"official": False})
    groups = broken_destinations(ctx.links).join(flags, "portal_id")
    suggestion = "if(official, 'suggestion.official-link-dead.v1', 'suggestion.broken-navigation.v1')"
    return findings_from(groups, draft(
        "broken_link.repeated-failure.v1", "broken_link", suggestion, "repair",
        subject="destination", title=quoted(TITLES["broken_link"]),
        summary=text(SUMMARIES["broken_link"], codes="array_join(codes, ', ')"),
        severity="CASE WHEN official THEN 'critical' WHEN source_pages >= 3 THEN 'significant' ELSE 'advisory' END",
        confidence="if(retried, 'high', 'medium')", check_status="'fail'",
        first_observed_at="first_checked", last_observed_at="last_checked", affected_urls="array(CAST(destination AS string))",
        limitations="array(if(official, 'Raised because the portal has an official source, not because this page is one.', 'Based on the number of linking pages only.'))",
        evidence_type="'link_check_result'", evidence_source_url="destination", related_observation_id="NULL",
        evidence_description=text("{destination} failed link checks from {source_pages} source page(s)."),
        evidence_content="to_json(struct(destination, source_pages, link_rows, codes))",
    ))


def broken_link_sources(links: DataFrame) -> DataFrame:
    """The full detail behind the counts: each failing (portal, destination, source page)."""
    return links.filter(F.col("status").isin(*FAILURE_STATUSES)).groupBy(
        "portal_id", "destination", "source_page"
    ).agg(F.count("*").alias("link_rows"), F.max("attempts").alias("attempts"))


register_rule(Rule("broken_link.repeated-failure.v1", "broken_link", "Destinations that fail from one or more source pages.", evaluate=broken_links))
register_rule(Rule("https.certificate-failure.v1", "https", "Expired or mismatching certificate on the entry page.", portal_findings=certificate_failure))
register_rule(Rule("https.no-tls-upgrade.v1", "https", "The entry page ends on a destination without HTTPS.", row_finding=no_tls_upgrade))
register_rule(Rule("freshness.no-signal.v1", "freshness", "Records that no freshness signal was available.", portal_findings=no_freshness_signal))
register_rule(Rule("crawl_coverage.summary.v1", "crawl_coverage", "What a run did and did not cover for a portal.", portal_findings=coverage_summary))
