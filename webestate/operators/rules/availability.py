"""Availability, redirect, HTTPS, freshness and coverage rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webestate.functions.checks import observation_summary
from webestate.operators.rules.base import (
    ENTRY_GROUPS, MIN_SPACING_MINUTES, Rule, RuleContext, draft, effective_attempts, emit, findings_from, int_param, quoted, register_rule,
)
from webestate.operators.rules.wording import SUMMARIES, TITLES

REPEAT = "suggestion.repeatedly-unavailable.v1"
BY_HAND = "suggestion.manual-verification.v1"
ONE_RUN = "array('Attempts are those of one run; they are not spread over days.')"


def attempts_note(ctx: RuleContext, parameters: dict) -> str:
    """Limitation that says how attempts were counted."""
    least = int_param(parameters, "minSpacingMinutes", MIN_SPACING_MINUTES)
    return f"array('Attempts of several runs count when at least {least} minutes apart.')" if ctx.several_runs else ONE_RUN


def text(template: str, **values: str) -> str:
    """SQL concatenation of a template whose {names} stand for SQL expressions."""
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(quoted(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(values.get(name, name))
    return "concat(" + ", ".join(parts) + ")"


def entry_draft(rule_id: str, category: str, group: str, suggestion: str, evidence_type: str, **fields: str) -> str:
    """Finding over a group of entry checks. Evidence is bounded: counts and the
    first row; every row behind it is in entry_evidence."""
    return draft(
        rule_id, category, suggestion,
        first_observed_at=f"{group}_first.checked_at", last_observed_at=f"{group}_last",
        affected_urls="array(canonical_url)", evidence_type=quoted(evidence_type), evidence_source_url="canonical_url",
        related_observation_id=f"{group}_first.observation_id",
        evidence_content=f"to_json(struct({group}_n AS rows, {group}_attempt AS max_attempt, {group}_first AS first, "
                         f"CAST({group}_last AS string) AS last_checked_at))",
        **fields,
    )


def unavailable(ctx: RuleContext, parameters: dict, prior: str) -> str:
    count = effective_attempts("failed", ctx)
    return emit(f"{count} >= {int_param(parameters, 'spacedAttempts', 3)}", entry_draft(
        "availability.unavailable.v1", "availability", "failed", REPEAT, "http_response_snapshot",
        title=quoted(TITLES["unavailable"]),
        summary=text(SUMMARIES["unavailable"], count=count),
        severity="'critical'", confidence="'high'", check_status="'fail'", limitations=attempts_note(ctx, parameters),
        evidence_description=text("The entry page at {canonical_url} failed to load on {failed_n} attempt(s)."),
    ))


def server_error(ctx: RuleContext, parameters: dict, prior: str) -> str:
    count, least = effective_attempts("server", ctx), int_param(parameters, "minRepeatedOccurrences", 2)
    sustained = f"{count} > {least}"
    return emit(f"{count} >= {least}", entry_draft(
        "availability.server-error.v1", "availability", "server", REPEAT, "http_response_snapshot",
        title=f"if({sustained}, {quoted(TITLES['server_error_sustained'])}, {quoted(TITLES['server_error'])})",
        summary=text(SUMMARIES["server_error"], count=count),
        severity=f"if({sustained}, 'critical', 'significant')",
        confidence="'high'", check_status="'fail'", limitations=attempts_note(ctx, parameters),
        evidence_description=text("The entry page at {canonical_url} returned a server error on {server_n} attempt(s)."),
    ))


def not_found(ctx: RuleContext, parameters: dict, prior: str) -> str:
    count = effective_attempts("missing")
    return emit(f"{count} >= {int_param(parameters, 'minRepeatedOccurrences', 2)}", entry_draft(
        "availability.not-found.v1", "availability", "missing", REPEAT, "http_response_snapshot",
        title=quoted(TITLES["not_found"]),
        summary=text(SUMMARIES["not_found"], count=count),
        severity="'critical'", confidence="'high'", check_status="'fail'", limitations=ONE_RUN,
        evidence_description=text("The entry page at {canonical_url} returned {missing_first.http_status} on {count} attempt(s).", count=count),
    ))


def automation_blocked(ctx: RuleContext, parameters: dict, prior: str) -> str:
    return emit("blocked_n > 0", entry_draft(
        "availability.automation-blocked.v1", "availability", "blocked", BY_HAND, "http_response_snapshot",
        title=quoted(TITLES["blocked"]),
        summary=text(SUMMARIES["blocked"]),
        severity="'advisory'", confidence="'low'", check_status="'not_assessable'", review_status="'not_assessable'",
        limitations="array('A blocked automated check says nothing about human visitors; check by hand.')",
        evidence_description=text("The automated check of {canonical_url} was blocked."),
    ))


def access_restricted(ctx: RuleContext, parameters: dict, prior: str) -> str:
    shown = "coalesce(CAST(restricted_first.http_status AS string), restricted_first.error_code)"
    return emit("restricted_n > 0", entry_draft(
        "availability.access-restricted.v1", "availability", "restricted", BY_HAND, "http_response_snapshot",
        title=quoted(TITLES["restricted"]),
        summary=text(SUMMARIES["restricted"], shown=shown),
        severity="'advisory'", confidence="'low'", check_status="'not_assessable'",
        limitations="array('Whether the restriction is intended needs a person to confirm.')",
        evidence_description=text("{canonical_url} returned {shown}, an access-restriction response.", shown=shown),
    ))


def certificate_failure(ctx: RuleContext, parameters: dict, prior: str) -> str:
    return emit("tls_n > 0", entry_draft(
        "https.certificate-failure.v1", "https", "tls", "suggestion.certificate-failure.v1", "certificate_detail",
        title=f"if(tls_first.error_code = 'TLS_CERT_EXPIRED', {quoted(TITLES['certificate_expired'])}, {quoted(TITLES['certificate_mismatch'])})",
        summary=text(SUMMARIES["certificate"]),
        severity="'significant'", confidence="'high'", check_status="'fail'",
        limitations="array('Seen in an ordinary page request, not in a certificate scan.')",
        evidence_description=text("{canonical_url} produced a certificate error: {tls_first.error_code}."),
    ))


def no_freshness_signal(ctx: RuleContext, parameters: dict, prior: str) -> str:
    # Only the first clean check counts, so the span is one instant.
    finding = entry_draft(
        "freshness.no-signal.v1", "freshness", "clean", "suggestion.potential-staleness.v1", "text_excerpt",
        title=quoted(TITLES["no_freshness"]),
        summary=quoted(SUMMARIES["no_freshness"]),
        severity="'advisory'", confidence="'low'", check_status="'not_applicable'",
        limitations="array('Page metadata only; dates in the text were not read.')",
        evidence_description=text("No freshness signal was extracted for {canonical_url}."),
    ).replace("'last_observed_at', CAST(clean_last AS", "'last_observed_at', CAST(clean_first.checked_at AS")
    return emit("clean_n > 0", finding)


def coverage_summary(ctx: RuleContext, parameters: dict, prior: str) -> str:
    full = f"(pages_observed >= {ctx.max_pages} OR budget_cut)"
    limits = {"max_pages": f"'{ctx.max_pages}'", "max_depth": f"'{ctx.max_depth}'"}
    said = {k: text(SUMMARIES[f"coverage_{k}"], **limits) for k in ("pages", "budget", "depth", "robots", "skips")}
    note = f"""concat_ws(' ', {said['pages']}, if({full}, {said['budget']}, NULL), if(depth_reached, {said['depth']}, NULL),
        if(robots_skips > 0, {said['robots']}, NULL), if(skipped > 0, {said['skips']}, NULL))"""
    return emit("covered", draft(
        "crawl_coverage.summary.v1", "crawl_coverage", "suggestion.no-action.v1",
        title=quoted(TITLES["coverage"]), summary=note, severity="'advisory'", confidence="'high'",
        check_status=f"if({full} OR depth_reached OR robots_skips > 0, 'warning', 'not_applicable')",
        review_status="'automated_observation'",
        first_observed_at=f"coalesce(first_checked, {ctx.now})", last_observed_at=f"coalesce(last_checked, {ctx.now})",
        affected_urls="array(canonical_url)",
        limitations="array('Bounded by page, depth and robots limits; an unobserved page is not a passing page.')",
        evidence_type="'text_excerpt'", evidence_source_url="canonical_url", related_observation_id="NULL",
        evidence_description=text("Coverage summary for {portal_id}: {note}", note=note),
        evidence_content="to_json(struct(pages_observed, page_rows, skipped, robots_skips))",
    ))


def per_row(rule_id: str, category: str, suggestion: str, evidence_type: str, **fields: str) -> str:
    """Finding about one observation row."""
    return draft(
        rule_id, category, suggestion, "manual_assessment", subject="observation_id",
        severity="'advisory'", confidence="'medium'", check_status="'warning'",
        first_observed_at="checked_at", last_observed_at="checked_at",
        evidence_type=quoted(evidence_type), evidence_source_url="requested_url", related_observation_id="observation_id", **fields,
    )


def cross_domain(ctx: RuleContext, parameters: dict) -> str:
    outside = "away_host IS NOT NULL AND NOT exists(hostnames, h -> lower(h) = away_host)"
    return f"CASE WHEN {outside} THEN " + per_row(
        "redirect.cross-domain.v1", "availability", "suggestion.directory-mismatch.v1", "redirect_chain",
        title=quoted(TITLES["cross_domain"]),
        summary=text(SUMMARIES["cross_domain"], target="away"),
        affected_urls="array(requested_url, away)",
        limitations="array('A redirect to another domain can be a planned move; review by hand.')",
        evidence_description=text("Requesting {requested_url} redirected to {target}.", target="away"),
        evidence_content="to_json(redirect_chain)",
    ) + " END"


def no_tls_upgrade(ctx: RuleContext, parameters: dict) -> str:
    plain = r"error_code IS NULL AND reached RLIKE r'^[A-Za-z][A-Za-z0-9+.\-]*:' AND NOT reached RLIKE '(?i)^https:'"
    return f"CASE WHEN {plain} THEN " + per_row(
        "https.no-tls-upgrade.v1", "https", "suggestion.certificate-failure.v1", "http_response_snapshot",
        title=quoted(TITLES["no_tls"]),
        summary=text(SUMMARIES["no_tls"], target="reached"),
        affected_urls="array(reached)", limitations="array('Only the scheme of the final destination was looked at.')",
        evidence_description=text("{requested_url} was served at {target}.", target="reached"),
        evidence_content="to_json(struct(requested_url, final_url, http_status))",
    ) + " END"


def entry_evidence(ctx: RuleContext) -> DataFrame:
    """Every entry observation behind a portal rule, one row per (rule, observation)."""
    rules = {
        "availability.unavailable.v1": "failed", "availability.server-error.v1": "server",
        "availability.not-found.v1": "missing", "availability.automation-blocked.v1": "blocked",
        "availability.access-restricted.v1": "restricted", "https.certificate-failure.v1": "tls",
    }
    hits = ", ".join(f"if({ENTRY_GROUPS[g]}, '{r}', NULL)" for r, g in rules.items())
    return ctx.entry_rows.select(
        "portal_id", "seq", "observation_id", F.expr(f"explode(array_compact(array({hits})))").alias("rule_id"),
        observation_summary().alias("observation_summary"),
    )


register_rule(Rule("availability.unavailable.v1", "availability", "Entry URL fails for the configured number of attempts without a usable response.", portal_findings=unavailable, defaults={"spacedAttempts": 3}))
register_rule(Rule("availability.server-error.v1", "availability", "Repeated 5xx responses on the entry URL.", portal_findings=server_error, defaults={"minRepeatedOccurrences": 2}))
register_rule(Rule("availability.not-found.v1", "availability", "The entry URL repeatedly returns 404 or 410.", portal_findings=not_found, defaults={"minRepeatedOccurrences": 2}))
register_rule(Rule("redirect.cross-domain.v1", "availability", "The final host lies outside the registered hostnames.", row_finding=cross_domain))
register_rule(Rule("availability.automation-blocked.v1", "availability", "The automated check was blocked on the entry page.", portal_findings=automation_blocked))
register_rule(Rule("availability.access-restricted.v1", "availability", "The entry page answered 401 or 403.", portal_findings=access_restricted))
