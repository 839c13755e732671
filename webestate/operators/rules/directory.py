"""Directory disagreement rules over the sources array of the portal profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webestate.functions.text import name_tokens, names_disagree
from webestate.operators.rules.availability import text
from webestate.operators.rules.base import Rule, RuleContext, draft, emit, quoted, register_rule
from webestate.operators.rules.wording import SUMMARIES, TITLES

MISMATCH = "suggestion.directory-mismatch.v1"
DIRECTORIES = "filter(sources, s -> s.source_type = 'official_directory')"


def listing(rule_id: str, **fields: str) -> str:
    """Finding about a portal's directory listing."""
    return draft(
        rule_id, "directory_mismatch", MISMATCH, severity="'advisory'",
        evidence_type="'directory_listing'", related_observation_id="NULL", **fields,
    )


def unavailable_destination(ctx: RuleContext, parameters: dict, prior: str) -> str:
    critical = f"transform(filter({prior}, f -> f.category = 'availability' AND f.severity = 'critical'), f -> f.rule_id)"
    finding = listing(
        "directory_mismatch.unavailable-destination.v1", subject="s.source_id",
        title=quoted(TITLES["directory_unavailable"]),
        summary=text(SUMMARIES["directory_unavailable"], rules=f"array_join({critical}, ', ')"),
        confidence="'medium'", check_status="'fail'", first_observed_at="s.retrieved_at", last_observed_at=ctx.now,
        affected_urls="array(s.source_url, canonical_url)", evidence_source_url="s.source_url",
        limitations=f"array({quoted('Built on the availability findings of this run; the listing was not fetched again.')})",
        evidence_description=text('The directory source "{s.source_name}" lists {s.source_url}, found critically unavailable.'),
        evidence_content=f"to_json(struct(s.source_id AS source_id, {critical} AS rules))",
    )
    return f"CASE WHEN size({critical}) > 0 THEN transform({DIRECTORIES}, s -> {finding}) END"


def host(url: str) -> str:
    return f"nullif(lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#: ]+)', 1)), '')"


def tokens(name: str) -> str:
    return f"filter(split(lower({name}), '[^a-z0-9]+'), t -> length(t) >= 3)"


def listed_vs_observed(ctx: RuleContext, parameters: dict, prior: str) -> str:
    listed, own, seen = host("s.source_url"), host("canonical_url"), host("first_final_url")
    a, b = tokens("s.source_name"), tokens("name")
    # Reasons in order name, host, redirect.
    name_reason = text(SUMMARIES["directory_name"])
    host_reason = text(SUMMARIES["directory_host"], listed=listed, own=own)
    seen_reason = text(SUMMARIES["directory_seen"], listed=listed, seen=seen)
    reasons = f"""array_compact(array(
        if(size({a}) > 0 AND size({b}) > 0 AND NOT arrays_overlap({a}, {b}), {name_reason}, NULL),
        if({listed} <> {own}, {host_reason}, NULL), if({seen} <> {listed}, {seen_reason}, NULL)))"""
    finding = listing(
        "directory_mismatch.listed-vs-observed.v1", subject="j.s.source_id",
        title=quoted(TITLES["directory_disagrees"]),
        summary=text(SUMMARIES["directory_disagrees"], why="array_join(j.reasons, '; ')"),
        confidence="'low'", check_status="'warning'", first_observed_at="j.s.retrieved_at", last_observed_at=ctx.now,
        affected_urls="array(j.s.source_url, canonical_url)", evidence_source_url="j.s.source_url",
        limitations="array('Names are compared by shared words only; confirm by hand.')",
        evidence_description=text('Directory source "{j.s.source_name}" compared against portal "{name}".'),
        evidence_content="to_json(struct(j.s AS source, name, canonical_url))",
    )
    judged = f"transform({DIRECTORIES}, s -> struct(s AS s, {reasons} AS reasons))"
    return f"transform(filter({judged}, j -> size(j.reasons) > 0), j -> {finding})"


def official_not_listed(ctx: RuleContext, parameters: dict, prior: str) -> str:
    return emit(f"official_status = 'verified' AND size(sources) > 0 AND size({DIRECTORIES}) = 0", listing(
        "directory_mismatch.official-portal-not-listed.v1",
        title=quoted(TITLES["directory_absent"]),
        summary=text(SUMMARIES["directory_absent"]),
        confidence="'medium'", check_status="'warning'", first_observed_at=ctx.now, last_observed_at=ctx.now,
        affected_urls="array(canonical_url)", evidence_source_url="canonical_url",
        limitations="array('Only the sources attached to this portal were looked at.')",
        evidence_description=text("{name} ({canonical_url}) is verified but has no official_directory source."),
        evidence_content="to_json(struct(portal_id, sources))",
    ))


def name_agreement(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Shared-token count and disagreement flag for pairs of names joined by key."""
    a, b = name_tokens(F.col(left)), name_tokens(F.col(right))
    return pairs.withColumn("shared_tokens", F.size(F.array_intersect(a, b))).withColumn("disagree", names_disagree(a, b))


register_rule(Rule("directory_mismatch.unavailable-destination.v1", "directory_mismatch", "A directory lists a destination found critically unavailable.", portal_findings=unavailable_destination))
register_rule(Rule("directory_mismatch.listed-vs-observed.v1", "directory_mismatch", "Listed name or host disagrees with what was observed.", portal_findings=listed_vs_observed))
register_rule(Rule("directory_mismatch.official-portal-not-listed.v1", "directory_mismatch", "A verified portal has no directory source.", portal_findings=official_not_listed))
