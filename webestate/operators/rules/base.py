"""Rule interface, registry and the single-pass evaluation plan.

Two kinds of rule exist. A *portal rule* is an array-of-findings SQL expression over
one wide row per portal (the profile), so all of them share one plan. A *table
rule* returns its own findings frame, for rules that work per row or per group
of an observation table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webestate.functions.checks import final_url
from webestate.functions.urls import host_of
from webestate.operators.spacing import count_spaced

FINDING_FIELDS = (
    "subject", "rule_id", "category", "title", "summary", "severity", "confidence",
    "check_status", "review_status", "first_observed_at", "last_observed_at", "affected_urls",
    "suggestion_rule_id", "suggested_action", "limitations", "evidence_type",
    "evidence_description", "evidence_source_url", "related_observation_id", "evidence_content",
)

FIELD_TYPES = {
    "affected_urls": "array<string>", "limitations": "array<string>",
    "first_observed_at": "timestamp_ntz", "last_observed_at": "timestamp_ntz",
}
#: Fields that drafts hold; fewer while only these are wanted, so the others are never computed.
_WANTED: ContextVar[tuple[str, ...]] = ContextVar("wanted finding fields", default=FINDING_FIELDS)


@contextmanager
def wanted_fields(*names: str) -> Iterator[None]:
    """Findings drafted inside have these fields only, besides those that rules read of each other (rule, category, severity)."""
    token = _WANTED.set(tuple(n for n in FINDING_FIELDS if n in {*names, "rule_id", "category", "severity"}))
    try:
        yield
    finally:
        _WANTED.reset(token)


def no_findings() -> str:
    return "CAST(array() AS array<struct<" + ",".join(f"{name}:{FIELD_TYPES.get(name, 'string')}" for name in _WANTED.get()) + ">>)"

# Suggestion id -> suggested action.
SUGGESTIONS = {
    "suggestion.repeatedly-unavailable.v1": "repair",
    "suggestion.official-link-dead.v1": "repair",
    "suggestion.certificate-failure.v1": "repair",
    "suggestion.broken-navigation.v1": "repair",
    "suggestion.potential-staleness.v1": "manual_assessment",
    "suggestion.directory-mismatch.v1": "manual_assessment",
    "suggestion.possible-overlap.v1": "review_consolidation",
    "suggestion.apparent-obsolete-with-corroboration.v1": "review_retirement",
    "suggestion.manual-verification.v1": "manual_assessment",
    "suggestion.no-action.v1": "maintain",
}

AVAILABILITY_RULES = (
    "availability.unavailable.v1", "availability.server-error.v1", "availability.not-found.v1",
    "redirect.cross-domain.v1", "availability.automation-blocked.v1", "availability.access-restricted.v1",
)

# Error codes that mean no usable response at all.
TOTAL_FAILURE = (
    "DNS_FAILURE", "CONNECT_TIMEOUT", "READ_TIMEOUT", "TOO_MANY_REDIRECTS",
    "INTERNAL_AUDIT_ERROR", "SSRF_BLOCKED",
)

ENTRY_GROUPS = {
    "failed": "error_code IN (" + ", ".join(f"'{c}'" for c in TOTAL_FAILURE) + ")",
    "server": "error_code = 'HTTP_SERVER_ERROR'",
    "missing": "http_status IN (404, 410)",
    "blocked": "error_code = 'AUTOMATION_BLOCKED'",
    "restricted": "(error_code = 'AUTH_REQUIRED' OR (error_code = 'HTTP_CLIENT_ERROR' AND http_status = 403))",
    "tls": "error_code IN ('TLS_CERT_EXPIRED', 'TLS_HOST_MISMATCH')",
    "clean": "error_code IS NULL",
}
#: Groups of entry checks whose days a summary names.
DATED_GROUPS = ("failed", "server", "missing")


@dataclass
class RuleContext:
    """Inputs of one analysis: portals, sources and observation tables of a run."""

    run_id: str
    analyzed_at: str
    portals: DataFrame
    sources: DataFrame
    pages: DataFrame
    links: DataFrame
    skips: DataFrame
    max_pages: int = 40
    max_depth: int = 2
    #: Whether ``pages`` holds the checks of several runs; repeated failures then count by their spacing in time.
    several_runs: bool = False
    #: Merged :func:`entry_partials` and :func:`address_partials` of checks that are not in ``pages``, for portal rules.
    stored_entry: DataFrame | None = None
    stored_addresses: DataFrame | None = None
    #: :func:`skip_facts` of ``skips``, if they are known already.
    stored_skips: DataFrame | None = None
    #: Names the state of links, skips, portals and sources: two contexts of a run with one name hold the same. None: may differ.
    version: str | None = None

    @property
    def now(self) -> str:
        return f"TIMESTAMP_NTZ'{self.analyzed_at}'"

    @cached_property
    def entry_rows(self) -> DataFrame:
        """Observations of each portal's own entry URL."""
        p = self.portals.select("portal_id", "canonical_url", "hostnames")
        o = self.pages.withColumnRenamed("portal_id", "o_portal")
        return o.join(
            p, (o.o_portal == p.portal_id) & (o.requested_url == p.canonical_url)
        ).drop("o_portal")

    @cached_property
    def targets(self) -> DataFrame:
        """Entry rows with where they ended: after redirects (``away``, ``away_host``) and as reported (``reached``)."""
        rows = self.entry_rows.withColumn("away", final_url(F.col("final_url"), F.col("redirect_chain")))
        return rows.withColumn("away_host", host_of(F.col("away"))).withColumn("reached", F.coalesce("final_url", "requested_url"))

    @cached_property
    def entry(self) -> DataFrame:
        """One row per portal: counts, first row and dates of each kind of entry check."""
        return entry_facts(self.stored_entry if self.stored_entry is not None else entry_partials(self.entry_rows))

    def spaced_attempts(self, minutes: dict[str, int]) -> DataFrame:
        """``portal_id`` and, for each group of entry checks, ``<group>_spaced``: how many are at least so many minutes apart."""
        hits = [F.when(F.expr(ENTRY_GROUPS[g]), F.struct(F.lit(g).alias("kind"), F.lit(m).alias("minutes"))) for g, m in sorted(minutes.items())]
        rows = self.entry_rows.select("portal_id", "checked_at", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("portal_id", "checked_at", "hit.*")
        out = None
        for m in sorted(set(minutes.values())):
            counts = count_spaced(rows.where(F.col("minutes") == m), ["portal_id", "kind"], "checked_at", m, days=1 + m // 1440)
            out = counts if out is None else out.unionByName(counts)
        return out.groupBy("portal_id").agg(*(F.max(F.when(F.col("kind") == g, F.col("spaced_n"))).alias(f"{g}_spaced") for g in sorted(minutes)))

    @cached_property
    def coverage(self) -> DataFrame:
        return coverage_facts(self.stored_addresses if self.stored_addresses is not None else address_partials(self.pages), self.stored_skips if self.stored_skips is not None else skip_facts(self.skips))

    @cached_property
    def portal_sources(self) -> DataFrame:
        """Sources of each portal, in the order of its references."""
        refs = self.portals.select("portal_id", F.posexplode("source_refs").alias("pos", "source_id"))
        named = refs.join(self.sources, "source_id")
        item = F.struct("pos", "source_id", "source_name", "source_url", "source_type", "retrieved_at")
        return named.groupBy("portal_id").agg(F.array_sort(F.collect_list(item)).alias("sources"))

    @cached_property
    def profile(self) -> DataFrame:
        """The wide row portal rules read."""
        return (
            self.portals.join(self.entry, "portal_id", "left")
            .join(self.coverage, "portal_id", "left")
            .join(self.portal_sources, "portal_id", "left")
            .withColumn("sources", F.coalesce("sources", F.array().cast(self.portal_sources.schema["sources"].dataType)))
        )


#: Groups of entry checks whose rule counts attempts by spacing when several runs are given, by rule.
SPACED_RULES = {"availability.unavailable.v1": "failed", "availability.server-error.v1": "server"}
MIN_SPACING_MINUTES = 15


def effective_attempts(group: str, ctx: RuleContext | None = None) -> str:
    """Larger of the number of rows and the highest attempt number in them; over several runs, the spaced attempts."""
    if ctx is not None and ctx.several_runs:
        return f"coalesce({group}_spaced, 0L)"
    return f"greatest({group}_n, coalesce({group}_attempt, 0), 0L)"


def entry_partials(rows: DataFrame) -> DataFrame:
    """Entry checks summed up per portal, in a form that :func:`merged_entry` can put together again."""
    row = "struct(seq, struct(checked_at, http_status, error_code, error_message, observation_id) AS row)"
    aggs = ["count(*) AS entries", "min(CASE WHEN seq IS NOT NULL THEN struct(seq, final_url) END) AS first_any"]
    for name, hit in ENTRY_GROUPS.items():
        known = f"({hit}) AND seq IS NOT NULL"
        aggs += [
            f"count_if({hit}) AS {name}_n", f"max(CASE WHEN {hit} THEN attempt END) AS {name}_attempt",
            f"min(CASE WHEN {known} THEN {row} END) AS {name}_least", f"max(CASE WHEN {known} THEN struct(seq, checked_at) END) AS {name}_most",
        ]
        if name in DATED_GROUPS:
            aggs.append(f"collect_set(CASE WHEN {hit} THEN date_format(checked_at, 'yyyy-MM-dd') END) AS {name}_days")
    return rows.groupBy("portal_id").agg(*map(F.expr, aggs))


def merged_entry(partials: DataFrame) -> DataFrame:
    """Partials of any number of parts as one row per portal, of the same form."""
    aggs = ["sum(entries) AS entries", "min(first_any) AS first_any"]
    for name in ENTRY_GROUPS:
        aggs += [f"sum({name}_n) AS {name}_n", f"max({name}_attempt) AS {name}_attempt", f"min({name}_least) AS {name}_least", f"max({name}_most) AS {name}_most"]
        if name in DATED_GROUPS:
            aggs.append(f"array_distinct(flatten(collect_list({name}_days))) AS {name}_days")
    return partials.groupBy("portal_id").agg(*map(F.expr, aggs))


def entry_facts(partials: DataFrame) -> DataFrame:
    """What rules read: one row per portal from its partials."""
    out = ["portal_id", "entries", "first_any.final_url AS first_final_url"]
    for name in ENTRY_GROUPS:
        out += [f"{name}_n", f"{name}_attempt", f"{name}_least.row AS {name}_first", f"{name}_most.checked_at AS {name}_last"]
        if name in DATED_GROUPS:
            out.append(f"array_join(array_sort({name}_days), ', ') AS {name}_dates")
    return partials.selectExpr(*out)


def address_partials(pages: DataFrame) -> DataFrame:
    """Page checks per (portal, address): a portal with very many pages is spread over tasks."""
    return pages.groupBy("portal_id", "requested_url").agg(
        F.count("*").alias("n"), F.min("checked_at").alias("lo"), F.max("checked_at").alias("hi"))


def merged_addresses(partials: DataFrame) -> DataFrame:
    return partials.groupBy("portal_id", "requested_url").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def skip_facts(skips: DataFrame) -> DataFrame:
    """Skips of each portal summed up by reason."""
    reason = F.col("reason")
    return skips.groupBy("portal_id").agg(
        F.count("*").alias("skipped"),
        F.bool_or(reason.rlike("(?i)max ?depth")).alias("depth_reached"),
        F.bool_or(reason.rlike("(?i)max ?pages|budget")).alias("budget_cut"),
        F.count_if(reason.rlike("(?i)robots")).alias("robots_skips"),
    )


def coverage_facts(per_url: DataFrame, skipped: DataFrame) -> DataFrame:
    """Per portal: distinct addresses observed, time span and skip reasons, from :func:`address_partials` and :func:`skip_facts`."""
    seen = per_url.groupBy("portal_id").agg(
        F.count("*").alias("pages_observed"), F.sum("n").alias("page_rows"),
        F.min("lo").alias("first_checked"), F.max("hi").alias("last_checked"),
    )
    both = seen.join(skipped, "portal_id", "full_outer")
    return both.withColumn("covered", F.lit(True)).fillna(
        {"pages_observed": 0, "page_rows": 0, "skipped": 0, "robots_skips": 0, "depth_reached": False, "budget_cut": False}
    )


@dataclass(frozen=True)
class Rule:
    """A rule: identity plus exactly one of ``portal_findings``, ``row_finding`` or ``evaluate``.

    ``portal_findings(ctx, parameters, prior)`` returns a SQL expression over the
    profile row whose value is an array of findings, or null; ``prior`` names the
    column with the findings of the portal rules before it. ``row_finding(ctx,
    parameters)`` returns an expression over one entry observation: a finding or null.
    """

    rule_id: str
    category: str
    description: str
    version: int = 1
    portal_findings: Callable[[RuleContext, dict, str], str] | None = None
    evaluate: Callable[[RuleContext, dict], DataFrame] | None = None
    row_finding: Callable[[RuleContext, dict], str] | None = None
    defaults: dict = field(default_factory=dict)

    @property
    def kind(self) -> str:
        return "portal" if self.portal_findings is not None else "row" if self.row_finding is not None else "table"


REGISTRY: list[Rule] = []


def register_rule(rule: Rule) -> Rule:
    if any(r.rule_id == rule.rule_id for r in REGISTRY):
        raise ValueError(f"rule {rule.rule_id} is registered already")
    if [rule.portal_findings, rule.evaluate, rule.row_finding].count(None) != 2:
        raise ValueError("a rule needs one of portal_findings, row_finding or evaluate")
    REGISTRY.append(rule)
    return rule


def select_rules(
    checks: list[dict] | None = None, registry: list[Rule] | None = None
) -> tuple[list[tuple[Rule, dict]], list[str]]:
    """Enabled rules in registry order with their parameters, and unknown rule ids."""
    registry = REGISTRY if registry is None else registry
    if checks is None:
        return [(r, dict(r.defaults)) for r in registry], []
    enabled = {c["rule_id"]: c.get("parameters") or {} for c in checks if c.get("enabled", True)}
    known = {r.rule_id for r in registry}
    chosen = [(r, {**r.defaults, **enabled[r.rule_id]}) for r in registry if r.rule_id in enabled]
    return chosen, [rule_id for rule_id in enabled if rule_id not in known]


def int_param(parameters: dict, name: str, fallback: int) -> int:
    value = parameters.get(name, fallback)
    return value if isinstance(value, int) and not isinstance(value, bool) and value > 0 else fallback


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def draft(rule_id: str, category: str, suggestion: str, action: str | None = None, **fields: str) -> str:
    """SQL for one finding struct with the common fields in fixed order.

    Field values are SQL expressions; ``suggestion`` is an expression when it is not a bare id.
    """
    bare = suggestion in SUGGESTIONS
    values = {
        "rule_id": quoted(rule_id), "category": quoted(category), "review_status": "'pending_review'", "subject": "''",
        "suggestion_rule_id": quoted(suggestion) if bare else suggestion,
        "suggested_action": quoted(action or SUGGESTIONS[suggestion]), **fields,
    }
    return "named_struct(" + ", ".join(
        f"'{name}', CAST({values[name]} AS {FIELD_TYPES.get(name, 'string')})" for name in _WANTED.get()
    ) + ")"


def emit(condition: str, finding: str) -> str:
    """A one-finding array when the condition holds, else null."""
    return f"CASE WHEN {condition} THEN array({finding}) END"


def findings_from(df: DataFrame, finding: str) -> DataFrame:
    return df.selectExpr("portal_id", f"{finding} AS f").select("portal_id", "f.*")


def run_rules(ctx: RuleContext, checks: list[dict] | None = None, registry: list[Rule] | None = None, kinds: tuple[str, ...] = ("portal", "row", "table")) -> DataFrame:
    """Findings of all enabled rules of these kinds: one exploded portal plan, one exploded plan over entry rows, one plan per table rule."""
    selected, _ = select_rules(checks, registry)
    selected = [(r, p) for r, p in selected if r.kind in kinds]
    frames: list[DataFrame] = []
    wide, arrays = None, []
    for rule, parameters in selected:
        if rule.portal_findings is None:
            continue
        if wide is None:
            wide = ctx.profile.withColumn("prior", F.expr(no_findings()))
            minutes = {SPACED_RULES[r.rule_id]: int_param(p, "minSpacingMinutes", MIN_SPACING_MINUTES) for r, p in selected if r.rule_id in SPACED_RULES}
            if ctx.several_runs and minutes:
                wide = wide.join(ctx.spaced_attempts(minutes), "portal_id", "left")
        own = f"coalesce({rule.portal_findings(ctx, parameters, 'prior')}, {no_findings()})"
        if rule.category == "availability":
            wide = wide.withColumn("prior", F.expr(f"concat(prior, {own})"))
        else:
            arrays.append(own)
    if wide is not None:
        every = "concat(" + ", ".join(["prior", *arrays]) + ")"
        # The outer form spares the optimizer's size test of the array, a second evaluation of every rule.
        flat = wide.selectExpr("portal_id", f"explode_outer({every}) AS f").filter("f IS NOT NULL")
        frames.append(flat.select("portal_id", "f.*"))
    per_row = [rule.row_finding(ctx, parameters) for rule, parameters in selected if rule.row_finding is not None]
    if per_row:
        flat = ctx.targets.selectExpr("portal_id", f"explode_outer(array_compact(array({', '.join(per_row)}))) AS f").filter("f IS NOT NULL")
        frames.append(flat.select("portal_id", "f.*"))
    for rule, parameters in selected:
        if rule.evaluate is not None:
            frames.append(rule.evaluate(ctx, parameters).select("portal_id", *_WANTED.get()))
    if not frames:
        raise ValueError("no enabled rule")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def rule_severities(ctx: RuleContext, checks: list[dict] | None = None, registry: list[Rule] | None = None) -> DataFrame:
    """``portal_id, rule_id, category, severity`` of all findings, without their texts and evidence: what health and counts need."""
    with wanted_fields():
        return run_rules(ctx, checks, registry)


def scoped_portals(portals: DataFrame, pages: DataFrame) -> DataFrame:
    """Portals with at least one page observation; all of them when there is none at all."""
    if pages.select("portal_id").isEmpty():
        return portals
    return portals.join(pages.select("portal_id"), "portal_id", "left_semi")


def materialise_findings(findings: DataFrame, run_id: str, captured_at: str) -> tuple[DataFrame, DataFrame]:
    """Findings with content-based ids, and their evidence artifacts.

    Ids are digests of run, portal, rule and subject, so that a rerun gives the
    same ids whatever the order of the tasks.
    """
    key = F.concat_ws("|", F.lit(run_id), F.col("portal_id").cast("string"), F.col("rule_id"), F.col("subject"))
    finding_id = F.concat(F.lit("finding-"), F.substring(F.sha2(key, 256), 1, 32))
    base = findings.withColumn("finding_id", finding_id).withColumn("run_id", F.lit(run_id))
    evidence_id = F.concat(F.lit("evidence-"), F.col("finding_id"), F.lit("-1"))
    records = base.withColumn("evidence_refs", F.array(evidence_id)).drop(
        "evidence_type", "evidence_description", "evidence_source_url", "related_observation_id", "evidence_content"
    )
    artifacts = base.select(
        evidence_id.alias("artifact_id"), "run_id", "portal_id", "finding_id",
        F.col("evidence_type").alias("type"),
        F.lit(captured_at).cast("timestamp_ntz").alias("captured_at"),
        F.col("evidence_source_url").alias("source_url"),
        "related_observation_id",
        F.sha2("evidence_content", 256).alias("content_digest"),
        F.lit("application/json").alias("mime_type"),
        F.col("evidence_description").alias("description"),
        F.col("evidence_content").alias("content"),
        F.lit(False).alias("privacy_reviewed"),
    )
    return records, artifacts
