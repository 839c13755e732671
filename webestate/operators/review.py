"""Review gates: decisions, evidence privacy, overlap comparisons, publishable set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webestate.operators.rules.base import AVAILABILITY_RULES


def effective_privacy(artifacts: DataFrame, overlays: DataFrame) -> DataFrame:
    """Artifacts with ``reviewed``: own flag or a positive overlay."""
    positive = overlays.filter("privacy_reviewed").select("artifact_id").distinct().withColumn("overlaid", F.lit(True))
    return artifacts.join(positive, "artifact_id", "left").select(
        "artifact_id", (F.col("privacy_reviewed") | F.coalesce("overlaid", F.lit(False))).alias("reviewed")
    )


def evidence_state(owners: DataFrame, key: str, reviewed: DataFrame) -> DataFrame:
    """(key, pos, ref, found, reviewed) for every evidence reference of a table."""
    refs = owners.select(key, F.posexplode("evidence_refs").alias("pos", "ref"))
    known = reviewed.select(F.col("artifact_id").alias("ref"), F.lit(True).alias("found"), "reviewed")
    return refs.join(known, "ref", "left").fillna({"found": False, "reviewed": False})


def unreviewed_refs(comparisons: DataFrame, reviewed: DataFrame) -> DataFrame:
    return evidence_state(comparisons, "comparison_id", reviewed).filter("NOT reviewed").select("comparison_id", "ref")


def unresolved_evidence(findings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """References that no artifact answers."""
    refs = findings.select("finding_id", F.explode("evidence_refs").alias("ref"))
    return refs.join(artifacts.select(F.col("artifact_id").alias("ref")), "ref", "left_anti").select("finding_id", "ref")


def stale_decisions(decisions: DataFrame, findings: DataFrame) -> DataFrame:
    return decisions.join(findings.select("finding_id"), "finding_id", "left_anti")


def awaiting_review(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    return findings.join(decisions.select("finding_id"), "finding_id", "left_anti")


def to_publish(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings decided for publication, with the decision's overrides."""
    chosen = decisions.filter("decision = 'publish'").select("finding_id", "overridden_severity", "overridden_action")
    return findings.join(chosen, "finding_id")


def issue(code: str, df: DataFrame, subject: str | Column = "finding_id", detail: Column | None = None) -> DataFrame:
    key = F.col(subject) if isinstance(subject, str) else subject
    extra = F.lit(None) if detail is None else detail
    return df.select(F.lit(code).alias("code"), key.cast("string").alias("finding_id"), extra.cast("string").alias("detail"))


def unknown_portal(published: DataFrame, portals: DataFrame) -> DataFrame:
    return published.join(portals.select("portal_id"), "portal_id", "left_anti")


def retirement_from_availability(published: DataFrame) -> DataFrame:
    return published.filter(
        (F.col("overridden_action") == "review_retirement") & F.col("rule_id").isin(*AVAILABILITY_RULES)
    )


def evidence_issues(published: DataFrame, reviewed: DataFrame) -> DataFrame:
    state = evidence_state(published, "finding_id", reviewed)
    code = F.when(~F.col("found"), "unresolved_evidence_ref").when(~F.col("reviewed"), "unreviewed_evidence")
    return state.filter("NOT found OR NOT reviewed").select(
        code.alias("code"), F.col("finding_id").cast("string").alias("finding_id"), F.col("ref").alias("detail"))


def overlap_issues(
    published: DataFrame, comparisons: DataFrame, portals: DataFrame, reviewed: DataFrame, run_id: str
) -> DataFrame:
    """Every gate an overlap finding's comparison has to pass, as issue rows."""
    known = portals.select(F.col("portal_id").alias("known"))
    wanted = published.filter("category = 'possible_overlap'").select(
        "finding_id", "portal_id", F.col("overlap_comparison_id").alias("wanted_id"))
    c = comparisons.withColumnRenamed("run_id", "c_run")
    pairs = wanted.join(c, F.col("wanted_id") == F.col("comparison_id"), "left")
    pairs = pairs.join(known.select(F.col("known").alias("portal_a"), F.lit(True).alias("known_a")), "portal_a", "left")
    pairs = pairs.join(known.select(F.col("known").alias("portal_b"), F.lit(True).alias("known_b")), "portal_b", "left")
    gates = """array_compact(array(
        if(wanted_id IS NULL, named_struct('code', 'missing_overlap_comparison_id', 'detail', CAST(NULL AS string)), NULL),
        if(wanted_id IS NOT NULL AND comparison_id IS NULL, named_struct('code', 'overlap_comparison_not_found', 'detail', wanted_id), NULL),
        if(c_run <> '{run}', named_struct('code', 'cross_run_overlap_comparison', 'detail', c_run), NULL),
        if(conclusion <> 'possible_overlap', named_struct('code', 'non_publishable_overlap_conclusion', 'detail', conclusion), NULL),
        if(portal_id <> portal_a AND portal_id <> portal_b, named_struct('code', 'overlap_portal_mismatch', 'detail', CAST(portal_id AS string)), NULL),
        if(comparison_id IS NOT NULL AND known_a IS NULL, named_struct('code', 'overlap_portal_not_found', 'detail', concat('A ', portal_a)), NULL),
        if(comparison_id IS NOT NULL AND known_b IS NULL, named_struct('code', 'overlap_portal_not_found', 'detail', concat('B ', portal_b)), NULL)))
    """.replace("{run}", run_id)
    flat = pairs.select("finding_id", F.expr(f"explode({gates})").alias("g"))
    state = evidence_state(comparisons, "comparison_id", reviewed).filter("NOT found OR NOT reviewed")
    refs = wanted.join(state, F.col("wanted_id") == F.col("comparison_id"))
    ref_code = F.when(F.col("found"), "unreviewed_overlap_evidence").otherwise("unresolved_overlap_evidence_ref")
    return flat.select(F.col("g.code").alias("code"), F.col("finding_id").cast("string").alias("finding_id"), F.col("g.detail").alias("detail")).unionByName(
        refs.select(ref_code.alias("code"), F.col("finding_id").cast("string").alias("finding_id"), F.col("ref").alias("detail")))


def sidecar_issues(code: str, errors: DataFrame) -> DataFrame:
    """Issue rows for the files a sidecar scan could not accept."""
    return issue(code, errors, F.col("file_key"), F.col("parse_error"))


def review_issues(
    findings: DataFrame, decisions: DataFrame, portals: DataFrame, reviewed: DataFrame,
    comparisons: DataFrame, run_id: str, file_issues: DataFrame | None = None,
) -> DataFrame:
    """All issues of a review; the run may be published only when there is none."""
    published = to_publish(findings, decisions)
    out = issue("stale_review_reference", stale_decisions(decisions, findings))
    for part in (
        issue("missing_review_decision", awaiting_review(findings, decisions), detail=F.col("rule_id")),
        issue("unknown_portal", unknown_portal(published, portals), detail=F.col("portal_id")),
        issue("review_retirement_from_availability_only", retirement_from_availability(published), detail=F.col("rule_id")),
        evidence_issues(published, reviewed),
        overlap_issues(published, comparisons, portals, reviewed, run_id),
        *([] if file_issues is None else [file_issues]),
    ):
        out = out.unionByName(part)
    return out


def publishable(findings: DataFrame, decisions: DataFrame, issues: DataFrame) -> DataFrame:
    """Findings decided for publication that no issue names, overrides applied."""
    blocked = issues.select(F.col("finding_id").alias("blocked_id"))
    kept = to_publish(findings, decisions)
    kept = kept.join(blocked, kept.finding_id.cast("string") == blocked.blocked_id, "left_anti")
    return apply_overrides(kept)


def apply_overrides(published: DataFrame) -> DataFrame:
    return published.withColumns({
        "review_status": F.lit("reviewed"),
        "severity": F.coalesce("overridden_severity", "severity"),
        "suggested_action": F.coalesce("overridden_action", "suggested_action"),
    }).drop("overridden_severity", "overridden_action")


def run_verdict(issues: DataFrame) -> DataFrame:
    """One row: number of issues and whether the run passes."""
    return issues.agg(F.count("*").alias("issues"), (F.count("*") == 0).alias("ok"))


def published_evidence(findings: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Reviewed artifacts each finding may cite, in reference order."""
    return evidence_state(findings, "finding_id", reviewed).filter("reviewed").select(
        "finding_id", "pos", F.col("ref").alias("artifact_id"))


def used_evidence(findings: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Distinct artifact ids cited by published findings or chosen comparisons."""
    one = findings.select(F.explode("evidence_refs").alias("artifact_id"))
    two = comparisons.select(F.explode("evidence_refs").alias("artifact_id"))
    return one.union(two).distinct()


def publication_artifacts(artifacts: DataFrame, used: DataFrame) -> DataFrame:
    """Used artifacts, flagged as reviewed, sorted by id."""
    return artifacts.join(used, "artifact_id", "left_semi").withColumn("privacy_reviewed", F.lit(True)).orderBy("artifact_id")


def overlap_context(findings: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Completed overlap comparison of a finding, and the other portal of the pair."""
    done = comparisons.filter("status = 'completed' AND conclusion = 'possible_overlap'").select("comparison_id", "portal_a", "portal_b")
    joined = findings.select("finding_id", "portal_id", F.col("overlap_comparison_id").alias("wanted_id")).join(
        done, F.col("wanted_id") == F.col("comparison_id"), "left")
    other = F.when(F.col("portal_a") == F.col("portal_id"), F.col("portal_b")).otherwise(F.col("portal_a"))
    return joined.select("finding_id", "portal_id", "comparison_id", F.when(F.col("comparison_id").isNotNull(), other).alias("other_portal_id"))
