"""Roll-ups: health, counts, coverage, run status and one assessment per portal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webestate.functions.checks import ACTION_ORDER, ACTIONS, HEALTH, SEVERITY, rank

# Rules that decide the health precedence.
UNAVAILABILITY_RULES = ("availability.unavailable.v1", "availability.not-found.v1", "availability.server-error.v1")
NOT_ASSESSABLE_RULES = ("availability.automation-blocked.v1", "availability.access-restricted.v1")

# Wording of the coverage note.
NO_PAGES_NOTE = "No pages were attempted for this portal in the referenced crawl run."
COVERAGE_NOTE = "{} of {} attempted page check(s) returned a response; {} link(s) checked{}."
BROWSER_NOTE = "; browser rendering fallback was used for at least one page"


def health_column() -> Column:
    """Health of a group of findings, by precedence. An aggregate expression."""
    severe = F.col("severity").isin("critical", "significant")
    unclear = F.col("rule_id").isin(*NOT_ASSESSABLE_RULES)
    return (
        F.when(F.bool_or((F.col("severity") == "critical") & F.col("rule_id").isin(*UNAVAILABILITY_RULES)), "unavailable")
        .when(F.bool_or(severe & ~unclear), "degraded")
        .when(F.bool_or(unclear), "not_assessable")
        .otherwise("healthy")
    )


def severity_count_columns() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITY]


def portal_health(portals: DataFrame, findings: DataFrame) -> DataFrame:
    """Health and severity counts of every portal; portals without findings are healthy."""
    per = findings.groupBy("portal_id").agg(health_column().alias("health"), *severity_count_columns())
    zero = {f"{s}_count": 0 for s in SEVERITY}
    return portals.select("portal_id").join(per, "portal_id", "left").fillna({"health": "healthy", **zero})


def most_urgent_action(action: str | Column = "suggested_action") -> Column:
    """Most urgent of a group of actions; an empty group is 'maintain'. An aggregate expression."""
    col = F.col(action) if isinstance(action, str) else action
    best = F.min(rank(col, ACTION_ORDER))
    return F.coalesce(F.element_at(F.array(*(F.lit(a) for a in ACTION_ORDER)), best + 1), F.lit("maintain"))


def crawl_coverage(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Attempted, observed and checked counts per portal, from two separate aggregates."""
    seen = pages.groupBy("portal_id").agg(
        F.count("*").alias("pages_attempted"),
        F.count_if(F.col("error_code").isNull()).alias("pages_observed"),
        F.bool_or(F.col("fetch_mode") == "browser").alias("browser_fallback_used"),
    )
    checked = links.groupBy("portal_id").agg(F.count("*").alias("links_checked"))
    return with_coverage_note(
        seen.join(checked, "portal_id", "full_outer").fillna(
            {"pages_attempted": 0, "pages_observed": 0, "browser_fallback_used": False, "links_checked": 0}
        )
    )


def with_coverage_note(coverage: DataFrame) -> DataFrame:
    browser = F.when(F.col("browser_fallback_used"), BROWSER_NOTE).otherwise("")
    note = F.when(F.col("pages_attempted") == 0, NO_PAGES_NOTE).otherwise(
        F.format_string(COVERAGE_NOTE.replace("{}", "%s"), "pages_observed", "pages_attempted", "links_checked", browser))
    return coverage.withColumn("coverage_note", note)


def dense_counts(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Count per value with zeros for values that do not occur. One aggregate row, then unpivoted."""
    wide = df.agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))
    return wide.unpivot([], list(values), column, "portals")


def sparse_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("portals"))


def health_counts(assessments: DataFrame) -> DataFrame:
    return dense_counts(assessments, "technical_health", HEALTH)


def action_counts(assessments: DataFrame) -> DataFrame:
    return dense_counts(assessments, "suggested_action", ACTIONS)


def severity_counts(assessments: DataFrame) -> DataFrame:
    """Sums of the stored per-portal counts, one row per severity."""
    wide = assessments.agg(*(F.coalesce(F.sum(f"{s}_count"), F.lit(0)).alias(s) for s in SEVERITY))
    return wide.unpivot([], list(SEVERITY), "severity", "findings")


def portal_run_status(pages: DataFrame) -> DataFrame:
    """Per run and portal: failed if the first check failed, partial if any did, else
    succeeded; with the time span of its checks."""
    ok = F.col("error_code").isNull()
    return pages.groupBy("run_id", "portal_id").agg(
        F.min_by(ok, "seq").alias("entry_ok"), F.bool_or(~ok).alias("saw_error"),
        F.min("checked_at").alias("first_checked"), F.max("checked_at").alias("last_checked"),
    ).select(
        "run_id", "portal_id", "first_checked", "last_checked",
        F.when(~F.col("entry_ok"), "failed").when(F.col("saw_error"), "partial").otherwise("succeeded").alias("status"),
    )


def run_totals(statuses: DataFrame) -> DataFrame:
    """Run status: completed iff all succeeded, failed iff none, else partial."""
    t = statuses.groupBy("run_id").agg(
        F.count("*").alias("portal_count"),
        *(F.count_if(F.col("status") == s).alias(f"portals_{s}") for s in ("succeeded", "failed", "partial")),
        F.min("first_checked").alias("started_at"), F.max("last_checked").alias("completed_at"),
    )
    n, good = F.col("portal_count"), F.col("portals_succeeded")
    return t.withColumn(
        "status", F.when((n > 0) & (good == n), "completed").when(good == 0, "failed").otherwise("partial")
    )


def select_comparison(
    comparisons: DataFrame, portals: DataFrame, unreviewed_refs: DataFrame, run_id: str
) -> DataFrame:
    """The comparison chosen for each portal that is side A or B: the smallest id that
    belongs to the run, has two known portals and only reviewed evidence.

    ``unreviewed_refs`` holds (comparison_id, ref) pairs that fail the evidence test.
    """
    known = portals.select("portal_id")
    valid = (
        comparisons.filter(F.col("run_id") == run_id)
        .join(known.withColumnRenamed("portal_id", "portal_a"), "portal_a", "left_semi")
        .join(known.withColumnRenamed("portal_id", "portal_b"), "portal_b", "left_semi")
        .join(unreviewed_refs, "comparison_id", "left_anti")
    )
    sides = valid.select(F.explode(F.array_distinct(F.array("portal_a", "portal_b"))).alias("portal_id"), "comparison_id", "conclusion")
    return sides.groupBy("portal_id").agg(
        F.min("comparison_id").alias("comparison_id"), F.min_by("conclusion", "comparison_id").alias("conclusion")
    )


def continuing_role(conclusion: Column) -> Column:
    return (
        F.when(conclusion.isNull(), "not_reviewed")
        .when(conclusion.isin("possible_overlap", "distinct"), conclusion)
        .otherwise("unclear")
    )


def assess_portals(
    portals: DataFrame, findings: DataFrame, coverage: DataFrame, chosen: DataFrame, run_id: str, analyzed_at: str
) -> DataFrame:
    """One row per known portal with at least one finding in the run.

    ``findings`` carries a boolean ``publishable`` and final severity, action and
    review status. Everything per portal comes from one aggregate, so a portal
    with very many findings is combined before it is shuffled.
    """
    pub = F.col("publishable")
    reviewed = pub & (F.col("review_status") == "reviewed")
    severe = F.col("severity").isin("critical", "significant")
    unclear = F.col("rule_id").isin(*NOT_ASSESSABLE_RULES)
    per = findings.groupBy("portal_id").agg(
        F.when(F.bool_or(reviewed & (F.col("severity") == "critical") & F.col("rule_id").isin(*UNAVAILABILITY_RULES)), "unavailable")
        .when(F.bool_or(reviewed & severe & ~unclear), "degraded")
        .when(F.bool_or(reviewed & unclear), "not_assessable").otherwise("healthy").alias("technical_health"),
        *(F.count_if(pub & (F.col("severity") == s)).alias(f"{s}_count") for s in SEVERITY),
        F.count_if(pub).alias("reviewed_finding_count"),
        most_urgent_action(F.when(pub, F.col("suggested_action"))).alias("suggested_action"),
        F.coalesce(F.max(F.when(pub, F.col("last_observed_at"))), F.lit(analyzed_at).cast("timestamp_ntz")).alias("last_checked_at"),
    )
    joined = portals.join(per, "portal_id").join(coverage, "portal_id", "left").join(chosen, "portal_id", "left")
    filled = joined.fillna({"pages_attempted": 0, "pages_observed": 0, "links_checked": 0, "browser_fallback_used": False})
    return with_coverage_note(filled.drop("coverage_note")).withColumn(
        "continuing_role", continuing_role(F.col("conclusion"))
    ).withColumn("audit_run_id", F.lit(run_id))


def publication_summary(assessments: DataFrame, run: DataFrame, published_at: str, analysis_limitations: list[str]) -> DataFrame:
    """One row per run: counts as maps (health and action sparse, severity dense), date, limitations."""
    health = F.map_from_entries(F.filter(F.array(*(
        F.struct(F.lit(h), F.count_if(F.col("technical_health") == h)) for h in HEALTH)), lambda e: e["col2"] > 0))
    actions = F.map_from_entries(F.filter(F.array(*(
        F.struct(F.lit(a), F.count_if(F.col("suggested_action") == a)) for a in ACTIONS)), lambda e: e["col2"] > 0))
    severity = F.map_from_entries(F.array(*(
        F.struct(F.lit(s), F.coalesce(F.sum(f"{s}_count"), F.lit(0))) for s in SEVERITY)))
    counts = assessments.groupBy(F.col("audit_run_id").alias("run_id")).agg(
        F.count("*").alias("portal_count"), health.alias("technical_health_counts"),
        severity.alias("severity_counts"), actions.alias("suggested_action_counts"),
    )
    facts = run.select(
        "run_id", F.coalesce("completed_at", "started_at").alias("audit_date"), "methodology_version", "limitations")
    # One row of each kind per run, folded into one; each column is set in one of them only.
    names = ("audit_date", "methodology_version", "limitations", "portal_count", "technical_health_counts", "severity_counts", "suggested_action_counts")
    folded = counts.unionByName(facts, allowMissingColumns=True).groupBy("run_id").agg(
        *(F.first(n, ignorenulls=True).alias(n) for n in names)).filter("portal_count IS NOT NULL")
    extra = F.array(*(F.lit(x) for x in analysis_limitations)).cast("array<string>")
    return folded.withColumn("published_at", F.lit(published_at)).withColumn("limitations", F.concat("limitations", extra))
