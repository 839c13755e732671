"""Freshness signals of page texts: what dates a page shows, and whether they say that it is out of date.

Signals, not a verdict: a recent date does not prove a page right, and an old one does not prove it useless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webestate.functions.dates import date_mentions, mention_fields
from webestate.operators.rules.availability import text
from webestate.operators.rules.base import Rule, RuleContext, draft, findings_from, int_param, quoted

STALE_DAYS, COPYRIGHT_YEARS = 365, 2


def freshness_signals(texts: DataFrame, keep: list[str], day_first: bool = True) -> DataFrame:
    """One row per date of ``texts`` (``*keep, text``): ``*keep, nth, raw, kind, day, precision, ambiguous, at``.

    ``kind`` is updated, deadline, copyright or dated. Rows are exploded before they are parsed, so every expression is
    evaluated once for each mention.
    """
    # The outer form keeps the optimizer from testing the array, and so searching the text, once more.
    rows = texts.select(*keep, F.posexplode_outer(date_mentions(F.col("text"))).alias("nth", "m")).where("m IS NOT NULL").select(*keep, "nth", "m.raw", "m.at")
    return rows.withColumn("f", mention_fields(F.col("raw"), day_first)).select(*keep, "nth", "raw", "f.kind", "f.day", "f.precision", "f.ambiguous", "at")


def page_freshness(texts: DataFrame, keep: list[str], as_of: Column, stale_days: int = STALE_DAYS) -> DataFrame:
    """One row per text: counts of signals, newest dates, the first piece of evidence and ``status``.

    Status is ``potentially_stale`` if the newest update is older than ``stale_days``, or if a deadline has passed and no update is newer
    than it; else ``recent_signal`` if a day of any exact kind is given; ``weak_signal`` if there is only a copyright year; and ``no_freshness_signal``.
    Days after ``as_of`` are no updates. Texts are aggregated by ``keep``, partially before the shuffle.
    """
    f = freshness_signals(texts, keep)
    past = F.col("day") <= as_of
    dated = f.where("day IS NOT NULL")
    per = dated.groupBy(*keep).agg(
        F.count(F.lit(1)).alias("signals"), F.count_if("ambiguous").alias("ambiguous"),
        F.max(F.when((F.col("kind") == "updated") & past, F.col("day"))).alias("updated"),
        F.max(F.when((F.col("kind") == "deadline") & (F.col("day") < as_of), F.col("day"))).alias("expired"),
        F.max(F.when((F.col("kind") == "deadline") & (F.col("day") >= as_of), F.col("day"))).alias("open_deadline"),
        F.max(F.when((F.col("kind") == "dated") & past, F.col("day"))).alias("notice"),
        F.max(F.when(F.col("kind") == "copyright", F.year("day"))).alias("copyright_year"),
        F.min_by(F.struct("raw", "at"), F.struct(F.when(F.col("kind") == "updated", 0).when(F.col("kind") == "deadline", 1).when(F.col("kind") == "dated", 2).otherwise(3), "nth")).alias("evidence"))
    old = F.datediff(as_of, "updated") > stale_days
    overdue = F.col("expired").isNotNull() & F.col("open_deadline").isNull() & (F.col("updated").isNull() | (F.col("updated") <= F.col("expired")))
    status = (F.when(F.coalesce(old, F.lit(False)) | overdue, "potentially_stale").when(F.coalesce("updated", "notice", "open_deadline", "expired").isNotNull(), "recent_signal")
              .when(F.col("copyright_year").isNotNull(), "weak_signal").otherwise("no_freshness_signal"))
    return (texts.select(*keep).distinct().join(per, keep, "left")
            .select(*keep, F.coalesce("signals", F.lit(0)).alias("signals"), F.coalesce("ambiguous", F.lit(0)).alias("ambiguous"), "updated", "expired", "open_deadline", "notice",
                    "copyright_year", F.coalesce(F.col("copyright_year") < F.year(as_of) - COPYRIGHT_YEARS, F.lit(False)).alias("old_copyright"),
                    F.col("evidence.raw").alias("evidence"), F.col("evidence.at").alias("evidence_at"), status.alias("status")))


def stale_rule(texts: DataFrame) -> Rule:
    """A rule beside ``freshness.no-signal.v1``: portals whose entry page shows only passed dates. ``texts`` has ``portal_id, url, text``."""

    def evaluate(ctx: RuleContext, parameters: dict) -> DataFrame:
        now = F.expr(ctx.now)
        pages = texts.join(ctx.portals.select("portal_id", "canonical_url"), "portal_id").where("url = canonical_url")
        found = page_freshness(pages.select("portal_id", "url", "text"), ["portal_id", "url"], now.cast("date"), int_param(parameters, "staleDays", STALE_DAYS))
        finding = draft(
            "freshness.potentially-stale.v1", "freshness", "suggestion.potential-staleness.v1",
            title=quoted("Visible dates on the entry page have passed"),
            summary=text("The newest date that {url} shows reads “{evidence}”."),
            severity="'advisory'", confidence="if(ambiguous > 0, 'low', 'medium')", check_status="'warning'",
            first_observed_at=ctx.now, last_observed_at=ctx.now, affected_urls="array(url)",
            limitations="array('A recent date does not prove a page right, an old one does not prove it useless.')",
            evidence_type="'text_excerpt'", evidence_source_url="url", related_observation_id="NULL",
            evidence_description=text("“{evidence}” at character {evidence_at}.", evidence_at="CAST(evidence_at AS string)"),
            evidence_content="to_json(struct(evidence, evidence_at, CAST(updated AS string) AS updated, CAST(expired AS string) AS expired, copyright_year))",
        )
        return findings_from(found.where("status = 'potentially_stale'"), finding)

    return Rule("freshness.potentially-stale.v1", "freshness", "Dates that the entry page shows have passed.", evaluate=evaluate, defaults={"staleDays": STALE_DAYS})
