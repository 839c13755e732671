"""Queries over visitor reports, review gates and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from webestate.functions import text
from webestate.operators import experience as ex
from webestate.operators import review, rollup
from webestate.plans import beds
from webestate.plans.catalog import ORACLES, plain, query  # noqa: F401
from webestate.plans.sql_beds import B4, B6, B7
from webestate.session import scratch_path, table

NOW = "1999-01-01 00:00:00"


def joined(spark, sf):
    return ex.with_moderation(beds.submissions(spark, sf), beds.moderation(spark, sf))


def visible(spark, sf):
    return ex.publicly_visible(joined(spark, sf))


VISIBLE = "vis AS (SELECT * FROM subs WHERE status = 'approved' AND consent)"


@query("src09_tables", f"WITH {B4}, {B6} SELECT 'submissions' AS relation, count(*) AS rows FROM subs UNION ALL SELECT 'moderation', count(*) FROM subs UNION ALL SELECT 'abuse_keys', count(*) FROM req")
def src09(spark, sf):
    def size(name, df):
        return df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "rows")

    return size("submissions", beds.submissions(spark, sf)).unionByName(size("moderation", beds.moderation(spark, sf))).unionByName(
        size("abuse_keys", beds.requests(spark, sf)))


@query("flt02_publicly_visible", f"WITH {B4}, {VISIBLE} SELECT submission_id, portal_id FROM vis")
def flt02(spark, sf):
    return visible(spark, sf).select("submission_id", "portal_id")


@query("jn07_moderated", f"WITH {B4} SELECT submission_id, portal_id, outcome, status, CAST(created_at AS VARCHAR) AS created_at FROM subs")
def jn07(spark, sf):
    return plain(joined(spark, sf), "submission_id", "portal_id", "outcome", "status", "created_at")


@query("jn08_optional_moderation", f"WITH {B4} SELECT submission_id, CASE WHEN submission_id % 4 = 0 THEN 'pending' ELSE status END AS status FROM subs")
def jn08(spark, sf):
    some = beds.moderation(spark, sf).withColumn("gone", F.col("submission_id") % 4 == 0).filter("NOT gone").drop("gone")
    return ex.with_optional_moderation(beds.submissions(spark, sf), some).select("submission_id", "status")


@query("ag10_experience_summary", f"""WITH {B4}, {VISIBLE} SELECT portal_id, count(*) AS experiences, count(*) FILTER (outcome = 'completed') AS completed, count(*) FILTER (outcome = 'partially_completed') AS partially_completed,
  count(*) FILTER (outcome = 'not_completed') AS not_completed, count(*) FILTER (outcome = 'information_only') AS information_only, count(rating) AS rating_count, round(avg(rating), 2) AS average_rating,
  min(coalesce(occurred_on, strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z'))) AS earliest, max(coalesce(occurred_on, strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z'))) AS latest, count(*) < 5 AS small_sample FROM vis GROUP BY 1""")
def ag10(spark, sf):
    return ex.experience_summary(visible(spark, sf))


THEMES_SQL = "thm AS (SELECT portal_id, theme, count(*) AS n FROM (SELECT portal_id, unnest(themes) AS theme FROM vis) GROUP BY 1, 2)"


@query("ag10_theme_map", f"WITH {B4}, {VISIBLE}, {THEMES_SQL} SELECT portal_id, string_agg(theme || '=' || n, ',' ORDER BY theme) AS themes FROM thm GROUP BY 1")
def ag10_themes(spark, sf):
    m = ex.theme_map(ex.theme_counts(visible(spark, sf)))
    return m.select("portal_id", F.array_join(F.transform(F.map_entries("theme_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("themes"))


@query("tk06_top_themes", f"WITH {B4}, {VISIBLE}, {THEMES_SQL} SELECT portal_id, theme, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY portal_id ORDER BY n DESC, theme) AS place FROM thm) WHERE place <= 5")
def tk06(spark, sf):
    return ex.top_themes(ex.theme_counts(visible(spark, sf)))


@query("ag18_active_count", f"WITH {B6} SELECT key, count(*) AS n FROM req WHERE created_at >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 36 HOUR AND created_at <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1")
def ag18(spark, sf):
    return ex.active_count(beds.requests(spark, sf), ["key"], "2024-01-15 12:00:00", 36.0)


@query("wn02_rolling_counts", f"""WITH {B6} SELECT request_id, count(*) OVER (PARTITION BY key ORDER BY created_at RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS last_day,
  count(*) OVER (PARTITION BY key ORDER BY created_at RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND CURRENT ROW) AS last_minutes FROM req""")
def wn02(spark, sf):
    r = beds.requests(spark, sf).select("request_id", "key", "created_at")
    day = ex.rolling_counts(r, ["key"], "created_at", 24, "last_day")
    return ex.rolling_counts(day, ["key"], "created_at", 1 / 6, "last_minutes").select("request_id", "last_day", "last_minutes")


def duplicate_input(spark, sf):
    r = beds.requests(spark, sf)
    key = text.duplicate_key(F.lit(None).cast("string"), F.array(), F.lit(None).cast("string"), F.col("free_text"))
    status = F.when(F.col("request_id") % 7 == 0, "rejected").when(F.col("request_id") % 2 == 0, "pending").otherwise("approved")
    return r.select(
        F.col("request_id").alias("submission_id"), "key", F.lit("p").alias("portal_id"), "task_type", "outcome", "created_at",
        key.alias("content_key"), status.alias("status"))


@query("jn09_duplicates", f"""WITH {B6}, d AS (SELECT *, row_number() OVER () AS x, CASE WHEN request_id % 7 = 0 THEN 'rejected' ELSE 'ok' END AS st FROM req)
  SELECT a.request_id AS submission_id, (SELECT arg_min(b.request_id, (b.created_at, b.request_id)) FROM d b WHERE b.task_type = a.task_type AND b.free_text = a.free_text AND b.st = 'ok'
     AND b.created_at BETWEEN a.created_at - INTERVAL 10 MINUTE AND a.created_at AND (b.created_at, b.request_id) < (a.created_at, a.request_id)
     AND EXISTS (SELECT 1 FROM d c WHERE c.key = a.key AND c.created_at < a.created_at AND c.created_at >= a.created_at - INTERVAL 10 MINUTE)) AS duplicate_of FROM d a""")
def jn09(spark, sf):
    rows = duplicate_input(spark, sf)
    return ex.mark_duplicates(rows, rows.select("key", "portal_id", "created_at")).select("submission_id", "duplicate_of")


ADMISSION_SQL = f"""WITH RECURSIVE {B6}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at, request_id) AS rn FROM req),
  w(key, rn, request_id, portal_id, ok, hist) AS (
    SELECT key, rn, request_id, portal_id, true, [{{'t': created_at, 'p': portal_id}}] FROM n WHERE rn = 1
    UNION ALL
    SELECT n.key, n.rn, n.request_id, n.portal_id, a.ok, CASE WHEN a.ok THEN list_append(a.live, {{'t': n.created_at, 'p': n.portal_id}}) ELSE a.live END
    FROM w JOIN n ON n.key = w.key AND n.rn = w.rn + 1,
    LATERAL (SELECT list_filter(w.hist, lambda h: h.t >= n.created_at - INTERVAL 24 HOUR) AS live,
      len(list_filter(w.hist, lambda h: h.t >= n.created_at - INTERVAL 24 HOUR)) < 5 AND len(list_filter(w.hist, lambda h: h.t >= n.created_at - INTERVAL 24 HOUR AND h.p = n.portal_id)) < 2 AS ok) a)
  SELECT request_id, key, portal_id, ok AS accepted FROM w"""


@query("st01_admission", ADMISSION_SQL)
def st01(spark, sf):
    return ex.admit(beds.requests(spark, sf))


@query("st05_key_expiry", f"WITH {B6} SELECT key, count(*) AS live FROM req WHERE NOT expires_at < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def st05(spark, sf):
    live, _ = ex.drop_expired_keys(beds.requests(spark, sf), "2024-01-20 00:00:00")
    return live.groupBy("key").agg(F.count("*").alias("live"))


@query("so02_queue", f"""WITH {B4} SELECT submission_id, portal_id, CAST(created_at AS VARCHAR) AS created_at, task_type, outcome, array_to_string(themes, '|') AS themes, CASE WHEN length(free_text) > 160 THEN left(free_text, 160) || '…' ELSE free_text END AS preview, consent
  FROM subs WHERE status = 'pending' ORDER BY subs.created_at, submission_id LIMIT 50""")
def so02(spark, sf):
    return plain(ex.moderation_queue(joined(spark, sf)))


@query("fn30_previews", "SELECT conv_id, turn, CASE WHEN length(text) > 160 THEN left(text, 160) || '…' ELSE text END AS preview FROM conversations")
def fn30(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.moderation_preview(F.col("text")).alias("preview"))


@query("so03_page", f"WITH {B4}, {VISIBLE} SELECT submission_id, CAST(created_at AS VARCHAR) AS created_at FROM vis WHERE portal_id = 7 ORDER BY vis.created_at DESC, submission_id LIMIT 1 OFFSET 1")
def so03(spark, sf):
    return plain(ex.approved_page(visible(spark, sf), 7, "2", "1")[0], "submission_id", "created_at")


@query("ag20_page_total", f"WITH {B4}, {VISIBLE} SELECT count(*) AS total FROM vis WHERE portal_id = 7")
def ag20(spark, sf):
    return ex.approved_page(visible(spark, sf), 7)[1]


@query("st06_retention", f"""WITH {B4}, gone AS (SELECT submission_id FROM subs WHERE status = 'rejected' AND moderated_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY)
  SELECT 'submissions' AS relation, count(*) AS rows FROM subs WHERE submission_id NOT IN (SELECT submission_id FROM gone) UNION ALL
  SELECT 'moderation', count(*) FROM subs WHERE submission_id NOT IN (SELECT submission_id FROM gone) UNION ALL SELECT 'deleted', count(*) FROM gone""")
def st06(spark, sf):
    """Both tables rewritten; the counts were observed while they were written."""
    counts = ex.write_retained(beds.submissions(spark, sf), beds.moderation(spark, sf), NOW, scratch_path(spark, "retained"))
    rows = [("submissions", counts["submissions"]), ("moderation", counts["moderation"]), ("deleted", counts["rejected_submissions_deleted"])]
    return spark.createDataFrame(rows, "relation string, rows bigint")


def decision_batch(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "labels").select(
        F.when(d % 50 == 0, d + 100000000).otherwise(d).alias("submission_id"),
        F.when(d % 3 == 0, "approved").when(d % 3 == 1, "rejected").otherwise("needs_redaction").alias("decision"),
        F.when(d % 4 == 1, F.lit("spam")).alias("reason_code"), F.when(d % 6 == 2, F.lit("redacted text")).alias("public_text"))


DECISIONS_SQL = """dd AS (SELECT CASE WHEN doc_id % 50 = 0 THEN doc_id + 100000000 ELSE doc_id END AS submission_id, CASE doc_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'needs_redaction' END AS decision,
    CASE WHEN doc_id % 4 = 1 THEN 'spam' END AS reason_code, CASE WHEN doc_id % 6 = 2 THEN 'redacted text' END AS public_text FROM labels),
  bad AS (SELECT submission_id, decision, CASE WHEN decision = 'needs_redaction' AND coalesce(public_text, '') = '' THEN 'needs_redaction requires public text' WHEN submission_id NOT IN (SELECT submission_id FROM subs) THEN 'submission not found' END AS error FROM dd)"""


@query("st07_moderation", f"""WITH {B4}, {DECISIONS_SQL}, ok AS (SELECT dd.* FROM dd JOIN bad USING (submission_id) WHERE error IS NULL)
  SELECT s.submission_id, coalesce(ok.decision, s.status) AS status, CAST(CASE WHEN ok.decision IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE moderated_at END AS VARCHAR) AS moderated_at, ok.reason_code,
  CASE WHEN ok.decision = 'approved' AND ok.public_text IS NULL THEN s.free_text ELSE ok.public_text END AS public_text FROM subs s LEFT JOIN ok USING (submission_id)""")
def st07(spark, sf):
    return plain(ex.apply_decisions(beds.moderation(spark, sf), beds.submissions(spark, sf), decision_batch(spark, sf), NOW)[0])


@query("st07_refused_decisions", f"WITH {B4}, {DECISIONS_SQL} SELECT submission_id, decision, error FROM bad WHERE error IS NOT NULL")
def st07_refused(spark, sf):
    return ex.apply_decisions(beds.moderation(spark, sf), beds.submissions(spark, sf), decision_batch(spark, sf), NOW)[1]


# Review gates ---------------------------------------------------------------------------


def review_inputs(spark, sf):
    return (
        beds.review_findings(spark, sf), beds.review_decisions(spark, sf), beds.review_portals(spark, sf),
        review.effective_privacy(beds.review_artifacts(spark, sf), beds.privacy_overlays(spark, sf)), beds.overlap_comparisons(spark, sf))


def all_issues(spark, sf):
    return review.review_issues(*review_inputs(spark, sf), beds.RUN_ID)


PUBLISHED = "pub AS (SELECT rf.*, overridden_severity, overridden_action FROM rf JOIN dec USING (finding_id) WHERE decision = 'publish')"
EVIDENCE = """ev AS (SELECT CASE WHEN a.artifact_id IS NULL THEN 'unresolved_evidence_ref' ELSE 'unreviewed_evidence' END AS code, CAST(p.finding_id AS VARCHAR) AS finding_id, ref AS detail
    FROM pub p JOIN refs USING (finding_id) LEFT JOIN art a ON a.artifact_id = ref WHERE NOT coalesce(a.reviewed, false))"""
OVERLAP = """ov AS (SELECT p.finding_id, p.portal_id, p.comparison_id AS wanted, c.* EXCLUDE (comparison_id), c.comparison_id AS have FROM pub p LEFT JOIN cmp c ON c.comparison_id = p.comparison_id WHERE category = 'possible_overlap'),
  ovi AS (SELECT 'missing_overlap_comparison_id' AS code, CAST(finding_id AS VARCHAR) AS finding_id, CAST(NULL AS VARCHAR) AS detail FROM ov WHERE wanted IS NULL
    UNION ALL SELECT 'overlap_comparison_not_found', CAST(finding_id AS VARCHAR), wanted FROM ov WHERE wanted IS NOT NULL AND have IS NULL
    UNION ALL SELECT 'cross_run_overlap_comparison', CAST(finding_id AS VARCHAR), run_id FROM ov WHERE run_id <> 'run-1'
    UNION ALL SELECT 'non_publishable_overlap_conclusion', CAST(finding_id AS VARCHAR), conclusion FROM ov WHERE conclusion <> 'possible_overlap'
    UNION ALL SELECT 'overlap_portal_mismatch', CAST(finding_id AS VARCHAR), CAST(portal_id AS VARCHAR) FROM ov WHERE have IS NOT NULL AND portal_id <> portal_a AND portal_id <> portal_b
    UNION ALL SELECT 'overlap_portal_not_found', CAST(finding_id AS VARCHAR), 'A ' || portal_a FROM ov WHERE have IS NOT NULL AND portal_a NOT IN (SELECT portal_id FROM rp)
    UNION ALL SELECT 'overlap_portal_not_found', CAST(finding_id AS VARCHAR), 'B ' || portal_b FROM ov WHERE have IS NOT NULL AND portal_b NOT IN (SELECT portal_id FROM rp)
    UNION ALL SELECT CASE WHEN a.artifact_id IS NULL THEN 'unresolved_overlap_evidence_ref' ELSE 'unreviewed_overlap_evidence' END, CAST(finding_id AS VARCHAR), c.ref
      FROM ov JOIN cref c ON c.comparison_id = have LEFT JOIN art a ON a.artifact_id = c.ref WHERE NOT coalesce(a.reviewed, false))"""
AVAIL = "('availability.unavailable.v1','availability.server-error.v1','availability.not-found.v1','redirect.cross-domain.v1','availability.automation-blocked.v1','availability.access-restricted.v1')"
ISSUES = f"""{PUBLISHED}, {EVIDENCE}, {OVERLAP}, iss AS (
    SELECT 'stale_review_reference' AS code, CAST(finding_id AS VARCHAR) AS finding_id, CAST(NULL AS VARCHAR) AS detail FROM dec WHERE finding_id NOT IN (SELECT finding_id FROM rf)
    UNION ALL SELECT 'missing_review_decision', CAST(finding_id AS VARCHAR), rule_id FROM rf WHERE finding_id NOT IN (SELECT finding_id FROM dec)
    UNION ALL SELECT 'unknown_portal', CAST(finding_id AS VARCHAR), CAST(portal_id AS VARCHAR) FROM pub WHERE portal_id NOT IN (SELECT portal_id FROM rp)
    UNION ALL SELECT 'review_retirement_from_availability_only', CAST(finding_id AS VARCHAR), rule_id FROM pub WHERE overridden_action = 'review_retirement' AND rule_id IN {AVAIL}
    UNION ALL SELECT * FROM ev UNION ALL SELECT * FROM ovi)"""
R = f"WITH {B7}, "


@query("rv03_stale", f"WITH {B7} SELECT finding_id, decision FROM dec WHERE finding_id NOT IN (SELECT finding_id FROM rf)")
def rv03(spark, sf):
    return review.stale_decisions(beds.review_decisions(spark, sf), beds.review_findings(spark, sf)).select("finding_id", "decision")


@query("rv04_awaiting", f"WITH {B7} SELECT finding_id, rule_id, severity FROM rf WHERE finding_id NOT IN (SELECT finding_id FROM dec)")
def rv04(spark, sf):
    return review.awaiting_review(beds.review_findings(spark, sf), beds.review_decisions(spark, sf)).select("finding_id", "rule_id", "severity")


@query("rv05_unknown_portal", f"{R}{PUBLISHED} SELECT finding_id, portal_id FROM pub WHERE portal_id NOT IN (SELECT portal_id FROM rp)")
def rv05(spark, sf):
    f, d, p, _, _ = review_inputs(spark, sf)
    return review.unknown_portal(review.to_publish(f, d), p).select("finding_id", "portal_id")


@query("rv06_retirement_override", f"{R}{PUBLISHED} SELECT finding_id, rule_id FROM pub WHERE overridden_action = 'review_retirement' AND rule_id IN {AVAIL}")
def rv06(spark, sf):
    f, d, *_ = review_inputs(spark, sf)
    return review.retirement_from_availability(review.to_publish(f, d)).select("finding_id", "rule_id")


@query("rv07_evidence", f"{R}{PUBLISHED}, {EVIDENCE} SELECT * FROM ev")
def rv07(spark, sf):
    f, d, _, reviewed, _ = review_inputs(spark, sf)
    return review.evidence_issues(review.to_publish(f, d), reviewed)


@query("rv08_overlap_gates", f"{R}{PUBLISHED}, {OVERLAP} SELECT * FROM ovi")
def rv08(spark, sf):
    f, d, p, reviewed, c = review_inputs(spark, sf)
    return review.overlap_issues(review.to_publish(f, d), c, p, reviewed, beds.RUN_ID)


@query("rv10_issues", f"{R}{ISSUES} SELECT code, count(*) AS issues FROM iss GROUP BY 1")
def rv10_issues(spark, sf):
    return all_issues(spark, sf).groupBy("code").agg(F.count("*").alias("issues"))


@query("rv10_publishable", f"{R}{ISSUES} SELECT finding_id, coalesce(overridden_severity, severity) AS severity, coalesce(overridden_action, suggested_action) AS suggested_action FROM pub WHERE CAST(finding_id AS VARCHAR) NOT IN (SELECT finding_id FROM iss)")
def rv10(spark, sf):
    f, d, *_ = review_inputs(spark, sf)
    return review.publishable(f, d, all_issues(spark, sf)).select("finding_id", "severity", "suggested_action")


@query("rv10_run_verdict", f"{R}{ISSUES} SELECT count(*) AS issues, count(*) = 0 AS ok FROM iss")
def rv10_verdict(spark, sf):
    return review.run_verdict(all_issues(spark, sf))


@query("dv04_overrides", f"{R}{PUBLISHED} SELECT finding_id, 'reviewed' AS review_status, coalesce(overridden_severity, severity) AS severity, coalesce(overridden_action, suggested_action) AS suggested_action FROM pub")
def dv04(spark, sf):
    f, d, *_ = review_inputs(spark, sf)
    return review.apply_overrides(review.to_publish(f, d)).select("finding_id", "review_status", "severity", "suggested_action")


CHOSEN = """okc AS (SELECT * FROM cmp WHERE run_id = 'run-1' AND portal_a IN (SELECT portal_id FROM rp) AND portal_b IN (SELECT portal_id FROM rp)
    AND NOT EXISTS (SELECT 1 FROM cref c LEFT JOIN art a ON a.artifact_id = c.ref WHERE c.comparison_id = cmp.comparison_id AND NOT coalesce(a.reviewed, false))),
  chosen AS (SELECT portal_id, min(comparison_id) AS comparison_id, arg_min(conclusion, comparison_id) AS conclusion FROM (
    SELECT portal_a AS portal_id, comparison_id, conclusion FROM okc UNION ALL SELECT portal_b, comparison_id, conclusion FROM okc WHERE portal_a <> portal_b) GROUP BY 1)"""
USED = f"used AS (SELECT ref FROM refs WHERE finding_id IN (SELECT finding_id FROM pub WHERE CAST(finding_id AS VARCHAR) NOT IN (SELECT finding_id FROM iss)) UNION SELECT ref FROM cref WHERE comparison_id IN (SELECT comparison_id FROM chosen))"


def chosen(spark, sf):
    _, _, p, reviewed, c = review_inputs(spark, sf)
    return rollup.select_comparison(c, p, review.unreviewed_refs(c, reviewed), beds.RUN_ID)


@query("jn12_selected_comparison", f"{R}{CHOSEN} SELECT portal_id, comparison_id, conclusion FROM chosen")
def jn12(spark, sf):
    return chosen(spark, sf)


@query("dv03_continuing_role", f"{R}{CHOSEN} SELECT portal_id, CASE WHEN conclusion IS NULL THEN 'not_reviewed' WHEN conclusion IN ('possible_overlap', 'distinct') THEN conclusion ELSE 'unclear' END AS continuing_role FROM rp LEFT JOIN chosen USING (portal_id)")
def dv03(spark, sf):
    p = beds.review_portals(spark, sf).select("portal_id")
    return p.join(chosen(spark, sf), "portal_id", "left").select("portal_id", rollup.continuing_role(F.col("conclusion")).alias("continuing_role"))


def used(spark, sf):
    f, d, _, _, c = review_inputs(spark, sf)
    picked = c.join(chosen(spark, sf).select("comparison_id"), "comparison_id", "left_semi")
    return review.used_evidence(review.publishable(f, d, all_issues(spark, sf)), picked)


@query("se05_used_evidence", f"{R}{ISSUES}, {CHOSEN}, {USED} SELECT ref AS artifact_id FROM used")
def se05(spark, sf):
    return used(spark, sf)


@query("dv05_published_artifacts", f"{R}{ISSUES}, {CHOSEN}, {USED} SELECT artifact_id, true AS privacy_reviewed FROM art WHERE artifact_id IN (SELECT ref FROM used)")
def dv05(spark, sf):
    return review.publication_artifacts(beds.review_artifacts(spark, sf), used(spark, sf)).select("artifact_id", "privacy_reviewed")


@query("jn10_finding_evidence", f"WITH {B7} SELECT finding_id, CAST(r.n - 1 AS INTEGER) AS pos, ref AS artifact_id FROM refs r JOIN art a ON a.artifact_id = ref WHERE reviewed")
def jn10(spark, sf):
    f, _, _, reviewed, _ = review_inputs(spark, sf)
    return review.published_evidence(f, reviewed)


@query("jn11_overlap_context", f"""WITH {B7} SELECT finding_id, rf.portal_id, c.comparison_id, CASE WHEN c.comparison_id IS NULL THEN NULL WHEN portal_a = rf.portal_id THEN portal_b ELSE portal_a END AS other_portal_id
  FROM rf LEFT JOIN (SELECT * FROM cmp WHERE status = 'completed' AND conclusion = 'possible_overlap') c ON c.comparison_id = rf.comparison_id""")
def jn11(spark, sf):
    return review.overlap_context(beds.review_findings(spark, sf), beds.overlap_comparisons(spark, sf))
