"""Queries over dated snapshots: histories, changes and as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webestate.operators import history
from webestate.plans import beds
from webestate.plans.catalog import plain, query
from webestate.plans.sql_beds import B3

# Bed: the link checks of a quarter are one run; every portal sits out every sixth run.


def quarterly_links(spark: SparkSession, sf: str) -> DataFrame:
    """Link checks with the run that made them."""
    links = beds.link_observations(spark, sf).withColumn("quarter", F.date_trunc("quarter", "checked_at").cast("timestamp_ntz"))
    number = F.year("quarter") * 4 + F.quarter("quarter")
    return (links.withColumn("run_at", F.expr("quarter + interval 3 months")).withColumn("run_id", F.date_format("quarter", "'q'yyyy-MM"))
            .where((F.col("portal_id") + number) % 6 != 0))


def run_inputs(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings per section of a portal, portals looked at, and runs."""
    failing = links.where(F.col("status").isin("fail", "not_assessable"))
    severity = F.when(F.count(F.lit(1)) >= 3, "critical").when(F.count(F.lit(1)) == 2, "significant").otherwise("advisory")
    states = (failing.groupBy("run_id", "portal_id", F.concat(F.lit("/s/"), F.col("destination") % 10).alias("section"))
              .agg(severity.alias("severity"), F.max("http_status").alias("http_status")))
    return states, links.select("run_id", "portal_id").distinct(), links.select("run_id", "run_at").distinct()


def finding_history(spark: SparkSession, sf: str) -> DataFrame:
    states, coverage, runs = run_inputs(quarterly_links(spark, sf))
    return history.interval_history(states, coverage, runs, "portal_id", ["section"], ["severity", "http_status"])


RUNS_SQL = rf"""WITH {B3}, links AS (
    SELECT * FROM (SELECT *, date_trunc('quarter', checked_at) AS quarter FROM b3)
    WHERE (portal_id + year(quarter) * 4 + quarter(quarter)) % 6 <> 0
), tagged AS (
    SELECT *, strftime(quarter, 'q%Y-%m') AS run_id, (quarter + INTERVAL 3 MONTH)::TIMESTAMP AS run_at FROM links
), visits AS (
    SELECT run_id, portal_id, run_at, row_number() OVER w AS visit, lead(run_at) OVER w AS next_at
    FROM (SELECT DISTINCT run_id, portal_id, run_at FROM tagged) WINDOW w AS (PARTITION BY portal_id ORDER BY run_at, run_id)
), states AS (
    SELECT run_id, portal_id, '/s/' || (destination % 10) AS section,
        CASE WHEN count(*) >= 3 THEN 'critical' WHEN count(*) = 2 THEN 'significant' ELSE 'advisory' END AS severity,
        max(CASE WHEN status = 'fail' THEN CASE WHEN l_partkey % 2 = 0 THEN 404 ELSE 410 END END) AS http_status
    FROM tagged WHERE status IN ('fail', 'not_assessable') GROUP BY ALL
), marked AS (
    SELECT s.*, v.visit, v.run_at, v.next_at, CASE
        WHEN lag(v.visit) OVER w IS NULL THEN 'appeared' WHEN v.visit - lag(v.visit) OVER w > 1 THEN 'reopened'
        WHEN lag(severity) OVER w IS DISTINCT FROM severity OR lag(http_status) OVER w IS DISTINCT FROM http_status THEN 'changed' END AS opened
    FROM states s JOIN visits v USING (run_id, portal_id) WINDOW w AS (PARTITION BY portal_id, section ORDER BY v.visit)
), numbered AS (
    SELECT *, count(opened) OVER (PARTITION BY portal_id, section ORDER BY visit) AS version FROM marked
), versions AS (
    SELECT portal_id, section, version, any_value(severity) AS severity, max(http_status) AS http_status, min(run_at) AS valid_from, arg_max(next_at, visit) AS next_at,
        arg_min(run_id, visit) AS first_run, arg_max(run_id, visit) AS last_run, count(*) AS n_runs, min(opened) AS opened_by, min(visit) AS a, max(visit) AS b,
        max(CASE WHEN next_at IS NULL THEN 1 ELSE 0 END) AS last_visit
    FROM numbered GROUP BY portal_id, section, version
), history AS (
    SELECT portal_id, section, version::INTEGER AS version, severity, http_status, valid_from, CASE WHEN last_visit = 0 THEN next_at END AS valid_to, first_run, last_run, n_runs, opened_by,
        CASE WHEN last_visit = 1 THEN NULL WHEN lead(a) OVER (PARTITION BY portal_id, section ORDER BY version) = b + 1 THEN 'changed' ELSE 'resolved' END AS closed_by
    FROM versions
)"""


@query("ex04_finding_history", RUNS_SQL + """
SELECT portal_id, section, version, severity, http_status, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to, first_run, last_run, n_runs, opened_by, closed_by FROM history""")
def ex04_finding_history(spark: SparkSession, sf: str) -> DataFrame:
    return plain(finding_history(spark, sf))


@query("ex04_run_changes", RUNS_SQL + """, moves AS (
    SELECT valid_from AS "at", opened_by AS what FROM history UNION ALL SELECT valid_to, 'resolved' FROM history WHERE closed_by = 'resolved'
), counts AS (
    SELECT "at", count(*) FILTER (WHERE what = 'appeared') AS appeared, count(*) FILTER (WHERE what = 'reopened') AS reopened,
        count(*) FILTER (WHERE what = 'changed') AS changed, count(*) FILTER (WHERE what = 'resolved') AS resolved FROM moves GROUP BY "at"
)
SELECT "at"::VARCHAR AS "at", appeared, reopened, changed, resolved, sum(appeared + reopened - resolved) OVER (ORDER BY "at")::BIGINT AS open_after FROM counts""")
def ex04_run_changes(spark: SparkSession, sf: str) -> DataFrame:
    return plain(history.changes_per_run(finding_history(spark, sf)))


@query("ex04_open_at_run", RUNS_SQL + """
SELECT r.run_id, h.severity, count(*) AS n FROM (SELECT DISTINCT run_id, run_at FROM tagged) r
JOIN history h ON h.valid_from <= r.run_at AND (h.valid_to IS NULL OR h.valid_to > r.run_at) GROUP BY ALL""")
def ex04_open_at_run(spark: SparkSession, sf: str) -> DataFrame:
    """Open findings at the time of every run, by severity: versions are counted where they begin and end, not once per run."""
    versions = finding_history(spark, sf)
    begins = versions.groupBy("severity", F.col("valid_from").alias("at")).agg(F.count(F.lit(1)).alias("d"))
    ends = versions.where("valid_to IS NOT NULL").groupBy("severity", F.col("valid_to").alias("at")).agg((-F.count(F.lit(1))).alias("d"))
    runs = run_inputs(quarterly_links(spark, sf))[2]
    steps = begins.unionByName(ends).groupBy("severity", "at").agg(F.sum("d").alias("d"))
    return (runs.join(steps, F.col("at") <= F.col("run_at")).groupBy("run_id", "severity").agg(F.sum("d").alias("n")).where("n > 0"))


@query("ex04_status_at_report", RUNS_SQL + """, status AS (
    SELECT run_id, portal_id, run_at, visit, (SELECT min(CASE severity WHEN 'critical' THEN 0 WHEN 'significant' THEN 1 ELSE 2 END) FROM states s
        WHERE s.run_id = v.run_id AND s.portal_id = v.portal_id) AS worst FROM visits v
), named AS (
    SELECT portal_id, run_at, CASE worst WHEN 0 THEN 'unavailable' WHEN 1 THEN 'degraded' WHEN 2 THEN 'noted' ELSE 'healthy' END AS status, run_id FROM status
), reports AS (
    SELECT o_orderkey AS submission_id, o_custkey AS portal_id, o_orderdate + to_minutes(o_orderkey % 1440) AS created_at FROM orders
)
SELECT submission_id, r.portal_id, created_at::VARCHAR AS created_at, n.status, n.run_id FROM reports r ASOF LEFT JOIN named n ON r.portal_id = n.portal_id AND r.created_at >= n.run_at""")
def ex04_status_at_report(spark: SparkSession, sf: str) -> DataFrame:
    """What the last run before each visitor report said about its portal."""
    states, coverage, runs = run_inputs(quarterly_links(spark, sf))
    worst = F.min(F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "significant", 1).otherwise(2))
    found = states.groupBy("run_id", "portal_id").agg(worst.alias("worst"))
    status = F.when(F.col("worst") == 0, "unavailable").when(F.col("worst") == 1, "degraded").when(F.col("worst") == 2, "noted").otherwise("healthy")
    seen = coverage.join(found, ["run_id", "portal_id"], "left").join(runs, "run_id").select("portal_id", "run_at", status.alias("status"), "run_id")
    reports = beds.submissions(spark, sf).select("submission_id", "portal_id", "created_at")
    return plain(history.asof_join(reports, seen, ["portal_id"], "created_at", "run_at", ["status", "run_id"], days=365))
