"""Derived inputs: the given tables put into the record shapes of the audit.

Every function maps whole tables with column expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webestate.functions import checks
from webestate.functions.html import page_title
from webestate.session import table

RUN_ID = "run-1"
ANALYZED_AT = "2024-02-01 00:00:00"

SOURCE_ROWS = [
    ("dir", "Estate directory listing", "Registry Office", "https://dir.example.org/list", "official_directory"),
    ("page", "Official landing page", "Registry Office", "https://page.example.org/", "official_page"),
    ("man", "Manual research notes", "Audit Desk", "https://man.example.org/", "manual_verified"),
    ("dir2", "Second directory for tion that was", "Archive Office", "https://dir2.example.org/list", "official_directory"),
    ("idle", "Listing without input", "Archive Office", "https://idle.example.org/", "manual_verified"),
]


def sources(spark: SparkSession) -> DataFrame:
    """Listing sources: a registry of fixed size."""
    return spark.createDataFrame(
        SOURCE_ROWS, "source_id string, source_name string, authority string, source_url string, source_type string"
    ).withColumn("retrieved_at", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """B1: listing rows from pages."""
    pages = table(spark, sf, "pages")
    n = F.col("page_id")
    return pages.select(
        n.alias("seq"),
        F.col("url").alias("raw_url"),
        F.regexp_extract("url", r"^(https?://[^/]+/[^/?#]+)", 1).alias("url"),
        page_title(F.col("html")).alias("name"),
        F.when(n % 4 == 0, "dir").when(n % 4 == 1, "page").when(n % 4 == 2, "man").otherwise("dir2").alias("source_id"),
        F.when(n % 5 == 0, " ").otherwise(F.concat(F.lit("DEPT_"), n % 7)).alias("department"),
        F.lit(None).cast("string").alias("portal_type"),
        F.array(F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1)).alias("tags"),
        F.when(n % 3 == 0, "listed").when(n % 3 == 1, "outbound_link").otherwise("manual").alias("discovery_method"),
    )


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    """http sites on mobile hosts stand for their https twin."""
    return (
        table(spark, sf, "pages")
        .select(F.regexp_extract("url", r"^(http://m\.[^/]+/[^/?#]+)", 1).alias("from_url"))
        .filter("from_url <> ''")
        .distinct()
        .withColumn("to_url", F.regexp_replace("from_url", "^http:", "https:"))
        .withColumn("seq", F.lit(0).cast("bigint"))
    )


def page_observations(spark: SparkSession, sf: str) -> DataFrame:
    """B2: page checks from events."""
    e = table(spark, sf, "events").filter("event_type <> 'view'")
    canonical = F.concat(F.lit("https://p"), F.col("user_id"), F.lit(".example.org/"))
    kind, err, n = F.col("user_id") % 10, F.col("event_type") == "error", F.col("event_id")
    code = (
        F.when(kind == 0, "DNS_FAILURE").when(kind == 1, "CONNECT_TIMEOUT").when(kind == 2, "HTTP_SERVER_ERROR")
        .when(kind == 3, "HTTP_CLIENT_ERROR").when(kind == 4, "HTTP_CLIENT_ERROR").when(kind == 5, "AUTOMATION_BLOCKED")
        .when(kind == 6, "AUTH_REQUIRED").when(kind == 7, "TLS_CERT_EXPIRED").when(kind == 8, "TLS_HOST_MISMATCH")
    )
    code = F.when(err, code)
    status = F.when(
        err & code.isNotNull(),
        F.when(kind == 2, 503).when(kind == 3, 404).when(kind == 4, 403).when(kind == 6, 401),
    ).otherwise(200)
    return e.select(
        F.lit(RUN_ID).alias("run_id"),
        n.alias("seq"),
        F.concat(F.lit("obs-"), n).alias("observation_id"),
        F.col("user_id").alias("portal_id"),
        F.when(F.col("event_type").isin("error", "click"), canonical)
        .otherwise(F.concat(canonical, F.col("event_type"))).alias("requested_url"),
        F.when(
            F.col("event_type") == "click",
            F.when(n % 10 == 0, "http://other.example.net/").when(n % 10 == 1, F.regexp_replace(canonical, "^https", "http")),
        ).alias("final_url"),
        F.array().cast("array<struct<url:string,status:int>>").alias("redirect_chain"),
        F.col("ts").alias("checked_at"),
        (1 + n % 3).cast("int").alias("attempt"),
        F.when(n % 25 == 0, "browser").otherwise("http").alias("fetch_mode"),
        status.cast("int").alias("http_status"),
        code.alias("error_code"),
        F.lit(None).cast("string").alias("error_message"),
        F.when(n % 6 == 0, "application/pdf").otherwise("text/HTML; charset=utf-8").alias("content_type"),
    )


def skip_log(spark: SparkSession, sf: str) -> DataFrame:
    """B2: addresses a run chose not to fetch."""
    n = F.col("event_id")
    return table(spark, sf, "events").filter("event_type = 'view'").select(
        F.col("user_id").alias("portal_id"),
        F.concat(F.lit("https://p"), F.col("user_id"), F.lit(".example.org/v/"), n).alias("url"),
        F.lit(1).alias("depth"),
        F.when(n % 4 == 0, "robots_disallowed").when(n % 4 == 1, "maxPagesPerPortal reached")
        .when(n % 4 == 2, 'matches excluded route category "login"')
        .otherwise('hostname "x.example.net" is not a registered hostname for this portal').alias("reason"),
    )


def link_observations(spark: SparkSession, sf: str) -> DataFrame:
    """B3: link checks from lineitem."""
    li = table(spark, sf, "lineitem")
    calm = (F.col("l_suppkey") % 10).isin(4, 5, 6, 9)
    status = F.when(
        F.col("l_returnflag") == "R",
        F.when(calm, "pass").when(F.col("l_linenumber") % 5 == 0, "not_assessable").otherwise("fail"),
    ).when(F.col("l_returnflag") == "A", "not_applicable").otherwise("pass")
    return li.select(
        F.lit(RUN_ID).alias("run_id"),
        F.col("l_suppkey").alias("portal_id"),
        F.col("l_orderkey").alias("source_page"),
        (F.col("l_partkey") % 50).alias("destination"),
        status.alias("status"),
        F.when((status == "fail") & (F.col("l_linenumber") % 4 != 2), "HTTP_CLIENT_ERROR").alias("error_code"),
        F.when(status == "fail", F.when(F.col("l_partkey") % 2 == 0, 404).otherwise(410)).alias("http_status"),
        (1 + F.col("l_linenumber") % 3).cast("int").alias("attempts"),
        F.col("l_shipdate").alias("checked_at"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"),
    )


def portals(spark: SparkSession, sf: str) -> DataFrame:
    """Portal dimension from supplier, nation and region."""
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    key = F.col("s_suppkey")
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            key.alias("portal_id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("https://p"), key, F.lit(".example.org/")).alias("canonical_url"),
            F.array(F.concat(F.lit("p"), key, F.lit(".example.org"))).alias("hostnames"),
            F.array(F.concat(F.lit("http://p"), key, F.lit(".example.org/"))).alias("alternate_urls"),
            F.when(key % 5 == 0, F.lit(None)).otherwise(F.col("n_name")).alias("department"),
            F.when(key % 3 == 0, "service").when(key % 3 == 1, "information").otherwise("unknown").alias("portal_type"),
            F.when((F.col("r_regionkey") <= 1) | (key % 7 == 0), "verified").otherwise("unverified").alias("official_status"),
            F.array(F.concat(F.lit("src-"), F.col("r_regionkey"))).alias("source_refs"),
        )
    )


def portal_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Listing sources of the portal dimension, one per region."""
    k = F.col("r_regionkey")
    return table(spark, sf, "region").select(
        F.concat(F.lit("src-"), k).alias("source_id"),
        F.concat(F.lit("Supplier register "), F.col("r_name")).alias("source_name"),
        F.concat(F.lit("https://dir"), k, F.lit(".example.org/list")).alias("source_url"),
        F.when(k == 0, "official_directory").when(k == 1, "official_page").otherwise("manual_verified").alias("source_type"),
        F.lit("2024-01-15 00:00:00").cast("timestamp_ntz").alias("retrieved_at"),
    )


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """B4: visitor reports from orders."""
    return submissions_from(table(spark, sf, "orders"))


def submissions_from(orders: DataFrame) -> DataFrame:
    """B4 over any frame of orders, streaming ones too."""
    k = F.col("o_orderkey")
    themes, tasks = (F.array(*(F.lit(v) for v in vs)) for vs in (checks.THEMES, checks.TASK_TYPES))
    priority = F.substring("o_orderpriority", 1, 1)
    return orders.select(
        k.alias("submission_id"),
        F.col("o_custkey").alias("portal_id"),
        F.expr("o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 as int), 0)").alias("created_at"),
        F.when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM"))
        .when(k % 3 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("occurred_on"),
        F.element_at(tasks, (k % 9 + 1).cast("int")).alias("task_type"),
        F.when(priority == "1", "completed").when(priority == "2", "partially_completed")
        .when(priority == "3", "not_completed").when(priority == "4", "information_only")
        .otherwise("other").alias("outcome"),
        F.array(F.element_at(themes, (k % 13 + 1).cast("int")), F.element_at(themes, (k % 7 + 1).cast("int"))).alias("themes"),
        F.when(k % 4 != 0, (1 + k % 5).cast("int")).alias("rating"),
        (k % 10 != 0).alias("consent"),
        F.concat(F.lit("Report  on order "), k % 50, F.lit(" ")).alias("free_text"),
        F.when(k % 8 == 0, "kiosk").when(k % 2 == 0, "mobile").alias("device_type"),
        F.lit("public_form").alias("source"),
    )


def moderation(spark: SparkSession, sf: str) -> DataFrame:
    """B4: one moderation row per report."""
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
    return table(spark, sf, "orders").select(
        k.alias("submission_id"),
        state.alias("status"),
        F.when(
            state != "pending",
            F.expr("o_orderdate + make_dt_interval(2, 0, cast(o_orderkey % 1440 as int), 0)"),
        ).alias("moderated_at"),
        F.lit(None).cast("string").alias("reason_code"),
        F.lit(None).cast("string").alias("public_text"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """B6: report requests from events."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("key"),
        F.col("event_type").alias("portal_id"),
        (F.col("user_id") % 3).alias("task_type"),
        F.lit("completed").alias("outcome"),
        F.concat(F.lit("note "), F.col("event_id") % 2).alias("free_text"),
        F.col("ts").alias("created_at"),
        F.expr("ts + interval 24 hours").alias("expires_at"),
    )


# Review bed B7 -------------------------------------------------------------

REVIEW_RULES = (
    ("availability.unavailable.v1", "availability"), ("availability.server-error.v1", "availability"),
    ("availability.not-found.v1", "availability"), ("redirect.cross-domain.v1", "availability"),
    ("availability.automation-blocked.v1", "availability"), ("availability.access-restricted.v1", "availability"),
    ("broken_link.repeated-failure.v1", "broken_link"), ("https.certificate-failure.v1", "https"),
    ("https.no-tls-upgrade.v1", "https"), ("freshness.no-signal.v1", "freshness"),
    ("crawl_coverage.summary.v1", "crawl_coverage"),
    ("directory_mismatch.unavailable-destination.v1", "directory_mismatch"),
    ("directory_mismatch.listed-vs-observed.v1", "directory_mismatch"),
    ("directory_mismatch.official-portal-not-listed.v1", "directory_mismatch"),
)


def review_portals(spark: SparkSession, sf: str) -> DataFrame:
    """Known portals of the review bed: key 49 of the fifty is missing."""
    return table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("portal_id")).distinct().filter(
        "portal_id <> 49"
    ).withColumn("name", F.concat(F.lit("Portal "), F.col("portal_id")))


def review_findings(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    rules = F.array(*(F.lit(r) for r, _ in REVIEW_RULES))
    cats = F.array(*(F.lit(c) for _, c in REVIEW_RULES))
    idx = (d % 14 + 1).cast("int")
    overlap = d % 9 == 0
    return table(spark, sf, "documents").select(
        d.alias("finding_id"),
        F.lit(RUN_ID).alias("run_id"),
        (d % 50).alias("portal_id"),
        F.element_at(rules, idx).alias("rule_id"),
        F.when(overlap, "possible_overlap").otherwise(F.element_at(cats, idx)).alias("category"),
        F.when(F.col("n_chars") % 3 == 0, "critical").when(F.col("n_chars") % 3 == 1, "significant")
        .otherwise("advisory").alias("severity"),
        F.when(F.col("n_chars") % 4 == 0, "repair").when(F.col("n_chars") % 4 == 1, "manual_assessment")
        .when(F.col("n_chars") % 4 == 2, "maintain").otherwise("review_consolidation").alias("suggested_action"),
        F.when(overlap & (d % 27 != 0), F.concat(F.lit("cmp-"), d % 120)).alias("overlap_comparison_id"),
        F.array(F.concat(F.lit("e"), d, F.lit("-1")), F.concat(F.lit("e"), d, F.lit("-2"))).alias("evidence_refs"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id % 100000 as int), 0)").alias("last_observed_at"),
    )


def review_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Two artifacts per finding; the second is missing for every 17th."""
    d = F.col("doc_id")
    return (
        table(spark, sf, "documents")
        .select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
        .filter(~((d % 17 == 0) & (F.col("n") == 2)))
        .select(
            F.concat(F.lit("e"), d, F.lit("-"), F.col("n")).alias("artifact_id"),
            F.lit(RUN_ID).alias("run_id"),
            (d % 50).alias("portal_id"),
            (d % 35 == 0).alias("privacy_reviewed"),
        )
    )


def privacy_overlays(spark: SparkSession, sf: str) -> DataFrame:
    return review_artifacts(spark, sf).select(
        "artifact_id",
        (F.regexp_extract("artifact_id", r"^e(\d+)", 1).cast("bigint") % 5 != 0).alias("privacy_reviewed"),
    )


def review_decisions(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "labels").select(
        F.when(d % 50 == 0, d + 1000000).otherwise(d).alias("finding_id"),
        F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "publish")
        .otherwise("needs_more_evidence").alias("decision"),
        F.when(d % 13 == 0, "advisory").alias("overridden_severity"),
        F.when(d % 11 == 0, "review_retirement").alias("overridden_action"),
    )


def overlap_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed pairs: consecutive supplier keys."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("cmp-"), k).alias("comparison_id"),
        F.when(k % 13 == 0, "run-0").otherwise(F.lit(RUN_ID)).alias("run_id"),
        (k % 53).alias("portal_a"),
        ((k + 9) % 50).alias("portal_b"),
        F.when(k % 11 == 0, "draft").otherwise("completed").alias("status"),
        F.when(k % 3 == 0, "possible_overlap").when(k % 3 == 1, "distinct").otherwise("insufficient_evidence").alias("conclusion"),
        F.array(F.concat(F.lit("e"), k * 3, F.lit("-1")), F.concat(F.lit("e"), k * 3, F.lit("-2"))).alias("evidence_refs"),
    )


# Robots and frontier beds ----------------------------------------------------

ROBOTS_TEMPLATES = (
    "# site rules\nUser-agent: *\nDisallow: /en/\nAllow: /en/7\nDisallow:\n",
    "User-agent: alphabot\nUser-agent: siteauditbot\nDisallow: /de/ # german\nDisallow: /*.html$\n\nUser-agent: *\nDisallow: /\n",
    "User-agent: other\nDisallow: /\nUser-Agent: *\nDisallow: /*?page=\nAllow: /fr/*?page=2\nnonsense line\nDisallow: /es/\n",
)
USER_AGENT = "SiteAuditBot/1.0 (+https://audit.example.org/about)"


def robots_texts(spark: SparkSession, sf: str) -> DataFrame:
    """B8: one robots text per host, by host name length."""
    host = F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)
    hosts = table(spark, sf, "pages").select(host.alias("host")).distinct()
    a, b, c = (F.lit(t) for t in ROBOTS_TEMPLATES)
    return hosts.withColumn(
        "body", F.when(F.length("host") % 3 == 0, a).when(F.length("host") % 3 == 1, b).otherwise(c)
    )


def frontier_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A link graph per portal from lineitem keys: 200 nodes, some foreign, some excluded."""
    li = table(spark, sf, "lineitem")
    node, dest = F.col("l_orderkey") % 200, F.col("l_partkey") % 200
    base = F.concat(F.lit("https://p"), F.col("l_suppkey"), F.lit(".example.org"))
    target = (
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("https://other.example.net/n/"), dest))
        .when(dest % 37 == 0, F.concat(base, F.lit("/login/"), dest))
        .otherwise(F.concat(base, F.lit("/n/"), dest))
    )
    return li.select(
        F.col("l_suppkey").alias("portal_id"),
        F.concat(base, F.lit("/n/"), node).alias("from_url"),
        target.alias("to_url"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice").alias("pos"),
    )


def frontier_seeds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    base = F.concat(F.lit("https://p"), k, F.lit(".example.org/n/"))
    return table(spark, sf, "supplier").select(
        k.alias("portal_id"),
        F.array(F.concat(F.lit("p"), k, F.lit(".example.org"))).alias("hostnames"),
        F.array(F.concat(base, k % 200), F.concat(base, (k * 7) % 200)).alias("seed_urls"),
    )
