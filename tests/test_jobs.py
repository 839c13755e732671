"""Edge cases of rules, inventory, links, admission, review and publication."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from webestate.operators import experience as ex
from webestate.operators import inventory, links, publish, quality, rollup
from webestate.operators.rules import REGISTRY, RuleContext, run_rules, scoped_portals, select_rules
from webestate.functions.urls import CrawlPolicy
from webestate.sources import records, snapshots

URL = "https://p.example.org/"
OBS = "portal_id string, seq bigint, observation_id string, requested_url string, final_url string, redirect_chain array<struct<url:string,status:int>>, checked_at timestamp_ntz, attempt int, fetch_mode string, http_status int, error_code string, error_message string"
LINK = "portal_id string, source_page string, destination string, status string, error_code string, attempts int, checked_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def obs(n, code=None, status=None, attempt=1, url=URL, final=None, chain=()):
    return ("p", n, f"o{n}", url, final, list(chain), T0 + dt.timedelta(hours=n), attempt, "http", status, code, None)


def context(spark, pages=(), link_rows=(), skips=(), source_type="manual_verified", status="verified", name="Site of Things", max_pages=40):
    portals = spark.createDataFrame([("p", name, URL, ["p.example.org"], status, ["s"])],
                                    "portal_id string, name string, canonical_url string, hostnames array<string>, official_status string, source_refs array<string>")
    sources = spark.createDataFrame([("s", "Site register", "https://d.example.org/list", source_type, T0)],
                                    "source_id string, source_name string, source_url string, source_type string, retrieved_at timestamp_ntz")
    return RuleContext("run", "2024-02-01 00:00:00", portals, sources, spark.createDataFrame(list(pages), OBS),
                       spark.createDataFrame(list(link_rows), LINK), spark.createDataFrame(list(skips), "portal_id string, url string, depth int, reason string"), max_pages=max_pages)


def fired(ctx, *rules):
    found = run_rules(ctx, [{"rule_id": r} for r in rules] if rules else None)
    return sorted((r["rule_id"], r["severity"]) for r in found.select("rule_id", "severity").collect())


def test_one_row_may_stand_for_three_attempts(spark):
    rule = "availability.unavailable.v1"
    assert fired(context(spark, [obs(1, "DNS_FAILURE", attempt=3)]), rule) == [(rule, "critical")]
    assert fired(context(spark, [obs(i, "DNS_FAILURE") for i in range(3)]), rule) == [(rule, "critical")]
    assert fired(context(spark, [obs(i, "DNS_FAILURE") for i in range(2)]), rule) == []
    assert fired(context(spark, [obs(1, "DNS_FAILURE", attempt=3, url=URL + "x")]), rule) == []


def test_server_errors_escalate_and_restrictions_do_not(spark):
    rule = "availability.server-error.v1"
    assert fired(context(spark, [obs(i, "HTTP_SERVER_ERROR", 503) for i in range(2)]), rule) == [(rule, "significant")]
    assert fired(context(spark, [obs(i, "HTTP_SERVER_ERROR", 503) for i in range(3)]), rule) == [(rule, "critical")]
    every = fired(context(spark, [obs(i, "AUTH_REQUIRED", 401) for i in range(5)], source_type="official_directory", name="Site"))
    assert ("availability.access-restricted.v1", "advisory") in every and not any(s == "critical" for _, s in every)
    forbidden = fired(context(spark, [obs(i, "HTTP_CLIENT_ERROR", 403) for i in range(5)]), "availability.access-restricted.v1", "availability.not-found.v1")
    assert forbidden == [("availability.access-restricted.v1", "advisory")]


def test_redirects_use_the_last_hop_source(spark):
    rule = "redirect.cross-domain.v1"
    away = obs(1, chain=[{"url": "https://q.example.org/", "status": 302}])
    assert fired(context(spark, [away, obs(2, final="https://P.example.org/x"), obs(3, final="nonsense")]), rule) == [(rule, "advisory")]


def test_broken_links_by_number_of_pages_and_source(spark):
    rule = "broken_link.repeated-failure.v1"
    rows = [("p", f"s{i}", "d", "fail", "HTTP_CLIENT_ERROR", 1, T0) for i in range(3)]
    assert fired(context(spark, link_rows=rows), rule) == [(rule, "significant")]
    assert fired(context(spark, link_rows=rows[:2]), rule) == [(rule, "advisory")]
    assert fired(context(spark, link_rows=rows[:1], source_type="official_page"), rule) == [(rule, "critical")]
    retried = run_rules(context(spark, link_rows=[(*rows[0][:5], 2, T0)]), [{"rule_id": rule}]).first()
    assert retried["confidence"] == "high" and retried["suggestion_rule_id"] == "suggestion.broken-navigation.v1"


def test_directory_rule_reads_earlier_critical_findings(spark):
    rule = "directory_mismatch.unavailable-destination.v1"
    ctx = context(spark, [obs(i, "CONNECT_TIMEOUT") for i in range(3)], source_type="official_directory")
    assert (rule, "advisory") in fired(ctx) and fired(ctx, rule) == []


def test_coverage_needs_rows_or_skips(spark):
    rule = "crawl_coverage.summary.v1"
    assert fired(context(spark), rule) == []
    row = run_rules(context(spark, skips=[("p", "u", 1, "robots_disallowed")]), [{"rule_id": rule}]).first()
    assert row["check_status"] == "warning" and "1 URL(s) were not fetched because robots.txt" in row["summary"]
    capped = run_rules(context(spark, [obs(1), obs(2, url=URL + "a")], max_pages=2), [{"rule_id": rule}]).first()
    assert "page budget was reached" in capped["summary"]


def test_rule_selection_and_scope(spark):
    chosen, unknown = select_rules([{"rule_id": "https.no-tls-upgrade.v1"}, {"rule_id": "nope"}, {"rule_id": "availability.unavailable.v1", "enabled": False}])
    assert [r.rule_id for r, _ in chosen] == ["https.no-tls-upgrade.v1"] and unknown == ["nope"]
    assert len(REGISTRY) == 14 and [r.category for r in REGISTRY][-3:] == ["directory_mismatch"] * 3
    ctx = context(spark)
    assert scoped_portals(ctx.portals, ctx.pages).count() == 1
    assert scoped_portals(ctx.portals, spark.createDataFrame([("z", 1)], "portal_id string, x int")).count() == 0


@pytest.mark.parametrize("rows,want", [
    ([("availability.not-found.v1", "critical"), ("https.x", "significant")], "unavailable"),
    ([("https.x", "significant"), ("availability.automation-blocked.v1", "advisory")], "degraded"),
    ([("availability.automation-blocked.v1", "advisory")], "not_assessable"),
    ([("availability.server-error.v1", "significant")], "degraded"), ([], "healthy"),
])
def test_health_precedence(spark, rows, want):
    portals = spark.createDataFrame([("p",)], "portal_id string")
    found = spark.createDataFrame([("p", *r) for r in rows], "portal_id string, rule_id string, severity string")
    assert rollup.portal_health(portals, found).first()["health"] == want


def test_most_urgent_action(spark):
    def best(*actions):
        return spark.createDataFrame([(a,) for a in actions], "suggested_action string").agg(rollup.most_urgent_action().alias("a")).first()["a"]

    assert best() == "maintain" and best("other") == "maintain" and best("maintain", "repair", "review_consolidation") == "repair"


def test_merge_keeps_provenance(spark):
    rows = [(1, "https://a.org/x/", "Blog", "man", None, ["t2"], "manual"), (2, "https://a.org/x", "Official", "dir", "D1", ["t1"], "listed"),
            (3, "http://a.org/x", "Twin", "man", "D2", [], "manual"), (4, "::", "Bad", "man", None, [], "manual")]
    c = spark.createDataFrame(rows, "seq bigint, url string, name string, source_id string, department string, tags array<string>, discovery_method string").withColumn("portal_type", F.lit(None).cast("string"))
    s = spark.createDataFrame([("man", "manual_verified", "https://m.org"), ("dir", "official_directory", "https://d.org")], "source_id string, source_type string, source_url string")
    alias = inventory.alias_map(spark.createDataFrame([("http://a.org/x", "https://b.org/", 1), ("http://a.org/x/", "https://a.org/x", 2)], "from_url string, to_url string, seq int"))
    resolved = inventory.with_canonical(c, alias)
    got = inventory.merge_candidates(resolved, s).collect()
    assert len(got) == 1
    p = got[0]
    assert (p["name"], p["department"], p["official_status"], p["tags"]) == ("Official", "D1", "verified", ["t1", "t2"])
    assert p["source_refs"] == ["man", "dir"] and p["alternate_urls"] == ["http://a.org/x"] and p["hostnames"] == ["a.org"] and len(p["discovery"]) == 2
    assert inventory.rejected(resolved).first()["reason"].startswith("URL normalization failed: malformed")
    with pytest.raises(ValueError):
        inventory.alias_map(spark.createDataFrame([("bad", "https://b.org/", 1)], "from_url string, to_url string, seq int"))


def test_links_with_base_context_and_empty_targets(spark):
    body = '<base href="https://b.org/d/"><p>see <a href="x?a=1&amp;b=2">the <b>page</b></a> now</p><script><a href="/no">no</a></script><a href="">e</a><a href="mailto:x@y">m</a>'
    rows = links.extract_links(spark.createDataFrame([(1, "https://a.org/", body)], "page_id int, url string, html string")).collect()
    assert [(r["raw_href"], r["resolved_url"], r["anchor_text"]) for r in rows] == [
        ("x?a=1&b=2", "https://b.org/d/x?a=1&b=2", "the page"), ("mailto:x@y", "mailto:x@y", "m")]
    assert rows[0]["context"] == "see the page now"


def test_robots_longest_match(spark):
    txt = "User-agent: siteauditbot\nUser-agent: x\nDisallow: /a\nAllow: /a/b$\nDisallow:\n\nUser-agent: *\nDisallow: /"
    rules = links.robots_rules(spark.createDataFrame([("h", txt)], "host string, body string"))
    groups = links.robots_groups(rules, "SiteAuditBot/1.0")
    pages = spark.createDataFrame([("h", p) for p in ("/a/b", "/a/bc", "/c")] + [("other", "/a")], "host string, path string")
    got = {(r["host"], r["path"]): r["allowed"] for r in links.robots_decisions(pages, groups).collect()}
    assert got == {("h", "/a/b"): True, ("h", "/a/bc"): False, ("h", "/c"): True, ("other", "/a"): True}


def _greedy(rows):
    taken, out = {}, {}
    for rid, key, portal, t in sorted(rows, key=lambda r: (r[3], r[0])):
        live = [a for a in taken.get(key, []) if a[0] >= t - dt.timedelta(hours=24)]
        ok = len(live) < 5 and sum(a[1] == portal for a in live) < 2
        taken[key] = live + ([(t, portal)] if ok else [])
        out[rid] = ok
    return out


def _requests(n, keys, days, seed):
    rng = random.Random(seed)
    return [(i, rng.randrange(keys), f"p{rng.randrange(4)}", T0 + dt.timedelta(seconds=rng.randrange(days * 86400))) for i in range(n)]


REQUEST = "request_id bigint, key bigint, portal_id string, created_at timestamp_ntz"


def test_admission_equals_brute_force(spark):
    # One key holds a third of all requests.
    rows = _requests(300, 12, 3, 1) + [(1000 + r[0], 99, r[2], r[3]) for r in _requests(150, 1, 3, 2)]
    got = {r["request_id"]: r["accepted"] for r in ex.admit(spark.createDataFrame(rows, REQUEST)).collect()}
    assert got == _greedy(rows)


def test_admission_of_one_dense_key_and_of_null_keys(spark):
    rows = _requests(6000, 1, 4, 7) + [(9000 + r[0], None, r[2], r[3]) for r in _requests(60, 1, 3, 8)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = {r["request_id"]: r["accepted"] for r in ex.admit(spark.createDataFrame(rows, REQUEST)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == _greedy(rows) and ex.admit(spark.createDataFrame([], REQUEST)).collect() == []


def test_inventory_orders(spark):
    rows = [(1, "beta", "healthy", 0, 0, 1, "2024-01-02"), (2, "Alpha", "degraded", 0, 1, 0, "2024-01-03"), (3, "alpha", "unavailable", 2, 0, 0, "2024-01-01"), (4, "Éa", "not_assessable", 0, 0, 0, "2024-01-02")]
    df = spark.createDataFrame(rows, "portal_id int, name string, technical_health string, critical_count int, significant_count int, advisory_count int, last_checked_at string")
    order = {k: [r["portal_id"] for r in publish.sort_inventory(df, k).collect()] for k in ("name", "health", "severity", "lastChecked")}
    assert order == {"name": [3, 2, 1, 4], "health": [3, 2, 4, 1], "severity": [3, 2, 1, 4], "lastChecked": [2, 1, 4, 3]}


def test_last_decision_about_a_report_counts(spark):
    m = spark.createDataFrame([(1, "pending", None, None, None), (2, "pending", None, None, None)], "submission_id int, status string, moderated_at timestamp_ntz, reason_code string, public_text string")
    s = spark.createDataFrame([(1, "own"), (2, "own")], "submission_id int, free_text string")
    batch = spark.createDataFrame([(1, "rejected", "spam", None, 5), (1, "approved", None, None, 9), (1, "needs_redaction", None, None, 10), (7, "approved", None, None, 1)],
                                  "submission_id int, decision string, reason_code string, public_text string, decided_at int")
    after, refused = ex.apply_decisions(m, s, batch, "2024-01-01 00:00:00")
    assert sorted((r["submission_id"], r["status"], r["public_text"]) for r in after.collect()) == [(1, "approved", "own"), (2, "pending", None)]
    assert sorted(r["submission_id"] for r in refused.collect()) == [1, 7]


def test_run_ids_stay_text(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "portal_id int")
    snapshots.write_snapshot({"portals": df}, str(tmp_path), "007")
    assert [tuple(r) for r in snapshots.read_current(spark, str(tmp_path), "portals").collect()] == [(1, "007")]


def test_admission_window_is_inclusive(spark):
    rows = [(i, 1, "p", T0 + dt.timedelta(hours=24 * i)) for i in range(3)] + [(10, 1, "p", T0 + dt.timedelta(hours=24))]
    got = {r["request_id"]: r["accepted"] for r in ex.admit(spark.createDataFrame(rows, REQUEST)).collect()}
    assert got == _greedy(rows) == {0: True, 1: True, 2: True, 10: False}


def test_rolling_counts_equal_brute_force(spark):
    rows = _requests(200, 3, 4, 3)
    got = {r["request_id"]: r["n"] for r in ex.rolling_counts(spark.createDataFrame(rows, REQUEST), ["key"], "created_at", 24, "n").collect()}
    day = dt.timedelta(hours=24)
    assert got == {r[0]: sum(1 for s in rows if s[1] == r[1] and r[3] - day <= s[3] <= r[3]) for r in rows}


def test_sequence_numbers_over_a_hot_key(spark):
    df = spark.range(500).select(F.lit("hot").alias("k"), F.col("id"))
    got = links.number_rows(df, "k", F.floor(F.col("id") / 37), ["id"])
    assert got.filter("sequence <> id + 1").count() == 0


def test_summary_flag_and_text_dates(spark):
    rows = [("p", "completed", None, "2024-05", 5), ("p", "odd", T0.replace(month=5), None, 2), ("p", "completed", None, "2024-05-01", None)]
    df = spark.createDataFrame(rows, "portal_id string, outcome string, created_at timestamp_ntz, occurred_on string, rating int")
    s = ex.experience_summary(df).first()
    assert (s["experiences"], s["completed"], s["rating_count"], s["average_rating"], s["small_sample"]) == (3, 2, 2, 3.5, True)
    assert (s["earliest"], s["latest"]) == ("2024-05", "2024-05-01T00:00:00.000Z")


@pytest.mark.parametrize("page,size,want", [(None, None, (1, 10)), ("0", "-3", (1, 10)), ("abc", "500", (1, 50)), ("3x", "7", (3, 7))])
def test_page_bounds(page, size, want):
    assert ex.page_bounds(page, size) == want


def test_retention_is_strict_and_keeps_undated(spark):
    m = spark.createDataFrame([(1, "rejected", dt.datetime(2024, 1, 1)), (2, "rejected", dt.datetime(2024, 1, 1, 0, 0, 1)), (3, "rejected", None), (4, "approved", dt.datetime(2020, 1, 1))],
                              "submission_id int, status string, moderated_at timestamp_ntz")
    assert [r[0] for r in ex.expired_submissions(m, "2024-03-31 00:00:01").collect()] == [1]


def test_facets_and_department_options(spark):
    rows = [("a", "Alpha", "D", "degraded", "repair", 1, 2, 0), ("b", "beta", None, "healthy", "maintain", 0, 0, 0)]
    df = spark.createDataFrame(rows, "portal_id string, name string, department string, technical_health string, suggested_action string, critical_count int, significant_count int, advisory_count int").withColumns({
        "canonical_url": F.concat(F.lit("https://"), "portal_id", F.lit(".org/")), "hostnames": F.array("portal_id"), "alternate_urls": F.array("portal_id"), "portal_type": F.lit("unknown")})

    def ids(**k):
        return [r["portal_id"] for r in publish.filter_inventory(df, publish.Facets(**k)).orderBy("portal_id").collect()]

    assert ids(severity="significant") == ["a"] and ids(q="  ") == ["a", "b"] and ids(department="Unspecified") == ["b"]
    assert ids(q="B.ORG") == ["b"] and ids(assessable="not_assessable") == []
    assert [r[0] for r in publish.department_options(df).collect()] == ["D", "Unspecified"]
    assert [r["portal_id"] for r in publish.sort_inventory(df, "severity").collect()] == ["a", "b"]


def test_record_scans(spark, tmp_path):
    good = '{"schemaVersion":"1","findingId":"f1","decision":"publish","reviewedAt":"2024-01-01T00:00:00Z","reviewer":"d","rationale":"r"}'
    bad = good.replace("publish", "maybe")
    path = tmp_path / "d.jsonl"
    path.write_text(good + "\n\n" + bad + "\n")
    assert records.read_records(spark, str(path), "review_decision", "lenient").count() == 1
    with pytest.raises(Exception, match="enum:decision"):
        records.read_records(spark, str(path), "review_decision").collect()
    assert records.read_records(spark, str(tmp_path / "none"), "review_decision").count() == 0
    path.write_text("{oops\n")
    with pytest.raises(Exception):
        records.read_records(spark, str(path), "review_decision", "lenient").collect()
    folder = tmp_path / "side"
    folder.mkdir()
    (folder / "f1.json").write_text(good)
    (folder / "f2.json").write_text(good)
    (folder / "f3.json").write_text("{")
    ok, errors = records.read_sidecars(spark, str(folder), "review_decision", "findingId")
    assert ok.count() == 1 and {r["file_key"] for r in errors.collect()} == {"f2", "f3"}


def test_snapshots_are_written_once(spark, tmp_path):
    root = str(tmp_path / "root")
    assert snapshots.known_portal_ids(spark, root) == (None, False)
    one = spark.createDataFrame([("a",)], "portal_id string")
    snapshots.write_snapshot({"portals": one}, root, "r1")
    with pytest.raises(FileExistsError):
        snapshots.write_snapshot({"portals": one}, root, "r1")
    snapshots.write_snapshot({"portals": spark.createDataFrame([("b",), ("c",)], "portal_id string")}, root, "r2")
    snapshots.write_snapshot({"portals": one}, root, "r1", overwrite=True)
    assert [r["portal_id"] for r in snapshots.read_current(spark, root, "portals").collect()] == ["a"]


def test_csv_export_has_guard_and_crlf(spark, sf, tmp_path):
    from webestate.plans.rollup_queries import assessments

    rows = assessments(spark, sf).withColumn("name", F.lit('=SUM("a")\nb'))
    snapshots.export_csv(rows, str(tmp_path / "csv"))
    texts = [p.read_bytes() for p in (tmp_path / "csv").glob("*.csv")]
    body = next(t for t in texts if b"SUM" in t)
    assert body.startswith(b"portalId,name,canonicalUrl") and b"\r\n" in body and b'"\'=SUM(""a"") b"' in body


def test_frontier_cap_counts_only_fetched_pages(spark):
    seeds = spark.createDataFrame([("p", ["h.org"], ["https://h.org/a", "https://h.org/blocked"])], "portal_id string, hostnames array<string>, seed_urls array<string>")
    edges = spark.createDataFrame([("p", "https://h.org/a", u, i) for i, u in enumerate(["https://h.org/a", "https://h.org/b", "https://h.org/login", "https://h.org/c", "https://o.org/", "::"])],
                                  "portal_id string, from_url string, to_url string, pos int")
    plan = links.visit_plan(seeds, edges, F.col("url").endswith("blocked"), CrawlPolicy(max_pages=2))
    got = {r["url"]: r["outcome"] for r in plan.collect()}
    assert got == {"https://h.org/a": "visit", "https://h.org/blocked": "robots_disallowed", "https://h.org/b": "visit",
                   "https://h.org/login": 'matches excluded route category "login"', "https://h.org/c": "maxPagesPerPortal reached",
                   "https://o.org/": 'hostname "o.org" is not a registered hostname for this portal', "::": "malformed URL: malformed URL (failed to parse)"}


def test_publication_stops_on_violations(spark):
    with pytest.raises(ValueError):
        quality.require_none(spark.range(1), "assessments")
    quality.require_none(spark.range(0), "assessments")


@pytest.mark.parametrize("name", ["ru07_broken_destinations", "dq02_run_violations", "tk03_directory_mismatches", "jn15_ip_ranges", "jn12_selected_comparison", "jn09_duplicates", "ag17_publication_summary"])
def test_plans_have_no_pairwise_join(spark, sf, name):
    from webestate.plans import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_a_twin():
    from webestate.plans import ORACLES, QUERIES

    assert set(ORACLES) == set(QUERIES)
