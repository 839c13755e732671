"""Nested exports, observed retention, SQL functions, brief findings and rules over several runs."""

import datetime as dt
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.test_jobs import OBS, context, obs
from webestate.functions.sql import register_functions
from webestate.operators import experience as ex
from webestate.operators.rules import rule_severities, run_rules
from webestate.plans import rule_queries as rules
from webestate.sources import snapshots

T0 = dt.datetime(2024, 1, 1)


def test_nested_parts_hold_every_finding_within_the_limit(spark):
    rows = [(1, f"f{i}", "x" * (i % 90)) for i in range(3000)] + [(2, "only", "y"), (3, "long", "z" * 5000), (3, "short", "z")] + [(1, "f7", "x" * 7)]
    findings = spark.createDataFrame(rows, "portal_id bigint, finding_id string, summary string")
    parts = snapshots.nested_parts(findings, most=2000).collect()
    assert sorted((r["portal_id"], f["finding_id"], f["summary"]) for r in parts for f in r["findings"]) == sorted(rows)
    for p in (1, 2, 3):
        assert sorted(r["part"] for r in parts if r["portal_id"] == p) == list(range(sum(r["portal_id"] == p for r in parts)))
    for r in parts:
        assert len(r["findings"]) == 1 or len(json.dumps([f.asDict() for f in r["findings"]], separators=(",", ":"))) <= 2002
    assert sum(r["portal_id"] == 1 for r in parts) < 400


def test_nested_export_is_one_object_per_portal(spark, tmp_path):
    findings = spark.createDataFrame([(1, "a", "s"), (1, "b", "s")], "portal_id bigint, finding_id string, summary string")
    portals = spark.createDataFrame([(1, "One"), (2, "Two")], "portal_id bigint, name string")
    snapshots.export_nested(spark.createDataFrame([(2,)], "portals int"), portals, findings, str(tmp_path / "doc"))
    rows = {r["portal_id"]: r for r in map(json.loads, (r.value for r in spark.read.text(str(tmp_path / "doc" / "portals")).collect()))}
    assert rows[1] == {"portal_id": 1, "name": "One", "findings": [{"finding_id": "a", "summary": "s"}, {"finding_id": "b", "summary": "s"}], "more_parts": 0}
    assert rows[2] == {"portal_id": 2, "name": "Two", "findings": [], "more_parts": 0}


def test_retention_counts_are_those_of_the_written_tables(spark, tmp_path):
    subs = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "submission_id bigint, free_text string")
    old = T0 - dt.timedelta(days=91)
    mod = spark.createDataFrame([(i, "rejected" if i % 2 else "approved", old if i < 6 else T0) for i in range(10)] + [(99, "rejected", None)], "submission_id bigint, status string, moderated_at timestamp_ntz")
    counts = ex.write_retained(subs, mod, str(T0), str(tmp_path / "kept"))
    assert counts == {"submissions": 7, "moderation": 8, "rejected_submissions_deleted": 3}
    kept = [spark.read.parquet(f"{tmp_path}/kept/{n}") for n in ("submissions", "moderation")]
    s, m, removed = ex.apply_retention(subs, mod, str(T0))
    assert kept[0].exceptAll(s).count() == 0 and kept[0].count() == s.count() == 7 and kept[1].count() == m.count()
    assert removed.first()[0] == 3 and kept[0].columns == subs.columns


def test_sql_functions(spark):
    assert "web_anchors" in register_functions(spark)
    row = spark.sql("""SELECT web_host('HTTPS://u@WWW.A.example:80/x?y') AS h, web_path('https://a/b/c?d#e') AS p, web_stem('http://m.a.example/') AS s, decoded('&lt;&#65;&nope;&amp;amp;') AS d,
        trimmed('  x y\t') AS t, page_title('<TITLE> a &amp; b </title>') AS title, name_tokens('The Land-Land of x') AS n, http_error(404) AS e, http_error(200) AS ok,
        names_disagree('Land office', 'Water board') AS no, names_disagree('Land office', 'office') AS yes""").first()
    assert tuple(row) == ("www.a.example", "/b/c", "a.example", "<A&nope;&amp;", "x y", "a & b", ["the", "land"], "HTTP_CLIENT_ERROR", None, True, False)
    html = """<a href="/1?a=1&amp;b=2" class=x>One <b>two</b></a><p><A title="<a href='no'>" HREF=' /2 '></A><a name="n">none</a><a\nhref=/3>3</a>"""
    spark.createDataFrame([(1, html), (2, None), (3, "no links")], "k int, h string").createOrReplaceTempView("t_pages")
    rows = spark.sql("SELECT k, a.href, a.anchor_text FROM t_pages, LATERAL web_anchors(h) a ORDER BY a.pos").collect()
    assert (1, "/1?a=1&b=2", "One two") in [tuple(r) for r in rows] and (1, "/3", "3") in [tuple(r) for r in rows]
    assert {r["k"] for r in rows} == {1}


def test_brief_findings_are_the_findings(spark, sf):
    ctx = rules.context(spark, sf)
    columns = ["portal_id", "rule_id", "category", "severity"]
    brief, full = rule_severities(ctx), run_rules(ctx).select(*columns)
    assert brief.columns == columns and brief.exceptAll(full).count() == 0 == full.exceptAll(brief).count()
    assert len(run_rules(ctx).columns) > 15


def test_failures_of_several_runs_count_by_their_spacing(spark):
    ctx = context(spark, [obs(9)])
    only = [{"rule_id": "availability.unavailable.v1", "parameters": {"spacedAttempts": 3, "minSpacingMinutes": 15}}]

    def found(minutes, several=True):
        rows = [(*obs(i, "DNS_FAILURE")[:6], T0 + dt.timedelta(minutes=m), *obs(i, "DNS_FAILURE")[7:]) for i, m in enumerate(minutes)]
        one = replace(ctx, pages=spark.createDataFrame(rows, OBS), several_runs=several)
        return [(r["summary"], r["limitations"]) for r in run_rules(one, only).collect()]

    assert found([0, 5, 10, 14, 16]) == []
    (summary, limits), = found([0, 5, 15, 29, 30, 44])
    assert "3 checks" in summary and "15 minutes" in limits[0]
    assert len(found([0, 5, 10], several=False)) == 1


@pytest.mark.parametrize("days", [1, 3])
def test_spacing_longer_than_a_day(spark, days):
    from webestate.operators import spacing

    rows = [(1, T0 + dt.timedelta(hours=7 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, at timestamp_ntz")
    n, last = 0, None
    for _, t in rows:
        if last is None or t - last >= dt.timedelta(minutes=1000):
            n, last = n + 1, t
    assert tuple(spacing.count_spaced(df, ["k"], "at", 1000, days).first()) == (1, n, T0, last)


def test_parts_of_a_nested_export_are_cut_once(spark, tmp_path, monkeypatch):
    stored = []
    monkeypatch.setattr(snapshots, "materialise", lambda df, label, keep=snapshots.materialise: (stored.append(label), keep(df, label))[1])
    findings = spark.range(300).selectExpr("id % 3 AS portal_id", "concat('rule-', id) AS rule_id")
    snapshots.export_nested(spark.createDataFrame([(3,)], "portals int"), spark.range(4).withColumnRenamed("id", "portal_id"), findings, str(tmp_path / "doc"), most=500)
    inner = "portal_id bigint, findings array<struct<rule_id:string>>"
    rules = [spark.read.schema(inner).json(f"{tmp_path}/doc/{part}").selectExpr("explode(findings.rule_id) AS r") for part in ("portals", "parts")]
    assert stored == ["parts"] and all(r.count() for r in rules) and rules[0].union(rules[1]).distinct().count() == rules[0].union(rules[1]).count() == 300


def test_broken_destinations_name_every_failure_and_keep_null_keys(spark):
    from webestate.operators.rules.links import broken_destinations

    rows = [(1, "d", 10, "fail", "A", 1), (1, "d", 10, "fail", "B", 2), (1, "d", 11, "fail", "A", 1), (1, "d", None, "not_assessable", None, 1), (1, None, 12, "fail", "A", None), (1, "d", 13, "pass", "C", 9)]
    links = spark.createDataFrame(rows, "portal_id bigint, destination string, source_page bigint, status string, error_code string, attempts int").withColumn("checked_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    found = broken_destinations(links)
    got = {r["destination"]: (r["source_pages"], r["link_rows"], r["retried"], r["codes"]) for r in found.collect()}
    assert got == {"d": (2, 4, True, ["A", "B", "not_assessable"]), None: (1, 1, None, ["A"])}
    assert "collect_set" not in found._jdf.queryExecution().toString()
