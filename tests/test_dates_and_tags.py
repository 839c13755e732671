"""Date mentions, freshness status and mixed content."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from webestate.functions import dates, tags
from webestate.operators import freshness, mixed
from webestate.operators.rules import REGISTRY, run_rules
from webestate.plans import page_queries
from webestate.plans import rule_queries as rules

CASES = [
    ("on 2024-02-29.", "dated", date(2024, 2, 29), "day", False),
    ("Last updated: 31/12/2023", "updated", date(2023, 12, 31), "day", False),
    ("modified on 05.06.2021", "updated", date(2021, 6, 5), "day", True),
    ("12-25-2020", "dated", date(2020, 12, 25), "day", False),
    ("Deadline: 3rd of", None, None, None, None),
    ("deadline 3rd March, 2024", "deadline", date(2024, 3, 3), "day", False),
    ("valid until Sept. 9th 2025", "deadline", date(2025, 9, 9), "day", False),
    ("In February 2024 we", "dated", date(2024, 2, 29), "month", False),
    ("© 2011 – 2019 Office", "copyright", date(2019, 12, 31), "year", False),
    ("Copyright 2020", "copyright", date(2020, 12, 31), "year", False),
    ("30.02.2024", "dated", None, "day", False),
    ("13/13/2024", "dated", None, "day", False),
    ("7/7/2024", "dated", date(2024, 7, 7), "day", False),
    ("version 1.2.2020.5 and 12345-01-01", None, None, None, None),
    ("maybe 2024", None, None, None, None),
    ("", None, None, None, None),
]


def signals(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    return freshness.freshness_signals(df, ["n"], **options).orderBy("n", "nth").collect()


def test_formats_labels_and_ambiguity(spark):
    rows = {r["n"]: r for r in signals(spark, [c[0] for c in CASES])}
    for n, (text, kind, day, precision, ambiguous) in enumerate(CASES):
        if text.startswith("version"):  # the first number triple is followed by more digits
            continue
        if kind is None:
            assert n not in rows, text
        else:
            assert (rows[n]["kind"], rows[n]["day"], rows[n]["precision"], rows[n]["ambiguous"]) == (kind, day, precision, ambiguous), text
    assert signals(spark, ["5/6/2021"], day_first=False)[0]["day"] == date(2021, 5, 6)
    assert signals(spark, [None]) == []


def test_places_are_those_of_the_text(spark):
    texts = ["é" * 40 + " Updated 1/2/2020, " + "漢字 " * 20 + "1/2/2020 and © 2019\nDue date: 4 Jan 2021", "x " * 3000 + "2020-01-01 " * 400]
    python = re.compile(dates.MENTION)
    for row in signals(spark, texts):
        assert texts[row["n"]][row["at"] - 1:row["at"] - 1 + len(row["raw"])] == row["raw"]
    found = [r["raw"] for r in signals(spark, texts)]
    assert found == [m[0] for t in texts for m in python.finditer(t)] and len(found) == 404


@pytest.mark.parametrize("text, status", [
    ("nothing", "no_freshness_signal"), ("© 2019", "weak_signal"), ("Updated 1 Jan 2024", "recent_signal"), ("Updated 1 Jan 2020", "potentially_stale"),
    ("Deadline 1 Jan 2023", "potentially_stale"), ("Deadline 1 Jan 2023. Updated 5 Jan 2024", "recent_signal"), ("Deadline 1 Jan 2023, deadline 1 Jan 2025", "recent_signal"),
    ("Updated 1 Jan 2030", "no_freshness_signal"), ("Notice of 3 May 2012", "recent_signal"), (None, "no_freshness_signal"), ("Updated 30.02.2020", "no_freshness_signal"),
])
def test_status(spark, text, status):
    df = spark.createDataFrame([(1, text)], "n int, text string")
    assert freshness.page_freshness(df, ["n"], F.lit("2024-02-01").cast("date")).first()["status"] == status


def resources(spark, html, url="https://p.example.org/"):
    pages = spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")
    return sorted((r["tag"], r["attribute"], r["resource"], r["scheme"], r["kind"]) for r in mixed.sub_resources(pages).collect())


def test_tokens_of_markup(spark):
    html = """<IMG ALT="a > b" src=http://x/1.png/><!-- <img src=c> --><p title='<img src="http://no/">'>t</p><style media="x">a{b:url( "http://y/q.png" )}</style><br/>"""
    got = spark.createDataFrame([(html,)], "h string").select(tags.tags(F.col("h")).alias("t")).first()["t"]
    assert [t[:4].lower() for t in got] == ["<img", "<p t", "<sty", "<br/"]
    assert resources(spark, html) == [("img", "src", "http://x/1.png/", "http", "passive"), ("style", "text", "http://y/q.png", "http", "passive")]


def test_relative_resources_take_the_base_or_page_scheme(spark):
    assert resources(spark, '<img src="a.png"><script src="//cdn/x.js"></script>') == [("img", "src", "a.png", "https", "passive"), ("script", "src", "//cdn/x.js", "https", "active")]
    assert resources(spark, '<base href="http://b/"><img src="a.png"><img src="HTTPS://c/d">') == [("img", "src", "HTTPS://c/d", "https", "passive"), ("img", "src", "a.png", "http", "passive")]
    assert resources(spark, '<img src=""><img src><link href="http://z/"><a href="http://z/">z</a>') == []
    assert resources(spark, None) == [] and resources(spark, "") == []


def test_source_sets_and_style_imports(spark):
    html = """<source srcset="http://a/1.png 1x, data:image/png;base64,AA== 2x,http://a/3.png"><div style='background: URL(http://b/c)'></div><style>@import url("http://d/e.css"); @import 'http://f/g.css';</style>"""
    assert [(r[2], r[4]) for r in resources(spark, html) if r[3] == "http"] == [("http://b/c", "passive"), ("http://a/1.png", "passive"), ("http://a/3.png", "passive"), ("http://d/e.css", "active"), ("http://f/g.css", "active")]


def test_mixed_pages_are_https_only_and_encoded_addresses_count(spark):
    pages = spark.createDataFrame([(1, "http://p/", '<img src="http://a/">'), (2, "https://p/", '<img src="http&#58;//a/">'), (3, "https://p/", "<p>http://a/</p>"), (4, None, "<img src='http://a/'>")],
                                  "page_id int, url string, html string")
    assert [(r["page_id"], r["resource"]) for r in mixed.mixed_content(pages).collect()] == [(2, "http://a/")]


def test_extension_rules_run_beside_the_others(spark, sf):
    n = F.col("page_id")
    texts = page_queries.dated_texts(spark, sf).select(n.alias("portal_id"), F.concat(F.lit("https://p"), n, F.lit(".example.org/")).alias("url"), "text")
    ctx = rules.context(spark, sf)
    both = run_rules(ctx, [{"rule_id": "freshness.no-signal.v1"}, {"rule_id": "freshness.potentially-stale.v1", "parameters": {"staleDays": 30}}], [*REGISTRY, freshness.stale_rule(texts)])
    assert {r["rule_id"] for r in both.select("rule_id").distinct().collect()} == {"freshness.no-signal.v1", "freshness.potentially-stale.v1"}
