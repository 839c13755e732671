"""Queries over what pages show and load: dates and mixed content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webestate.functions import dates
from webestate.functions.sql import register_functions
from webestate.operators import freshness, mixed
from webestate.operators.rules import run_rules
from webestate.plans import beds
from webestate.plans import rule_queries as rules
from webestate.plans.catalog import plain, query
from webestate.plans.sql_beds import PORTALS
from webestate.session import table

AS_OF = beds.ANALYZED_AT[:10]
# Bed: sentences with dates, by page id; {d}, {m}, {y} are numbers of the page, {n} its month's name.
SENTENCES = (
    "No date here, call 555-0199.", "Last updated on {d}/{m}/{y}.", "Deadline: {d} {n} {y}. Apply by {d}-{m}-2024.", "© 2012 - {y} Records Office",
    "Posted {n} {d}th, {y}. Updated on {y}-{m}-{d}", "Apply by 30.02.2024 or {m}.{d}.{y}, version 1.2.2020.5", "Notice of {n} {y}; closing date {m}/25/{y}", "Copyright {y}. Last reviewed: {d}-{m}-{y}",
)
NAMES = ("January", "Feb", "March", "Apr.", "May", "June", "July", "Aug", "Sept", "October", "Nov", "December")


def dated_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Page texts with a dated sentence inside."""
    n = F.col("page_id")
    flat = F.regexp_replace("html", "<[^>]*>", " ")
    said = F.element_at(F.array(*map(F.lit, SENTENCES)), (n % 8 + 1).cast("int"))
    for mark, value in (("{d}", n % 28 + 1), ("{m}", n % 12 + 1), ("{y}", n % 7 + 2018), ("{n}", F.element_at(F.array(*map(F.lit, NAMES)), (n % 12 + 1).cast("int")))):
        said = F.replace(said, F.lit(mark), value.cast("string"))
    pages = table(spark, sf, "pages").select("page_id", "url", flat.alias("flat"), said.alias("said"))
    return pages.select("page_id", "url", F.concat(F.substring("flat", 1, 150), F.lit(" "), "said", F.lit(" "), F.expr("substring(flat, 151)")).alias("text"))


def _label(kind: str) -> str:
    return "'(?i)^(?:" + dict(dates.KINDS)[kind] + ")'"


_N = dates.MONTH
DATES_SQL = f"""WITH said AS (
    SELECT page_id, url, regexp_replace(html, '<[^>]*>', ' ', 'g') AS flat,
        replace(replace(replace(replace([{", ".join(f"'{s}'" for s in SENTENCES)}][page_id % 8 + 1], '{{d}}', (page_id % 28 + 1)::VARCHAR), '{{m}}', (page_id % 12 + 1)::VARCHAR),
            '{{y}}', (page_id % 7 + 2018)::VARCHAR), '{{n}}', [{", ".join(f"'{s}'" for s in NAMES)}][page_id % 12 + 1]) AS s FROM pages
), texts AS (
    SELECT page_id, url, substring(flat, 1, 150) || ' ' || s || ' ' || substring(flat, 151) AS text FROM said
), cut AS (
    SELECT page_id, regexp_extract_all(text, '{dates.MENTION}') AS raws, regexp_split_to_array(text, '{dates.MENTION}') AS gaps FROM texts
), flat_mentions AS (
    SELECT page_id, unnest(raws) AS raw, generate_subscripts(raws, 1) - 1 AS nth, unnest(list_transform(gaps[:len(raws)], lambda g: length(g))) AS gap FROM cut
), mentions AS (
    SELECT *, 1 + sum(gap) OVER w + coalesce(sum(length(raw)) OVER before, 0) AS place FROM flat_mentions
    WINDOW w AS (PARTITION BY page_id ORDER BY nth), before AS (PARTITION BY page_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fields AS (
    SELECT *, regexp_extract(raw, '([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}})$', ['y', 'm', 'd']) AS iso,
        regexp_extract(raw, '([0-9]{{1,2}})[./-]([0-9]{{1,2}})[./-]([0-9]{{4}})$', ['a', 'b', 'y']) AS num,
        regexp_extract(raw, '(?i)([0-9]{{1,2}})(?:st|nd|rd|th)?\\s+({_N})\\.?,?\\s+([0-9]{{4}})$', ['d', 'm', 'y']) AS dn,
        regexp_extract(raw, '(?i)({_N})\\.?\\s+(?:([0-9]{{1,2}})(?:st|nd|rd|th)?,?\\s+)?([0-9]{{4}})$', ['m', 'd', 'y']) AS nm FROM mentions
), numbers AS (
    SELECT *, try_cast(num.a AS INTEGER) AS a, try_cast(num.b AS INTEGER) AS b FROM fields
), parsed AS (
    SELECT page_id, nth, raw, place,
        CASE WHEN regexp_matches(raw, {_label("updated")}) THEN 'updated' WHEN regexp_matches(raw, {_label("deadline")}) THEN 'deadline'
            WHEN regexp_matches(raw, {_label("copyright")}) THEN 'copyright' ELSE 'dated' END AS kind,
        CASE WHEN iso.y <> '' THEN try_cast(iso.y || '-' || lpad(iso.m, 2, '0') || '-' || lpad(iso.d, 2, '0') AS DATE)
            WHEN num.y <> '' THEN CASE WHEN a > 12 OR b <= 12 THEN try_cast(num.y || '-' || lpad(num.b, 2, '0') || '-' || lpad(num.a, 2, '0') AS DATE)
                ELSE try_cast(num.y || '-' || lpad(num.a, 2, '0') || '-' || lpad(num.b, 2, '0') AS DATE) END
            WHEN dn.y <> '' THEN try_cast(dn.y || '-' || lpad(((instr('{dates.MONTHS}', lower(dn.m[:3])) + 2) // 3)::VARCHAR, 2, '0') || '-' || lpad(dn.d, 2, '0') AS DATE)
            WHEN nm.y <> '' AND nm.d <> '' THEN try_cast(nm.y || '-' || lpad(((instr('{dates.MONTHS}', lower(nm.m[:3])) + 2) // 3)::VARCHAR, 2, '0') || '-' || lpad(nm.d, 2, '0') AS DATE)
            WHEN nm.y <> '' THEN last_day(try_cast(nm.y || '-' || lpad(((instr('{dates.MONTHS}', lower(nm.m[:3])) + 2) // 3)::VARCHAR, 2, '0') || '-01' AS DATE))
            ELSE try_cast(raw[-4:] || '-12-31' AS DATE) END AS day,
        CASE WHEN iso.y <> '' OR num.y <> '' OR dn.y <> '' OR (nm.y <> '' AND nm.d <> '') THEN 'day' WHEN nm.y <> '' THEN 'month' ELSE 'year' END AS precision,
        coalesce(a <= 12 AND b <= 12 AND a <> b, false) AS ambiguous
    FROM numbers
)"""


@query("ex01_date_mentions", DATES_SQL + ' SELECT page_id, nth::INTEGER AS nth, raw, kind, day::VARCHAR AS day, precision, ambiguous, place::INTEGER AS "at" FROM parsed')
def ex01_date_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Every date that a page shows, what it is, and where it stands."""
    return freshness.freshness_signals(dated_texts(spark, sf), ["page_id"]).withColumn("day", F.col("day").cast("string"))


STATUS_SQL = DATES_SQL + f""", per AS (
    SELECT page_id, count(*) AS signals, count(*) FILTER (WHERE ambiguous) AS ambiguous, max(day) FILTER (WHERE kind = 'updated' AND day <= DATE '{AS_OF}') AS updated,
        max(day) FILTER (WHERE kind = 'deadline' AND day < DATE '{AS_OF}') AS expired, max(day) FILTER (WHERE kind = 'deadline' AND day >= DATE '{AS_OF}') AS open_deadline,
        max(day) FILTER (WHERE kind = 'dated' AND day <= DATE '{AS_OF}') AS notice, max(year(day)) FILTER (WHERE kind = 'copyright') AS copyright_year,
        arg_min(raw, CASE kind WHEN 'updated' THEN 0 WHEN 'deadline' THEN 1 WHEN 'dated' THEN 2 ELSE 3 END * 1000000 + nth) AS evidence,
        arg_min(place, CASE kind WHEN 'updated' THEN 0 WHEN 'deadline' THEN 1 WHEN 'dated' THEN 2 ELSE 3 END * 1000000 + nth)::INTEGER AS evidence_at
    FROM parsed WHERE day IS NOT NULL GROUP BY page_id
), judged AS (
    SELECT t.page_id, coalesce(signals, 0) AS signals, coalesce(ambiguous, 0) AS ambiguous, updated, expired, open_deadline, notice, copyright_year::INTEGER AS copyright_year,
        coalesce(copyright_year < {int(AS_OF[:4]) - freshness.COPYRIGHT_YEARS}, false) AS old_copyright, evidence, evidence_at,
        CASE WHEN DATE '{AS_OF}' - updated > {freshness.STALE_DAYS} OR (expired IS NOT NULL AND open_deadline IS NULL AND (updated IS NULL OR updated <= expired)) THEN 'potentially_stale'
            WHEN coalesce(updated, notice, open_deadline, expired) IS NOT NULL THEN 'recent_signal' WHEN copyright_year IS NOT NULL THEN 'weak_signal' ELSE 'no_freshness_signal' END AS status
    FROM texts t LEFT JOIN per USING (page_id)
)"""


@query("ex01_page_freshness", STATUS_SQL + """ SELECT page_id, signals, ambiguous, updated::VARCHAR AS updated, expired::VARCHAR AS expired, open_deadline::VARCHAR AS open_deadline,
    notice::VARCHAR AS notice, copyright_year, old_copyright, evidence, evidence_at, status FROM judged""")
def ex01_page_freshness(spark: SparkSession, sf: str) -> DataFrame:
    """What each page's dates say about its freshness."""
    out = freshness.page_freshness(dated_texts(spark, sf), ["page_id"], F.lit(AS_OF).cast("date"))
    return out.select(*[F.col(c).cast("string").alias(c) if c in ("updated", "expired", "open_deadline", "notice") else c for c in out.columns])


STALE = rules.finding_select(
    "hit", rule_id="'freshness.potentially-stale.v1'", category="'freshness'", title="'Visible dates on the entry page have passed'",
    summary="'The newest date that ' || canonical_url || ' shows reads “' || evidence || '”.'", severity="'advisory'", confidence="CASE WHEN ambiguous > 0 THEN 'low' ELSE 'medium' END",
    check_status="'warning'", first_observed_at=f"TIMESTAMP '{beds.ANALYZED_AT}'", last_observed_at=f"TIMESTAMP '{beds.ANALYZED_AT}'", affected_urls="canonical_url",
    suggestion_rule_id="'suggestion.potential-staleness.v1'", suggested_action="'manual_assessment'")


@query("ex01_potentially_stale", f"{STATUS_SQL}, {PORTALS}, hit AS (SELECT * FROM judged JOIN portals ON portal_id = page_id WHERE judged.status = 'potentially_stale') {STALE}")
def ex01_potentially_stale(spark: SparkSession, sf: str) -> DataFrame:
    """The rule beside the one for missing signals: findings about entry pages."""
    n = F.col("page_id")
    texts = dated_texts(spark, sf).select(n.alias("portal_id"), F.concat(F.lit("https://p"), n, F.lit(".example.org/")).alias("url"), "text")
    rule = freshness.stale_rule(texts)
    return plain(run_rules(rules.context(spark, sf), registry=[rule]), *rules.COLUMNS)


# Mixed content -----------------------------------------------------------------

# Bed: markup that loads something, by page id.
MARKUP = (
    '<p>http: is only a word</p>',
    '<img src="http://img.example.net/1.png?a=1&amp;b=2"><IMG alt=\'x > y\' SRCSET="https://a.example.net/1.png 1x, http://a.example.net/2.png 2x">',
    '<link rel="preload stylesheet" href="http://css.example.net/a.css"><link rel="canonical" href="http://x.example.net/">',
    "<script src='http://js.example.net/a.js'></script><!-- <img src=\"http://no.example.net/c.png\"> -->",
    "<div style=\"background:url('http://bg.example.net/b.png')\">x</div><style>@import \"http://css.example.net/i.css\"; p{background:url(http://bg.example.net/p.png)}</style>",
    '<base href="http://base.example.net/"><img src="rel.png"><video poster="//cdn.example.net/p.jpg" src="https://v.example.net/1.mp4"></video>',
    '<form action="http://form.example.net/post"><iframe src=http://frame.example.net/x></iframe></form><a href="http://link.example.net/">x</a>',
)
# What the bed's markup loads over HTTP on an HTTPS page: place in MARKUP, tag, attribute, resource, kind.
LOADED = (
    (1, "img", "src", "http://img.example.net/1.png?a=1&b=2", "passive"), (1, "img", "srcset", "http://a.example.net/2.png", "passive"),
    (2, "link", "href", "http://css.example.net/a.css", "active"), (3, "script", "src", "http://js.example.net/a.js", "active"),
    (4, "div", "style", "http://bg.example.net/b.png", "passive"), (4, "style", "text", "http://css.example.net/i.css", "active"), (4, "style", "text", "http://bg.example.net/p.png", "passive"),
    (5, "img", "src", "rel.png", "passive"), (6, "form", "action", "http://form.example.net/post", "form"), (6, "iframe", "src", "http://frame.example.net/x", "active"),
)
LOADED_SQL = "loaded(place, tag, attribute, resource, kind) AS (VALUES " + ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in LOADED) + ")"


def loading_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with markup that loads something behind their navigation."""
    extra = F.element_at(F.array(*map(F.lit, MARKUP)), (F.col("page_id") % 7 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", "url", F.replace("html", F.lit("</nav>"), F.concat(F.lit("</nav>"), extra)).alias("html"))


@query("ex05_mixed_content", f"WITH {LOADED_SQL} SELECT page_id, tag, attribute, resource, kind FROM pages JOIN loaded ON page_id % 7 = place WHERE url LIKE 'https:%'")
def ex05_mixed_content(spark: SparkSession, sf: str) -> DataFrame:
    """Resources over HTTP on HTTPS pages."""
    return mixed.mixed_content(loading_pages(spark, sf)).select("page_id", "tag", "attribute", "resource", "kind")


@query("ex05_mixed_pages", f"""WITH {LOADED_SQL} SELECT page_id, count(*) FILTER (WHERE kind = 'active') AS active, count(*) FILTER (WHERE kind = 'passive') AS passive,
    count(*) FILTER (WHERE kind = 'form') AS form, array_to_string(list_sort(list_distinct(list(regexp_extract(resource, '//([^/]+)', 1)) FILTER (WHERE resource LIKE '%//%'))), '|') AS hosts
    FROM pages JOIN loaded ON page_id % 7 = place WHERE url LIKE 'https:%' GROUP BY page_id""".replace("array_to_string(list_sort", "coalesce(array_to_string(list_sort").replace("'|') AS hosts", "'|'), '') AS hosts"))
def ex05_mixed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by kind and hosts of each page with mixed content."""
    return plain(mixed.mixed_summary(loading_pages(spark, sf)), "page_id", "active", "passive", "form", "hosts")


MIXED = rules.finding_select(
    "hit", rule_id="'https.mixed-content.v1'", category="'https'", title="'Entry page loads resources over plain HTTP'",
    summary="canonical_url || ' refers to ' || active || ' active, ' || passive || ' passive resource(s) and ' || form || ' form target(s) over HTTP, the first being ' || resource || '.'",
    severity="'advisory'", confidence="'medium'", check_status="'warning'", first_observed_at=f"TIMESTAMP '{beds.ANALYZED_AT}'", last_observed_at=f"TIMESTAMP '{beds.ANALYZED_AT}'",
    affected_urls="canonical_url", suggestion_rule_id="'suggestion.manual-verification.v1'", suggested_action="'manual_assessment'")
FIRST = {1: LOADED[0][3], 2: LOADED[2][3], 3: LOADED[3][3], 4: LOADED[4][3], 5: LOADED[7][3], 6: LOADED[8][3]}


@query("ex05_mixed_findings", f"""WITH {LOADED_SQL}, {PORTALS}, first(place, resource) AS (VALUES {", ".join(f"({k}, '{v}')" for k, v in FIRST.items())}), hit AS (
    SELECT portal_id, any_value(canonical_url) AS canonical_url, any_value(first.resource) AS resource, count(*) FILTER (WHERE kind = 'active') AS active,
        count(*) FILTER (WHERE kind = 'passive') AS passive, count(*) FILTER (WHERE kind = 'form') AS form
    FROM pages JOIN loaded ON page_id % 7 = loaded.place JOIN first ON first.place = loaded.place JOIN portals ON portal_id = page_id GROUP BY portal_id) {MIXED}""")
def ex05_mixed_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The advisory rule over entry pages."""
    n = F.col("page_id")
    pages = loading_pages(spark, sf).select(n.alias("portal_id"), "page_id", F.concat(F.lit("https://p"), n, F.lit(".example.org/")).alias("url"), "html")
    return plain(run_rules(rules.context(spark, sf), registry=[mixed.mixed_rule(pages)]), *rules.COLUMNS)


# SQL surface ---------------------------------------------------------------------

LINKS_SQL = """
SELECT web_stem(p.url) AS site, coalesce(web_host(a.href), 'own') AS target, count(*) AS links, count(DISTINCT p.page_id) AS pages, min(a.anchor_text) AS first_text,
    max(names_disagree(page_title(p.html), a.anchor_text)) AS disagrees
FROM webestate_pages p, LATERAL web_anchors(p.html) a WHERE a.href <> '#' GROUP BY 1, 2"""


@query("ux01_sql_surface", r"""WITH hrefs AS (
    SELECT page_id, url, html, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS t FROM pages
), words AS (
    SELECT *, list_filter(regexp_split_to_array(lower(regexp_extract(html, '<title>(.*?)</title>', 1)), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ('amp', 'quot')) AS a,
        list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda w: length(w) >= 3) AS b FROM hrefs
)
SELECT regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^(?:www[0-9]?|m|mobile)\.', '') AS site,
    CASE WHEN href LIKE 'http%' THEN regexp_extract(href, '^https?://([^/?#:]+)', 1) ELSE 'own' END AS target, count(*) AS links, count(DISTINCT page_id) AS pages, min(t) AS first_text,
    bool_or(len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b)) AS disagrees
FROM words GROUP BY 1, 2""".replace(chr(92) * 2, chr(92)))
def ux01_sql_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Where the links of each site lead, written in SQL with the registered functions only."""
    register_functions(spark)
    table(spark, sf, "pages").createOrReplaceTempView("webestate_pages")
    return spark.sql(LINKS_SQL)
