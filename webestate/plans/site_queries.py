"""Queries over URLs, pages, listings and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from webestate.functions import checks, html, text, urls
from webestate.operators import inventory, links, tables
from webestate.operators.rules.directory import name_agreement
from webestate.plans import beds
from webestate.plans.catalog import plain, query
from webestate.plans.sql_beds import B1, B2, B3
from webestate.session import materialise, table

POLICY = urls.CrawlPolicy(disabled_domains=("cheap-pills.example.com",), denylist_patterns=(r"/en/7\d\d", "(", r"\.html$"))
LINK_POLICY = urls.CrawlPolicy(disabled_domains=("spam-farm.example.org",), denylist_patterns=("^/T",))


def url_rows(spark, sf):
    """Page addresses, some of them spoilt by key so that every reject reason occurs."""
    n = F.col("page_id")
    return table(spark, sf, "pages").select(n, F.when(n % 31 == 0, F.lit("  ")).when(n % 29 == 0, F.lit("no address")).when(
        n % 23 == 0, F.regexp_replace("url", "^https?", "ftp")).when(n % 19 == 0, F.regexp_replace("url", "^https?://[^/]*", "https://")).when(
        n % 7 == 0, F.concat(F.lit(" "), F.regexp_replace(F.upper(F.regexp_extract("url", "^(https?://)", 1)), "$", ""),
                             F.upper(F.regexp_extract("url", "^https?://([^/]+)", 1)),
                             F.when(F.col("url").startswith("https"), ":443").otherwise(":80"),
                             F.regexp_extract("url", "^https?://[^/]+(.*)$", 1))).otherwise(F.col("url")).alias("raw"))


RAW_SQL = """raw AS (SELECT page_id, url, CASE WHEN page_id % 31 = 0 THEN 'empty' WHEN page_id % 29 = 0 THEN 'bad' WHEN page_id % 23 = 0 THEN 'ftp'
    WHEN page_id % 19 = 0 THEN 'nohost' ELSE 'ok' END AS kind FROM pages),
  nrm AS (SELECT page_id, kind, CASE WHEN kind IN ('ok') THEN regexp_replace(replace(regexp_replace(url, '#.*$', ''), '?utm_source=feed', ''), '/$', '')
    WHEN kind = 'nohost' THEN 'https://' || regexp_replace(replace(regexp_replace(regexp_extract(url, '^https?://[^/]+/(.*)$', 1), '#.*$', ''), '?utm_source=feed', ''), '/$', '') END AS normalized,
    CASE kind WHEN 'empty' THEN 'empty URL' WHEN 'bad' THEN 'malformed URL (failed to parse)' WHEN 'ftp' THEN 'unsupported scheme "ftp:" (only http/https are admitted as portal URLs)' END AS reject_reason FROM raw),
  nr2 AS (SELECT *, regexp_extract(normalized, '^https?://([^/?]+)', 1) AS host FROM nrm)"""


@query("tx01_canonical_urls", f"""WITH {RAW_SQL} SELECT page_id, normalized, nullif(host, '') AS host,
  lower(host || CASE WHEN regexp_extract(normalized, '^https?://[^/?]+/([^?]+)', 1) <> '' THEN '-' || replace(regexp_extract(normalized, '^https?://[^/?]+/([^?]+)', 1), '/', '-') ELSE '' END) AS site_id, reject_reason FROM nr2""".replace("nullif(host, '') AS host", "host"))
def tx01(spark, sf):
    return tables.canonical_urls(url_rows(spark, sf), "raw").select("page_id", "normalized", "host", "site_id", "reject_reason")


@query("tx01_url_clusters", """WITH n AS (SELECT url, regexp_replace(replace(regexp_replace(url, '#.*$', ''), '?utm_source=feed', ''), '/$', '') AS normalized FROM pages)
  SELECT normalized, count(*) AS rows, count(DISTINCT url) AS variants FROM n GROUP BY 1""")
def tx01_clusters(spark, sf):
    return tables.url_clusters(tables.canonical_urls(table(spark, sf, "pages").select("url"), "url"), "url")


@query("tx01_url_rejects", f"WITH {RAW_SQL} SELECT reject_reason, count(*) AS rows FROM nr2 WHERE reject_reason IS NOT NULL GROUP BY 1")
def tx01_rejects(spark, sf):
    return tables.url_rejects(tables.canonical_urls(url_rows(spark, sf), "raw"))


# Links -----------------------------------------------------------------------------

LINKS_SQL = """anchors AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin, generate_subscripts(hs, 1) AS pos, unnest(hs) AS raw_href, unnest(ts) AS anchor_text
    FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS ts FROM pages)),
  lk AS (SELECT page_id, url, pos, raw_href, anchor_text, origin, regexp_extract(origin, '//(.*)$', 1) AS host,
    origin || array_to_string(list_transform(string_split(raw_href, ''), lambda c: CASE WHEN regexp_matches(c, '[^\\x00-\\x7F]') THEN url_encode(c) ELSE c END), '') AS resolved_url FROM anchors)"""
SCOPE_SQL = """dec AS (SELECT lk.*, CASE WHEN host = 'cheap-pills.example.com' OR host LIKE '%.cheap-pills.example.com' THEN 'domain "' || host || '" is disabled by crawl policy'
    WHEN regexp_matches(p, '(?i)/en/7\\d\\d') THEN 'matches denylisted path pattern "/en/7\\d\\d"' WHEN regexp_matches(p, '(?i)\\.html$') THEN 'matches denylisted path pattern "\\.html$"'
    WHEN regexp_matches(p, '(?i)/(login|signin|log-in)\\b') THEN 'matches excluded route category "login"' WHEN regexp_matches(p, '(?i)/(logout|signout)\\b') THEN 'matches excluded route category "logout"'
    WHEN regexp_matches(p, '(?i)/(auth|authenticate|otp)\\b') THEN 'matches excluded route category "authentication"' WHEN regexp_matches(p, '(?i)/(account|my-account|profile)\\b') THEN 'matches excluded route category "account"'
    WHEN regexp_matches(p, '(?i)/(pay\\b|payment|checkout\\b)') THEN 'matches excluded route category "payment"'
    WHEN regexp_matches(p, '(?i)/(submit\\b|apply\\b|transaction)') THEN 'matches excluded route category "transaction_submission"'
    WHEN regexp_matches(p, '(?i)/(delete|update|create)\\b') THEN 'matches excluded route category "state_mutating_form"'
    WHEN regexp_matches(p, '(?i)(/calendar\\b|/events?/\\d{4})') THEN 'matches excluded route category "calendar"'
    WHEN regexp_matches(p, '(?i)(/search\\b|[?&]q=)') THEN 'matches excluded route category "site_search_results"' END AS scope_reason
  FROM (SELECT *, regexp_replace(substr(resolved_url, length(origin) + 1), '/$', '') AS p FROM lk) lk)"""


def page_links(spark, sf):
    return links.extract_links(table(spark, sf, "pages"))


@query("tx02_scope", """WITH u AS (SELECT url AS resolved_url, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM
    (SELECT regexp_replace(replace(regexp_replace(url, '#.*$', ''), '?utm_source=feed', ''), '/$', '') AS url FROM pages)), """ + SCOPE_SQL.replace("lk.*, CASE", "host, CASE").replace("FROM lk) lk)", "FROM u) lk)") + """
  SELECT host, scope_reason, count(*) AS rows FROM dec GROUP BY 1, 2""")
def tx02(spark, sf):
    pages = table(spark, sf, "pages").select("url", F.array(urls.host_of(F.col("url"))).alias("hostnames"))
    return tables.scope_counts(tables.scope_decisions(pages, "url", "hostnames", POLICY))


@query("tx02_link_scope", f"WITH {LINKS_SQL}, {SCOPE_SQL} SELECT host, scope_reason, count(*) AS rows FROM dec GROUP BY 1, 2")
def tx02_links(spark, sf):
    rows = page_links(spark, sf).withColumn("hostnames", F.array(urls.host_of(F.col("url"))))
    return tables.scope_counts(tables.scope_decisions(rows, "resolved_url", "hostnames", POLICY))


@query("jb01_links", f"WITH {LINKS_SQL} SELECT page_id, CAST(pos AS INTEGER) AS pos, raw_href, resolved_url, anchor_text, anchor_text AS context FROM lk")
def jb01(spark, sf):
    return page_links(spark, sf).select("page_id", "pos", "raw_href", "resolved_url", "anchor_text", "context")


@query("fn18_raw_hrefs", f"WITH {LINKS_SQL} SELECT page_id, string_agg(raw_href, '|' ORDER BY pos) AS hrefs, count(*) AS n FROM lk GROUP BY 1")
def fn18(spark, sf):
    return plain(table(spark, sf, "pages").select("page_id", html.raw_hrefs(F.col("html")).alias("hrefs")).filter("size(hrefs) > 0").withColumn("n", F.size("hrefs").cast("bigint")))


@query("src05_html_listing", f"""WITH {LINKS_SQL} SELECT page_id, anchor_text AS name, raw_href AS url, CAST(NULL AS VARCHAR) AS reject_reason FROM lk""")
def src05(spark, sf):
    from webestate.sources.listings import read_listing_html

    good, rejects = read_listing_html(table(spark, sf, "pages"))
    return good.select("page_id", "name", "url", F.lit(None).cast("string").alias("reject_reason")).unionByName(rejects.select("page_id", "name", "url", "reject_reason"))


DEST_SQL = """dst AS (SELECT *, regexp_replace(resolved_url, '/$', '') AS destination, (host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org' OR regexp_matches(raw_href, '^/[Tt]') OR
   regexp_matches(raw_href, '(?i)(/(login|signin|log-in|logout|signout|auth|authenticate|otp|account|my-account|profile|pay|checkout|submit|apply|delete|update|create|calendar|search)\\b|/payment|/transaction|/events?/\\d{4}|[?&]q=)')) AS excluded FROM lk)"""


def prepared_links(spark, sf):
    return links.prepare_links(page_links(spark, sf), LINK_POLICY)


@query("flt07_link_exclusion", f"WITH {LINKS_SQL}, {DEST_SQL} SELECT page_id, raw_href, destination, excluded FROM dst")
def flt07(spark, sf):
    return prepared_links(spark, sf).select("page_id", "raw_href", "destination", "excluded")


@query("jb02_relationship", f"""WITH {LINKS_SQL}, {DEST_SQL} SELECT host AS portal_id, 'run-1-' || host || '-l' || row_number() OVER (PARTITION BY host ORDER BY page_id, pos) AS link_id, page_id, raw_href,
  CASE WHEN page_id % 3 = 0 THEN 'external' ELSE 'internal' END AS relationship FROM dst""")
def jb02(spark, sf):
    rows = prepared_links(spark, sf).withColumn("portal_id", urls.host_of(F.col("url")))
    rows = rows.withColumn("hostnames", F.when(F.col("page_id") % 3 == 0, F.array(F.lit("elsewhere.example.org"))).otherwise(F.array("portal_id")))
    rows = rows.withColumn("relationship", links.relationship("destination_host", "hostnames"))
    numbered = links.number_rows(rows, "portal_id", F.col("page_id"), ["pos"])
    link_id = F.concat(F.lit("run-1-"), "portal_id", F.lit("-l"), "sequence")
    return numbered.select("portal_id", link_id.alias("link_id"), "page_id", "raw_href", "relationship")


@query("wn03_sequences", f"""WITH {B3} SELECT portal_id, source_page, destination, l_linenumber, row_number() OVER (PARTITION BY portal_id ORDER BY checked_at, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS sequence FROM b3""")
def wn03(spark, sf):
    rows = beds.link_observations(spark, sf)
    numbered = links.number_rows(rows, "portal_id", F.to_date("seq.l_shipdate"), ["seq"])
    return numbered.select("portal_id", "source_page", "destination", F.col("seq.l_linenumber").alias("l_linenumber"), "sequence")


@query("jn06_destinations", f"""WITH {LINKS_SQL}, {DEST_SQL}, res AS (SELECT DISTINCT destination, CASE WHEN length(destination) % 4 = 0 THEN 'fail' ELSE 'pass' END AS status,
    CAST(CASE WHEN length(destination) % 4 = 0 THEN 404 ELSE 200 END AS INTEGER) AS http_status, CASE WHEN length(destination) % 4 = 0 THEN 'HTTP_CLIENT_ERROR' END AS error_code FROM dst WHERE NOT excluded)
  SELECT page_id, raw_href, destination, CASE WHEN excluded THEN 'not_applicable' ELSE status END AS status, CASE WHEN excluded THEN 'SCOPE_EXCLUDED' ELSE error_code END AS error_code,
    CAST(CASE WHEN excluded THEN 0 ELSE 1 END AS INTEGER) AS attempts FROM dst LEFT JOIN res USING (destination)""")
def jn06(spark, sf):
    # Read twice below, so the links are extracted into a table first.
    prepared = materialise(prepared_links(spark, sf).select("page_id", "raw_href", "destination", "excluded"), "links")
    broken = F.length("destination") % 4 == 0
    results = links.unique_destinations(prepared).select(
        "destination", F.when(broken, "fail").otherwise("pass").alias("status"), F.when(broken, 404).otherwise(200).alias("http_status"),
        F.when(broken, "HTTP_CLIENT_ERROR").alias("error_code"), F.lit(1).alias("attempts"))
    return links.fan_out(prepared, results).select("page_id", "raw_href", "destination", "status", "error_code", "attempts")


@query("jb06_reconciled_probes", f"""WITH {B3}, pr AS (SELECT portal_id * 50 + destination AS destination, CASE l_linestatus WHEN 'F' THEN 'HEAD' ELSE 'GET' END AS method, bool_and(status <> 'fail') AS ok,
    CASE WHEN bool_and(status <> 'fail') THEN 200 WHEN (portal_id * 50 + destination) % 3 = 0 THEN 405 WHEN (portal_id * 50 + destination) % 3 = 1 THEN 501 ELSE 404 END AS http_status, max(attempts) AS attempts FROM b3 GROUP BY portal_id * 50 + destination, l_linestatus)
  SELECT h.destination, CASE WHEN CASE WHEN retry THEN g.ok ELSE h.ok END THEN 'pass' ELSE 'fail' END AS status, CAST(CASE WHEN retry THEN g.attempts + h.attempts ELSE h.attempts END AS INTEGER) AS attempts
  FROM (SELECT a.*, NOT a.ok AND a.http_status IN (405, 501) AND EXISTS (SELECT 1 FROM pr x WHERE x.method = 'GET' AND x.destination = a.destination) AS retry FROM pr a WHERE method = 'HEAD') h
  LEFT JOIN (SELECT * FROM pr WHERE method = 'GET') g USING (destination)""")
def jb06(spark, sf):
    li = table(spark, sf, "lineitem")
    calm = (F.col("l_suppkey") % 10).isin(4, 5, 6, 9)
    failed = (F.col("l_returnflag") == "R") & ~calm & (F.col("l_linenumber") % 5 != 0)
    dest = F.col("l_suppkey") * 50 + F.col("l_partkey") % 50
    method = F.when(F.col("l_linestatus") == "F", "HEAD").otherwise("GET")
    probes = li.groupBy(dest.alias("destination"), method.alias("method")).agg(
        F.bool_and(~failed).alias("ok"), F.max(1 + F.col("l_linenumber") % 3).cast("int").alias("attempts"))
    status = F.when(F.col("ok"), 200).when(F.col("destination") % 3 == 0, 405).when(F.col("destination") % 3 == 1, 501).otherwise(404)
    probes = probes.withColumn("http_status", status).withColumn("error_code", F.when(~F.col("ok"), checks.classify_http_status(F.col("http_status"))))
    return links.reconcile_probes(probes).select("destination", "status", "attempts")


# Robots ------------------------------------------------------------------------------

ROBOTS_SQL = """hosts AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages),
  rules AS (SELECT host, unnest(CASE length(host) % 3
     WHEN 0 THEN [{'agent': '*', 'type': 'disallow', 'pattern': '/en/', 'pos': 2}, {'agent': '*', 'type': 'allow', 'pattern': '/en/7', 'pos': 3}, {'agent': '*', 'type': 'disallow', 'pattern': '', 'pos': 4}]
     WHEN 1 THEN [{'agent': 'alphabot', 'type': 'disallow', 'pattern': '/de/', 'pos': 2}, {'agent': 'siteauditbot', 'type': 'disallow', 'pattern': '/de/', 'pos': 2}, {'agent': 'alphabot', 'type': 'disallow', 'pattern': '/*.html$', 'pos': 3},
       {'agent': 'siteauditbot', 'type': 'disallow', 'pattern': '/*.html$', 'pos': 3}, {'agent': '*', 'type': 'disallow', 'pattern': '/', 'pos': 6}]
     ELSE [{'agent': 'other', 'type': 'disallow', 'pattern': '/', 'pos': 1}, {'agent': '*', 'type': 'disallow', 'pattern': '/*?page=', 'pos': 3}, {'agent': '*', 'type': 'allow', 'pattern': '/fr/*?page=2', 'pos': 4}, {'agent': '*', 'type': 'disallow', 'pattern': '/es/', 'pos': 6}] END) AS r FROM hosts)"""


@query("jb04_robots_rules", f"WITH {ROBOTS_SQL} SELECT host, r.agent AS agent, r.type AS type, r.pattern AS pattern, CAST(r.pos AS INTEGER) AS pos FROM rules")
def jb04(spark, sf):
    return links.robots_rules(beds.robots_texts(spark, sf)).filter("type IS NOT NULL").select("host", "agent", "type", "pattern", "pos")


@query("jn14_robots_decisions", """WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+([^#]*)', 1) AS path FROM pages)
  SELECT page_id, host, path, CASE length(host) % 3 WHEN 0 THEN NOT (path LIKE '/en/%' AND path NOT LIKE '/en/7%')
    WHEN 1 THEN NOT (path LIKE '/de/%' OR regexp_matches(path, '^/.*\\.html$'))
    ELSE CASE WHEN regexp_matches(path, '^/fr/.*\\?page=2') THEN true ELSE NOT (regexp_matches(path, '^/.*\\?page=') OR path LIKE '/es/%') END END AS allowed FROM p""")
def jn14(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/?#:]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/]+([^#]*)", 1).alias("path"))
    groups = links.robots_groups(links.robots_rules(beds.robots_texts(spark, sf)), beds.USER_AGENT)
    return links.robots_decisions(pages, groups).select("page_id", "host", "path", "allowed")


def _frontier_sql(max_pages: int, depth: int) -> str:
    """The level-by-level visit plan as SQL, one set of tables per level."""
    parts = ["""edges AS (SELECT l_suppkey AS portal_id, b || '/n/' || (l_orderkey % 200) AS from_url,
      CASE WHEN l_linenumber = 7 THEN 'https://other.example.net/n/' || d WHEN d % 37 = 0 THEN b || '/login/' || d ELSE b || '/n/' || d END AS url,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) AS pos
      FROM (SELECT *, 'https://p' || l_suppkey || '.example.org' AS b, l_partkey % 200 AS d FROM lineitem))""",
             """l0 AS (SELECT portal_id, url, min(n) AS place FROM (SELECT s_suppkey AS portal_id, 'https://p' || s_suppkey || '.example.org/n/' || (s_suppkey % 200) AS url, 0 AS n FROM supplier
      UNION ALL SELECT s_suppkey, 'https://p' || s_suppkey || '.example.org/n/' || ((s_suppkey * 7) % 200), 1 FROM supplier) GROUP BY 1, 2)"""]
    for d in range(depth + 1):
        if d:
            seen = " UNION ALL ".join(f"SELECT portal_id, url FROM o{i}" for i in range(d))
            parts.append(f"""l{d} AS (SELECT e.portal_id, e.url, min(p.ord * 1000000000 + e.pos) AS place FROM edges e JOIN o{d - 1} p ON p.portal_id = e.portal_id AND p.url = e.from_url AND p.outcome = 'visit'
              WHERE (e.portal_id, e.url) NOT IN (SELECT (portal_id, url) FROM ({seen})) GROUP BY 1, 2)""")
        used = "0" if not d else "coalesce((SELECT count(*) FROM (" + " UNION ALL ".join(
            f"SELECT portal_id FROM o{i} WHERE outcome = 'visit'" for i in range(d)) + ") v WHERE v.portal_id = l.portal_id), 0)"
        parts.append(f"""s{d} AS (SELECT l.*, {used} AS used, CASE WHEN url NOT LIKE 'https://p' || portal_id || '.example.org/%' THEN 'hostname "other.example.net" is not a registered hostname for this portal'
            WHEN url LIKE '%/login/%' THEN 'matches excluded route category "login"' END AS reason, regexp_matches(url, '3$') AS blocked FROM l{d} l)""")
        parts.append(f"""r{d} AS (SELECT *, coalesce(sum(CASE WHEN reason IS NULL AND NOT blocked THEN 1 ELSE 0 END) OVER (PARTITION BY portal_id ORDER BY place, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM s{d})""")
        parts.append(f"""o{d} AS (SELECT portal_id, url, {d} AS depth, CASE WHEN reason IS NULL AND NOT blocked AND used + ahead < {max_pages} THEN ahead + 1 END AS ord,
            CASE WHEN reason IS NOT NULL THEN reason WHEN used + ahead >= {max_pages} THEN 'maxPagesPerPortal reached' WHEN blocked THEN 'robots_disallowed' ELSE 'visit' END AS outcome FROM r{d})""")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(
        f'SELECT portal_id, url, CAST(depth AS INTEGER) AS depth, CAST(ord AS INTEGER) AS "order", outcome FROM o{d}' for d in range(depth + 1))


@query("jb03_frontier", _frontier_sql(8, 2))
def jb03(spark, sf):
    return links.visit_plan(
        beds.frontier_seeds(spark, sf), beds.frontier_edges(spark, sf), F.col("url").rlike("3$"), urls.CrawlPolicy(max_pages=8))


# Pages and texts -----------------------------------------------------------------------


def marked_pages(spark, sf):
    """Pages with login, block and shell markup added by key."""
    n, u, h = F.col("page_id"), F.col("url"), F.col("html")
    return table(spark, sf, "pages").select(
        n, F.when(n % 10 == 0, F.concat(F.regexp_extract(u, "^(https?://[^/]+)", 1), F.lit("/sso/login?next=1"))).otherwise(u).alias("url"),
        F.when(n % 6 == 1, F.lit('<html><body class="x"><div id="root"></div><script>go()</script></body></html>'))
        .when(n % 6 == 2, F.lit("<html><head><title>t</title></head><body><p>short</p><a href='/a'>a</a></body></html>"))
        .when(n % 9 == 0, F.concat(h, F.lit('<form><input name="username"><INPUT class="k" type="password"></form>')))
        .when(n % 8 == 0, F.concat(h, F.lit('<div class="G-Recaptcha"></div>'))).when(n % 7 == 0, F.concat(h, F.lit("<p>Access Denied</p>")))
        .otherwise(h).alias("html"))


ACCESS_SQL = """acc AS (SELECT page_id, CASE WHEN page_id % 10 = 0 OR (page_id % 9 = 0 AND page_id % 6 NOT IN (1, 2)) THEN 'login_wall'
    WHEN page_id % 6 NOT IN (1, 2) AND (page_id % 8 = 0 OR page_id % 7 = 0) THEN 'automation_block' WHEN page_id % 6 IN (1, 2) THEN 'empty_shell' ELSE 'open' END AS access,
    regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages)"""


@query("tx04_page_access", f"WITH {ACCESS_SQL} SELECT page_id, access FROM acc")
def tx04(spark, sf):
    return tables.page_access(marked_pages(spark, sf)).select("page_id", "access")


@query("tx04_access_share", f"""WITH {ACCESS_SQL} SELECT host, count(*) AS pages, count(*) FILTER (access = 'login_wall') AS login_wall, count(*) FILTER (access = 'automation_block') AS automation_block,
  count(*) FILTER (access = 'empty_shell') AS empty_shell, round(count(*) FILTER (access <> 'open') / count(*), 6) AS closed_share FROM acc GROUP BY 1""")
def tx04_share(spark, sf):
    return tables.access_share(tables.page_access(marked_pages(spark, sf)))


@query("tx04_document_blocks", """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(recaptcha|hcaptcha|h-captcha|cf-turnstile|captcha-delivery\\.com|funcaptcha|arkoselabs)') THEN 'captcha'
  WHEN regexp_matches(text, '(?i)(access denied|automated (queries|requests|access)|unusual traffic|verify you are human|please verify you are a human|checking your browser before accessing|pardon the interruption|request blocked)') THEN 'phrase' ELSE 'none' END AS block FROM documents""")
def tx04_docs(spark, sf):
    reason = html.block_reason(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.when(reason.contains("CAPTCHA"), "captcha").when(reason.isNotNull(), "phrase").otherwise("none").alias("block"))


@query("tx05_page_metadata", """SELECT page_id, nullif(CASE WHEN length(t) > 200 THEN left(t, 199) || '…' ELSE t END, '') AS title, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS language, sha256(html) AS digest
  FROM (SELECT *, trim(regexp_replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM pages)""")
def tx05(spark, sf):
    return tables.page_metadata(table(spark, sf, "pages")).select("page_id", "title", "language", "digest")


@query("tx05_canonical_links", """SELECT page_id, 'https://canon.example.org/x/' || page_id AS canonical FROM pages""")
def tx05_canonical(spark, sf):
    n = F.col("page_id")
    head = F.when(n % 2 == 0, F.concat(F.lit('<base href="//canon.example.org/x/y"><link REL=canonical href=" '), n, F.lit('">'))).otherwise(
        F.concat(F.lit("<link href='https://canon.example.org/q/../x/"), n, F.lit("' rel='canonical'>")))
    pages = table(spark, sf, "pages").select(n, F.concat(F.lit("https"), F.regexp_replace("url", "^https?", "")).alias("url"), F.concat(head, F.col("html")).alias("html"))
    return tables.page_metadata(pages).select("page_id", "canonical")


@query("tx05_language_counts", "SELECT coalesce(nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), ''), 'unknown') AS language, count(*) AS pages FROM pages GROUP BY 1")
def tx05_languages(spark, sf):
    return table(spark, sf, "pages").groupBy(F.coalesce(html.language(F.col("html")), F.lit("unknown")).alias("language")).agg(F.count("*").alias("pages"))


@query("tx05_identical_documents", "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1")
def tx05_identical(spark, sf):
    return tables.identical_bodies(table(spark, sf, "documents").select("doc_id", html.content_digest(F.col("text")).alias("digest")), "digest", "doc_id")


FLAGS_SQL = r"""CASE WHEN regexp_matches({0}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}') THEN 'possible_email' END,
    CASE WHEN regexp_matches({0}, '(^|[^0-9])(\+?91[-\s]?|0)?[6-9]([-\s]?[0-9]){{9}}([^0-9]|$)') THEN 'possible_indian_mobile_number' END,
    CASE WHEN regexp_matches({0}, '(^|[^0-9])[0-9]{{4}}[-\s]?[0-9]{{4}}[-\s]?[0-9]{{4}}([^0-9]|$)') THEN 'possible_aadhaar_number' END,
    CASE WHEN regexp_matches({0}, '\b[A-Za-z]{{5}}[0-9]{{4}}[A-Za-z]\b') THEN 'possible_pan_number' END,
    CASE WHEN regexp_matches({0}, '(^|[^0-9])[0-9]{{8,}}([^0-9]|$)') THEN 'possible_long_reference_number' END"""


@query("tx06_personal_data", "SELECT doc_id, concat_ws('|', " + FLAGS_SQL.format("text") + ") AS flags FROM documents")
def tx06(spark, sf):
    return plain(tables.personal_data(table(spark, sf, "documents")).select("doc_id", "flags"))


@query("tx06_flag_counts", "SELECT lang, source, flag, count(*) AS rows FROM (SELECT lang, source, unnest(list_filter([" + FLAGS_SQL.format("text") + "], lambda x: x IS NOT NULL)) AS flag FROM documents) GROUP BY 1, 2, 3")
def tx06_counts(spark, sf):
    return tables.flag_counts(tables.personal_data(table(spark, sf, "documents")), "lang", "source")


@query("tx06_conversation_flags", "SELECT conv_id, turn, concat_ws('|', " + FLAGS_SQL.format("text") + ") AS flags, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS clean_text FROM conversations")
def tx06_conversations(spark, sf):
    return plain(tables.personal_data(table(spark, sf, "conversations")).select("conv_id", "turn", "flags", "clean_text"))


@query("se03_flag_union", "SELECT doc_id, concat_ws('|', " + FLAGS_SQL.format("left(text, length(text) // 2)") + ") AS first_flags, list_sort(list_distinct(list_concat(list_filter([" + FLAGS_SQL.format("left(text, length(text) // 2)") + "], lambda x: x IS NOT NULL), list_filter([" + FLAGS_SQL.format("substr(text, length(text) // 2 + 1)") + "], lambda x: x IS NOT NULL))))::VARCHAR AS flags FROM documents")
def se03(spark, sf):
    docs = table(spark, sf, "documents").withColumn("half", (F.length("text") / 2).cast("int"))
    a = text.privacy_flags(F.expr("left(text, half)"))
    b = text.privacy_flags(F.expr("substring(text, half + 1)"))
    both = F.concat(F.lit("["), F.array_join(F.array_sort(text.merge_flags(a, b)), ", "), F.lit("]"))
    return docs.select("doc_id", F.array_join(a, "|").alias("first_flags"), both.alias("flags"))


@query("tx07_narrative_clusters", """WITH k AS (SELECT conv_id * 1000 + turn AS id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t, role FROM conversations)
  SELECT min(id) AS first, count(*) AS reports FROM k GROUP BY role, t""")
def tx07(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    none = F.lit(None).cast("string")
    return tables.narrative_clusters(turns, "id", description=none, themes=F.array("role"), occurred_on=none, free_text=F.col("text")).select("first", "reports")


_IPAD = "".join(f"\\x{b ^ 0x36:02X}" for b in b"audit-secret".ljust(64, b"\0"))
_OPAD = "".join(f"\\x{b ^ 0x5C:02X}" for b in b"audit-secret".ljust(64, b"\0"))


@query("tx08_keyed_activity", f"""SELECT sha256('{_OPAD}'::BLOB || unhex(sha256('{_IPAD}'::BLOB || encode(coalesce(ip, 'unknown'))))) AS keyed_hash, strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests
  FROM (SELECT ts, CASE WHEN user_id % 25 = 0 THEN NULL ELSE '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS ip FROM events) GROUP BY 1, 2""")
def tx08(spark, sf):
    ip = F.when(F.col("user_id") % 25 != 0, F.concat(F.lit("10.0."), F.expr("user_id div 256"), F.lit("."), F.col("user_id") % 256))
    return tables.pseudonymised_activity(table(spark, sf, "events").withColumn("ip", ip), "audit-secret", "ip", "ts")


NAMES_SQL = f"""{B1}, src AS (SELECT * FROM (VALUES ('dir', 'Estate directory listing', 'dir.example.org'), ('page', 'Official landing page', 'page.example.org'), ('man', 'Manual research notes', 'man.example.org'),
    ('dir2', 'Second directory for tion that was', 'dir2.example.org')) s(source_id, source_name, source_host)),
  tk AS (SELECT c.seq, c.source_id, c.host, source_host, list_distinct(list_filter(string_split_regex(lower(c.name), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS a,
    list_distinct(list_filter(string_split_regex(lower(source_name), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS b FROM canon c JOIN src USING (source_id))"""


@query("tx09_name_agreement", f"""WITH {NAMES_SQL} SELECT source_id, count(*) AS pairs, CAST(sum(len(list_intersect(a, b))) AS BIGINT) AS shared_tokens,
  count(*) FILTER (len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) = 0) AS disagreements,
  round(count(*) FILTER (len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) = 0) / count(*), 6) AS rate FROM tk GROUP BY 1""")
def tx09(spark, sf):
    pairs = name_agreement(beds.candidates(spark, sf).join(beds.sources(spark), "source_id"), "name", "source_name")
    return pairs.groupBy("source_id").agg(
        F.count("*").alias("pairs"), F.sum("shared_tokens").alias("shared_tokens"), F.count_if("disagree").alias("disagreements"),
        F.round(F.count_if("disagree") / F.count("*"), 6).alias("rate"))


@query("jn13_name_host_disagreement", f"WITH {NAMES_SQL} SELECT seq, len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) = 0 AS name_disagrees, host <> source_host AS host_differs FROM tk")
def jn13(spark, sf):
    pairs = name_agreement(beds.candidates(spark, sf).join(beds.sources(spark), "source_id"), "name", "source_name")
    return pairs.select("seq", F.col("disagree").alias("name_disagrees"), (urls.host_of(F.col("url")) != urls.host_of(F.col("source_url"))).alias("host_differs"))


@query("tx03_error_classes", f"""WITH {B2} SELECT portal_id, coalesce(CASE WHEN http_status = 401 THEN 'AUTH_REQUIRED' WHEN http_status BETWEEN 400 AND 499 THEN 'HTTP_CLIENT_ERROR' WHEN http_status >= 500 THEN 'HTTP_SERVER_ERROR' END,
    CASE WHEN error_code IN ('DNS_FAILURE', 'CONNECT_TIMEOUT', 'TLS_CERT_EXPIRED', 'TLS_HOST_MISMATCH') THEN error_code WHEN error_code = 'AUTOMATION_BLOCKED' THEN 'INTERNAL_AUDIT_ERROR' END, 'OK') AS error_class,
  strftime(checked_at, '%Y-%m-%d') AS day, count(*) AS rows, count(*) FILTER (content_type ILIKE '%text/html%') AS html_rows FROM b2 GROUP BY 1, 2, 3""")
def tx03(spark, sf):
    kind = F.col("portal_id") % 10
    network = F.when(F.col("error_code").isNotNull() & F.col("http_status").isNull(),
                     F.when(kind == 0, "ENOTFOUND").when(kind == 1, "UND_ERR_CONNECT_TIMEOUT").when(kind == 7, "CERT_HAS_EXPIRED").when(kind == 8, "HOSTNAME_MISMATCH").otherwise("EPROTO"))
    return tables.error_counts(tables.classify_checks(beds.page_observations(spark, sf).withColumn("network_code", network)))


IP_SQL = "ips AS (SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN '10' WHEN 1 THEN '127' WHEN 2 THEN '172' WHEN 3 THEN '192' WHEN 4 THEN '169' WHEN 5 THEN '100' WHEN 6 THEN '0' WHEN 7 THEN '300' ELSE '8' END || '.' || CASE o_orderkey % 9 WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 168 ELSE o_orderkey % 256 END WHEN 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN 254 ELSE 1 END ELSE o_orderkey % 256 END || '.' || (o_custkey % 256) || '.7' AS ip FROM orders)"
IP_HIT = """CASE WHEN a = 10 THEN '10.0.0.0/8' WHEN a = 127 THEN '127.0.0.0/8' WHEN a = 172 AND b BETWEEN 16 AND 31 THEN '172.16.0.0/12' WHEN a = 192 AND b = 168 THEN '192.168.0.0/16'
  WHEN a = 169 AND b = 254 THEN '169.254.0.0/16' WHEN a = 100 AND b BETWEEN 64 AND 127 THEN '100.64.0.0/10' WHEN a = 0 THEN '0.0.0.0/8' END"""


def addresses(spark, sf):
    k, r = F.col("o_orderkey"), F.col("o_orderkey") % 9
    first = F.element_at(F.array(*(F.lit(x) for x in ("10", "127", "172", "192", "169", "100", "0", "300", "8"))), (r + 1).cast("int"))
    second = F.when(r == 3, F.when(k % 2 == 0, 168).otherwise(k % 256)).when(r == 4, F.when(k % 2 == 0, 254).otherwise(1)).otherwise(k % 256)
    return table(spark, sf, "orders").select(k.alias("id"), F.concat_ws(".", first, second.cast("string"), (F.col("o_custkey") % 256).cast("string"), F.lit("7")).alias("ip"))


@query("jn15_ip_ranges", f"""WITH {IP_SQL}, o AS (SELECT id, ip, CAST(split_part(ip, '.', 1) AS INTEGER) AS a, CAST(split_part(ip, '.', 2) AS INTEGER) AS b FROM ips)
  SELECT id, ip, {IP_HIT} AS range FROM o WHERE {IP_HIT} IS NOT NULL""")
def jn15(spark, sf):
    rows = []
    for first, bits in checks.BLOCKED_IPV4:
        value = 0
        for octet in first.split("."):
            value = value * 256 + int(octet)
        rows.append((bits, value, f"{first}/{bits}"))
    ranges = spark.createDataFrame(rows, "bits int, network bigint, range string")
    return tables.match_ranges(addresses(spark, sf), ranges, sorted({r[0] for r in rows}))


@query("fn24_blocked_addresses", f"""WITH {IP_SQL}, o AS (SELECT id, ip, CAST(split_part(ip, '.', 1) AS INTEGER) AS a, CAST(split_part(ip, '.', 2) AS INTEGER) AS b FROM ips)
  SELECT a > 255 OR {IP_HIT} IS NOT NULL AS blocked, count(*) AS addresses FROM o GROUP BY 1""")
def fn24(spark, sf):
    return addresses(spark, sf).groupBy(checks.is_blocked_ip(F.col("ip")).alias("blocked")).agg(F.count("*").alias("addresses"))


# Inventory ---------------------------------------------------------------------------


def resolved(spark, sf):
    return inventory.with_canonical(beds.candidates(spark, sf), inventory.alias_map(beds.aliases(spark, sf)))


MERGED_SQL = f"""{B1}, mrg AS (SELECT canonical, regexp_extract(canonical, '^https?://([^/]+)', 1) || '-' || regexp_extract(canonical, '^https?://[^/]+/(.*)$', 1) AS portal_id,
    arg_min(name, (CASE WHEN source_type IN ('official_directory', 'official_page') THEN 0 ELSE 1 END) * 1000000000 + seq) AS name,
    arg_min(department, seq) FILTER (trim(department) <> '') AS department, bool_or(source_type IN ('official_directory', 'official_page')) AS verified FROM canon GROUP BY canonical)"""
ORDERED = "(SELECT string_agg(v, '|' ORDER BY f) FROM (SELECT {0} AS v, min(seq) AS f FROM canon c WHERE c.canonical = mrg.canonical {1} GROUP BY 1))"


@query("ag01_inventory_merge", f"""WITH {MERGED_SQL} SELECT portal_id, name, canonical AS canonical_url, department, 'unknown' AS portal_type, CASE WHEN verified THEN 'verified' ELSE 'unverified' END AS official_status,
  {ORDERED.format('source_id', '')} AS source_refs, regexp_extract(canonical, '^https?://([^/]+)', 1) AS hostnames, coalesce({ORDERED.format('normalized', 'AND normalized <> c.canonical')}, '') AS alternate_urls,
  (SELECT string_agg(DISTINCT tag, '|' ORDER BY tag) FROM canon c WHERE c.canonical = mrg.canonical) AS tags,
  {ORDERED.format("discovery_method || ' ' || CASE source_id WHEN 'dir' THEN 'https://dir.example.org/list' WHEN 'page' THEN 'https://page.example.org/' WHEN 'man' THEN 'https://man.example.org/' ELSE 'https://dir2.example.org/list' END", '')} AS discovery FROM mrg""")
def ag01(spark, sf):
    portals = inventory.merge_candidates(resolved(spark, sf), beds.sources(spark))
    routes = F.transform("discovery", lambda d: F.concat(d["discovery_method"], F.lit(" "), d["from_url"]))
    return plain(portals.withColumn("discovery", routes))


@query("jn01_aliases", f"WITH {B1} SELECT seq, normalized, canonical AS canonical_url FROM canon")
def jn01(spark, sf):
    return resolved(spark, sf).select("seq", F.col("n.normalized").alias("normalized"), "canonical_url")


@query("jn02_back_links", f"""WITH {MERGED_SQL} SELECT source_id, coalesce(c.name, '') AS name, normalized AS normalized_url, m.portal_id, CAST(NULL AS VARCHAR) AS rejected_reason FROM canon c JOIN mrg m USING (canonical)
  UNION ALL SELECT 'dir', '(unknown)', NULL, NULL, 'missing name' FROM pages WHERE page_id % 20 = 0""")
def jn02(spark, sf):
    rows = resolved(spark, sf)
    rejects = table(spark, sf, "pages").filter("page_id % 20 = 0").select(
        F.lit("dir").alias("source_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("url"), F.lit("missing name").alias("reject_reason"))
    out = inventory.back_links(rows, inventory.merge_candidates(rows, beds.sources(spark)), rejects)
    return out.select("source_id", F.coalesce("name", F.lit("")).alias("name"), "normalized_url", "portal_id", "rejected_reason")


@query("se01_candidate_union", f"WITH {B1} SELECT source_id, CAST(CASE source_id WHEN 'dir' THEN 0 WHEN 'page' THEN 1 WHEN 'man' THEN 2 ELSE 3 END AS INTEGER) AS source_pos, seq, url FROM cand")
def se01(spark, sf):
    return inventory.ordered_candidates(beds.candidates(spark, sf), ["dir", "page", "man"]).select("source_id", "source_pos", "seq", "url")


@query("se04_unmatched_sources", f"WITH {B1} SELECT 'idle' AS source_id, 'enabled source has no input' AS warning UNION ALL SELECT DISTINCT 'x-' || tag, 'input has no enabled source, skipped' FROM cand")
def se04(spark, sf):
    rows = beds.candidates(spark, sf)
    inputs = rows.select("source_id").distinct().union(rows.select(F.concat(F.lit("x-"), F.col("tags")[0])).distinct())
    return inventory.unmatched_sources(beds.sources(spark).select("source_id"), inputs)


@query("ag19_duplicate_ids", f"WITH {MERGED_SQL} SELECT portal_id, count(*) AS rows FROM mrg GROUP BY 1 HAVING count(*) > 1")
def ag19(spark, sf):
    return inventory.duplicate_ids(inventory.merge_candidates(resolved(spark, sf), beds.sources(spark)), "portal_id")


@query("rv01_inventory_checks", f"""WITH {MERGED_SQL} SELECT 'duplicate_portal_id' AS code, portal_id AS subject FROM mrg GROUP BY portal_id HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'unresolved_source_ref', portal_id || ' man' || repeat('', CAST(length(canonical) AS INTEGER)) FROM mrg WHERE false
  UNION ALL SELECT 'unresolved_source_ref', portal_id || ' man' FROM mrg WHERE EXISTS (SELECT 1 FROM canon c WHERE c.canonical = mrg.canonical AND source_id = 'man')""")
def rv01(spark, sf):
    known = beds.sources(spark)
    portals = inventory.merge_candidates(resolved(spark, sf), known)
    return inventory.inventory_issues(portals, known.filter("source_id <> 'man'"))


@query("snk08_inventory_report", f"""WITH {MERGED_SQL} SELECT 'portals' AS part, canonical AS k, name || ': ' || {ORDERED.replace("'|'", "', '").format("CASE source_id WHEN 'dir' THEN 'Estate directory listing' WHEN 'page' THEN 'Official landing page' WHEN 'man' THEN 'Manual research notes' ELSE 'Second directory for tion that was' END", '')} AS v FROM mrg
  UNION ALL SELECT 'totals', 'portals', CAST(count(*) AS VARCHAR) FROM mrg UNION ALL SELECT 'totals', 'sources', '5' UNION ALL SELECT 'totals', 'rejected', '0'""")
def snk08(spark, sf):
    rows = resolved(spark, sf)
    portals = inventory.merge_candidates(rows, beds.sources(spark))
    frames = inventory.inventory_report_frames(portals, beds.sources(spark), inventory.back_links(rows, portals))
    one = frames["portals"].select(F.lit("portals").alias("part"), F.col("canonical_url").alias("k"), F.concat("name", F.lit(": "), "sources").alias("v"))
    two = frames["totals"].select(F.lit("totals").alias("part"), F.col("item").alias("k"), F.col("n").cast("string").alias("v"))
    return one.unionByName(two)
