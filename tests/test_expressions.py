"""Edge cases of the URL, HTML, text and check expressions."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from webestate.functions import checks, html, text, urls

NORMAL = [
    ("HTTP://Ex.COM:80/a/../b//?b=2&a=1&utm_source=x#f", "http://ex.com/b/?a=1&b=2"),
    ("https://ex.com:443", "https://ex.com/"),
    ("https://ex.com/a/", "https://ex.com/a"),
    ("https://ex.com/?utm_source=x", "https://ex.com/"),
    ("https://ex.com/?UTM_SOURCE=x", "https://ex.com/?UTM_SOURCE=x"),
    ("https://ex.com/p?x=2&x=1&a=b c", "https://ex.com/p?a=b+c&x=1&x=2"),
    ("  https://x.org/é q ", "https://x.org/%C3%A9%20q"),
    ("https://u:p@h.org:8443/x", "https://u:p@h.org:8443/x"),
    ("https://h.org/?q=%zz&y", "https://h.org/?q=%25zz&y="),
    ("https://h.org/?", "https://h.org/"),
]
REFUSED = [
    ("", urls.EMPTY_URL), ("   ", urls.EMPTY_URL), ("not a url", urls.MALFORMED_URL), ("https://", urls.MALFORMED_URL),
    ("https://h.org:99999/", urls.MALFORMED_URL), ("https://a b.org/", urls.MALFORMED_URL),
    ("mailto:a@b.org", 'unsupported scheme "mailto:" (only http/https are admitted as portal URLs)'),
]


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_normalised_urls_and_reasons(spark):
    df = spark.createDataFrame([(u,) for u, _ in NORMAL + REFUSED], "u string")
    got = {r["u"]: r["n"] for r in urls.with_normalized_url(df, "u", "n").collect()}
    assert {u: got[u]["normalized"] for u, _ in NORMAL} == dict(NORMAL)
    assert {u: got[u]["reason"] for u, _ in REFUSED} == dict(REFUSED)
    assert all(got[u]["normalized"] is None and not got[u]["ok"] for u, _ in REFUSED)


def test_normalisation_is_idempotent_over_a_table(spark, sf):
    from webestate.session import table

    once = urls.with_normalized_url(table(spark, sf, "pages").select("url"), "url", "n").select(F.col("n.normalized").alias("a"))
    twice = urls.with_normalized_url(once, "a", "m").select("a", F.col("m.normalized").alias("b"))
    assert twice.filter("NOT a <=> b").count() == 0


def test_options_keep_slash_and_fragment(spark):
    options = urls.UrlOptions(strip_trailing_slash=False, remove_fragments=False, tracking_parameters=(), sort_parameters=False)
    df = spark.createDataFrame([("https://h.org/a/?b=1&a=2&gclid=3#top",)], "u string")
    assert urls.with_normalized_url(df, "u", "n", options).first()["n"]["normalized"] == "https://h.org/a/?b=1&a=2&gclid=3#top"


def test_relative_candidates_use_their_base(spark):
    df = spark.createDataFrame([("../x", "https://h.org/a/b/"), ("", "https://h.org/"), ("y", None)], "u string, b string")
    rows = [r["n"] for r in urls.with_normalized_url(df, "u", "n", base="b").collect()]
    assert rows[0]["normalized"] == "https://h.org/a/x"
    assert rows[1]["reason"] == urls.EMPTY_URL and rows[2]["reason"] == urls.MALFORMED_URL


@pytest.mark.parametrize("href,base,want", [
    ("/The", "https://a.org/x/y", "https://a.org/The"), ("../z", "https://a.org/x/y/w", "https://a.org/x/z"),
    ("?a=1", "https://a.org/x/y?b", "https://a.org/x/y?a=1"), ("#f", "https://a.org/x?b", "https://a.org/x?b#f"),
    ("//c.org", "http://a.org", "http://c.org/"), ("JavaScript:x()", "http://a.org", "javascript:x()"),
    ("x", "bad", None), ("./", "http://a.org/p/q", "http://a.org/p/"), ("http://b.org", "bad", "http://b.org/"),
])
def test_resolution(spark, href, base, want):
    df = spark.createDataFrame([(href, base)], "h string, b string")
    assert urls.with_resolved_url(df, "h", "b", "r").first()["r"] == want


def test_portal_ids_ignore_scheme_and_query(spark):
    got = [one(spark, urls.portal_id(F.lit(u))) for u in ("https://H.org/A/b c?x=1", "http://h.org/A/b%20c", "https://h.org/")]
    assert got == ["h.org-a-b-c", "h.org-a-b-20c", "h.org"]


def test_scope_takes_the_first_reason(spark):
    policy = urls.CrawlPolicy(disabled_domains=("off.org",), denylist_patterns=("(", "^/secret"))
    rows = [
        ("https://x.off.org/login", "x.off.org", 'domain "x.off.org" is disabled by crawl policy'),
        ("https://b.org/", "b.org", 'hostname "b.org" is not a registered hostname for this portal'),
        ("https://a.org/secret/login", "a.org", 'matches denylisted path pattern "^/secret"'),
        ("https://a.org/LOGIN", "a.org", 'matches excluded route category "login"'),
        ("https://a.org/events/2024", "a.org", 'matches excluded route category "calendar"'),
        ("https://a.org/x?q=1", "a.org", 'matches excluded route category "site_search_results"'),
        ("https://a.org/loginhelp", "a.org", None),
    ]
    df = spark.createDataFrame(rows, "u string, h string, want string").withColumn("hosts", F.array(F.lit("A.org")))
    out = df.withColumn("got", F.expr(urls.scope_reason("u", "h", "hosts", policy)))
    assert out.filter("NOT got <=> want").collect() == []


def test_login_and_block_detection(spark):
    form = '<input type="password"><input name="username">'
    cases = [
        (form, "https://a.org/login", "final URL path looks like a login route and the page contains a password field"),
        (form, "https://a.org/x", "page contains both a password field and a recognizable username field"),
        ("<p>hi</p>", "https://a.org/sso?x=1", "final URL path matches a common login/auth route pattern"),
        ('<input type="password">', "https://a.org/x", None),
    ]
    for body, url, want in cases:
        assert one(spark, html.auth_wall_reason(F.lit(body), F.lit(url))) == want
    assert "CAPTCHA-provider signature (matched recaptcha)" in one(spark, html.block_reason(F.lit("Access denied g-recaptcha")))
    assert one(spark, html.block_reason(F.lit("Unusual Traffic"))).endswith("(matched unusual traffic)")
    assert one(spark, html.block_reason(F.lit("plain"))) is None


def test_shells(spark):
    shell = '<body><div id="root"></div><script>x</script></body>'
    assert one(spark, html.has_app_root(F.lit(shell)))
    assert not one(spark, html.has_app_root(F.lit('<body><p>a</p><p>b</p><div id="root"></div></body>')))
    assert one(spark, html.empty_shell(F.lit(399), F.lit(9), F.lit(True)))
    assert not one(spark, html.empty_shell(F.lit(400), F.lit(9), F.lit(True)))
    assert one(spark, html.empty_shell(F.lit(199), F.lit(2), F.lit(False)))
    assert not one(spark, html.empty_shell(F.lit(199), F.lit(3), F.lit(False)))


def test_hrefs_and_texts(spark):
    body = "<a href=\"/a\">x</a><A class=b href='/b '>y</A><a href=/c>z</a><a href=''>n</a><abbr href=/d>"
    assert one(spark, html.raw_hrefs(F.lit(body))) == ["/a", "/b", "/c"]
    assert one(spark, html.truncate_text(F.lit("a" * 201))) == "a" * 199 + "…"
    assert one(spark, html.truncate_text(F.lit(" a\n b "))) == "a b"
    assert one(spark, html.language(F.lit('<html><meta http-equiv="Content-Language" content=" as ">'))) == "as"


@pytest.mark.parametrize("body,flags", [
    ("mail me at a.b@c.org now", ["possible_email"]), ("call 98765 43210 now", ["possible_indian_mobile_number"]),
    ("+91-9876543210", ["possible_indian_mobile_number", "possible_long_reference_number"]),
    ("1234 5678 9012", ["possible_aadhaar_number"]), ("ABCDE1234F", ["possible_pan_number"]), ("xABCDE1234F", []),
    ("ref 12345678", ["possible_long_reference_number"]), ("1234567", []), (None, []), ("1298765432101234", ["possible_long_reference_number"]),
])
def test_privacy_flags(spark, body, flags):
    assert one(spark, text.privacy_flags(F.lit(body).cast("string"))) == flags


def test_texts(spark):
    assert one(spark, text.normalize_bounded_text(F.lit(" <b>Hi</b>\n there "))) == "Hi there"
    assert one(spark, text.normalize_bounded_text(F.lit("<br> "))) is None
    key = text.duplicate_key(F.lit(" Applied  FOR x "), F.array(F.lit("b"), F.lit("a")), F.lit("2024-05-09"), F.lit(None).cast("string"))
    assert one(spark, key) == '["applied for x","a,b","2024-05",""]'
    assert one(spark, text.csv_cell(F.lit("=1+1"))) == "'=1+1"
    assert one(spark, text.quoted_csv_cell(F.lit('-a"b,c'))) == '"\'-a""b,c"'
    assert one(spark, text.moderation_preview(F.lit("x" * 161))) == "x" * 160 + "…"
    assert one(spark, text.department_label(F.lit("  "))) == "Unspecified"
    want = hmac.new(b"k" * 70, b"10.0.0.1", hashlib.sha256).hexdigest()
    assert one(spark, text.keyed_hash("k" * 70, F.lit("10.0.0.1"))) == want
    assert one(spark, text.keyed_hash("s", F.lit(None).cast("string"))) == hmac.new(b"s", b"unknown", hashlib.sha256).hexdigest()


def test_checks(spark):
    assert [one(spark, checks.classify_http_status(F.lit(s))) for s in (200, 301, 401, 404, 500)] == [None, None, "AUTH_REQUIRED", "HTTP_CLIENT_ERROR", "HTTP_SERVER_ERROR"]
    assert one(spark, checks.classify_network_code(F.lit("EWEIRD"))) == "INTERNAL_AUDIT_ERROR"
    blocked = {"127.0.0.1": True, "172.32.0.1": False, "172.16.9.9": True, "8.8.8.8": False, "300.1.1.1": True, "x": True, "::1": True,
               "fe80::1": True, "fd00::1": True, "2001:db8::1": False, "::ffff:10.0.0.1": True, "::ffff:8.8.8.8": False, "100.127.255.255": True, "100.128.0.0": False}
    assert {ip: one(spark, checks.is_blocked_ip(F.lit(ip))) for ip in blocked} == blocked
    assert one(spark, checks.rank(F.lit("other"), checks.SEVERITY_ORDER, 3)) == 3


def test_first_exact_attribute_counts(spark):
    from webestate.operators import links

    pages = [(1, '<a href="/right" data-href="/wrong">x</a>'), (2, "<a data-href='/no' title='a href=/no >' HREF = /yes>y</a>"), (3, '<a data-href="/no">z</a>'), (4, '<a title="q"href="/q">q</a>')]
    df = spark.createDataFrame([(i, "https://h.org/", h) for i, h in pages], "page_id int, url string, html string")
    assert sorted((r["page_id"], r["raw_href"]) for r in links.extract_links(df).collect()) == [(1, "/right"), (2, "/yes"), (4, "/q")]
    lang = spark.createDataFrame([('<html xml:lang="de" lang="en">',), ('<html xml:lang="de">',)], "h string").select(html.language(F.col("h"))).collect()
    assert [r[0] for r in lang] == ["en", None]


def test_character_references(spark):
    text = "&#8217;&#x2019;&eacute;&amp;lt; &nope; &#0; &#x110000; &#xD800; &Eacute &hellip;&apos;&#99999999999999999999; a&b"
    want = "\u2019\u2019\u00e9&lt; &nope; \ufffd \ufffd \ufffd &Eacute \u2026'\ufffd a&b"
    df = spark.createDataFrame([(text,)], "t string").select(html.decode_entities(F.col("t")).alias("a"), F.expr(html.decoded_sql("t")).alias("b"))
    assert tuple(df.first()) == (want, want)


def test_numbers_with_other_blanks_are_flagged(spark):
    df = spark.createDataFrame([("call 98765\u00a043210 now",), ("id 1234\u20031234\u00a01234",), ("plain",)], "t string")
    assert [r[0] for r in df.select(text.privacy_flags(F.col("t"))).collect()] == [["possible_indian_mobile_number"], ["possible_aadhaar_number"], []]
