"""HTML expressions over whole page texts (no DOM library)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from html.entities import name2codepoint
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TEXT = 200

# Login and block signatures, in order of precedence.
AUTH_PATH = r"(?i)/(login|log-in|signin|sign-in|auth|authenticate|account/login|sso)(?:[/?#]|$)"
PASSWORD_FIELD = r"""(?i)<input[^>]+type=["']?password["']?"""
USERNAME_FIELD = r"""(?i)<input[^>]+(?:name|id)=["']?(username|user_name|user-id|loginid|login_id)["']?"""
CAPTCHA_SIGNATURES = (
    "recaptcha", "g-recaptcha", "hcaptcha", "h-captcha", "cf-turnstile",
    r"captcha-delivery\.com", "funcaptcha", "arkoselabs",
)
BLOCK_PHRASES = (
    "access denied", "automated (queries|requests|access)", "unusual traffic",
    "please verify you are a human", "verify you are human",
    "checking your browser before accessing", "pardon the interruption", "request blocked",
)
# Every signature and phrase holds one of these.
BLOCK_PARTS = (
    "captcha", "cf-turnstile", "arkoselabs", "access denied", "automated ", "unusual traffic", "verify you are", "checking your browser",
    "pardon the interruption", "request blocked",
)
# Reasons for a login wall or a block.
LOGIN_ROUTE_AND_PASSWORD = "final URL path looks like a login route and the page contains a password field"
PASSWORD_AND_USERNAME = "page contains both a password field and a recognizable username field"
LOGIN_ROUTE = "final URL path matches a common login/auth route pattern"
CAPTCHA_REASON = "page contains a recognizable CAPTCHA-provider signature (matched "
BLOCK_REASON = "page contains bot-block interstitial phrasing (matched "
# Shell thresholds.
SHELL_TEXT, SHELL_LINKS, APP_ROOT_TEXT = 200, 3, 400

# White space as JavaScript's \s has it, as a regex class body.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# The same without the plain blank.
BREAKS = SPACE.replace(r"\s", r"\t\n\x0B\f\r")

# " name=hex code point " of the HTML 4 entity names, from the standard library's table, and apos.
ENTITY_NAMES = " " + " ".join(f"{n}={c:06X}" for n, c in sorted({**name2codepoint, "apos": 39}.items())) + " "
ENTITY = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"

# Fixed value: the link scan's href pattern. Being greedy, it takes the last attribute whose name ends in "href".
HREF = r"""(?is)<a\b[^>]*\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""


def attribute_pattern(tag: str, name: str) -> str:
    """First attribute of exactly this name; quoted values of other attributes are stepped over."""
    return rf"""(?is)<{tag}(?=[\s/"'>])(?:[^"'>]*?(?:"[^"]*"|'[^']*'))*?[^"'>]*?(?<=[\s"'/]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""


def quoted_sql(pattern: str) -> str:
    return "r\"" + pattern.replace('"', r"\x22") + "\""


ANCHOR_HREF_SQL = quoted_sql(attribute_pattern("a", "href"))


def trimmed_sql(value: str) -> str:
    return rf"regexp_replace({value}, r'^[{SPACE}]+|[{SPACE}]+$', '')"


def decoded_sql(value: str) -> str:
    """Character references decoded: decimal, hexadecimal and the names above; others stay."""
    code = (
        f"CASE WHEN ent_n LIKE '#x%' OR ent_n LIKE '#X%' THEN substr(ent_n, 3) WHEN ent_n LIKE '#%' THEN hex(try_cast(substr(ent_n, 2) AS BIGINT)) "
        f"WHEN ent_n <> '' AND instr('{ENTITY_NAMES}', concat(' ', ent_n, '=')) > 0 THEN substr('{ENTITY_NAMES}', instr('{ENTITY_NAMES}', concat(' ', ent_n, '=')) + length(ent_n) + 2, 6) "
        f"WHEN ent_n <> '' THEN '-' END")
    number = "conv(ent_c, 16, 10)"
    point = (f"CASE WHEN length(ltrim('0', ent_c)) BETWEEN 1 AND 6 AND {number} <= 1114111 AND {number} NOT BETWEEN 55296 AND 57343 "
             f"THEN decode(unhex(lpad(ltrim('0', ent_c), 8, '0')), 'UTF-32') ELSE '\ufffd' END")
    known = "CASE WHEN ent_c = '-' OR ent_n = '' THEN concat('&', ent_p) ELSE concat(" + point + ", substr(ent_p, length(ent_n) + 2)) END"
    piece = f"transform(array(coalesce({code}, CASE WHEN ent_n = '' THEN '-' ELSE 'FFFFFFF' END)), ent_c -> {known})[0]"
    each = f"transform(array(regexp_extract(ent_p, r'{ENTITY}', 1)), ent_n -> {piece})[0]"
    out = f"array_join(transform(split(x, '&', -1), (ent_p, ent_i) -> CASE WHEN ent_i = 0 THEN ent_p ELSE {each} END), '')"
    return f"transform(array({value}), x -> CASE WHEN contains(x, '&') THEN {out} ELSE x END)[0]"


def short_text_sql(markup: str) -> str:
    """Text of some markup, collapsed, at most 200 characters, null when empty."""
    flat = trimmed_sql(rf"regexp_replace(regexp_replace({decoded_sql(f"regexp_replace({markup}, '<[^>]*>', '')")}, r'[{SPACE}]+', ' '), '^ ', '')")
    return (
        f"transform(array({flat}), f -> CASE WHEN f = '' THEN NULL WHEN length(f) > {MAX_TEXT} "
        f"THEN concat(left(f, {MAX_TEXT - 1}), '…') ELSE f END)[0]"
    )


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends. Single blanks are no match, so most of a text is copied as it is."""
    return F.btrim(F.regexp_replace(text, rf"[{BREAKS}][{SPACE}]*| [{SPACE}]+", " "), F.lit(" "))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _entity(piece: Column) -> Column:
    """What follows an ampersand, decoded."""
    def pointed(name: Column, code: Column) -> Column:
        """The character of a hexadecimal code, and what follows the reference."""
        digits = F.ltrim(code, F.lit("0"))
        number = F.conv(digits, 16, 10).cast("bigint")
        valid = F.length(digits).between(1, 6) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.concat(char, F.substring(piece, F.length(name) + 2, F.lit(2**30)))

    def named(name: Column) -> Column:
        """A name's code, null if it has none."""
        at = F.instr(F.lit(ENTITY_NAMES), F.concat(F.lit(" "), name, F.lit("=")))
        return bound(at, lambda i: F.when(i > 0, F.substring(F.lit(ENTITY_NAMES), i + F.length(name) + 2, F.lit(6))))

    def decoded(name: Column) -> Column:
        numeric = F.when(F.lower(name).startswith("#x"), F.substring(name, 3, 2**30)).otherwise(F.hex(F.substring(name, 2, 2**30).try_cast("bigint")))
        code = F.when(name.startswith("#"), F.coalesce(numeric, F.lit("FFFFFFF"))).otherwise(named(name))
        plain = F.concat(F.lit("&"), piece)
        return F.when(name == "", plain).otherwise(bound(code, lambda c: F.when(c.isNull(), plain).otherwise(pointed(name, c))))

    return bound(F.regexp_extract(piece, ENTITY, 1), decoded)


#: Frequent references that plain replacement decodes; the ampersand comes last, so nothing is decoded twice.
FREQUENT = ("lt", "gt", "quot", "apos", "nbsp", "copy", "middot")
#: Any other reference.
OTHER = r"&(?!amp;)(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


def decode_entities(text: Column) -> Column:
    """Character references decoded; works on plain columns. Texts with frequent references only are not taken apart."""
    def whole(t: Column) -> Column:
        return F.array_join(F.transform(F.split(t, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(_entity(p))), "")

    def decoded(t: Column) -> Column:
        common = t
        for name in FREQUENT:
            common = F.replace(common, F.lit(f"&{name};"), F.lit(chr({**name2codepoint, "apos": 39}[name])))
        known = bound(common, lambda c: F.when(~c.contains("&") | ~c.rlike(OTHER), F.replace(c, F.lit("&amp;"), F.lit("&"))))
        return F.when(~t.contains("&"), t).otherwise(F.coalesce(known, whole(t)))

    return bound(text, decoded)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>", "")


def truncate_text(text: Column) -> Column:
    flat = collapse(text)
    return F.when(
        F.length(flat) > MAX_TEXT, F.concat(F.substring(flat, 1, MAX_TEXT - 1), F.lit("…"))
    ).otherwise(flat)


def non_empty(text: Column) -> Column:
    return F.when(text != "", text)


def content_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def raw_hrefs(html: Column) -> Column:
    """All anchor href values in document order, trimmed, empty ones dropped."""
    double, single, bare = (F.regexp_extract_all(html, F.lit(HREF), F.lit(i)) for i in (1, 2, 3))
    merged = F.zip_with(
        F.zip_with(double, single, lambda d, s: F.concat(d, s)), bare, lambda ds, b: F.concat(ds, b)
    )
    return F.filter(F.transform(merged, trim_all), lambda h: h != "")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside one tag; null when absent."""
    pattern = attribute_pattern("[a-z0-9]+", name)
    value = F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))
    return F.when(tag.rlike(pattern), decode_entities(value))


def page_title(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    return non_empty(truncate_text(decode_entities(raw)))


def canonical_href(html: Column) -> Column:
    tag = F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*>""", 0)
    return F.when(tag != "", trim_all(attribute(tag, "href")))


def base_href(html: Column) -> Column:
    tag = F.regexp_extract(html, r"(?is)<base\b[^>]*\bhref\b[^>]*>", 0)
    return F.when(tag != "", attribute(tag, "href"))


def language(html: Column) -> Column:
    lang = attribute(F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0), "lang")
    meta = attribute(
        F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?content-language["']?[^>]*>""", 0), "content"
    )
    return non_empty(trim_all(F.coalesce(lang, meta, F.lit(""))))


def auth_wall_reason(html: Column, url: Column) -> Column:
    """Why a page looks like a login wall, else null."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    login_path = F.when(url.rlike(r"^[A-Za-z]+://"), path).otherwise(url).rlike(AUTH_PATH)
    password, username = html.rlike(PASSWORD_FIELD), html.rlike(USERNAME_FIELD)
    return (
        F.when(login_path & password, F.lit(LOGIN_ROUTE_AND_PASSWORD))
        .when(password & username, F.lit(PASSWORD_AND_USERNAME))
        .when(login_path, F.lit(LOGIN_ROUTE))
    )


def block_reason(html: Column) -> Column:
    """First CAPTCHA signature, else first interstitial phrase, else null."""
    out = F.lit(None).cast("string")
    groups = (
        (BLOCK_PHRASES, BLOCK_REASON),
        (CAPTCHA_SIGNATURES, CAPTCHA_REASON),
    )
    for patterns, label in groups:
        for pattern in reversed(patterns):
            out = F.when(html.rlike("(?i)" + pattern), F.lit(f"{label}{pattern})")).otherwise(out)
    # Plain searches answer for the many pages that match nothing.
    def maybe(low: Column) -> Column:
        return reduce(or_, (low.contains(part) for part in BLOCK_PARTS))

    return F.when(bound(F.lower(html), maybe), out)


def visible_markup(html: Column) -> Column:
    """Body markup without scripts, styles, noscript parts and comments."""
    def body(quiet: Column) -> Column:
        return F.when(
            quiet.rlike(r"(?i)<body\b"), F.regexp_extract(quiet, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
        ).otherwise(F.regexp_replace(quiet, r"(?is)<head\b[^>]*>.*?</head\s*>|<title[^>]*>.*?</title\s*>", ""))

    return bound(F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->", ""), body)


def markup_text(markup: Column) -> Column:
    """Text of visible markup."""
    return collapse(decode_entities(strip_tags(markup)))


def visible_text(html: Column) -> Column:
    return markup_text(visible_markup(html))


def has_app_root(html: Column) -> Column:
    return app_root(visible_markup(html))


def app_root(body: Column) -> Column:
    """A mount-point element alone in the body, or beside one simple sibling.

    Approximates "at most two body children" without a DOM: the sibling may hold text only.
    """
    mark = r"""(?:\bid\s*=\s*["']?(?:app|root|__next|__nuxt)["']?(?=[\s>/])|\bdata-reactroot\b)"""
    sibling = r"(?:<[a-z0-9]+\b[^>]*>(?:[^<]*</[a-z0-9]+\s*>)?)"
    root = rf"<([a-z0-9]+)\b[^>]*{mark}[^>]*>.*</\1\s*>"
    # Most pages have no such mark at all.
    return bound(body, lambda body: body.rlike("(?i)" + mark) & _root_alone(body, root, sibling))


def _root_alone(body: Column, root: str, sibling: str) -> Column:
    return body.rlike(rf"(?is)^\s*{sibling}\s*{root}\s*$") | body.rlike(rf"(?is)^\s*{root}\s*{sibling}?\s*$")


def empty_shell(text_length: Column, links: Column, app_root: Column) -> Column:
    return (app_root & (text_length < APP_ROOT_TEXT)) | ((text_length < SHELL_TEXT) & (links < SHELL_LINKS))
