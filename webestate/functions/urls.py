"""URL expressions: parsing, canonical form, resolution, scope."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import IllegalArgumentException
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default tracking parameters.
TRACKING_PARAMETERS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid",
)

# Route categories with their path patterns, in policy order.
ROUTE_CATEGORIES = {
    "login": [r"/login\b", r"/signin\b", r"/log-in\b"],
    "logout": [r"/logout\b", r"/signout\b"],
    "authentication": [r"/auth\b", r"/authenticate\b", r"/otp\b"],
    "account": [r"/account\b", r"/my-account\b", r"/profile\b"],
    "payment": [r"/pay\b", r"/payment", r"/checkout\b"],
    "transaction_submission": [r"/submit\b", r"/apply\b", r"/transaction"],
    "state_mutating_form": [r"/delete\b", r"/update\b", r"/create\b"],
    "calendar": [r"/calendar\b", r"/events?/\d{4}"],
    "site_search_results": [r"/search\b", r"[?&]q="],
    "infinite_query_combination": [],
}

# Reject reasons.
EMPTY_URL = "empty URL"
MALFORMED_URL = "malformed URL (failed to parse)"
UNSUPPORTED_SCHEME = 'unsupported scheme "{}:" (only http/https are admitted as portal URLs)'
DISABLED_DOMAIN = 'domain "{}" is disabled by crawl policy'
FOREIGN_HOST = 'hostname "{}" is not a registered hostname for this portal'
DENYLISTED_PATH = 'matches denylisted path pattern "{}"'
EXCLUDED_ROUTE = 'matches excluded route category "{}"'
UNUSABLE_URL = "malformed URL"


def _around(template: str, value: str) -> str:
    head, tail = template.split("{}")
    return f"concat('{head}', {value}, '{tail}')"



@dataclass(frozen=True)
class UrlOptions:
    strip_trailing_slash: bool = True
    remove_fragments: bool = True
    tracking_parameters: tuple[str, ...] = TRACKING_PARAMETERS
    sort_parameters: bool = True


@dataclass(frozen=True)
class CrawlPolicy:
    """Default crawl boundaries and exclusions."""

    max_pages: int = 40
    max_depth: int = 2
    allowed_schemes: tuple[str, ...] = ("http", "https")
    excluded_schemes: tuple[str, ...] = ("mailto", "tel", "javascript", "data")
    denylist_patterns: tuple[str, ...] = ()
    route_categories: tuple[str, ...] = tuple(ROUTE_CATEGORIES)
    disabled_domains: tuple[str, ...] = ()
    url_options: UrlOptions = field(default_factory=UrlOptions)

# The multi-step expressions below are SQL text. ``bind`` names an intermediate
# value through a one-element array: a lambda variable is evaluated once and the
# optimizer never copies its definition into every place that uses it.


def bind(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


# Characters that stay as they are in a path and in a query.
PATH_KEEP = r"\x21\x23-\x3B\x3D\x40-\x5F\x61-\x7A\x7C\x7E"
QUERY_KEEP = r"\x21\x24-\x26\x28-\x3B\x3D\x3F-\x7E"


def _percent_encoded(value: str, keep: str) -> str:
    """Percent-encode runs of characters outside ``keep`` (a regex class body)."""
    return (
        f"CASE WHEN {value} RLIKE r'^[{keep}]*$' THEN {value} ELSE array_join(transform("
        f"regexp_extract_all({value}, r'([{keep}]+|[^{keep}]+)', 1), run -> CASE WHEN run RLIKE r'^[{keep}]+$' "
        "THEN run ELSE replace(url_encode(run), '+', '%20') END), '') END"
    )


def _without_dot_segments(path: str) -> str:
    kept = (
        f"aggregate(slice(split({path}, '/', -1), 2, greatest(size(split({path}, '/', -1)) - 1, 0)), CAST(array() AS array<string>), (acc, seg) -> "
        r"CASE WHEN seg RLIKE r'(?i)^(\.|%2e){2}$' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) "
        r"WHEN seg RLIKE r'(?i)^(\.|%2e)$' THEN acc ELSE array_append(acc, seg) END)"
    )
    tail = rf"CASE WHEN {path} RLIKE r'(?i)/(\.|%2e){{1,2}}$' THEN array('') ELSE CAST(array() AS array<string>) END"
    return (
        rf"CASE WHEN {path} = '' THEN '/' WHEN {path} RLIKE r'(?i)(^|/)(\.|%2e){{1,2}}(/|$)' "
        f"THEN concat('/', array_join(concat({kept}, {tail}), '/')) ELSE {path} END"
    )


def parts_sql(url: str) -> str:
    """Struct of the parts of an absolute http(s) URL; ``valid`` is false otherwise.

    Internationalised hosts and numeric IPv4 spellings are taken as written.
    """
    bad_host = (
        r"h.host = '' OR (NOT h.host RLIKE r'^\[[0-9a-f:.]+\]$' AND h.host RLIKE r'[\x00-\x20#/:<>?@\[\\\]^|%\x7F]')"
    )
    finish = f"""named_struct(
        'valid', a.scheme IN ('http', 'https') AND NOT ({bad_host}) AND coalesce(try_cast(h.port AS bigint), 0) <= 65535,
        'scheme', a.scheme, 'userinfo', h.userinfo, 'host', h.host,
        'port', CASE WHEN h.port = CASE a.scheme WHEN 'https' THEN '443' ELSE '80' END THEN '' ELSE h.port END,
        'path', {bind('dots', _without_dot_segments('a.path'), _percent_encoded('dots', PATH_KEEP))},
        'query', a.query, 'fragment', a.fragment)"""
    host = r"""named_struct(
        'host', lower(regexp_extract(regexp_replace(a.authority, '^.*@', ''), r'^(\[[^\]]*\]|[^:]*)(?::[0-9]*)?$', 1)),
        'port', regexp_replace(regexp_extract(a.authority, r'^(?:.*@)?(?:\[[^\]]*\]|[^:@]*):([0-9]+)$', 1), '^0+(?=.)', ''),
        'userinfo', regexp_extract(a.authority, '^(.*)@', 1))"""
    cut = r"""named_struct(
        'scheme', lower(regexp_extract(u, r'^([A-Za-z][A-Za-z0-9+.\-]*):', 1)),
        'authority', regexp_extract(u, r'(?i)^https?:[/\\]*([^/\\?#]*)', 1),
        'path', replace(regexp_extract(u, r'(?i)^https?:[/\\]*[^/\\?#]*([^?#]*)', 1), r'\', '/'),
        'query', regexp_extract(u, r'^[^?#]*\?([^#]*)', 1),
        'fragment', regexp_extract(u, r'^[^#]*#(.*)$', 1))"""
    return bind("u", _clean(url), bind("a", cut, bind("h", host, finish)))


def _clean(url: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({url}, ''), r'(?U)^[\x00-\x20\s]+|[\x00-\x20\s]+$', ''), r'[\t\n\r]', '')"


def _origin(parts: str) -> str:
    return (
        f"concat({parts}.scheme, '://', CASE WHEN {parts}.userinfo <> '' THEN concat({parts}.userinfo, '@') ELSE '' END, "
        f"{parts}.host, CASE WHEN {parts}.port <> '' THEN concat(':', {parts}.port) ELSE '' END)"
    )


def _canonical_query(query: str, options: UrlOptions) -> str:
    """Form-decode, drop tracking keys, sort by (key, value), form-encode."""
    def decode(value: str) -> str:
        return f"url_decode(regexp_replace({value}, '%(?![0-9A-Fa-f]{{2}})', '%25'))"

    key = "substring_index(p, '=', 1)"
    value = "CASE WHEN contains(p, '=') THEN regexp_replace(p, '^[^=]*=', '') ELSE '' END"
    pairs = f"transform(filter(split({query}, '&'), p -> p <> ''), p -> named_struct('k', {decode(key)}, 'v', {decode(value)}))"
    if options.tracking_parameters:
        keys = ", ".join("'" + k.replace("'", "\\'") + "'" for k in options.tracking_parameters)
        pairs = f"filter({pairs}, p -> p.k NOT IN ({keys}))"
    if options.sort_parameters:
        pairs = f"array_sort({pairs})"
    return f"CASE WHEN {query} = '' THEN '' ELSE array_join(transform({pairs}, p -> concat(url_encode(p.k), '=', url_encode(p.v))), '&') END"


def normalized_sql(url: str, options: UrlOptions = UrlOptions(), original: str | None = None) -> str:
    """Struct (ok, original, normalized, hostname, reason) of a raw URL."""
    path = "x.path"
    if options.strip_trailing_slash:
        path = "CASE WHEN length(x.path) > 1 AND endswith(x.path, '/') THEN left(x.path, length(x.path) - 1) ELSE x.path END"
    fragment = "''" if options.remove_fragments else "CASE WHEN x.fragment <> '' THEN concat('#', x.fragment) ELSE '' END"
    whole = f"concat({_origin('x')}, {path}, CASE WHEN q <> '' THEN concat('?', q) ELSE '' END, {fragment})"
    reason = (
        f"CASE WHEN raw = '' THEN '{EMPTY_URL}' WHEN x.scheme = '' THEN '{MALFORMED_URL}' "
        f"WHEN x.scheme NOT IN ('http', 'https') THEN {_around(UNSUPPORTED_SCHEME, 'x.scheme')} "
        f"WHEN NOT x.valid THEN '{MALFORMED_URL}' END"
    )
    finish = (
        f"named_struct('ok', why IS NULL, 'original', {original or url}, 'normalized', CASE WHEN why IS NULL THEN {whole} END, "
        "'hostname', CASE WHEN why IS NULL THEN x.host END, 'reason', why)"
    )
    body = bind("x", parts_sql("raw"), bind("q", _canonical_query("x.query", options), bind("why", reason, finish)))
    return bind("raw", rf"regexp_replace(coalesce({url}, ''), r'(?U)^\s+|\s+$', '')", body)


def resolved_sql(href: str, base: str) -> str:
    """``href`` resolved against the absolute URL ``base``; null if it cannot be."""
    return bind("b", parts_sql(base), resolved_against_sql(href, "b"))


def resolved_against_sql(href: str, b: str) -> str:
    """``href`` resolved against a base given as the struct of its parts."""
    joined = rf"""CASE WHEN ref RLIKE r'^[A-Za-z][A-Za-z0-9+.\-]*:' THEN ref WHEN {b}.valid THEN CASE
        WHEN ref = '' THEN concat(page, bq)
        WHEN ref RLIKE r'^[/\\]{{2}}' THEN concat({b}.scheme, ':', ref)
        WHEN ref RLIKE r'^[/\\]' THEN concat({_origin(b)}, ref)
        WHEN startswith(ref, '?') THEN concat(page, ref)
        WHEN startswith(ref, '#') THEN concat(page, bq, ref)
        ELSE concat({_origin(b)}, regexp_replace({b}.path, '[^/]*$', ''), ref) END END"""
    web = (
        f"concat({_origin('y')}, y.path, CASE WHEN y.query <> '' THEN concat('?', {_percent_encoded('y.query', QUERY_KEEP)}) ELSE '' END, "
        "CASE WHEN y.fragment <> '' THEN concat('#', y.fragment) ELSE '' END)"
    )
    other = "CASE WHEN y.scheme <> '' AND y.scheme NOT IN ('http', 'https') THEN concat(y.scheme, regexp_replace(j, '^[^:]*', '')) END"
    body = bind("y", parts_sql("j"), f"CASE WHEN y.valid THEN {web} ELSE {other} END")
    query = f"CASE WHEN {b}.query <> '' THEN concat('?', {b}.query) ELSE '' END"
    body = bind("page", f"concat({_origin(b)}, {b}.path)", bind("bq", query, bind("j", joined, body)))
    return f"CASE WHEN {href} IS NOT NULL THEN {bind('ref', _clean(href), body)} END"


def once(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add a costly column that is computed exactly once per row.

    A filter on a plain projected column is pushed below the projection together
    with a copy of its expression; it is not pushed below a generator.
    """
    return df.select("*", F.expr(f"explode(array({expression}))").alias(name))


def with_normalized_url(
    df: DataFrame, column: str, out: str, options: UrlOptions = UrlOptions(), base: str | None = None
) -> DataFrame:
    """Add struct ``out``(ok, original, normalized, hostname, reason) for a raw URL column."""
    if base is None:
        return once(df, out, normalized_sql(column, options))
    source = rf"CASE WHEN {base} IS NULL OR {column} RLIKE r'(?U)^\s*$' THEN {column} ELSE coalesce({resolved_sql(column, base)}, {column}) END"
    return once(df, out, bind("src", source, normalized_sql("src", options, column)))


def with_resolved_url(df: DataFrame, href: str, base: str, out: str) -> DataFrame:
    return once(df, out, resolved_sql(href, base))


def host_of(url: Column) -> Column:
    """Lower-cased host of an absolute URL, null when there is none."""
    host = F.lower(F.regexp_extract(
        url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]+)", 1))
    return F.when(host != "", host)


def portal_id(normalized: Column) -> Column:
    """Stable id: host and path segments joined by '-'."""
    path = F.regexp_extract(normalized, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    segments = F.transform(
        F.filter(F.split(path, "/"), lambda s: s != ""),
        lambda s: F.regexp_replace(s, r"[^A-Za-z0-9._~\-]+", "-"),
    )
    return F.lower(F.concat_ws("-", host_of(normalized), segments))


def is_domain_disabled(host: str, domains: tuple[str, ...]) -> str:
    """SQL condition: host equals a disabled domain or lies below one."""
    tests = [f"lower({host}) = {_quoted(d.lower())} OR endswith(lower({host}), {_quoted('.' + d.lower())})" for d in domains]
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def host_in_scope(host: str, hostnames: str) -> str:
    return f"exists({hostnames}, known -> lower(known) = lower({host}))"


def _usable(pattern: str) -> bool:
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile("(?i)" + pattern)
    except IllegalArgumentException:
        return False
    return True


def denylist_match(path: str, patterns: tuple[str, ...]) -> str:
    """SQL for the first matching pattern; patterns that the engine's regex language refuses are skipped."""
    branches = []
    for pattern in patterns:
        if not _usable(pattern):
            continue
        branches.append(f"WHEN {path} RLIKE {_quoted('(?i)' + pattern)} THEN {_quoted(pattern)}")
    return "CASE " + " ".join(branches) + " END" if branches else "CAST(NULL AS string)"


def route_category(path: str, categories: tuple[str, ...] = tuple(ROUTE_CATEGORIES)) -> str:
    """SQL for the first category in policy order whose patterns match the path (query included)."""
    branches = [
        f"WHEN {path} RLIKE {_quoted('(?i)' + '|'.join(ROUTE_CATEGORIES[c]))} THEN {_quoted(c)}"
        for c in categories if ROUTE_CATEGORIES.get(c)
    ]
    return "CASE " + " ".join(branches) + " END" if branches else "CAST(NULL AS string)"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scope_reason(normalized: str, host: str, hostnames: str, policy: CrawlPolicy) -> str:
    """SQL for why a URL is out of scope, null when it is in scope. The first reason wins."""
    tail = bind("deny", denylist_match("route", policy.denylist_patterns), bind(
        "category", route_category("route", policy.route_categories),
        f"CASE WHEN deny IS NOT NULL THEN {_around(DENYLISTED_PATH, 'deny')} WHEN category IS NOT NULL THEN {_around(EXCLUDED_ROUTE, 'category')} END"))
    tail = bind("route", f"regexp_extract({normalized}, '^[a-z]+://[^/?#]*([^#]*)', 1)", tail)
    return f"""CASE WHEN {is_domain_disabled(host, policy.disabled_domains)} THEN {_around(DISABLED_DOMAIN, host)}
        WHEN NOT {host_in_scope(host, hostnames)} THEN {_around(FOREIGN_HOST, host)}
        WHEN NOT {normalized} RLIKE '^https?://' THEN '{UNUSABLE_URL}' ELSE {tail} END"""
