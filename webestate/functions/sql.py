"""Expressions and anchors as SQL functions, for users who write SQL only."""

from __future__ import annotations

from pyspark.sql import SparkSession

from webestate.functions.html import ANCHOR_HREF_SQL, decoded_sql, short_text_sql, trimmed_sql

_HOST = r"r'^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]+)'"
_HREF = " || ".join(f"regexp_extract(tag, {ANCHOR_HREF_SQL}, {i})" for i in (1, 2, 3))

#: name -> parameters, result and body. Bodies are single expressions.
SCALARS = {
    "web_host": ("url STRING", "STRING", f"nullif(lower(regexp_extract(url, {_HOST}, 1)), '')"),
    "web_path": ("url STRING", "STRING", r"regexp_extract(url, r'^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"),
    "web_stem": ("url STRING", "STRING", r"regexp_replace(web_host(url), r'^(?:www\d?|m|mobile)\.', '')"),
    "decoded": ("value STRING", "STRING", decoded_sql("value")),
    "trimmed": ("value STRING", "STRING", trimmed_sql("value")),
    "markup_text": ("markup STRING", "STRING", short_text_sql("markup")),
    "page_title": ("html STRING", "STRING", short_text_sql(r"regexp_extract(html, r'(?is)<title[^>]*>(.*?)</title\s*>', 1)")),
    "name_tokens": ("name STRING", "ARRAY<STRING>", "array_distinct(filter(split(lower(name), '[^a-z0-9]+'), t -> length(t) >= 3))"),
    "names_disagree": ("a STRING, b STRING", "BOOLEAN", "size(name_tokens(a)) > 0 AND size(name_tokens(b)) > 0 AND NOT arrays_overlap(name_tokens(a), name_tokens(b))"),
    "http_error": ("status INT", "STRING", "CASE WHEN status = 401 THEN 'AUTH_REQUIRED' WHEN status BETWEEN 400 AND 499 THEN 'HTTP_CLIENT_ERROR' WHEN status >= 500 THEN 'HTTP_SERVER_ERROR' END"),
}
_INNER = r"regexp_extract(piece, r'(?is)^[^>]*>(.*?)</a\s*>', 1)"
#: Anchors of a page in order: place, decoded href and text.
ANCHORS = (
    "html STRING", "pos INT, href STRING, anchor_text STRING",
    f"SELECT pos, {trimmed_sql(decoded_sql(f'({_HREF})'))} AS href, {short_text_sql(_INNER)} AS anchor_text "
    f"FROM (SELECT pos, piece, regexp_extract(piece, {ANCHOR_HREF_SQL}, 0) AS tag "
    r"FROM posexplode(split(html, r'(?i)(?=<a[\s/])', -1)) AS t(pos, piece)) WHERE tag <> ''",
)


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions for this session, and return their names. ``web_anchors`` is a table function, used with LATERAL."""
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    parameters, result, body = ANCHORS
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION web_anchors({parameters}) RETURNS TABLE({result}) RETURN {body}")
    return [*SCALARS, "web_anchors"]
