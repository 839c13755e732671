"""Tags, attributes and sub-resource addresses of markup in one pass, as native expressions (no DOM library)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webestate.functions.html import decode_entities, trim_all

QUIET = r"(?is)<!--.*?-->"
#: An opening tag with quoted values stepped over, or a style element with its text.
TAG = r"""(?is)<style\b[^>]*>.*?</style\s*>|<[a-z][^\s/>]*(?:[^>"']|"[^"]*"|'[^']*')*>"""
ATTRIBUTE = r"""(?is)([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
CSS_URL = r"""(?i)(?:url\(\s*["']?|@import\s+["'])([^"')\s]+)"""

# Attributes that load a resource, by tag, and whether the resource can act on the page.
LOADS = {
    ("script", "src"): "active", ("iframe", "src"): "active", ("frame", "src"): "active", ("embed", "src"): "active", ("object", "data"): "active",
    ("img", "src"): "passive", ("img", "srcset"): "passive", ("source", "src"): "passive", ("source", "srcset"): "passive", ("audio", "src"): "passive",
    ("video", "src"): "passive", ("video", "poster"): "passive", ("track", "src"): "passive", ("input", "src"): "passive", ("body", "background"): "passive",
    ("form", "action"): "form",
}
# Link relations that load a resource.
ACTIVE_LINKS, PASSIVE_LINKS = ("stylesheet", "modulepreload"), ("icon", "preload", "prefetch", "apple-touch-icon", "manifest")


def tags(html: Column) -> Column:
    """Opening tags and style elements in document order, comments left out."""
    return F.regexp_extract_all(F.regexp_replace(html, QUIET, ""), F.lit(TAG), F.lit(0))


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^<([^\s/>]+)", 1))


def attributes(tag: Column) -> Column:
    """``name, value`` of the attributes with a value, in order; names in lower case, values decoded and trimmed."""
    body = F.regexp_extract(tag, r"(?is)^<[^\s/>]+((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", 1)
    names, double, single, bare = (F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(i)) for i in (1, 2, 3, 4))
    pairs = F.arrays_zip(names.alias("n"), double.alias("d"), single.alias("s"), bare.alias("b"))
    return F.transform(pairs, lambda a: F.struct(F.lower(a["n"]).alias("name"), trim_all(decode_entities(F.concat(a["d"], a["s"], a["b"]))).alias("value")))


def srcset_urls(value: Column) -> Column:
    """Addresses of a srcset list; commas inside an address, as in data URLs, do not end it."""
    return F.transform(F.regexp_extract_all(value, F.lit(r"(?:^|,)\s*([^\s,][^\s]*)"), F.lit(1)), lambda u: F.regexp_replace(u, ",+$", ""))


def css_urls(css: Column) -> Column:
    return F.regexp_extract_all(css, F.lit(CSS_URL), F.lit(1))
