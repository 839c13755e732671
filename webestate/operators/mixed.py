"""Mixed content: resources that a page served over HTTPS loads over plain HTTP, as advisory evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webestate.functions import tags as T
from webestate.functions.html import base_href, trim_all
from webestate.operators.rules.availability import text
from webestate.operators.rules.base import Rule, RuleContext, draft, findings_from, quoted

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def sub_resources(pages: DataFrame, mention: str | None = None) -> DataFrame:
    """Everything that pages (``page_id, url, html``) load: ``page_id, url, tag_nth, tag, attribute, resource, scheme, kind``.

    ``resource`` is the address as written; ``scheme`` is its own, or that of the page's base or address for a relative one. ``kind``
    is active, passive or form. With ``mention``, a pattern, only tags that match it are taken apart; relative addresses are then found
    only where a base matches. Tags are exploded before their attributes are read; no row carries more than one tag.
    """
    page = pages.select("page_id", "url", base_href(F.col("html")).alias("base"), T.tags(F.col("html")).alias("tags"))
    base_scheme = F.lower(F.coalesce(F.nullif(F.regexp_extract("base", SCHEME, 1), F.lit("")), F.nullif(F.regexp_extract("url", SCHEME, 1), F.lit(""))))
    # Outer forms keep the optimizer from testing the arrays, and so making them, once more.
    rows = page.select("page_id", "url", base_scheme.alias("base_scheme"), F.posexplode_outer("tags").alias("tag_nth", "raw")).where("raw IS NOT NULL")
    if mention is not None:
        rows = rows.where(F.col("raw").rlike(mention) | (F.col("base_scheme") == "http"))
    named = rows.select("page_id", "url", "base_scheme", "tag_nth", "raw", T.tag_name(F.col("raw")).alias("tag"))
    own = F.when((F.col("tag") == "style") & F.col("raw").rlike(r"(?is)</style\s*>$"), F.array(F.struct(F.lit("text").alias("name"), F.col("raw").alias("value")))).otherwise(T.attributes(F.col("raw")))
    attributes = named.select("page_id", "url", "base_scheme", "tag_nth", "tag", own.alias("attributes"))
    relation = F.lower(F.get(F.filter("attributes", lambda a: a["name"] == "rel"), F.lit(0))["value"])
    each = attributes.select("page_id", "url", "base_scheme", "tag_nth", "tag", F.when(F.col("tag") == "link", relation).alias("rel"),
                             F.explode_outer("attributes").alias("a")).where("a IS NOT NULL").select("*", F.col("a.name").alias("attribute"), "a.value")
    kinds = F.create_map(*[F.lit(x) for (tag, name), kind in T.LOADS.items() for x in (f"{tag} {name}", kind)])
    words = F.split("rel", r"\s+")
    linked = (F.when(F.arrays_overlap(words, F.array(*map(F.lit, T.ACTIVE_LINKS))), "active")
              .when(F.arrays_overlap(words, F.array(*map(F.lit, T.PASSIVE_LINKS))), "passive"))
    known = F.when((F.col("tag") == "link") & (F.col("attribute") == "href"), linked).otherwise(F.try_element_at(kinds, F.concat_ws(" ", "tag", "attribute")))
    css = (F.col("attribute") == "style") | ((F.col("tag") == "style") & (F.col("attribute") == "text"))
    imports = F.regexp_extract_all("value", F.lit(r"(?i)@import\s+(?:url\(\s*)?[\"']?([^\"')\s;]+)"), F.lit(1))
    loaded = F.when(css, F.array_except(T.css_urls(F.col("value")), imports)).when(F.col("attribute") == "srcset", T.srcset_urls(F.col("value"))).otherwise(F.array("value"))
    found = each.where(known.isNotNull() | css).select(
        "page_id", "url", "base_scheme", "tag_nth", "tag", "attribute",
        F.explode_outer(F.concat(F.transform(loaded, lambda u: F.struct(u.alias("resource"), F.when(css, "passive").otherwise(known).alias("kind"))),
                           F.transform(F.when(css, imports).otherwise(F.array().cast("array<string>")), lambda u: F.struct(u.alias("resource"), F.lit("active").alias("kind"))))).alias("r"))
    resource = trim_all(F.col("r.resource"))
    scheme = F.coalesce(F.nullif(F.regexp_extract(resource, SCHEME, 1), F.lit("")), F.when(resource.startswith("//"), F.regexp_extract("url", SCHEME, 1)), "base_scheme")
    return found.where(resource != "").select("page_id", "url", "tag_nth", "tag", "attribute", resource.alias("resource"), F.lower(scheme).alias("scheme"), F.col("r.kind").alias("kind"))


def mixed_content(pages: DataFrame) -> DataFrame:
    """Resources over HTTP on pages over HTTPS. Pages of another scheme, or without ``http:`` in their markup, are not taken apart."""
    maybe = pages.where(F.col("url").rlike("(?i)^https:") & F.col("html").rlike("(?i)http(?::|&)"))
    return sub_resources(maybe, r"(?i)http(?::|&)").where("scheme = 'http'")


def mixed_summary(pages: DataFrame) -> DataFrame:
    """One row per page with mixed content: counts by kind, distinct hosts, and the first resource."""
    found = mixed_content(pages)
    host = F.lower(F.regexp_extract("resource", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#:\s]+)", 1))
    return found.groupBy("page_id", "url").agg(
        *(F.count_if(F.col("kind") == k).alias(k) for k in ("active", "passive", "form")),
        F.array_sort(F.collect_set(F.nullif(host, F.lit("")))).alias("hosts"), F.min_by("resource", F.struct("tag_nth", "attribute", "resource")).alias("first_resource"))


def mixed_rule(pages: DataFrame) -> Rule:
    """A rule beside the HTTPS rules: entry pages with mixed content. ``pages`` has ``portal_id, page_id, url, html``."""

    def evaluate(ctx: RuleContext, parameters: dict) -> DataFrame:
        entry = pages.join(ctx.portals.select("portal_id", "canonical_url"), "portal_id").where("url = canonical_url")
        found = mixed_summary(entry.select(F.struct("portal_id", "page_id").alias("page_id"), "url", "html")).withColumn("portal_id", F.col("page_id.portal_id"))
        finding = draft(
            "https.mixed-content.v1", "https", "suggestion.manual-verification.v1",
            title=quoted("Entry page loads resources over plain HTTP"),
            summary=text("{url} refers to {active} active, {passive} passive resource(s) and {form} form target(s) over HTTP, the first being {first_resource}.",
                         active="CAST(active AS string)", passive="CAST(passive AS string)", form="CAST(form AS string)"),
            severity="'advisory'", confidence="'medium'", check_status="'warning'", first_observed_at=ctx.now, last_observed_at=ctx.now, affected_urls="array(url)",
            limitations="array('Read from the markup as served; what scripts load later was not seen.')",
            evidence_type="'text_excerpt'", evidence_source_url="url", related_observation_id="NULL",
            evidence_description=text("First resource over HTTP: {first_resource}."), evidence_content="to_json(struct(active, passive, form, hosts, first_resource))",
        )
        return findings_from(found, finding)

    return Rule("https.mixed-content.v1", "https", "The entry page refers to resources over plain HTTP.", evaluate=evaluate)
