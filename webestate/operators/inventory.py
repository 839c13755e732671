"""Inventory: aliases, merge of candidates into portals, back-links, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webestate.functions.checks import VERIFYING_SOURCE_TYPES
from webestate.functions.html import trim_all
from webestate.functions.urls import UrlOptions, host_of, portal_id, with_normalized_url


def union_candidates(parts: list[DataFrame]) -> DataFrame:
    """Candidates of all sources in ingest order: (source_pos, row seq) is the order."""
    out = None
    for pos, part in enumerate(parts):
        tagged = part.withColumn("source_pos", F.lit(pos))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out.withColumn("order_key", F.struct("source_pos", "seq"))


def ordered_candidates(candidates: DataFrame, sources: list[str]) -> DataFrame:
    """One table of candidates in ingest order of ``sources``; a source that is not listed comes after them."""
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source_id")).cast("int")
    tagged = candidates.withColumn("source_pos", F.when(place > 0, place - 1).otherwise(len(sources)))
    return tagged.withColumn("order_key", F.struct("source_pos", "seq"))


def alias_map(aliases: DataFrame, options: UrlOptions = UrlOptions()) -> DataFrame:
    """(from_normalized, to_normalized); the last duplicate wins, any malformed side fails the build."""
    both = with_normalized_url(with_normalized_url(aliases, "from_url", "f", options), "to_url", "t", options)
    bad = both.filter("NOT f.ok OR NOT t.ok")
    if not bad.isEmpty():
        raise ValueError("an alias has a malformed URL")
    return both.groupBy(F.col("f.normalized").alias("from_normalized")).agg(
        F.max_by("t.normalized", "seq").alias("to_normalized"))


def with_canonical(candidates: DataFrame, aliases: DataFrame, options: UrlOptions = UrlOptions(), base: str | None = None) -> DataFrame:
    """Normalise each candidate and replace aliased addresses (one hop)."""
    norm = with_normalized_url(candidates, "url", "n", options, base)
    joined = norm.join(aliases, F.col("n.normalized") == F.col("from_normalized"), "left")
    return joined.withColumn("canonical_url", F.coalesce("to_normalized", "n.normalized")).drop("from_normalized", "to_normalized")


def rejected(resolved: DataFrame) -> DataFrame:
    return resolved.filter("NOT n.ok").select(
        "source_id", "name", "url", F.concat(F.lit("URL normalization failed: "), "n.reason").alias("reason"))


def merge_candidates(resolved: DataFrame, sources: DataFrame) -> DataFrame:
    """One portal per canonical URL.

    Two steps: rows of the same (canonical, own URL, source, route) first shrink
    to one row on the map side, so the second step collects distinct variants
    only, however many listings repeat the same address.
    """
    rows = resolved.filter("n.ok").join(sources.select("source_id", "source_type", "source_url"), "source_id", "left")
    if "order_key" not in rows.columns:
        rows = rows.withColumn("order_key", F.col("seq"))
    verifying = F.coalesce(F.col("source_type").isin(*VERIFYING_SOURCE_TYPES), F.lit(False))
    has_dept = trim_all(F.coalesce("department", F.lit(""))) != ""
    key = F.col("order_key")
    variants = rows.groupBy(
        "canonical_url", "source_id", verifying.alias("verifying"), F.col("source_url").alias("from_url"), "discovery_method",
        F.col("n.normalized").alias("own_url"), F.col("n.hostname").alias("own_host"),
    ).agg(
        F.min(key).alias("first"),
        F.min_by("name", key).alias("name"),
        F.min(F.when(has_dept, F.struct(key.alias("o"), "department"))).alias("dept"),
        F.min(F.when(F.col("portal_type").isNotNull(), F.struct(key.alias("o"), "portal_type"))).alias("ptype"),
        F.array_distinct(F.flatten(F.collect_set(F.coalesce("tags", F.array().cast("array<string>"))))).alias("tags"),
    )
    item = F.struct("first", "own_url", "own_host", "source_id", "from_url", "discovery_method")
    merged = variants.groupBy("canonical_url").agg(
        F.min_by("name", F.struct(~F.col("verifying"), "first")).alias("name"),
        F.min("dept").alias("dept"), F.min("ptype").alias("ptype"),
        F.bool_or("verifying").alias("verified"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
        F.array_sort(F.collect_list(item)).alias("items"),
    )
    url = F.col("canonical_url")

    def distinct(field: str):
        return F.array_distinct(F.transform("items", lambda i: i[field]))

    return merged.select(
        portal_id(url).alias("portal_id"), "name", "canonical_url",
        F.col("dept.department").alias("department"),
        F.coalesce("ptype.portal_type", F.lit("unknown")).alias("portal_type"),
        F.when(F.col("verified"), "verified").otherwise("unverified").alias("official_status"),
        distinct("source_id").alias("source_refs"),
        F.array_union(F.array(host_of(url)), distinct("own_host")).alias("hostnames"),
        F.filter(distinct("own_url"), lambda u: u != url).alias("alternate_urls"),
        "tags",
        F.array_distinct(F.transform("items", lambda i: F.struct(i["from_url"].alias("from_url"), i["discovery_method"].alias("discovery_method")))).alias("discovery"),
    )


def back_links(resolved: DataFrame, portals: DataFrame, adapter_rejects: DataFrame | None = None) -> DataFrame:
    """Every candidate with its portal id or its reject reason, plus the adapters' rejects."""
    ids = portals.select("canonical_url", "portal_id")
    out = resolved.join(ids, "canonical_url", "left").select(
        "source_id", "name", F.col("url").alias("original_url"), F.col("n.normalized").alias("normalized_url"),
        "portal_id", F.col("n.reason").alias("rejected_reason"), "discovery_method")
    if adapter_rejects is not None:
        extra = adapter_rejects.select(
            "source_id", F.coalesce("name", F.lit("(unknown)")).alias("name"), F.coalesce("url", F.lit("(unknown)")).alias("original_url"),
            F.lit(None).cast("string").alias("normalized_url"), F.lit(None).cast("string").alias("portal_id"),
            F.col("reject_reason").alias("rejected_reason"),
            F.lit("(rejected before discovery route was recorded)").alias("discovery_method"))
        out = out.unionByName(extra)
    return out


def unmatched_sources(registry: DataFrame, inputs: DataFrame) -> DataFrame:
    """Enabled sources without input, and inputs without an enabled source."""
    idle = registry.join(inputs, "source_id", "left_anti").select("source_id", F.lit("enabled source has no input").alias("warning"))
    stray = inputs.join(registry, "source_id", "left_anti").select("source_id", F.lit("input has no enabled source, skipped").alias("warning"))
    return idle.unionByName(stray)


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1")


def inventory_issues(portals: DataFrame, sources: DataFrame) -> DataFrame:
    """Referential checks of an inventory as (code, subject) rows."""
    def row(code: str, df: DataFrame, subject: str) -> DataFrame:
        return df.select(F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject"))

    refs = portals.select("portal_id", F.explode("source_refs").alias("source_id"))
    loose = refs.join(sources.select("source_id"), "source_id", "left_anti")
    out = row("duplicate_source_id", duplicate_ids(sources, "source_id"), "source_id")
    for part in (
        row("duplicate_portal_id", duplicate_ids(portals, "portal_id"), "portal_id"),
        row("missing_discovery", portals.filter("size(discovery) = 0"), "portal_id"),
        row("missing_source_refs", portals.filter("size(source_refs) = 0"), "portal_id"),
        row("unresolved_source_ref", loose.withColumn("s", F.concat_ws(" ", "portal_id", "source_id")), "s"),
    ):
        out = out.unionByName(part)
    return out


def inventory_report_frames(portals: DataFrame, sources: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """Tables behind an inventory report: totals, sources, portals by name, rejects."""
    names = portals.select("portal_id", "canonical_url", F.posexplode("source_refs").alias("pos", "source_id")).join(
        sources.select("source_id", "source_name"), "source_id", "left")
    names = names.groupBy("portal_id", "canonical_url").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("source_name", "source_id").alias("n")))), lambda s: s["n"]), ", ").alias("sources"))
    routes = F.array_join(F.transform("discovery", lambda d: F.concat(d["discovery_method"], F.lit(" from "), d["from_url"])), "; ")
    rejects = links.filter("rejected_reason IS NOT NULL")
    portal_count = portals.agg(F.count("*").alias("n")).select(F.lit("portals").alias("item"), "n")
    source_count = sources.agg(F.count("*").alias("n")).select(F.lit("sources").alias("item"), "n")
    reject_count = rejects.agg(F.count("*").alias("n")).select(F.lit("rejected").alias("item"), "n")
    return {
        "totals": portal_count.unionByName(source_count).unionByName(reject_count),
        "sources": sources.select("source_id", "source_name", "source_type", "source_url", "retrieved_at"),
        "portals": portals.join(names, ["portal_id", "canonical_url"]).select(
            "name", "official_status", "canonical_url", "sources", routes.alias("discovery_routes")
        ).orderBy(F.collate("name", "UNICODE"), "canonical_url"),
        "rejects": rejects.select("source_id", "name", "original_url", "rejected_reason"),
    }
