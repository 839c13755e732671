"""Table jobs: computed columns plus the aggregate each job is for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webestate.functions import checks, html, text, urls


def canonical_urls(df: DataFrame, column: str, options: urls.UrlOptions = urls.UrlOptions()) -> DataFrame:
    out = urls.with_normalized_url(df, column, "n", options)
    return out.select(
        *df.columns, F.col("n.normalized").alias("normalized"), F.col("n.hostname").alias("host"),
        F.when(F.col("n.ok"), urls.portal_id(F.col("n.normalized"))).alias("site_id"), F.col("n.reason").alias("reject_reason"),
    )


def url_clusters(canonical: DataFrame, column: str) -> DataFrame:
    """Rows that share a canonical URL: size and number of different spellings."""
    return canonical.filter("normalized IS NOT NULL").groupBy("normalized").agg(
        F.count("*").alias("rows"), F.count_distinct(column).alias("variants"))


def url_rejects(canonical: DataFrame) -> DataFrame:
    return canonical.filter("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count("*").alias("rows"))


def scope_decisions(df: DataFrame, column: str, hostnames: str, policy: urls.CrawlPolicy) -> DataFrame:
    """In or out of scope, with the first reason; unusable URLs are out with their own reason."""
    out = urls.with_normalized_url(df, column, "n", policy.url_options)
    reason = f"coalesce(n.reason, {urls.scope_reason('n.normalized', 'n.hostname', hostnames, policy)})"
    return out.withColumn("scope_reason", F.expr(reason)).withColumn("in_scope", F.col("scope_reason").isNull())


def scope_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy(F.col("n.hostname").alias("host"), "scope_reason").agg(F.count("*").alias("rows"))


def classify_checks(df: DataFrame) -> DataFrame:
    """Error code of a raw result: HTTP status first, then the network code."""
    code = F.coalesce(
        checks.classify_http_status(F.col("http_status")),
        F.when(F.col("network_code").isNotNull(), checks.classify_network_code(F.col("network_code"))),
    )
    return df.withColumn("error_class", code).withColumn("is_html", checks.is_html_content_type(F.col("content_type")))


def error_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("portal_id", F.coalesce("error_class", F.lit("OK")).alias("error_class"), F.to_date("checked_at").cast("string").alias("day")).agg(
        F.count("*").alias("rows"), F.count_if("is_html").alias("html_rows"))


def page_access(df: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """Access class of a page: login wall, automation block or empty shell, else open."""
    # Text and mount point come from one evaluation of the visible markup.
    seen = html.bound(html.visible_markup(F.col(body)), lambda m: F.struct(F.length(html.markup_text(m)).alias("text_length"), html.app_root(m).alias("app_root")))
    page = df.withColumn("links", F.size(html.raw_hrefs(F.col(body)))).withColumn("__seen", seen)
    page = page.withColumns({"text_length": F.col("__seen.text_length"), "app_root": F.col("__seen.app_root")}).drop("__seen")
    page = page.withColumn("auth_reason", html.auth_wall_reason(F.col(body), F.col(url))).withColumn("block_reason", html.block_reason(F.col(body)))
    shell = html.empty_shell(F.col("text_length"), F.col("links"), F.col("app_root"))
    return page.withColumn(
        "access", F.when(F.col("auth_reason").isNotNull(), "login_wall").when(F.col("block_reason").isNotNull(), "automation_block")
        .when(shell, "empty_shell").otherwise("open"))


def access_share(pages: DataFrame, url: str = "url") -> DataFrame:
    per = pages.groupBy(urls.host_of(F.col(url)).alias("host")).agg(
        F.count("*").alias("pages"), *(F.count_if(F.col("access") == a).alias(a) for a in ("login_wall", "automation_block", "empty_shell")))
    closed = F.col("login_wall") + F.col("automation_block") + F.col("empty_shell")
    return per.withColumn("closed_share", F.round(closed / F.col("pages"), 6))


def page_metadata(df: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """Title, canonical address, language and body digest of each page."""
    out = df.withColumns({
        "title": html.page_title(F.col(body)), "language": html.language(F.col(body)), "digest": html.content_digest(F.col(body)),
        "__base": html.base_href(F.col(body)), "__canon": html.canonical_href(F.col(body)),
    })
    out = urls.with_resolved_url(out, "__base", url, "__resolved_base")
    out = out.withColumn("__effective", F.coalesce("__resolved_base", F.col(url)))
    out = urls.with_resolved_url(out, "__canon", "__effective", "canonical")
    return out.drop("__base", "__canon", "__resolved_base", "__effective")


def identical_bodies(df: DataFrame, digest: str, key: str) -> DataFrame:
    """Groups of more than one row with the same digest: size and first key, never the members."""
    return df.groupBy(digest).agg(F.count("*").alias("copies"), F.min(key).alias("first_key")).filter("copies > 1")


def personal_data(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("flags", text.privacy_flags(F.col(column))).withColumn("clean_text", text.normalize_bounded_text(F.col(column)))


def flag_counts(flagged: DataFrame, *dims: str) -> DataFrame:
    # The outer form keeps the optimizer from testing the array, and so computing it, twice.
    flat = flagged.select(*dims, F.explode_outer("flags").alias("flag")).filter("flag IS NOT NULL")
    return flat.groupBy(*dims, "flag").agg(F.count("*").alias("rows"))


def narrative_clusters(df: DataFrame, order: str | F.Column, **parts) -> DataFrame:
    """Reports with the same comparison key: cluster size and first row.

    The key travels as a digest, so that long texts are not shuffled.
    """
    key = text.duplicate_key(parts["description"], parts["themes"], parts["occurred_on"], parts["free_text"])
    return df.withColumn("cluster_id", F.sha2(key, 256)).groupBy("cluster_id").agg(
        F.count("*").alias("reports"), F.min(order).alias("first"))


def pseudonymised_activity(df: DataFrame, secret: str, address: str, at: str) -> DataFrame:
    """Counts per keyed hash and day; the raw address is dropped in the same projection."""
    hashed = df.select(text.keyed_hash(secret, F.col(address)).alias("keyed_hash"), F.to_date(at).cast("string").alias("day"))
    return hashed.groupBy("keyed_hash", "day").agg(F.count("*").alias("requests"))


def match_ranges(addresses: DataFrame, ranges: DataFrame, lengths: list[int]) -> DataFrame:
    """Longest containing range of each IPv4 address.

    Each address is looked up once per prefix length in use with an equality join
    on (length, network), which hashes and spreads whatever the size of the range
    table; there is no pairwise comparison.
    """
    number = checks.ipv4_number(F.col("ip"))
    probes = addresses.withColumn("number", number).withColumn("bits", F.explode(F.array(*(F.lit(n) for n in lengths))))
    step = F.pow(F.lit(2), 32 - F.col("bits")).cast("bigint")
    probes = probes.withColumn("network", (F.floor(F.col("number") / step) * step).cast("bigint"))
    hits = probes.join(ranges, ["bits", "network"])
    return hits.groupBy(*addresses.columns).agg(F.max_by("range", "bits").alias("range"))
