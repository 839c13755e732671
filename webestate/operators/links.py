"""Link graph and crawl-result jobs over tables of collected pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webestate.functions import html, urls
from webestate.session import materialise


def extract_links(
    pages: DataFrame, url: str = "url", body: str = "html", key: str = "page_id", keep_empty: bool = False
) -> DataFrame:
    """One row per anchor: raw href, resolved URL, anchor text and its neighbouring text.

    The markup is cut in front of every anchor; a piece then holds one anchor and
    what follows it. Context is the text next to the anchor up to the nearest tags,
    which is the whole parent text where the parent has no other element.
    """
    quiet = rf"regexp_replace({body}, r'(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->', '')"
    pages = pages.select(key, url, F.expr(rf"split({quiet}, r'(?i)(?=<a[\s>])')").alias("pieces"), html.base_href(F.col(body)).alias("base_raw"))
    pages = urls.once(pages, "base_url", f"coalesce({urls.resolved_sql('base_raw', url)}, {url})")
    pages = urls.once(pages, "base", urls.parts_sql("base_url"))
    # One row per anchor first, then plain columns over its short text.
    cut = "named_struct('piece', piece, 'prior', CASE WHEN i > 0 THEN substring_index(pieces[i - 1], '>', -1) ELSE '' END)"
    rows = pages.select(key, url, "base", F.expr(f"posexplode(transform(pieces, (piece, i) -> {cut}))").alias("pos", "cut"))
    rows = rows.select(key, url, "base", "pos", "cut.prior", "cut.piece", F.expr(f"regexp_extract(cut.piece, {html.ANCHOR_HREF_SQL}, 0)").alias("tag")).filter("tag <> ''")
    href = " || ".join(f"regexp_extract(tag, {html.ANCHOR_HREF_SQL}, {i})" for i in (1, 2, 3))
    rows = urls.once(rows, "raw_href", html.trimmed_sql(html.decoded_sql(f"({href})")))
    if not keep_empty:
        rows = rows.filter("raw_href <> ''")
    rows = rows.select("*", F.expr(r"regexp_extract(piece, r'(?is)^<a[^>]*>(.*?)(?:</a\s*>|\z)', 1)").alias("inner"),
                       F.expr(r"regexp_extract(piece, r'(?is)</a\s*>([^<]*)', 1)").alias("after"))
    resolved = urls.resolved_against_sql("nullif(raw_href, '')", "base")
    fields = f"named_struct('anchor_text', {html.short_text_sql('inner')}, 'context', {html.short_text_sql('concat(prior, inner, after)')}, 'resolved_url', {resolved})"
    return urls.once(rows, "anchor", fields).select(key, url, "pos", "raw_href", "anchor.*")


def prepare_links(links: DataFrame, policy: urls.CrawlPolicy) -> DataFrame:
    """Normalised destination, its host and the exclusion flag; links without a resolved URL are dropped."""
    def listed(values: tuple[str, ...]) -> str:
        return ", ".join(f"'{v}'" for v in values)

    scheme = r"lower(regexp_extract(resolved_url, r'^([A-Za-z][A-Za-z0-9+.\-]*):', 1))"
    excluded = (
        f"{scheme} IN ({listed(policy.excluded_schemes)}) OR {scheme} NOT IN ({listed(policy.allowed_schemes)}) OR NOT t.ok "
        f"OR {urls.scope_reason('t.normalized', 't.hostname', 'array(t.hostname)', policy)} IS NOT NULL"
    )
    judged = urls.bind("t", urls.normalized_sql("resolved_url", policy.url_options), (
        f"named_struct('destination', coalesce(t.normalized, resolved_url), 'destination_host', coalesce(t.hostname, ''), 'excluded', {excluded})"))
    return urls.once(links.filter("resolved_url IS NOT NULL"), "judged", judged).select("*", "judged.*").drop("judged")


def relationship(host: str, hostnames: str) -> Column:
    return F.expr(f"if({urls.host_in_scope(host, hostnames)}, 'internal', 'external')")


def unique_destinations(prepared: DataFrame) -> DataFrame:
    return prepared.filter("NOT excluded").select("destination").distinct()


def fan_out(prepared: DataFrame, results: DataFrame) -> DataFrame:
    """Give every occurrence the result of its destination; excluded ones get a fixed result.

    A hot destination is on the streamed side, which AQE may split; the result
    side has one row per destination.
    """
    out = F.col("excluded")
    return prepared.join(results, "destination", "left").withColumns({
        "status": F.when(out, "not_applicable").otherwise(F.col("status")),
        "http_status": F.when(~out, F.col("http_status")),
        "error_code": F.when(out, "SCOPE_EXCLUDED").otherwise(F.col("error_code")),
        "attempts": F.when(out, 0).otherwise(F.col("attempts"))})


def reconcile_probes(probes: DataFrame) -> DataFrame:
    """Final result per destination from its HEAD row and, for 405/501, its GET row."""
    def side(method: str, name: str) -> Column:
        return F.max(F.when(F.col("method") == method, F.struct("ok", "http_status", "error_code", "attempts"))).alias(name)

    both = probes.groupBy("destination").agg(side("HEAD", "h"), side("GET", "g"))
    retry = ~F.col("h.ok") & F.coalesce(F.col("h.http_status").isin(405, 501), F.lit(False)) & F.col("g").isNotNull()
    ok = F.when(retry, F.col("g.ok")).otherwise(F.col("h.ok"))
    return both.filter("h IS NOT NULL").select(
        "destination", F.when(ok, "pass").otherwise("fail").alias("status"),
        F.when(retry, F.col("g.http_status")).otherwise(F.col("h.http_status")).alias("http_status"),
        F.when(~ok, F.when(retry, F.col("g.error_code")).otherwise(F.col("h.error_code"))).alias("error_code"),
        F.when(retry, F.col("h.attempts") + F.col("g.attempts")).otherwise(F.col("h.attempts")).alias("attempts"))


def number_rows(df: DataFrame, key: str, block: Column, order: list[Column | str], out: str = "sequence") -> DataFrame:
    """1-based sequence per key in (block, order) order.

    ``block`` must rise with the order. Rows are numbered inside (key, block) and
    shifted by the number of rows in earlier blocks, so a hot key is spread over
    its blocks and only block counts are summed per key.
    """
    tagged = df.withColumn("__block", block)
    sizes = tagged.groupBy(key, "__block").agg(F.count("*").alias("__n"))
    before = W.partitionBy(key).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(key, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    numbered = tagged.withColumn("__rn", F.row_number().over(W.partitionBy(key, "__block").orderBy(*order)))
    return numbered.join(offsets, [key, "__block"]).withColumn(out, F.col("__rn") + F.col("__offset")).drop("__block", "__rn", "__offset")


# Robots ------------------------------------------------------------------------


def robots_rules(texts: DataFrame, key: str = "host") -> DataFrame:
    """(key, agent, type, pattern, pos) rows. Windows run per robots text, which the fetch limit bounds."""
    lines = texts.select(key, F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", html.trim_all(F.regexp_replace("line", r"#.*$", ""))).filter(F.col("line").contains(":"))
    lines = lines.select(
        key, "line_no", F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))).alias("field"),
        F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"),
    ).filter(F.col("field").isin("user-agent", "allow", "disallow"))
    by_line = W.partitionBy(key).orderBy("line_no")
    is_agent = F.col("field") == "user-agent"
    starts = is_agent & (F.coalesce(F.lag("field").over(by_line), F.lit("")) != "user-agent")
    grouped = lines.withColumn("starts", starts.cast("int")).withColumn("grp", F.sum("starts").over(by_line)).filter("grp > 0")
    agents = grouped.filter(is_agent).groupBy(key, "grp", F.lower("value").alias("agent")).agg(F.min("line_no").alias("agent_line"))
    rules = grouped.filter(~is_agent).select(key, "grp", F.col("field").alias("type"), F.col("value").alias("pattern"), F.col("line_no").alias("pos"))
    return agents.join(rules, [key, "grp"], "left").select(key, "agent", "agent_line", "type", "pattern", "pos")


def robots_regex(pattern: Column) -> Column:
    """Anchored regex of a robots pattern: '*' is any run, a final '$' anchors the end."""
    body = F.regexp_replace(pattern, r"\$$", "")
    escaped = F.regexp_replace(F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("^"), escaped, F.when(pattern.endswith("$"), "$").otherwise(""))


def robots_groups(rules: DataFrame, user_agent: str, key: str = "host") -> DataFrame:
    """Rules of the group that speaks for the user agent, as one array per key."""
    named = (F.col("agent") != "*") & F.contains(F.lit(user_agent.lower()), F.col("agent"))
    agent_order = F.min("agent_line").over(W.partitionBy(key, "agent"))
    ranked = rules.withColumn("__first", agent_order).withColumn(
        "__choice", F.when(named, F.struct(F.lit(0).alias("k"), F.col("__first").alias("l")))
        .when(F.col("agent") == "*", F.struct(F.lit(1).alias("k"), F.lit(0).alias("l"))))
    best = ranked.groupBy(key).agg(F.min_by("agent", "__choice").alias("agent"))
    # Most patterns are plain prefixes; only the others need a regex.
    plain = ~F.col("pattern").contains("*") & ~F.col("pattern").endswith("$")
    item = F.struct("pos", "type", "pattern", F.when(~plain, robots_regex(F.col("pattern"))).alias("regex"))
    usable = F.col("type").isNotNull() & (F.col("pattern") != "")
    return rules.join(best, [key, "agent"]).groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(usable, item))).alias("rules"))


def robots_decisions(pages: DataFrame, groups: DataFrame, path: str = "path", key: str = "host") -> DataFrame:
    """Longest matching rule decides, first on ties; no rule allows.

    The rules of a site come as one array, so a page row is never multiplied by
    the number of rules. Each distinct (site, path) is decided once.
    """
    joined = pages.select(key, path).distinct().join(groups, key, "left")
    hits = F.filter(F.coalesce("rules", F.expr("CAST(array() AS array<struct<pos:int,type:string,pattern:string,regex:string>>)")),
                    lambda r: F.when(r["regex"].isNull(), F.startswith(F.col(path), r["pattern"])).otherwise(F.rlike(F.col(path), r["regex"])))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["pattern"]).alias("n"), (-r["pos"]).alias("p"), r["type"].alias("type"))))
    decided = joined.select(F.col(key).alias("__key"), F.col(path).alias("__path"), F.coalesce(best["type"] == "allow", F.lit(True)).alias("allowed"))
    return pages.join(decided, F.col(key).eqNullSafe(F.col("__key")) & F.col(path).eqNullSafe(F.col("__path"))).drop("__key", "__path")


# Bounded frontier ----------------------------------------------------------------


def visit_plan(seeds: DataFrame, edges: DataFrame, robots_blocked: Column, policy: urls.CrawlPolicy) -> DataFrame:
    """Breadth-first visit plan per portal: (portal_id, url, depth, order, outcome).

    A queue is first in, first out, so it visits level by level; inside a level
    the order is (parent's order, link position). One join round per level, each
    written to the shared folder. ``robots_blocked`` is a condition over ``url``.
    The page cap is applied by keeping the first N allowed addresses per portal
    and comparing the rest with the last one kept.
    """
    level = seeds.select("portal_id", F.posexplode("seed_urls").alias("link", "raw"), F.lit(0).alias("parent"))
    level = level.select("portal_id", "raw", F.struct("parent", F.col("link").cast("string").alias("link")).alias("place"))
    hosts = seeds.select("portal_id", "hostnames")
    outgoing = edges.select("portal_id", "from_url", F.col("to_url").alias("raw"), "pos")
    done: DataFrame | None = None
    for depth in range(policy.max_depth + 1):
        fresh = urls.with_normalized_url(level, "raw", "n", policy.url_options)
        first = fresh.groupBy("portal_id", F.coalesce("n.normalized", "raw").alias("url"), F.col("n.hostname").alias("host"), F.col("n.reason").alias("bad")).agg(
            F.min("place").alias("place"))
        if done is not None:
            first = first.join(done.select("portal_id", "url"), ["portal_id", "url"], "left_anti")
        first = first.join(hosts, "portal_id")
        reason = f"coalesce(concat('malformed URL: ', bad), {urls.scope_reason('url', 'host', 'hostnames', policy)})"
        first = first.withColumn("reason", F.expr(reason)).withColumn("blocked", robots_blocked)
        used = (
            hosts.select("portal_id").withColumn("used", F.lit(0).cast("bigint")) if done is None
            else hosts.select("portal_id").join(
                done.filter("outcome = 'visit'").groupBy("portal_id").agg(F.count("*").alias("used")), "portal_id", "left").fillna({"used": 0})
        )
        first = first.join(used, "portal_id")
        allowed = first.filter("reason IS NULL AND NOT blocked")
        rank = F.row_number().over(W.partitionBy("portal_id").orderBy("place", "url"))
        kept = allowed.withColumn("order", rank).filter(F.col("order") <= policy.max_pages).filter(F.col("order") <= policy.max_pages - F.col("used"))
        kept = kept.select("portal_id", "url", "order")
        # The address that fills the cap: later ones were not visited because of it.
        last = kept.join(first.select("portal_id", "url", "place", "used"), ["portal_id", "url"]).groupBy("portal_id").agg(
            F.max(F.struct("place", "url")).alias("last"), (F.max("order") + F.max("used")).alias("filled"))
        judged = first.join(kept, ["portal_id", "url"], "left").join(last, "portal_id", "left")
        full = F.coalesce(
            (F.col("filled") >= policy.max_pages) & (F.struct("place", "url") > F.col("last")), F.col("used") >= policy.max_pages)
        outcome = (
            F.when(F.col("reason").isNotNull(), F.col("reason"))
            .when(F.col("order").isNotNull(), "visit")
            .when(full, "maxPagesPerPortal reached")
            .otherwise("robots_disallowed"))
        step = materialise(judged.select("portal_id", "url", F.lit(depth).alias("depth"), F.col("order").cast("int").alias("order"), outcome.alias("outcome")), f"frontier-{depth}")
        done = step if done is None else done.unionByName(step)
        if depth == policy.max_depth:
            break
        parents = step.filter("outcome = 'visit'").select("portal_id", F.col("url").alias("from_url"), F.col("order").alias("parent"))
        level = outgoing.join(parents, ["portal_id", "from_url"]).select("portal_id", "raw", F.struct("parent", F.col("pos").alias("link")).alias("place"))
    return done
