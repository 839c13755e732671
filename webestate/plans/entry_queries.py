"""Queries over spaced attempts and over directory entries that are one portal."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webestate.operators import resolution, spacing
from webestate.operators.rules import RuleContext, run_rules
from webestate.plans import beds
from webestate.plans import rule_queries as rules
from webestate.plans.catalog import plain, query
from webestate.plans.sql_beds import B1, B2, ENTRY, PORTALS

# Spaced attempts -------------------------------------------------------------

SPACING = 1440


def runs_context(spark: SparkSession, sf: str) -> RuleContext:
    """Page checks as one run a day."""
    ctx = rules.context(spark, sf)
    return replace(ctx, pages=ctx.pages.withColumn("run_id", F.date_format("checked_at", "'run-'yyyyMMdd")), several_runs=True)


def spaced_sql(rows: str, keys: str) -> str:
    """Greedy counting as a recursive query: the next counted attempt is the first one far enough from the last."""
    same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM c.{k}" for k in keys.split(", "))
    mine = ", ".join(f"c.{k}" for k in keys.split(", "))
    return f"""chain AS (
      SELECT {keys}, min(checked_at) AS seen, 1::BIGINT AS n FROM {rows} GROUP BY {keys}
      UNION ALL
      SELECT {mine}, min(a.checked_at), c.n + 1 FROM chain c JOIN {rows} a ON {same} AND a.checked_at >= c.seen + INTERVAL {SPACING} MINUTE GROUP BY {mine}, c.n, c.seen),
    spaced AS (SELECT {keys}, max(n) AS n, min(seen) AS lo, max(seen) AS hi FROM chain GROUP BY {keys})"""


@query("ex03_spaced_attempts", f"WITH RECURSIVE {B2}, failing AS (SELECT * FROM b2 WHERE error_code IS NOT NULL), {spaced_sql('failing', 'portal_id, error_code')}"
       " SELECT portal_id, error_code, n AS spaced_n, lo::VARCHAR AS first_at, hi::VARCHAR AS last_at FROM spaced")
def ex03_spaced_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Failed checks of each portal and kind that are a day apart, from tables of each run joined together."""
    failing = beds.page_observations(spark, sf).where("error_code IS NOT NULL")
    keys = ["portal_id", "error_code"]
    return plain(spacing.count_spaced(failing, keys, "checked_at", SPACING))


RU01_SPACED = rules.RU01.replace("g WHERE n >= 3", "h WHERE n >= 3")
RU02_SPACED = rules.RU02.replace("g WHERE n >= 2", "h WHERE n >= 2")


def spaced_group(where: str) -> str:
    """The group of one rule with its spaced attempts in place of the number of rows."""
    group = rules.entry_group(where)
    return f"hits AS (SELECT * FROM entry WHERE {where}), {spaced_sql('hits', 'portal_id')}, {group}, h AS (SELECT g.* REPLACE (spaced.n AS n) FROM g JOIN spaced USING (portal_id))"


def spaced_rule(rule_id: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = run_rules(runs_context(spark, sf), [{"rule_id": rule_id, "parameters": {"minSpacingMinutes": SPACING}}])
        return plain(found, *rules.COLUMNS)

    return run


RECURSIVE = f"WITH RECURSIVE {B2}, {PORTALS}, {ENTRY}"
query("ex03_spaced_unavailable", f"{RECURSIVE}, {spaced_group(rules.FAILED)} {RU01_SPACED}")(spaced_rule("availability.unavailable.v1"))
query("ex03_spaced_server_error", f"{RECURSIVE}, {spaced_group(rules.SERVER)} {RU02_SPACED}")(spaced_rule("availability.server-error.v1"))


# Directory entries -----------------------------------------------------------


def directory_entries(spark: SparkSession, sf: str) -> DataFrame:
    """B1 as directory entries, and a second directory that lists every fourth site again: name reversed, often a word short, other address."""
    c = beds.candidates(spark, sf)
    words = F.reverse(F.split(F.coalesce("name", F.lit("")), " "))
    short = F.when(F.col("seq") % 8 == 7, F.slice(words, 2, 1000)).otherwise(words)
    host = F.regexp_replace(F.regexp_extract("raw_url", r"^https?://([^/?#:]+)", 1), r"^(?:www|m)\.", "")
    again = c.where("seq % 4 = 3").select(
        (F.col("seq") * 2 + 1).alias("entry_id"), F.lit("dir3").alias("source_id"), F.array_join(short, " ").alias("name"),
        F.concat(F.when(F.col("seq") % 3 == 0, "http://www.").otherwise("https://"), host, F.lit("/list/"), F.col("seq") % 50, F.lit("/")).alias("url"))
    return c.select((F.col("seq") * 2).alias("entry_id"), "source_id", "name", F.col("raw_url").alias("url")).unionByName(again)


CLUSTERS_SQL = rf"""WITH RECURSIVE {B1}, entries AS (
    SELECT seq * 2 AS entry_id, source_id, name, raw_url AS url FROM cand
    UNION ALL SELECT seq * 2 + 1, 'dir3', array_to_string(CASE WHEN seq % 8 = 7 THEN w[2:] ELSE w END, ' '),
        CASE WHEN seq % 3 = 0 THEN 'http://www.' ELSE 'https://' END || regexp_replace(regexp_extract(raw_url, '^https?://([^/?#:]+)', 1), '^(?:www|m)\.', '') || '/list/' || (seq % 50) || '/'
    FROM (SELECT *, list_reverse(string_split(coalesce(name, ''), ' ')) AS w FROM cand) WHERE seq % 4 = 3
), hosts AS (
    SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^(?:www[0-9]?|m|mobile)\.', '') AS stem FROM entries
), known AS (
    SELECT entry_id, source_id, stem, regexp_extract(stem, '([^.]+\.[^.]+)$', 1) AS domain,
        stem || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(?i)/(?:index\.(?:html?|php))?$', '') AS address,
        list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(name, '')), '[^a-z0-9]+'), lambda t: length(t) >= 3))) AS tokens
    FROM hosts
), prof AS (
    SELECT *, row_number() OVER () AS id FROM (SELECT DISTINCT stem, domain, tokens FROM known WHERE len(tokens) > 0 AND stem <> '')
), pairs AS (
    SELECT * FROM (
        SELECT a.id AS a, b.id AS b, len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens)))::DOUBLE
            + CASE WHEN a.stem = b.stem THEN 0.5 ELSE 0.25 END AS score
        FROM prof a JOIN prof b ON a.id < b.id AND a.domain = b.domain AND a.domain <> '') WHERE score >= 1
), links AS (
    SELECT 'e' || entry_id AS a, 'x' || address AS b FROM known WHERE address <> ''
    UNION SELECT 'e' || entry_id, 'n' || tokens::VARCHAR FROM known WHERE len(tokens) >= 3
    UNION SELECT 'e' || entry_id, 'p' || id FROM known JOIN prof USING (stem, tokens)
    UNION SELECT 'p' || a, 'p' || b FROM pairs
), ways AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
    SELECT entry_id AS start, 'e' || entry_id AS node FROM known UNION SELECT start, b FROM reach JOIN ways ON node = a
), clusters AS (
    SELECT k.entry_id, k.source_id, k.address, k.tokens, min(start) AS cluster_id FROM known k JOIN reach ON node = 'e' || k.entry_id GROUP BY ALL
)"""


@query("ex02_portal_clusters", CLUSTERS_SQL + " SELECT entry_id, source_id, cluster_id FROM clusters")
def ex02_portal_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The portal that every directory entry stands for."""
    return resolution.portal_clusters(directory_entries(spark, sf))[0].select("entry_id", "source_id", "cluster_id")


@query("ex02_duplicate_entries", CLUSTERS_SQL + """, scores AS (
    SELECT cluster_id, count(*) AS pairs, round(min(score), 6) AS weakest, round(avg(score), 6) AS mean_score
    FROM (SELECT DISTINCT cluster_id, pairs.a, pairs.b, score FROM pairs JOIN prof ON prof.id = pairs.a JOIN known USING (stem, tokens) JOIN clusters USING (entry_id)) GROUP BY cluster_id
)
SELECT cluster_id, count(*) AS entries, count(DISTINCT source_id) AS sources, count(DISTINCT address) AS addresses, count(DISTINCT tokens) AS names,
    coalesce(any_value(pairs), 0) AS pairs, any_value(weakest) AS weakest, any_value(mean_score) AS mean_score
FROM clusters LEFT JOIN scores USING (cluster_id) GROUP BY cluster_id HAVING count(*) > 1""")
def ex02_duplicate_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of several entries with their evidence."""
    return resolution.cluster_evidence(*resolution.portal_clusters(directory_entries(spark, sf)))
