"""URL filters: allow and block rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 512-bit blocks (eight longs, one bit of each set per key). It is sized by the exact number of
listed URLs and joined to the pages by block number: broadcast while its size, known beforehand, stays below
``broadcast_bytes``, as a shuffle join beyond that. Only possible hits reach the exact join with the list, which removes
the false positives.

A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule (host and path) wins,
and ``block`` wins over ``allow`` for the same rule text. Rules are matched once per distinct (host, path).

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is not listed: ``allow``. Null
hosts in rules and null URLs in the list are ignored; an empty list or rule table decides nothing. Equal rows are judged
alike and all returned; extra columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webestate.llm.lines import ascii_lower

WORDS, BITS_PER_KEY, BLOCK_BYTES = 8, 12, 88


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without a last slash, and query without ``utm_`` fields; null without ``://``. Scheme and fragment don't count."""
    query = F.regexp_extract(url, r"^(?s:.*?)://[^?#]*\?([^#]*)", 1)
    fields = F.array_join(F.filter(F.split(query, "&", -1), lambda x: ~x.startswith("utm_")), "&")
    whole = F.concat(url_host(url), F.regexp_replace(url_path(url), "/$", ""), F.when(fields != "", F.concat(F.lit("?"), fields)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, whole)


def rule_matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, rule_verdict`` for the distinct ``host, path`` of ``urls`` that a rule of ``host, path, verdict`` fits."""
    rules = rules.where(F.col("host").isNotNull()).select(
        F.col("host").alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    depth = rules.agg(F.max(F.size(F.split("r_host", r"\.", -1)))).first()[0] or 1
    labels = F.split("host", r"\.", -1)
    tails = F.transform(F.sequence(F.lit(1), F.least(F.lit(depth), F.size(labels))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    fits = (urls.select("host", "path").distinct().withColumn("tail", F.explode(tails))
            .join(rules, F.col("tail") == F.col("r_host")).where(F.col("path").startswith(F.col("r_path"))))
    best = F.max(F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule")))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def _bit(i: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("_bits", 6 * i).bitwiseAND(F.lit(63)).cast("int"))


def _placed(df: DataFrame, key: Column, blocks: int) -> DataFrame:
    return df.withColumns({"_block": F.pmod(F.xxhash64(F.lit(3), key), F.lit(blocks)), "_bits": F.xxhash64(F.lit(7), key)})


def bloom_table(keys: DataFrame, blocks: int) -> DataFrame:
    """``_b, w0 .. w7``: the blocks that hold a bit; ``keys`` has one column ``key``."""
    placed = _placed(keys, F.col("key"), blocks)
    return placed.groupBy(F.col("_block").alias("_b")).agg(*[F.bit_or(_bit(i)).alias(f"w{i}") for i in range(WORDS)])


def listed_pages(urls: DataFrame, listed: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``urls`` (with ``canon``) and ``listed``: whether ``canon`` is among the canonical URLs ``canon`` of ``listed``."""
    listed = listed.where(F.col("canon").isNotNull()).select(F.col("canon").alias("key")).distinct()
    blocks = max(1, math.ceil(listed.count() * BITS_PER_KEY / (64 * WORDS)))
    table = bloom_table(listed, blocks)
    if blocks * BLOCK_BYTES <= broadcast_bytes:
        table = F.broadcast(table)
    probed = _placed(urls, F.col("canon"), blocks).join(table, F.col("_block") == F.col("_b"), "left")
    possible = F.col("canon").isNotNull()
    for i in range(WORDS):
        possible = possible & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(_bit(i)) != 0)
    probed = probed.select(*urls.columns, possible.alias("_possible"))
    hits = probed.where("_possible").join(listed, F.col("canon") == F.col("key"), "left")
    return (probed.where(~F.col("_possible")).select(*urls.columns, F.lit(False).alias("listed"))
            .unionByName(hits.select(*urls.columns, F.col("key").isNotNull().alias("listed"))))


def judge_pages(pages: DataFrame, rules: DataFrame, listed: DataFrame, **options) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, listed``."""
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), canonical(F.col("url")).alias("canon"))
    ruled = rule_matches(urls, rules)
    judged = listed_pages(urls, listed, **options).join(
        ruled.withColumnsRenamed({"host": "_h", "path": "_p"}), (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "listed")
