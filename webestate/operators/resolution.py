"""Directory entries that are one portal: blocking, scored pairs, clusters with evidence.

Entries agree by their address (host without ``www.`` or ``m.``, and path), by an equal name of some words, or by a scored
pair: the overlap of their name tokens (Jaccard) plus ``STEM_BONUS`` on the same host stem or ``DOMAIN_BONUS`` on the same
registered domain, at least 1. All entries of one name are one node of the graph (of a short name, those of one host stem; without a
name, those of one address), and nodes that share an address are linked to the least of them, so the graph holds only names that meet others.
Pairs are formed between distinct
(host stem, name) profiles only, and only where they share one of their rarest tokens: with an overlap of ``t`` or more,
two token sets share a token among the ``n - ceil(t n) + 1`` rarest of each, so nothing is missed. Blocks of more
than ``BLOCK`` profiles are cut into tiles; only links leave a tile.

Cases: an entry without a usable address or name agrees with nothing by it. Entries of equal ``entry_id`` are one; those without are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webestate.functions.text import name_tokens
from webestate.functions.urls import host_of
from webestate.operators.graph import components
from webestate.session import materialise

STEM_BONUS, DOMAIN_BONUS = 0.5, 0.25
#: Words of a name that alone says that two entries are one.
NAME_WORDS = 3
BLOCK = 1000


def host_stem(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^(?:www\d?|m|mobile)\.", "")


def address_key(url: Column) -> Column:
    """Host stem and path of a URL, without scheme, case of the host, default page, closing slash, query and fragment."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"(?i)/(?:index\.(?:html?|php))?$", "")
    return F.concat(host_stem(host_of(url)), path)


def profiles(entries: DataFrame) -> DataFrame:
    """``entry_id, source_id, address, stem, domain, tokens``."""
    tokens = F.array_sort(F.coalesce(name_tokens(F.col("name")), F.array().cast("array<string>")))
    stem = host_stem(host_of(F.col("url")))
    return entries.select("entry_id", "source_id", address_key(F.col("url")).alias("address"), stem.alias("stem"),
                          F.regexp_extract(stem, r"([^.]+\.[^.]+)$", 1).alias("domain"), tokens.alias("tokens"))


def _id(kind: str, *cols: Column | str) -> Column:
    """A digest that names something of this kind."""
    return F.unhex(F.md5(F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"{kind}{i}") for i, c in enumerate(cols)]))))


def _node(tokens: Column, profile: Column) -> Column:
    """The node of a profile: its name alone, if that is enough."""
    return F.when(F.size(tokens) >= NAME_WORDS, _id("n", tokens)).otherwise(profile)


def _met(rows: DataFrame) -> DataFrame:
    """``a, b``: the nodes of each key (``key, node``) linked to the least of them. Keys of one node, most of them, go no further than counting."""
    least = rows.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").select("key", "b")
    return rows.join(materialise(least, "shared"), "key").where("node > b").select(F.col("node").alias("a"), "b")


def scored_pairs(named: DataFrame) -> DataFrame:
    """``a, b, score, a_node, b_node``: linked pairs of distinct ``profile, stem, domain, tokens`` rows, and their nodes."""
    frequency = named.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    spread = named.select("profile", F.explode("tokens").alias("token")).join(frequency, "token")
    rarest = spread.groupBy("profile").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("ranked"))
    ranked = named.join(rarest, "profile").withColumn("n", F.size("ranked"))

    def prefix(least: float) -> Column:
        return F.slice("ranked", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))

    keyed = []
    for scope, bonus in (("stem", STEM_BONUS), ("domain", DOMAIN_BONUS)):
        keyed.append(ranked.where(F.col(scope) != "").select("profile", "stem", "tokens", "n", F.lit(scope).alias("scope"), F.lit(bonus).alias("bonus"), F.col(scope).alias("place"),
                                                             prefix(1 - bonus).alias("prefix")).withColumn("token", F.explode("prefix")))
    rows = materialise(keyed[0].unionByName(keyed[1]), "blocks")
    block = ["scope", "place", "token"]
    tiles = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(*block, F.ceil(F.col("rows") / BLOCK).cast("int").alias("tiles"))
    dealt = rows.join(tiles, block).withColumn("own", F.pmod(F.xxhash64("profile"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    left = dealt.select(*block, "bonus", "profile", "stem", "tokens", "prefix", "n", F.col("own").alias("i"), F.col("other").alias("j"))
    right = dealt.select(*block, *[F.col(c).alias(f"{c}_b") for c in ("profile", "stem", "tokens", "prefix", "n")], F.col("other").alias("i"), F.col("own").alias("j"))
    shared = F.size(F.array_intersect("tokens", "tokens_b"))
    overlap = shared / (F.col("n") + F.col("n_b") - shared)
    once = F.get(F.array_intersect("prefix", "prefix_b"), F.lit(0)) == F.col("token")  # a pair counts in the block of its rarest common token
    apart = (F.col("scope") == "stem") | (F.col("stem") != F.col("stem_b"))
    near = F.least("n", "n_b") >= (1 - F.col("bonus")) * F.greatest("n", "n_b")
    met = left.join(right, [*block, "i", "j"]).where((F.col("profile") < F.col("profile_b")) & near & apart & once)
    scored = met.withColumn("score", overlap + F.col("bonus")).where("score >= 1")
    nodes = [_node(F.col(f"tokens{side}"), F.col(f"profile{side}").cast("binary")).alias(name) for side, name in (("", "a_node"), ("_b", "b_node"))]
    return scored.select(F.col("profile").alias("a"), F.col("profile_b").alias("b"), "score", *nodes)


def portal_clusters(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters of ``entries`` (``entry_id, source_id, name, url``).

    First ``entry_id, source_id, address, tokens, cluster_id``: every entry, a cluster being its smallest entry id. Then the
    linked pairs of profiles, ``cluster_id, a, b, score``.
    """
    profile = F.when((F.size("tokens") > 0) & (F.col("stem") != ""), _id("c", "stem", "tokens"))
    alone = F.when(F.col("address") != "", _id("x", "address")).otherwise(_id("e", "entry_id"))
    known = profiles(entries).where("entry_id IS NOT NULL").withColumn("profile", profile)
    known = materialise(known.withColumn("node", F.coalesce(_node(F.col("tokens"), F.col("profile")), alone)), "profiles")
    named = known.where("profile IS NOT NULL").select("profile", "stem", "domain", "tokens").distinct()
    pairs = materialise(scored_pairs(named), "pairs")
    edges = pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    for key in (F.when(F.col("address") != "", _id("x", "address")), F.col("entry_id")):
        edges = edges.unionByName(_met(known.select(key.alias("key"), "node").where("key IS NOT NULL")))
    found = components(edges)
    nodes = known.groupBy("node").agg(F.min("entry_id").alias("least")).join(found, "node", "left").withColumn("label", F.coalesce("component", "node"))
    nodes = materialise(nodes.select("node", "label", "least"), "nodes")
    clusters = nodes.groupBy("label").agg(F.min("least").alias("cluster_id"))
    labels = materialise(nodes.join(clusters, "label").select("node", "cluster_id"), "clusters")
    clustered = known.join(labels, "node").select("entry_id", "source_id", "address", "tokens", "cluster_id")
    linked = pairs.join(labels.withColumnRenamed("node", "a_node"), "a_node")
    text = [F.concat(F.lit("p"), F.lower(F.hex(c))).alias(c) for c in ("a", "b")]
    return clustered, linked.select("cluster_id", *text, "score")


def cluster_evidence(clustered: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clusters of several entries: how many entries, sources, addresses, names and scored pairs they hold, and the weakest and mean score."""
    def distinct(c: str, name: str) -> DataFrame:
        return clustered.select("cluster_id", c).where(F.col(c).isNotNull()).distinct().groupBy("cluster_id").agg(F.count(F.lit(1)).alias(name))

    size = materialise(clustered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1"), "sizes")
    clustered = materialise(clustered.join(size.select("cluster_id"), "cluster_id", "left_semi"), "clustered")
    scores = pairs.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.min("score"), 6).alias("weakest"), F.round(F.avg("score"), 6).alias("mean_score"))
    out = size
    for part in (distinct("source_id", "sources"), distinct("address", "addresses"), distinct("tokens", "names"), scores):
        out = out.join(part, "cluster_id", "left")
    return out.fillna({"sources": 0, "addresses": 0, "names": 0, "pairs": 0})
