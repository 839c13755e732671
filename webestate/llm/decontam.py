"""Benchmark decontamination by the pigeonhole rule.

Text and items are compared lower-cased with runs of white space as one blank. An item of m characters may occur with up
to k = ``share`` * m edits. Cut into k + 1 pieces, at least one piece must then occur unchanged, so an automaton over all
pieces finds every candidate place, and Myers' bit-parallel distance (free start and end in the text) verifies the
window around it. Candidate windows of an item that overlap are verified as one, so the work stays linear in the text.

Items of up to ``shard_chars`` characters travel with the tasks. More items are dealt into shards and distinct texts into
groups of bounded size, and every group meets every shard in a task of its own; no item passes the driver then.

Cases: null or blank items match nothing; a null or empty text is clean; an item shorter than 1 / ``share`` must occur
exactly. Rows with equal ids are judged each by its own text; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webestate.llm.common import wide_hash, wrapped
from webestate.session import materialise

HIT = "array<struct<item_id: bigint, distance: int>>"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def myers(pattern: str, text: str) -> int:
    """Smallest edit distance between ``pattern`` and any substring of ``text``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    every, last = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    up, down, score, best = every, 0, len(pattern), len(pattern)
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        grow = down | (every & ~(horizontal | up))
        fall = up & horizontal
        if grow & last:
            score += 1
        elif fall & last:
            score -= 1
            best = min(best, score)
        grow = (grow << 1) & every
        up = ((fall << 1) & every) | (every & ~(vertical | grow))
        down = grow & vertical
    return best


class Finder:
    """All items of one shard: the automaton of their pieces and the verification."""

    def __init__(self, items: tuple[tuple[int, str], ...], share: float) -> None:
        self.items = [(i, t, int(len(t) * share)) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget) in enumerate(self.items):
            cuts = [len(text) * j // (budget + 1) for j in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def hits(self, text: str | None) -> list[dict]:
        if self.empty or not text:
            return []
        text = normal(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, at in places:
                _, item, budget = self.items[n]
                start = end - size + 1 - at
                low, high = max(0, start - budget), start + len(item) + budget
                own = windows.setdefault(n, [])
                if own and low <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], low), max(own[-1][1], high)
                else:
                    own.append([low, high])
        found = []
        for n, own in windows.items():
            name, item, budget = self.items[n]
            best = budget + 1
            for low, high in own:
                best = 0 if text.find(item, low, high) >= 0 else min(best, myers(item, text[low:high]))
                if best == 0:
                    break
            if best <= budget:
                found.append({"item_id": name, "distance": best})
        return sorted(found, key=lambda x: (x["item_id"] is None, x["item_id"]))


@lru_cache(maxsize=4)
def _finder(items: tuple[tuple[int, str], ...], share: float) -> Finder:
    return Finder(items, share)


def _scan(items: tuple[tuple[int, str], ...], share: float):
    @F.pandas_udf(HIT)
    def scan(texts: pd.Series) -> pd.Series:
        finder = _finder(items, share)
        return pd.Series([finder.hits(t) for t in texts], dtype=object)

    return scan


def _named(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.col("text").isNotNull())


def _known(rows: Iterable[tuple[int | None, str]]) -> tuple[tuple[int | None, str], ...]:
    return tuple(sorted({(i, t) for i, text in rows if (t := normal(text))}, key=str))


def benchmark_hits(docs: DataFrame, items: DataFrame, share: float = 0.08, shard_chars: int = 4_000_000) -> Column:
    """A column over ``docs.text``: the items found, with their distance. All items pass the driver, shard by shard: meant for one shard or few."""
    items = _named(items)
    shards = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / shard_chars))
    columns = []
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).collect()
        columns.append(_scan(_known((r["item_id"], r["text"]) for r in part), share)(F.col("text")))
    return columns[0] if len(columns) == 1 else F.concat(*columns)


def _scan_groups(texts: DataFrame, items: DataFrame, share: float, shards: int, group_bytes: int = 16 << 20) -> DataFrame:
    """``h1, h2, hits`` of texts (``h1, h2, text``) against items that are too many for one task.

    Items are dealt into ``shards`` and texts into groups of about ``group_bytes``; every group meets every shard in a task of its own. Nothing
    passes the driver.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(total / group_bytes))
    left = texts.select("h1", "h2", "text", F.pmod("h1", F.lit(groups)).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("group"))

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        finder = _finder(_known(zip(known.column("item_id").to_pylist(), known.column("text").to_pylist(), strict=True)), share)
        hits = [finder.hits(t) for t in docs.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
        return pa.Table.from_arrays([docs.column("h1"), docs.column("h2"), pa.array(hits, kind)], names=["h1", "h2", "hits"])

    found = left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInArrow(run, f"h1 bigint, h2 bigint, hits {HIT}")
    return found.where(F.size("hits") > 0).groupBy("h1", "h2").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))


def with_hits(docs: DataFrame, items: DataFrame, share: float = 0.08, shard_chars: int = 4_000_000) -> DataFrame:
    """``docs`` with ``_hits``: the items found in ``text``, with their distance. ``items`` has ``item_id`` and ``text``.

    Items of at most ``shard_chars`` characters travel to every task; beyond that, distinct texts and shards of items meet in groups.
    """
    items = _named(items)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if total <= shard_chars:
        return docs.withColumn("_hits", benchmark_hits(docs, items, share, shard_chars))
    keyed = materialise(docs.withColumns(dict(zip(("_h1", "_h2"), wide_hash("text"), strict=True))), "keyed")
    texts = keyed.where("text IS NOT NULL").groupBy(F.col("_h1").alias("h1"), F.col("_h2").alias("h2")).agg(F.first("text").alias("text"))
    found = _scan_groups(texts, items, share, math.ceil(total / shard_chars))
    same = (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2"))
    return keyed.join(found, same, "left").withColumn("_hits", F.coalesce("hits", F.array().cast(HIT))).drop("_h1", "_h2", "h1", "h2", "hits")


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold an item."""
    kept = with_hits(wrapped(docs, "text"), items, **options).where(F.size("_hits") == 0)
    return kept.select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def contamination_digest(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, contaminated, n_items, item_ids, distances``."""
    docs = docs.select("doc_id", "text")
    found = with_hits(docs, items, **options).select("doc_id", F.col("_hits").alias("hits"))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").alias("n_items"),
                        F.col("hits.item_id").alias("item_ids"), F.col("hits.distance").alias("distances"))
