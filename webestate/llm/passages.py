"""Substring dedup on words: passages that a document with a smaller id holds too are removed.

A passage is ``span`` (13) consecutive words. Anchors are the hashes of 7 words at positions whose remainder by 7 is in
{0, 1, 3}, a difference cover: two equal passages, wherever they stand, have an anchor at the same offset, and it lies
inside. Anchors are asked about first (does another document hold it?). Around shared anchors a match is extended to
all passages that contain the anchor; their 128-bit hashes are asked about in a second exchange (does a document with a
smaller id hold it?), and words under a passage with that answer go. Both exchanges send a hash once per cell
(:mod:`cells`), so groups of copies of any size cost no more than single texts.

Cases: a null text has no words. Rows with equal ``doc_id`` are one document, each row with its own text. A row with a
null ``doc_id`` is neither compared nor changed. Texts shorter than a passage lose nothing. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webestate.llm import cells as c
from webestate.llm.wordhash import U, Words, mix, powers

#: Period and a difference cover of it: every remainder is a difference of two members.
PERIOD, COVER = 7, (0, 1, 3)
#: Bits of an anchor that are sent: a chance hit only costs a passage test.
KEEP = U(0xFFFFFFFFFFFF0000)


def rolling(words: Words, length: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (index of a word) and hash of every run of ``length`` words inside one text."""
    n = np.diff(words.first)
    runs = np.maximum(n - length + 1, 0)
    start = np.repeat(words.first[:-1], runs) + np.arange(int(runs.sum())) - np.repeat(np.concatenate(([0], np.cumsum(runs)))[:-1], runs)
    step, h = powers(U(base), length), np.zeros(len(start), dtype=np.uint64)
    for j in range(length):
        h += words.h[start + j] * step[j]
    return start, mix(h)


class Cell:
    """The documents of one cell and what is asked about them."""

    def __init__(self, table: pa.Table, span: int) -> None:
        self.ids = table.column("doc_id").to_pylist()
        self.words = Words(table.column("text").to_pylist())
        self.span = span
        self.known = np.asarray([i is not None for i in self.ids], dtype=bool)
        self.doc = np.asarray([i if i is not None else 0 for i in self.ids], dtype=np.int64)

    def anchors(self) -> None:
        start, h = rolling(self.words, self.span - PERIOD + 1, 0x9FB21C651E98DF25)
        text = self.words.doc[start]
        pick = np.isin((start - self.words.first[text]) % PERIOD, COVER) & self.known[text]
        self.at, text = start[pick], text[pick]
        self.hashes, self.place, low, high = c.distinct(h[pick] & KEEP, self.doc[text])
        self.several = low < high

    def passages(self, shared: np.ndarray) -> None:
        """Passages that contain a shared anchor: ``begin``, and their distinct hashes with the smallest id."""
        w, size = self.words, self.span
        last = w.first[1:] - size  # last start of a passage in each text
        hit = self.at[shared[self.place]]
        text = w.doc[hit]
        begin = (hit[:, None] - np.arange(PERIOD)[None, :]).ravel()
        owner = np.repeat(text, PERIOD)
        begin = np.unique(begin[(begin >= w.first[owner]) & (begin <= last[owner])])
        self.begin, self.owner = begin, w.doc[begin] if len(begin) else np.zeros(0, dtype=np.int64)
        h1, h2 = (np.zeros(len(begin), dtype=np.uint64) for _ in range(2))
        for h, base in ((h1, 0xD6E8FEB86659FD93), (h2, 0xA0761D6478BD642F)):
            step = powers(U(base), size)
            for j in range(size):
                h += w.h[begin + j] * step[j]
        h1, h2 = mix(h1), mix(h2)
        order = np.lexsort((h2, h1))
        fresh = np.concatenate(([True], (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0))) if len(order) else np.zeros(0, dtype=bool)
        self.of = np.zeros(len(order), dtype=np.int64)
        self.of[order] = np.cumsum(fresh) - 1
        self.h1, self.h2 = h1[order][fresh], h2[order][fresh]
        self.low = np.full(len(self.h1), np.iinfo(np.int64).max)
        np.minimum.at(self.low, self.of, self.doc[self.owner])

    def kept(self, earlier: np.ndarray) -> tuple[list[int], list[int], list[str]]:
        """Words, removed words and kept text of each row; ``earlier`` marks passages that an outside document with a smaller id holds."""
        w = self.words
        gone = self.begin[earlier[self.of] | (self.low[self.of] < self.doc[self.owner])]
        edge = np.zeros(len(w.h) + 1, dtype=np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + self.span, -1)
        stays = np.cumsum(edge)[:-1] == 0
        texts = []
        for i in range(len(self.ids)):
            a, b = w.first[i], w.first[i + 1]
            texts.append(b" ".join([w.data[s:e] for s, e in zip(w.start[a:b][stays[a:b]].tolist(), w.end[a:b][stays[a:b]].tolist(), strict=True)]).decode("utf-8", "surrogatepass"))
        n = np.diff(w.first)
        return n.tolist(), (n - np.add.reduceat(np.concatenate((stays, [0])), w.first[:-1]) * (n > 0)).tolist() if len(n) else [], texts


def _ask_anchors(table: pa.Table, span: int, ranges: int) -> pa.Table:
    cell = Cell(table, span)
    cell.anchors()
    return c.ask(1, table.column("cell")[0].as_py(), cell.hashes, [cell.several], ranges)


def _shared(hashes: np.ndarray, who: np.ndarray, extras: list[bytes]) -> np.ndarray:
    several = np.concatenate([np.frombuffer(x, dtype=bool) for x in extras])
    unique, place, count = np.unique(hashes, return_inverse=True, return_counts=True)
    inside = np.zeros(len(unique), dtype=bool)
    inside[place[several]] = True
    return (count > 1)[place] | inside[place]


def _ask_passages(docs: pa.Table, replies: pa.Table, span: int, ranges: int) -> pa.Table:
    cell = Cell(docs, span)
    cell.anchors()
    cell.passages(c.bits_of(replies, 1, len(cell.hashes)))
    return c.ask(2, docs.column("cell")[0].as_py() if docs.num_rows else 0, cell.h1, [cell.h2, cell.low], ranges)


def _earlier(hashes: np.ndarray, who: np.ndarray, extras: list[bytes]) -> np.ndarray:
    both = [np.frombuffer(x, dtype=np.int64) for x in extras]
    second = np.concatenate([x[: len(x) // 2] for x in both]).view(np.uint64)
    low = np.concatenate([x[len(x) // 2:] for x in both])
    order = np.lexsort((low, second, hashes))
    fresh = np.concatenate(([True], (np.diff(hashes[order]) != 0) | (np.diff(second[order]) != 0)))
    least = low[order][fresh][np.cumsum(fresh) - 1]
    found = np.zeros(len(hashes), dtype=bool)
    found[order] = least < low[order]
    return found


def _apply(docs: pa.Table, replies: pa.Table, span: int) -> pa.Table:
    cell = Cell(docs, span)
    cell.anchors()
    cell.passages(c.bits_of(replies, 1, len(cell.hashes)))
    n, removed, texts = cell.kept(c.bits_of(replies, 2, len(cell.h1)))
    return pa.Table.from_arrays([docs.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                                names=["doc_id", "n_words", "n_removed", "kept"])


def dedup_passages(docs: DataFrame, span: int = 13) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept`` (the words that stay, joined by one blank)."""
    if span < PERIOD + 2:
        raise ValueError(f"a passage has at least {PERIOD + 2} words")
    parted, ranges = c.cells(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    by_cell = parted.groupBy("cell")
    asked = by_cell.applyInArrow(lambda d: _ask_anchors(d, span, ranges), c.ASKS)
    first = c.answer(asked, _shared)
    asked = by_cell.cogroup(first.groupBy("cell")).applyInArrow(lambda d, r: _ask_passages(d, r, span, ranges), c.ASKS)
    replies = first.unionByName(c.answer(asked, _earlier))
    return by_cell.cogroup(replies.groupBy("cell")).applyInArrow(lambda d, r: _apply(d, r, span), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def passage_digest(docs: DataFrame, span: int = 13) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``."""
    return dedup_passages(docs, span).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
