"""Suffix-array dedup: bytes under a ``span``-byte (400) string that occurs anywhere else are removed.

**Index.** A suffix array over every byte would be many times the text. The arrays here are sparse: of the starts of
all 64-byte grams in a ``span``-byte string, the one with the smallest hash is kept (leftmost of ties), so two equal
strings keep the same start, and every string keeps one. A kept suffix is stored under its first eight bytes and the
fingerprint of its first 64, in that order. The fingerprint is the hash mixed once more: kept hashes are small by
choice, so by themselves nearly all would fall into the lowest range. :class:`SuffixIndex` is a logarithmic family of
such arrays: a new batch gets its own array, is merge-scanned against every level, and levels of equal size merge, so an
entry is rewritten log(batches) times. Arrays are cut by fingerprint range; each range is one row of a written table.
Inside a batch a suffix that a cell holds repeatedly is one entry, so a frequent passage costs one entry per cell.

**Extension.** A match of 64 bytes is extended in both directions. First the whole context of the suffix (all strings
through it) is compared: where it occurs again, all its strings are repeats. The other contexts, and one holder of each
repeated context that has rivals, post their strings, whose 96-bit hashes are counted over all cells. The kept starts of
a cell are found once and stored; extension hashes only texts with a shared suffix.

Cases: null text is empty; text shorter than ``span`` loses nothing. Ids play no part: equal rows are repeats of each
other. Extra columns are ignored. Remaining bytes can cut a UTF-8 letter, so they are returned as binary.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webestate.llm import cells as c
from webestate.llm.wordhash import _BYTE, U, mix, powers, slabs
from webestate.session import materialise

GRAM = 64
BATCHES = 4
INDEX_RANGES = 4  # a range of the index spans so many of the strings: it holds one entry for about 170 bytes of text
ARRAY = "range int, lead binary, print binary, cell binary, place binary, several binary"
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    return powers(U(base), n)


class Hashed:
    """Prefix sums of the bytes of each slab, for the hash of any part of a text."""

    def __init__(self, raw: np.ndarray, parts: list[tuple[int, int]], base: int) -> None:
        longest = max((b - a for a, b in parts), default=0)
        self.top = -(-(longest + 1) // (1 << 20)) << 20
        self.power, self.parts = _powers(base, self.top + 1), np.asarray([a for a, _ in parts] or [0])
        self.back = U(pow(base, -self.top, 2**64))
        self.sums = np.zeros(len(raw) + len(parts), dtype=np.uint64)  # one more entry than bytes in each slab
        for k, (a, b) in enumerate(parts):
            np.cumsum(_BYTE[raw[a:b]] * self.power[: b - a], out=self.sums[a + k + 1:b + k + 1])

    def grams(self, k: int, n: int, width: int) -> np.ndarray:
        """:meth:`of` for all ``width`` neighbouring bytes of slab ``k``, which has ``n``."""
        sums, m = self.sums[self.parts[k] + k:self.parts[k] + k + n + 1], n - width + 1
        return mix((sums[width:] - sums[:-width]) * self.power[self.top - m + 1:self.top + 1][::-1] * self.back + U(width))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the parts, some at a time: intermediate arrays stay small."""
        if len(start) > 1 << 17:
            return np.concatenate([self.of(start[i:i + (1 << 17)], end[i:i + (1 << 17)]) for i in range(0, len(start), 1 << 17)])
        k = np.searchsorted(self.parts, start, "right") - 1
        return mix((self.sums[end + k] - self.sums[start + k]) * self.power[self.top - (start - self.parts[k])] * self.back + (end - start).astype(np.uint64))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, in two passes over blocks of ``width``."""
    n = len(x)
    pad = np.full(-n % width + width, np.iinfo(x.dtype).max, dtype=x.dtype)
    rows = np.concatenate((x, pad)).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1:n])


def spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All integers from low to high (included) of every pair, sorted and distinct."""
    size = np.maximum(high - low + 1, 0)
    return np.unique(np.repeat(low, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))


def _fingerprints(hashed: Hashed, at: np.ndarray) -> np.ndarray:
    """Of the kept grams that start at ``at``, spread evenly over all 64-bit values."""
    return mix(hashed.of(at, at + GRAM))


class Cell:
    """The texts of one cell as one byte string, and what is asked about it. ``kept`` are the stored starts of an earlier step."""

    def __init__(self, table: pa.Table, span: int, kept: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        ids = table.column("doc_id").to_pylist()
        # Rows arrive in any order; stored places need one that every step finds again. Rows that tie are equal.
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, coded[i]))
        self.ids, coded = [ids[i] for i in order], [coded[i] for i in order]
        self.span, self.raw = span, np.frombuffer(b"".join(coded), dtype=np.uint8)
        self.bounds = np.concatenate(([0], np.cumsum([len(x) for x in coded]))).astype(np.int64)
        if kept is not None:
            self.at, self.place = kept
            return
        parts = slabs(self.bounds, 1 << 19)
        first = Hashed(self.raw, parts, BASES[0])
        self.at = np.concatenate([self._samples(first, k, a, b) for k, (a, b) in enumerate(parts)] or [np.zeros(0, dtype=np.int64)])
        self.prints, self.place, count = np.unique(_fingerprints(first, self.at), return_inverse=True, return_counts=True)
        self.several = count > 1
        head = np.zeros(len(self.prints), dtype=np.int64)
        head[self.place] = self.at
        self.lead = np.zeros(len(head), dtype=np.uint64)
        for j in range(8):
            self.lead = (self.lead << U(8)) | self.raw[head + j].astype(np.uint64)

    def _samples(self, first: Hashed, k: int, a: int, b: int) -> np.ndarray:
        """Starts kept in slab ``k``."""
        if b - a < self.span:
            return np.zeros(0, dtype=np.int64)
        grams = first.grams(k, b - a, GRAM)
        key = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        least = sliding_least(key, self.span - GRAM + 1)
        whole = np.zeros(b - a, dtype=bool)  # starts of strings inside one text
        inside = self.bounds[(self.bounds >= a) & (self.bounds <= b)]
        for x, y in zip(inside[:-1].tolist(), inside[1:].tolist(), strict=True):
            whole[x - a:max(x, y - self.span + 1) - a] = True
        return a + np.unique((least[whole[: len(least)]] & U(0xFFFFFFFF)).astype(np.int64))

    def _hash(self, at: np.ndarray) -> None:
        """Hashes of the texts that hold these places; adjacent texts share a slab."""
        texts = np.unique(np.searchsorted(self.bounds, at, "right") - 1)
        parts: list[tuple[int, int]] = []
        for a, b in zip(self.bounds[texts].tolist(), self.bounds[texts + 1].tolist(), strict=True):
            if parts and parts[-1][1] == a and b - parts[-1][0] <= 1 << 19:
                parts[-1] = parts[-1][0], b
            else:
                parts.append((a, b))
        self.first, self.second = (Hashed(self.raw, parts, base) for base in BASES)

    def contexts(self, shared: np.ndarray) -> None:
        """Distinct (fingerprint, context) of the shared suffixes: ``f, c1, c2``; ``entry`` of each shared suffix."""
        pick = shared[self.place]
        self.sat = self.at[pick]
        self._hash(self.sat)
        text = np.searchsorted(self.bounds, self.sat, "right") - 1
        low, high = self.bounds[text], self.bounds[text + 1]
        low, high = np.maximum(low, self.sat - self.span + GRAM), np.minimum(high, self.sat + self.span)
        self.begin, self.last = low, np.minimum(self.sat, high - self.span)  # starts of the strings through the suffix
        turn = mix((self.sat - low).astype(np.uint64))
        f, c1, c2 = _fingerprints(self.first, self.sat), self.first.of(low, high) ^ turn, self.second.of(low, high) + turn
        order = np.lexsort((c2, c1, f))
        f, c1, c2 = f[order], c1[order], c2[order]
        fresh = np.concatenate(([True], (np.diff(f) != 0) | (np.diff(c1) != 0) | (np.diff(c2) != 0)))[: len(order)]
        self.entry = np.zeros(len(order), dtype=np.int64)
        self.entry[order] = np.cumsum(fresh) - 1
        self.f, self.c1, self.c2 = f[fresh], c1[fresh], c2[fresh]
        self.repeated = np.bincount(self.entry, minlength=len(self.f)) > 1

    def strings(self, posts: np.ndarray) -> None:
        """Strings through the suffixes whose context posts: ``starts``, distinct hashes ``s1, s2`` and ``of`` each start."""
        one = np.zeros(len(self.f), dtype=np.int64)
        one[self.entry[::-1]] = np.arange(len(self.entry))[::-1]  # first suffix of each context
        use = one[posts]
        self.starts = spans(self.begin[use], self.last[use])
        s1, s2 = self.first.of(self.starts, self.starts + self.span), self.second.of(self.starts, self.starts + self.span)
        s2 = (s2 >> U(32)).astype(np.uint32)
        order = np.lexsort((s2, s1))
        s1, s2 = s1[order], s2[order]
        fresh = np.concatenate(([True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])))[: len(order)]
        self.of = np.zeros(len(order), dtype=np.int32)
        self.of[order] = np.cumsum(fresh) - 1
        self.s1, self.s2 = s1[fresh], s2[fresh]
        self.twice = np.bincount(self.of, minlength=len(self.s1)) > 1

    def removed(self, settled: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Mask of the bytes that go."""
        self.first = self.second = None  # hashing is over
        edge = np.zeros(len(self.raw) + 1, dtype=np.int32)
        all_in = settled[self.entry] & (self.last >= self.begin)
        np.add.at(edge, self.begin[all_in], 1)
        np.add.at(edge, self.last[all_in] + self.span, -1)
        gone = self.starts[found[self.of]]
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + self.span, -1)
        return np.cumsum(edge, dtype=np.int32, out=edge)[:-1] > 0


def _bools(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype=bool) for x in parts])


class SuffixIndex:
    """Levels of sparse suffix arrays; ``add`` returns replies (:mod:`cells`) about suffixes that occur more than once."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, asks: DataFrame) -> DataFrame:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:  # geometric merge, before the next batch
            (n, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * n, materialise(a.groupBy("range").cogroup(b.groupBy("range")).applyInArrow(lambda x, y: _row(_sorted(x, y)), ARRAY), "level")))
        batch = materialise(asks.where("step = 1").groupBy("range").applyInArrow(lambda t: _array(t), ARRAY), "suffixes")
        found = batch.groupBy("range").applyInArrow(lambda t: _repeats(t, None), c.REPLIES)
        for _, level in self.levels:
            found = found.unionByName(batch.groupBy("range").cogroup(level.groupBy("range")).applyInArrow(lambda x, y: _repeats(x, y), c.REPLIES))
        self.levels.append((1, batch))
        return found


def _array(table: pa.Table) -> pa.Table:
    """The suffix array of one batch and range, from the sorted lists of its cells."""
    table = table.sort_by("cell")
    prints = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
    extras = table.column("extra").to_pylist()
    sizes = [len(x) for x in prints]
    columns = {
        "range": table.column("range")[0].as_py(), "print": np.concatenate(prints),
        "lead": np.concatenate([np.frombuffer(x[: 8 * n], dtype=np.uint64) for x, n in zip(extras, sizes, strict=True)]),
        "several": _bools([x[8 * n:] for x, n in zip(extras, sizes, strict=True)]),
        "cell": np.repeat(table.column("cell").to_numpy(), sizes).astype(np.int64), "place": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]),
    }
    return _row(_ordered(columns))


def _ordered(x: dict) -> dict:
    order = np.lexsort((x["cell"], x["print"], x["lead"]))
    return {k: v if k == "range" else v[order] for k, v in x.items()}


def _read(table: pa.Table) -> dict:
    kinds = {"lead": np.uint64, "print": np.uint64, "cell": np.int64, "place": np.int32, "several": bool}
    row = table.to_pylist()[0]
    return {"range": row["range"]} | {k: np.frombuffer(row[k], dtype=t) for k, t in kinds.items()}


def _sorted(*tables: pa.Table) -> dict:
    parts = [_read(t) for t in tables if t.num_rows]
    if len(parts) == 1:
        return parts[0]
    return _ordered({k: v if k == "range" else np.concatenate([p[k] for p in parts]) for k, v in parts[0].items()})


def _row(x: dict) -> pa.Table:
    names = ("lead", "print", "cell", "place", "several")
    return pa.Table.from_arrays([pa.array([x["range"]], pa.int32()), *(pa.array([x[k].tobytes()], pa.binary()) for k in names)], names=["range", *names])


def _repeats(batch: pa.Table, level: pa.Table | None) -> pa.Table:
    """Merge scan: neighbours in the common order with the same suffix; one answer for each cell on either side."""
    rows = []
    if batch.num_rows and (level is None or level.num_rows):
        x = _sorted(batch) if level is None else _sorted(batch, level)
        equal = (x["print"][1:] == x["print"][:-1]) & (x["lead"][1:] == x["lead"][:-1])
        bits = np.concatenate((equal, [False])) | np.concatenate(([False], equal)) | (x["several"] if level is None else False)
        order = np.lexsort((x["place"], x["cell"]))
        cells, begin = np.unique(x["cell"][order], return_index=True)
        for cell, part in zip(cells.tolist(), np.split(bits[order], begin[1:]), strict=True):
            rows.append((1, cell, x["range"], np.packbits(part).tobytes(), len(part)))
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["step", "cell", "range", "bits", "n"])


def _settle(prints: np.ndarray, who: np.ndarray, extras: list[bytes]) -> np.ndarray:
    """For each context: does it occur again, and must it post its strings?"""
    n = [len(x) // 17 for x in extras]
    c1 = np.concatenate([np.frombuffer(x[: 8 * k], dtype=np.uint64) for x, k in zip(extras, n, strict=True)])
    c2 = np.concatenate([np.frombuffer(x[8 * k:16 * k], dtype=np.uint64) for x, k in zip(extras, n, strict=True)])
    twice = _bools([x[16 * k:] for x, k in zip(extras, n, strict=True)])
    order = np.lexsort((who, c2, c1, prints))
    f = np.concatenate(([True], np.diff(prints[order]) != 0))
    fresh = f | np.concatenate(([True], (np.diff(c1[order]) != 0) | (np.diff(c2[order]) != 0)))
    group, family = np.cumsum(fresh) - 1, np.cumsum(f) - 1
    held = np.bincount(group)
    again = (held[group] > 1) | (np.bincount(group, weights=twice[order]) > 0)[group]
    rivals = (np.bincount(family, weights=fresh) > 1)[family]
    out = np.zeros((len(order), 2), dtype=bool)
    out[order, 0], out[order, 1] = again, rivals & (~again | fresh)
    return out


def _counted(hashes: np.ndarray, who: np.ndarray, extras: list[bytes]) -> np.ndarray:
    n = [len(x) // 5 for x in extras]
    second = np.concatenate([np.frombuffer(x[: 4 * k], dtype=np.uint32) for x, k in zip(extras, n, strict=True)])
    twice = _bools([x[4 * k:] for x, k in zip(extras, n, strict=True)])
    order = np.lexsort((second, hashes))
    group = np.cumsum(np.concatenate(([True], (np.diff(hashes[order]) != 0) | (np.diff(second[order]) != 0)))) - 1
    found = np.zeros(len(order), dtype=bool)
    found[order] = (np.bincount(group) > 1)[group] | (np.bincount(group, weights=twice[order]) > 0)[group]
    return found


def _name(docs: pa.Table) -> int:
    return docs.column("cell")[0].as_py()


def _ask_suffixes(docs: pa.Table, span: int, ranges: int) -> pa.Table:
    """The suffixes of a cell, and, as step 0, the places of its kept starts for the later steps."""
    cell = Cell(docs, span)
    asks = c.ask(1, _name(docs), cell.prints, [cell.lead, cell.several], ranges)
    kept = pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip((0, -1, _name(docs), cell.at.astype(np.int32).tobytes(), cell.place.astype(np.int32).tobytes()), asks.schema, strict=True)], schema=asks.schema)
    return pa.concat_tables([asks, kept])


def _again(docs: pa.Table, replies: pa.Table, span: int) -> Cell:
    """The cell with its stored starts and the contexts of its shared suffixes."""
    kept = next(r["bits"] for r in replies.select(["step", "bits"]).to_pylist() if r["step"] == 0)
    both = np.frombuffer(kept, dtype=np.int32).astype(np.int64).reshape(2, -1)
    cell = Cell(docs, span, (both[0], both[1]))
    cell.contexts(c.bits_of(replies, 1, int(both[1].max(initial=-1)) + 1))
    return cell


def _ask_contexts(docs: pa.Table, replies: pa.Table, span: int, ranges: int) -> pa.Table:
    cell = _again(docs, replies, span)
    return c.ask(2, _name(docs), cell.f, [cell.c1, cell.c2, cell.repeated], ranges)


def _ask_strings(docs: pa.Table, replies: pa.Table, span: int, ranges: int) -> pa.Table:
    cell = _again(docs, replies, span)
    cell.strings(c.bits_of(replies, 2, len(cell.f), 2)[:, 1])
    return c.ask(3, _name(docs), cell.s1, [cell.s2, cell.twice], ranges)


def _apply(docs: pa.Table, replies: pa.Table, span: int) -> pa.Table:
    cell = _again(docs, replies, span)
    settled = c.bits_of(replies, 2, len(cell.f), 2)
    cell.strings(settled[:, 1])
    gone = cell.removed(settled[:, 0], c.bits_of(replies, 3, len(cell.s1)))
    kept, removed, runs = [], [], []
    for a, b in zip(cell.bounds[:-1].tolist(), cell.bounds[1:].tolist(), strict=True):
        part = gone[a:b]
        kept.append(cell.raw[a:b][~part].tobytes())
        removed.append(int(part.sum()))
        runs.append(int((np.diff(np.concatenate(([False], part)).astype(np.int8)) == 1).sum()))
    sizes = np.diff(cell.bounds)
    return pa.Table.from_arrays([pa.array(cell.ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_suffixes(docs: DataFrame, span: int = 400, batches: int = BATCHES) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary)."""
    if span <= GRAM:
        raise ValueError(f"a string has more than {GRAM} bytes")
    parted, ranges = c.cells(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    by_cell, sparse = parted.groupBy("cell"), -(-ranges // INDEX_RANGES)
    asked = materialise(by_cell.applyInArrow(lambda d: _ask_suffixes(d, span, sparse), c.ASKS), "suffix-lists")
    kept = asked.where("step = 0").select("step", "cell", "range", F.concat("hashes", "extra").alias("bits"), F.lit(0).alias("n"))
    index, first = SuffixIndex(), None
    for batch in range(batches):
        found = index.add(asked.where(F.pmod("cell", F.lit(batches)) == batch))
        first = found if first is None else first.unionByName(found)
    first = materialise(first, "suffix-replies").unionByName(kept)
    asked = by_cell.cogroup(first.groupBy("cell")).applyInArrow(lambda d, r: _ask_contexts(d, r, span, sparse), c.ASKS)
    replies = first.unionByName(c.answer(asked, _settle))
    asked = by_cell.cogroup(replies.groupBy("cell")).applyInArrow(lambda d, r: _ask_strings(d, r, span, ranges), c.ASKS)
    replies = replies.unionByName(c.answer(asked, _counted))
    return by_cell.cogroup(replies.groupBy("cell")).applyInArrow(
        lambda d, r: _apply(d, r, span), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def suffix_digest(docs: DataFrame, span: int = 400) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    return dedup_suffixes(docs, span).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
