"""Vectorised word hashing for tasks: whole texts in, one 64-bit hash per word out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (wrap-around arithmetic is meant)."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of some texts: ``h`` hashes, ``doc`` index of the text, ``start`` and ``end`` offsets into ``data``, ``first`` word of each text."""

    def __init__(self, texts: list[str | None]) -> None:
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(coded) + b"\n"
        begins = np.concatenate(([0], np.cumsum([len(c) + 1 for c in coded])))
        raw, parts = np.frombuffer(self.data, dtype=np.uint8), []
        for a, b in slabs(begins):
            parts.append((a, *_hashed(raw[a:b])))
        self.start = np.concatenate([a + s for a, s, _, _ in parts]) if parts else np.zeros(0, dtype=np.int64)
        self.end = np.concatenate([a + e for a, _, e, _ in parts]) if parts else self.start
        self.h = np.concatenate([h for *_, h in parts]) if parts else np.zeros(0, dtype=np.uint64)
        self.first = np.searchsorted(self.start, begins)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))


def slabs(bounds: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of whole texts of about ``most`` bytes, as offsets; temporary arrays then stay small whatever the text."""
    out, start = [], 0
    ends = bounds[1:].tolist()
    for i, end in enumerate(ends):
        if end - start >= most or i == len(ends) - 1:
            if end > start:
                out.append((start, end))
            start = end
    return out


def _hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words in bytes that end in a blank."""
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space))))
    start, end = edge[0::2], edge[1::2]
    if len(start) == 0:
        return start, end, np.zeros(0, dtype=np.uint64)
    size = end - start
    at = np.concatenate(([0], np.cumsum(size)))
    inside = np.arange(at[-1]) - np.repeat(at[:-1], size)
    terms = _BYTE[raw[~space]] * powers(_BASE, int(size.max()))[inside]
    return start, end, mix(np.add.reduceat(terms, at[:-1]) + size.astype(np.uint64))


def chunks(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[tuple[list, list[str | None]]]:
    """``(first column, second column)`` of runs of rows whose texts have about ``most`` characters together; a longer text comes alone."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = size = 0
        for i, text in enumerate(texts):
            if size and size + len(text or "") > most:
                yield ids[start:i], texts[start:i]
                start, size = i, 0
            size += len(text or "")
        if start < len(texts):
            yield ids[start:], texts[start:]
