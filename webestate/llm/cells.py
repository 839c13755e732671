"""An exchange of packed hash lists between groups of documents ("cells") and hash ranges.

A task that holds a cell of documents asks about a sorted list of distinct hashes; the list is cut by hash range, every
range gets one binary value per cell, answers one bit per hash, and the bits come back to the cell in the order of the
list. A hash is sent once per cell however often the cell holds it, so a hash that every document holds costs one entry
per cell, and both directions are spread evenly. Cells are a function of a row's id and text and lists are sorted sets, so a
task that runs again after a lost executor asks and answers the same. The numbers of cells and ranges follow the bytes of
all texts, so what one task holds does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webestate.llm.wordhash import U

CELL_BYTES, RANGE_BYTES = 4 << 20, 16 << 20
ASKS = "step int, range int, cell bigint, hashes binary, extra binary"
REPLIES = "step int, cell bigint, range int, bits binary, n int"


def cells(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, text, cell`` with about ``CELL_BYTES`` of text to a cell, and the number of hash ranges, one for ``RANGE_BYTES``.

    Rows of one id, or without any, are spread by their text.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, ranges = (max(1, -(-total // size)) for size in (CELL_BYTES, RANGE_BYTES))
    return docs.select("doc_id", "text", F.pmod(F.xxhash64(F.lit(29), "doc_id", "text"), F.lit(n)).alias("cell")), ranges


def cut(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of the sorted 64-bit ``hashes`` begins, and the end."""
    step = (1 << 64) // ranges + 1
    return np.searchsorted(hashes, np.asarray([min(i * step, 2**64 - 1) for i in range(ranges)] + [0], dtype=np.uint64)[:-1]).tolist() + [len(hashes)]


def ask(step: int, cell: int, hashes: np.ndarray, extras: list[np.ndarray], ranges: int) -> pa.Table:
    """Rows of ``ASKS``: ``hashes`` sorted and distinct, ``extras`` arrays of the same length."""
    at, rows = cut(hashes, ranges), []
    for r in range(ranges):
        a, b = at[r], at[r + 1]
        if b > a:
            rows.append((step, r, cell, hashes[a:b].tobytes(), b"".join(x[a:b].tobytes() for x in extras)))
    schema = pa.schema([("step", pa.int32()), ("range", pa.int32()), ("cell", pa.int64()), ("hashes", pa.binary()), ("extra", pa.binary())])
    return pa.Table.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def answer(asks: DataFrame, decide: Callable[[np.ndarray, np.ndarray, list[bytes]], np.ndarray]) -> DataFrame:
    """One or more bits for every hash asked. ``decide(hashes, cell index, extras)`` sees one hash range of all cells, in order of cells."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        lists = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        sizes = [len(x) for x in lists]
        bits = decide(np.concatenate(lists), np.repeat(np.arange(len(lists)), sizes), table.column("extra").to_pylist())
        packed = [np.packbits(x.ravel()).tobytes() for x in np.split(bits, np.cumsum(sizes)[:-1])]
        return pa.Table.from_arrays([table.column("step").cast(pa.int32()), table.column("cell"), table.column("range"), pa.array(packed, pa.binary()), pa.array(sizes, pa.int32())],
                                    names=["step", "cell", "range", "bits", "n"])

    return asks.groupBy("range").applyInArrow(run, REPLIES)


def bits_of(replies: pa.Table, step: int, n: int, width: int = 1) -> np.ndarray:
    """The bits of one step in the order of the list that was asked; several answers about one range are joined by or."""
    by_range: dict[int, np.ndarray] = {}
    for r in replies.select(["step", "range", "bits", "n"]).to_pylist():
        if r["step"] == step:
            bits = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), count=r["n"] * width).astype(bool)
            by_range[r["range"]] = bits | by_range[r["range"]] if r["range"] in by_range else bits
    found = np.concatenate([by_range[r] for r in sorted(by_range)]) if by_range else np.zeros(0, dtype=bool)
    if len(found) != n * width:
        raise ValueError(f"{n} hashes asked, {len(found) // width} answered")
    return found if width == 1 else found.reshape(n, width)


def distinct(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, the place of each input hash in them, and the smallest and largest ``docs`` value of each."""
    unique, place = np.unique(hashes, return_inverse=True)
    low, high = np.full(len(unique), np.iinfo(np.int64).max), np.full(len(unique), np.iinfo(np.int64).min)
    np.minimum.at(low, place, docs)
    np.maximum.at(high, place, docs)
    return unique, place, low, high


__all__ = ["ASKS", "REPLIES", "U", "answer", "ask", "bits_of", "cells", "cut", "distinct"]
