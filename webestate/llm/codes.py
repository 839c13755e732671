"""Vector code compression: product codes by integer Lloyd rounds that visit only active entries.

A vector is cut into equal consecutive parts; every part position has a codebook, and a vector is stored as one entry
index for each part. All arithmetic is in integers, so a distance kept from the round before is exact:

1. Every part is compared with every entry once; entry and squared distance are stored beside the vector.
2. Sums of the parts of each entry are added up map-side and by one aggregate of ``entries`` rows for each component.
3. A part whose entry did not move keeps its distance and is compared with moved entries only; a moved entry wins with a
   smaller distance, or with the same distance and a lower index. All other parts are compared with every entry again.

The state of a round is a written table. Codebooks (``entries`` integers for each component) travel with the tasks; their
size does not depend on the number of vectors.

Cases: a null vector and one with a null or non-finite component has no row; a zero vector is like any other. Vectors of
another length have codebooks of their own, sixteen nearly equal parts if the length is no multiple; an empty vector has
code 0 and error 0. Components beyond +-2**18 count as that value (2**26 after scaling), which keeps sums of squares of
512 components in 64 bits. Rows with equal ``vec_id`` count each; the first codebook takes rows in order of ``vec_id``,
nulls last, equal ids by components. Fewer vectors than entries give a smaller codebook. An empty table gives no rows. A sum over a label
beyond 64 bits is null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from webestate.session import materialise

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, LIMIT = 256, 1 << 26
#: One array of ``(entries, width)`` integers for each part.
Book = list[np.ndarray]


def integers(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * x.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


def bounds(width: int, parts: int) -> list[int]:
    return [i * width // parts for i in range(parts + 1)]


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows; a matrix product while every term fits in a double."""
    reach = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * reach * reach * max(1, x.shape[1]) < 2**53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(book)), dtype=np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - book[None, :, j]) ** 2
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry, lowest index on ties, and its distance."""
    d = squared(x, book)
    code = d.argmin(1)
    return code, d[np.arange(len(x)), code]


def renew(x: np.ndarray, old: np.ndarray, book: np.ndarray, code: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`nearest` for rows whose entry and distance in the codebook ``old`` are known."""
    moved = (old != book).any(1)
    code, distance = code.copy(), distance.copy()
    lost, active = moved[code], np.flatnonzero(moved)
    if lost.any():
        code[lost], distance[lost] = nearest(x[lost], book)
    stay = np.flatnonzero(~lost)
    if len(stay) and len(active):
        place, d = nearest(x[stay], book[active])
        entry = active[place]
        better = (d < distance[stay]) | ((d == distance[stay]) & (entry < code[stay]))
        code[stay[better]], distance[stay[better]] = entry[better], d[better]
    return code, distance


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one vector length at a time."""
    for batch in batches:
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            yield int(size), batch if (sizes == size).all() else batch.filter(pa.array(sizes == size))


def _state(batch: pa.RecordBatch, q: np.ndarray, code: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    packed = pa.array([row.tobytes() for row in code.astype(np.uint8)], pa.binary())
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("size"), _lists(q, pa.int32()), packed, _lists(distance, pa.int64())],
                                      names=["vec_id", "label", "size", "q", "code", "distances"])


def first_assignment(kept: DataFrame, books: dict[int, Book], parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, batch in _by_length(batches):
            q, at = integers(_matrix(batch.column("embedding"), batch.num_rows)), bounds(size, parts)
            pairs = [nearest(q[:, at[p]:at[p + 1]], books[size][p]) for p in range(parts)]
            yield _state(batch, q, np.stack([c for c, _ in pairs], 1), np.stack([d for _, d in pairs], 1))

    fields = [kept.schema["vec_id"], kept.schema["label"], StructField("size", IntegerType()), StructField("q", ArrayType(IntegerType())),
              StructField("code", BinaryType()), StructField("distances", ArrayType(LongType()))]
    return kept.mapInArrow(run, StructType(fields))


def active_assignment(state: DataFrame, old: dict[int, Book], books: dict[int, Book], parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, batch in _by_length(batches):
            q, at, n = _matrix(batch.column("q"), batch.num_rows).astype(np.int64), bounds(size, parts), batch.num_rows
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(n, parts).astype(np.int64)
            distance = _matrix(batch.column("distances"), n)
            pairs = [renew(q[:, at[p]:at[p + 1]], old[size][p], books[size][p], code[:, p], distance[:, p]) for p in range(parts)]
            yield _state(batch, q, np.stack([c for c, _ in pairs], 1), np.stack([d for _, d in pairs], 1))

    return state.mapInArrow(run, state.schema)


def entry_means(state: DataFrame, books: dict[int, Book], parts: int) -> dict[int, Book]:
    """Codebooks with every used entry at the floor of the mean of its parts."""
    entries = {size: len(book[0]) for size, book in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = {}, {}
        for size, batch in _by_length(batches):
            n, k, at = batch.num_rows, entries[size], bounds(size, parts)
            q = _matrix(batch.column("q"), n).astype(np.int64)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(n, parts)
            total, used = sums.setdefault(size, np.zeros((size, k), dtype=np.int64)), counts.setdefault(size, np.zeros((size, k), dtype=np.int64))
            for p in range(parts):
                for c in range(at[p], at[p + 1]):
                    np.add.at(total[c], code[:, p], q[:, c])
                    used[c] += np.bincount(code[:, p], minlength=k)
        for size, total in sums.items():
            component, entry = np.nonzero(counts[size])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), size), pa.int32()), pa.array(component, pa.int32()), pa.array(entry, pa.int32()),
                                              pa.array(counts[size][component, entry]), pa.array(total[component, entry])], names=["size", "component", "entry", "n", "total"])

    summed = (state.select("size", "q", "code").mapInArrow(run, "size int, component int, entry int, n bigint, total bigint")
              .groupBy("size", "component", "entry").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas())
    renewed = {size: [part.copy() for part in book] for size, book in books.items()}
    for size, component, entry, n, total in summed.itertuples(index=False):
        at = bounds(size, parts)
        part = max(p for p in range(parts) if at[p] <= component < at[p + 1])
        renewed[size][part][entry, component - at[part]] = int(total) // int(n)
    return renewed


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return F.coalesce(~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, Book]]:
    """``vec_id, label, size, q, code, distances`` of every usable vector, and the codebooks of each vector length.

    ``q`` holds the scaled integers, ``code`` one byte for each part, ``distances`` the squared distance of each part.
    """
    kept = vectors.where(usable(F.col("embedding"))).select("vec_id", "label", F.size("embedding").alias("size"), "embedding")
    books: dict[int, Book] = {}
    for row in kept.select("size").distinct().collect():  # vector lengths
        first = kept.where(F.col("size") == row["size"]).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
        q, at = integers(np.asarray([r["embedding"] for r in first], dtype=np.float64).reshape(len(first), row["size"])), bounds(row["size"], parts)
        books[row["size"]] = [q[:, at[p]:at[p + 1]] for p in range(parts)]
    state = first_assignment(kept, books, parts)
    for _ in range(rounds):
        state = materialise(state, "codes")
        old, books = books, entry_means(state, books, parts)
        state = active_assignment(state, old, books, parts)
    return state, books


def restored(codes: DataFrame, books: dict[int, Book], parts: int = PARTS) -> DataFrame:
    """``vec_id, approximation``: the vectors that the codes stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, batch in _by_length(batches):
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, parts)
            q = np.concatenate([books[size][p][code[:, p]] for p in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _lists((q + 0.5) / SCALE, pa.float64())], names=["vec_id", "approximation"])

    return codes.select("vec_id", "size", "code").mapInArrow(run, f"vec_id {codes.schema['vec_id'].dataType.simpleString()}, approximation array<double>")


def book_sha256(book: Book) -> str:
    return hashlib.sha256(",".join(str(v) for part in book for v in part.ravel().tolist()).encode()).hexdigest()


def with_label_sum(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``, the sum of ``error`` over rows of equal label.

    Labels with over a 64th of all rows, of which there are fewer than 64, are joined map-side; the others by a shuffle.
    """
    totals = materialise(rows.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-sums")
    every = totals.agg(F.sum("n")).first()[0] or 0
    sums = totals.select(F.col("label").alias("_label"), "label_error", "n")
    hot, rest = sums.where(F.col("n") * 64 > every).drop("n"), sums.where(F.col("n") * 64 <= every).drop("n")
    same = F.col("label").eqNullSafe(F.col("_label"))
    return (rows.join(F.broadcast(hot), same).drop("_label")
            .unionByName(rows.join(F.broadcast(hot), same, "left_anti").join(rest, same).drop("_label")))


def code_digest(vectors: DataFrame) -> DataFrame:
    """One row per usable vector: ``vec_id, code, error, label_error, codebooks_sha256``."""
    state, books = compress(vectors.select("vec_id", "label", "embedding"))
    digest = F.lit(None).cast("string")
    for size, book in books.items():
        digest = F.when(F.col("size") == size, F.lit(book_sha256(book))).otherwise(digest)
    error = F.aggregate("distances", F.lit(0).cast("bigint"), lambda a, d: a + d)
    rows = materialise(state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), error.alias("error"), digest.alias("codebooks_sha256")), "coded")
    return with_label_sum(rows).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
