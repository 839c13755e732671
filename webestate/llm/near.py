"""MinHash near-dedup with improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A document is the multiset of its five-word shingles; the n-th repeat of a shingle is an element of its own, so integer
term frequencies need no weights. An element weighs the mean inverse document frequency of its words (hashed to
``BUCKETS``, counted over all documents). Similarity is the weighted Jaccard similarity of two such sets.

1. Sketch: ICWS samples, 80 per document, in 20 bands of 4. Documents of some size use one permutation: each element is
   evaluated once, in one bin, and empty bins borrow from others. Light documents evaluate every element 80 times. The
   ranges of the two schemes overlap by the factor that the threshold allows, so similar documents share a scheme.
   At similarity 0.8 a pair shares no band with probability 3e-5.
2. Groups: copies (equal texts) are one representative; representatives that share a band are connected.
3. Verification: a connected group is cut into blocks of bounded size, and every block meets every other block of its
   group in one task, which computes exact weighted similarities by sparse counting and blocked matrix products. Only
   a spanning forest of the links found leaves a task: no pairs are emitted, and no pair inside a group is skipped.
4. Classes: components of these links, named by their smallest ``doc_id``.

Cases: a document with fewer than five words has one shingle of all its words. A text without words (or null) links with
nothing, not even its copies. Rows with equal ``doc_id`` are one document. A row with a null ``doc_id`` is in no class
and kept. Extra columns are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webestate.llm.common import partitions, wide_hash, wrapped
from webestate.llm.graph import components
from webestate.llm.wordhash import U, Words, chunks, mix, powers
from webestate.session import materialise

SHINGLE, BUCKETS = 5, 1 << 16
BANDS, ROWS = 20, 4
BINS = BANDS * ROWS
#: Total weight up to which every element is evaluated for every sample.
LIGHT = 96.0
BLOCK_DOCS, BLOCK_WORDS = 1024, 400_000


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each word bucket, over all rows with words; a fixed-size table."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for _, texts in chunks(batches):
            w = Words(texts)
            keys = np.unique(w.doc.astype(np.int64) * BUCKETS + (w.h % U(BUCKETS)).astype(np.int64))
            total += np.bincount(keys % BUCKETS, minlength=BUCKETS)
            n += len(np.unique(w.doc))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], used)), pa.int32()), pa.array(np.concatenate(([n], total[used])), pa.int64())], ["bucket", "docs"])

    counts = (docs.select("doc_id", "text").mapInArrow(count, "bucket int, docs bigint").groupBy("bucket").agg(F.sum("docs").alias("docs")).toPandas())
    df, n = np.zeros(BUCKETS), int(counts.loc[counts["bucket"] == -1, "docs"].sum())
    rest = counts[counts["bucket"] >= 0]
    df[rest["bucket"]] = rest["docs"]
    return (np.log1p(n / np.maximum(df, 1)) / math.log1p(max(n, 1))).astype(np.float64)


def elements(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, key, weight`` of all elements, in order of (doc, key)."""
    w = Words(texts)
    n = np.diff(w.first)
    padded = np.where((n > 0) & (n < SHINGLE), SHINGLE, n)  # short texts: blanks fill up the only shingle
    at = np.concatenate(([0], np.cumsum(padded)))
    place = at[w.doc] + np.arange(len(w.h)) - w.first[w.doc]
    h, weight = np.zeros(at[-1], dtype=np.uint64), np.zeros(at[-1])
    h[place], weight[place] = w.h, idf[(w.h % U(BUCKETS)).astype(np.int64)]
    shingles = np.maximum(padded - SHINGLE + 1, 0)
    doc = np.repeat(np.arange(len(texts)), shingles)
    if len(doc) == 0:
        return doc, np.zeros(0, dtype=np.uint64), np.zeros(0)
    begin = at[doc] + np.arange(len(doc)) - np.concatenate(([0], np.cumsum(shingles)))[doc]
    base = powers(U(0xD6E8FEB86659FD93), SHINGLE)
    key, total = np.zeros(len(doc), dtype=np.uint64), np.zeros(len(doc))
    for j in range(SHINGLE):
        key += h[begin + j] * base[j]
        total += weight[begin + j]
    key, total = mix(key), np.maximum(total / np.minimum(n[doc], SHINGLE), 0.01)
    order = np.lexsort((key, doc))
    doc, key, total = doc[order], key[order], total[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    rank = np.arange(len(key)) - np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
    return doc, np.where(rank > 0, mix(key + rank.astype(np.uint64) * U(0xA0761D6478BD642F)), key), total


def _uniform(key: np.ndarray, seed: int) -> np.ndarray:
    return ((mix(key ^ U((seed * 0x9E3779B97F4A7C15 + 0x1B873593) & (2**64 - 1))) >> U(11)).astype(np.float64) + 0.5) / 2.0**53


def consistent_sample(key: np.ndarray, weight: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank (smaller wins) and sample value of each element: gamma(2, 1) step and level, uniform shift."""
    step = -np.log(_uniform(key, 4 * seed + 1) * _uniform(key, 4 * seed + 2))
    both = mix(key ^ U((seed * 0xBF58476D1CE4E5B9 + 77) & (2**64 - 1)))
    shift = ((both & U(0xFFFFFFFF)).astype(np.float64) + 0.5) / 2.0**32
    level = -np.log((((both >> U(32)).astype(np.float64) + 0.5) / 2.0**32) * _uniform(key, 4 * seed + 3))
    t = np.floor(np.log(weight) / step + shift)
    return np.log(level) - step * (t - shift) - step, mix(key + t.astype(np.int64).astype(np.uint64) * U(0xE7037ED1A0B428DB))


def sketches(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys: ``doc, band key`` rows for ``n`` documents."""
    total = np.bincount(doc, weights=weight, minlength=n)
    owners, bands = [], []

    def emit(rows: np.ndarray, values: np.ndarray, scheme: int) -> None:
        for b in range(BANDS):
            code = np.full(len(rows), (b * 2 + scheme + 1) * 0x9FB21C651E98DF25 & (2**64 - 1), dtype=np.uint64)
            for r in range(ROWS):
                code = mix(code + values[:, b * ROWS + r])
            owners.append(rows)
            bands.append(code)

    light = np.flatnonzero((total > 0) & (total <= LIGHT))
    if len(light):
        pick = np.isin(doc, light)
        d, k, w = np.searchsorted(light, doc[pick]), key[pick], weight[pick]
        begin = np.searchsorted(d, np.arange(len(light)))
        values = np.zeros((len(light), BINS), dtype=np.uint64)
        for j in range(BINS):
            rank, value = consistent_sample(k, w, j)
            lowest = np.minimum.reduceat(rank, begin)
            values[:, j] = np.minimum.reduceat(np.where(rank == lowest[d], value, U(2**64 - 1)), begin)
        emit(light, values, 0)
    heavy = np.flatnonzero(total >= 0.8 * LIGHT)
    if len(heavy):
        pick = np.isin(doc, heavy)
        d, k, w = np.searchsorted(heavy, doc[pick]), key[pick], weight[pick]
        rank, value = consistent_sample(k, w, 1000)
        bin_ = ((mix(k + U(0x2545F4914F6CDD1D)) >> U(32)) % U(BINS)).astype(np.int64)
        cell = d * BINS + bin_
        order = np.lexsort((rank, cell))
        first = order[np.concatenate(([True], np.diff(cell[order]) > 0))]
        flat, filled = np.zeros(len(heavy) * BINS, dtype=np.uint64), np.zeros(len(heavy) * BINS, dtype=bool)
        flat[cell[first]], filled[cell[first]] = value[first], True
        empty, turn = np.flatnonzero(~filled), 0
        while len(empty):
            turn += 1
            probe = (mix(((empty % BINS) + turn * BINS).astype(np.uint64)) % U(BINS)).astype(np.int64)
            source = empty // BINS * BINS + probe
            found = filled[source]
            flat[empty[found]] = flat[source[found]]
            empty = empty[~found]
        emit(heavy, flat.reshape(-1, BINS), 1)
    if not owners:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(owners), np.concatenate(bands)


def _sketch_rows(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """``doc_id, h1, h2, n, bands`` of rows with an id and words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[pa.RecordBatch, int]]:
            for batch in batches:
                texts, start, size = batch.column("text").to_pylist(), 0, 0
                for i, t in enumerate([*texts, None]):
                    if i == len(texts) or size and size + len(t) > 2 << 20:
                        yield batch.slice(start, i - start), texts[start:i]
                        start, size = i, 0
                    size += len(t or "")

        for part, texts in rows():
            if not texts:
                continue
            doc, key, weight = elements(texts, idf)
            owner, band = sketches(doc, key, weight, len(texts))
            order = np.argsort(owner, kind="stable")
            n = np.bincount(doc, minlength=len(texts))
            ends = np.searchsorted(owner[order], np.arange(len(texts) + 1))
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(band[order].view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h1"), part.column("h2"), pa.array(n, pa.int32()), bands], ["doc_id", "h1", "h2", "n", "bands"])

    high, low = wide_hash("text")
    source = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", high.alias("h1"), low.alias("h2"))
    return source.mapInArrow(run, "doc_id bigint, h1 bigint, h2 bigint, n int, bands array<bigint>").where("n > 0")


class Links:
    """Spanning forest of the links found in one task."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def add(self, rows: np.ndarray, cols: np.ndarray) -> None:
        for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
            a, b = self.top(i), self.top(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)


def overlaps(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Weight that each two of ``n`` documents share (upper triangle): rare elements by pairs, frequent ones by products."""
    order = np.lexsort((doc, key))
    doc, key, weight = doc[order], key[order], weight[order]
    fresh = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((fresh, [len(key)])))
    shared = np.zeros(n * n)
    for s in np.unique(size[(size > 1) & (size <= 24)]):
        begin = fresh[size == s]
        cells = [(doc[begin + i] * n + doc[begin + j]) for i in range(s) for j in range(i + 1, s)]
        np.add.at(shared, np.concatenate(cells), np.tile(weight[begin], s * (s - 1) // 2))
    shared = shared.reshape(n, n)
    many = np.flatnonzero(size > 24)
    for at in range(0, len(many), 1024):
        part = many[at:at + 1024]
        holds = np.zeros((n, len(part)))
        where = np.repeat(np.arange(len(part)), size[part])
        spots = np.repeat(fresh[part], size[part]) + np.arange(len(where)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        holds[doc[spots], where] = 1
        shared += (holds * weight[fresh[part]]) @ holds.T
    return shared


def tile_links(ids: list[int], sides: np.ndarray, texts: list[str], idf: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between side 0 and side 1, or inside side 0 if that is all."""
    doc, key, weight = elements(texts, idf)
    n = len(texts)
    total = np.bincount(doc, weights=weight, minlength=n)
    both = overlaps(doc, key, weight, n)
    rows, cols = np.nonzero(np.triu(both, 1) > 0)
    inter = both[rows, cols]
    fits = inter >= threshold * (total[rows] + total[cols] - inter) - 1e-9
    if sides.any():
        fits &= sides[rows] != sides[cols]
    links = Links(n)
    links.add(rows[fits], cols[fits])
    return [(ids[i], ids[links.top(i)]) for i in range(n) if links.top(i) != i]


def _verified(members: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """``a, b`` links from ``grp, ta, tb, side, id, text``, one task-local group (grp, ta, tb) after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list) -> pa.RecordBatch:
            found = tile_links([r["id"] for r in rows], np.asarray([r["side"] for r in rows]), [r["text"] for r in rows], idf, threshold)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        held, now = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if (tile := (r["grp"], r["ta"], r["tb"])) != now:
                    if len(held) > 1:
                        yield links(held)
                    held, now = [], tile
                held.append(r)
        if len(held) > 1:
            yield links(held)

    n = partitions(members.sparkSession)
    return members.repartition(n, "grp", "ta", "tb").sortWithinPartitions("grp", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def near_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, class_id`` for every row with an id; ``class_id`` is the smallest ``doc_id`` of its class."""
    idf = document_frequencies(docs)
    rows = materialise(_sketch_rows(docs, idf), "sketches")
    reps = materialise(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "representatives")
    own = rows.join(reps.withColumnsRenamed({"h1": "r1", "h2": "r2"}), (F.col("doc_id") == F.col("rep")) & (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")))
    bands = own.select("rep", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select(F.col("band").alias("k"), "low")
    groups = materialise(components(bands.join(shared, F.col("band") == F.col("k")).select(F.col("rep").alias("a"), F.col("low").alias("b"))), "groups")

    sized = groups.join(own.select("rep", "n"), F.col("id") == F.col("rep")).select("id", F.col("component").alias("grp"), "n")
    blocks = (sized.groupBy(F.col("grp").alias("g")).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n") / BLOCK_WORDS)).cast("int").alias("blocks")))
    placed = (sized.join(blocks, F.col("grp") == F.col("g"))
              .select("id", "grp", "blocks", F.pmod(F.xxhash64(F.lit(23), "id"), F.col("blocks")).cast("int").alias("block")))
    texts = docs.select(F.col("doc_id").alias("d"), "text").join(materialise(placed, "members"), F.col("d") == F.col("id"))
    tiles = (texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("grp", F.least("block", "other").alias("ta"), F.greatest("block", "other").alias("tb"),
                     (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "text"))
    found = components(_verified(tiles, idf, threshold)).withColumnsRenamed({"id": "i", "component": "label"})
    labels = reps.join(found, F.col("rep") == F.col("i"), "left").select("h1", "h2", F.coalesce("label", "rep").alias("class_id"))
    classes = rows.select("doc_id", "h1", "h2").join(labels, ["h1", "h2"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return classes


def near_digest(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per document: ``doc_id, class_id, kept``; documents without words are classes of their own."""
    docs = docs.select("doc_id", "text")
    found = near_classes(docs, threshold).withColumnRenamed("doc_id", "d")
    return (docs.select("doc_id").join(found, F.col("doc_id") == F.col("d"), "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
            .withColumn("kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True))))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id."""
    gone = near_classes(docs, threshold).where("class_id <> doc_id").select(F.col("doc_id").alias("_gone"))
    return wrapped(docs, "doc_id").join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select("_row.*")
