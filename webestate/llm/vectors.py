"""Embedding near-dedup: all pairs at or above a cosine, by int8 tile products with error bounds.

Equal vectors are one class with a count. Classes are dealt into blocks of about ``block`` vectors; every two blocks meet
in one task. There, unit vectors are quantised to int8 with one scale each, and the norm of each vector's quantisation
error is kept. For unit u, v with errors a, b (norms):  u.v <= s_u s_v q_u.q_v + a + b + a b,  so only pairs whose
quantised product can reach the threshold are computed again, in double precision from the given components. Integer
products are exact in the float type that the matrix product uses. A task returns one row per vector with a link: the
number of vectors linked and a member of its spanning forest, never the pairs.

The work is quadratic in the number of distinct vectors, in blocks; memory is one block pair per task.

Cases: null or empty vectors, zero vectors and vectors with null or non-finite components link with nothing and are
their own component; vectors of different length don't link. Rows with equal ``vec_id`` count as separate vectors and
share a component. A row with a null ``vec_id`` links with nothing and is kept. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webestate.llm.common import wide_hash
from webestate.llm.graph import components
from webestate.llm.near import Links
from webestate.session import materialise

STRIP = 512


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and norms of the errors (rounded up)."""
    scale = np.abs(unit).max(1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9) + 1e-12
    return codes, scale, error


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that their squares neither overflow nor vanish; cosines stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0, keepdims=True))[1])


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool):
    """Yield ``rows, cols`` of pairs with cosine >= threshold between the double-precision rows of ``a`` and ``b``."""
    (qa, sa, ea), (qb, sb, eb) = quantised(unit_rows(a)), quantised(unit_rows(b))
    a, b = scaled(a), scaled(b)
    kind = np.float32 if a.shape[1] * 127 * 127 < 2**24 else np.float64
    right, sb32 = np.ascontiguousarray(qb.T.astype(kind)), sb.astype(np.float32)
    slack = (np.float32(eb.max()) if len(eb) else np.float32(0))
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    for at in range(0, len(a), STRIP):
        end = min(at + STRIP, len(a))
        low = at + 1 if same else 0  # a pair inside a block once
        if low >= len(b):
            continue
        product = qa[at:end].astype(kind) @ right[:, low:]
        need = ((threshold - 1e-5 - ea[at:end] * (1 + slack) - slack) / sa[at:end]).astype(np.float32)  # the worst error of b, then its own
        rows, cols = np.nonzero(product * sb32[low:] >= need[:, None])
        rows, cols = rows + at, cols + low
        if same:
            keep = cols > rows
            rows, cols = rows[keep], cols[keep]
        bound = sa[rows] * sb[cols] * np.einsum("ij,ij->i", qa[rows].astype(np.float64), qb[cols].astype(np.float64)) + ea[rows] + eb[cols] + ea[rows] * eb[cols] if len(rows) else np.zeros(0)
        maybe = bound >= threshold - 1e-9
        rows, cols = rows[maybe], cols[maybe]
        for i in range(0, len(rows), 1 << 16):
            r, c = rows[i:i + (1 << 16)], cols[i:i + (1 << 16)]
            exact = np.einsum("ij,ij->i", a[r], b[c]) / (na[r] * nb[c])
            yes = exact >= threshold
            yield r[yes], c[yes]


def _pack(table: pa.Table) -> pa.Table:
    """The vectors of one block and one length as one row."""
    width = table.column("dim")[0].as_py()
    x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    assert len(x) == width * table.num_rows
    cells = {name: pa.array([table.column(name).to_numpy().astype(np.int64).tobytes()], pa.binary()) for name in ("h1", "h2", "rep", "n")}
    return pa.Table.from_arrays([pa.array([width], pa.int32()), table.column("block").cast(pa.int32()).slice(0, 1), *cells.values(), pa.array([x.tobytes()], pa.binary())],
                                names=["dim", "block", *cells, "data"])


def _tile(table: pa.Table, threshold: float) -> pa.Table:
    rows = sorted(table.select(["block", "h1", "h2", "rep", "n", "data", "dim"]).to_pylist(), key=lambda r: r["block"])
    parts = [{k: np.frombuffer(r[k], dtype=np.int64) for k in ("h1", "h2", "rep", "n")} | {"x": np.frombuffer(r["data"]).reshape(-1, r["dim"])} for r in rows]
    first, second, same = parts[0], parts[-1], len(parts) == 1
    size = len(first["rep"])
    offset = 0 if same else size
    total = np.zeros(offset + len(second["rep"]), dtype=np.int64)
    forest = Links(len(total))
    for r, c in linked_pairs(first["x"], second["x"], threshold, same):
        np.add.at(total, r, second["n"][c])
        np.add.at(total, c + offset, first["n"][r])
        forest.add(r, c + offset)
    hit = np.flatnonzero(total)
    col = {k: first[k] if same else np.concatenate((first[k], second[k])) for k in ("h1", "h2", "rep")}
    top = np.asarray([forest.top(i) for i in hit.tolist()], dtype=np.int64)
    return pa.Table.from_arrays([pa.array(col["h1"][hit]), pa.array(col["h2"][hit]), pa.array(total[hit]), pa.array(col["rep"][hit]), pa.array(col["rep"][top])],
                                names=["h1", "h2", "links", "a", "b"])


def vector_links(vectors: DataFrame, threshold: float = 0.9, block: int = 4096) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    e = F.col("embedding")
    usable = F.coalesce((F.size(e) > 0) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = vectors.where(usable & F.col("vec_id").isNotNull())
    high, low = wide_hash("embedding")
    keyed = good.select("vec_id", high.alias("h1"), low.alias("h2"), "embedding")
    classes = materialise(keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")), "vectors")
    count = classes.count()
    blocks = max(1, -(-count // block))
    dealt = classes.withColumns({"dim": F.size("embedding"), "block": F.pmod(F.xxhash64(F.lit(41), "h1"), F.lit(blocks)).cast("int")})
    packed = materialise(dealt.groupBy("dim", "block").applyInArrow(_pack, "dim int, block int, h1 binary, h2 binary, rep binary, n binary, data binary"), "blocks")
    meets = (packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .withColumns({"ta": F.least("block", "other"), "tb": F.greatest("block", "other")}))
    tiles = materialise(meets.groupBy("dim", "ta", "tb").applyInArrow(lambda t: _tile(t, threshold), "h1 bigint, h2 bigint, links bigint, a bigint, b bigint"), "tiles")
    labels = components(tiles.select("a", "b")).withColumnsRenamed({"id": "i", "component": "label"})
    counts = tiles.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    known = (classes.select("h1", "h2", "rep", "n").join(counts, ["h1", "h2"], "left").join(labels, F.col("rep") == F.col("i"), "left")
             .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id")))
    linked = keyed.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~(usable & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
