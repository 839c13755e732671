"""Language identification by the nearest centroid of TF-IDF character n-grams.

Letters are lower-cased, everything else is a boundary; the one-, two- and three-letter grams are hashed into
``DIMS`` features. Keys, addresses and other runs with a digit, ``@`` or ``_`` are left out, unless no letter is left. Document frequencies come from every learnable row. Each language is then clustered (spherical
k-means) on a bounded sample of its rows, ``per_language`` expected rows chosen by a hash of the id, and a document is
compared with all centroids by cosine. A document is rejected if it has no letter or if its best cosine is below the
floor that its language has for texts of its length: ``margin`` times the ``quantile`` of the cosines in that length class
alone. Those come from sampled rows and from pieces of them, one of each shorter class a row, so no short class is thin;
either half of the sample is measured on centroids of the other half. A class longer than every sampled row takes the
floor of the longest one that has some.

Cases: null, empty or letterless text gives ``und``, score 0, rejected. Rows without a language teach nothing. If no row
can teach, every document is ``und``. Ties go to the language that is first in code-point order. Languages are few:
their names, counts and centroids are the only data that pass the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 4096
#: Upper ends of the length classes, in letters, for the rejection floors.
LENGTHS = (16, 64, 256, 1024)
#: Runs that are keys or addresses, not words.
KEYED = re.compile(r"(?<![0-9A-Za-z_@+/=.:%&?#~-])[A-Za-z+/=.:%&?#~-]*+[0-9_@][0-9A-Za-z_@+/=.:%&?#~-]*+", re.ASCII)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to its lower-case letter, 0 for anything that is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for start, end in ((0, 0xD800), (0xE000, 0x32400)):
        for code in range(start, end):
            letter = chr(code)
            if letter.isalpha():
                low = letter.lower()
                table[code] = ord(low) if len(low) == 1 else code
    return table


def gram_counts(text: str | None) -> tuple[np.ndarray, int]:
    """Counts of hashed grams and the number of letters, of words alone where there are any."""
    if not text:
        return np.zeros(DIMS, dtype=np.int64), 0
    counts, n = _gram_counts(plain := KEYED.sub(" ", text))
    return (counts, n) if n or plain == text else _gram_counts(text)


def _gram_counts(text: str) -> tuple[np.ndarray, int]:
    x = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    x = np.concatenate(([0], x, [0])).astype(np.uint32)
    mid, left, right = x[1:-1], x[:-2], x[2:]
    inside = mid > 0
    n = int(inside.sum())
    if n == 0:
        return np.zeros(DIMS, dtype=np.int64), 0
    mid, left, right = mid[inside], left[inside], right[inside]
    one = mid * np.uint32(0x9E3779B1)
    two = (left * np.uint32(0x85EBCA77)) ^ (one + np.uint32(0x27D4EB2F))
    three = (two * np.uint32(0xC2B2AE3D)) ^ (right * np.uint32(0x165667B1))
    return np.bincount(np.concatenate([(h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20) for h in (one, two, three)]), minlength=DIMS), n


def _vectors(texts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts, sizes = zip(*(gram_counts(t) for t in texts), strict=True)
    v = np.log1p(np.asarray(counts, dtype=np.float32)) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1), np.asarray(sizes)


def _clusters(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the mean's nearest row and then the row farthest from all chosen."""
    chosen = [int((v @ v.mean(0)).argmax())]
    near = v @ v[chosen[0]]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    c = v[chosen]
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        c = np.stack([v[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c = c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c.astype(np.float32)


def _pieces(text: str, rng: np.random.Generator) -> list[str]:
    """One piece of ``text`` for each length class that is shorter: whole words, or characters where no blank parts them."""
    parts, glue = (words, " ") if len(words := KEYED.sub(" ", text).split()) > 1 else (list(text), "")
    ends = np.cumsum([len(x) for x in parts])
    out = []
    for low, high in zip((4, *LENGTHS), LENGTHS, strict=False):
        size = int(np.exp(rng.uniform(np.log(low), np.log(high))))
        if len(parts) and ends[-1] > size:
            start = int(rng.integers(np.searchsorted(ends, ends[-1] - size) + 1))
            before = ends[start] - len(parts[start])
            out.append(glue.join(parts[start:int(np.searchsorted(ends, before + size)) + 1]))
    return out


def _floors(texts: list[str], idf: np.ndarray, clusters: int, quantile: float, margin: float) -> np.ndarray:
    """The lowest cosine that passes, of each length class."""
    halves, cosines, kinds = (texts[::2], texts[1::2] or texts), [], []
    rng = np.random.default_rng(len(texts))
    for mine, other in (halves, halves[::-1]):
        c = _clusters(_vectors(other, idf)[0], clusters)
        for text in mine:
            v, sizes = _vectors([text, *_pieces(text, rng)], idf)
            cosines.append((v @ c.T).max(1)[sizes > 0])
            kinds.append(np.searchsorted(LENGTHS, sizes[sizes > 0]))
    best, kind = np.concatenate(cosines), np.concatenate(kinds)
    floors = [float(np.quantile(best[kind == j], quantile)) * margin if (kind == j).any() else None for j in range(len(LENGTHS) + 1)]
    for j in range(1, len(floors)):
        floors[j] = floors[j - 1] if floors[j] is None else floors[j]
    return np.asarray([x or 0.0 for x in floors], dtype=np.float32)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), dtype=np.float32))
    idf: np.ndarray = field(default_factory=lambda: np.zeros(DIMS, dtype=np.float32))
    floors: np.ndarray = field(default_factory=lambda: np.zeros((0, len(LENGTHS) + 1), dtype=np.float32))

    def judge(self, texts) -> pd.DataFrame:
        v, sizes = _vectors(texts, self.idf)
        if not self.languages:
            return pd.DataFrame({"lang_pred": ["und"] * len(v), "score": 0.0, "rejected": True})
        cos = v @ self.centroids.T
        best = cos.argmax(1)
        lang, score = self.owner[best], np.clip(cos[np.arange(len(v)), best].astype(np.float64), 0, 1)
        floor = self.floors[lang, np.searchsorted(LENGTHS, sizes)]
        none = sizes == 0
        names = np.asarray(self.languages, dtype=object)[lang]
        names[none] = "und"
        return pd.DataFrame({"lang_pred": names, "score": np.where(none, 0.0, score), "rejected": none | (score < floor)})


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = 600, clusters: int = 4, quantile: float = 0.01, margin: float = 0.8) -> Model:
    """Learn from rows with a text and a language that are not held out."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                counts, size = gram_counts(text)
                total += counts > 0
                n += size > 0
        yield pd.DataFrame({"gram": np.arange(-1, DIMS), "docs": np.concatenate(([n], total))})

    seen = (learn.select("text").mapInPandas(frequencies, "gram int, docs long")
            .groupBy("gram").agg(F.sum("docs").alias("docs")).toPandas().set_index("gram")["docs"])
    if seen.empty or seen[-1] == 0:
        return Model()
    idf = np.log((1 + seen[-1]) / (1 + seen.drop(-1).sort_index().to_numpy())).astype(np.float32)
    rows = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in rows.items() for x in (lang, min(steps, per_language * steps // n))])
    sample = learn.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(steps)) < share[F.col("lang")])

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        texts = group.sort_values(["doc_id", "text"])["text"].tolist()
        v, sizes = _vectors(texts, idf)
        v, texts = v[sizes > 0], [t for t, n in zip(texts, sizes, strict=True) if n]
        if len(v) == 0:
            return pd.DataFrame({"lang": [], "centroids": [], "floors": []})
        c, floors = _clusters(v, clusters), _floors(texts, idf, clusters, quantile, margin)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "centroids": [c.astype(np.float32).tobytes()], "floors": [floors.tobytes()]})

    found = sorted(sample.groupBy("lang").applyInPandas(centroids, "lang string, centroids binary, floors binary").collect())
    parts = [np.frombuffer(r["centroids"], dtype=np.float32).reshape(-1, DIMS) for r in found]
    return Model([r["lang"] for r in found], np.repeat(np.arange(len(found)), [len(p) for p in parts]) if parts else np.zeros(0, dtype=np.int64),
                 np.concatenate(parts) if parts else np.zeros((0, DIMS), dtype=np.float32), idf,
                 np.stack([np.frombuffer(r["floors"], dtype=np.float32) for r in found]) if parts else np.zeros((0, len(LENGTHS) + 1), dtype=np.float32))


def judge(text: Column, model: Model) -> Column:
    """``struct<lang_pred, score, rejected>`` of a text column."""
    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def call(texts: pd.Series) -> pd.DataFrame:
        if len(texts) == 0:
            return pd.DataFrame({"lang_pred": [], "score": [], "rejected": []})
        return pd.concat([model.judge(texts.iloc[i:i + 256]) for i in range(0, len(texts), 256)], ignore_index=True)

    return call(text)


def keep_known(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that a model learned from ``docs`` rejects."""
    return docs.where(~judge(F.col("text"), fit(docs, **options))["rejected"])


def language_digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, rejected``."""
    docs = docs.select("doc_id", "text", "lang")
    found = docs.withColumn("found", judge(F.col("text"), fit(docs, **options)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score", "found.rejected")
