"""Line dedup: lines that many documents share stay in one of them only.

Hashes of line keys are range-partitioned, sorted by document and position inside a key, and streamed: a window
function marks the first row of each document. A key's rows are salted by document, so a line that a third of all
documents hold is spread over ``salts`` windows. The result is a compressed bitmap per document (64 lines to a word,
only words with a dropped line), not text; :func:`drop_lines` applies it.

Cases: a null or empty text is one empty line and drops nothing. Rows with equal ``doc_id`` count as one document; each
is judged by its own text. A null ``doc_id`` counts as one document below every other. Extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webestate.functions.html import bound
from webestate.llm.common import wide_hash, wrapped

#: ASCII white space that is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else unchanged; ``lower`` does that only for pure ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_mark(text: Column) -> Column:
    """Tells rows of one ``doc_id`` with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, salts: int = 256) -> DataFrame:
    """``doc_id, mark, n_dropped, dropped``: documents that lose a line. ``dropped`` maps a word index to 64 line bits."""
    # Mark and lines are made below the generator, once for each text.
    split = docs.select("doc_id", text_mark(F.col("text")).alias("mark"), text_lines(F.col("text")).alias("lines"))
    lines = split.select("doc_id", "mark", F.posexplode("lines").alias("pos", "line"))
    keys = (lines.where(F.octet_length("line") >= min_chars)
            .select("doc_id", "mark", "pos", F.btrim("line", F.lit(BLANKS)).alias("line"))
            .where(F.length("line") >= min_chars)
            .select("doc_id", "mark", "pos", ascii_lower(F.col("line")).alias("line")))
    high, low = wide_hash("line")
    rows = (keys.select(high.alias("h1"), low.alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "doc_id", "mark", "pos")
            .repartitionByRange("h1", "h2", "salt"))
    stream = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc_id").desc_nulls_last(), "mark", "pos")
    first = (F.row_number().over(stream) == 1) | ~F.lag("doc_id").over(stream).eqNullSafe(F.col("doc_id"))
    frequent = (rows.select("h1", "h2", "salt", "doc_id", first.alias("first")).where("first")
                .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("holders"), F.max("doc_id").alias("keeper"), F.collect_set("salt").alias("salts"))
                .where(F.col("holders") >= min_docs).select("h1", "h2", "keeper", F.explode("salts").alias("salt")))
    gone = rows.join(frequent, ["h1", "h2", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    words = (gone.groupBy("doc_id", "mark", F.shiftright("pos", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")))
    return (words.groupBy("doc_id", "mark")
            .agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
                 F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped")))


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` (without columns of these names) with ``_kept`` (text without the dropped lines), ``_lines`` and ``_gone`` (line counts)."""
    marks = bitmaps.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_m"), F.col("n_dropped").alias("_gone"), F.col("dropped").alias("_bits"))
    joined = docs.withColumn("_mark", text_mark(F.col("text"))).join(
        marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_m")), "left")
    # Words of a text in order, with zeros for those that the map leaves out: made once for each text, then looked up by place.
    given = F.array_sort(F.map_entries("_bits"))
    before = F.concat(F.array(F.lit(-1)), F.transform(given, lambda e: e["key"]))
    words = F.flatten(F.transform(F.arrays_zip(given.alias("e"), F.slice(before, F.lit(1), F.size(given)).alias("p")), lambda x: F.concat(
        F.array_repeat(F.lit(0).cast("long"), x["e"]["key"] - x["p"] - 1), F.array(x["e"]["value"]))))
    stays = bound(words, lambda w: F.filter(text_lines(F.col("text")), lambda line, i: (
        F.coalesce(F.get(w, F.shiftright(i, 6)), F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) == 0)))
    return (joined.withColumn("_lines", F.size(text_lines(F.col("text"))).cast("long"))
            .withColumn("_kept", F.when(F.col("_bits").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stays, "\n")))
            .withColumn("_gone", F.coalesce("_gone", F.lit(0)).cast("long"))
            .drop("_id", "_m", "_mark", "_bits"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its columns; a text that loses no line is unchanged, null included."""
    kept = drop_lines(wrapped(docs, "doc_id", "text"), line_bitmaps(docs, **options))
    text = F.when(F.col("_gone") > 0, F.col("_kept")).otherwise(F.col("text"))
    return kept.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def line_digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, kept_sha256``."""
    docs = docs.select("doc_id", "text")
    kept = drop_lines(docs, line_bitmaps(docs, **options))
    return kept.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))
