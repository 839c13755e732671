"""Listing scans with a reject channel: CSV, JSON and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webestate.functions.html import trim_all
from webestate.operators.links import extract_links

# Reject reasons.
NO_NAME, NO_URL = "row missing a usable 'name'", "row missing a usable 'url'"
EMPTY_HREF, NO_LINK_TEXT = "empty href attribute", "anchor has a href but no usable link text for a name"

NOT_AN_OBJECT = "entry is not an object"

# Portal types a listing may state.
PORTAL_TYPES = ("information", "transactional", "directory", "mixed", "unknown")


def split_rejects(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    tagged = df.withColumn("reject_reason", reason)
    return tagged.filter("reject_reason IS NULL").drop("reject_reason"), tagged.filter("reject_reason IS NOT NULL")


def blank(column: str) -> Column:
    return trim_all(F.coalesce(F.col(column), F.lit(""))) == ""


def missing_field() -> Column:
    """The name is looked at before the url."""
    return F.when(blank("name"), NO_NAME).when(blank("url"), NO_URL)


def read_listing_csv(spark: SparkSession, path: str, source_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows with name and url, and the rows refused. Header names are trimmed and lower-cased."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = raw.toDF(*(c.strip().lower() for c in raw.columns))
    for needed in ("name", "url"):
        if needed not in named.columns:
            raise ValueError(f"listing has no column {needed}")
    for optional in ("department", "notes"):
        if optional not in named.columns:
            named = named.withColumn(optional, F.lit(None).cast("string"))
    rows = named.select(*(trim_all(F.col(c)).alias(c) for c in ("name", "url", "department", "notes")), F.lit(source_id).alias("source_id"))
    rows = rows.filter(F.coalesce("name", "url", "department", "notes").isNotNull())
    return split_rejects(rows, missing_field())


def read_listing_json(texts: DataFrame, column: str, source_id: str) -> tuple[DataFrame, DataFrame]:
    """Entries of a top-level array or of {"entries": [...]}, and the entries refused."""
    doc = F.when(F.trim(F.col(column)).startswith("["), F.col(column)).otherwise(F.get_json_object(column, "$.entries"))
    rows = texts.select(F.posexplode(F.from_json(doc, "array<variant>")).alias("pos", "entry"))
    entry = F.col("entry")

    def text(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(entry, f"$.{name}", "variant"))
        return F.when(kind == "STRING", trim_all(F.try_variant_get(entry, f"$.{name}", "string")))

    is_object = F.schema_of_variant(entry).startswith("OBJECT")
    all_text = F.schema_of_variant(F.try_variant_get(entry, "$.tags", "variant")) == "ARRAY<STRING>"
    kind = text("portalType")
    out = rows.select(
        "pos", F.lit(source_id).alias("source_id"), text("name").alias("name"), text("url").alias("url"), text("department").alias("department"),
        F.when(kind.isin(*PORTAL_TYPES), kind).alias("portal_type"),
        F.when(all_text, F.try_variant_get(entry, "$.tags", "array<string>")).alias("tags"), is_object.alias("is_object"))
    return split_rejects(out, F.when(~F.col("is_object"), NOT_AN_OBJECT).otherwise(
        F.replace(missing_field(), F.lit("row missing"), F.lit("entry missing"))))


def read_listing_html(pages: DataFrame, url: str = "url", body: str = "html", key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """Every anchor of a page as a candidate: link text as name, raw href as url."""
    rows = extract_links(pages, url, body, key, keep_empty=True).select(key, "pos", F.col("anchor_text").alias("name"), F.col("raw_href").alias("url"))
    return split_rejects(rows, F.when(blank("url"), EMPTY_HREF).when(blank("name"), NO_LINK_TEXT))
