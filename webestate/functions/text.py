"""Text expressions: privacy flags, comparison keys, names, CSV cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webestate.functions.html import SPACE, collapse, trim_all

# Privacy flags and their patterns, in report order.
PRIVACY_PATTERNS = (
    ("possible_email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("possible_indian_mobile_number", r"(?<![\d])(?:\+?91[-\s]?|0)?[6-9](?:[-\s]?\d){9}(?![\d])"),
    ("possible_aadhaar_number", r"(?<![\d])\d{4}[-\s]?\d{4}[-\s]?\d{4}(?![\d])"),
    ("possible_pan_number", r"\b[A-Za-z]{5}[0-9]{4}[A-Za-z]\b"),
    ("possible_long_reference_number", r"(?<![\d])\d{8,}(?![\d])"),
)

PREVIEW_CHARS = 160


def privacy_flags(text: Column) -> Column:
    """Flags in report order. A text without '@' or without digits skips the patterns that need one.
    White space in a pattern is JavaScript's."""
    body = F.coalesce(text, F.lit(""))
    needs = {"possible_email": body.contains("@")}
    digits = body.rlike("[0-9]")
    return F.array_compact(F.array(*(
        F.when(needs.get(flag, digits), F.when(body.rlike(pattern.replace(r"[-\s]", f"[-{SPACE}]")), F.lit(flag))) for flag, pattern in PRIVACY_PATTERNS)))


def merge_flags(first: Column, second: Column) -> Column:
    return F.array_union(first, second)


def normalize_bounded_text(text: Column) -> Column:
    flat = collapse(F.regexp_replace(text, r"<[^>]*>", " "))
    return F.when(flat != "", flat)


def comparison_text(text: Column) -> Column:
    return F.lower(collapse(F.coalesce(text, F.lit(""))))


def duplicate_key(description: Column, themes: Column, occurred_on: Column, free_text: Column) -> Column:
    """The four compared fields as a JSON array of strings."""
    return F.to_json(F.array(
        comparison_text(description),
        F.array_join(F.array_sort(themes), ","),
        F.substring(F.coalesce(occurred_on, F.lit("")), 1, 7),
        comparison_text(free_text),
    ))


def name_tokens(name: Column) -> Column:
    return F.array_distinct(
        F.filter(F.split(F.lower(name), r"[^a-z0-9]+"), lambda t: F.length(t) >= 3)
    )


def names_disagree(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def csv_cell(value: Column) -> Column:
    """Formula guard; quoting and escaping are left to the CSV writer."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def quoted_csv_cell(value: Column) -> Column:
    """The whole cell as text, for exports assembled as lines."""
    guarded = csv_cell(value)
    return F.when(
        guarded.rlike(r'[",\r\n]'),
        F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"')),
    ).otherwise(guarded)


def moderation_preview(text: Column) -> Column:
    return F.when(
        F.length(text) > PREVIEW_CHARS, F.concat(F.substring(text, 1, PREVIEW_CHARS), F.lit("…"))
    ).otherwise(text)


def department_label(department: Column) -> Column:
    flat = trim_all(F.coalesce(department, F.lit("")))
    return F.when(flat != "", flat).otherwise(F.lit("Unspecified"))


def keyed_hash(secret: str, message: Column) -> Column:
    """HMAC-SHA256 in hex from two nested digests; a null message counts as 'unknown'."""
    import hashlib

    key = secret.encode("utf-8")
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    body = F.encode(F.coalesce(message.cast("string"), F.lit("unknown")), "UTF-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256)
