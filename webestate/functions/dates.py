"""Dates in running text: formats, ambiguity, labels and places, as native expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words before a date that say what it is.
UPDATED = r"last\s+(?:updated|modified|reviewed|revised)|(?:updated|modified|reviewed|revised)(?:\s+on)?"
DEADLINE = r"deadline|last\s+date|closing\s+date|due\s+date|(?:apply|register|submit)\s+(?:by|before)|valid\s+until|expires(?:\s+on)?|ends\s+on"
COPYRIGHT = r"©|\(c\)|copyright"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"

ISO = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
NUMERIC = r"[0-9]{1,2}(?:/[0-9]{1,2}/|\.[0-9]{1,2}\.|-[0-9]{1,2}-)[0-9]{4}"
DAY_NAMED = rf"[0-9]{{1,2}}(?:st|nd|rd|th)?\s+{MONTH}\.?,?\s+[0-9]{{4}}"
NAMED = rf"{MONTH}\.?\s+(?:[0-9]{{1,2}}(?:st|nd|rd|th)?,?\s+)?[0-9]{{4}}"
LABEL = rf"(?:(?:{UPDATED}|{DEADLINE}|{COPYRIGHT})\s*(?::|-|is|on|of)?\s*)?"
YEARS = rf"(?:{COPYRIGHT})\s*(?:[0-9]{{4}}\s*[-–]\s*)?[0-9]{{4}}"
#: A labelled or bare date, or the years of a copyright line; the longest format first.
MENTION = rf"(?i)(?:{LABEL}\b(?:{ISO}|{NUMERIC}|{DAY_NAMED}|{NAMED})|{YEARS})\b"

#: What a mention is by its label, in order of precedence.
KINDS = (("updated", UPDATED), ("deadline", DEADLINE), ("copyright", COPYRIGHT))


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i)


def _number(text: Column) -> Column:
    return text.try_cast("int")


def _made(year: Column, month: Column, day: Column) -> Column:
    """A date, null if there is no such day."""
    padded = (F.lpad(c.cast("string"), n, "0") for c, n in ((year, 4), (month, 2), (day, 2)))
    return F.concat_ws("-", *padded).try_cast("date")


def mention_fields(raw: Column, day_first: bool = True) -> Column:
    """``kind, day, precision, ambiguous`` of one mention.

    ``day`` is the last day that the mention can mean, null if there is no such day. Of numeric dates that can be read both ways the
    order of ``day_first`` counts, and they are marked; a pair of numbers that only one order allows is not ambiguous.
    """
    kind = F.lit("dated")
    for name, pattern in reversed(KINDS):
        kind = F.when(raw.rlike(rf"(?i)^(?:{pattern})"), name).otherwise(kind)
    iso, numeric = r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", r"([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4})$"
    day_named, named = rf"(?i)([0-9]{{1,2}})(?:st|nd|rd|th)?\s+({MONTH})\.?,?\s+([0-9]{{4}})$", rf"(?i)({MONTH})\.?\s+(?:([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+)?([0-9]{{4}})$"

    def month(name: Column) -> Column:
        return ((F.instr(F.lit(MONTHS), F.lower(F.substring(name, 1, 3))) + 2) / 3).cast("int")

    a, b, y = (_number(_group(raw, numeric, i)) for i in (1, 2, 3))
    ambiguous = (a <= 12) & (b <= 12) & (a != b)
    first = (a > 12) | (F.lit(day_first) & (b <= 12))
    by_number = _made(y, F.when(first, b).otherwise(a), F.when(first, a).otherwise(b))
    has_day = _group(raw, named, 2) != ""
    named_month = _made(_group(raw, named, 3), month(_group(raw, named, 1)), F.when(has_day, _group(raw, named, 2)).otherwise("1"))
    day = (F.when(raw.rlike(iso), _made(*(_group(raw, iso, i) for i in (1, 2, 3))))
           .when(raw.rlike(numeric), by_number)
           .when(raw.rlike(day_named), _made(_group(raw, day_named, 3), month(_group(raw, day_named, 2)), _group(raw, day_named, 1)))
           .when(raw.rlike(named), F.when(has_day, named_month).otherwise(F.last_day(named_month)))
           .otherwise(_made(_group(raw, r"([0-9]{4})$", 1), F.lit("12"), F.lit("31"))))
    exact = raw.rlike(iso) | raw.rlike(numeric) | raw.rlike(day_named) | (raw.rlike(named) & has_day)
    precision = F.when(exact, "day").when(raw.rlike(named), "month").otherwise("year")
    return F.struct(kind.alias("kind"), day.alias("day"), precision.alias("precision"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"))


def date_mentions(text: Column) -> Column:
    """All dates of a text in order, as ``raw`` (label included) and ``at``, its place in code points from 1."""
    raws = F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))
    gaps = F.slice(F.split(text, MENTION, -1), F.lit(1), F.size(raws))
    steps = F.zip_with(raws, gaps, lambda r, g: F.struct(r.alias("raw"), F.length(g).alias("gap")))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<raw:string,at:int>>").alias("out"))
    return F.aggregate(steps, start, lambda s, x: F.struct(
        (s["next"] + x["gap"] + F.length(x["raw"])).alias("next"),
        F.concat(s["out"], F.array(F.struct(x["raw"].alias("raw"), (s["next"] + x["gap"]).alias("at")))).alias("out")), lambda s: s["out"])
