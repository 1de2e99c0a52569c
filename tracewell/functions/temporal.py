"""Dates and times as evidence writes them: the pattern, and a canonical form with its precision. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How dates, times and vague times are written.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAMES = "january|february|march|april|may|june|july|august|september|october|november|december|sept|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
WEEKDAY = r"(?:(?:Mon|Tues?|Wed(?:nes)?|Thu(?:rs)?|Fri|Sat(?:ur)?|Sun)(?:day)?\.?,?\s+)"
DATE = rf"(?:{WEEKDAY}?\d{{1,2}}\s+(?:{MONTH_NAMES})\.?,?\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[-/]\d{{1,2}}[-/](?:\d{{4}}|\d{{2}}))"
CUE = r"(?:approximately|approx\.?|around|about|roughly|~)\s*"
TIME = r"\d{1,2}:\d{2}(?:\s*(?:[AaPp]\.\s?[Mm]\.|[AaPp][Mm])(?![A-Za-z]))?"
TEMPORAL = rf"(?i)(?=[\dmtwfsar~])(?<![\w:/-])(?:{DATE}(?:,\s*|\s+)(?:at\s+)?(?:{CUE})?{TIME}|{DATE}|(?:{CUE})?{TIME})(?![\w:]|[-/]\d)"
ZONE = "+05:30"
# The parts of a date by name, by numbers with the day first and as ISO has it, and of a time.
NAMED_DATE = rf"(?i)^{WEEKDAY}?(\d{{1,2}})\s+([A-Za-z]+)\.?,?\s+(\d{{4}})"
NUMERIC_DATE = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4}|\d{2})(?!\d)"
ISO_DATE = r"^(\d{4}-\d{2}-\d{2})"
CLOCK = r"(?i)(?<![\d:])(\d{1,2}):(\d{2})(?:\s*([ap])\.?\s?m\.?)?$"


def _date(text: Column) -> Column:
    """``yyyy-MM-dd`` of the date a text starts with; null if there is no such day."""
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(text, NAMED_DATE, 2), 1, 3)))
    short = F.regexp_extract(text, NUMERIC_DATE, 3)
    year = F.when(F.length(short) == 2, F.concat(F.when(short <= "69", "20").otherwise("19"), short)).otherwise(short)
    parts = (
        F.when(text.rlike(NAMED_DATE), F.concat_ws("-", F.regexp_extract(text, NAMED_DATE, 3), month.cast("string"), F.regexp_extract(text, NAMED_DATE, 1)))
        .when(text.rlike(ISO_DATE), F.regexp_extract(text, ISO_DATE, 1))
        .when(text.rlike(NUMERIC_DATE), F.concat_ws("-", year, F.regexp_extract(text, NUMERIC_DATE, 2), F.regexp_extract(text, NUMERIC_DATE, 1)))
    )
    return F.date_format(F.try_to_timestamp(parts, F.lit("y-M-d")), "yyyy-MM-dd")


def _clock(text: Column) -> Column:
    """``HH:mm`` of the time a text ends with; null if there is no such time."""
    hour, minute, half = F.regexp_extract(text, CLOCK, 1).try_cast("int"), F.regexp_extract(text, CLOCK, 2).try_cast("int"), F.lower(F.regexp_extract(text, CLOCK, 3))
    full = F.when((half != "") & hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)).when((half == "") & (hour <= 23), hour)
    return F.when(minute <= 59, F.concat(F.lpad(full.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")))


def canonical(raw: Column) -> Column:
    """The ``value`` of ``normalize`` alone."""

    def of(text):
        parts = F.struct(text.rlike(rf"(?i)^{DATE}").alias("dated"), text.rlike(rf"(?i){TIME}$").alias("timed"), text.alias("text"))
        day, clock = lambda x: _date(x["text"]), lambda x: _clock(x["text"])
        value = lambda x: F.when(x["dated"] & x["timed"], F.concat(day(x), F.lit("T"), clock(x), F.lit(ZONE))).when(x["dated"], day(x)).when(x["timed"], F.concat(F.lit("T"), clock(x)))
        return F.transform(F.array(parts), value)[0]

    return F.transform(F.array(F.regexp_replace(F.trim(raw), r"\s+", " ")), of)[0]


def normalize(raw: Column) -> Column:
    """``(value, kind, precision, at)``: canonical text, DATETIME, DATE or TIME, how exact, and the instant of a full one; null if invalid."""
    text = F.regexp_replace(F.trim(raw), r"\s+", " ")
    has_date, has_time = text.rlike(rf"(?i)^{DATE}"), text.rlike(rf"(?i){TIME}$")
    day, clock = _date(text), _clock(text)
    precision = F.when(has_time & text.rlike(rf"(?i)(?:^|[\s,]){CUE}\d"), "APPROXIMATE").otherwise("EXACT")
    both = F.concat(day, F.lit("T"), clock, F.lit(ZONE))
    make = lambda value, kind: F.struct(value.alias("value"), F.lit(kind).alias("kind"), precision.alias("precision"), F.try_to_timestamp(F.when(F.lit(kind) == "DATETIME", value), F.lit("yyyy-MM-dd'T'HH:mmXXX")).alias("at"))
    return (
        F.when(has_date & has_time & both.isNotNull(), make(both, "DATETIME"))
        .when(has_date & ~has_time & day.isNotNull(), make(day, "DATE"))
        .when(~has_date & has_time & clock.isNotNull(), make(F.concat(F.lit("T"), clock), "TIME"))
    )
