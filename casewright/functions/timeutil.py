"""Date and time functions: Central-time normalisation, parts, comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Chicago"
#: Formats tried in order; a named zone is converted, a naive time is local wall clock.
ZONED = ("yyyy-MM-dd HH:mm:ss VV",)
NAIVE = ("yyyy-MM-dd HH:mm:ss", "yyyyMMdd HHmmss.SSS", "yyyyMMdd HHmmss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyyMMdd")
ZONES = {"PST": "America/Los_Angeles", "PDT": "America/Los_Angeles", "CST": "America/Chicago", "CDT": "America/Chicago"}
#: Zones that only the tolerant grammar reads.
MORE_ZONES = {"EST": "America/New_York", "EDT": "America/New_York", "MST": "America/Denver", "MDT": "America/Denver", "UTC": "UTC", "GMT": "UTC", "Z": "UTC"}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def named_zones(text: Column) -> Column:
    """Zone abbreviations as region names."""
    for short, region in ZONES.items():
        text = F.regexp_replace(text, rf"\b{short}\b", region)
    return text


def central(text: Column) -> Column:
    """Wall clock in US Central as a timestamp without zone; null text is 1900-01-01, nonsense is null.

    What the listed formats miss is read by the tolerant grammar.
    """
    named = named_zones(text)
    zoned = F.coalesce(*(F.to_timestamp_ntz(F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.try_to_timestamp(named, F.lit(f)).cast("timestamp_ntz"))) for f in ZONED))
    naive = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in NAIVE))
    return F.when(text.isNull(), F.lit("1900-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.coalesce(zoned, naive, tolerant(text)))


# --- dates in any order -------------------------------------------------------------------------

_TIME = r"(?i)(?<![\d:])(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,6}))?)?\s*(?:([ap])\.?m\b\.?)?"
_HOUR = r"(?i)(?<![\d:])(\d{1,2})\s*([ap])\.?m\b\.?"
_OFFSET = r"(?<=[\d\sM])(?:UTC|GMT)?([+-]\d{2}):?(\d{2})(?!\d)"
_NAMED = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b"
_YEAR_FIRST = r"(?<!\d)(\d{4})\s*[-/. ]\s*(\d{1,2})\s*[-/. ]\s*(\d{1,2})(?!\d)"
_YEAR_LAST = r"(?<!\d)(\d{1,2})\s*[-/. ]\s*(\d{1,2})\s*[-/., ]\s*(\d{4}|\d{2})(?!\d)"


def _group(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _number(text: Column, pattern: str, group: int) -> Column:
    return _group(text, pattern, group).try_cast("int")


def tolerant(text: Column) -> Column:
    """Wall clock in US Central of a date with an optional time and zone, its parts in any order; null for anything else.

    Read are a month's name with a day and a year, year first (2024/3/5) and year last (3/5/2024: month, then day, unless
    the first is over 12), a time of 12 or 24 hours, a zone's abbreviation or an offset.  Years of two digits are
    1969 to 2068.  Weekdays and other words around are passed over; day, month and year have to be there.
    """
    offset = F.when(_group(text, _TIME, 1).isNotNull() & _group(text, _OFFSET, 1).isNotNull(), F.concat(_group(text, _OFFSET, 1), F.lit(":"), _group(text, _OFFSET, 2)))
    return _bound(F.struct(text.alias("text"), offset.alias("offset")), lambda t: _bound(_time_parts(t), _joined_parts))


def _bound(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _time_parts(t: Column) -> Column:
    """Hour, minute, second and zone of a text, and the text without them."""
    text, offset = t["text"], t["offset"]
    clock = _group(text, _TIME, 1)
    hour = F.coalesce(clock.try_cast("int"), _number(text, _HOUR, 1), F.lit(0))
    half = F.lower(F.coalesce(_group(text, _TIME, 5), F.when(clock.isNull(), _group(text, _HOUR, 2))))
    zone = offset
    for short, region in (ZONES | MORE_ZONES).items():
        zone = F.coalesce(zone, F.when(text.rlike(rf"(?<![A-Za-z]){short}(?![A-Za-z])"), F.lit(region)))
    rest = F.regexp_replace(F.regexp_replace(F.when(offset.isNotNull(), F.regexp_replace(text, _OFFSET, " ")).otherwise(text), _TIME, " "), _HOUR, " ")
    return F.struct(
        rest.alias("rest"), zone.alias("zone"), hour.alias("hour"), half.alias("half"), _number(text, _TIME, 2).alias("minute"), _number(text, _TIME, 3).alias("second"),
        F.rpad(F.coalesce(_group(text, _TIME, 4), F.lit("")), 6, "0").alias("micros"), F.lower(_group(rest, _NAMED, 1)).alias("word"),
    )


def _joined_parts(p: Column) -> Column:
    """The wall clock in US Central of the parts and the date that the rest of the text holds."""
    rest, word, half, hour = p["rest"], p["word"], p["half"], p["hour"]
    hour24 = F.when(half.isNull(), hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(99)
    named_month = F.array_position(F.array(*map(F.lit, MONTHS)), word).cast("int")
    named_year = F.coalesce(_number(rest, r"(?<!\d)(\d{4})(?!\d)", 1), _short_year(_number(rest, r"(?<!\d)\d{1,2}(?:st|nd|rd|th)?\D+(\d{2})(?!\d)", 1)), _short_year(_number(rest, r"'(\d{2})(?!\d)", 1)))
    named_day = _number(rest, r"(?i)(?<![\d'])(\d{1,2})(?:st|nd|rd|th)?(?!\d)", 1)
    named = F.struct(named_year.alias("y"), named_month.alias("m"), named_day.alias("d"))
    front = F.struct(*(_number(rest, _YEAR_FIRST, i).alias(n) for i, n in ((1, "y"), (2, "m"), (3, "d"))))
    first, second, last = _number(rest, _YEAR_LAST, 1), _number(rest, _YEAR_LAST, 2), _group(rest, _YEAR_LAST, 3)
    last_year = F.when(F.length(last) == 4, last.try_cast("int")).otherwise(_short_year(last.try_cast("int")))
    back = F.struct(last_year.alias("y"), F.when(first > 12, second).otherwise(first).alias("m"), F.when(first > 12, first).otherwise(second).alias("d"))
    date = F.when(word.isNotNull(), named).when(rest.rlike(_YEAR_FIRST), front).otherwise(back)

    def clock(d: Column) -> Column:
        whole = F.format_string("%04d-%02d-%02d %02d:%02d:%02d.%s", d["y"], d["m"], d["d"], hour24, F.coalesce(p["minute"], F.lit(0)), F.coalesce(p["second"], F.lit(0)), p["micros"])
        return F.when(d["y"].isNotNull() & d["m"].isNotNull() & d["d"].isNotNull(), F.try_to_timestamp(whole, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))).cast("timestamp_ntz")

    moved = lambda read: F.when(p["zone"].isNull(), read).otherwise(F.to_timestamp_ntz(F.convert_timezone(F.coalesce(p["zone"], F.lit("UTC")), F.lit(ZONE), read)))
    return _bound(_bound(date, clock), moved)


def _short_year(number: Column) -> Column:
    return F.when(number < 69, number + 2000).otherwise(number + 1900)


def date_part(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def time_part(ts: Column) -> Column:
    return F.date_format(ts, "HHmmss.SSS")


def display(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" US-CST"))


def now_central() -> Column:
    """The present moment in US Central as ISO text."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def minutes(text: Column) -> Column:
    """Minutes of ``H:mm`` or ``HH:mm[:ss]``; null for anything else."""
    found = F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})", 1)
    rest = F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})", 2)
    return F.when(found != "", found.try_cast("int") * 60 + rest.try_cast("int"))


def typed_time(text: Column) -> Column:
    """Typed times: blanks and dashes stand for colons."""
    return F.regexp_replace(text, r"[-\s]", ":")


def sheet_date(text: Column) -> Column:
    """The date of ``yyyy-MM-dd[ time]``; null for anything else."""
    return F.split(text, " ")[0].try_cast("date")


def fuzzy(text: Column | str) -> Column:
    """What the tolerant grammar reads, as a timestamp of the session's zone."""
    return tolerant(F.col(text) if isinstance(text, str) else text).cast("timestamp")
