"""What a text may mean as a time: a span of seconds in UTC.

A text is read twice, upon two defaults that differ in every field. Where the readings differ in the date, the text names no day
and is refused; where they differ in the hour, it names a day without a time and means all of it; else it means one second.
Texts without a zone are in UTC. Names of days and months are words, never a sign of a time.
"""

from __future__ import annotations

from datetime import UTC, datetime

from dateutil import parser
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULTS = (datetime(2000, 1, 1, 0, 0, 0), datetime(2001, 2, 2, 23, 59, 59))
#: Which end of a span an operator compares with.
END = {"<": 0, ">=": 0, "!=": 0, ">": 1, "<=": 1}


def span(text: str) -> tuple[datetime, datetime]:
    """The first and the last second that text may mean; ValueError where it is no date."""
    try:
        first, last = (parser.parse(text.strip("\"'"), default=d) for d in DEFAULTS)
    except (ValueError, TypeError, OverflowError, AttributeError) as e:
        raise ValueError(f"{text!r} is no date") from e
    if (first.year, first.month) != (last.year, last.month) or first.day != last.day:
        raise ValueError(f"{text!r} names no whole date")
    if first.hour == last.hour:
        last = first
    utc = lambda t: (t.astimezone(UTC) if t.tzinfo else t.replace(tzinfo=UTC)).replace(microsecond=0)
    return utc(first), utc(last)


def bound(text: str, operator: str) -> datetime:
    """The second that operator compares with: of a bare day its end after > and <=, else its start."""
    return span(text)[END[operator]]


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Forms of dates besides ISO: what precedes the rest, and which groups are month, day and year. Days and months in digits are read
#: month first, unless the first one can be no month.
_NAME, _DAY, _YEAR = r"([A-Za-z]{3,9})\.?", r"(\d{1,2})(?:st|nd|rd|th)?", r"(\d{4})"
_WEEKDAY = r"^\s*(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
FORMS = (
    (rf"(?i){_WEEKDAY}{_NAME}\s+{_DAY},?\s+{_YEAR}\b,?(.*)$", 1, 2, 3),
    (rf"(?i){_WEEKDAY}{_DAY}[\s-]+{_NAME},?[\s-]+{_YEAR}\b,?(.*)$", 2, 1, 3),
    (rf"^\s*{_YEAR}[/.](\d{{1,2}})[/.](\d{{1,2}})\b,?(.*)$", 2, 3, 1),
    (rf"^\s*(\d{{1,2}})[/.-](\d{{1,2}})[/.-]{_YEAR}\b,?(.*)$", 1, 2, 3),
    (r"^\s*()(\d{4})(\d{2})(\d{2})()$", 3, 4, 2),
)
_CLOCK = r"(?i)^\s*(?:t|at\s)?\s*(\d{1,2})(?::(\d{2}))?(?::(\d{2}))?(?:\.\d+)?\s*(am|pm)?\s*(z|utc|gmt|[+-]\d{2}:?\d{2})?\s*$"


def read(raw: Column) -> Column:
    """The time that a stored text names, to the second, null where it names none: ISO, and the forms of FORMS with a clock or
    without one, names of months in English. Texts without a zone are in the session's."""
    found = [F.date_trunc("second", raw.try_cast("timestamp"))]
    for pattern, month, day, year in FORMS:
        part = lambda i, p=pattern: F.regexp_extract(raw, p, i)
        name = F.lower(F.substring(part(month), 1, 3))
        number = F.array_position(F.array(*map(F.lit, MONTHS)), name)
        m, d = F.when(number > 0, number.cast("int")).otherwise(part(month).try_cast("int")), part(day).try_cast("int")
        swap = (m > 12) & (d <= 12) & part(month).rlike(r"^\d")
        m, d = F.when(swap, d).otherwise(m), F.when(swap, m).otherwise(d)
        rest = part(5 if pattern.endswith("()$") else 4)
        clock = lambda i: F.regexp_extract(rest, _CLOCK, i)  # noqa: B023, E731
        bare = F.trim(rest) == ""
        hour, half = clock(1).try_cast("int"), F.lower(clock(4))
        hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
        told = (clock(2) != "") | (half != "")  # a number alone is no time
        time = F.when(bare, F.lit("00:00:00")).when(told, F.format_string("%02d:%02d:%02d", hour, F.coalesce(clock(2).try_cast("int"), F.lit(0)), F.coalesce(clock(3).try_cast("int"), F.lit(0))))
        zone = F.regexp_replace(F.upper(clock(5)), r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
        day_text = F.format_string("%s-%02d-%02d", part(year), m, d)
        found.append(F.when(raw.rlike(pattern) & m.isNotNull() & d.isNotNull() & time.isNotNull(), F.concat(day_text, F.lit(" "), time, zone).try_cast("timestamp")))
    return F.coalesce(*found)
