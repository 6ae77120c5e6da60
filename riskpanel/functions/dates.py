"""Dates and periods. A period is named by its last day, so a year is its December 31."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, functions as F

from .text import first_part

# Period -> step between two period ends.
PERIOD_STEPS = {
    "year": "INTERVAL 1 YEAR",
    "quarter": "INTERVAL 3 MONTH",
    "month": "INTERVAL 1 MONTH",
    "week": "INTERVAL 7 DAY",
    "day": "INTERVAL 1 DAY",
}

# The first three letters of English month names, in order.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_TAIL = r"(|[T\s].*)$"
# Shapes other than year-month-day, and how they are rewritten to it. Two-digit years are 1969 to 2068.
_SHAPES = (
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})" + _TAIL, "$1-$2-$3$4"),
    (r"^(\d{4})(\d{2})(\d{2})[T\s]?(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6"),
    (r"^(\d{4})(\d{2})(\d{2})" + _TAIL, "$1-$2-$3$4"),
    (r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})" + _TAIL, "$3-$1-$2$4"),
    (r"^(\d{1,2})[/-](\d{1,2})[/-]([0-5]\d|6[0-8])" + _TAIL, "20$3-$1-$2$4"),
    (r"^(\d{1,2})[/-](\d{1,2})[/-](69|[7-9]\d)" + _TAIL, "19$3-$1-$2$4"),
)
_DAY_NAME = r"(?i)^(?:[a-z]{3,9},?\s+)?(\d{1,2})[-/\s]([a-z]{3,9})\.?[-/,\s]+(\d{4}|\d{2})" + _TAIL
_NAME_DAY = r"(?i)^(?:[a-z]{3,9},\s+)?([a-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})" + _TAIL
_HALF_DAY = r"(?i)^(\S+)[T\s]+(\d{1,2})(?::(\d{2}))?(?::(\d{2}))?(?:\.(\d+))?\s*([ap])\.?m\.?$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def date_text(value: Column | str) -> Column:
    """Date part of a ``date time`` text."""
    return first_part(value, " ")


_DIGITS = {"yyyy": r"\d{4}", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}",
           "M": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}"}


def format_shape(fmt: str) -> str:
    """Regular expression for the texts a date format can read."""
    shape = ""
    for piece in re.findall(r"yyyy|MM?|dd?|HH?|mm|ss|'[^']*'|.", fmt):
        shape += _DIGITS.get(piece) or re.escape(piece.strip("'"))
    return f"^{shape}$"


def _month(name: Column) -> Column:
    """Number of a month name; null for other words."""
    place = F.position(F.lower(F.substring(name, 1, 3)), F.lit(MONTHS))
    return F.when((place > 0) & (place % 3 == 1), ((place + 2) / 3).cast("int"))


def _full_year(year: Column) -> Column:
    short = year.cast("int")
    return F.when(F.length(year) == 4, short).otherwise(F.when(short < 69, short + 2000).otherwise(short + 1900))


def _year_first(text: Column) -> Column:
    """A date text of any known shape with its day written as year-month-day."""
    named = []
    for pattern, (day, month, year) in ((_DAY_NAME, (1, 2, 3)), (_NAME_DAY, (2, 1, 3))):
        part = lambda k: F.regexp_extract(text, pattern, k)  # noqa: B023, E731
        day_text = F.concat_ws("-", _full_year(part(year)).cast("string"), _month(part(month)).cast("string"), part(day))
        named.append(F.when(text.rlike(pattern) & _month(part(month)).isNotNull(), F.concat(day_text, part(4))))
    numbered = [F.when(text.rlike(shape), F.regexp_replace(text, shape, new)) for shape, new in _SHAPES]
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text).otherwise(F.coalesce(*numbered, *named))


def _whole_day(text: Column) -> Column:
    """Times with AM or PM on the 24-hour clock."""
    part = lambda k: F.regexp_extract(text, _HALF_DAY, k)
    hour = part(2).cast("int")
    valid = hour.between(1, 12)
    clock = F.format_string(
        "%s %02d:%s:%s.%s", part(1), hour % 12 + F.when(F.lower(part(6)) == "p", 12).otherwise(0),
        *[F.when(part(k) == "", zero).otherwise(part(k)) for k, zero in ((3, "00"), (4, "00"), (5, "0"))],
    )
    return F.when(text.rlike(_HALF_DAY), F.when(valid, clock)).otherwise(text)


def parse_timestamp(value: Column | str, formats: Sequence[str] = ()) -> Column:
    """Moment of a text as written, without a time zone; null when no shape fits (see ``count_rejects``).

    Reads year-month-day with ``-``, ``/`` or nothing between, month/day/year
    with two- or four-digit years, and days with English month names; after a
    blank or ``T`` a time with optional seconds, fraction, AM or PM, and zone.
    A zone is not applied: the clock time stays as written, whatever the
    session's own zone. ``formats`` are further patterns, tried last.
    """

    def read(text: Column) -> Column:
        known = _let(_let(_let(text, _year_first), _whole_day), _moment)
        return F.coalesce(known, *[F.to_timestamp_ntz(_fitting(text, f), F.lit(f)) for f in formats]) if formats else known

    return _let(F.trim(_col(value).cast("string")), read)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, so that nested steps do not multiply the expression."""
    return F.get(F.transform(F.array(value), use), 0)


def _moment(clock: Column) -> Column:
    """Moment of a text that starts with year-month-day; a comma before the fraction and a blank before the zone are read too."""
    clock = F.regexp_replace(clock, r"(:\d{2}),(\d)", "$1.$2")
    clock = F.regexp_replace(clock, r"\s+(Z|UTC|GMT|[+-]\d{2}:?\d{2})$", "$1")
    clock = F.regexp_replace(clock, r"(:\d{2}[^-+]*[+-]\d{2})(\d{2})$", "$1:$2")
    day_only = r"^\d{4}-\d{1,2}-\d{1,2}$"
    return _let(clock, lambda c: F.when(c.rlike(day_only), c.try_cast("date").cast("timestamp_ntz")).otherwise(c.try_cast("timestamp_ntz")))


def _fitting(text: Column, fmt: str) -> Column:
    """The text where a further format can read it, else null."""
    return F.when(text.rlike(format_shape(fmt)) & F.try_to_timestamp(text, F.lit(fmt)).isNotNull(), text)


def parse_date(value: Column | str, formats: Sequence[str] = ()) -> Column:
    """Day of a text, with or without a time; null when no shape fits (see ``count_rejects``)."""
    return parse_timestamp(value, formats).cast("date")


def count_rejects(raw: Column | str, parsed: Column | str) -> Column:
    """Aggregate: number of texts that were present but could not be parsed."""
    return F.count_if(_col(raw).isNotNull() & _col(parsed).isNull()).cast("bigint")


def year_end(year: Column | str) -> Column:
    return F.make_date(_col(year).cast("int"), F.lit(12), F.lit(31))


def period_end(value: Column | str, period: str = "year") -> Column:
    """Last day of the period that holds the date (weeks end on Sunday)."""
    day = _col(value).cast("date")
    if period == "year":
        return year_end(F.year(day))
    if period == "quarter":
        return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    if period == "month":
        return F.last_day(day)
    if period == "week":
        return F.date_add(F.trunc(day, "week"), 6)
    if period == "day":
        return day
    raise ValueError(f"unknown period {period!r}; choose one of {sorted(PERIOD_STEPS)}")


def period_range(first: Column, last: Column, period: str = "year") -> Column:
    """Array of all period ends from ``first`` to ``last``, empty periods included."""
    if period in ("week", "day"):
        return F.sequence(first, last, F.expr(PERIOD_STEPS[period]))
    # Step over first days, then take the period end, so that month lengths never drift.
    starts = F.sequence(
        F.trunc(first, period), F.trunc(last, period), F.expr(PERIOD_STEPS[period])
    )
    return F.transform(starts, lambda start: period_end(start, period))


# Months per period, for stepping on the driver.
_PERIOD_MONTHS = {"year": 12, "quarter": 3, "month": 1}


def next_period_end(end: date, period: str) -> date:
    """The period end after a period end."""
    if period not in _PERIOD_MONTHS:
        return end + timedelta(days={"week": 7, "day": 1}[period])
    months = end.year * 12 + end.month + _PERIOD_MONTHS[period]
    # The first day after the next period, minus one day.
    return date(months // 12, months % 12 + 1, 1) - timedelta(days=1)
