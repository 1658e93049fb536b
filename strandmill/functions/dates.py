"""Dates as expressions: decimal years, ambiguous dates, ranges, ISO weeks.

A parsed date is a struct ``lo, hi, exact`` of decimal years; unknown dates are
null. Missing text is the empty string. ``today`` caps ambiguous dates and is
always a parameter, so plans are repeatable.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of date text: fixed patterns.
ISO = r"^\d{4}-\d{2}-\d{2}$"
LENIENT = r"^\d{1,4}-0*\d{1,2}-0*\d{1,2}$"
AMBIGUOUS = r"^[\dX]{4}-[\dX]{1,2}-[\dX]{1,2}$"
DECIMAL = r"^-?\d+\.\d+$"
YEAR = r"^\d{1,4}$"
YEAR_MONTH = r"^\d{1,4}-\d{1,2}$"
_DURATION = re.compile(r"P?(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?$", re.IGNORECASE)


def decimal_year(date: Column) -> Column:
    """Year plus the middle of the day as a share of the year's days."""
    year = F.year(date)
    return year + (F.dayofyear(date) - F.lit(0.5)) / F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def decimal_year_of(date: dt.date) -> float:
    """``decimal_year`` for a date on the driver."""
    days = 366 if date.year % 4 == 0 and (date.year % 100 != 0 or date.year % 400 == 0) else 365
    return date.year + (date.timetuple().tm_yday - 0.5) / days


def coarse_decimal_year(date: Column) -> Column:
    """The other convention: months as twelfths, days over 365.25; distances use it."""
    return F.year(date) + (F.month(date) - 1) / F.lit(12.0) + (F.dayofmonth(date) - 1) / F.lit(365.25)


def date_of_decimal_year(value: Column) -> Column:
    """First day whose share of the year reaches the fraction."""
    year = F.floor(value).cast("int")
    days = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), F.floor((value - year + F.lit(1e-10)) * days).cast("int"))


def bound(value: str | float, today: dt.date | None = None) -> float:
    """A limit given by a user: a decimal year, a date, or a duration before today."""
    text = str(value)
    try:
        return float(text)
    except ValueError:
        pass
    try:
        return decimal_year_of(dt.date.fromisoformat(text))
    except ValueError:
        pass
    match = _DURATION.match(text)
    if not match or not any(match.groups()):
        raise ValueError(f"unable to determine date from {text!r}")
    years, months, weeks, days = (int(g or 0) for g in match.groups())
    today = today or dt.date.today()
    total = today.year * 12 + today.month - 1 - 12 * years - months
    last = (dt.date(total // 12 + (total % 12 == 11), (total + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    start = dt.date(total // 12, total % 12 + 1, min(today.day, last))
    return decimal_year_of(start - dt.timedelta(weeks=weeks, days=days))


def _date(year: Column, month: Column, day: Column) -> Column:
    """Clamp the month to 1..12 and the day to the month's days."""
    month = F.least(F.greatest(month, F.lit(1)), F.lit(12))
    first = F.make_date(F.greatest(year, F.lit(1)), month, F.lit(1))
    last = F.dayofmonth(F.last_day(first))
    return F.date_add(first, F.least(F.greatest(day, F.lit(1)), last) - 1)


def _ambiguous(text: Column, fill: str, low_year: int | None, high_year: int | None) -> Column:
    parts = F.split(F.translate(text, "X", fill), "-")
    year = F.element_at(parts, 1).try_cast("int")
    if low_year is not None:
        year = F.greatest(year, F.lit(low_year))
    if high_year is not None:
        year = F.least(year, F.lit(high_year))
    return _date(year, F.element_at(parts, 2).try_cast("int"), F.element_at(parts, 3).try_cast("int"))


def well_formed_ambiguity(text: Column) -> Column:
    """Only less significant parts may be unknown: no known day in an unknown month."""
    parts = F.split(text, "-")
    year, month, day = (F.element_at(parts, i) for i in (1, 2, 3))
    whole = lambda p: p.rlike("^X+$")
    return (~year.contains("X") | (whole(month) & whole(day))) & (~month.contains("X") | whole(day))


def ambiguity_error(text: Column) -> Column:
    """What is wrong with a date of digits and X: ``year`` or ``month`` where that part is
    unknown and a less significant one is not, else null."""
    parts = F.split(text, "-")
    year, month, day = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    vague = text.contains("X") & text.rlike(AMBIGUOUS)
    return F.when(vague & year.contains("X") & ((month != "XX") | (day != "XX")), "year").when(vague & ~year.contains("X") & month.contains("X") & (day != "XX"), "month")


def checked_ambiguity(text: Column) -> Column:
    """The text; a date whose unknown part is followed by a known one fails the job."""
    wrong = ambiguity_error(text)
    return F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("date "), text, F.lit(": its "), wrong, F.lit(" is unknown, so less significant parts must be too")))).otherwise(text)


def date_range(text: Column, today: dt.date, low_year: int | None = None, high_year: int | None = None) -> Column:
    """``struct<lo: date, hi: date, exact: boolean, number: double>`` of a date text, or null.

    Tried in order: the wholly unknown date; ISO; ambiguous; decimal year; year;
    year and month (clamped); lenient year-month-day; ``from/to``.
    """
    limit = F.lit(today)
    number = lambda kind: F.lit(None).cast("double") if kind is None else kind

    def entry(lo: Column, hi: Column, exact: bool, value: Column | None = None) -> Column:
        return F.struct(lo.cast("date").alias("lo"), hi.cast("date").alias("hi"), F.lit(exact).alias("exact"), number(value).alias("number"))

    parts = F.split(text, "-")
    numbers = [F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3)]
    start_end = F.split(text, "/")
    iso = text.try_cast("date")
    day = _date(*numbers)
    real = (numbers[1].between(1, 12)) & (numbers[2].between(1, 31)) & (F.dayofmonth(day) == numbers[2])
    low, high = _ambiguous(text, "0", low_year, high_year), _ambiguous(text, "9", low_year, high_year)
    year = text.try_cast("int")
    pair = [F.try_element_at(start_end, F.lit(i)) for i in (1, 2)]
    ends = [p.try_cast("date") for p in pair]
    nothing = F.lit(None)
    return (
        F.when(text.isin("XXXX-XX-XX", ""), nothing)
        .when(text.rlike(ISO), F.when(iso.isNotNull(), entry(iso, iso, True)))
        .when(text.contains("X") & text.rlike(AMBIGUOUS), F.when(well_formed_ambiguity(text), entry(F.least(low, limit), F.least(high, limit), False)))
        .when(text.rlike(DECIMAL), entry(F.lit(None), F.lit(None), True, text.try_cast("double")))
        .when(text.rlike(YEAR), entry(_date(year, F.lit(1), F.lit(1)), F.least(_date(year, F.lit(12), F.lit(31)), limit), False))
        .when(text.rlike(YEAR_MONTH), entry(_date(numbers[0], numbers[1], F.lit(1)), F.least(_date(numbers[0], numbers[1], F.lit(31)), limit), False))
        .when(text.rlike(LENIENT), F.when(real, entry(day, day, True)))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}/\d{4}-\d{2}-\d{2}$"), F.when(ends[0] <= ends[1], entry(ends[0], ends[1], False)))
    )


def numeric_range(text: Column, today: dt.date, low_year: int | None = None, high_year: int | None = None) -> Column:
    """``struct<lo: double, hi: double, exact: boolean>`` of decimal years, or null."""
    found = date_range(text, today, low_year, high_year)
    one = F.transform(
        F.array(found),
        lambda r: F.when(
            r.isNotNull(),
            F.struct(
                F.coalesce(r["number"], decimal_year(r["lo"])).alias("lo"),
                F.coalesce(r["number"], decimal_year(r["hi"])).alias("hi"),
                r["exact"].alias("exact"),
            ),
        ),
    )
    return F.element_at(one, 1)


def calendar_parts(text: Column, today: dt.date) -> Column:
    """``struct<year, month, day>``; a part is null where the ends of the range differ in it."""
    found = date_range(text, today)

    def parts(r: Column) -> Column:
        lo = F.coalesce(r["lo"], date_of_decimal_year(r["number"]))
        hi = F.coalesce(r["hi"], date_of_decimal_year(r["number"]))
        year, month = F.year(lo) == F.year(hi), F.month(lo) == F.month(hi)
        return F.when(
            r.isNotNull(),
            F.struct(
                F.when(year, F.year(lo)).alias("year"),
                F.when(year & month, F.month(lo)).alias("month"),
                F.when(lo == hi, F.dayofmonth(lo)).alias("day"),
            ),
        )

    return F.element_at(F.transform(F.array(found), parts), 1)


def is_ambiguous(text: Column, by: str = "any", today: dt.date = dt.date(2100, 1, 1)) -> Column:
    """Whether a year, month or day (or any part) is unknown; an unknown month makes
    the day unknown too, and text that is no date is ambiguous in every part."""
    parts = calendar_parts(text, today)
    known = {"year": parts["year"], "month": parts["month"], "day": parts["day"], "any": parts["day"]}[by]
    return parts.isNull() | known.isNull()


def iso_week(date: Column) -> Column:
    """ISO year and week, YYYY-WW."""
    return F.format_string("%04d-%02d", F.extract(F.lit("YEAROFWEEK"), date), F.weekofyear(date))


def backwards_pivots(start: float, end: float, months: int) -> list[float]:
    """Decimal years from ``end`` back to ``start`` in steps of months, ascending, 4 digits."""
    year = int(end)
    days = 366 if year % 4 == 0 and (year % 100 != 0 or year % 400 == 0) else 365
    day = dt.date(year, 1, 1) + dt.timedelta(days=int((end - year + 1e-10) * days))
    out, step = [], 0
    while True:
        total = day.year * 12 + day.month - 1 - step * months
        last = (dt.date(total // 12 + (total % 12 == 11), (total + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
        value = decimal_year_of(dt.date(total // 12, total % 12 + 1, min(day.day, last)))
        if value < start:
            return out[::-1]
        out.append(round(value, 4))
        step += 1
