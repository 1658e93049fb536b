"""strptime patterns as Spark expressions that mask the parts a pattern leaves open."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directives and what they determine: fixed values.
YEAR = ("%Y", "%y", "%G", "%c", "%x", "%D", "%F")
MONTH = ("%m", "%b", "%B", "%c", "%x", "%D", "%F")
DAY = ("%d", "%c", "%x", "%D", "%F")
DAY_OF_YEAR = ("%j",)
WEEKS = ("%U", "%W", "%V")
WEEKDAYS = ("%a", "%A", "%w", "%u")
#: Java letters of the directives that Spark parses itself, and their regular expressions.
JAVA = {"%Y": "yyyy", "%m": "M", "%d": "d", "%b": "MMM", "%B": "MMMM", "%y": "yy", "%H": "H", "%M": "m", "%S": "s"}
SHAPE = {"%Y": r"\d{4}", "%m": r"\d{1,2}", "%d": r"\d{1,2}", "%b": r"[A-Za-z]{3}", "%B": r"[A-Za-z]+", "%y": r"\d{2}", "%H": r"\d{1,2}", "%M": r"\d{1,2}", "%S": r"\d{1,2}"}
#: Patterns that are always tried first.
BUILT_IN = ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%SZ")


def directives(pattern: str) -> list[str]:
    """Directives of a pattern; an escaped percent sign is none."""
    return [d for d in re.findall(r"%.", pattern) if d != "%%"]


def determines(pattern: str) -> int:
    """How many of year, month and day a pattern fixes; each counts only after the one before."""
    found = set(directives(pattern))
    fixes = lambda *groups: all(found & set(group) for group in groups)
    place = fixes(DAY_OF_YEAR) or fixes(WEEKS, WEEKDAYS)
    level = 0
    for known in (fixes(YEAR), fixes(MONTH) or place, fixes(DAY) or place):
        if not known:
            break
        level += 1
    return level


def _pieces(pattern: str) -> list[str]:
    return re.findall(r"%.|[^%]+", pattern)


def _native(pattern: str) -> bool:
    return all(d in JAVA for d in directives(pattern))


def _python_parse(pattern: str):
    from datetime import datetime

    @F.pandas_udf("date")
    def parse(values: pd.Series) -> pd.Series:
        def one(value):
            try:
                return datetime.strptime(value, pattern).date()
            except (TypeError, ValueError):
                return None

        return values.map(one)

    return parse


def parsed(value: Column, pattern: str) -> Column:
    """The date of a text by a strptime pattern, or null; parts left open are 1."""
    if not _native(pattern):
        return _python_parse(pattern)(value)
    shape = "".join(SHAPE.get(p, "%" if p == "%%" else re.escape(p)) for p in _pieces(pattern))
    java = "".join(JAVA.get(p, "'%'" if p == "%%" else "'" + p.replace("'", "''") + "'") for p in _pieces(pattern))
    named = {"%b": True, "%B": True}
    text = F.initcap(value) if any(d in named for d in directives(pattern)) else value
    return F.when(value.rlike(f"^{shape}$"), F.try_to_timestamp(text, F.lit(java)).cast("date"))


def masked(date: Column, pattern: str) -> Column:
    """ISO text of a date with XX for what the pattern leaves open."""
    return F.date_format(date, ("'XXXX-XX-XX'", "yyyy'-XX-XX'", "yyyy-MM'-XX'", "yyyy-MM-dd")[determines(pattern)])


def interval(value: Column) -> Column:
    """``Y/Y``, ``Y-m-d/Y-m-d`` and ``[Y TO Y]`` as an ISO interval, or null."""
    years = r"^(?:\[(\d{4}) TO (\d{4})\]|(\d{4})/(\d{4}))$"
    start = F.concat(F.regexp_extract(value, years, 1), F.regexp_extract(value, years, 3))
    end = F.concat(F.regexp_extract(value, years, 2), F.regexp_extract(value, years, 4))
    sides = F.split(value, "/")
    whole = value.rlike(r"^\d{4}-\d{2}-\d{2}/\d{4}-\d{2}-\d{2}$") & F.try_element_at(sides, F.lit(1)).try_cast("date").isNotNull() & F.try_element_at(sides, F.lit(2)).try_cast("date").isNotNull()
    return F.when(value.rlike(years), F.concat(start, F.lit("-01-01/"), end, F.lit("-12-31"))).when(whole, value)


def iso_date(value: Column, patterns: list[str], mask_failures: bool = True) -> Column:
    """The first pattern that fits decides; empty and wholly masked text is XXXX-XX-XX."""
    tried = [F.when(parsed(value, p).isNotNull(), masked(parsed(value, p), p)) for p in [*BUILT_IN, *patterns]]
    failed = F.lit("XXXX-XX-XX") if mask_failures else value
    already = F.when(value.rlike(r"^[\dX]{4}-[\dX]{2}-[\dX]{2}$") & value.contains("XX"), value)
    return F.when(F.trim(value) == "", "XXXX-XX-XX").otherwise(reduce(lambda a, b: F.coalesce(a, b), [*tried, interval(value), already, failed]))
