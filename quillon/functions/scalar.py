"""Column builders for arithmetic, logic, text and dates, where the semantics differ from the built-ins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import InvalidOperation, TypeMismatch

NAN, INF = float("nan"), float("inf")


def _num(x: Column | float | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


# Arithmetic: doubles by IEEE rules, nulls pass through, nothing raises.


def add(a: Column, b: Column | float) -> Column:
    return _num(a) + _num(b)


def sub(a: Column, b: Column | float) -> Column:
    return _num(a) - _num(b)


def mul(a: Column, b: Column | float) -> Column:
    return _num(a) * _num(b)


def fdiv(a: Column, b: Column | float) -> Column:
    """IEEE division: x/0 is an infinity of x's sign, 0/0 is NaN."""
    x, y = _num(a), _num(b)
    zero = F.when((x == 0) | F.isnan(x), F.lit(NAN)).otherwise(F.signum(x) * F.lit(INF))
    return F.when(x.isNotNull() & (y == 0), zero).otherwise(x / F.when(y != 0, y))


def fmod(a: Column, b: Column | float) -> Column:
    """Remainder with the dividend's sign; x % 0 is NaN."""
    x, y = _num(a), _num(b)
    return F.when(x.isNotNull() & (y == 0), F.lit(NAN)).otherwise(x % F.when(y != 0, y))


def power(a: Column, b: Column | float) -> Column:
    return F.pow(_num(a), _num(b))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves toward positive infinity (-2.5 -> -2)."""
    scale = float(10**digits)
    return F.floor(_num(x) * scale + 0.5).cast("double") / scale


def strict_and(a: Column, b: Column) -> Column:
    """AND that is null as soon as one side is."""
    return F.when(a.isNotNull() & b.isNotNull(), a & b)


def strict_or(a: Column, b: Column) -> Column:
    """OR that is null as soon as one side is."""
    return F.when(a.isNotNull() & b.isNotNull(), a | b)


# Text.


def trim(x: Column) -> Column:
    """Without any Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)\A[\s﻿]+|[\s﻿]+\z", "")


def replace_all(x: Column, pattern: str, replacement: str) -> Column:
    """Every literal occurrence; an empty pattern changes nothing."""
    return F.replace(x, F.lit(pattern), F.lit(replacement)) if pattern else x


def text_slice(x: Column, start: int, end: int | None = None) -> Column:
    """Characters [start, end) from 0; negative places count from the end."""
    n = F.length(x)

    def place(k: int) -> Column:
        return F.greatest(n + k, F.lit(0)) if k < 0 else F.least(F.lit(k), n)

    first, last = place(start), n if end is None else place(end)
    return F.substring(x, first + 1, F.greatest(last - first, F.lit(0)))


def split(x: Column, separator: str) -> Column:
    """On a literal separator; all trailing empty parts are kept."""
    return F.split(x, re.sub(r"([^A-Za-z0-9 ])", r"\\\1", separator), -1)


def pad_start(x: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(x) < width, F.lpad(x, width, fill)).otherwise(x)


def pad_end(x: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(x) < width, F.rpad(x, width, fill)).otherwise(x)


def extract(x: Column, pattern: str) -> Column:
    """The pattern's first group, null without a match."""
    if not re.search(r"(?<!\\)\((?!\?[:=!<])|\(\?P?<[A-Za-z]", pattern):
        raise TypeMismatch("the pattern has no capture group")
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1))


# Dates; times are taken in the session's zone, which the engine sets to UTC.

DATE_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "quarter": F.quarter,
    "day_of_year": F.dayofyear,
    "week_number": F.weekofyear,
}
UNIT_MICROS = {"days": 86_400_000_000, "hours": 3_600_000_000, "minutes": 60_000_000, "seconds": 1_000_000, "milliseconds": 1_000}
TRUNCATE_UNITS = ("year", "quarter", "month", "day", "hour", "minute", "second")


def date_part(x: Column, part: str) -> Column:
    """A part as a whole number; ``day_of_week`` is 0 on Sunday, ``week_number`` follows ISO 8601."""
    if part == "day_of_week":
        return (F.dayofweek(x) - 1).cast("bigint")
    if part not in DATE_PARTS:
        raise InvalidOperation(f"unknown date part {part!r}")
    return DATE_PARTS[part](x).cast("bigint")


def epoch_millis(x: Column) -> Column:
    return F.unix_millis(x.cast("timestamp"))


def truncate(x: Column, unit: str) -> Column:
    if unit not in TRUNCATE_UNITS:
        raise InvalidOperation(f"cannot truncate to {unit!r}")
    return F.date_trunc(unit, x).cast("timestamp_ntz")


def _micros_between(earlier: Column, later: Column) -> Column:
    return F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))


def diff_between(a: Column, b: Column, unit: str = "days") -> Column:
    """a - b in fractional units."""
    if unit not in UNIT_MICROS:
        raise InvalidOperation(f"unknown unit {unit!r}")
    return _micros_between(b, a).cast("double") / float(UNIT_MICROS[unit])


def until(a: Column, b: Column, unit: str = "day") -> Column:
    """b - a in fractional units; a month counts 30 days, a year 365."""
    days = {"day": 1, "month": 30, "year": 365}
    if unit in days:
        return _micros_between(a, b).cast("double") / float(UNIT_MICROS["days"]) / days[unit]
    return -diff_between(a, b, unit + "s")


def format_date(x: Column, pattern: str) -> Column:
    """The first of each of the tokens YYYY MM DD HH mm ss; all other text stays as it is."""
    tokens = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss"}
    parts, rest, used = [], pattern, set()
    while rest:
        token = next((t for t in tokens if rest.startswith(t) and t not in used), None)
        if token:
            used.add(token)
            parts.append(F.date_format(x, tokens[token]))
            rest = rest[len(token) :]
        else:
            parts.append(F.lit(rest[0]))
            rest = rest[1:]
    return F.concat(F.date_format(x, "yyyy").substr(1, 0), *parts)
