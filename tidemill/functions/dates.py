"""Calendar functions on times, in a named location."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.duration import Duration, parse
from ..plans.stream import instant, time_lit

#: Weekdays from 0, months from 1 (fixed values).
WEEKDAYS = {n: i for i, n in enumerate("Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split())}
MONTHS = {n: i for i, n in enumerate("January February March April May June July August September October November December".split(), 1)}


def time(t, location: str = "UTC") -> Column:
    """A time column, or a constant from a time, text or duration from now."""
    return t if isinstance(t, Column) else time_lit(instant(t))


def _local(t, location: str) -> Column:
    t = time(t)
    return t if location == "UTC" else F.from_utc_timestamp(t, location)


def _part(fn):
    def part(t, location: str = "UTC") -> Column:
        return fn(_local(t, location)).cast("long")

    return part


second, minute, hour = _part(F.second), _part(F.minute), _part(F.hour)
month_day, year_day, month, year = _part(F.dayofmonth), _part(F.dayofyear), _part(F.month), _part(F.year)
week, quarter = _part(F.weekofyear), _part(F.quarter)
week_day = _part(lambda t: F.dayofweek(t) - 1)


def millisecond(t) -> Column:
    return F.floor(F.pmod(F.unix_micros(time(t)), F.lit(10**6)) / 1000).cast("long")


def microsecond(t) -> Column:
    return F.pmod(F.unix_micros(time(t)), F.lit(10**6)).cast("long")


def nanosecond(t) -> Column:
    return microsecond(t) * 1000


def add(d, to, location: str = "UTC") -> Column:
    """to + d: months first (clamped to the month's end), then the rest."""
    d = parse(d)
    if location == "UTC" or d.fixed:
        return d.added_to(time(to))
    return F.to_utc_timestamp(d.added_to(_local(to, location)), location)


def sub(d, from_, location: str = "UTC") -> Column:
    return add(-parse(d), from_, location)


def truncate(t, unit, location: str = "UTC") -> Column:
    """Down to a whole unit; weeks start on Thursday, as the epoch did."""
    from ..operators.windows import floor_time

    return floor_time(time(t), parse(unit), Duration(), location)


def scale(d, n: int) -> Duration:
    return parse(d).scale(n)


def system_time() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


# Locations: a zone's name, as Spark's time functions take it.
UTC_ZONE = "UTC"


def fixed_location(offset) -> str:
    """A zone of constant offset, from a duration."""
    us = parse(offset).micros
    h, m = divmod(abs(us) // 60_000_000, 60)
    return f"{'-' if us < 0 else '+'}{h:02d}:{m:02d}"


def location(name: str) -> str:
    from zoneinfo import ZoneInfo

    ZoneInfo(name)
    return name
