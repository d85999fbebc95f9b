"""Calendar-aware durations: whole months and microseconds, with a sign.

``parse("1y2mo3w4d5h6m7s8ms9us")``; nanosecond parts are rounded down to Spark's
microseconds. Months never turn into microseconds or back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of the fixed units, months of the calendar units (fixed values).
MICROS = {"us": 1, "µs": 1, "ms": 10**3, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6, "w": 7 * 86400 * 10**6}
MONTHS = {"mo": 1, "q": 3, "y": 12}
_PART = re.compile(r"(\d+)(mo|ms|us|µs|ns|[yqwdhms])")


@dataclass(frozen=True)
class Duration:
    months: int = 0
    micros: int = 0
    infinite: bool = False

    def __neg__(self) -> Duration:
        return Duration(-self.months, -self.micros, self.infinite)

    def scale(self, n: int) -> Duration:
        return Duration(self.months * n, self.micros * n)

    @property
    def fixed(self) -> bool:
        return not self.months and not self.infinite

    def added_to(self, t: Column) -> Column:
        """t + duration: months first, clamped to the month's end, then the rest."""
        out = t
        if self.months:
            out = out + F.make_interval(months=F.lit(self.months))
        if self.micros:
            out = F.timestamp_micros(F.unix_micros(out) + F.lit(self.micros))
        return out

    def after(self, t: datetime) -> datetime:
        if self.months:
            n = t.year * 12 + t.month - 1 + self.months
            y, m = divmod(n, 12)
            last = (datetime(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(days=1)).day
            t = t.replace(year=y, month=m + 1, day=min(t.day, last))
        return t + timedelta(microseconds=self.micros)

    def text(self) -> str:
        if self.infinite:
            return "inf"
        sign, mo, us = ("-", -self.months, -self.micros) if self.months < 0 or self.micros < 0 else ("", self.months, self.micros)
        out = [f"{n}{u}" for u, n in (("y", mo // 12), ("mo", mo % 12)) if n]
        for u in ("w", "d", "h", "m", "s", "ms", "us"):
            n, us = divmod(us, MICROS[u])
            out += [f"{n}{u}"] if n else []
        return sign + ("".join(out) or "0s")


INF = Duration(infinite=True)


def parse(value: str | Duration | timedelta | int) -> Duration:
    """From text, a timedelta or a whole number of nanoseconds."""
    if isinstance(value, Duration):
        return value
    if isinstance(value, timedelta):
        return Duration(0, round(value / timedelta(microseconds=1)))
    if isinstance(value, int):
        return Duration(0, value // 1000)
    if value == "inf":
        return INF
    text, sign = (value[1:], -1) if value.startswith("-") else (value, 1)
    parts = _PART.findall(text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"not a duration: {value!r}")
    months = sum(int(n) * MONTHS[u] for n, u in parts if u in MONTHS)
    micros = sum(int(n) * MICROS[u] for n, u in parts if u in MICROS) + sum(int(n) for n, u in parts if u == "ns") // 1000
    return Duration(sign * months, sign * micros)
