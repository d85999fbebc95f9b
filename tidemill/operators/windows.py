"""Time windows: tumbling, sliding, calendar and zoned, and down-sampling.

A window is [start, start + period) with starts every ``every`` from the epoch
plus an offset. Window bounds are plain expressions: a sliding window explodes
each row into the few windows that hold it, and nothing else multiplies rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.duration import Duration, parse
from ..plans.stream import START, STOP, TIME, VALUE, TableStream, clock, col, time_lit
from . import aggregates, selectors
from .shape import fill_empty


def floor_time(t: Column, every: Duration, offset: Duration = Duration(), location: str = "UTC") -> Column:
    """Start of the ``every`` period that holds t."""
    zoned = location != "UTC"
    local = F.from_utc_timestamp(t, location) if zoned else t
    if every.months:
        base = (-offset).added_to(local) if offset != Duration() else local
        month = F.year(base) * 12 + F.month(base) - 1
        # months count from January 1970
        at = F.floor((month - 1970 * 12) / every.months) * every.months + 1970 * 12
        start = F.make_timestamp(F.floor(at / 12), at % 12 + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        start = offset.added_to(start) if offset != Duration() else start
    else:
        us, off = F.unix_micros(local), offset.micros % every.micros
        start = F.timestamp_micros(us - F.pmod(us - off, F.lit(every.micros)))
    return F.to_utc_timestamp(start, location) if zoned else start


def window_starts(t: Column, every: Duration, period: Duration, offset: Duration, location: str = "UTC") -> Column:
    """Array of the starts of all windows that hold t, oldest first."""
    last = floor_time(t, every, offset, location)
    n = _overlaps(every, period)
    starts = F.array(*((-every).scale(i).added_to(last) for i in range(n - 1, -1, -1)))
    return F.filter(starts, lambda x: period.added_to(x) > t) if n > 1 or period != every else starts


def _overlaps(every: Duration, period: Duration) -> int:
    if bool(every.months) != bool(period.months):
        days = lambda d: d.months * 31 * 86_400_000_000 + d.micros
        return max(1, -(-days(period) // max(days(Duration(every.months * 28 // 31 or 0, every.micros)) or 28 * 86_400_000_000, 1)) + 1)
    size, step = (period.months, every.months) if every.months else (period.micros, every.micros)
    return max(1, -(-size // step))


def _checked(every, period, offset) -> tuple[Duration, Duration, Duration]:
    every, offset = parse(every), parse(offset)
    period = parse(period) if period is not None else every
    for d in (every, period):
        if not d.infinite and (d.months < 0 or d.micros < 0 or not (d.months or d.micros)):
            raise ValueError("window every and period must be positive")
        if d.months and d.micros:
            raise ValueError("a window is whole months or fixed time, not both")
    return every, period, offset


def window(s: TableStream, every, period=None, offset="0s", time_column: str = TIME, start_column: str = START, stop_column: str = STOP, create_empty: bool = False, location: str = "UTC") -> TableStream:
    """Each row once per window that holds it, clipped to the stream's bounds;
    _start and _stop are set and join the key. ``every="inf"``: the bounds."""
    every, period, offset = _checked(every, period, offset)
    s.need(time_column)
    key = tuple(dict.fromkeys((*(k for k in s.key if k not in (start_column, stop_column)), start_column, stop_column)))
    if every.infinite:
        if s.bounds is None:
            raise ValueError("window(every: inf) needs the bounds of a range")
        a, b = map(time_lit, s.bounds)
        return s.to(s.df.withColumns({start_column: a, stop_column: b}), key=key)
    rows = s.df.where(col(time_column).isNotNull())
    if every == period:
        begun = rows.withColumn("__w", floor_time(col(time_column), every, offset, location))
    else:
        begun = rows.withColumn("__w", F.explode(window_starts(col(time_column), every, period, offset, location)))
    a, b = F.col("__w"), _end(F.col("__w"), period, location)
    if s.bounds:
        a, b = F.greatest(a, time_lit(s.bounds[0])), F.least(b, time_lit(s.bounds[1]))
    out = begun.withColumns({start_column: a, stop_column: b}).drop("__w")
    empty = None
    if create_empty:
        if s.bounds is None:
            raise ValueError("createEmpty needs the bounds of a range")
        rest = [k for k in key if k not in (start_column, stop_column)]
        a_, b_ = map(time_lit, s.bounds)
        keys = s.df.select(*map(col, rest)).distinct() if rest else s.df.sparkSession.range(1)
        # each key is multiplied by the windows of the bounds where it is
        begun = keys.withColumn("__w", F.explode(_starts(s.bounds, every, period, offset, location)))
        stop = _end(F.col("__w"), period, location)
        begun = begun.where((F.col("__w") < b_) & (stop > a_))
        empty = begun.withColumns({start_column: F.greatest("__w", a_), stop_column: F.least(stop, b_)})
        empty = empty.select(*map(col, key))
    return s.to(out, key=key, empty=empty)


def _end(start: Column, period: Duration, location: str) -> Column:
    if location == "UTC":
        return period.added_to(start)
    return F.to_utc_timestamp(period.added_to(F.from_utc_timestamp(start, location)), location)


def _starts(bounds: tuple[datetime, datetime], every: Duration, period: Duration, offset: Duration, location: str) -> Column:
    """Array of the starts of the windows that may overlap the bounds."""
    a, b = map(time_lit, bounds)
    first = (-every).scale(_overlaps(every, period) - 1).added_to(floor_time(a, every, offset, location))
    step = F.make_ym_interval(F.lit(0), F.lit(every.months)) if every.months else F.expr(f"make_dt_interval(0, 0, 0, {every.micros / 1e6:.6f})")
    return F.sequence(first, b, step)


#: Aggregates and selectors that aggregate_window knows by name.
FUNCTIONS: dict[str, Callable] = {
    n: getattr(aggregates, n + "_of") for n in ("count", "sum", "mean", "min", "max", "spread", "stddev", "skew", "quantile", "first", "last")
} | {"median": aggregates.quantile_of}


def aggregate_window(s: TableStream, every, fn: str | Callable = "mean", column: str = VALUE, period=None, offset="0s", time_src: str = STOP, time_dst: str = TIME, create_empty: bool = True, location: str = "UTC", **kw) -> TableStream:
    """Down-sample: aggregate each window, name its time after ``time_src``.

    ``fn`` is an aggregate's name (one ``groupBy`` on key and window start, no
    window function), or any operator on streams. Windows without rows give null
    (0 for a count) unless ``create_empty`` is off.
    """
    every_, period_, offset_ = _checked(every, period, offset)
    create_empty = create_empty and s.bounds is not None
    win = window(s, every_, period_, offset_, create_empty=create_empty, location=location)
    if callable(fn):
        out = fn(win, column, **kw) if kw else fn(win, column)
        out = fill_empty(out.to(empty=win.empty)) if create_empty else out
        df = out.df
    else:
        agg = FUNCTIONS[fn](win, column, **kw)
        df = win.df.groupBy(*map(col, win.key)).agg(agg.alias(column))
        if win.empty is not None:
            same = [F.col(f"e.`{k}`").eqNullSafe(F.col(f"d.`{k}`")) for k in win.key]
            on = same[0]
            for c in same[1:]:
                on &= c
            value = F.coalesce(F.col(f"d.`{column}`"), F.lit(0)) if fn == "count" else F.col(f"d.`{column}`")
            df = win.empty.alias("e").join(df.alias("d"), on, "left").select(*(F.col(f"e.`{k}`") for k in win.key), value.alias(column))
    df = df.withColumn(time_dst, col(time_src))
    if s.bounds:
        df = df.withColumns({START: time_lit(s.bounds[0]), STOP: time_lit(s.bounds[1])})
        key = tuple(dict.fromkeys((*(k for k in s.key if k not in (START, STOP)), START, STOP)))
    else:
        df = df.drop(*(c for c in (START, STOP) if c != time_dst))
        key = tuple(k for k in s.key if k not in (START, STOP))
    return s.to(df, key=key, order=(time_dst,), empty=None)


def timed_moving_average(s: TableStream, every, period, column: str = VALUE) -> TableStream:
    """Mean over overlapping windows; _time is the window's stop."""
    return aggregate_window(s, every, "mean", column, period, create_empty=False)


def aggregate_rate(s: TableStream, every, group_columns=(), unit="1s", by_zero: bool = False) -> TableStream:
    """Non-negative derivative, averaged per window and series, summed over groups;
    ``by_zero`` as in ``derivative``."""
    from .sequences import derivative

    rates = aggregate_window(derivative(s, unit, non_negative=True, by_zero=by_zero), every, "mean", create_empty=False)
    by = [*group_columns, TIME]
    df = rates.df.groupBy(*map(col, by)).agg(F.sum(col(VALUE)).alias(VALUE))
    return s.to(df, key=tuple(group_columns), order=(TIME,), empty=None)


def interpolate_linear(s: TableStream, every, column: str = VALUE) -> TableStream:
    """Original rows and, strictly between neighbours, a row on each ``every``
    boundary, on the straight line. Other non-key columns and nulls are errors."""
    d = parse(every)
    odd = [c for c in s.columns if c not in (*s.key, TIME, column)]
    if odd:
        raise ValueError(f"interpolate: unexpected columns {odd}")
    w = s.rows()
    v = F.when(col(column).isNull() | col(TIME).isNull(), F.raise_error(F.lit("interpolate: null value")).cast("double")).otherwise(col(column).cast("double"))
    rows = s.df.withColumns({"__t": F.unix_micros(col(TIME)), "__v": v})
    rows = rows.withColumns({"__nt": F.lead("__t").over(w), "__nv": F.lead("__v").over(w)})
    step = d.micros
    first = F.col("__t") - F.pmod(F.col("__t"), F.lit(step)) + step
    grid = F.when(first < F.col("__nt"), F.sequence(first, F.col("__nt") - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    every_t = F.explode(F.concat(F.array("__t"), grid)).alias("__at")
    out = rows.select(*map(col, s.key), "__t", "__v", "__nt", "__nv", every_t)
    line = F.col("__v") + (F.col("__nv") - F.col("__v")) * (F.col("__at") - F.col("__t")) / (F.col("__nt") - F.col("__t"))
    value = F.when(F.col("__at") == F.col("__t"), F.col("__v")).otherwise(line)
    out = out.select(*map(col, s.key), F.timestamp_micros("__at").alias(TIME), value.alias(column))
    return s.to(out.select(*map(col, dict.fromkeys([*s.key, TIME, column]))), order=(TIME,), empty=None)


def day_formatter(start: datetime) -> dict[str, datetime]:
    """Start and stop of the day that begins at ``start``."""
    return {"start": start, "stop": start + timedelta(days=1)}


def week_formatter(start: datetime) -> dict[str, datetime]:
    return {"start": start, "stop": start + timedelta(days=7)}


def day_finder(weekday: int, now: datetime | None = None) -> datetime:
    """The last such weekday (Sunday is 0) before today."""
    day = _today(now)
    return day - timedelta(days=(day.isoweekday() % 7 - weekday) % 7 or 7)


def _today(now: datetime | None) -> datetime:
    return (now or clock.now()).replace(hour=0, minute=0, second=0, microsecond=0)


def bounds_of(period: str, now: datetime | None = None) -> dict[str, datetime]:
    """Start and stop of the most recent such calendar period: yesterday, a
    weekday's name, week or month."""
    day = _today(now)
    names = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
    if period == "yesterday":
        return day_formatter(day - timedelta(days=1))
    if period == "week":
        return week_formatter(day - timedelta(days=day.weekday()))
    if period == "month":
        start = day.replace(day=1)
        return {"start": start, "stop": Duration(1).after(start)}
    return day_formatter(day_finder(names.index(period), now))


def last_of_window(s: TableStream, every, column: str = VALUE) -> TableStream:
    return aggregate_window(s, every, selectors.last, column, create_empty=False)
