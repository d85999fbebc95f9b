"""Row-sequence operators: what depends on the rows before, within a table.

Window functions wherever a rule looks back by rows or to the last non-null row;
recursions (exponential averages and kin), forecasts and the line simplification
go through a table at a time, in its order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.duration import parse
from ..plans.stream import STOP, TIME, VALUE, Record, TableStream, col, instant, time_lit

NAN = float("nan")
_I = "__i"


def _numbered(s: TableStream) -> TableStream:
    return s.to(s.df.withColumn(_I, F.row_number().over(s.rows())))


def _from_second(s: TableStream, df) -> TableStream:
    return s.to(df.where(F.col(_I) > 1).drop(_I), empty=None)


def _signed(s: TableStream, c: str) -> Column:
    """An unsigned column counts down as a signed one."""
    kind = s.df.schema[c].dataType
    return col(c).cast("long") if isinstance(kind, (T.IntegralType, T.DecimalType)) else col(c)


def difference(s: TableStream, columns: Sequence[str] = (VALUE,), non_negative: bool = False, keep_first: bool = False, initial_zero: bool = False) -> TableStream:
    """Change since the last non-null value. A fall, if ``non_negative``, gives
    null, or with ``initial_zero`` the value itself, as if counted from zero."""
    s.need(*columns)
    n = _numbered(s)
    new = {}
    for c in columns:
        v = _signed(s, c)
        p = F.last(v, ignorenulls=True).over(s.before())
        d = v - p
        if non_negative:
            fallen = F.when(v >= 0, v) if initial_zero else F.lit(None)
            d = F.when(v < p, fallen).otherwise(d)
        if keep_first and initial_zero:
            d = F.when(p.isNull() & v.isNotNull(), F.lit(0).cast(s.df.schema[c].dataType if not isinstance(s.df.schema[c].dataType, T.DecimalType) else "long")).otherwise(d)
        new[c] = d
    df = n.df.withColumns(new)
    return s.to(df.drop(_I), empty=None) if keep_first else _from_second(s, df)


def _per(change: Column, gap: Column, by_zero: bool) -> Column:
    return F.when(gap == 0, change * float("inf") if by_zero else F.lit(None).cast("double")).otherwise(change / gap)


def derivative(s: TableStream, unit="1s", non_negative: bool = False, columns: Sequence[str] = (VALUE,), time_column: str = TIME, initial_zero: bool = False, by_zero: bool = False) -> TableStream:
    """Change per ``unit`` since the last non-null value; the first row goes. A time
    that repeats gives null, or with ``by_zero`` the quotient: infinite, or NaN
    where the value repeats too."""
    s.need(time_column, *columns)
    us = float(parse(unit).micros)
    t = F.unix_micros(col(time_column)).cast("double")
    new = {}
    for c in columns:
        v = col(c).cast("double")
        prior = F.last(F.when(v.isNotNull(), F.struct(t.alias("t"), v.alias("v"))), ignorenulls=True).over(s.before())
        gap = (t - prior["t"]) / us
        rate = _per(v - prior["v"], gap, by_zero)
        if non_negative:
            rate = F.when(v < prior["v"], _per(v, gap, by_zero) if initial_zero else F.lit(None).cast("double")).otherwise(rate)
        new[c] = rate
    return _from_second(s, _numbered(s).df.withColumns(new))


def elapsed(s: TableStream, unit="1s", time_column: str = TIME, column_name: str = "elapsed") -> TableStream:
    """Whole units since the row before; the first row goes."""
    s.need(time_column)
    t = F.unix_micros(col(time_column))
    gap = ((t - F.lag(t).over(s.rows())) / float(parse(unit).micros)).cast("long")
    return _from_second(s, _numbered(s).df.withColumn(column_name, gap))


def cumulative_sum(s: TableStream, columns: Sequence[str] = (VALUE,)) -> TableStream:
    """Running sum; a null repeats it."""
    s.need(*columns)
    def total(c):
        kind = s.df.schema[c].dataType
        kind = T.LongType() if isinstance(kind, T.IntegralType) else kind
        return F.coalesce(F.sum(col(c)).over(s.upto()), F.lit(0)).cast(kind)

    return s.to(s.df.withColumns({c: total(c) for c in columns}))


def increase(s: TableStream, columns: Sequence[str] = (VALUE,)) -> TableStream:
    """Running total of a counter that may reset."""
    return cumulative_sum(difference(s, columns, non_negative=True, keep_first=True, initial_zero=True), columns)


def moving_average(s: TableStream, n: int, column: str = VALUE) -> TableStream:
    """Mean of the last n rows, nulls skipped; a shorter table gives one mean."""
    if n < 1:
        raise ValueError("n must be positive")
    s.need(column)
    w = s.rows()
    size = F.count(F.lit(1)).over(Window.partitionBy(*map(col, s.key)))
    out = s.df.withColumns({column: F.avg(col(column).cast("double")).over(w.rowsBetween(-(n - 1), 0)), _I: F.row_number().over(w), "__n": size})
    return s.to(out.where((F.col(_I) >= n) | ((F.col("__n") < n) & (F.col(_I) == F.col("__n")))).drop(_I, "__n"), empty=None)


def chande_momentum_oscillator(s: TableStream, n: int, columns: Sequence[str] = (VALUE,)) -> TableStream:
    """100 (ups - downs) / (ups + downs) over n changes; the first n rows go."""
    s.need(*columns)
    w = s.rows()
    df = _numbered(s).df
    for c in columns:
        df = df.withColumn("__d", col(c).cast("double") - F.lag(col(c).cast("double")).over(w))
        up = F.sum(F.when(F.col("__d") > 0, F.col("__d")).otherwise(0.0)).over(w.rowsBetween(-(n - 1), 0))
        down = F.sum(F.when(F.col("__d") < 0, -F.col("__d")).otherwise(0.0)).over(w.rowsBetween(-(n - 1), 0))
        df = df.withColumns({"__up": up, "__down": down})
        total = F.col("__up") + F.col("__down")
        df = df.withColumn(c, F.when(total == 0, F.lit(NAN)).otherwise(100 * (F.col("__up") - F.col("__down")) / F.nullif(total, F.lit(0.0)))).drop("__d", "__up", "__down")
    return s.to(df.where(F.col(_I) > n).drop(_I), empty=None)


def kaufmans_er(s: TableStream, n: int) -> TableStream:
    """Efficiency ratio: the oscillator's size over 100."""
    out = chande_momentum_oscillator(s, n)
    return out.to(out.df.withColumn(VALUE, F.abs(col(VALUE)) / 100.0))


# Recursions: a table at a time in its order, in time linear in its rows.


def _folded(s: TableStream, column: str, fold: Callable[[np.ndarray], tuple[int, np.ndarray]]) -> TableStream:
    """``fold`` maps the ordered values of a table (NaN for null) to how many
    leading rows go and the new values of the others (NaN for null)."""
    s.need(column)
    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name == column else f for f in s.df.schema])
    rows = s.df.withColumns({column: col(column).cast("double"), _I: F.row_number().over(s.rows())})

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by(_I)
        values = part.column(column).to_numpy()
        lead, new = fold(np.where(np.equal(values, None), np.nan, values).astype(float) if values.dtype == object else values)
        part = part.slice(lead).drop_columns([_I])
        return part.set_column(part.schema.get_field_index(column), column, pa.array(new, pa.float64(), from_pandas=True))

    by = [col(k) for k in s.key] or [F.lit(0)]
    return s.to(rows.groupBy(*by).applyInArrow(run, schema), empty=None)


def _mean(values: np.ndarray) -> float:
    real = values[~np.isnan(values)]
    return float(real.sum() / len(real)) if len(real) else NAN


def _ema(values: np.ndarray, n: int, k: float) -> np.ndarray:
    """Mean of the first n values, then the recursion; nulls repeat the last."""
    now = _mean(values[:n])
    out = [now]
    for v in values[n:].tolist():
        if v == v:
            now = v * k + now * (1 - k) if now == now else v
        out.append(now)
    return np.array(out)


def exponential_moving_average(s: TableStream, n: int, column: str = VALUE) -> TableStream:
    """EMA with k = 2 / (n + 1), seeded by the mean of the first n rows; a
    shorter table gives one mean."""
    return _folded(s, column, lambda v: (min(n, len(v)) - 1, _ema(v, n, 2 / (n + 1))))


def double_ema(s: TableStream, n: int) -> TableStream:
    """2 EMA - EMA(EMA)."""
    return _multi_ema(s, n, 2, lambda e: 2 * e[0] - e[1])


def triple_ema(s: TableStream, n: int) -> TableStream:
    """3 EMA - 3 EMA(EMA) + EMA(EMA(EMA))."""
    return _multi_ema(s, n, 3, lambda e: 3 * e[0] - 3 * e[1] + e[2])


def _multi_ema(s: TableStream, n: int, depth: int, combine) -> TableStream:
    def fold(values: np.ndarray):
        layers = [_ema(values, n, 2 / (n + 1))]
        for _ in range(depth - 1):
            layers.append(_ema(layers[-1], n, 2 / (n + 1)))
        size = len(layers[-1])
        return len(values) - size, combine([x[-size:] for x in layers])

    return _folded(s, VALUE, fold)


def triple_exponential_derivative(s: TableStream, n: int) -> TableStream:
    """Per cent change of the triple-smoothed EMA."""

    def fold(values: np.ndarray):
        x = values
        for _ in range(3):
            x = _ema(x, n, 2 / (n + 1))
        new = (x[1:] / x[:-1] - 1) * 100 if len(x) > 1 else np.array([NAN])
        return len(values) - len(new), new

    return _folded(s, VALUE, fold)


def relative_strength_index(s: TableStream, n: int, columns: Sequence[str] = (VALUE,)) -> TableStream:
    """100 - 100 / (1 + gains / losses), both smoothed with 1 / n; the change of
    the first row counts from 0; the first n rows go."""

    def fold(values: np.ndarray):
        d = np.diff(values, prepend=0.0)
        up, down = (_ema(np.where(x > 0, x, 0.0), n, 1 / n) for x in (d, -d))
        with np.errstate(divide="ignore", invalid="ignore"):
            new = np.where(down == 0, np.where(up == 0, NAN, 100.0), 100.0 - 100.0 / (1.0 + up / down))
        new = new[1:] if len(new) > 1 else new
        return len(values) - len(new), new

    for c in columns:
        s = _folded(s, c, fold)
    return s


def kaufmans_ama(s: TableStream, n: int, column: str = VALUE) -> TableStream:
    """Kaufman's adaptive average, from the efficiency ratio of n changes and
    smoothing between 2 and 30 rows; the first n rows go."""
    fast, slow = 2 / (2 + 1), 2 / (30 + 1)

    def fold(values: np.ndarray):
        if len(values) <= n:
            return len(values), values[:0]
        steps = np.abs(np.diff(values))
        noise = np.convolve(steps, np.ones(n), "valid")
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(noise == 0, 0.0, np.abs(values[n:] - values[:-n]) / noise)
        gain = (ratio * (fast - slow) + slow) ** 2
        now, out = values[n - 1], []
        for v, g in zip(values[n:].tolist(), gain.tolist()):
            now = now + g * (v - now)
            out.append(now)
        return n, np.array(out)

    out = _folded(s, column, fold)
    return out.to(out.df.where(col(column).isNotNull()))


# States


def state_tracking(s: TableStream, fn: Callable[[Record], Column], count_column: str | None = None, duration_column: str | None = None, duration_unit="1s", time_column: str = TIME) -> TableStream:
    """Rows (from 1) and units (from 0) since the predicate has been true without
    a break; -1 where it is not."""
    w = s.rows()
    on = F.coalesce(fn(s.r), F.lit(False))
    df = s.df.withColumn("__on", on)
    df = df.withColumns({"__new": F.col("__on") & F.coalesce(~F.lag("__on").over(w), F.lit(True)), _I: F.row_number().over(w)})
    begun = lambda c: F.last(F.when(F.col("__new"), c), ignorenulls=True).over(s.upto())
    if count_column:
        df = df.withColumn(count_column, F.when(F.col("__on"), F.col(_I) - begun(F.col(_I)) + 1).otherwise(-1).cast("long"))
    if duration_column:
        t = F.unix_micros(col(time_column))
        bad = t.isNull() | (F.lag(t).over(w) > t)
        span = ((t - begun(t)) / float(parse(duration_unit).micros)).cast("long")
        safe = F.when(bad, F.raise_error(F.lit("state duration: null or out-of-order time")).cast("long")).otherwise(span)
        df = df.withColumn(duration_column, F.when(F.col("__on"), safe).otherwise(F.lit(-1)).cast("long"))
    return s.to(df.drop("__on", "__new", _I))


def state_count(s: TableStream, fn, column: str = "stateCount") -> TableStream:
    return state_tracking(s, fn, count_column=column)


def state_duration(s: TableStream, fn, column: str = "stateDuration", time_column: str = TIME, unit="1s") -> TableStream:
    return state_tracking(s, fn, duration_column=column, duration_unit=unit, time_column=time_column)


def event_duration(s: TableStream, unit="1ns", column_name: str = "duration", time_column: str = TIME, stop_column: str = STOP, stop=None) -> TableStream:
    """Whole units until the next row; the last row counts to ``stop``."""
    t = F.unix_micros(col(time_column))
    end = time_lit(instant(stop)) if stop is not None else col(stop_column)
    gap = F.coalesce(F.lead(t).over(s.rows()), F.unix_micros(end)) - t
    n = gap * 1000 if unit == "1ns" else (gap / float(parse(unit).micros))
    return s.to(s.df.withColumn(column_name, n.cast("long")))


# Metric-style functions on counters and gauges


def changes(s: TableStream) -> TableStream:
    """How often the value changed."""
    v = col(VALUE).cast("double")
    df = s.df.withColumn("__c", (F.lag(v).over(s.rows()) != v).cast("int"))
    return s.to(df.groupBy(*map(col, s.key)).agg(F.coalesce(F.sum("__c"), F.lit(0)).cast("double").alias(VALUE)), order=(), empty=None)


def resets(s: TableStream) -> TableStream:
    """How often a counter fell."""
    v = col(VALUE).cast("double")
    df = s.df.withColumn("__c", (F.lag(v).over(s.rows()) > v).cast("int"))
    return s.to(df.groupBy(*map(col, s.key)).agg(F.coalesce(F.sum("__c"), F.lit(0)).cast("double").alias(VALUE)), order=(), empty=None)


def instant_rate(s: TableStream, is_rate: bool = True) -> TableStream:
    """Change of the last two points, per second for a rate; a fallen counter
    counts from zero."""
    rows = s.df.where(col(VALUE).isNotNull())
    w = s.rows(order=s.ordering(reverse=True))
    two = rows.withColumn(_I, F.row_number().over(w)).where(F.col(_I) <= 2)
    t, v = F.unix_micros(col(TIME)) / 1e6, col(VALUE).cast("double")
    get = lambda c, i: F.max(F.when(F.col(_I) == i, c))
    v1, v0, t1, t0 = get(v, 1), get(v, 2), get(t, 1), get(t, 2)
    change = F.when(v1 < v0, v1).otherwise(v1 - v0) if is_rate else v1 - v0
    out = two.groupBy(*map(col, s.key)).agg((change / F.nullif(t1 - t0, F.lit(0.0)) if is_rate else change).alias(VALUE), F.count("*").alias("__n"))
    return s.to(out.where("__n = 2").drop("__n"), order=(), empty=None)


def extrapolated_rate(s: TableStream, is_counter: bool = True, is_rate: bool = True) -> TableStream:
    """Rate, increase or delta over the bounds, extrapolated to them unless the
    edge gap exceeds 1.1 average gaps, and not below a counter's zero."""
    if s.bounds is None:
        raise ValueError("extrapolated_rate needs the bounds of a range")
    a, b = (x.timestamp() if x.tzinfo else x.replace(tzinfo=__import__("datetime").UTC).timestamp() for x in s.bounds)
    rows = s.df.where(col(VALUE).isNotNull()).withColumns({"__t": F.unix_micros(col(TIME)) / 1e6, "__v": col(VALUE).cast("double")})
    prior = F.lag("__v").over(s.rows())
    rows = rows.withColumn("__reset", F.when(prior > F.col("__v"), prior).otherwise(0.0))
    agg = rows.groupBy(*map(col, s.key)).agg(
        F.min("__t").alias("t0"), F.max("__t").alias("t1"), F.min_by("__v", "__t").alias("v0"), F.max_by("__v", "__t").alias("v1"), F.sum("__reset").alias("up"), F.count("*").alias("n")
    ).where("n > 1")
    total = F.col("v1") - F.col("v0") + (F.col("up") if is_counter else F.lit(0.0))
    span, gap = F.col("t1") - F.col("t0"), (F.col("t1") - F.col("t0")) / (F.col("n") - 1)
    head, tail = F.col("t0") - F.lit(a), F.lit(b) - F.col("t1")
    if is_counter:
        zero = F.when((total > 0) & (F.col("v0") >= 0), span * (F.col("v0") / F.nullif(total, F.lit(0.0))))
        head = F.when(zero < head, zero).otherwise(head)
    more = span + F.when(head < gap * 1.1, head).otherwise(gap / 2) + F.when(tail < gap * 1.1, tail).otherwise(gap / 2)
    value = total * (more / span)
    return s.to(agg.select(*map(col, s.key), (value / (b - a) if is_rate else value).alias(VALUE)), order=(), empty=None)


def linear_regression(s: TableStream, predict: bool = False, from_now: float = 0.0) -> TableStream:
    """Slope per second, or the value predicted ``from_now`` seconds past the stop."""
    t, v = F.unix_micros(col(TIME)) / 1e6, col(VALUE).cast("double")
    at = s.bounds[1].replace(tzinfo=__import__("datetime").UTC).timestamp() if s.bounds else 0.0
    x = t - F.lit(at)
    line = F.regr_intercept(v, x) + F.regr_slope(v, x) * F.lit(float(from_now)) if predict else F.regr_slope(v, x)
    out = s.df.where(col(VALUE).isNotNull()).groupBy(*map(col, s.key)).agg(line.alias(VALUE), F.count("*").alias("__n"))
    return s.to(out.where("__n > 1").drop("__n"), order=(), empty=None)


def double_exponential(s: TableStream, smoothing: float, trend: float) -> TableStream:
    """Level of double exponential smoothing after a table's last point."""
    rows = s.df.where(col(VALUE).isNotNull()).withColumn(_I, F.row_number().over(s.rows()))
    rows = rows.select(*map(col, s.key), F.col(_I), col(VALUE).cast("double").alias(VALUE))
    schema = T.StructType([*(s.df.schema[k] for k in s.key), T.StructField(VALUE, T.DoubleType())])

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by(_I)
        values = part.column(VALUE).to_pylist()
        one = part.slice(0, min(1, len(values) - 1)).drop_columns([_I])
        if len(values) > 1:
            level, slope = values[0], values[1] - values[0]
            for x in values[1:]:
                before, level = level, smoothing * x + (1 - smoothing) * (level + slope)
                slope = trend * (level - before) + (1 - trend) * slope
            one = one.set_column(one.schema.get_field_index(VALUE), VALUE, pa.array([level]))
        return one

    by = [col(k) for k in s.key] or [F.lit(0)]
    return s.to(rows.groupBy(*by).applyInArrow(run, schema), order=(), empty=None)


def label_replace(s: TableStream, source: str, destination: str, regex: str, replacement: str) -> TableStream:
    """Set a label from a full match of another; an empty result drops it to null."""
    src = F.coalesce(col(source), F.lit("")) if source in s.columns else F.lit("")
    full = f"^(?:{regex})$"
    new = F.nullif(F.regexp_replace(src, full, replacement), F.lit(""))
    old = col(destination) if destination in s.columns else F.lit(None).cast("string")
    out = s.df.withColumn(destination, F.when(src.rlike(full), new).otherwise(old))
    return s.to(out, key=tuple(dict.fromkeys((*s.key, destination))))


def timestamp(s: TableStream) -> TableStream:
    return s.to(s.df.withColumn(VALUE, F.unix_micros(col(TIME)) / 1e6))


def date_part(s: TableStream, part: str) -> TableStream:
    """A calendar part of epoch seconds in _value: minute, hour, day_of_week
    (Sunday 0), day_of_month, days_in_month, month or year."""
    t = F.timestamp_micros((col(VALUE).cast("double") * 1e6).cast("long"))
    fn = {"minute": F.minute, "hour": F.hour, "day_of_week": lambda x: F.dayofweek(x) - 1, "day_of_month": F.dayofmonth, "days_in_month": lambda x: F.day(F.last_day(x)), "month": F.month, "year": F.year}[part]
    return s.to(s.df.withColumn(VALUE, fn(t).cast("double")))


def metric_quantile(s: TableStream, q: float) -> TableStream:
    """Interpolated quantile; below 0 it is -Inf, above 1 +Inf."""
    v = col(VALUE).cast("double")
    agg = F.lit(float("-inf")) if q < 0 else F.lit(float("inf")) if q > 1 else F.percentile(v, F.lit(float(q)))
    out = s.df.groupBy(*map(col, s.key)).agg(F.count(v).alias("__n"), (agg if 0 <= q <= 1 else F.first(agg)).alias(VALUE))
    return s.to(out.drop("__n"), order=(), empty=None)


# Forecasts and simplification: a table at a time in pandas


def holt_winters(s: TableStream, n: int, interval, seasonality: int = 0, with_fit: bool = False, column: str = VALUE, time_column: str = TIME) -> TableStream:
    """n points of triple exponential smoothing with damped trend (additive
    trend, multiplicative season), fitted by a bounded simplex search. A table
    is one group: use ``aggregate_window`` first where tables are long."""
    step = parse(interval).micros
    keys = list(s.key)
    fields = [s.df.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField(time_column, T.TimestampType()), T.StructField(column, T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from ..functions.forecast import fit_and_forecast

        pdf = pdf.sort_values(time_column)
        t = pdf[time_column].astype("datetime64[us]").astype("int64").to_numpy()
        slot = (t - t[0]) // step
        values = pd.Series(pdf[column].astype(float).to_numpy(), index=slot).groupby(level=0).last().reindex(range(int(slot[-1]) + 1)).to_numpy()
        fitted, future = fit_and_forecast(values, n, seasonality)
        out, first = (list(fitted) + list(future), 0) if with_fit else (list(future), len(values))
        times = pd.to_datetime(t[0] + (first + pd.RangeIndex(len(out)).to_numpy()) * step, unit="us")
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(out) for k in keys}, time_column: times, column: out})

    slim = s.df.select(*map(col, [*keys, time_column, column]))
    out = slim.groupBy(*map(col, keys)).applyInPandas(run, schema) if keys else slim.groupBy(F.lit(0)).applyInPandas(run, schema)
    return s.to(out, order=(time_column,), empty=None)


def simplify_line(s: TableStream, epsilon: float | None = None, retention: float | None = None, column: str = VALUE, time_column: str = TIME) -> TableStream:
    """Ramer-Douglas-Peucker: rows within ``epsilon`` of the line between kept
    rows go; or the share ``retention`` of rows that matter most stays; with
    neither, the tolerance of every stretch follows from its length and slope."""
    if epsilon and retention:
        raise ValueError("give epsilon or retention, not both")
    keys = list(s.key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from ..functions.forecast import digital_line, line_importance

        pdf = pdf.sort_values(time_column).reset_index(drop=True)
        t = pdf[time_column].astype("datetime64[us]").astype("int64").to_numpy() * 1e3  # nanoseconds
        values = pdf[column].astype(float).to_numpy()
        if not epsilon and retention is None:
            return pdf.loc[digital_line(t, values)]
        weight = line_importance(t, values)
        if retention is not None:
            keep = max(2, round(len(pdf) * retention / 100 if retention > 1 else len(pdf) * retention))
            return pdf.loc[sorted(pd.Series(weight).nlargest(keep).index)]
        return pdf[weight > (epsilon or 0.0)]

    by = [col(k) for k in keys] or [F.lit(0)]
    return s.to(s.df.groupBy(*by).applyInPandas(run, s.df.schema), empty=None)
