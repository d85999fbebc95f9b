"""Projection, filtering, schema and grouping operators.

None of these moves rows between tasks; ``pivot`` and the key listings aggregate.
"""

from __future__ import annotations

import builtins
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import convert
from ..plans.duration import Duration, parse
from ..plans.stream import START, STOP, TIME, VALUE, Record, TableStream, as_column, col, instant, time_lit


def filter(s: TableStream, fn: Callable[[Record], Column], on_empty: str = "drop") -> TableStream:  # noqa: A001
    """Rows for which the predicate is true; ``on_empty="keep"`` remembers the
    keys of tables that lose all rows."""
    if on_empty not in ("drop", "keep"):
        raise ValueError("on_empty must be 'drop' or 'keep'")
    kept = s.df.where(fn(s.r))
    if on_empty == "drop" or not s.key:
        return s.to(kept)
    keys = s.df.select(*map_cols(s.key)).distinct()
    return s.to(kept, empty=keys if s.empty is None else keys.unionByName(s.empty).distinct())


def range(s: TableStream, start, stop=None) -> TableStream:  # noqa: A001
    """Rows with start <= _time < stop; adds _start and _stop to row and key."""
    s.need(TIME)
    a, b = instant(start), instant(stop if stop is not None else "0s")
    kept = s.df.where((col(TIME) >= time_lit(a)) & (col(TIME) < time_lit(b)))
    out = kept.withColumns({START: time_lit(a), STOP: time_lit(b)})
    key = tuple(dict.fromkeys((*s.key, START, STOP)))
    return s.to(out, key=key, bounds=(a, b))


def drop(s: TableStream, columns: Sequence[str] | None = None, fn: Callable[[str], bool] | None = None) -> TableStream:
    gone = builtins.set(columns or ()) if fn is None else {c for c in s.columns if fn(c)}
    return s.to(s.df.select(*(col(c) for c in s.columns if c not in gone)))


def keep(s: TableStream, columns: Sequence[str] | None = None, fn: Callable[[str], bool] | None = None) -> TableStream:
    held = builtins.set(columns or ()) if fn is None else {c for c in s.columns if fn(c)}
    return s.to(s.df.select(*(col(c) for c in s.columns if c in held)))


def duplicate(s: TableStream, column: str, as_: str) -> TableStream:
    s.need(column)
    return s.to(s.df.withColumn(as_, col(column)))


def rename(s: TableStream, columns: dict[str, str] | None = None, fn: Callable[[str], str] | None = None) -> TableStream:
    names = columns if fn is None else {c: fn(c) for c in s.columns}
    s.need(*names)
    new = [names.get(c, c) for c in s.columns]
    if len(builtins.set(new)) < len(new):
        raise ValueError(f"rename makes duplicate columns: {new}")
    out = s.df.toDF(*new)
    moved = lambda x: names.get(x, x) if isinstance(x, str) else x
    return s.to(out, key=tuple(moved(k) for k in s.key), order=tuple(moved(o) for o in s.order))


def set(s: TableStream, key: str | None = None, value: str | None = None, **many) -> TableStream:  # noqa: A001
    """Assign constants to columns, new or not: ``set("host", "a")`` or keywords."""
    pairs = ({key: value} if key is not None else {}) | many
    return s.to(s.df.withColumns({k: as_column(v) for k, v in pairs.items()}))


def map(s: TableStream, fn: Callable[[Record], dict], merge_key: bool = False) -> TableStream:  # noqa: A001
    """Row to record. ``fn`` returns {label: Column or constant}; ``extend`` it
    with ``{**all_of(r), ...}``. Key columns the record lacks leave the key,
    unless ``merge_key``."""
    record = fn(s.r)
    if merge_key:
        record = {**{k: col(k) for k in s.key if k not in record}, **record}
    hidden = [o for o in s.order if isinstance(o, str) and o not in record]
    out = s.df.select(*(as_column(v).alias(k) for k, v in record.items()))
    return s.to(out, order=tuple(o for o in s.order if o not in hidden))


def extend(s: TableStream, fn: Callable[[Record], dict]) -> TableStream:
    """``{r with ...}``: the row with columns added or replaced."""
    return s.to(s.df.withColumns({k: as_column(v) for k, v in fn(s.r).items()}))


def group(s: TableStream, columns: Sequence[str] = (), mode: str = "by") -> TableStream:
    """Regroup: by these columns, by all except these, or ``extend`` the key."""
    if mode == "by":
        key = [c for c in columns if c in s.columns]
    elif mode == "except":
        key = [c for c in s.columns if c not in columns]
    elif mode == "extend":
        key = [*s.key, *(c for c in columns if c in s.columns and c not in s.key)]
    else:
        raise ValueError(f"unknown group mode {mode!r}")
    return s.to(key=tuple(key), empty=None)


def ungroup(s: TableStream) -> TableStream:
    return group(s)


def fill(s: TableStream, column: str = VALUE, value=None, use_previous: bool = False) -> TableStream:
    """Replace nulls by a constant of the column's type or by the last non-null."""
    if use_previous:
        if column not in s.columns:
            return s
        return s.to(s.df.withColumn(column, F.last(col(column), ignorenulls=True).over(s.upto())))
    if value is None:
        raise ValueError("fill needs a value or use_previous")
    if column not in s.columns:
        return s.to(s.df.withColumn(column, F.lit(value)))
    kinds = {bool: T.BooleanType, int: (T.LongType, T.IntegerType, T.DecimalType, T.ShortType), float: (T.DoubleType, T.FloatType), str: T.StringType, datetime: T.TimestampType}
    kind = s.df.schema[column].dataType
    if type(value) in kinds and not isinstance(kind, kinds[type(value)]):
        raise TypeError(f"fill column type mismatch: {kind.simpleString()} and {type(value).__name__}")
    return s.to(s.df.withColumn(column, F.coalesce(col(column), F.lit(value))))


def time_shift(s: TableStream, duration, columns: Sequence[str] = (START, STOP, TIME)) -> TableStream:
    d = parse(duration)
    out = s.df.withColumns({c: d.added_to(col(c)) for c in columns if c in s.columns})
    return s.to(out, bounds=tuple(d.after(t) for t in s.bounds) if s.bounds else None)


def hour_selection(s: TableStream, start: int, stop: int, time_column: str = TIME, location: str = "UTC") -> TableStream:
    """Rows whose local hour is in [start, stop], over midnight if start > stop."""
    if not (0 <= start <= 23 and 0 <= stop <= 23):
        raise ValueError("hours must be in 0..23")
    h = F.hour(F.from_utc_timestamp(col(time_column), location))
    return s.to(s.df.where(h.between(start, stop) if start <= stop else (h >= start) | (h <= stop)))


def truncate_time(s: TableStream, unit) -> TableStream:
    from ..functions.dates import truncate

    return s.to(s.df.withColumn(TIME, truncate(col(TIME), unit)))


def _converted(fn: Callable[[Column], Column]) -> Callable[[TableStream], TableStream]:
    def op(s: TableStream) -> TableStream:
        s.need(VALUE)
        return s.to(s.df.withColumn(VALUE, fn(col(VALUE), s.df.schema[VALUE].dataType)))

    return op


to_string, to_int, to_uint = _converted(convert.string), _converted(convert.int_), _converted(convert.uint)
to_float, to_bool, to_time = _converted(convert.float_), _converted(convert.bool_), _converted(convert.time)


def columns(s: TableStream, column: str = VALUE) -> TableStream:
    """Each table becomes the list of its column labels."""
    labels = F.explode(F.array(*(F.lit(c) for c in s.columns)))
    out = s.df.select(*map_cols(s.key)).distinct().select(*map_cols(s.key), labels.alias(column))
    return s.to(out, order=())


def keys(s: TableStream, column: str = VALUE) -> TableStream:
    """Each table becomes the list of its key's labels."""
    if not s.key:
        return s.to(s.df.limit(0).select(F.lit("").alias(column)), order=())
    labels = F.explode(F.array(*(F.lit(c) for c in s.key)))
    return s.to(s.df.select(*map_cols(s.key)).distinct().select(*map_cols(s.key), labels.alias(column)), order=())


def key_values(s: TableStream, key_columns: Sequence[str] | None = None) -> TableStream:
    """Distinct (_key, _value) pairs of the named columns, all of one type."""
    names = list(key_columns or s.key)
    s.need(*names)
    kinds = {s.df.schema[n].dataType.simpleString() for n in names}
    if len(kinds) > 1:
        raise TypeError(f"keyValues columns differ in type: {sorted(kinds)}")
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("_key"), col(n).alias(VALUE)) for n in names))).alias("_p")
    rest = [k for k in s.key if k not in ("_key", VALUE)]
    out = s.df.select(*map_cols(rest), pairs).select(*map_cols(rest), "_p._key", f"_p.{VALUE}").distinct()
    return s.to(out, key=(*rest, "_key"), order=(VALUE,))


def map_cols(names: Sequence[str]) -> list[Column]:
    return [col(n) for n in names]


def pivot(s: TableStream, row_key: Sequence[str], column_key: Sequence[str], value_column: str = VALUE, values: Sequence[str] | None = None) -> TableStream:
    """Long to wide: one row per row key, one column per joined column key.

    Nulls in a column key read "null"; of several values the last in order wins.
    Columns outside group key, row key and the pivot go. ``values`` states the
    labels to expect, which saves the pass that finds them.
    """
    s.need(*row_key, *column_key, value_column)
    text = lambda c: F.coalesce(F.format_string("%E", col(c)) if isinstance(s.df.schema[c].dataType, T.DoubleType) else col(c).cast("string"), F.lit("null"))
    label = F.concat_ws("_", *(text(c) for c in column_key))
    stay = [k for k in s.key if k not in column_key and k != value_column and k not in row_key]
    by = [*stay, *row_key]
    order = F.struct(*(col(o) if isinstance(o, str) else o for o in s.order)) if s.order else F.lit(0)
    grouped = s.df.withColumn("__label", label).withColumn("__ord", order).groupBy(*map_cols(by))
    wide = grouped.pivot("__label", list(values) if values else None).agg(F.max_by(col(value_column), col("__ord")))
    clash = builtins.set(wide.columns[len(by) :]) & builtins.set(by)
    if clash:
        raise ValueError(f"pivot label equals a column: {sorted(clash)}")
    return s.to(wide, key=tuple(stay), order=tuple(row_key), empty=None)


def unpivot(s: TableStream, other_columns: Sequence[str] = (TIME,)) -> TableStream:
    """Wide to long: every column but key and ``other_columns`` becomes rows of
    _field and _value; null values are left out; _field joins the key."""
    ids = list(dict.fromkeys([*s.key, *(c for c in (TIME, *other_columns) if c in s.columns)]))
    fields = [c for c in s.columns if c not in ids]
    out = s.df.unpivot(map_cols(ids), map_cols(fields), "_field", VALUE).where(col(VALUE).isNotNull())
    return s.to(out, key=(*s.key, "_field"))


def fields_as_columns(s: TableStream) -> TableStream:
    """Pivot _field by _time."""
    return pivot(s, [TIME], ["_field"], VALUE)


def align_time(s: TableStream, align_to=datetime(1970, 1, 1)) -> TableStream:
    """Shift every table so that its first row is at ``align_to``."""
    first = F.unix_micros(F.min(col(TIME)).over(s.rows().rowsBetween(-(2**63), 2**63 - 1)))
    at = F.unix_micros(time_lit(instant(align_to)))
    return s.to(s.df.withColumn(TIME, F.timestamp_micros(F.unix_micros(col(TIME)) - first + at)))


def fill_empty(s: TableStream) -> TableStream:
    """Give every empty table one row that is null but for its key."""
    if s.empty is None:
        return s
    keys = s.empty.join(s.df.select(*map_cols(s.key)).distinct(), list(s.key), "left_anti")
    return s.to(s.df.unionByName(keys, allowMissingColumns=True), empty=None)


def object_keys(record: dict) -> list[str]:
    return list(record)


def mask(s: TableStream, hidden: Sequence[str]) -> TableStream:
    """Hide columns from what follows, while the key keeps grouping."""
    return s.to(s.df.drop(*hidden))


def shift_to_now(s: TableStream) -> TableStream:
    """Shift all times so that the newest row is now."""
    newest = s.df.agg(F.max(col(TIME))).first()[0]
    from ..plans.stream import clock

    if newest is None:
        return s
    return time_shift(s, Duration(0, int((clock.now() - newest).total_seconds() * 10**6)))
