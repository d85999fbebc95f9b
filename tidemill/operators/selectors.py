"""Selectors keep whole rows: first, last, extremes, samples, sorts and top-k.

Row choice is ``row_number`` per table, which Spark turns into a group limit
before the shuffle; an ungrouped stream uses a global top-k instead.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.stream import TIME, VALUE, TableStream, col
from .aggregates import mean_of

_N = "__n"


def _pick(s: TableStream, order: list[Column], n: int = 1, offset: int = 0, where: Column | None = None, keys: Sequence[str] = ()) -> TableStream:
    df = s.df if where is None else s.df.where(where)
    if not s.key and not keys and order:
        out = df.orderBy(*order)
        return s.to((out.offset(offset) if offset else out).limit(n), empty=None)
    ranked = df.withColumn(_N, F.row_number().over(s.rows(*keys, order=order)))
    kept = ranked.where((F.col(_N) <= offset + n) & (F.col(_N) > offset)) if offset else ranked.where(F.col(_N) <= n)
    return s.to(kept.drop(_N), empty=None)


def first(s: TableStream, column: str = VALUE) -> TableStream:
    s.need(column)
    return _pick(s, s.ordering(), where=col(column).isNotNull())


def last(s: TableStream, column: str = VALUE) -> TableStream:
    s.need(column)
    return _pick(s, s.ordering(reverse=True), where=col(column).isNotNull())


def _extreme(s: TableStream, column: str, by: Column) -> TableStream:
    s.need(column)
    if s.df.schema[column].dataType.typeName() in ("string", "boolean", "binary"):
        raise TypeError(f"unsupported column type {s.df.schema[column].dataType.typeName()}")
    return _pick(s, [by, *s.ordering()], where=col(column).isNotNull())


def max(s: TableStream, column: str = VALUE) -> TableStream:  # noqa: A001
    return _extreme(s, column, col(column).desc())


def min(s: TableStream, column: str = VALUE) -> TableStream:  # noqa: A001
    return _extreme(s, column, col(column).asc())


def distinct(s: TableStream, column: str = VALUE) -> TableStream:
    """Distinct values in _value, null once, in the order first seen; a column
    that is not there gives one empty text a table."""
    if column not in s.columns:
        out = s.df.groupBy(*map(col, s.key)).agg(F.lit("").alias(VALUE)) if s.key else s.df.limit(1).select(F.lit("").alias(VALUE))
        return s.to(out, order=(), empty=None)
    order = F.struct(*(col(o) if isinstance(o, str) else o for o in s.order)) if s.order else F.lit(0)
    stay = [k for k in s.key if k != column]
    out = s.df.groupBy(*map(col, stay), col(column).alias("__v")).agg(F.min(order).alias("__first"))
    return s.to(out.withColumnRenamed("__v", VALUE), key=tuple(stay), order=("__first",), empty=None)


def unique(s: TableStream, column: str = VALUE) -> TableStream:
    s.need(column)
    return _pick(s, s.ordering(), keys=[column])


def limit(s: TableStream, n: int, offset: int = 0) -> TableStream:
    return _pick(s, s.ordering() or [F.lit(0)], n, offset)


def tail(s: TableStream, n: int, offset: int = 0) -> TableStream:
    return _pick(s, s.ordering(reverse=True) or [F.lit(0)], n, offset)


def sample(s: TableStream, n: int, pos: int = -1, column: str = VALUE) -> TableStream:
    """Every n-th row from ``pos``; a negative pos draws one."""
    if n < 1 or pos >= n:
        raise ValueError("need n >= 1 and pos < n")
    at = pos if pos >= 0 else random.randrange(n)
    ranked = s.df.withColumn(_N, F.row_number().over(s.rows()) - 1)
    return s.to(ranked.where((F.col(_N) >= at) & ((F.col(_N) - at) % n == 0)).drop(_N), empty=None)


def sort(s: TableStream, columns: Sequence[str] = (VALUE,), desc: bool = False) -> TableStream:
    """Order within tables: nulls first both ways. Nothing moves until needed."""
    by = tuple((col(c).desc_nulls_first() if desc else col(c).asc_nulls_first()) for c in columns if c in s.columns)
    return s.to(order=by)


def _by(s: TableStream, columns: Sequence[str], desc: bool) -> list[Column]:
    return [col(c).desc_nulls_first() if desc else col(c).asc_nulls_first() for c in columns]


def top(s: TableStream, n: int, columns: Sequence[str] = (VALUE,)) -> TableStream:
    s.need(*columns)
    out = _pick(s, _by(s, columns, True) + s.ordering(), n)
    return out.to(order=tuple(_by(s, columns, True)))


def bottom(s: TableStream, n: int, columns: Sequence[str] = (VALUE,)) -> TableStream:
    s.need(*columns)
    out = _pick(s, _by(s, columns, False) + s.ordering(), n)
    return out.to(order=tuple(_by(s, columns, False)))


def _groups(s: TableStream, n: int, column: str, group_columns: Sequence[str], desc: bool, select) -> TableStream:
    """One row of each group, the n highest or lowest; of equals the group seen
    first, as a stable sort of the groups has it."""
    chosen, pick = select(s.to(key=tuple(group_columns))), top if desc else bottom
    if not (group_columns and s.order and all(isinstance(o, str) for o in s.order)):
        return pick(chosen.to(key=()), n, [column])
    seen = s.df.groupBy(*map(col, group_columns)).agg(F.min(F.struct(*map(col, s.order))).alias("__seen"))
    same = [F.col(f"__c.`{k}`").eqNullSafe(F.col(f"__s.`{k}`")) for k in group_columns]
    on = same[0]
    for c in same[1:]:
        on &= c
    flat = chosen.df.alias("__c").join(seen.alias("__s"), on).select("__c.*", "__seen")
    out = pick(chosen.to(flat, key=(), order=("__seen",)), n, [column])
    return out.to(out.df.drop("__seen"))


def highest_max(s, n, column=VALUE, group_columns=()):
    return _groups(s, n, column, group_columns, True, lambda x: max(x, column))


def lowest_min(s, n, column=VALUE, group_columns=()):
    return _groups(s, n, column, group_columns, False, lambda x: min(x, column))


def _mean(x: TableStream, column: str) -> TableStream:
    return x.to(x.df.groupBy(*map(col, x.key)).agg(mean_of(x, column).alias(column)), order=(), empty=None)


def highest_average(s, n, column=VALUE, group_columns=()):
    return _groups(s, n, column, group_columns, True, lambda x: _mean(x, column))


def lowest_average(s, n, column=VALUE, group_columns=()):
    return _groups(s, n, column, group_columns, False, lambda x: _mean(x, column))


def highest_current(s, n, column=VALUE, group_columns=()):
    return _groups(s, n, column, group_columns, True, lambda x: last(x, column))


def lowest_current(s, n, column=VALUE, group_columns=()):
    return _groups(s, n, column, group_columns, False, lambda x: last(x, column))


def preview(s: TableStream, nrows: int = 5, ntables: int = 5) -> TableStream:
    """At most ``nrows`` rows of each of ``ntables`` tables."""
    if not s.key:
        return limit(s, nrows)
    keys = s.df.select(*map(col, s.key)).distinct().orderBy(*map(col, s.key)).limit(ntables)
    same = [F.col(f"__s.`{k}`").eqNullSafe(F.col(f"__k.`{k}`")) for k in s.key]
    on = same[0]
    for c in same[1:]:
        on &= c
    return limit(s.to(s.df.alias("__s").join(F.broadcast(keys).alias("__k"), on, "left_semi")), nrows)


__all__ = [n for n in globals() if not n.startswith("_") and n not in ("F", "TIME", "Column", "Sequence", "annotations", "random")]
