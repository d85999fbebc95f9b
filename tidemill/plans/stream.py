"""The one plan node of the engine: a DataFrame with what a DataFrame lacks.

A stream of tables is one DataFrame; a table is the rows that agree on the group
key. ``key`` and ``order`` are names of ordinary columns, so regrouping and
sorting move no data until an operator needs them. ``bounds`` are the [start,
stop) of the last range, ``empty`` the keys of tables without rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .duration import Duration, parse

TIME, START, STOP, VALUE = "_time", "_start", "_stop", "_value"


class Record:
    """Row proxy for lambdas: ``r._value``, ``r["_value"]``, ``r.exists("x")``.

    A column the table lacks reads as null, as an absent property does.
    """

    def __init__(self, columns: Sequence[str], prefix: str = ""):
        self._columns, self._prefix = list(columns), prefix

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self._prefix}`{name}`") if name in self._columns else F.lit(None)

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def exists(self, name: str) -> Column:
        return self[name].isNotNull()


def as_column(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def col(name: str) -> Column:
    """A column by its exact label, dots and all."""
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class TableStream:
    df: DataFrame
    key: tuple[str, ...] = ()
    order: tuple[str | Column, ...] = (TIME,)
    bounds: tuple[datetime, datetime] | None = None
    empty: DataFrame | None = None

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def r(self) -> Record:
        return Record(self.df.columns)

    def to(self, df: DataFrame | None = None, **changes) -> TableStream:
        """A copy; key and order keep only labels that are still there."""
        out = replace(self, **({"df": df} if df is not None else {}), **changes)
        there = set(out.df.columns)
        order = tuple(o for o in out.order if isinstance(o, Column) or o in there)
        return replace(out, key=tuple(k for k in out.key if k in there), order=order)

    def ordering(self, reverse: bool = False) -> list[Column]:
        """Row order in a table: nulls first, whichever the direction."""
        out = []
        for o in self.order:
            if isinstance(o, Column):
                out.append(o)
            else:
                out.append(col(o).desc_nulls_last() if reverse else col(o).asc_nulls_first())
        return out

    def rows(self, *more: str, order: list[Column] | None = None) -> WindowSpec:
        """Window over a table's rows in order."""
        return Window.partitionBy(*(col(k) for k in (*self.key, *more))).orderBy(*(order or self.ordering() or [F.lit(0)]))

    def before(self) -> WindowSpec:
        return self.rows().rowsBetween(Window.unboundedPreceding, -1)

    def upto(self) -> WindowSpec:
        return self.rows().rowsBetween(Window.unboundedPreceding, 0)

    def need(self, *names: str) -> None:
        missing = [n for n in names if n not in self.df.columns]
        if missing:
            raise ValueError(f"no column {', '.join(missing)}")

    def pipe(self, fn: Callable[..., TableStream], *args, **kw) -> TableStream:
        return fn(self, *args, **kw)

    def sorted(self) -> DataFrame:
        """The rows in table order, for delivery."""
        by = [col(k).asc_nulls_first() for k in self.key] + self.ordering()
        return self.df.orderBy(*by) if by else self.df


def table(df: DataFrame, key: Sequence[str] = (), order: Sequence[str | Column] | str = (TIME,), **renamed: str) -> TableStream:
    """Make a stream of a DataFrame; ``renamed`` maps conventional names to
    columns: ``table(events, _time="ts", _value="value")``."""
    for new, old in renamed.items():
        df = df.withColumnRenamed(old, new)
    order = (order,) if isinstance(order, str) else tuple(order)
    return TableStream(df, tuple(key), tuple(o for o in order if isinstance(o, Column) or o in df.columns))


class Clock:
    """The query's now: one instant for all relative bounds; ``set`` fixes it."""

    def __init__(self):
        self._fixed: datetime | None = None

    def set(self, t: datetime | None) -> None:
        self._fixed = t

    def now(self) -> datetime:
        return self._fixed or datetime.now(UTC).replace(tzinfo=None)


clock = Clock()


def instant(value: datetime | str | Duration) -> datetime:
    """A time, a text in RFC 3339, or a duration relative to now."""
    if isinstance(value, datetime):
        return value if value.tzinfo is None else value.astimezone(UTC).replace(tzinfo=None)
    if isinstance(value, Duration):
        return value.after(clock.now())
    if value[:1] in "-0123456789" and "T" not in value and value.count("-") < 2:
        return parse(value).after(clock.now())
    t = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return t if t.tzinfo is None else t.astimezone(UTC).replace(tzinfo=None)


def time_lit(t: datetime) -> Column:
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
