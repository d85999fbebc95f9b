"""Dynamic queries: a table, column or record out of a stream, on the driver."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NoReturn

from ..plans.stream import TableStream, col


class Row(dict):
    __getattr__ = dict.get


def table_find(s: TableStream, fn: Callable[[Row], bool]) -> TableStream:
    """The first table (in key order) whose key satisfies ``fn``."""
    keys = s.df.select(*map(col, s.key)).distinct().orderBy(*map(col, s.key)).toLocalIterator() if s.key else iter([{}])
    for row in keys:
        key = Row(row.asDict() if s.key else {})
        if fn(key):
            df = s.df
            for k, v in key.items():
                df = df.where(col(k).eqNullSafe(v))
            return s.to(df)
    raise LookupError("no table found")


def get_column(s: TableStream, column: str) -> list:
    s.need(column)
    return [r[0] for r in s.df.orderBy(*s.ordering()).select(col(column)).collect()]


def get_record(s: TableStream, idx: int) -> dict:
    rows = s.df.orderBy(*s.ordering()).offset(idx).limit(1).collect()
    if not rows:
        raise IndexError(f"index out of bounds: {idx}")
    return rows[0].asDict(recursive=True)


def find_column(s: TableStream, fn: Callable[[Row], bool], column: str) -> list:
    try:
        return get_column(table_find(s, fn), column)
    except (LookupError, ValueError):
        return []


def find_record(s: TableStream, fn: Callable[[Row], bool], idx: int) -> dict:
    try:
        return get_record(table_find(s, fn), idx)
    except LookupError:
        return {}


def catch(fn: Callable[[], Any]) -> dict:
    """Run ``fn``; its value, or the error's code and message."""
    try:
        return {"value": fn(), "code": 0, "msg": ""}
    except Exception as e:
        return {"value": None, "code": 1, "msg": str(e)}


def die(msg: str) -> NoReturn:
    raise RuntimeError(msg)


class Results(dict):
    """Named results of a query: ``results.yield_(stream, "name")``."""

    def yield_(self, s: TableStream, name: str = "_result") -> TableStream:
        if name in self:
            raise ValueError(f"duplicate result name {name!r}")
        self[name] = s.sorted()
        return s


def chain(first: TableStream, second: Callable[[], TableStream]) -> TableStream:
    """Run the first query to its end, then make the second."""
    first.df.write.format("noop").mode("overwrite").save()
    return second()
