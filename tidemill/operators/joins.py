"""Joins. Sides meet within equal group keys (null-safe) and on plain equality."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.stream import TIME, Record, TableStream, as_column, col


def tables(left: TableStream, right: TableStream, on: Callable[[Record, Record], Column], as_: Callable[[Record, Record], dict] | None = None, method: str = "inner") -> TableStream:
    """Equi-join within group keys: ``on(l, r)`` is a conjunction of equalities,
    ``as_(l, r)`` the output record, in which the key must survive. On an
    unmatched side the key columns are there and the rest is null."""
    if method not in ("inner", "left", "right", "full"):
        raise ValueError(f"unknown join method {method!r}")
    if set(left.key) != set(right.key):
        raise ValueError("the sides' group keys differ")
    l, r = Record(left.columns, "l."), Record(right.columns, "r.")
    cond = on(l, r)
    for k in left.key:
        cond &= l[k].eqNullSafe(r[k])
    joined = left.df.alias("l").join(right.df.alias("r"), cond, method)

    class Side(Record):
        def __getitem__(self, name):
            if name in left.key and name in right.columns:
                return F.coalesce(l[name], r[name])
            return super().__getitem__(name)

    sl, sr = Side(left.columns, "l."), Side(right.columns, "r.")
    record = as_(sl, sr) if as_ else {**{c: sl[c] for c in left.columns}, **{c: sr[c] for c in right.columns if c not in left.columns}}
    lost = [k for k in left.key if k not in record]
    if lost:
        raise ValueError(f"join: group key columns are missing from the output: {lost}")
    return left.to(joined.select(*(as_column(v).alias(k) for k, v in record.items())), empty=None)


def inner(left, right, on, as_=None):
    return tables(left, right, on, as_, "inner")


def left(left_, right, on, as_=None):
    return tables(left_, right, on, as_, "left")


def right(left_, right_, on, as_=None):
    return tables(left_, right_, on, as_, "right")


def full(left_, right_, on, as_=None):
    return tables(left_, right_, on, as_, "full")


def time(left_, right_, as_=None, method: str = "inner"):
    """Join on _time."""
    return tables(left_, right_, lambda l, r: l[TIME] == r[TIME], as_, method)


def join(sides: dict[str, TableStream], on: Sequence[str], method: str = "inner") -> TableStream:
    """Inner join of two named streams on columns; other columns on both sides
    take the suffix ``_<name>``. A side without an ``on`` column gives nothing."""
    if method != "inner" or len(sides) != 2:
        raise ValueError("join takes two tables and the method 'inner'")
    (ln, l), (rn, r) = sides.items()
    clash = [c for c in l.columns if c in r.columns and c not in on]
    name = lambda c, side: f"{c}_{side}" if c in clash else c
    ldf = l.df.toDF(*(name(c, ln) for c in l.columns))
    rdf = r.df.toDF(*(name(c, rn) for c in r.columns))
    if any(c not in l.columns or c not in r.columns for c in on):
        missing = [c for c in on if c not in ldf.columns]
        empty = ldf.withColumns({c: F.lit(None).cast("string") for c in missing}).join(rdf.limit(0).select(*(col(c) for c in rdf.columns if c not in on)))
        return l.to(empty.limit(0), key=())
    key = dict.fromkeys([*(name(k, ln) for k in l.key), *(name(k, rn) for k in r.key)])
    order = tuple(name(o, ln) if isinstance(o, str) else o for o in l.order)
    return TableStream(ldf.join(rdf, list(on), "inner"), tuple(key), order)


def by_key(left_: TableStream, right_: TableStream, fn: Callable[[Record, Record], dict]) -> TableStream:
    """Inner join on the group key and _time with a row function."""
    return tables(left_, right_, lambda l, r: l[TIME] == r[TIME], fn, "inner")
