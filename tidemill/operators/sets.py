"""Union, row differences and assertions on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.stream import TableStream


def union(*streams: TableStream) -> TableStream:
    """All rows of all streams; schemas are united with nulls. A column with two
    types raises."""
    if not streams:
        raise ValueError("union needs at least one stream")
    kinds: dict[str, str] = {}
    for s in streams:
        for f in s.df.schema:
            if kinds.setdefault(f.name, f.dataType.simpleString()) != f.dataType.simpleString():
                raise TypeError(f"schema collision: column {f.name!r} is {kinds[f.name]} and {f.dataType.simpleString()}")
    df, key = streams[0].df, dict.fromkeys(streams[0].key)
    for s in streams[1:]:
        df = df.unionByName(s.df, allowMissingColumns=True)
        key |= dict.fromkeys(s.key)
    bounds = [s.bounds for s in streams if s.bounds]
    joint = (min(b[0] for b in bounds), max(b[1] for b in bounds)) if bounds else None
    return streams[0].to(df, key=tuple(key), bounds=joint, empty=None)


def diff(want: TableStream, got: TableStream) -> TableStream:
    """Rows of one stream only, marked in _diff: ``-`` wanted, ``+`` got."""
    cols = [c for c in want.columns if c in got.columns] + [c for c in want.columns if c not in got.columns] + [c for c in got.columns if c not in want.columns]
    a = want.df.unionByName(got.df.limit(0), allowMissingColumns=True).select(*cols)
    b = got.df.unionByName(want.df.limit(0), allowMissingColumns=True).select(*cols)
    only = a.exceptAll(b).withColumn("_diff", F.lit("-")).unionByName(b.exceptAll(a).withColumn("_diff", F.lit("+")))
    return want.to(only, empty=None)


def assert_equals(name: str, got: TableStream, want: TableStream) -> TableStream:
    if not diff(want, got).df.isEmpty():
        raise AssertionError(f"{name}: streams are not equal")
    return got


def assert_empty(s: TableStream) -> TableStream:
    if not s.df.isEmpty():
        raise AssertionError("expected no rows")
    return s


def assert_equal_values(got, want) -> None:
    if got != want:
        raise AssertionError(f"{got!r} is not {want!r}")


def should_error(fn, want: str) -> None:
    """Run ``fn``, whose error must have ``want`` in its message."""
    try:
        fn()
    except Exception as e:
        if want not in str(e):
            raise AssertionError(f"the error {e} does not have {want!r}") from e
        return
    raise AssertionError("expected an error")


def should_error_with_code(fn, want: str, code: int) -> None:
    """``should_error``, and the error's code (1 unless it has one) is ``code``."""
    try:
        fn()
    except Exception as e:
        if want not in str(e):
            raise AssertionError(f"the error {e} does not have {want!r}") from e
        if getattr(e, "code", 1) != code:
            raise AssertionError(f"the error has code {getattr(e, 'code', 1)}, not {code}") from e
        return
    raise AssertionError("expected an error")


def assert_matches(got: str, want: str) -> None:
    import re

    if not re.search(want, got):
        raise AssertionError(f"Regex `{want}` does not match `{got}`")


#: Names by which a test may be picked.
tags: list[str] = []


def fail() -> None:
    raise AssertionError("fail")


def make_any(value):
    return value


class make_record(dict):  # noqa: N801
    """A record of any fields, read as attributes."""

    __getattr__ = dict.get


def expect_plan(s: TableStream, pattern: str, count: int | None = None) -> None:
    """The physical plan must match the pattern (``count`` times)."""
    import re

    plan = s.df._jdf.queryExecution().executedPlan().toString()
    found = len(re.findall(pattern, plan))
    if found != count if count is not None else not found:
        raise AssertionError(f"{pattern!r} is {found} times in the plan")


def load(s: TableStream) -> TableStream:
    return s
