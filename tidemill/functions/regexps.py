"""Regular expressions of the RE2 kind on Java's engine."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import quote as quote_meta  # noqa: F401


def compile(pattern: str) -> str:  # noqa: A001
    """Checks a pattern and puts RE2's own spellings into Java's."""
    out = pattern.replace("(?P<", "(?<").replace(r"\z", r"\z").replace(r"\C", ".")
    re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", re.sub(r"\\[pP](\{\w+\}|\w)", "x", out)).replace(r"\z", r"\Z"))
    return out


def get_string(pattern: str) -> str:
    return pattern


def template(text: str) -> str:
    """$1 and ${1} of RE2's templates, for Java's."""
    return re.sub(r"\$\{(\d+)\}", r"$\1", text)


def find_string(v: Column, pattern: str) -> Column:
    return F.regexp_extract(v, f"({compile(pattern)})", 1)


def find_string_index(v: Column, pattern: str) -> Column:
    """[start, end) of the first match in bytes; [] without one."""
    at, found = F.regexp_instr(v, F.lit(compile(pattern))), find_string(v, pattern)
    start = F.octet_length(F.substring(v, F.lit(1), at - 1))
    pair = F.array(start, start + F.octet_length(found)).cast("array<bigint>")
    return F.when(at > 0, pair).otherwise(F.array().cast("array<bigint>"))


def match_string(v: Column, pattern: str) -> Column:
    return v.rlike(compile(pattern))


def replace_all_string(v: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(v, compile(pattern), template(replacement))


def split_regexp(v: Column, pattern: str, i: int) -> Column:
    if i == 0:
        return F.array().cast("array<string>")
    return F.split(v, compile(pattern), i)
