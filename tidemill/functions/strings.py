"""String functions as Columns. Index functions count UTF-8 bytes; lengths and
substrings count characters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def quote(text: str) -> str:
    """A literal as a Java pattern."""
    return re.sub(r"([\\^$.|?*+()\[\]{}\-/&#~])", r"\\\1", text)


def _set(chars: str) -> str:
    return "[" + "".join("\\" + ch if re.match(r"[\[\]\\^\-&~]", ch) else ch for ch in chars) + "]"


def title(v):
    """First letter of every word in upper case, the rest as it is."""
    parts = F.regexp_extract_all(_c(v), F.lit(r"([^\s]+|\s+)"), F.lit(1))
    return F.coalesce(F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), ""), _c(v))


def to_upper(v):
    return F.upper(_c(v))


to_title = to_upper


def to_lower(v):
    return F.lower(_c(v))


def trim(v, cutset: str):
    return F.regexp_replace(_c(v), f"^{_set(cutset)}+|{_set(cutset)}+$", "") if cutset else _c(v)


def trim_left(v, cutset: str):
    return F.regexp_replace(_c(v), f"^{_set(cutset)}+", "") if cutset else _c(v)


def trim_right(v, cutset: str):
    return F.regexp_replace(_c(v), f"{_set(cutset)}+$", "") if cutset else _c(v)


def trim_space(v):
    return F.regexp_replace(_c(v), r"(?U)^\s+|\s+$", "")


def trim_prefix(v, prefix):
    v, p = _c(v), _c(prefix)
    return F.when(F.startswith(v, p), F.substring(v, F.length(p) + 1, F.length(v))).otherwise(v)


def trim_suffix(v, suffix):
    v, p = _c(v), _c(suffix)
    return F.when(F.endswith(v, p), F.substring(v, F.lit(1), F.length(v) - F.length(p))).otherwise(v)


def has_prefix(v, prefix):
    return F.startswith(_c(v), _c(prefix))


def has_suffix(v, suffix):
    return F.endswith(_c(v), _c(suffix))


def contains_str(v, substr):
    return F.contains(_c(v), _c(substr))


def contains_any(v, chars: str):
    return _c(v).rlike(_set(chars)) if chars else F.lit(False)


def equal_fold(v, t):
    return F.lower(_c(v)) == F.lower(_c(t))


def compare(v, t):
    v, t = _c(v), _c(t)
    return F.when(v < t, -1).when(v > t, 1).when(v == t, 0).cast("long")


def count_str(v, substr: str):
    """Non-overlapping occurrences; an empty one counts characters plus one."""
    v = _c(v)
    if not substr:
        return (F.length(v) + 1).cast("long")
    return ((F.length(v) - F.length(F.replace(v, F.lit(substr)))) / len(substr)).cast("long")


def _bytes_before(v: Column, at: Column) -> Column:
    return F.when(at > 0, F.octet_length(F.substring(v, F.lit(1), at - 1))).otherwise(-1).cast("long")


def index(v, substr):
    v = _c(v)
    return _bytes_before(v, F.instr(v, _c(substr)))


def index_any(v, chars: str):
    v = _c(v)
    return _bytes_before(v, F.regexp_instr(v, F.lit(_set(chars)))) if chars else F.lit(-1).cast("long")


def last_index(v, substr: str):
    v = _c(v)
    at = F.instr(F.reverse(v), F.lit(substr[::-1]))
    return F.when(at > 0, F.octet_length(F.substring(v, F.lit(1), F.length(v) - at + 1 - len(substr)))).otherwise(-1).cast("long")


def last_index_any(v, chars: str):
    v = _c(v)
    at = F.regexp_instr(F.reverse(v), F.lit(_set(chars))) if chars else F.lit(0)
    return F.when(at > 0, F.octet_length(F.substring(v, F.lit(1), F.length(v) - at))).otherwise(-1).cast("long")


def is_digit(v):
    return _c(v).rlike(r"^\p{Nd}$")


def is_letter(v):
    return _c(v).rlike(r"^\p{L}$")


def is_lower(v):
    return _c(v).rlike(r"^\p{Ll}$")


def is_upper(v):
    return _c(v).rlike(r"^\p{Lu}$")


def repeat(v, i: int):
    return F.repeat(_c(v), i)


def replace(v, t: str, u: str, i: int):
    """The first i occurrences of t become u; all of them for i < 0."""
    if i < 0:
        return replace_all(v, t, u)
    parts = F.split(_c(v), quote(t), i + 1)
    head = F.slice(parts, 1, F.lit(i + 1))
    return F.array_join(head, u)


def replace_all(v, t: str, u: str):
    return F.replace(_c(v), F.lit(t), F.lit(u))


def split(v, t: str):
    return F.split(_c(v), quote(t), -1) if t else F.filter(F.split(_c(v), ""), lambda x: x != "")


def split_n(v, t: str, i: int):
    """At most i parts; i < 0: all; 0: none."""
    if i == 0:
        return F.array().cast("array<string>")
    return F.split(_c(v), quote(t), i)


def split_after(v, t: str):
    return F.split(_c(v), f"(?<={quote(t)})", -1)


def split_after_n(v, t: str, i: int):
    if i == 0:
        return F.array().cast("array<string>")
    return F.split(_c(v), f"(?<={quote(t)})", i)


def join_str(arr, v: str):
    return F.array_join(arr, v)


def strlen(v):
    return F.char_length(_c(v)).cast("long")


def substring(v, start, end):
    """Characters [start, end), both clamped to the text."""
    v = _c(v)
    a = F.greatest(_c(start), F.lit(0))
    b = F.least(_c(end), F.length(v))
    return F.when(b > a, F.substring(v, (a + 1).cast("int"), (b - a).cast("int"))).when(v.isNotNull(), F.lit(""))
