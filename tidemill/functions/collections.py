"""Arrays, dictionaries, records, JSON and dynamic values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import convert


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def array_concat(arr: Column, v: Column) -> Column:
    return F.concat(arr, v)


def array_map(arr: Column, fn: Callable[[Column], Column]) -> Column:
    return F.transform(arr, fn)


def array_filter(arr: Column, fn: Callable[[Column], Column]) -> Column:
    return F.filter(arr, fn)


def _each(fn):
    return lambda arr, kind=None: F.transform(arr, lambda x: fn(x, kind))


array_to_bool, array_to_float, array_to_int = _each(convert.bool_), _each(convert.float_), _each(convert.int_)
array_to_string, array_to_time, array_to_uint = _each(convert.string), _each(convert.time), _each(convert.uint)


def array_to_duration(arr: Column) -> Column:
    """Texts like 1h30m as nanoseconds."""
    unit = {"w": 604800, "d": 86400, "h": 3600, "ms": 0.001, "us": 1e-6, "ns": 1e-9, "m": 60, "s": 1}

    def one(x):
        total = F.lit(0).cast("long")
        for u, sec in unit.items():
            tail = "(?!s)" if u == "m" else ""
            n = F.regexp_extract(x, rf"(\d+){u}{tail}(?![a-z])|(\d+){u}{tail}(?=\d)", 0)
            total = total + F.coalesce(F.nullif(F.regexp_extract(n, r"\d+", 0), F.lit("")).cast("long"), F.lit(0)) * int(sec * 1e9 + 0.5)
        return F.when(x.startswith("-"), -total).otherwise(total)

    return F.transform(arr, one)


def dict_from_list(pairs: Column) -> Column:
    return F.map_from_entries(pairs)


def dict_get(d: Column, key, default) -> Column:
    return F.coalesce(F.try_element_at(d, _c(key)), _c(default))


def dict_insert(d: Column, key, value) -> Column:
    k = _c(key)
    return F.map_concat(F.map_filter(d, lambda x, _: x != k), F.create_map(k, _c(value)))


def dict_remove(d: Column, key) -> Column:
    k = _c(key)
    return F.map_filter(d, lambda x, _: x != k)


#: A record without fields.
any_record: dict = {}


def record_get(record: Column, kind: T.StructType, key: str, default) -> Column:
    """A field by name, or the default if the record's type lacks it."""
    return F.coalesce(record[key], _c(default)) if key in kind.names else _c(default)


def json_encode(v: Column, kind: T.DataType | None = None) -> Column:
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(v).cast("binary")
    return F.regexp_replace(F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":|\}$', "").cast("binary")


def json_parse(v: Column, schema: str | T.StructType) -> Column:
    """JSON bytes as a record; use ``F.schema_of_json`` to learn a schema."""
    return F.from_json(v.cast("string"), schema)


def dynamic(v: Column, kind: T.DataType | None = None) -> Column:
    return F.parse_json(json_encode(v, kind).cast("string"))


def dynamic_json_parse(v: Column) -> Column:
    return F.parse_json(v.cast("string"))


def dynamic_json_encode(v: Column) -> Column:
    return F.to_json(v).cast("binary")


def dynamic_as_array(v: Column) -> Column:
    return F.variant_get(v, "$", "array<variant>")


def dynamic_get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def dynamic_is_type(v: Column, name: str) -> Column:
    """Run-time type of a dynamic value."""
    kind = F.schema_of_variant(v)
    return {
        "string": kind == "STRING",
        "bool": kind == "BOOLEAN",
        "int": kind == "BIGINT",
        "float": kind.rlike("^(DOUBLE|FLOAT|DECIMAL|BIGINT)"),
        "array": kind.startswith("ARRAY"),
        "object": kind.startswith("OBJECT"),
        "null": kind == "VOID",
    }[name]


def dynamic_equal(a: Column, b: Column) -> Column:
    return F.to_json(a).eqNullSafe(F.to_json(b))
