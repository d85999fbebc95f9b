"""Strict conversions: what can't be converted raises; null stays null."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.duration import Duration, parse

UINT = "decimal(20,0)"
_WRAP = F.lit


def _kind(kind: T.DataType | None) -> type:
    return type(kind) if kind is not None else T.StringType


def _fail(c: Column, what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"cannot convert to {what}: "), c.cast("string")))


def rfc3339(c: Column) -> Column:
    """A time as text, without trailing zeros of the second's fraction."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0+$", "")
    return F.concat(whole, part, F.lit("Z"))


def string(c: Column, kind: T.DataType | None = None) -> Column:
    k = _kind(kind)
    if k is T.TimestampType:
        return rfc3339(c)
    if k is T.BinaryType:
        return F.decode(c, "UTF-8")
    if k in (T.DoubleType, T.FloatType):
        text = F.regexp_replace(c.cast("string"), r"\.0$", "")
        return F.when(F.isnan(c), "NaN").when(c == float("inf"), "+Inf").when(c == float("-inf"), "-Inf").otherwise(text)
    return c.cast("string")


def int_(c: Column, kind: T.DataType | None = None) -> Column:
    k = _kind(kind)
    if k is T.TimestampType:
        return F.unix_micros(c) * 1000
    if k is T.BooleanType:
        return F.when(c, F.lit(1)).when(~c, F.lit(0)).cast("long")
    if k is T.DecimalType:  # an unsigned number's bits as a signed one
        return F.when(c >= F.lit(2**63).cast(UINT), c - F.lit(str(2**64)).cast("decimal(21,0)")).otherwise(c).cast("long")
    return c.cast("long")


def uint(c: Column, kind: T.DataType | None = None) -> Column:
    n = int_(c, kind) if _kind(kind) is not T.StringType else c.cast("decimal(20,0)")
    wide = n.cast("decimal(21,0)")
    return F.when(wide < 0, wide + F.lit(str(2**64)).cast("decimal(21,0)")).otherwise(wide).cast(UINT)


def float_(c: Column, kind: T.DataType | None = None) -> Column:
    k = _kind(kind)
    if k is T.BooleanType:
        return F.when(c, 1.0).when(~c, 0.0)
    if k is T.StringType:
        low = F.lower(F.trim(c))
        plain = F.when(low.isin("inf", "+inf", "infinity", "+infinity"), float("inf")).when(low.isin("-inf", "-infinity"), float("-inf")).when(low == "nan", float("nan"))
        return plain.otherwise(c.cast("double"))
    return c.cast("double")


def bool_(c: Column, kind: T.DataType | None = None) -> Column:
    k = _kind(kind)
    if k is T.BooleanType:
        return c
    yes, no = (F.lit("true"), F.lit("false")) if k is T.StringType else (F.lit(1), F.lit(0))
    return F.when(c.isNull(), F.lit(None).cast("boolean")).when(c == yes, True).when(c == no, False).otherwise(_fail(c, "bool").cast("boolean"))


def time(c: Column, kind: T.DataType | None = None) -> Column:
    k = _kind(kind)
    if k is T.TimestampType:
        return c
    if k is T.StringType:
        return c.cast("timestamp")
    return F.timestamp_micros(F.floor(c.cast("decimal(20,0)") / 1000).cast("long"))


def bytes_(c: Column, kind: T.DataType | None = None) -> Column:
    return c.cast("string").cast("binary")


def duration(value) -> Duration:
    """From text or whole nanoseconds, on the driver."""
    return parse(value)


def display(c: Column, kind: T.DataType | None = None) -> Column:
    """Readable text of any value, composites included; nulls read <null>."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(("" if i == 0 else ", ") + f.name + ": "), display(c[f.name], f.dataType)) for i, f in enumerate(kind)]
        text = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: display(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pair = lambda e: F.concat(display(e["key"], kind.keyType), F.lit(": "), display(e["value"], kind.valueType))
        text = F.concat(F.lit("["), F.array_join(F.transform(F.map_entries(c), pair), ", "), F.lit("]"))
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("0x"), F.lower(F.hex(c)))
    else:
        text = string(c, kind)
    return F.coalesce(text, F.lit("<null>"))


def contains(value, items: Column | list) -> Column:
    return F.array_contains(items, value) if isinstance(items, Column) else F.lit(value).isin(*items) if not isinstance(value, Column) else value.isin(*items)


def length(c: Column) -> Column:
    return F.size(c)


def is_type(kind: T.DataType, name: str) -> bool:
    """Test a column's type by the engine's name for it."""
    names = {"bool": T.BooleanType, "int": (T.LongType, T.IntegerType), "uint": T.DecimalType, "float": (T.DoubleType, T.FloatType), "string": T.StringType, "time": T.TimestampType, "bytes": T.BinaryType, "array": T.ArrayType, "dictionary": T.MapType, "record": T.StructType, "dynamic": T.VariantType}
    return isinstance(kind, names[name])


def is_numeric(kind: T.DataType) -> bool:
    return any(is_type(kind, n) for n in ("int", "uint", "float"))


def today() -> datetime:
    from ..plans.stream import clock

    return clock.now().replace(hour=0, minute=0, second=0, microsecond=0)
