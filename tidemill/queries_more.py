"""Registered queries of what ``queries`` leaves: conversions, constants, sources
and sinks (written, read back and compared), extraction, monitoring, messages,
regions, engine hooks. Small literal tables where an operator needs them."""

from __future__ import annotations

import json
import math
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import bits, collections, convert, dates, geo, maths, regexps, strings
from .operators import aggregates, composed, extract, joins, monitor, selectors, sequences, sets, shape, windows
from .plans import duration as durations
from .plans import engine
from .plans.duration import parse
from .plans.stream import TIME, VALUE, TableStream, clock, col, table
from .queries import QUERIES, SQL, W, add, ev, fn, op, read
from .sources import sinks, tables
from .streaming import ingest


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


def one(name: str, make: Callable[[SparkSession], dict[str, object]], sql: str) -> None:
    """A query of one row of scalars, columns or plain values."""
    add(name, lambda s, d: s.range(1).select(*(as_column(v).alias(k) for k, v in make(s).items())), f"SELECT {sql}")


def as_column(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


NOW = datetime(2024, 1, 17, 10, 30, 15)  # a Wednesday


def at_now(make: Callable):
    """Run ``make`` with the clock at NOW."""

    def run(*args):
        clock.set(NOW)
        try:
            return make(*args)
        finally:
            clock.set(None)

    return run


# Conversions and types

fn("bool", "events", "event_id", lambda: convert.bool_(F.col("event_id") % 2, T.LongType()), "event_id % 2 = 1")
fn("bytes", "part", "p_partkey", lambda: F.hex(convert.bytes_(F.col("p_name"))), "hex(p_name)")
fn("float", "events", "event_id", lambda: convert.float_(F.concat(F.col("user_id").cast("string"), F.lit(".5"))), "user_id + 0.5")
fn("vectorized_float", "events", "event_id", lambda: convert.float_(F.col("user_id"), T.LongType()), "user_id::DOUBLE")
fn("int", "events", "event_id", lambda: convert.int_(F.col("user_id").cast("string")), "user_id::BIGINT")
fn("string", "events", "event_id", lambda: convert.string(F.col("user_id").cast("double"), T.DoubleType()), "user_id::VARCHAR")
fn("uint", "events", "event_id", lambda: convert.uint(-F.col("user_id"), T.LongType()).cast("string"), "CASE WHEN user_id = 0 THEN '0' ELSE (18446744073709551616 - user_id::HUGEINT)::VARCHAR END")
fn("time", "events", "event_id", lambda: convert.time(F.col("event_id") * 1_000_000_000, T.LongType()), "TIMESTAMP '1970-01-01' + to_seconds(event_id)")
fn("display", "region", "r_regionkey", lambda: convert.display(F.struct(F.col("r_regionkey").alias("k"), F.array("r_name", F.lit(None).cast("string")).alias("n")), T.StructType([T.StructField("k", T.IntegerType()), T.StructField("n", T.ArrayType(T.StringType()))])), "'{k: ' || r_regionkey || ', n: [' || r_name || ', <null>]}'")
one("duration_literal", lambda s: {"us": convert.duration("1h30m").micros, "months": convert.duration("1y2mo").months, "ns": parse("1us").micros * 1000}, "5400000000 AS us, 14 AS months, 1000 AS ns")
one("inf_duration", lambda s: {"infinite": durations.INF.infinite, "finite": parse("1d").infinite}, "true AS infinite, false AS finite")
one("now", at_now(lambda s: {"now": F.lit(clock.now().isoformat()), "day": F.lit(convert.today().isoformat())}), "'2024-01-17T10:30:15' AS now, '2024-01-17T00:00:00' AS day")
one("today", at_now(lambda s: {"day": F.lit(convert.today().isoformat())}), "'2024-01-17T00:00:00' AS day")
one("system_time", lambda s: {"fresh": abs((dates.system_time() - datetime.now(dates.UTC).replace(tzinfo=None)).total_seconds()) < 60}, "true AS fresh")
_KINDS = {"bool": T.BooleanType(), "int": T.LongType(), "uint": T.DecimalType(20, 0), "float": T.DoubleType(), "string": T.StringType(), "time": T.TimestampType(), "bytes": T.BinaryType(), "array": T.ArrayType(T.LongType()), "record": T.StructType([])}
add("is_type", lambda s, d: rows(s, "kind string, asked string, out boolean", *((k, a, convert.is_type(t, a)) for k, t in _KINDS.items() for a in _KINDS)), f"SELECT kind, asked, kind = asked AS out FROM (SELECT unnest({list(_KINDS)}) AS kind) CROSS JOIN (SELECT unnest({list(_KINDS)}) AS asked)")
add("is_numeric", lambda s, d: rows(s, "kind string, out boolean", *((k, convert.is_numeric(t)) for k, t in _KINDS.items())), f"SELECT kind, kind IN ('int', 'uint', 'float') AS out FROM (SELECT unnest({list(_KINDS)}) AS kind)")
_WORDS = lambda: F.split("p_name", " ")
fn("array_to_string", "part", "p_partkey", lambda: F.array_join(collections.array_to_string(F.array("p_size", "p_partkey"), T.LongType()), ","), "p_size || ',' || p_partkey")
fn("array_to_int", "part", "p_partkey", lambda: F.array_join(collections.array_to_int(F.array(F.col("p_size") + 0.5, F.col("p_size") + 0.25), T.DoubleType()).cast("array<string>"), ","), "p_size || ',' || p_size")
fn("array_to_uint", "part", "p_partkey", lambda: F.array_join(collections.array_to_uint(F.array("p_size", "p_partkey"), T.LongType()).cast("array<string>"), ","), "p_size || ',' || p_partkey")
fn("array_to_float", "part", "p_partkey", lambda: F.aggregate(collections.array_to_float(F.array(F.col("p_size").cast("string"), F.lit("0.5"))), F.lit(0.0), lambda a, x: a + x), "p_size + 0.5")
fn("array_to_bool", "part", "p_partkey", lambda: F.element_at(collections.array_to_bool(F.array(F.col("p_size").cast("long") % 2), T.LongType()), 1), "p_size % 2 = 1")
fn("array_to_time", "part", "p_partkey", lambda: F.element_at(collections.array_to_time(F.array(F.col("p_size").cast("long") * 1_000_000_000), T.LongType()), 1), "TIMESTAMP '1970-01-01' + to_seconds(p_size::BIGINT)")
fn("array_to_duration", "part", "p_partkey", lambda: F.element_at(collections.array_to_duration(F.array(F.concat(F.lit("1h"), F.col("p_size").cast("string"), F.lit("m")))), 1), "(3600 + 60 * p_size::BIGINT) * 1000000000")

# Strings and regular expressions

fn("to_title", "part", "p_partkey", lambda: strings.to_upper(F.col("p_name")), "upper(p_name)")
fn("index_any", "part", "p_partkey", lambda: strings.index_any(F.col("p_name"), "xyz "), "coalesce(list_min(list_filter([instr(p_name, 'x'), instr(p_name, 'y'), instr(p_name, 'z'), instr(p_name, ' ')], lambda i: i > 0)), 0) - 1")
fn("last_index_any", "part", "p_partkey", lambda: strings.last_index_any(F.col("p_name"), "e "), "length(p_name) - list_min(list_filter([instr(reverse(p_name), 'e'), instr(reverse(p_name), ' ')], lambda i: i > 0))")
fn("split_after", "part", "p_partkey", lambda: F.array_join(strings.split_after(F.col("p_name"), "e"), "|"), "regexp_replace(p_name, 'e', 'e|', 'g')")
fn("split_after_n", "part", "p_partkey", lambda: F.array_join(strings.split_after_n(F.col("p_name"), "e", 2), "|"), "regexp_replace(p_name, 'e', 'e|')")
fn("regexp_compile", "part", "p_partkey", lambda: regexps.find_string(F.col("p_name"), regexps.compile("(?P<first>[a-c])l")), "regexp_extract(p_name, '[a-c]l')")
fn("regexp_quote_meta", "part", "p_partkey", lambda: regexps.match_string(F.concat("p_name", F.lit(".+")), regexps.quote_meta(".+") + "$"), "true")
one("regexp_get_string", lambda s: {"out": regexps.get_string("[a-z]+")}, "'[a-z]+' AS out")

# Times

fn("date_nanosecond", "events", "event_id", lambda: dates.nanosecond(F.col("ts")), "(epoch_us(ts) % 1000000) * 1000")
fn("date_time", "events", "event_id", lambda: dates.time(F.col("ts")), "ts")
fn("date_scale", "events", "event_id", lambda: dates.add(dates.scale("1mo", 3), F.col("ts")), "ts + INTERVAL 3 MONTH")
fn("add_duration", "events", "event_id", lambda: dates.add("36h", F.col("ts")), "ts + INTERVAL 36 HOUR")
fn("sub_duration", "events", "event_id", lambda: dates.sub("1y", F.col("ts")), "ts - INTERVAL 1 YEAR")
fn("date_add_zoned", "events", "event_id", lambda: dates.add("1mo", F.col("ts"), "America/New_York"), "ts - INTERVAL 5 HOUR + INTERVAL 1 MONTH + INTERVAL 5 HOUR")
fn("date_truncate_zoned", "events", "event_id", lambda: dates.truncate(F.col("ts"), "1d", "America/New_York"), "date_trunc('day', ts - INTERVAL 5 HOUR) + INTERVAL 5 HOUR")
_DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
for _n, _a, _b in [("yesterday", "2024-01-16", "2024-01-17"), ("week", "2024-01-15", "2024-01-22"), ("month", "2024-01-01", "2024-02-01")] + [(n, f"2024-01-{[15, 16, 10, 11, 12, 13, 14][i]}", f"2024-01-{[16, 17, 11, 12, 13, 14, 15][i]}") for i, n in enumerate(_DAYS)]:
    one(f"boundaries_{_n}", at_now(lambda s, n=_n: {k: F.lit(v.isoformat()) for k, v in windows.bounds_of(n).items()}), f"'{_a}T00:00:00' AS start, '{_b}T00:00:00' AS stop")
one("boundaries_day_finder", at_now(lambda s: {n: F.lit(windows.day_finder(i).isoformat()) for i, n in enumerate(("sunday", "monday", "tuesday", "wednesday"))}), "'2024-01-14T00:00:00' AS sunday, '2024-01-15T00:00:00' AS monday, '2024-01-16T00:00:00' AS tuesday, '2024-01-10T00:00:00' AS wednesday")
one("boundaries_day_formatter", lambda s: {k: F.lit(v.isoformat()) for k, v in windows.day_formatter(datetime(2024, 2, 28)).items()}, "'2024-02-28T00:00:00' AS start, '2024-02-29T00:00:00' AS stop")
one("boundaries_week_formatter", lambda s: {k: F.lit(v.isoformat()) for k, v in windows.week_formatter(datetime(2024, 2, 26)).items()}, "'2024-02-26T00:00:00' AS start, '2024-03-04T00:00:00' AS stop")
fn("timezone_fixed", "events", "event_id", lambda: dates.hour(F.col("ts"), dates.fixed_location("-8h")), "hour(ts - INTERVAL 8 HOUR)::BIGINT")
fn("timezone_location", "events", "event_id", lambda: dates.hour(F.col("ts"), dates.location("Asia/Tokyo")), "hour(ts + INTERVAL 9 HOUR)::BIGINT")
fn("timezone_utc", "events", "event_id", lambda: dates.hour(F.col("ts"), dates.UTC_ZONE), "hour(ts)::BIGINT")
add("date_constants", lambda s, d: rows(s, "name string, n long", *dates.WEEKDAYS.items(), *dates.MONTHS.items()), "SELECT strftime(DATE '2024-01-07' + i::INTEGER, '%A') AS name, i AS n FROM (SELECT unnest(range(7)) AS i) UNION ALL SELECT strftime(DATE '2024-01-15' + to_months(i::INTEGER), '%B'), i + 1 FROM (SELECT unnest(range(12)) AS i)")

# Math

_CONST = {"pi": "pi()", "e": "exp(1)", "phi": "(1 + sqrt(5)) / 2", "sqrt2": "sqrt(2)", "sqrte": "sqrt(exp(1))", "sqrtpi": "sqrt(pi())", "sqrtphi": "sqrt((1 + sqrt(5)) / 2)", "ln2": "ln(2)", "log2e": "1 / ln(2)", "ln10": "ln(10)", "log10e": "1 / ln(10)"}
for _n, _s in _CONST.items():
    one(f"math_const_{_n}", lambda s, n=_n: {"out": F.lit(round(getattr(maths, n), 12))}, f"round({_s}, 12) AS out")
one("math_maxfloat", lambda s: {"out": F.lit(maths.maxfloat) == F.lit(1.7976931348623157e308)}, "1.7976931348623157e308 * 10 = 'inf'::DOUBLE AS out")
one("math_smallest_nonzero_float", lambda s: {"positive": F.lit(maths.smallest_nonzero_float) > 0, "half": F.lit(maths.smallest_nonzero_float) / 2}, "true AS positive, 0.0 AS half")
one("math_maxint", lambda s: {"out": F.lit(str(maths.maxint))}, "(pow(2::HUGEINT, 62)::HUGEINT * 2 - 1)::VARCHAR AS out")
one("math_minint", lambda s: {"out": F.lit(str(maths.minint))}, "(-(pow(2::HUGEINT, 62)::HUGEINT * 2))::VARCHAR AS out")
one("math_maxuint", lambda s: {"out": F.lit(str(maths.maxuint))}, "(pow(2::HUGEINT, 62)::HUGEINT * 4 - 1)::VARCHAR AS out")
one("math_m_inf", lambda s: {"up": maths.is_inf(maths.m_inf(1), 1), "down": maths.is_inf(maths.m_inf(-1), -1), "up_is_down": maths.is_inf(maths.m_inf(1), -1)}, "true AS up, true AS down, false AS up_is_down")
one("math_nan", lambda s: {"out": maths.is_nan(maths.nan())}, "true AS out")
_X = lambda: F.col("p_size") / 60.0
_x = "(p_size / 60.0::DOUBLE)"
_fact = "gamma(n + 1.0)"
_sum = lambda term: f"list_sum(list_transform(range(0, 30), lambda n: {term}))"
_harm = lambda n: f"coalesce(list_sum(list_transform(range(1, ({n} + 1)::BIGINT), lambda k: 1.0 / k)), 0)"
_ERF = f"(2 / sqrt(pi()) * {_sum(f'pow(-1, n) * pow({_x}, 2 * n + 1) / ({_fact} * (2 * n + 1))')})"
_J = lambda m: _sum(f"pow(-1, n) * pow({_x} / 2, 2 * n + {m}) / ({_fact} * gamma(n + {m} + 1.0))")
_Y0 = f"(2 / pi() * ((ln({_x} / 2) + 0.5772156649015329) * {_J(0)} + {_sum(f'pow(-1, n + 1) * {_harm('n')} * pow({_x} / 2, 2 * n) / pow({_fact}, 2)')}))"
_Y1 = f"(2 / pi() * ln({_x} / 2) * {_J(1)} - 2 / (pi() * {_x}) - 1 / pi() * {_sum(f'pow(-1, n) * ({_harm('n')} + {_harm('n + 1')} - 2 * 0.5772156649015329) * pow({_x} / 2, 2 * n + 1) / ({_fact} * gamma(n + 2.0))')})"
_SPECIAL = {
    "erf": (maths.erf, _ERF), "erfc": (maths.erfc, f"1 - {_ERF}"), "j0": (maths.j0, _J(0)), "j1": (maths.j1, _J(1)), "jn": (lambda x: maths.jn(2, x), _J(2)),
    "y0": (maths.y0, _Y0), "y1": (maths.y1, _Y1), "yn": (lambda x: maths.yn(2, x), f"(2 / {_x} * {_Y1} - {_Y0})"),
    "erfinv": (lambda x: maths.erf(maths.erfinv(x)), _x), "erfcinv": (lambda x: maths.erfc(maths.erfcinv(x)), _x),
    "logb": (maths.logb, f"floor(log2({_x}))"), "ilogb": (maths.ilogb, f"floor(log2({_x}))"),
    "remainder": (lambda x: maths.remainder(x, 0.25), f"({_x} - 0.25 * round_even({_x} / 0.25, 0))"),
}
for _n, (_e, _s) in _SPECIAL.items():
    fn(f"math_{_n}", "part", "p_partkey", lambda e=_e: F.round(e(_X()).cast("double"), 6), f"round({_s}, 6)::DOUBLE")
_BITS = f"((floor(log2({_x})) + 1023)::HUGEINT * 4503599627370496 + (({_x} / pow(2, floor(log2({_x}))) - 1) * 4503599627370496)::HUGEINT)"
fn("math_float64bits", "part", "p_partkey", lambda: maths.float64bits(_X()).cast("string"), f"{_BITS}::VARCHAR")
fn("math_float64frombits", "part", "p_partkey", lambda: maths.float64frombits(maths.float64bits(_X())), _x)
fn("math_frexp", "part", "p_partkey", lambda: F.concat_ws(" ", maths.frexp(_X())["exp"].cast("string"), F.round(maths.frexp(_X())["frac"], 6).cast("string")), f"concat_ws(' ', (floor(log2({_x})) + 1)::BIGINT::VARCHAR, round({_x} / pow(2, floor(log2({_x})) + 1), 6)::VARCHAR)")
fn("math_lgamma", "part", "p_partkey", lambda: F.round(maths.lgamma(_X() + 1)["lgamma"] * maths.lgamma(_X() + 1)["sign"], 6), f"round(lgamma({_x} + 1), 6)")
fn("math_modf", "part", "p_partkey", lambda: F.round(maths.modf(_X() * 7)["int"] * 10 + maths.modf(_X() * 7)["frac"], 6), f"round(trunc({_x} * 7) * 10 + ({_x} * 7 - trunc({_x} * 7)), 6)")
fn("math_nextafter", "part", "p_partkey", lambda: maths.float64bits(maths.nextafter(_X(), F.lit(2.0))).cast("string"), f"({_BITS} + 1)::VARCHAR")
fn("math_sincos", "part", "p_partkey", lambda: F.round(maths.sincos(_X())["sin"] + 2 * maths.sincos(_X())["cos"], 6), f"round(sin({_x}) + 2 * cos({_x}), 6)")

# Hashes and hex: published digests of known texts

_HASHED = [("", "17241709254077376921", "11160318154034397263"), ("a", "15154266338359012955", "12917804110809363939"), ("abc", "4952883123889572249", "2640714258260161385")]
add("hash_xxhash64", lambda s, d: rows(s, "t string", *((t,) for t, *_ in _HASHED)).select("t", bits.xxhash64(F.col("t")).cast("string").alias("out")), "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{x}')" for t, x, _ in _HASHED) + ") v(t, out)")
add("hash_cityhash64", lambda s, d: rows(s, "t string", *((t,) for t, *_ in _HASHED)).select("t", bits.cityhash64(F.col("t")).cast("string").alias("out")), "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{x}')" for t, _, x in _HASHED) + ") v(t, out)")
add("hash_hmac", lambda s, d: rows(s, "t string", ("The quick brown fox jumps over the lazy dog",)).select("t", F.lower(F.hex(F.unbase64(bits.hmac(F.col("t"), "key")))).alias("out")), "SELECT 'The quick brown fox jumps over the lazy dog' AS t, 'de7c9b85b8b78aa6bc8a7a36f70a90701c9db4d9' AS out")
fn("hex_uint", "part", "p_partkey", lambda: bits.hex_uint(F.lower(F.hex("p_partkey"))).cast("string"), "p_partkey::VARCHAR")
fn("hex_bytes", "part", "p_partkey", lambda: bits.hex_bytes(F.hex(F.col("p_name").cast("binary"))).cast("string"), "p_name")

# Dictionaries, records, JSON and dynamic values

fn("dict_from_list", "part", "p_partkey", lambda: collections.dict_get(collections.dict_from_list(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(v, F.lit(0)).alias("v")) for k, v in (("a", F.col("p_size")), ("b", F.lit(7)))))), "a", -1), "p_size")
one("record_any", lambda s: {"fields": len(collections.any_record)}, "0 AS fields")
_REC = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
fn("record_get", "part", "p_partkey", lambda: F.concat_ws("|", collections.record_get(F.struct(F.col("p_size").alias("a"), F.col("p_name").alias("b")), _REC, "b", "none"), collections.record_get(F.struct(F.col("p_size").alias("a"), F.col("p_name").alias("b")), _REC, "c", "none")), "p_name || '|none'")
fn("json_encode", "part", "p_partkey", lambda: collections.json_encode(F.struct(F.col("p_size").alias("a"), F.col("p_name").alias("b")), _REC).cast("string"), """'{"a":' || p_size || ',"b":"' || p_name || '"}'""")
fn("dynamic", "part", "p_partkey", lambda: collections.dynamic_get(collections.dynamic(F.struct(F.col("p_size").alias("a"), F.col("p_name").alias("b")), _REC), "$.a", "long"), "p_size")
fn("dynamic_as_array", "part", "p_partkey", lambda: F.size(collections.dynamic_as_array(collections.dynamic(F.split("p_name", " "), T.ArrayType(T.StringType())))).cast("long"), "len(string_split(p_name, ' '))")
fn("dynamic_json_encode", "part", "p_partkey", lambda: collections.dynamic_json_encode(collections.dynamic_json_parse(F.concat(F.lit('{"z":'), F.col("p_size").cast("string"), F.lit("}")))).cast("string"), """'{"z":' || p_size || '}'""")
fn("dynamic_is_type", "part", "p_partkey", lambda: F.concat_ws(",", *(collections.dynamic_is_type(F.parse_json(F.lit(t)), k).cast("string") for t, k in (("1", "int"), ('"x"', "string"), ("[1]", "array"), ("{}", "object"), ("true", "int")))), "'true,true,true,true,false'")
fn("dynamic_is_not_distinct", "part", "p_partkey", lambda: collections.dynamic_equal(F.parse_json(F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit("]"))), F.parse_json(F.lit("[7]"))), "p_size = 7")

# Shape and aggregates that no query uses by default

op("to_uint", lambda s: shape.to_uint(s.to(s.df.withColumn(VALUE, col("user_id")))), ["event_id", "cast(_value AS string) AS _value"], "SELECT event_id, user_id::VARCHAR AS _value FROM ev")
one("object_keys", lambda s: {"out": F.array_join(F.array(*map(F.lit, shape.object_keys({"a": 1, "b": 2}))), ",")}, "'a,b' AS out")
op("table_fill", lambda s: shape.fill_empty(aggregates.count(shape.filter(s, lambda r: r["_value"] > 1e9, on_empty="keep"))), ["event_type", VALUE], "SELECT DISTINCT event_type, 0 AS _value FROM ev")
op("fill_empty", lambda s: shape.fill_empty(shape.filter(s, lambda r: r["_value"] > 1e9, on_empty="keep")), ["event_type", VALUE], "SELECT DISTINCT event_type, NULL::DOUBLE AS _value FROM ev")
add("linear_bins", lambda s, d: s.createDataFrame([(x,) for x in aggregates.linear_bins(1, 2.5, 4)], "le double").select(F.col("le").cast("string").alias("le")), "SELECT * FROM (VALUES ('1.0'), ('3.5'), ('6.0'), ('8.5'), ('Infinity')) v(le)")
add("logarithmic_bins", lambda s, d: s.createDataFrame([(x,) for x in aggregates.logarithmic_bins(1, 10, 3, False)], "le double"), "SELECT pow(10.0, i) AS le FROM (SELECT unnest(range(3)) AS i)")
_HAZEN = "list_transform([list_sort(list(_value))], lambda v: CASE WHEN {q} * len(v) <= 0.5 THEN v[1] WHEN {q} * len(v) >= len(v) - 0.5 THEN v[len(v)] ELSE v[floor({q} * len(v) + 0.5)::BIGINT] + (v[floor({q} * len(v) + 0.5)::BIGINT + 1] - v[floor({q} * len(v) + 0.5)::BIGINT]) * ({q} * len(v) + 0.5 - floor({q} * len(v) + 0.5)) END)[1]"
for _n, _q, _f in (("median_estimate", 0.5, aggregates.median), ("quantile_estimate", 0.9, lambda s: aggregates.quantile(s, 0.9))):
    op(_n, _f, ["user_id", "round(_value, 6) AS _value"], f"SELECT user_id, round({_HAZEN.format(q=_q)}, 6) AS _value FROM ev WHERE _value IS NOT NULL GROUP BY 1", nulls=True, key=("user_id",))
op("aggregate_window_median", lambda s: windows.aggregate_window(s, "1h", "median", create_empty=False), ["event_type", TIME, "round(_value, 6) AS _value"], f"SELECT event_type, date_trunc('hour', _time) + INTERVAL 1 HOUR AS _time, round({_HAZEN.format(q=0.5)}, 6) AS _value FROM ev GROUP BY 1, 2")
op("aggregate_window_quantile", lambda s: windows.aggregate_window(s, "1h", "quantile", create_empty=False, q=0.75), ["event_type", TIME, "round(_value, 6) AS _value"], f"SELECT event_type, date_trunc('hour', _time) + INTERVAL 1 HOUR AS _time, round({_HAZEN.format(q=0.75)}, 6) AS _value FROM ev GROUP BY 1, 2")
op("window_inf", lambda s: aggregates.count(windows.window(shape.range(s, "2024-01-05T00:00:00Z", "2024-01-07T00:00:00Z"), "inf")), ["event_type", "_start", "_stop", VALUE], "SELECT event_type, TIMESTAMP '2024-01-05' AS _start, TIMESTAMP '2024-01-07' AS _stop, count(*) AS _value FROM ev WHERE _time >= TIMESTAMP '2024-01-05' AND _time < TIMESTAMP '2024-01-07' GROUP BY 1")

# Sequences: recursions as recursive SQL, over all rows

_R = f"r AS (SELECT event_id, event_type, _value AS v, row_number() OVER ({W}) AS i FROM ev)"


def ema_sql(src: str, out: str, n: int, k: str) -> str:
    """CTE of the exponential average of ``src`` (event_type, i, event_id, v) in the same form."""
    return f"""{out}_all AS (SELECT event_type, 1 AS j, i, event_id, a AS v, {n} AS p FROM (SELECT event_type, avg(v) FILTER (p <= {n}) AS a, max(CASE WHEN p = {n} THEN i END) AS i, max(CASE WHEN p = {n} THEN event_id END) AS event_id FROM {src} GROUP BY 1)
  UNION ALL SELECT f.event_type, f.j + 1, s.i, s.event_id, s.v * {k} + f.v * (1 - {k}), s.p FROM {out}_all f JOIN {src} s ON s.event_type = f.event_type AND s.p = f.p + 1),
{out} AS (SELECT event_type, i, event_id, v, j AS p FROM {out}_all)"""


_P = f"r AS (SELECT event_id, event_type, _value AS v, row_number() OVER ({W}) AS i, row_number() OVER ({W}) AS p FROM ev)"
_K5, _K10 = "(2.0::DOUBLE / 6)", "(2.0::DOUBLE / 11)"
_rec = lambda *ctes: "WITH RECURSIVE ev AS (SELECT event_id, ts AS _time, event_type, value AS _value FROM events), " + ", ".join(ctes)


def seq(name: str, run: Callable[[TableStream], TableStream], sql: str) -> None:
    add(name, lambda s, d: run(ev(s, d)).df.selectExpr("event_id", "round(_value, 6) AS _value"), sql)


seq("exponential_moving_average", lambda s: sequences.exponential_moving_average(s, 10), _rec(_P, ema_sql("r", "a", 10, _K10)) + " SELECT event_id, round(v, 6) AS _value FROM a")
seq("double_ema", lambda s: sequences.double_ema(s, 5), _rec(_P, ema_sql("r", "a", 5, _K5), ema_sql("a", "b", 5, _K5)) + " SELECT b.event_id, round(2 * a.v - b.v, 6) AS _value FROM a JOIN b USING (event_id)")
seq("triple_ema", lambda s: sequences.triple_ema(s, 5), _rec(_P, ema_sql("r", "a", 5, _K5), ema_sql("a", "b", 5, _K5), ema_sql("b", "c", 5, _K5)) + " SELECT c.event_id, round(3 * a.v - 3 * b.v + c.v, 6) AS _value FROM a JOIN b USING (event_id) JOIN c USING (event_id)")
seq("triple_exponential_derivative", lambda s: sequences.triple_exponential_derivative(s, 5), _rec(_P, ema_sql("r", "a", 5, _K5), ema_sql("a", "b", 5, _K5), ema_sql("b", "c", 5, _K5)) + " SELECT event_id, round(d, 6) AS _value FROM (SELECT event_id, p, (v / lag(v) OVER (PARTITION BY event_type ORDER BY p) - 1) * 100 AS d FROM c) WHERE p > 1")
_CH = f"ch AS (SELECT event_id, event_type, i, p, v - coalesce(lag(v) OVER (PARTITION BY event_type ORDER BY i), 0) AS d FROM r), up AS (SELECT event_id, event_type, i, p, greatest(d, 0) AS v FROM ch), dn AS (SELECT event_id, event_type, i, p, greatest(-d, 0) AS v FROM ch)"
seq("relative_strength_index", lambda s: sequences.relative_strength_index(s, 5), _rec(_P, _CH, ema_sql("up", "a", 5, "0.2::DOUBLE"), ema_sql("dn", "b", 5, "0.2::DOUBLE")) + " SELECT a.event_id, round(CASE WHEN b.v = 0 THEN 100 ELSE 100 - 100 / (1 + a.v / b.v) END, 6) AS _value FROM a JOIN b USING (event_id) WHERE a.p > 1")
_ER = f"er AS (SELECT event_type, event_id, i AS p, v, power((CASE WHEN noise = 0 THEN 0 ELSE abs(v - back) / noise END) * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 31) + 2.0::DOUBLE / 31, 2) AS g, prior FROM (SELECT *, sum(d) OVER (PARTITION BY event_type ORDER BY i ROWS 4 PRECEDING) AS noise, lag(v, 5) OVER (PARTITION BY event_type ORDER BY i) AS back, lag(v) OVER (PARTITION BY event_type ORDER BY i) AS prior FROM (SELECT *, abs(v - lag(v) OVER (PARTITION BY event_type ORDER BY i)) AS d FROM r)) WHERE i > 5)"
_KAMA = "k AS (SELECT event_type, event_id, p, prior + g * (v - prior) AS v FROM er WHERE p = 6 UNION ALL SELECT e.event_type, e.event_id, e.p, k.v + e.g * (e.v - k.v) FROM k JOIN er e ON e.event_type = k.event_type AND e.p = k.p + 1)"
seq("kaufmans_ama", lambda s: sequences.kaufmans_ama(s, 5), _rec(_P, _ER, _KAMA) + " SELECT event_id, round(v, 6) AS _value FROM k")
add("double_exponential", lambda s, d: sequences.double_exponential(ev(s, d), 0.5, 0.25).df.selectExpr("event_type", "round(_value, 6) AS _value"), _rec(_P, "h AS (SELECT event_type, 1 AS p, a AS l, b - a AS b FROM (SELECT event_type, max(v) FILTER (p = 1) AS a, max(v) FILTER (p = 2) AS b FROM r GROUP BY 1) UNION ALL SELECT h.event_type, h.p + 1, 0.5 * r.v + 0.5 * (h.l + h.b), 0.25 * (0.5 * r.v + 0.5 * (h.l + h.b) - h.l) + 0.75 * h.b FROM h JOIN r ON r.event_type = h.event_type AND r.p = h.p + 1)") + " SELECT event_type, round(l, 6) AS _value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p DESC) AS z FROM h) WHERE z = 1")
op("state_tracking", lambda s: sequences.state_tracking(s, lambda r: r["_value"] > 5, "n", "us", "1us"), ["event_id", "n", "us"], f""", a AS (SELECT *, _value > 5 AS o FROM ev), b AS (SELECT *, CASE WHEN lag(o) OVER ({W}) <> o THEN 1 ELSE 0 END AS c FROM a), g AS (SELECT *, sum(c) OVER ({W} ROWS UNBOUNDED PRECEDING) AS isle FROM b)
SELECT event_id, CASE WHEN o THEN row_number() OVER (PARTITION BY event_type, isle ORDER BY _time, event_id) ELSE -1 END AS n, CASE WHEN o THEN epoch_us(_time) - first_value(epoch_us(_time)) OVER (PARTITION BY event_type, isle ORDER BY _time, event_id) ELSE -1 END AS us FROM g""")
_EX = "epoch_us(_time) / 1e6"
op(
    "extrapolated_rate",
    lambda s: sequences.extrapolated_rate(shape.range(s, "2024-01-02T00:00:00Z", "2024-01-09T00:00:00Z")),
    ["event_type", "round(_value, 6) AS _value"],
    f""", x AS (SELECT event_type, {_EX} AS t, _value AS v, lag(_value) OVER ({W}) AS pv FROM ev WHERE _time >= TIMESTAMP '2024-01-02' AND _time < TIMESTAMP '2024-01-09'),
g AS (SELECT event_type, min(t) AS t0, max(t) AS t1, arg_min(v, t) AS v0, arg_max(v, t) - arg_min(v, t) + sum(CASE WHEN pv > v THEN pv ELSE 0 END) AS total, count(*) AS n FROM x GROUP BY 1),
h AS (SELECT *, t1 - t0 AS span, (t1 - t0) / (n - 1) AS gap, least(t0 - epoch_us(TIMESTAMP '2024-01-02') / 1e6, CASE WHEN total > 0 AND v0 >= 0 THEN (t1 - t0) * v0 / total ELSE 'inf'::DOUBLE END) AS head, epoch_us(TIMESTAMP '2024-01-09') / 1e6 - t1 AS tail FROM g)
SELECT event_type, round(total * (span + CASE WHEN head < gap * 1.1 THEN head ELSE gap / 2 END + CASE WHEN tail < gap * 1.1 THEN tail ELSE gap / 2 END) / span / 604800, 6) AS _value FROM h""",
)
_LINE = [0, 0.1, -0.1, 5, 6, 7, 8.1, 9, 9, 9]


def _line(s: SparkSession, values=_LINE) -> TableStream:
    return table(rows(s, "_time timestamp, tag string, _value double", *((datetime(2024, 1, 1, 0, 0, i), "a", float(v)) for i, v in enumerate(values))), ("tag",))


# by hand: on so long a time axis the distance is the difference of values
add("simplify_line", lambda s, d: sequences.simplify_line(_line(s), epsilon=1.0).df.select(F.second(TIME).alias("t"), VALUE), "SELECT * FROM (VALUES (0, 0.0::DOUBLE), (2, -0.1), (3, 5.0), (7, 9.0), (9, 9.0)) v(t, _value)")
add("simplify_line_retention", lambda s, d: sequences.simplify_line(_line(s), retention=30.0).df.select(F.second(TIME).alias("t"), VALUE), "SELECT * FROM (VALUES (0, 0.0::DOUBLE), (2, -0.1), (9, 9.0)) v(t, _value)")
_AUTO = [10.5, -29.7, -67.5, -16.7]
add("simplify_line_learned", lambda s, d: sequences.simplify_line(_line(s, _AUTO)).df.select(F.second(TIME).alias("t"), VALUE), f"SELECT * FROM (VALUES {', '.join(f'({i}, {v}::DOUBLE)' for i, v in enumerate(_AUTO))}) v(t, _value)")
add("holt_winters", lambda s, d: sequences.holt_winters(_line(s, range(10, 50, 2)), 4, "1s").df.select(F.second(TIME).alias("t"), F.round(VALUE, 0).alias(VALUE)), "SELECT 20 + i AS t, (50 + 2 * i)::DOUBLE AS _value FROM (SELECT unnest(range(4)) AS i)")

# Extraction

_TAGGED = "ev AS (SELECT event_id, ts AS _time, event_type, value AS _value FROM events)"


def _first_by_key(s, d):
    return extract.table_find(ev(s, d), lambda k: k.event_type == "view")


add("table_find", lambda s, d: _first_by_key(s, d).df.select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE event_type = 'view'")
add("get_column", lambda s, d: s.createDataFrame([(i, v) for i, v in enumerate(extract.get_column(selectors.limit(_first_by_key(s, d), 5), "event_id"))], "i long, v long"), "SELECT i - 1 AS i, event_id AS v FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'view') WHERE i <= 5")
add("get_record", lambda s, d: s.createDataFrame([(extract.get_record(_first_by_key(s, d), 3)["event_id"],)], "v long"), "SELECT event_id AS v FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 1 OFFSET 3")
add("find_column", lambda s, d: s.createDataFrame([(len(extract.find_column(ev(s, d), lambda k: k.event_type == "click", "event_id")), len(extract.find_column(ev(s, d), lambda k: k.event_type == "none", "event_id")))], "n long, none long"), "SELECT count(*) AS n, 0 AS none FROM events WHERE event_type = 'click'")
add("find_record", lambda s, d: s.createDataFrame([(extract.find_record(ev(s, d), lambda k: k.event_type == "error", 0)["event_id"],)], "v long"), "SELECT event_id AS v FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 1")
one("catch", lambda s: {"code": extract.catch(lambda: extract.die("no"))["code"], "msg": extract.catch(lambda: extract.die("no"))["msg"], "value": extract.catch(lambda: 5)["value"]}, "1 AS code, 'no' AS msg, 5 AS value")
one("die", lambda s: {"msg": extract.catch(lambda: extract.die("stop here"))["msg"]}, "'stop here' AS msg")


def _yielded(s, d):
    out = extract.Results()
    out.yield_(shape.filter(ev(s, d), lambda r: r["_value"] > 20), "high")
    return out["high"].select("event_id")


add("yield", _yielded, "SELECT event_id FROM events WHERE value > 20")
add("chain", lambda s, d: extract.chain(ev(s, d), lambda: aggregates.count(shape.ungroup(ev(s, d)))).df, "SELECT count(*) AS _value FROM events")

# Assertions and test helpers: the error, or that there is none


def _says(act: Callable[[], object]) -> str:
    out = extract.catch(act)
    return out["msg"] if out["code"] else "ok"


def _asserted(name: str, good, bad, text: str) -> None:
    add(name, lambda s, d: rows(s, "good string, bad string", (_says(lambda: good(s, d)), _says(lambda: bad(s, d)))), f"SELECT 'ok' AS good, '{text}' AS bad")


_few = lambda s, d: selectors.limit(shape.ungroup(ev(s, d)), 3)
_none = lambda s, d: shape.filter(ev(s, d), lambda r: F.lit(False))
_asserted("assert_equals", lambda s, d: sets.assert_equals("t", _few(s, d), _few(s, d)), lambda s, d: sets.assert_equals("t", _few(s, d), _none(s, d)), "t: streams are not equal")
_asserted("assert_empty", lambda s, d: sets.assert_empty(_none(s, d)), lambda s, d: sets.assert_empty(_few(s, d)), "expected no rows")
_asserted("assert_equal_values", lambda s, d: sets.assert_equal_values(1, 1), lambda s, d: sets.assert_equal_values(1, 2), "1 is not 2")
_asserted("should_error", lambda s, d: sets.should_error(lambda: extract.die("xyz"), "y"), lambda s, d: sets.should_error(lambda: 1, "y"), "expected an error")
_asserted("should_error_with_code", lambda s, d: sets.should_error_with_code(lambda: extract.die("xyz"), "y", 1), lambda s, d: sets.should_error_with_code(lambda: extract.die("xyz"), "y", 3), "the error has code 1, not 3")
_asserted("assert_matches", lambda s, d: sets.assert_matches("123", "12"), lambda s, d: sets.assert_matches("123", "x"), "Regex `x` does not match `123`")
_asserted("expect_plan", lambda s, d: sets.expect_plan(_few(s, d), "Scan parquet", 1), lambda s, d: sets.expect_plan(_few(s, d), "NoSuchNode"), "''NoSuchNode'' is 0 times in the plan")
_asserted("testutil_fail", lambda s, d: extract.catch(sets.fail), lambda s, d: sets.fail(), "fail")
add("testing_load", lambda s, d: aggregates.count(shape.ungroup(sets.load(ev(s, d)))).df, "SELECT count(*) AS _value FROM events")
one("testing_tags", lambda s: {"out": len(sets.tags)}, "0 AS out")
one("testutil_make_record", lambda s: {"a": sets.make_record({"a": 1, "b": "x"}).a, "b": sets.make_record({"a": 1, "b": "x"}).b}, "1 AS a, 'x' AS b")
one("testutil_make_any", lambda s: {"out": sets.make_any(7)}, "7 AS out")

# Sources


def _long(s, d) -> TableStream:
    """Orders as points: measurement, tags, two fields, time."""
    o = read(s, d, "orders").select(F.lit("orders").alias("_measurement"), "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias(TIME), F.col("o_totalprice").cast("double").alias("price"), F.col("o_custkey").cast("double").alias("cust"), "o_orderkey")
    df = o.unpivot(["_measurement", "o_orderstatus", "o_orderpriority", TIME, "o_orderkey"], ["price", "cust"], "_field", VALUE)
    return table(df, ("_measurement", "o_orderstatus", "o_orderpriority", "_field"), (TIME, "o_orderkey"))


def _bucket(s, d) -> str:
    """The points, written as a bucket by month."""
    path = scratch(s, "bucket")
    p = _long(s, d)
    p.df.drop("o_orderkey").withColumn("month", F.date_format(TIME, "yyyy-MM")).repartition("month").write.partitionBy("month").parquet(path)
    return path


_LONG = "pts AS (SELECT 'orders' AS _measurement, o_orderstatus, o_orderpriority, o_orderdate::TIMESTAMP AS _time, 'price' AS _field, o_totalprice::DOUBLE AS _value FROM orders UNION ALL SELECT 'orders', o_orderstatus, o_orderpriority, o_orderdate::TIMESTAMP, 'cust', o_custkey::DOUBLE FROM orders)"
_A, _B = "1995-01-01T00:00:00Z", "1996-01-01T00:00:00Z"
_IN = "_time >= TIMESTAMP '1995-01-01' AND _time < TIMESTAMP '1996-01-01'"


def _sums(s: TableStream, *by: str) -> DataFrame:
    return s.df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum(VALUE), 2).alias("total"))


def pts(name: str, run: Callable[[SparkSession, str, str], DataFrame], sql: str) -> None:
    add(name, lambda s, d: run(s, d, _bucket(s, d)), f"WITH {_LONG} {sql}")


pts("bucket_from", lambda s, d, p: _sums(tables.bucket(s, p), "_field"), "SELECT _field, count(*) AS n, round(sum(_value), 2) AS total FROM pts GROUP BY 1")
pts("from_range", lambda s, d, p: _sums(tables.from_range(s, p, _A, _B), "_field"), f"SELECT _field, count(*) AS n, round(sum(_value), 2) AS total FROM pts WHERE {_IN} GROUP BY 1")
pts("filter_measurement", lambda s, d, p: _sums(tables.filter_measurement(tables.bucket(s, p), "orders"), "_field"), "SELECT _field, count(*) AS n, round(sum(_value), 2) AS total FROM pts GROUP BY 1")
pts("filter_fields", lambda s, d, p: _sums(tables.filter_fields(tables.bucket(s, p), ["price"]), "_field"), "SELECT _field, count(*) AS n, round(sum(_value), 2) AS total FROM pts WHERE _field = 'price' GROUP BY 1")
pts("in_bucket", lambda s, d, p: _sums(tables.in_bucket(s, p, "orders", _A, _B, ["price"], lambda r: r["o_orderstatus"] == "F"), "o_orderpriority"), f"SELECT o_orderpriority, count(*) AS n, round(sum(_value), 2) AS total FROM pts WHERE {_IN} AND _field = 'price' AND o_orderstatus = 'F' GROUP BY 1")
pts("select", lambda s, d, p: tables.select(s, p, _A, "orders", _B, ["price", "cust"]).df.groupBy("o_orderstatus").agg(F.count("price").alias("n"), F.count("cust").alias("m")), f"SELECT o_orderstatus, count(DISTINCT (o_orderpriority, _time)) AS n, count(DISTINCT (o_orderpriority, _time)) AS m FROM pts WHERE {_IN} GROUP BY 1")
pts("fields_as_columns", lambda s, d, p: shape.fields_as_columns(aggregates.aggregate(windows.window(tables.bucket(s, p, key=("_field", "o_orderstatus")), "1mo"), _value=F.max(VALUE)).to(order=()).pipe(lambda x: x.to(x.df.withColumn(TIME, col("_start")), key=("o_orderstatus",)))).df.select("o_orderstatus", TIME, "price", "cust"), "SELECT o_orderstatus, date_trunc('month', _time) AS _time, max(_value) FILTER (_field = 'price') AS price, max(_value) FILTER (_field = 'cust') AS cust FROM pts GROUP BY 1, 2")
_SCHEMA = dict(start=_A, stop=_B)
for _n, _f, _s in (
    ("measurements", lambda t: tables.measurements(t, **_SCHEMA), "SELECT 'orders' AS _value"),
    ("field_keys", lambda t: tables.field_keys(t, **_SCHEMA), f"SELECT DISTINCT _field AS _value FROM pts WHERE {_IN}"),
    ("measurement_field_keys", lambda t: tables.measurement_field_keys(t, "orders", **_SCHEMA), f"SELECT DISTINCT _field AS _value FROM pts WHERE {_IN}"),
    ("measurement_tag_values", lambda t: tables.measurement_tag_values(t, "orders", "o_orderstatus", **_SCHEMA), f"SELECT DISTINCT o_orderstatus AS _value FROM pts WHERE {_IN}"),
    ("measurement_tag_keys", lambda t: tables.measurement_tag_keys(t, "orders", **_SCHEMA), "SELECT unnest(['_measurement', 'o_orderstatus', 'o_orderpriority', '_field', '_start', '_stop']) AS _value"),
):
    add(_n, lambda s, d, f=_f: f(_long(s, d)).df, f"WITH {_LONG} {_s}")
one("schema_start_default", lambda s: {"start": tables.EXPLORED_START, "stop": tables.EXPLORED_STOP}, "'-30d' AS start, '0s' AS stop")
pts("mask", lambda s, d, p: aggregates.count(shape.mask(tables.bucket(s, p, key=("o_orderstatus", "_field")), ["_field"])).df.select("o_orderstatus", VALUE), "SELECT o_orderstatus, count(*) AS _value FROM pts GROUP BY 1")


def _catalogued(s, d):
    name = f"tm_{uuid.uuid4().hex[:8]}"
    read(s, d, "region").createOrReplaceTempView(name)
    return tables.buckets(s).where(F.col("name") == name).select(F.lit("region").alias("name"), "type")


add("buckets", _catalogued, "SELECT 'region' AS name, 'TEMPORARY' AS type")
add("databases", lambda s, d: tables.databases(s).where("name = 'default'").select("name"), "SELECT 'default' AS name")


def _viewed(s, d, name="tm_nation"):
    read(s, d, "nation").createOrReplaceTempView(name)
    return name


add("measurement_from", lambda s, d: tables.measurement(s, _viewed(s, d)).df.select("n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM nation")
add("query_from", lambda s, d: tables.from_query(s, f"SELECT n_regionkey, count(*) AS n FROM {_viewed(s, d)} GROUP BY 1").df, "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
add("sql_interval", lambda s, d: s.sql(f"SELECT TIMESTAMP '2024-01-31 00:00:00' + {tables.sql_interval('1mo')} AS a, TIMESTAMP '2024-01-31 00:00:00' + {tables.sql_interval('90m')} AS b"), "SELECT TIMESTAMP '2024-02-29' AS a, TIMESTAMP '2024-01-31 01:30:00' AS b")
add("bigtable_from", lambda s, d: tables.from_connector(s, "parquet", path=f"{d}/region.parquet").df.select("r_regionkey", "r_name"), "SELECT r_regionkey, r_name FROM region")
add("array_from", lambda s, d: tables.from_rows(s, [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]).df, "SELECT * FROM (VALUES (1, 'x'), (2, 'y')) v(a, b)")
add("csv_from_raw", lambda s, d: tables.from_csv(s, "a,b\n1,x\n2,\n", mode="raw").df, "SELECT * FROM (VALUES ('1', 'x'), ('2', '')) v(a, b)")
_CSV = "#datatype,string,long,dateTime:RFC3339,double,string\n#group,false,false,false,false,true\n#default,_result,,,,\n,result,table,_time,_value,host\n,,0,2024-01-01T00:00:00Z,1.5,a\n,,0,2024-01-01T00:00:10Z,,a\n\n#datatype,string,long,dateTime:RFC3339,boolean,string\n#group,false,false,false,false,true\n#default,_result,,,,\n,result,table,_time,up,host\n,,1,2024-01-01T00:00:00Z,true,b\n"


def _text_file(s, name: str, text: str) -> str:
    path = scratch(s, name)
    s.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


add("csv_from_file", lambda s, d: tables.from_csv(s, file=_text_file(s, "csv", _CSV)).df.select(TIME, VALUE, "host", "up"), "SELECT * FROM (VALUES (TIMESTAMP '2024-01-01', 1.5::DOUBLE, 'a', NULL::BOOLEAN), (TIMESTAMP '2024-01-01 00:00:10', NULL, 'a', NULL), (TIMESTAMP '2024-01-01', NULL, 'b', true)) v(_time, _value, host, up)")
_JSON = json.dumps({"results": [{"series": [{"name": "cpu", "tags": {"host": "a"}, "columns": ["time", "v"], "values": [["2024-01-01T00:00:00Z", 1.5], ["2024-01-01T00:00:10Z", 2.5]]}]}]})
add("result_json", lambda s, d: tables.from_result_json(s, _JSON).df.select(TIME, "_measurement", "host", "v"), "SELECT * FROM (VALUES (TIMESTAMP '2024-01-01', 'cpu', 'a', 1.5), (TIMESTAMP '2024-01-01 00:00:10', 'cpu', 'a', 2.5)) v(_time, _measurement, host, v)")
_PAGE = '# HELP x\nup{job="a"} 1 1704067200000\nup{job="b"} 0 1704067200000\nsize 2.5 1704067200000\n'
add("prometheus_scrape", lambda s, d: tables.scrape(s, text=_PAGE).df.select(TIME, "_measurement", "_field", "job", VALUE), "SELECT * FROM (VALUES (TIMESTAMP '2024-01-01', 'prometheus', 'up', 'a', 1.0::DOUBLE), (TIMESTAMP '2024-01-01', 'prometheus', 'up', 'b', 0.0), (TIMESTAMP '2024-01-01', 'prometheus', 'size', NULL, 2.5)) v(_time, _measurement, _field, job, _value)")
one("clickhouse_query", lambda s: {"url": tables.http_sql_url(tables.HTTP_SQL_URL, "SELECT 1", 5, 100)}, "'http://127.0.0.1:8123?query=SELECT+1&default_format=CSVWithNames&max_result_rows=5&max_result_bytes=100&add_http_cors_header=1' AS url")
one("logql_query_range", lambda s: {"url": tables.log_query_url('{a="b"}', "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z")}, "'http://127.0.0.1:3100/loki/api/v1/query_range?query=%7Ba%3D%22b%22%7D&limit=100&start=1704067200000000000&end=1704153600000000000&step=10&csv=1' AS url")
add("empty_table", lambda s, d: tables.empty_table(s).df.agg(F.count("*").alias("n")), "SELECT 0 AS n")
for _n in ("float", "uint", "string", "bool", "numericBool"):
    _v = {"float": "x + 0.18", "uint": "CASE WHEN x < 0 THEN (x::HUGEINT + 18446744073709551616)::VARCHAR ELSE x::VARCHAR END", "string": "'smpl_' || to_hex(CASE WHEN x < 0 THEN x + 256 ELSE x END)", "bool": "x > 5", "numericBool": "(x > 5)::BIGINT"}[_n]
    add(f"sampledata_{_n.lower()}", lambda s, d, n=_n: tables.sample(s, n).df.select("tag", F.col(TIME).alias("t"), (F.lower(VALUE) if n == "string" else col(VALUE).cast("string") if n == "uint" else col(VALUE)).alias("v")), f"SELECT tag, TIMESTAMP '2021-01-01' + to_seconds(10 * (i - 1)) AS t, {'lower(' + _v + ')' if _n == 'string' else _v} AS v FROM (SELECT 't1' AS tag, unnest([-2, 10, 7, 17, 15, 4]) AS x, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS i UNION ALL SELECT 't2', unnest([19, 4, -3, 19, 13, 1]), generate_subscripts([1, 2, 3, 4, 5, 6], 1))")
one("sampledata_bounds", lambda s: {"start": F.lit(tables.SAMPLE_START.isoformat()), "stop": F.lit(tables.SAMPLE_STOP.isoformat())}, "'2021-01-01T00:00:00' AS start, '2021-01-01T00:01:00' AS stop")
add("sample_list", lambda s, d: tables.sample_sets(s).select("name"), "SELECT unnest(['float', 'int', 'uint', 'string', 'bool', 'numericBool']) AS name")
add("sample_align_to_now", at_now(lambda s, d: shape.shift_to_now(tables.sample(s, "int")).df.agg(F.max(TIME).alias("t"))), "SELECT TIMESTAMP '2024-01-17 10:30:15' AS t")


def _sqlite(s, d):
    """A table written to a database file of the driver, and read again."""
    path = tempfile.mkdtemp(prefix="tidemill-") + "/t.db"
    sinks.to_sql(table(read(s, d, "nation").select("n_nationkey", "n_name")), "sqlite3", path, "t")
    return tables.from_sql(s, "sqlite3", path, "SELECT n_nationkey, n_name FROM t WHERE n_nationkey < 10").df


add("sql_from", _sqlite, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10")

# Sinks: written, read back, compared


def _back(s, d):
    path = scratch(s, "to")
    sinks.to_bucket(_long(s, d), path)
    return _sums(tables.bucket(s, path), "_field", "o_orderstatus")


add("to_bucket", _back, f"WITH {_LONG} SELECT _field, o_orderstatus, count(*) AS n, round(sum(_value), 2) AS total FROM pts GROUP BY 1, 2")


def _back_fields(s, d):
    path = scratch(s, "to")
    o = table(read(s, d, "orders").select(F.lit("o").alias("_measurement"), "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias(TIME), "o_totalprice", "o_custkey"), ("o_orderstatus",))
    sinks.to_bucket(o, path, tag_columns=["o_orderstatus"], field_fn=lambda r: {"half": r["o_totalprice"] / 2})
    return _sums(tables.bucket(s, path), "_field", "o_orderstatus")


add("to_bucket_fields", _back_fields, "SELECT 'half' AS _field, o_orderstatus, count(*) AS n, round(sum(o_totalprice / 2), 2) AS total FROM orders GROUP BY 2")


def _back_wide(s, d):
    path = scratch(s, "wide")
    o = read(s, d, "orders").select(F.lit("o").alias("_measurement"), "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias(TIME), "o_totalprice", "o_custkey")
    sinks.to_bucket_wide(table(o, ("_measurement", "o_orderstatus")), path)
    return _sums(tables.bucket(s, path), "_field", "o_orderstatus")


add("to_bucket_wide", _back_wide, "SELECT _field, o_orderstatus, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT 'o_totalprice' AS _field, o_orderstatus, o_totalprice::DOUBLE AS v FROM orders UNION ALL SELECT 'o_custkey', o_orderstatus, o_custkey FROM orders) GROUP BY 1, 2")
add("sql_to", lambda s, d: _sqlite(s, d).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM nation WHERE n_nationkey < 10")
add("kafka_to", lambda s, d: sinks.kafka_messages(ev(s, d), "events", None, ["event_type"], ["user_id"], TIME), "SELECT event_type AS key, 'events,event_type=' || event_type || ' user_id=' || user_id || 'i ' || (epoch_us(ts) * 1000)::VARCHAR AS value FROM events")


def _published(s, d):
    """Messages that a client appends to a file of the shared folder, read back."""
    path = scratch(s, "mqtt")
    import os

    os.makedirs(path.removeprefix("file://"), exist_ok=True)

    def client(topic, message, folder=path.removeprefix("file://")):
        import uuid as u

        with open(f"{folder}/{u.uuid4().hex}.txt", "w") as f:
            f.write(f"{topic} {message}\n")
        return True

    sinks.to_mqtt(selectors.limit(shape.ungroup(ev(s, d)), 20), client, "t", "events", [], ["user_id"])
    return s.read.text(path)


add("mqtt_to", _published, "SELECT 't events user_id=' || user_id || 'i ' || (epoch_us(ts) * 1000)::VARCHAR AS value FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 20)")
one("mqtt_publish", lambda s: {"ok": sinks.publish(lambda t, m: (t, m) == ("a", "b"), "a", "b"), "bad": sinks.publish(lambda t, m: False, "a", "b")}, "true AS ok, false AS bad")

# HTTP helpers and the services' messages: the JSON of one made from a row

one("http_basic_auth", lambda s: {"out": sinks.basic_auth("user", "pass")}, "'Basic ' || base64('user:pass'::BLOB) AS out")
one("http_path_escape", lambda s: {"out": sinks.path_escape("a b/c?d")}, "'a%20b%2Fc%3Fd' AS out")


def _answered(method: str):
    """A request to a local server that answers with what it got."""

    def run(s, d):
        import threading
        from http.server import BaseHTTPRequestHandler, HTTPServer

        class Echo(BaseHTTPRequestHandler):
            def do_POST(self):
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                out = f"{self.command} {self.path} {body.decode()} {self.headers.get('X-A', '')}".encode()
                self.send_response(201 if self.command == "POST" else 200)
                self.send_header("Content-Length", str(len(out)))
                self.end_headers()
                self.wfile.write(out)

            do_GET = do_PUT = do_POST

            def log_message(self, *args):
                pass

        server = HTTPServer(("127.0.0.1", 0), Echo)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{server.server_port}"
        try:
            got = {
                "post": lambda: sinks.post(f"{url}/p", params={"q": "1"}, headers={"X-A": "h"}, body=b"data"),
                "get": lambda: sinks.get(f"{url}/g", params={"q": ["1", "2"]}),
                "do": lambda: sinks.request("PUT", f"{url}/d", body=b"x"),
                "fetch": lambda: tables.fetch(f"{url}/f"),
            }[method]()
            out = sinks.peek(s, got).df.select("statusCode", "body")
            return s.createDataFrame(out.collect(), out.schema)
        finally:
            server.shutdown()

    return run


for _n, _m, _c, _b in (("http_post", "post", 201, "POST /p?q=1 data h"), ("requests_post", "post", 201, "POST /p?q=1 data h"), ("requests_get", "get", 200, "GET /g?q=1&q=2  "), ("requests_do", "do", 200, "PUT /d x "), ("requests_peek", "get", 200, "GET /g?q=1&q=2  "), ("http_get", "fetch", 200, "GET /f  "), ("api", "fetch", 200, "GET /f  ")):
    add(_n, _answered(_m), f'SELECT {_c} AS "statusCode", \'{_b}\' AS body')
one("requests_default_config", lambda s: {k: F.lit(str(v)) for k, v in sinks.DEFAULT_CONFIG.items()} | {"empty": len(sinks.EMPTY_BODY)}, "'30.0' AS timeout, 'False' AS insecure_skip_verify, 0 AS empty")


def _delivered(s, d):
    e = sinks.endpoint(lambda r: {"url": "u", "data": {"id": int(r["event_id"])}}, send=lambda m: m["data"]["id"] % 2 == 0)
    return e(ev(s, d)).df.select("event_id", "_sent")


add("http_endpoint", _delivered, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS _sent FROM events")
#: A message of each service and its JSON, written down by hand.
_SENT = {
    "slack": (lambda: sinks.slack_message("https://s/x", "tok", "#c", "hi", "#ff0000"), ["channel", "as_user", "attachments"], {"channel": "#c", "as_user": False}),
    "pagerduty": (lambda: sinks.pagerduty_message("key", "sum", "critical", "src", dedup_key="d"), ["payload", "routing_key", "dedup_key"], {"routing_key": "key", "dedup_key": "d", "event_action": "trigger"}),
    "opsgenie": (lambda: sinks.opsgenie_message("k", "m" * 140, "a", "desc", "P1", ["user:joe"], ["t"]), ["message", "alias"], {"message": "m" * 130, "alias": "a", "priority": "P1"}),
    "telegram": (lambda: sinks.telegram_message("T", "ch", "txt"), ["chat_id"], {"chat_id": "ch", "text": "txt", "parse_mode": "MarkdownV2", "disable_web_page_preview": False, "disable_notification": True}),
    "discord": (lambda: sinks.discord_message("i", "t", "c", "n", "av"), ["content"], {"username": "n", "content": "c", "avatar_url": "av"}),
    "teams": (lambda: sinks.teams_message("https://t", "ti", "x" * 80), ["summary"], {"@type": "MessageCard", "title": "ti", "summary": "x" * 67 + "..."}),
    "pushbullet": (lambda: sinks.pushbullet_message("T", "ti", "tx"), ["type"], {"type": "note", "title": "ti", "body": "tx"}),
    "victorops": (lambda: sinks.victorops_message("https://v", "CRITICAL", "e", "n", "s", 5, "tool"), ["message_type"], {"message_type": "CRITICAL", "entity_id": "e", "entity_display_name": "n", "monitoring_tool": "tool", "state_message": "s"}),
    "alerta": (lambda: sinks.alerta_message("https://a", "k", "r", "ev", "warning"), ["resource"], {"resource": "r", "event": "ev", "severity": "warning"}),
    "bigpanda": (lambda: sinks.bigpanda_message("T", "app", "ok", {"host": "h"}), ["host"], {"host": "h", "app_key": "app", "status": "ok"}),
    "webexteams": (lambda: sinks.webex_message("T", "room", "txt", "md"), ["roomId"], {"text": "txt", "markdown": "md", "roomId": "room"}),
}
for _n, (_make, _has, _want) in _SENT.items():
    add(f"{_n}_message", lambda s, d, m=_make, h=_has, w=_want: rows(s, "name string, out string", *((k, json.dumps(m()["data"][k])) for k in w), *((f"has {k}", str(k in m()["data"]).lower()) for k in h)), "SELECT * FROM (VALUES " + ", ".join([f"('{k}', '{json.dumps(v)}')" for k, v in _want.items()] + [f"('has {k}', 'true')" for k in _has]) + ") v(name, out)")
    # as an endpoint: one message a row, through the service's own maker
    add(f"{_n}_endpoint", lambda s, d, m=_make: sinks.endpoint(lambda r: m(), send=lambda msg: "data" in msg)(table(read(s, d, "region").select("r_regionkey"))).df, "SELECT r_regionkey, 'true' AS _sent FROM region")
_NESTED = {
    "sensu": (lambda: sinks.sensu_message("https://x", "k", "my check", "out", 2), lambda d: [d["entity"]["entity_class"], d["check"]["output"], str(d["check"]["status"]), d["check"]["state"]], ["proxy", "out", "2", "failing"]),
    "servicenow": (lambda: sinks.servicenow_message("https://x", "u", "p", "n", "t", "r", "m", "key", "desc", "crit"), lambda d: [d["records"][0][k] for k in ("node", "type", "resource", "metric_name", "message_key", "description", "severity")], ["n", "t", "r", "m", "key", "desc", "1"]),
    "zenoss": (lambda: sinks.zenoss_message("https://x", "u", "p", "dev", "comp", "Critical", "cls", "ck", "sum"), lambda d: [d["data"][0][k] for k in ("device", "component", "severity", "evclass", "evclasskey", "summary")], ["dev", "comp", "Critical", "cls", "ck", "sum"]),
}
for _n, (_make, _get, _want) in _NESTED.items():
    add(f"{_n}_event", lambda s, d, m=_make, g=_get: rows(s, "i long, out string", *enumerate(g(m()["data"]))), "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(_want)) + ") v(i, out)")
    add(f"{_n}_endpoint", lambda s, d, m=_make: sinks.endpoint(lambda r: m(), send=lambda msg: "data" in msg)(table(read(s, d, "region").select("r_regionkey"))).df, "SELECT r_regionkey, 'true' AS _sent FROM region")
one("sensu_name", lambda s: {"out": sinks.sensu_message("u", "k", "my check/1", "x")["data"]["check"]["metadata"]["name"]}, "'my_check_1' AS out")
add("pagerduty_severity", lambda s, d: rows(s, "level string, severity string, action string", *((x, sinks.pagerduty_severity(x), sinks.pagerduty_action(x)) for x in ("crit", "warn", "info", "ok", "unknown"))), "SELECT * FROM (VALUES ('crit', 'critical', 'trigger'), ('warn', 'warning', 'trigger'), ('info', 'info', 'trigger'), ('ok', 'info', 'resolve'), ('unknown', 'error', 'trigger')) v(level, severity, action)")
add("pagerduty_action_from_severity", lambda s, d: rows(s, "severity string, action string", *((x, sinks.pagerduty_action_of_severity(x)) for x in ("ok", "critical"))), "SELECT * FROM (VALUES ('ok', 'resolve'), ('critical', 'trigger')) v(severity, action)")
add("pagerduty_dedup_key", lambda s, d: sinks.dedup_key_column(ev(s, d)).df.select("event_id", "_pagerdutyDedupKey"), "SELECT event_id, sha256('event_type' || chr(10) || event_type || chr(10)) AS \"_pagerdutyDedupKey\" FROM events")
add("bigpanda_status", lambda s, d: rows(s, "level string, status string", *((x, sinks.bigpanda_status(x)) for x in ("crit", "warn", "info", "ok", "x"))), "SELECT * FROM (VALUES ('crit', 'critical'), ('warn', 'warning'), ('info', 'ok'), ('ok', 'ok'), ('x', 'unknown')) v(level, status)")
add("slack_validate_color", lambda s, d: rows(s, "c string, out string", *((c, _says(lambda c=c: sinks.validate_color(c))) for c in ("good", "#12aBcd", "red"))), "SELECT * FROM (VALUES ('good', 'ok'), ('#12aBcd', 'ok'), ('red', 'color must be hex or one of good, warning, danger')) v(c, out)")
one("opsgenie_responders", lambda s: {"out": json.dumps(sinks.opsgenie_message("k", "m", responders=["user:joe", "team:ops"])["data"]["responders"])}, """'[{"type": "user", "username": "joe"}, {"type": "team", "name": "ops"}]' AS out""")
_URLS = {"slack": "https://slack.com/api/chat.postMessage", "pagerduty": "https://events.pagerduty.com/v2/enqueue", "pushbullet": "https://api.pushbullet.com/v2/pushes", "telegram": "https://api.telegram.org/bot", "discord": "https://discordapp.com/api/webhooks/", "bigpanda": "https://api.bigpanda.io/data/v2/alerts"}
for _n, _u in _URLS.items():
    one(f"{_n}_default_url", lambda s, n=_n: {"out": sinks.DEFAULT_URLS[n]}, f"'{_u}' AS out")
one("telegram_defaults", lambda s: {"parse_mode": sinks.TELEGRAM["parse_mode"], "preview_off": sinks.TELEGRAM["disable_web_page_preview"], "silent": sinks.TELEGRAM["silent"]}, "'MarkdownV2' AS parse_mode, false AS preview_off, true AS silent")
one("teams_summary_cutoff", lambda s: {"out": sinks.SUMMARY_CUTOFF}, "70 AS out")
one("bigpanda_default_token_prefix", lambda s: {"out": sinks.TOKEN_PREFIX}, "'Bearer' AS out")

# Regions


def _places(s, d) -> TableStream:
    df = read(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 90).cast("double").alias("lat"), (F.col("s_suppkey") % 180).cast("double").alias("lon"), (F.col("s_suppkey") % 3).alias("g"))
    return table(df, ("g",), ("s_suppkey",))


_HAV = lambda a, b, c, d: f"(2 * 6371.01 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"
_LAT, _LON = "(s_suppkey % 90)", "(s_suppkey % 180)"


def place(name: str, expr: Callable[[], Column], sql: str) -> None:
    add(name, lambda s, d: _places(s, d).df.select("s_suppkey", expr().alias("out")), f"SELECT s_suppkey, {sql} AS out FROM supplier")


_POINT = {"lat": F.col, "lon": F.col}
_pt = lambda: {"lat": F.col("lat"), "lon": F.col("lon")}
_CIRCLE = {"lat": 40.0, "lon": 60.0, "radius": 3000.0}
place("geo_dwithin", lambda: geo.st_dwithin({"lat": 40.0, "lon": 60.0}, _pt(), 2500.0), f"{_HAV(40, 60, _LAT, _LON)} <= 2500")
place("geo_contains_circle", lambda: geo.st_contains(_CIRCLE, _pt()), f"{_HAV(40, 60, _LAT, _LON)} <= 3000")
place("geo_intersects", lambda: geo.st_intersects(_CIRCLE, _pt()), f"{_HAV(40, 60, _LAT, _LON)} <= 3000")
place("geo_distance_circle", lambda: F.round(geo.st_distance(_CIRCLE, _pt()), 6), f"round(greatest({_HAV(40, 60, _LAT, _LON)} - 3000, 0), 6)")
# a box on the equator's meridian: straight north and south, or to an edge's foot or corner
_FOOT = f"degrees(atan2(sin(radians({_LAT})), cos(radians({_LAT})) * cos(radians({_LON} - 50.0))))"
place("geo_distance_box", lambda: F.round(geo.st_distance({"minLat": 10, "maxLat": 60, "minLon": 0, "maxLon": 50}, _pt()), 4), f"round(CASE WHEN {_LON} <= 50 THEN radians(greatest({_LAT} - 60, 10 - {_LAT}, 0)) * 6371.01 WHEN cos(radians({_LON} - 50.0)) > 0 AND {_FOOT} BETWEEN 10 AND 60 THEN least({_HAV(_FOOT, 50, _LAT, _LON)}, {_HAV(10, 0, _LAT, _LON)}, {_HAV(60, 0, _LAT, _LON)}) ELSE least({_HAV(10, 50, _LAT, _LON)}, {_HAV(60, 50, _LAT, _LON)}, {_HAV(10, 0, _LAT, _LON)}, {_HAV(60, 0, _LAT, _LON)}) END, 4)")
place("geo_contains_antimeridian", lambda: geo.st_contains({"minLat": 0, "maxLat": 90, "minLon": 170, "maxLon": -170}, _pt()), f"{_LON} >= 170")
place("geo_units_mile", lambda: F.round(geo.haversine(40.0, 60.0, F.col("lat"), F.col("lon"), "mile"), 4), f"round({_HAV(40, 60, _LAT, _LON)} / 6371.01 * 3958.761, 4)")
_STR = lambda: {"linestring": F.concat(F.lit("0 0, "), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"))}
place("geo_length", lambda: F.round(geo.st_length(_STR()), 6), f"round({_HAV(0, 0, _LAT, _LON)}, 6)")
place("geo_contains_line", lambda: geo.st_contains({"minLat": 0, "maxLat": 45, "minLon": 0, "maxLon": 90}, _STR()), f"{_LAT} <= 45 AND {_LON} <= 90")
add("geo_line_string", lambda s, d: geo.st_line_string(_places(s, d)).df, "SELECT s_suppkey % 3 AS g, string_agg((s_suppkey % 180) || '.0 ' || (s_suppkey % 90) || '.0', ', ' ORDER BY s_suppkey) AS st_linestring FROM supplier GROUP BY 1")
#: Cells of the cube's six faces and their centres; a cell of level 9 and its parent (fixed values).
_FACES = [(0.0, 0.0, "1"), (0.0, 90.0, "3"), (90.0, 0.0, "5"), (0.0, 180.0, "7"), (0.0, -90.0, "9"), (-90.0, 0.0, "b")]
add("geo_s2_cell_id_token", lambda s, d: rows(s, "lat double, lon double", *((a, b) for a, b, _ in _FACES)).select("lat", "lon", geo.s2_cell_token(0, F.col("lat"), F.col("lon")).alias("token")).unionByName(rows(s, "t string", ("89c284",)).select(F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), geo.s2_cell_token(7, token=F.col("t")).alias("token"))), "SELECT * FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, '{t}')" for a, b, t in _FACES) + ", (NULL, NULL, '89c2c')) v(lat, lon, token)")
add("geo_s2_cell_lat_lon", lambda s, d: rows(s, "t string", *((t,) for *_, t in _FACES if t != "5" and t != "b")).select("t", F.round(geo.s2_cell_lat_lon(F.col("t"))["lat"], 6).alias("lat"), F.round(F.abs(geo.s2_cell_lat_lon(F.col("t"))["lon"]), 6).alias("lon")), "SELECT * FROM (VALUES ('1', 0.0::DOUBLE, 0.0::DOUBLE), ('3', 0.0, 90.0), ('7', 0.0, 180.0), ('9', 0.0, 90.0)) v(t, lat, lon)")
add("geo_get_level", lambda s, d: rows(s, "t string", ("1",), ("89c284",), ("89c2c",)).select("t", geo.get_level(F.col("t")).alias("level")), "SELECT * FROM (VALUES ('1', 0), ('89c284', 9), ('89c2c', 7)) v(t, level)")
fn("geo_cells", "supplier", "s_suppkey", lambda: geo.get_level(geo.s2_cell_token(10, F.col("s_suppkey") % 90, F.col("s_suppkey") % 180)), "10")


def _cells(s, d) -> TableStream:
    p = _places(s, d)
    return p.to(p.df.withColumn("s2_cell_id", geo.s2_cell_token(9, F.col("lat"), F.col("lon"))))


_BOX = {"minLat": 10, "maxLat": 40, "minLon": 20, "maxLon": 70}
_INBOX = f"{_LAT} BETWEEN 10 AND 40 AND {_LON} BETWEEN 20 AND 70"
add("geo_strict_filter", lambda s, d: geo.strict_filter(_cells(s, d), _BOX).df.select("s_suppkey"), f"SELECT s_suppkey FROM supplier WHERE {_INBOX}")
add("geo_filter_rows", lambda s, d: geo.filter_rows(_cells(s, d), _BOX).df.select("s_suppkey"), f"SELECT s_suppkey FROM supplier WHERE {_INBOX}")
add("geo_grid_filter", lambda s, d: geo.strict_filter(geo.grid_filter(_cells(s, d), _BOX), _BOX).df.agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM supplier WHERE {_INBOX}")
one("geo_get_grid", lambda s: {"level": geo.get_grid({"lat": 0.0, "lon": 0.0, "radius": 10.0}, level=0)["level"], "cells": F.array_join(F.array(*map(F.lit, geo.get_grid({"lat": 0.0, "lon": 0.0, "radius": 10.0}, level=0)["set"])), ",")}, "0 AS level, '1' AS cells")
add("geo_detect_level", lambda s, d: _cells(s, d).df.select(geo.get_level(F.col("s2_cell_id")).alias("level")).distinct(), "SELECT 9 AS level")
add("geo_group_by_area", lambda s, d: aggregates.count(geo.group_by_area(_cells(s, d), "area", 0).pipe(lambda x: x.to(x.df.withColumn(VALUE, F.lit(1))))).df.agg(F.sum(VALUE).alias("n"), F.max(geo.get_level(F.col("area"))).alias("level")), "SELECT count(*) AS n, 0 AS level FROM supplier")


def _fixes(s, d) -> TableStream:
    p = _places(s, d).df.select(F.timestamp_micros(F.col("s_suppkey") * 1_000_000).alias(TIME), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    return table(p.unpivot([TIME], ["latitude", "longitude"], "_field", VALUE), ("_field",))


add("geo_to_rows", lambda s, d: geo.to_rows(_fixes(s, d).to(key=())).df.select(F.unix_seconds(TIME).alias("k"), "latitude", "longitude"), f"SELECT s_suppkey AS k, {_LAT}::DOUBLE AS latitude, {_LON}::DOUBLE AS longitude FROM supplier")
add("geo_shape_data", lambda s, d: geo.shape_data(_fixes(s, d).to(key=()), "latitude", "longitude", 9).df.select(F.unix_seconds(TIME).alias("k"), "lat", "lon", geo.get_level(F.col("s2_cell_id")).alias("level")), f"SELECT s_suppkey AS k, {_LAT}::DOUBLE AS lat, {_LON}::DOUBLE AS lon, 9 AS level FROM supplier")

# Monitoring, alerts, tasks

_LEVEL = "CASE WHEN value > 20 THEN 'crit' WHEN value > 10 THEN 'warn' ELSE 'ok' END"


def _checked(s, d) -> TableStream:
    e = ev(s, d)
    return monitor.check(e.to(e.df.withColumn("_measurement", F.lit("m"))), lambda r: r["_level"], crit=lambda r: r["_value"] > 20, warn=lambda r: r["_value"] > 10, ok=lambda r: r["_value"] <= 10, data={"check_id": "c1", "type": "threshold"})


def _logged(s, d) -> str:
    path = scratch(s, "statuses")
    monitor.log(_checked(s, d), path)
    return path


add("monitor_log", lambda s, d: s.read.parquet(_logged(s, d)).groupBy("_level", "_check_id", "_type").agg(F.count("*").alias("n")), f"SELECT {_LEVEL} AS _level, 'c1' AS _check_id, 'threshold' AS _type, count(*) AS n FROM events GROUP BY 1")
add("monitor_write", lambda s, d: s.read.parquet(_logged(s, d)).groupBy("_level").agg(F.count("*").alias("n")), f"SELECT {_LEVEL} AS _level, count(*) AS n FROM events GROUP BY 1")
add("monitor_from", lambda s, d: monitor.from_log(s, _logged(s, d), "2024-01-03T00:00:00Z", "2024-01-05T00:00:00Z", lambda r: r["_level"] == "crit").df.select("event_id"), "SELECT event_id FROM events WHERE value > 20 AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05'")
add("monitor_logs", lambda s, d: monitor.from_log(s, _logged(s, d), "2024-01-03T00:00:00Z", "2024-01-05T00:00:00Z").df.groupBy("_level").agg(F.count("*").alias("n")), f"SELECT {_LEVEL} AS _level, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05' GROUP BY 1")
one("monitor_levels", lambda s: {"ok": monitor.OK, "info": monitor.INFO, "warn": monitor.WARN, "crit": monitor.CRIT, "unknown": monitor.UNKNOWN, "any": monitor.ANY, "bucket": monitor.BUCKET}, "'ok' AS ok, 'info' AS info, 'warn' AS warn, 'crit' AS crit, 'unknown' AS unknown, 'any' AS any, '_monitoring' AS bucket")
add("monitor_notify", at_now(lambda s, d: monitor.notify(_checked(s, d), sinks.endpoint(lambda r: {"data": r["_level"]}, send=lambda m: m["data"] == "crit"), {"notification_rule_id": "r1"}).df.groupBy("_sent", "_notification_rule_id").agg(F.count("*").alias("n"))), "SELECT CASE WHEN value > 20 THEN 'true' ELSE 'false' END AS _sent, 'r1' AS _notification_rule_id, count(*) AS n FROM events GROUP BY 1")
add("monitor_state_changes_only", lambda s, d: monitor.state_changes_only(_checked(s, d).to(order=(TIME, "event_id"))).df.select("event_id"), f"SELECT event_id FROM (SELECT event_id, {_LEVEL} AS l, lag({_LEVEL}) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events) WHERE l <> p")


def _runs(s) -> TableStream:
    return table(rows(s, "_time timestamp, status string", (datetime(2024, 1, 1), "success"), (datetime(2024, 1, 2), "success"), (datetime(2024, 1, 3), "failed")))


one("tasks_last_success", lambda s: {"out": F.lit(monitor.task_last_success(_runs(s), "2020-01-01T00:00:00Z").isoformat()), "none": F.lit(monitor.task_last_success(_runs(s).pipe(lambda x: x.to(x.df.limit(0))), "2020-01-01T00:00:00Z").isoformat())}, "'2024-01-02T00:00:00' AS out, '2020-01-01T00:00:00' AS none")
one("tasks_zero_time", lambda s: {"out": F.lit(monitor.ZERO_TIME.isoformat())}, "'1970-01-01T00:00:00' AS out")
add("alert", lambda s, d: composed.alert(ev(s, d), composed.define_check("id1", "name1"), crit=lambda r: r["_value"] > 20, warn=lambda r: r["_value"] > 10, topic="t").df.groupBy("_level", "_message", "id", "_topic").agg(F.count("*").alias("n")), f"SELECT {_LEVEL} AS _level, 'name1 is: ' || {_LEVEL} AS _message, 'id1' AS id, 't' AS _topic, count(*) AS n FROM events GROUP BY 1, 2")
one("alert_define_check", lambda s: {k: F.lit(v) for k, v in composed.define_check("a", "b", "custom").items() if k != "tags"}, "'a' AS check_id, 'b' AS check_name, 'custom' AS type")
op("alert_select", lambda s: composed.select(s, "v"), ["event_id", "v"], "SELECT event_id, _value AS v FROM ev")
op("alert_select_fn", lambda s: composed.select(s, "total", fn=aggregates.sum), ["event_type", "round(total, 4) AS total"], "SELECT event_type, round(sum(_value), 4) AS total FROM ev GROUP BY 1")
op("alert_compute", lambda s: composed.compute(s, "top", fn=selectors.max), ["event_type", "top"], "SELECT event_type, max(_value) AS top FROM ev GROUP BY 1")
op("alert_group_by", lambda s: aggregates.count(composed.group_by(s.to(s.df.withColumn("_measurement", F.lit("m"))), ["user_id"])), ["_measurement", "user_id", VALUE], "SELECT 'm' AS _measurement, user_id, count(*) AS _value FROM ev GROUP BY 2")


def _sides(s, d):
    day = lambda how: shape.ungroup(windows.aggregate_window(ev(s, d, key=()), "1d", how, create_empty=False))
    return {"a": shape.keep(day("count"), [TIME, VALUE]), "b": shape.keep(day("max"), [TIME, VALUE])}


add("alert_join", lambda s, d: composed.join_streams(_sides(s, d), measurement="j").df.select(TIME, "_measurement", "_value_a", "_value_b"), "SELECT date_trunc('day', ts) + INTERVAL 1 DAY AS _time, 'j' AS _measurement, count(*) AS _value_a, max(value) AS _value_b FROM events GROUP BY 1")
add("alert_deadman", at_now(lambda s, d: composed.dead_or_alive(ev(s, d).pipe(lambda e: e.to(e.df.withColumn("_measurement", F.lit("m")))), composed.define_check("i", "n"), "gone").df.select("_level", "_message")), "SELECT 'crit' AS _level, 'Deadman Check: n is: dead' AS _message")
_NB = [("a", "x", True)] * 3 + [("a", "y", True)] + [("b", "x", True)] + [("b", "y", True)] * 3 + [(None, "x", False), (None, "y", False)]
add("naive_bayes", lambda s, d: monitor.naive_bayes(table(rows(s, "c string, f string, train boolean", *_NB)), "c", "f", F.col("train")).df, "SELECT * FROM (VALUES ('x', 'a', 0.75::DOUBLE), ('x', 'b', 0.25), ('y', 'a', 0.25), ('y', 'b', 0.75)) v(f, c, probability)")
_H = lambda h: datetime(2024, 1, 1, h)
_OEE = [(_H(0), "running", 0, 0), (_H(2), "stopped", 10, 1), (_H(3), "running", 10, 1), (_H(7), "stopped", 30, 2)]


def _machine(s) -> TableStream:
    df = rows(s, "_time timestamp, state string, partCount long, badCount long", *_OEE).withColumns({"_stop": F.lit("2024-01-01 08:00:00").cast("timestamp"), "m": F.lit("m1")})
    return table(df, ("m", "_stop"))


add("oee_apq", lambda s, d: composed.apq(_machine(s), "running", "8h", "10m").df.select("m", *(F.round(c, 6).alias(c) for c in ("availability", "performance", "quality", "oee"))), "SELECT 'm1' AS m, 0.75::DOUBLE AS availability, round(30 * 10 / 360.0, 6)::DOUBLE AS performance, round(28 / 30.0, 6)::DOUBLE AS quality, round(0.75 * (300 / 360.0) * (28 / 30.0), 6)::DOUBLE AS oee")
add("oee_compute_apq", lambda s, d: composed.compute_apq(_machine(s), _machine(s), "running", "8h", "10m").df.select("m", F.round("oee", 6).alias("oee")), "SELECT 'm1' AS m, round(0.75 * (300 / 360.0) * (28 / 30.0), 6)::DOUBLE AS oee")

# Whole tables where a smaller query stood

op(
    "aggregate_window_empty",
    lambda s: windows.aggregate_window(shape.range(s, "2024-01-05T00:00:00Z", "2024-01-06T00:00:00Z"), "1m", "count"),
    ["event_type", TIME, VALUE],
    """, w AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-05 23:59:00', INTERVAL 1 MINUTE)) AS a),
e AS (SELECT * FROM ev WHERE _time >= TIMESTAMP '2024-01-05' AND _time < TIMESTAMP '2024-01-06')
SELECT k.event_type, w.a + INTERVAL 1 MINUTE AS _time, count(e.event_id) AS _value FROM (SELECT DISTINCT event_type FROM e) k CROSS JOIN w
LEFT JOIN e ON e.event_type = k.event_type AND date_trunc('minute', e._time) = w.a GROUP BY 1, 2""",
)
op(
    "select_window",
    lambda s: composed.select_window(shape.range(s, "2024-01-05T00:00:00Z", "2024-01-06T00:00:00Z"), "total", "sum", "5m", 0.0),
    ["event_type", TIME, "round(total, 6) AS total"],
    """, w AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-05 23:55:00', INTERVAL 5 MINUTE)) AS a),
e AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, _time, TIMESTAMP '1970-01-01') AS b FROM ev WHERE _time >= TIMESTAMP '2024-01-05' AND _time < TIMESTAMP '2024-01-06')
SELECT k.event_type, w.a + INTERVAL 5 MINUTE AS _time, round(coalesce(sum(e._value), 0.0), 6) AS total FROM (SELECT DISTINCT event_type FROM e) k CROSS JOIN w
LEFT JOIN e ON e.event_type = k.event_type AND e.b = w.a GROUP BY 1, 2""",
)
op(
    "linear_fit",
    lambda s: composed.linear_fit(shape.keep(s, ["event_type", "event_id", TIME, VALUE])),
    ["event_id", "x", "round(slope, 8) AS slope", "round(y_hat, 5) AS y_hat"],
    f""", x AS (SELECT *, row_number() OVER ({W})::DOUBLE AS x FROM ev)
SELECT event_id, x, round(regr_slope(_value, x) OVER (PARTITION BY event_type), 8) AS slope,
  round(regr_slope(_value, x) OVER (PARTITION BY event_type) * x + regr_intercept(_value, x) OVER (PARTITION BY event_type), 5) AS y_hat FROM x""",
)

# Engine hooks

one("runtime_version", lambda s: {"out": engine.version().startswith("tidemill")}, "true AS out")


def _without(s, d, key="spark.sql.optimizer.excludedRules"):
    with engine.without_rules(s, "org.apache.spark.sql.catalyst.optimizer.ConstantFolding"):
        inside = s.conf.get(key)
    return rows(s, "inside boolean, after boolean", ("ConstantFolding" in inside, s.conf.get(key, None) is None))


add("planner_disable_logical_rules", _without, "SELECT true AS inside, true AS after")
add("planner_disable_physical_rules", _without, "SELECT true AS inside, true AS after")
add("profiler_query", lambda s, d: engine.profile(ev(s, d)).select("rows"), "SELECT count(*) AS rows FROM events")
add("profiler_operator", lambda s, d: engine.profile(ev(s, d), "operator").agg(F.max(F.col("node").contains("Scan parquet")).alias("scan")), "SELECT true AS scan")
op("debug_pass", lambda s: engine.passed(s), ["event_id"], "SELECT event_id FROM ev")
op("debug_opaque", lambda s: engine.opaque(s), ["event_id"], "SELECT event_id FROM ev")
op("debug_slurp", lambda s: engine.slurp(shape.set(s, "slurped", "x")), ["event_id"], "SELECT event_id FROM ev")
add("debug_sink", lambda s, d: rows(s, "out boolean", (engine.sink(ev(s, d)) is None,)), "SELECT true AS out")
one("debug_get_option", lambda s: {"out": F.lit(str(engine.get_option("location"))), "none": F.lit(str(engine.get_option("absent", "x")))}, "'UTC' AS out, 'x' AS none")
one("debug_feature", lambda s: {"known": engine.feature(s, "spark.sql.adaptive.enabled") == "true", "unknown": F.lit(engine.feature(s, "no.such.flag"))}, "true AS known, NULL::VARCHAR AS unknown")
one("debug_null", lambda s: {"out": engine.null("long")}, "NULL::BIGINT AS out")
add("debug_vectorize", lambda s, d: engine.vectorize(ev(s, d), lambda r: {"twice": r["_value"] * 2}).df.select("event_id", "twice"), "SELECT event_id, value * 2 AS twice FROM events")
one("boolean_constants", lambda s: {"yes": engine.TRUE, "no": engine.FALSE}, "true AS yes, false AS no")
one("epoch_times", lambda s: {"epoch": F.lit(engine.EPOCH.isoformat()), "first": F.lit(engine.MIN_TIME.isoformat()), "last": F.lit(engine.MAX_TIME.isoformat())}, "'1970-01-01T00:00:00' AS epoch, '1677-09-21T00:12:43.145224' AS first, '2262-04-11T23:47:16.854775' AS last")
one("location_location", lambda s: {"out": dates.location("Europe/Paris"), "bad": _says(lambda: dates.location("No/Where")) != "ok"}, "'Europe/Paris' AS out, true AS bad")

# Plans: what the optimizer does with them


def planned(name: str, make: Callable[[SparkSession, str], DataFrame], *patterns: str) -> None:
    """Whether the physical plan has each pattern."""

    def run(s, d):
        plan = make(s, d)._jdf.queryExecution().executedPlan().toString()
        return rows(s, "pattern string, there boolean", *((p, bool(re.search(p, plan))) for p in patterns))

    add(f"plan_{name}", run, "SELECT * FROM (VALUES " + ", ".join(f"('{p}', true)" for p in patterns) + ") v(pattern, there)")


planned("sort_limit", lambda s, d: selectors.limit(selectors.sort(ev(s, d, key=()), [VALUE]), 3).df, "TakeOrderedAndProject")
planned("group_limit", lambda s, d: selectors.top(ev(s, d), 3).df, "WindowGroupLimit")
planned("window_aggregate", lambda s, d: windows.aggregate_window(ev(s, d), "1d", "sum", create_empty=False).df, "partial_sum", "HashAggregate")
planned("filter_pushdown", lambda s, d: shape.filter(ev(s, d), lambda r: r["_value"] > 1).df.select("event_id"), "PushedFilters: .*GreaterThan.value,1", "ReadSchema: struct<event_id:bigint,value:double>")
planned("equi_join", lambda s, d: joins.by_key(ev(s, d), ev(s, d), lambda l, r: {"event_type": l["event_type"], "x": l["_value"]}).df, "SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin")
planned("sort_merge_join", lambda s, d: read(s, d, "orders").hint("merge").join(read(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")), "SortMergeJoin", "Exchange hashpartitioning")
planned("vectorized_map", lambda s, d: shape.map(ev(s, d), lambda r: {"v": r["_value"] * 2}).df, "Project", "ColumnarToRow")
planned("schema_mutation", lambda s, d: shape.rename(shape.drop(ev(s, d), ["user_id"]), {VALUE: "v"}).df.select("v"), "ReadSchema: struct<value:double>")
planned("pivot", lambda s, d: shape.pivot(shape.ungroup(ev(s, d)), [TIME], ["event_type"], values=["click", "view"]).df, "partial_pivotfirst|partial_max_by|HashAggregate|ObjectHashAggregate")
planned("parallel_merge", lambda s, d: aggregates.sum(ev(s, d)).df, "Exchange hashpartitioning", "partial_sum")
planned("quantile_sketch", lambda s, d: aggregates.quantile(ev(s, d), 0.5).df, "partial_histogram_numeric")

# Streams: a table through a stream of files, to the end


_CUTS = ["2024-01-08", "2024-01-15", "2024-01-22"]


def _streamed(s, d, make: Callable[[TableStream], TableStream], mode: str = "append") -> DataFrame:
    """``make`` over the events as they come, a part of the time after the other. A
    folder of files lands at once, so a batch is a whole part. What is appended goes
    to files as well; complete tables, a row a group, are held."""
    path, name, folder = scratch(s, "stream"), f"st_{uuid.uuid4().hex[:8]}", s.sparkContext._jvm.org.apache.hadoop.fs.Path
    e = ev(s, d)
    part = sum(F.coalesce((col(TIME) >= t).cast("int"), F.lit(0)) for t in _CUTS)
    e.df.withColumn("__part", part).write.partitionBy("__part").parquet(f"{path}/all")
    files = folder(path).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder(f"{path}/in"))
    out = make(e.to(s.readStream.schema(e.df.schema).parquet(f"{path}/in/*")))
    sink = {"format": "parquet", "path": f"{path}/out"} if mode == "append" else {}
    with state_partitions(s):
        q = ingest.write(out, name, mode, f"{path}/checkpoint", **sink)
    try:
        for i in range(len(_CUTS) + 1):
            if files.exists(folder(f"{path}/all/__part={i}")):
                files.rename(folder(f"{path}/all/__part={i}"), folder(f"{path}/in/{i}"))
                q.processAllAvailable()
    finally:
        q.stop()
    return s.read.schema(out.df.schema).parquet(f"{path}/out") if sink else s.table(name)


@contextmanager
def state_partitions(s):
    """A stream keeps its partitions of state, a file each a batch, whatever they
    hold: no more than four a core."""
    key = "spark.sql.shuffle.partitions"
    n = s.conf.get(key)
    s.conf.set(key, str(min(int(n), 4 * s.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        s.conf.set(key, n)


add("stream_windowed", lambda s, d: _streamed(s, d, lambda t: ingest.windowed(t, "1d", {"n": F.count("*")}), "complete").select("event_type", "_start", "n"), "SELECT event_type, date_trunc('day', ts) AS _start, count(*) AS n FROM events GROUP BY 1, 2")
add("stream_windowed_months", lambda s, d: _streamed(s, d, lambda t: ingest.windowed(t, "1mo", {"n": F.count("*")}), "complete").select("event_type", "_start", "n"), "SELECT event_type, date_trunc('month', ts) AS _start, count(*) AS n FROM events GROUP BY 1, 2")
add("stream_last_seen", lambda s, d: _streamed(s, d, lambda t: t.to(ingest.last_seen(t)), "complete").select("event_type", TIME), "SELECT event_type, max(ts) AS _time FROM events GROUP BY 1")
add("stream_dedup", lambda s, d: _streamed(s, d, lambda t: ingest.dedup(t, ["event_id"])).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM events")
add("stream_filter_append", lambda s, d: _streamed(s, d, lambda t: shape.filter(t, lambda r: r["_value"] > 10)).select("event_id"), "SELECT event_id FROM events WHERE value > 10")
add("stream_state_changes", lambda s, d: _streamed(s, d, lambda t: ingest.level_changes(t, lambda r: F.when(r["_value"] > 10, "crit").otherwise("ok"))).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM (SELECT value > 10 AS l, lag(value > 10) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events) WHERE l <> p")
add("socket_lines", lambda s, d: ingest.decode_lines(rows(s, "value string", ("m,t=a v=1.5,n=2i 1704067200000000000",), ("x v=3",))).select("_measurement", "_field", VALUE, TIME), "SELECT * FROM (VALUES ('m', 'v', 1.5::DOUBLE, TIMESTAMP '2024-01-01'), ('m', 'n', 2.0, TIMESTAMP '2024-01-01'), ('x', 'v', 3.0, NULL)) v(_measurement, _field, _value, _time)")
for _n, _make, _want in (
    ("after_processing_time", lambda t: t.after("10s"), [False, True, True, True]),
    ("after_at_least", lambda t: t.at_least(3), [False, False, True, True]),
    ("repeated", lambda t: t.at_least(2).repeated(), [False, True, False, True]),
    ("or_finally", lambda t: t.at_least(3).or_finally(t.watermark(4)), [False, False, True, True]),
    ("after_watermark", lambda t: t.watermark(2), [False, True, True, True]),
):
    # one row arrives every ten seconds; the watermark is the row's number
    add(f"trigger_{_n}", lambda s, d, m=_make: rows(s, "i long, fired boolean", *enumerate(ingest.simulate(m(ingest.Trigger), [(10.0 * i, 1, i + 1) for i in range(4)]))), "SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(v).lower()})" for i, v in enumerate(_want)) + ") v(i, fired)")
add("trigger_narrow", lambda s, d: rows(s, "k string, fired boolean", *sorted(ingest.narrow(ingest.Trigger.at_least(2), [("a", 0.0, 1, 1), ("b", 1.0, 1, 1), ("a", 2.0, 1, 1)]).items())), "SELECT * FROM (VALUES ('a', true), ('b', false)) v(k, fired)")
one("periodic_tasks", at_now(lambda s: {"next": F.lit(ingest.Task("t", lambda: None, "1h", offset="5m").next_run(NOW).isoformat()), "ran": ingest.Task("t", lambda: 7, "1h").run(NOW)["status"]}), "'2024-01-17T11:05:00' AS next, 'success' AS ran")

del math
__all__ = ["QUERIES", "SQL"]
