"""Sources: stored tables, annotated CSV, JSON results, SQL, generators, sockets,
metrics pages and sample series. Each returns a ``TableStream``."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterable, Sequence
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import shape
from ..plans.duration import parse
from ..plans.stream import START, STOP, TIME, VALUE, Record, TableStream, col, instant, table, time_lit

#: Types of annotated CSV (fixed values).
CSV_TYPES = {
    "boolean": T.BooleanType(), "long": T.LongType(), "unsignedLong": T.DecimalType(20, 0), "double": T.DoubleType(), "string": T.StringType(),
    "tag": T.StringType(), "dateTime": T.TimestampType(), "dateTime:RFC3339": T.TimestampType(), "dateTime:RFC3339Nano": T.TimestampType(),
    "base64Binary": T.BinaryType(), "duration": T.LongType(),
}

#: Where the HTTP sources ask, unless told (fixed values).
HTTP_SQL_URL, LOG_URL, LOG_PATH = "http://127.0.0.1:8123", "http://127.0.0.1:3100", "/loki/api/v1/query_range"
#: Bounds that schema exploration uses, unless told (fixed values).
EXPLORED_START, EXPLORED_STOP = "-30d", "0s"


def from_rows(spark: SparkSession, rows: Iterable[dict], schema: str | T.StructType | None = None) -> TableStream:
    """One table without a key, of literal records."""
    rows = list(rows)
    if not rows and schema is None:
        raise ValueError("rows must be non-empty, or have a schema")
    return table(spark.createDataFrame([tuple(r.values()) for r in rows], schema or list(rows[0])))


def bucket(spark: SparkSession, path_or_table: str, key: Sequence[str] | None = None, fmt: str = "parquet", **renamed: str) -> TableStream:
    """A stored long-form table; all of tags, _measurement and _field are the
    key unless stated. Filters on it prune partitions and row groups."""
    df = spark.read.format(fmt).load(path_or_table) if "/" in path_or_table else spark.table(path_or_table)
    out = table(df, **renamed)
    if key is None:
        key = [f.name for f in out.df.schema if isinstance(f.dataType, T.StringType) and f.name not in (VALUE, START, STOP)]
    return out.to(key=tuple(key))


def from_range(spark: SparkSession, bucket_: str, start, stop=None, **kw) -> TableStream:
    return shape.range(bucket(spark, bucket_, **kw), start, stop)


def filter_measurement(s: TableStream, measurement: str) -> TableStream:
    return shape.filter(s, lambda r: r["_measurement"] == measurement)


def filter_fields(s: TableStream, fields: Sequence[str] = ()) -> TableStream:
    return shape.filter(s, lambda r: r["_field"].isin(*fields)) if fields else s


def in_bucket(spark: SparkSession, bucket_: str, measurement: str, start, stop=None, fields: Sequence[str] = (), predicate: Callable[[Record], Column] | None = None) -> TableStream:
    s = filter_fields(filter_measurement(from_range(spark, bucket_, start, stop), measurement), fields)
    return shape.filter(s, predicate) if predicate else s


def select(spark: SparkSession, bucket_: str, start, measurement: str, stop=None, fields: Sequence[str] = (), where=None) -> TableStream:
    """Measurement, fields and predicate of a bucket, with the fields as columns."""
    return shape.fields_as_columns(in_bucket(spark, bucket_, measurement, start, stop, fields, where))


def cardinality(s: TableStream, start, stop=None, predicate=None) -> TableStream:
    """How many series (distinct keys) have rows in a time range."""
    kept = shape.range(s, start, stop)
    kept = shape.filter(kept, predicate) if predicate else kept
    a, b = kept.bounds
    n = kept.df.select(*map(col, s.key)).distinct().agg(F.count(F.lit(1)).alias(VALUE))
    return TableStream(n.select(time_lit(a).alias(START), time_lit(b).alias(STOP), VALUE), (START, STOP), ())


# Schema exploration


def tag_values(s: TableStream, tag: str, predicate=None, start=EXPLORED_START, stop=None) -> TableStream:
    kept = shape.range(s, start, stop) if start is not None else s
    kept = shape.filter(kept, predicate) if predicate else kept
    out = kept.df.where(col(tag).isNotNull()).select(col(tag).alias(VALUE)).distinct()
    return TableStream(out, (), (VALUE,))


def tag_keys(s: TableStream, predicate=None, start=EXPLORED_START, stop=None) -> TableStream:
    """Key labels that some row of the range has a value for."""
    kept = shape.range(s, start, stop) if start is not None else s
    kept = shape.filter(kept, predicate) if predicate else kept
    there = kept.df.agg(F.array(*(F.when(F.count(col(k)) > 0, F.lit(k)) for k in kept.key)).alias("k"))
    return TableStream(there.select(F.explode("k").alias(VALUE)).where(col(VALUE).isNotNull()), (), (VALUE,))


def measurements(s: TableStream, **kw) -> TableStream:
    return tag_values(s, "_measurement", **kw)


def field_keys(s: TableStream, **kw) -> TableStream:
    return tag_values(s, "_field", **kw)


def measurement_tag_values(s: TableStream, measurement: str, tag: str, **kw) -> TableStream:
    return tag_values(s, tag, predicate=lambda r: r["_measurement"] == measurement, **kw)


def measurement_tag_keys(s: TableStream, measurement: str, **kw) -> TableStream:
    return tag_keys(s, predicate=lambda r: r["_measurement"] == measurement, **kw)


def measurement_field_keys(s: TableStream, measurement: str, **kw) -> TableStream:
    return measurement_tag_values(s, measurement, "_field", **kw)


def buckets(spark: SparkSession) -> DataFrame:
    """Stored tables and views as metadata rows."""
    rows = [(t.name, f"{t.database or ''}", t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, database string, type string")


def databases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name, d.locationUri) for d in spark.catalog.listDatabases()], "name string, location string")


# Annotated CSV


def _cell(text: str, kind: T.DataType):
    if text == "" and not isinstance(kind, T.StringType):
        return None
    if isinstance(kind, T.BooleanType):
        return {"true": True, "false": False, "t": True, "f": False}[text.lower()]
    if isinstance(kind, T.LongType):
        return int(parse(text).micros * 1000) if re.search("[a-z]", text) else int(text)
    if isinstance(kind, T.DecimalType):
        import decimal

        return decimal.Decimal(text)
    if isinstance(kind, T.DoubleType):
        return float(text)
    if isinstance(kind, T.TimestampType):
        return instant(re.sub(r"(\.\d{6})\d+", r"\1", text))
    if isinstance(kind, T.BinaryType):
        import base64

        return base64.b64decode(text)
    return text


def csv_tables(text: str) -> list[dict]:
    """Blocks of annotated CSV: names, types, key flags and rows."""
    out, block, notes = [], None, {}
    for row in csv.reader(io.StringIO(text)):
        if not any(row):
            block, notes = None, {}
        elif row[0].startswith("#"):
            if block is not None:
                block, notes = None, {}
            notes[row[0][1:]] = row[1:]
        elif block is None:
            names = row[1:]
            kinds = [CSV_TYPES[t] for t in notes["datatype"]]
            block = {"names": names, "types": notes["datatype"], "kinds": kinds, "group": [g == "true" for g in notes.get("group", ["false"] * len(names))], "default": notes.get("default", [""] * len(names)), "rows": []}
            out.append(block)
        else:
            cells = [c if c != "" else d for c, d in zip(row[1:], block["default"])]
            block["rows"].append([_cell(c, k) for c, k in zip(cells, block["kinds"])])
    return out


def from_csv(spark: SparkSession, csv_text: str | None = None, file: str | None = None, mode: str = "annotations") -> TableStream:
    """Annotated CSV (text or a path Spark reads), or ``raw``: all columns text."""
    if (csv_text is None) == (file is None):
        raise ValueError("give csv text or a file")
    if mode == "raw":
        if file:
            return table(spark.read.csv(file, header=True))
        rows = list(csv.reader(io.StringIO(csv_text)))
        return table(spark.createDataFrame([tuple(r) for r in rows[1:]], T.StructType([T.StructField(n, T.StringType()) for n in rows[0]])))
    if file:
        return _from_csv_files(spark, file)
    df, key = None, {}
    for b in csv_tables(csv_text):
        at = [i for i, n in enumerate(b["names"]) if n not in ("result", "table")]
        schema = T.StructType([T.StructField(b["names"][i], b["kinds"][i]) for i in at])
        part = spark.createDataFrame([tuple(r[i] for i in at) for r in b["rows"]], schema)
        key |= {b["names"][i]: 1 for i in at if b["group"][i]}
        df = part if df is None else df.unionByName(part, allowMissingColumns=True)
    if df is None:
        raise ValueError("no tables in the csv")
    return table(df, tuple(key))


def _from_csv_files(spark: SparkSession, file: str) -> TableStream:
    """Annotated files, each parsed where it is read. Only the blocks' headers go
    to the driver, which makes one schema of them."""
    whole = spark.read.text(file, wholetext=True)

    def heads(batches):
        for pdf in batches:
            found = {json.dumps([b["names"], b["types"], b["group"]]) for text in pdf["value"] for b in csv_tables(text)}
            yield pd.DataFrame({"head": sorted(found)})

    fields, key = {}, {}
    for r in whole.mapInPandas(heads, "head string").distinct().sort("head").collect():
        for name, kind, grouped in zip(*json.loads(r["head"])):
            if name not in ("result", "table"):
                fields.setdefault(name, kind)
                key |= {name: 1} if grouped else {}
    if not fields:
        raise ValueError("no tables in the csv")
    schema = T.StructType([T.StructField(n, CSV_TYPES[k]) for n, k in fields.items()])
    kinds = to_arrow_schema(schema)

    def rows(batches):
        for batch in batches:
            for text in batch.column("value").to_pylist():
                for b in csv_tables(text):
                    at = {n: i for i, n in enumerate(b["names"])}
                    cols = [pa.array([r[at[f.name]] if f.name in at else None for r in b["rows"]], f.type) for f in kinds]
                    yield pa.RecordBatch.from_arrays(cols, schema=kinds)

    return table(whole.mapInArrow(rows, schema), tuple(key))


def from_url(spark: SparkSession, url: str, mode: str = "annotations") -> TableStream:
    return from_csv(spark, fetch(url)["body"].decode(), mode=mode)


def fetch(url: str, method: str = "GET", headers: dict | None = None, body: bytes | None = None, timeout: float = 30.0) -> dict:
    """One HTTP call of the driver: statusCode, headers, body."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, data=body, headers=headers or {}, method=method), timeout=timeout) as r:  # noqa: S310
            return {"statusCode": r.status, "headers": dict(r.headers), "body": r.read()}
    except HTTPError as e:
        return {"statusCode": e.code, "headers": dict(e.headers), "body": e.read()}


def from_result_json(spark: SparkSession, json_text: str | None = None, file: str | None = None) -> TableStream:
    """A JSON result document: results, series, columns and values; tags and the
    series' name are the key."""
    if file:
        json_text = spark.read.text(file, wholetext=True).first()[0]
    rows, tags, names = [], {}, {}
    for result in json.loads(json_text)["results"]:
        for series in result.get("series", []):
            tags |= dict.fromkeys(series.get("tags", {}))
            for values in series["values"]:
                row = {"_measurement": series["name"], **series.get("tags", {}), **dict(zip(series["columns"], values))}
                names |= dict.fromkeys(row)
                rows.append(row)
    if not rows:
        raise ValueError("no series in the document")
    df = spark.createDataFrame([{n: r.get(n) for n in names} for r in rows], _guess(rows, names))
    if "time" in names:
        t = F.to_timestamp("time") if dict(df.dtypes)["time"] == "string" else F.timestamp_micros((col("time") / 1000).cast("long"))
        df = df.withColumn(TIME, t).drop("time")
    return table(df, ("_measurement", *tags))


def _guess(rows: list[dict], names: Iterable[str]) -> T.StructType:
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}

    def kind(n):
        seen = {type(r[n]) for r in rows if r.get(n) is not None}
        return kinds[float] if seen == {int, float} else kinds[seen.pop()] if len(seen) == 1 else kinds[str]

    return T.StructType([T.StructField(n, kind(n)) for n in names])


# Other systems


def from_sql(spark: SparkSession, driver: str, url: str, query: str, **options) -> TableStream:
    """A query run by another database through its JDBC driver; sqlite files are
    read by the driver where no JDBC jar is at hand."""
    if driver == "sqlite3":
        import sqlite3

        with sqlite3.connect(url) as db:
            cursor = db.execute(query)
            names = [d[0] for d in cursor.description]
            rows = [dict(zip(names, r)) for r in cursor.fetchall()]
        return table(spark.createDataFrame(rows, _guess(rows, names)))
    #: JDBC driver classes by name (fixed values).
    classes = {
        "mysql": "com.mysql.cj.jdbc.Driver", "postgres": "org.postgresql.Driver", "snowflake": "net.snowflake.client.jdbc.SnowflakeDriver",
        "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
        "awsathena": "com.simba.athena.jdbc.Driver", "bigquery": "com.simba.googlebigquery.jdbc.Driver", "hdb": "com.sap.db.jdbc.Driver",
        "vertica": "com.vertica.jdbc.Driver",
    }
    reader = spark.read.format("jdbc").option("driver", classes[driver]).option("url", url).option("query", query)
    return table(reader.options(**options).load())


def from_query(spark: SparkSession, sql: str) -> TableStream:
    """A Spark SQL query over registered tables."""
    return table(spark.sql(sql))


def measurement(spark: SparkSession, name: str) -> TableStream:
    return table(spark.table(name))


def sql_interval(d) -> str:
    d = parse(d)
    return f"INTERVAL '{d.months}' MONTH" if d.months else f"INTERVAL '{d.micros / 1e6:g}' SECOND"


def from_connector(spark: SparkSession, fmt: str, **options) -> TableStream:
    """Any data source Spark has a connector for (wide-column stores and so on)."""
    return table(spark.read.format(fmt).options(**options).load())


def from_http_sql(spark: SparkSession, query: str, url: str = HTTP_SQL_URL, limit: int = 100, max_bytes: int = 10_000_000, fmt: str = "CSVWithNames", cors: str = "1") -> TableStream:
    """SQL over HTTP, answered as CSV with names; the limits are the server's."""
    return from_csv(spark, fetch(http_sql_url(url, query, limit, max_bytes, fmt, cors), headers={"X-ClickHouse-Format": fmt})["body"].decode(), mode="raw")


def http_sql_url(url: str, query: str, limit: int = 100, max_bytes: int = 10_000_000, fmt: str = "CSVWithNames", cors: str = "1") -> str:
    from urllib.parse import urlencode

    return f"{url}?{urlencode({'query': query, 'default_format': fmt, 'max_result_rows': limit, 'max_result_bytes': max_bytes, 'add_http_cors_header': cors})}"


def from_log_query(spark: SparkSession, query: str, start, end=None, url: str = LOG_URL, path: str = LOG_PATH, limit: int = 100, step: int = 10, org: str = "") -> TableStream:
    """Rows of a log store's range query."""
    full = log_query_url(query, start, end, url, path, limit, step)
    return from_csv(spark, fetch(full, headers={"X-Scope-OrgID": org} if org else {})["body"].decode(), mode="raw")


def log_query_url(query: str, start, end=None, url: str = LOG_URL, path: str = LOG_PATH, limit: int = 100, step: int = 10) -> str:
    from urllib.parse import urlencode

    ns = lambda t: int(instant(t).timestamp() * 1e9)
    args = {"query": query, "limit": limit, "start": ns(start), "end": ns(end or "0s"), "step": step, "csv": 1}
    return f"{url}{path}?{urlencode(args)}"


_SAMPLE = re.compile(r"^([A-Za-z_:][\w:]*)(\{.*\})?\s+(\S+)(?:\s+(-?\d+))?$")
_LABEL = re.compile(r'([A-Za-z_]\w*)="((?:[^"\\]|\\.)*)"')


def parse_metrics(text: str) -> list[dict]:
    """Samples of a metrics page in the text exposition format."""
    out = []
    for line in text.splitlines():
        m = _SAMPLE.match(line.strip())
        if m and not line.startswith("#"):
            labels = {k: v.replace('\\"', '"').replace("\\n", "\n").replace("\\\\", "\\") for k, v in _LABEL.findall(m[2] or "")}
            out.append({"name": m[1], "labels": labels, "value": float(m[3].replace("Inf", "inf")), "ms": int(m[4]) if m[4] else None})
    return out


def scrape(spark: SparkSession, url: str | None = None, text: str | None = None, now: datetime | None = None) -> TableStream:
    """A metrics page as rows: _time, _measurement, _field, url, labels, _value."""
    from ..plans.stream import clock

    found = parse_metrics(text if text is not None else fetch(url)["body"].decode())
    labels = sorted({k for f in found for k in f["labels"]})
    at = now or clock.now()
    rows = [(datetime.fromtimestamp(f["ms"] / 1000, UTC).replace(tzinfo=None) if f["ms"] else at, "prometheus", f["name"], url or "", *(f["labels"].get(k) for k in labels), f["value"]) for f in found]
    schema = ", ".join(["_time timestamp", "_measurement string", "_field string", "url string", *(f"`{k}` string" for k in labels), "_value double"])
    return table(spark.createDataFrame(rows, schema), ("_measurement", "_field", "url", *labels))


# Generated series


def generate(spark: SparkSession, start, stop, count: int, fn: Callable[[Column], Column]) -> TableStream:
    """``count`` rows evenly spaced in [start, stop) with the value fn(n)."""
    a, b = instant(start), instant(stop)
    step = round((b - a).total_seconds() * 1e6) // max(count, 1)
    t = F.timestamp_micros(F.unix_micros(time_lit(a)) + col("id") * step)
    df = spark.range(count).select(time_lit(a).alias(START), time_lit(b).alias(STOP), t.alias(TIME), fn(col("id")).alias(VALUE))
    return TableStream(df, (START, STOP), (TIME,), (a, b))


def synthetic(spark: SparkSession, n: int, tags: dict[str, int] | None = None, nulls: float = 0.0, seed: int = 1, start="2020-01-01T00:00:00Z", every="10s") -> TableStream:
    """n rows for every combination of tag values; seeded, a share of them null."""
    tags, step = tags or {}, parse(every).micros
    series = 1
    for size in tags.values():
        series *= size
    df = spark.range(n * series).select("id", (col("id") % series).alias("__s"), F.floor(col("id") / series).alias("__n"))
    at, cols = 1, {}
    for name, size in tags.items():
        cols[name] = F.concat(F.lit(f"{name}-"), (F.floor(col("__s") / at) % size).cast("string"))
        at *= size
    value = F.when(F.rand(seed + 1) >= nulls, F.randn(seed) * 10 + 50)
    t = F.timestamp_micros(F.unix_micros(time_lit(instant(start))) + col("__n") * step)
    return table(df.select(t.alias(TIME), *(c.alias(k) for k, c in cols.items()), value.alias(VALUE)), tuple(tags))


#: Built-in sample series: one minute, ten seconds apart, two tags (own values).
SAMPLE_START, SAMPLE_STOP = datetime(2021, 1, 1), datetime(2021, 1, 1, 0, 1)
_NUMBERS = {"t1": [-2, 10, 7, 17, 15, 4], "t2": [19, 4, -3, 19, 13, 1]}


def sample(spark: SparkSession, kind: str = "float", include_null: bool = False) -> TableStream:
    """Sample series of floats, ints, uints, strings, bools or numericBool (0/1)."""
    make = {"float": lambda x: float(x) + 0.18, "int": int, "uint": lambda x: __import__("decimal").Decimal(x % 2**64), "string": lambda x: f"smpl_{x & 0xFF:x}", "bool": lambda x: x > 5, "numericBool": lambda x: int(x > 5)}[kind]
    types = {"float": "double", "int": "long", "uint": "decimal(20,0)", "string": "string", "bool": "boolean", "numericBool": "long"}
    rows = []
    for tag, values in _NUMBERS.items():
        for i, v in enumerate(values):
            missing = include_null and i in ((0, 3) if tag == "t1" else (1, 5))
            rows.append((datetime(2021, 1, 1, 0, 0, 10 * i), tag, None if missing else make(v)))
    out = table(spark.createDataFrame(rows, f"_time timestamp, tag string, _value {types[kind]}"), ("tag",))
    return out


def sample_sets(spark: SparkSession) -> DataFrame:
    """The catalogue of built-in sample series."""
    return spark.createDataFrame([(k, "one minute, two tags") for k in ("float", "int", "uint", "string", "bool", "numericBool")], "name string, description string")


def empty_table(spark: SparkSession) -> TableStream:
    return TableStream(spark.createDataFrame([], "_start timestamp, _stop timestamp, _time timestamp, _value double"), (START, STOP))


def from_socket(spark: SparkSession, url: str, decoder: str = "line") -> TableStream:
    """A streaming table of a tcp socket's lines, as line protocol or CSV cells."""
    from urllib.parse import urlsplit

    from ..streaming.ingest import decode_lines

    at = urlsplit(url)
    lines = spark.readStream.format("socket").option("host", at.hostname).option("port", at.port).load()
    return table(decode_lines(lines, "value", decoder))
