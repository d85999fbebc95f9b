"""Sinks: tables, databases, topics, line protocol and HTTP endpoints."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stream import START, STOP, TIME, VALUE, Record, TableStream, as_column, col


#: Requests unless told (fixed values).
DEFAULT_CONFIG: dict[str, object] = {"timeout": 30.0, "insecure_skip_verify": False}
EMPTY_BODY = b""
#: Where the services' messages go unless told, and limits and options of theirs (fixed values).
DEFAULT_URLS = {
    "slack": "https://slack.com/api/chat.postMessage", "pagerduty": "https://events.pagerduty.com/v2/enqueue",
    "pushbullet": "https://api.pushbullet.com/v2/pushes", "telegram": "https://api.telegram.org/bot",
    "discord": "https://discordapp.com/api/webhooks/", "bigpanda": "https://api.bigpanda.io/data/v2/alerts",
}
TELEGRAM = {"parse_mode": "MarkdownV2", "disable_web_page_preview": False, "silent": True}
SUMMARY_CUTOFF, TOKEN_PREFIX = 70, "Bearer"


def _escape(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"([{chars}])", r"\\$1")


def line_protocol(s: TableStream, measurement: Column, tags: Sequence[str], fields: dict[str, Column], time_column: str = TIME) -> Column:
    """``measurement,tag=value field=value time`` of each row; null fields and
    tags are left out. Nanosecond times."""
    kinds = dict(s.df.dtypes)
    tag = [F.when(col(t).isNotNull() & (col(t) != ""), F.concat(F.lit("," + t.replace(" ", "\\ ") + "="), _escape(col(t), ",= "))).otherwise("") for t in sorted(tags)]

    def text(name: str, c: Column) -> Column:
        kind = kinds.get(name, "double")
        if kind == "string":
            return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
        if kind in ("bigint", "int"):
            return F.concat(c.cast("string"), F.lit("i"))
        if kind.startswith("decimal"):
            return F.concat(c.cast("string"), F.lit("u"))
        return c.cast("string")

    pairs = F.array(*(F.when(c.isNotNull(), F.concat(F.lit(n.replace(" ", "\\ ") + "="), text(n, c))) for n, c in fields.items()))
    body = F.array_join(F.filter(pairs, lambda x: x.isNotNull()), ",")
    at = F.concat(F.lit(" "), (F.unix_micros(col(time_column)) * 1000).cast("string"))
    return F.when(body != "", F.concat(_escape(measurement, ", "), *tag, F.lit(" "), body, at))


def to_bucket(s: TableStream, path_or_table: str, time_column: str = TIME, measurement_column: str = "_measurement", tag_columns: Sequence[str] | None = None, field_fn: Callable[[Record], dict] | None = None, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> TableStream:
    """Append long-form points: tags, _measurement, _field, _time, _value."""
    s.need(time_column, measurement_column)
    tags = list(tag_columns) if tag_columns is not None else [f.name for f in s.df.schema if isinstance(f.dataType, T.StringType) and f.name not in (measurement_column, "_field", VALUE, START, STOP)]
    base = [col(time_column).alias(TIME), col(measurement_column).alias("_measurement"), *map(col, tags)]
    if field_fn:
        fields = field_fn(s.r)
        pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("_field"), as_column(v).cast("double").alias(VALUE)) for k, v in fields.items()))).alias("__f")
        df = s.df.select(*base, pairs).select("*", "__f.*").drop("__f")
    else:
        df = s.df.select(*base, col("_field"), col(VALUE))
    _append(df.where(col(VALUE).isNotNull() & col(TIME).isNotNull()), path_or_table, fmt, partition_by)
    return s


def to_bucket_wide(s: TableStream, path_or_table: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> TableStream:
    """Append pivoted points: key columns of text are tags, others fields."""
    s.need(TIME, "_measurement")
    tags = [k for k in s.key if k not in (START, STOP, TIME, "_measurement")]
    fields = [c for c in s.columns if c not in (*s.key, TIME, START, STOP, "_measurement")]
    df = s.df.select(col(TIME), col("_measurement"), *map(col, tags), *(col(f).cast("double") for f in fields))
    df = df.unpivot([TIME, "_measurement", *tags], list(fields), "_field", VALUE).where(col(VALUE).isNotNull())
    _append(df, path_or_table, fmt, partition_by)
    return s


def _append(df, where: str, fmt: str, partition_by: Sequence[str]) -> None:
    writer = df.write.mode("append").format(fmt)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.save(where) if "/" in where else writer.saveAsTable(where)


def to_sql(s: TableStream, driver: str, url: str, table: str, batch_size: int = 10_000, **options) -> TableStream:
    """Create the table if need be and insert in batches: through JDBC from the
    executors; into a sqlite file, which is the driver's, row by row there."""
    if driver == "awsathena":
        raise ValueError("this database is read-only")
    if driver == "sqlite3":
        import sqlite3

        kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "INTEGER"}
        with sqlite3.connect(url) as db:
            db.execute(f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(f'{n} {kinds.get(t, "TEXT")}' for n, t in s.df.dtypes)})")
            text = s.df.select(*(col(n) if t in kinds else col(n).cast("string") for n, t in s.df.dtypes))
            db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(s.columns))})", (tuple(r) for r in text.toLocalIterator()))
        return s
    s.df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch_size).options(**options).mode("append").save()
    return s


def to_kafka(s: TableStream, brokers: Sequence[str], topic: str, name: str | None = None, name_column: str | None = None, tag_columns: Sequence[str] = (), value_columns: Sequence[str] = (VALUE,), time_column: str = TIME, **options) -> TableStream:
    """Rows as line protocol to a topic, keyed by their tags."""
    messages = kafka_messages(s, name, name_column, tag_columns, value_columns, time_column)
    messages.write.format("kafka").option("kafka.bootstrap.servers", ",".join(brokers)).option("topic", topic).options(**options).save()
    return s


def kafka_messages(s: TableStream, name, name_column, tag_columns, value_columns, time_column):
    measurement = F.lit(name) if name else col(name_column or "_measurement")
    line = line_protocol(s, measurement, tag_columns, {c: col(c) for c in value_columns}, time_column)
    key = F.concat_ws(",", *map(col, tag_columns)) if tag_columns else F.lit(None).cast("string")
    return s.df.select(key.alias("key"), line.alias("value")).where("value IS NOT NULL")


def to_mqtt(s: TableStream, publish: Callable[[str, str], bool], topic: str | None = None, name: str | None = None, tag_columns: Sequence[str] = (), value_columns: Sequence[str] = (VALUE,), time_column: str = TIME) -> TableStream:
    """Rows as line protocol through ``publish(topic, message)``, a client's own
    function, called where the rows are."""
    line = line_protocol(s, F.lit(name or "mqtt"), tag_columns, {c: col(c) for c in value_columns}, time_column)
    rows = s.df.select(F.lit(topic or name or "mqtt").alias("t"), line.alias("m")).where("m IS NOT NULL")

    def send(part):
        for r in part:
            publish(r["t"], r["m"])

    rows.foreachPartition(send)
    return s


def publish(client: Callable[[str, str], bool], topic: str, message: str) -> bool:
    return bool(client(topic, message))


# HTTP and notifications


def http_post(url: str, headers: dict | None = None, data: bytes = b"") -> int:
    from .tables import fetch

    return fetch(url, "POST", headers, data)["statusCode"]


def basic_auth(user: str, password: str) -> str:
    import base64

    return "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()


def path_escape(text: str) -> str:
    from urllib.parse import quote

    return quote(text, safe="$&+=:@")


def endpoint(make: Callable[[dict], dict], send: Callable[[dict], bool] | None = None) -> Callable[[TableStream], TableStream]:
    """An endpoint of a message maker: applied to a stream it sends one message
    per row, from the tasks, and adds ``_sent``. ``make`` gives url, headers and
    data (text, or what JSON takes)."""

    def deliver(message: dict) -> bool:
        data = message["data"]
        body = data if isinstance(data, bytes) else (data if isinstance(data, str) else json.dumps(data)).encode()
        return 200 <= http_post(message["url"], message.get("headers", {"Content-Type": "application/json"}), body) < 300

    act = send or deliver

    def apply(s: TableStream) -> TableStream:
        names = s.columns

        def run(batches):
            for pdf in batches:
                pdf["_sent"] = [str(act(make(dict(zip(names, r))))).lower() for r in pdf.itertuples(index=False)]
                yield pdf

        schema = T.StructType([*s.df.schema.fields, T.StructField("_sent", T.StringType())])
        return s.to(s.df.mapInPandas(run, schema))

    return apply


#: Message makers of common services: (url, fixed headers, row -> body).
def slack_message(url: str = DEFAULT_URLS["slack"], token: str = "", channel: str = "", text: str = "", color: str = "good") -> dict:
    return {"url": url, "headers": {"Content-Type": "application/json", **({"Authorization": f"Bearer {token}"} if token else {})}, "data": {"channel": channel, "as_user": False, "attachments": [{"color": color, "text": text, "mrkdwn_in": ["text"]}]}}


def pagerduty_message(routing_key: str, summary: str, severity: str, source: str, event_action: str = "trigger", dedup_key: str = "", url: str = DEFAULT_URLS["pagerduty"], **more) -> dict:
    payload = {"summary": summary[:1024], "severity": severity, "source": source, **{k: v for k, v in more.items() if v is not None}}
    return {"url": url, "headers": {"Accept": "application/vnd.pagerduty+json;version=2", "Content-Type": "application/json"}, "data": {"payload": payload, "routing_key": routing_key, "dedup_key": dedup_key, "event_action": event_action}}


def pagerduty_severity(level: str) -> str:
    return {"crit": "critical", "warn": "warning", "info": "info", "ok": "info"}.get(level, "error")


def pagerduty_action(level: str) -> str:
    return "resolve" if level == "ok" else "trigger"


def dedup_key(record: dict, exclude: Sequence[str] = ("_start", "_stop", "_level")) -> str:
    import hashlib

    return hashlib.sha256("\n".join(f"{k}={record[k]}" for k in sorted(record) if k not in exclude).encode()).hexdigest()


def opsgenie_message(api_key: str, message: str, alias: str = "", description: str = "", priority: str = "P3", responders: Sequence[str] = (), tags: Sequence[str] = (), entity: str = "", actions: Sequence[str] = (), details: dict | None = None, visible_to: Sequence[str] = (), url: str = "https://api.opsgenie.com/v2/alerts") -> dict:
    people = lambda xs: [{"type": t.split(":")[0], "username" if t.startswith("user") else "name": t.split(":", 1)[1]} for t in xs]
    return {"url": url, "headers": {"Content-Type": "application/json; charset=utf-8", "Authorization": f"GenieKey {api_key}"}, "data": {"message": message[:130], "alias": alias[:512], "description": description[:15000], "responders": people(responders), "visibleTo": people(visible_to), "actions": list(actions), "tags": list(tags), "details": details or {}, "entity": entity[:512], "priority": priority}}


def telegram_message(token: str, channel: str, text: str, parse_mode: str = TELEGRAM["parse_mode"], disable_web_page_preview: bool = TELEGRAM["disable_web_page_preview"], silent: bool = TELEGRAM["silent"], url: str = DEFAULT_URLS["telegram"]) -> dict:
    return {"url": f"{url}{token}/sendMessage", "data": {"chat_id": channel, "text": text, "parse_mode": parse_mode, "disable_web_page_preview": disable_web_page_preview, "disable_notification": silent}}


def discord_message(webhook_id: str, webhook_token: str, content: str, username: str = "", avatar_url: str = "", url: str = DEFAULT_URLS["discord"]) -> dict:
    return {"url": f"{url}{webhook_id}/{webhook_token}", "data": {"username": username, "content": content, "avatar_url": avatar_url}}


def teams_message(url: str, title: str, text: str, summary: str = "") -> dict:
    return {"url": url, "data": {"@type": "MessageCard", "@context": "http://schema.org/extensions", "title": title, "text": text, "summary": summary or (text[: SUMMARY_CUTOFF - 3] + "..." if len(text) > SUMMARY_CUTOFF else text)}}


def pushbullet_message(token: str, title: str, text: str, url: str = DEFAULT_URLS["pushbullet"]) -> dict:
    return {"url": url, "headers": {"Access-Token": token, "Content-Type": "application/json"}, "data": {"type": "note", "title": title, "body": text}}


def victorops_message(url: str, message_type: str, entity_id: str = "", entity_display_name: str = "", state_message: str = "", timestamp: int = 0, monitoring_tool: str = "") -> dict:
    return {"url": url, "data": {"message_type": message_type, "entity_id": entity_id, "entity_display_name": entity_display_name, "monitoring_tool": monitoring_tool, "state_message": state_message, "state_start_time": timestamp}}


def alerta_message(url: str, api_key: str, resource: str, event: str, severity: str, environment: str = "", service: Sequence[str] = (), group: str = "", value: str = "", text: str = "", tags: Sequence[str] = (), attributes: dict | None = None, origin: str = "", type_: str = "") -> dict:
    return {"url": url, "headers": {"Authorization": f"Key {api_key}", "Content-Type": "application/json"}, "data": {"resource": resource, "event": event, "severity": severity, "environment": environment, "service": list(service), "group": group, "value": value, "text": text, "tags": list(tags), "attributes": attributes or {}, "origin": origin, "type": type_}}


def bigpanda_message(token: str, app_key: str, status: str, record: dict, url: str = DEFAULT_URLS["bigpanda"]) -> dict:
    return {"url": url, "headers": {"Authorization": f"{TOKEN_PREFIX} {token}", "Content-Type": "application/json"}, "data": {**record, "app_key": app_key, "status": status}}


def bigpanda_status(level: str) -> str:
    return {"crit": "critical", "warn": "warning", "info": "ok", "ok": "ok"}.get(level, "unknown")


def sensu_message(url: str, api_key: str, check: str, text: str, status: int = 0, state: str = "", entity: str = "events", namespace: str = "default", handlers: Sequence[str] = ()) -> dict:
    name = lambda x: __import__("re").sub(r"[^a-zA-Z0-9_.\-]", "_", x)
    data = {"entity": {"entity_class": "proxy", "metadata": {"name": name(entity)}}, "check": {"output": text, "state": state or ("passing" if status == 0 else "failing"), "status": status, "handlers": list(handlers), "interval": 60, "metadata": {"name": name(check)}}}
    return {"url": f"{url}/api/core/v2/namespaces/{namespace}/events", "headers": {"Content-Type": "application/json; charset=utf-8", "Authorization": f"Key {api_key}"}, "data": data}


def servicenow_message(url: str, username: str, password: str, node: str, metric_type: str, resource: str, metric_name: str, message_key: str, description: str, severity: str, source: str = "tidemill", additional_info: dict | None = None) -> dict:
    record = {"source": source, "node": node, "type": metric_type, "resource": resource, "metric_name": metric_name, "message_key": message_key, "description": description, "severity": {"crit": "1", "warn": "3", "info": "4", "ok": "5"}.get(severity, "0"), "additional_info": json.dumps(additional_info) if additional_info else None}
    return {"url": url, "headers": {"Authorization": basic_auth(username, password), "Content-Type": "application/json"}, "data": {"records": [record]}}


def webex_message(token: str, room_id: str, text: str, markdown: str = "", url: str = "https://webexapis.com") -> dict:
    return {"url": f"{url}/v1/messages", "headers": {"Authorization": f"Bearer {token}", "Content-Type": "application/json; charset=utf-8"}, "data": {"text": text, "markdown": markdown, "roomId": room_id}}


def zenoss_message(url: str, username: str, password: str, device: str, component: str, severity: str, event_class: str, event_class_key: str, summary: str = "", message: str = "", api_key: str = "", action: str = "EventsRouter", method: str = "add_event", type_: str = "rpc", tid: int = 1, collector: str = "") -> dict:
    event = {"device": device, "component": component, "severity": severity, "evclass": event_class, "evclasskey": event_class_key, "collector": collector, "summary": summary, "message": message}
    auth = {"z-api-key": api_key} if api_key else {"Authorization": basic_auth(username, password)}
    return {"url": url, "headers": {**auth, "Content-Type": "application/json"}, "data": {"action": action, "method": method, "data": [event], "type": type_, "tid": tid}}


# Requests and helpers of the services above


def request(method: str, url: str, params: dict | None = None, headers: dict | None = None, body: bytes = EMPTY_BODY, timeout: float | None = None) -> dict:
    """Any HTTP request: statusCode, body, headers and duration in nanoseconds."""
    import time as clock
    from urllib.parse import urlencode

    from ..plans.engine import get_option
    from .tables import fetch

    full = url + (("&" if "?" in url else "?") + urlencode(params, doseq=True) if params else "")
    began = clock.time()
    out = fetch(full, method, headers, body or None, timeout or get_option("timeout", 30.0))
    return out | {"duration": int((clock.time() - began) * 1e9)}


def get(url: str, **kw) -> dict:
    return request("GET", url, **kw)


def post(url: str, **kw) -> dict:
    return request("POST", url, **kw)


def peek(spark, response: dict) -> TableStream:
    """A response as a table of one row."""
    row = (response["statusCode"], response["body"].decode("utf-8", "replace"), json.dumps(response["headers"]), response.get("duration"))
    return TableStream(spark.createDataFrame([row], "statusCode int, body string, headers string, duration long"), (), ())


def validate_color(color: str) -> str:
    """A hex colour, or good, warning or danger."""
    import re

    if color not in ("good", "warning", "danger") and not re.fullmatch(r"#[0-9a-fA-F]{6}", color):
        raise ValueError("color must be hex or one of good, warning, danger")
    return color


def pagerduty_action_of_severity(severity: str) -> str:
    return "resolve" if severity == "ok" else "trigger"


def dedup_key_column(s: TableStream, exclude: Sequence[str] = ("_start", "_stop", "_level")) -> TableStream:
    """SHA-256 of each row's group key as ``_pagerdutyDedupKey``."""
    parts = [F.concat(F.lit(k + "\n"), F.coalesce(col(k).cast("string"), F.lit("")), F.lit("\n")) for k in sorted(s.key) if k not in exclude]
    return s.to(s.df.withColumn("_pagerdutyDedupKey", F.sha2(F.concat(*parts) if parts else F.lit(""), 256)))
