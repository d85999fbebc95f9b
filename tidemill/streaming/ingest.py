"""Structured Streaming: line protocol in, windowed aggregates with watermarks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.windows import floor_time, window_starts
from ..plans.duration import Duration, parse
from ..plans.stream import START, STOP, TIME, VALUE, TableStream, col


def decode_lines(df: DataFrame, column: str = "value", decoder: str = "line") -> DataFrame:
    """Lines as rows. ``line``: measurement, tags (a map), field, value, time;
    ``csv``: an array of cells."""
    text = F.col(column)
    if decoder == "csv":
        return df.select(F.split(text, ",").alias("cells"))
    head = F.regexp_extract(text, r"^((?:[^ \\]|\\.)+) ", 1)
    body = F.regexp_extract(text, r"^(?:[^ \\]|\\.)+ (.*?)(?: (-?\d+))?$", 1)
    ns = F.regexp_extract(text, r" (-?\d+)$", 1)
    parts = F.split(head, r"(?<!\\),")
    pair = lambda x: F.struct(F.regexp_extract(x, r"^((?:[^=\\]|\\.)+)=", 1).alias("k"), F.regexp_replace(F.regexp_extract(x, r"^(?:[^=\\]|\\.)+=(.*)$", 1), r"\\([,= ])", "$1").alias("v"))
    tags = F.map_from_entries(F.transform(F.slice(parts, 2, F.size(parts)), pair))
    fields = F.transform(F.split(body, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), pair)
    out = df.where(text != "").select(F.regexp_replace(parts[0], r"\\([, ])", "$1").alias("_measurement"), tags.alias("tags"), F.explode(fields).alias("__f"), F.timestamp_micros((F.nullif(ns, F.lit("")).cast("long") / 1000).cast("long")).alias(TIME))
    number = F.regexp_replace(F.col("__f.v"), r"[iu]$", "").try_cast("double")
    return out.select(TIME, "_measurement", "tags", F.col("__f.k").alias("_field"), number.alias(VALUE), F.col("__f.v").alias("_text"))


def windowed(s: TableStream, every, aggregates: dict[str, Column], lateness="10m", period=None) -> TableStream:
    """A streaming (or batch) windowed aggregate: rows later than ``lateness``
    behind the newest are dropped, and windows close when it passes them."""
    d, p = parse(every), parse(period if period is not None else every)
    df = s.df.withWatermark(TIME, f"{parse(lateness).micros // 1000} milliseconds") if s.df.isStreaming else s.df
    if d.months or p.months:
        # calendar windows have no fixed length: the watermark bounds late rows,
        # the window's start is a key
        begun = df.withColumn(START, floor_time(col(TIME), d) if p == d else F.explode(window_starts(col(TIME), d, p, Duration())))
        out = begun.groupBy(*map(col, s.key), col(START)).agg(*(c.alias(n) for n, c in aggregates.items()))
        end = p.added_to(col(START))
        return s.to(out.select(*map(col, s.key), col(START), end.alias(STOP), end.alias(TIME), *aggregates), key=(*s.key, START, STOP), order=(TIME,), empty=None)
    w = F.window(col(TIME), f"{p.micros} microseconds", f"{d.micros} microseconds")
    out = df.groupBy(*map(col, s.key), w.alias("__w")).agg(*(c.alias(n) for n, c in aggregates.items()))
    out = out.select(*map(col, s.key), F.col("__w.start").alias(START), F.col("__w.end").alias(STOP), F.col("__w.end").alias(TIME), *aggregates)
    return s.to(out, key=(*s.key, START, STOP), order=(TIME,), empty=None)


def last_seen(s: TableStream, timeout="10m") -> DataFrame:
    """A stateful stream of the newest row of each key, for deadman checks."""
    df = s.df.withWatermark(TIME, f"{parse(timeout).micros // 1000} milliseconds") if s.df.isStreaming else s.df
    return df.groupBy(*map(col, s.key)).agg(F.max(col(TIME)).alias(TIME), F.max_by(col(VALUE), col(TIME)).alias(VALUE))


def dedup(s: TableStream, columns, lateness="10m") -> TableStream:
    """Drop repeated rows, within the watermark on a stream."""
    df = s.df.withWatermark(TIME, f"{parse(lateness).micros // 1000} milliseconds") if s.df.isStreaming else s.df
    return s.to(df.dropDuplicatesWithinWatermark(list(columns)) if s.df.isStreaming else df.dropDuplicates(list(columns)))


def level_changes(s: TableStream, level) -> TableStream:
    """Rows whose level differs from their key's row before, across batches: the
    state of a key is its last level. Within a batch rows go in time order."""
    schema = T.StructType([*s.df.schema.fields, T.StructField("_level", T.StringType())])
    order = [o for o in s.order if isinstance(o, str)] or [TIME]

    def run(key, parts, state):
        rows = pd.concat(list(parts)).sort_values(order)
        before = state.get[0] if state.exists else None
        prior = rows["_level"].shift(1)
        prior.iloc[0] = before
        state.update((rows["_level"].iloc[-1],))
        yield rows[prior.notna() & (prior != rows["_level"])]

    leveled = s.df.withColumn("_level", level(s.r))
    out = leveled.groupBy(*map(col, s.key)).applyInPandasWithState(run, schema, "level string", "append", "NoTimeout")
    return s.to(out, empty=None)


class Trigger:
    """When a table's result is given: after a processing time, a number of rows
    or a watermark; once, or ``repeated``; or at the latest when another fires."""

    def __init__(self, fires, again: bool = False, kind: str = "", value=None):
        self._fires, self._again, self.kind, self.value = fires, again, kind, value

    @staticmethod
    def after(duration) -> Trigger:
        """So long after the first row, by the processing clock."""
        seconds = parse(duration).micros / 1e6
        return Trigger(lambda t: t["now"] - t["first"] >= seconds, kind="processing_time", value=seconds)

    @staticmethod
    def at_least(n: int) -> Trigger:
        return Trigger(lambda t: t["rows"] >= n, kind="rows", value=n)

    @staticmethod
    def watermark(at) -> Trigger:
        return Trigger(lambda t: t["watermark"] >= at, kind="watermark", value=at)

    @staticmethod
    def once() -> Trigger:
        """All there is, then the end."""
        return Trigger(lambda t: True, kind="once")

    def repeated(self) -> Trigger:
        return Trigger(self._fires, True, self.kind, self.value)

    def or_finally(self, last: Trigger) -> Trigger:
        return Trigger(lambda t: self._fires(t) or last._fires(t), self._again, self.kind, self.value)

    def fired(self, state: dict, now: float, rows: int, watermark) -> bool:
        """Take in what arrived; ``state`` is one table's, and empty at first."""
        if not state:
            state |= {"first": now, "rows": 0}
        state |= {"now": now, "rows": state["rows"] + rows, "watermark": watermark}
        out = self._fires(state)
        if out and self._again:
            state.clear()
        return out

    def option(self) -> dict:
        """As Spark's own trigger, where it has one."""
        if self.kind == "processing_time":
            return {"processingTime": f"{self.value:g} seconds"}
        return {"availableNow": True} if self.kind == "once" else {}


def simulate(trigger: Trigger, arrivals) -> list[bool]:
    """Whether the trigger fires at each arrival (time, rows, watermark)."""
    state: dict = {}
    return [trigger.fired(state, *a) for a in arrivals]


def narrow(trigger: Trigger, arrivals) -> dict[str, bool]:
    """The trigger for each table by itself: arrivals (key, time, rows, watermark)."""
    states, out = {}, {}
    for key, *a in arrivals:
        out[key] = trigger.fired(states.setdefault(key, {}), *a) or out.get(key, False)
    return out


@dataclass
class Task:
    """A query that runs every so often: ``next_run`` after a time, and ``run``,
    whose record says how it went."""

    name: str
    query: Callable[[], object]
    every: str
    offset: str = "0s"

    def next_run(self, after: datetime) -> datetime:
        step, shift = parse(self.every).micros, parse(self.offset).micros
        us = round((after - datetime(1970, 1, 1)).total_seconds() * 1e6)
        return datetime(1970, 1, 1) + timedelta(microseconds=(us - shift) // step * step + step + shift)

    def run(self, at: datetime) -> dict:
        try:
            return {TIME: at, "name": self.name, "status": "success", "result": self.query()}
        except Exception as e:
            return {TIME: at, "name": self.name, "status": "failed", "result": str(e)}


def write(s: TableStream, name: str, mode: str = "append", checkpoint: str | None = None, trigger: Trigger | None = None, **options):
    """Start the stream into a named in-memory table (tests) or a format."""
    writer = s.df.writeStream.outputMode(mode).queryName(name).format(options.pop("format", "memory"))
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    writer = writer.trigger(**trigger.option()) if trigger and trigger.option() else writer
    return writer.options(**options).start()
