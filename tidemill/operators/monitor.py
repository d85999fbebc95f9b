"""Checks, state changes, deadman alerts and notifications on streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.duration import parse
from ..plans.stream import TIME, VALUE, Record, TableStream, clock, col, instant, time_lit
from . import selectors, shape

#: Levels a check can find, the first that is true counting (fixed values).
LEVELS = ("crit", "warn", "info", "ok", "unknown")
#: Where statuses go unless told, and the time of a task that never ran (fixed values).
BUCKET, ZERO_TIME = "_monitoring", datetime(1970, 1, 1)
OK, INFO, WARN, CRIT, UNKNOWN, ANY = "ok", "info", "warn", "crit", "unknown", "any"


def check(s: TableStream, message: Callable[[Record], Column], crit=None, warn=None, info=None, ok=None, data: dict | None = None) -> TableStream:
    """Level and message of every row; what no predicate takes is unknown.
    ``data``: _check_id, _check_name, _type and tags of the check."""
    r = s.r
    level = F.lit(UNKNOWN)
    for name, fn in (("ok", ok), ("info", info), ("warn", warn), ("crit", crit)):
        if fn is not None:
            level = F.when(fn(r), F.lit(name)).otherwise(level)
    df = s.df.withColumn("_level", level)
    named = {("_" + k if k in ("check_id", "check_name", "type") else k): F.lit(v) for k, v in (data or {}).items()}
    df = df.withColumns(named | {"_source_measurement": r["_measurement"].cast("string"), "_source_timestamp": F.unix_micros(col(TIME)) * 1000})
    df = df.withColumn("_message", message(Record(df.columns)))
    key = tuple(dict.fromkeys((*s.key, *named, "_level", "_source_measurement")))
    return s.to(df, key=key)


def state_changes(s: TableStream, from_level: str = ANY, to_level: str = ANY) -> TableStream:
    """Rows whose level differs from the row before, from one level to another;
    ``_level`` may be left out of the key for it."""
    if from_level == to_level != ANY:
        return s.to(s.df.limit(0))
    flat = s.to(key=tuple(k for k in s.key if k not in ("_level", "_time")), order=("_source_timestamp",) if "_source_timestamp" in s.columns else (TIME,))
    prior = F.lag("_level").over(flat.rows())
    df = flat.df.withColumn("__p", prior)
    moved = F.col("__p").isNotNull() & (F.col("__p") != F.col("_level"))
    if from_level != ANY:
        moved &= F.col("__p") == from_level
    if to_level != ANY:
        moved &= F.col("_level") == to_level
    return flat.to(df.where(moved).drop("__p"))


def state_changes_only(s: TableStream) -> TableStream:
    return state_changes(s)


def deadman(s: TableStream, t) -> TableStream:
    """Last row of each table, and whether it is older than ``t``."""
    last = selectors.last(s, TIME)
    return last.to(last.df.withColumn("dead", col(TIME) < time_lit(instant(t))))


def notify(s: TableStream, endpoint: Callable[[TableStream], TableStream], data: dict | None = None) -> TableStream:
    """Send statuses through an endpoint; adds the rule's columns and _sent."""
    df = s.df.withColumns({"_" + k: F.lit(v) for k, v in (data or {}).items()} | {"_status_timestamp": F.unix_micros(col(TIME)) * 1000, TIME: time_lit(clock.now())})
    return endpoint(s.to(df))


def log(s: TableStream, path: str) -> TableStream:
    """Append statuses or notifications to a table."""
    s.df.write.mode("append").parquet(path)
    return s


def from_log(spark, path: str, start, stop=None, fn: Callable[[Record], Column] | None = None) -> TableStream:
    """Statuses of a time range, as logged."""
    from ..sources.tables import bucket

    s = shape.range(bucket(spark, path, key=()), start, stop)
    return shape.filter(s, fn) if fn else s


def task_last_success(runs: TableStream, or_time) -> "object":
    """Time of the last successful run, or a default (a duration or time)."""
    row = runs.df.where(col("status") == "success").agg(F.max(col(TIME))).first()
    return row[0] if row and row[0] is not None else instant(or_time)


def alert(s: TableStream, check_fn: Callable[[Record], Column], id_: Callable[[Record], Column] | None = None, message=None, details=None, level=None) -> TableStream:
    """Alert-style check: level (``ok`` unless the predicate holds), id, message."""
    r = s.r
    level_c = level(r) if level else F.when(check_fn(r), "crit").otherwise("ok")
    df = s.df.withColumns({"level": level_c, "id": id_(r) if id_ else F.concat_ws(":", *map(col, s.key)) if s.key else F.lit("")})
    m = message(Record(df.columns)) if message else F.concat(col("id"), F.lit(" is "), col("level"))
    return s.to(df.withColumns({"message": m, "details": details(r) if details else F.lit("")}))


def state_changes_only_alert(s: TableStream) -> TableStream:
    return state_changes(s.to(s.df.withColumn("_level", col("level"))))


def anomaly_mad(s: TableStream, threshold: float = 3.0, column: str = VALUE) -> TableStream:
    """Distance of each series from the median at its time, in median distances,
    and whether that is an anomaly. Times whose median distance is 0 are left out."""
    mid = s.df.groupBy(col(TIME)).agg(F.percentile(col(column), F.lit(0.5)).alias("__med"))
    away = s.df.join(mid, TIME).withColumn("__dist", F.abs(col(column) - F.col("__med")))
    typical = away.groupBy(col(TIME)).agg(F.percentile("__dist", F.lit(0.5)).alias("__typical")).where("__typical > 0")
    out = away.join(typical, TIME).withColumns({column: F.col("__dist") / F.col("__typical"), "MAD": F.col("__typical") * 1.4826})
    out = out.withColumn("level", F.when(col(column) >= threshold, "anomaly").otherwise("normal"))
    return s.to(out.drop("__med", "__dist", "__typical"), key=(TIME,), empty=None)


def naive_bayes(s: TableStream, class_column: str, feature: str, train: Column) -> TableStream:
    """Class probabilities of one categorical feature, learned from the rows
    where ``train`` holds, for the distinct feature values of the rest."""
    taught, rest = s.df.where(train), s.df.where(~train)
    total = taught.count()
    by_class = taught.groupBy(class_column).agg(F.count("*").alias("__nc"))
    both = taught.groupBy(class_column, feature).agg(F.count("*").alias("__n"))
    by_feature = taught.groupBy(feature).agg(F.count("*").alias("__nf"))
    p = both.join(by_class, class_column).join(by_feature, feature)
    p = p.withColumn("probability", F.col("__n") / F.col("__nc") * F.col("__nc") / total / (F.col("__nf") / total))
    return s.to(rest.select(feature).distinct().join(p.select(class_column, feature, "probability"), feature), key=(), order=())


def kpi_ratio(s: TableStream, good: Callable[[Record], Column]) -> TableStream:
    """Share of rows of each table for which a predicate holds."""
    out = s.df.groupBy(*map(col, s.key)).agg(F.avg(F.when(good(s.r), 1.0).otherwise(0.0)).alias(VALUE))
    return s.to(out, order=(), empty=None)


def window_align(t, every) -> Column:
    from .windows import floor_time

    return floor_time(t, parse(every))
