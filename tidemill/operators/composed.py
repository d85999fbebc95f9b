"""Analytics composed of other operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans.duration import parse
from ..plans.stream import STOP, TIME, VALUE, Record, TableStream, clock, col, time_lit
from . import aggregates, joins, monitor, sequences, shape, windows


def linear_fit(s: TableStream) -> TableStream:
    """Least squares of each table's values (renamed y) on the row number x:
    adds x, the sums, slope, y_hat and the squared errors."""
    df = s.df.withColumnRenamed(VALUE, "y").withColumn("x", F.row_number().over(s.rows()).cast("double"))
    w = Window.partitionBy(*map(col, s.key))
    y = col("y").cast("double")
    df = df.withColumns({"N": F.count(y).over(w).cast("double"), "sx": F.sum("x").over(w), "sy": F.sum(y).over(w), "sxy": F.sum(F.col("x") * y).over(w), "sxx": F.sum(F.col("x") * F.col("x")).over(w)})
    df = df.withColumn("slope", (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("N")) / F.nullif(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("N"), F.lit(0.0)))
    df = df.withColumn("y_hat", F.col("slope") * (F.col("x") - F.col("sx") / F.col("N")) + F.col("sy") / F.col("N"))
    return s.to(df.withColumn("errors", F.pow(y - F.col("y_hat"), F.lit(2.0))))


def compute_apq(production: TableStream, parts: TableStream, running_state: str, planned_time, ideal_cycle_time) -> TableStream:
    """Availability, performance, quality and their product: time in the running
    state over planned time, parts made against the ideal cycle, good parts."""
    planned, cycle = parse(planned_time).micros * 1000.0, parse(ideal_cycle_time).micros * 1000.0
    ran = shape.filter(sequences.event_duration(production, "1ns", "runTime"), lambda r: r["state"] == running_state)
    ran = aggregates.aggregate(ran, runTime=F.sum("runTime"))
    made = aggregates.sum(sequences.difference(parts, ["partCount"], non_negative=True), "partCount")
    bad = aggregates.sum(sequences.difference(parts, ["badCount"], non_negative=True), "badCount")
    keys = [k for k in ran.key if k in made.key]
    df = ran.df.join(made.df, keys).join(bad.df, keys) if keys else ran.df.crossJoin(made.df).crossJoin(bad.df)  # one row each
    df = df.withColumns({"availability": F.col("runTime") / planned, "performance": F.col("partCount") * cycle / F.col("runTime"), "quality": (F.col("partCount") - F.col("badCount")) / F.col("partCount")})
    df = df.withColumn("oee", F.col("availability") * F.col("performance") * F.col("quality"))
    return production.to(df.withColumn(TIME, col(STOP)) if STOP in df.columns else df, empty=None)


def apq(s: TableStream, running_state: str, planned_time, ideal_cycle_time) -> TableStream:
    return compute_apq(s, s, running_state, planned_time, ideal_cycle_time)


def select(s: TableStream, as_: str, column: str = VALUE, fn: Callable[..., TableStream] | None = None) -> TableStream:
    """A column (through an aggregate, if given) under another name."""
    out = fn(s, column) if fn else s
    return shape.rename(out, {column: as_})


compute = select


def select_window(s: TableStream, as_: str, fn, every, default, column: str = VALUE) -> TableStream:
    """Windowed aggregate with a default for empty windows, renamed."""
    return shape.rename(shape.fill(windows.aggregate_window(s, every, fn, column), column, default), {column: as_})


def group_by(s: TableStream, columns=()) -> TableStream:
    """Group by columns and always by measurement."""
    return shape.group(s, dict.fromkeys(["_measurement", *columns]))


def join_streams(sides: dict[str, TableStream], on=("_time",), measurement: str = "") -> TableStream:
    """Two streams joined on columns under one measurement name."""
    return shape.group(shape.set(joins.join(sides, list(on)), "_measurement", measurement), ["_measurement"], "extend")


def define_check(id_: str, name: str, kind: str = "custom") -> dict:
    return {"check_id": id_, "check_name": name, "type": kind, "tags": {}}


def alert(s: TableStream, check: dict, id_: Callable[[Record], Column] | None = None, details: Callable[[Record], Column] | None = None, message: Callable[[Record], Column] | None = None, crit=None, warn=None, info=None, ok=None, topic: str = "") -> TableStream:
    """A check's levels with id, details, topic and message."""
    data = {k: v for k, v in check.items() if k != "tags"} | {**check.get("tags", {})}
    never = lambda r: F.lit(False)
    default = message or (lambda r: F.concat(F.lit(f"{check['check_name']} is: "), r["_level"]))
    out = monitor.check(s, default, crit or never, warn or never, info or never, ok or (lambda r: F.lit(True)), data)
    r = out.r
    return shape.set(out, id=id_(r) if id_ else F.lit(check["check_id"]), details=details(r) if details else F.lit(""), _topic=topic)


def dead_or_alive(s: TableStream, check: dict, measurement: str, threshold: int = 0, **kw) -> TableStream:
    """A no-data check that also reports streams without any row: dead if a
    measurement has at most ``threshold`` rows."""
    one = s.df.sparkSession.range(1).select(F.lit(measurement).alias("_measurement"))
    rows = s.df.where(col("_measurement") == measurement).groupBy("_measurement").agg(F.count("*").alias("__n"))
    df = one.join(rows, "_measurement", "left").select("_measurement", time_lit(clock.now()).alias(TIME), (F.coalesce("__n", F.lit(0)) <= threshold).alias("dead"))
    text = kw.pop("message", lambda r: F.concat(F.lit(f"Deadman Check: {check['check_name']} is: "), F.when(r["dead"], "dead").otherwise("alive")))
    return alert(TableStream(df, ("_measurement",)), check, message=text, crit=lambda r: r["dead"], **kw)
