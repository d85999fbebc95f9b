"""Engine hooks: version, options, rule switches, profiles and debug operators."""

from __future__ import annotations

import time
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stream import TableStream

#: Options of the engine, by package and name.
options: dict[str, object] = {"location": "UTC", "profilers": (), "timeout": 30.0}
#: The range of times in nanoseconds that a 64-bit clock can tell (fixed values).
EPOCH = datetime(1970, 1, 1)
MIN_TIME, MAX_TIME = datetime(1677, 9, 21, 0, 12, 43, 145224), datetime(2262, 4, 11, 23, 47, 16, 854775)

TRUE, FALSE = True, False


def feature(spark: SparkSession, key: str) -> str | None:
    """A setting of the session by name; None if there is none."""
    try:
        return spark.conf.get(key)
    except Exception:  # unknown to Spark
        return None


def vectorize(s: TableStream, fn) -> TableStream:
    """``map``: all expressions run in generated code, over columns where the
    scan gives columns."""
    from ..operators.shape import extend

    return extend(s, fn)


def version() -> str:
    import pyspark

    return f"tidemill 0.1 on Spark {pyspark.__version__}"


def get_option(name: str, default=None):
    return options.get(name, default)


@contextmanager
def without_rules(spark: SparkSession, *rules: str):
    """Run without some optimizer rules, by their class names."""
    key = "spark.sql.optimizer.excludedRules"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ",".join(rules))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def profile(s: TableStream, kind: str = "query") -> DataFrame:
    """Run a stream to the end and report on it: ``query`` gives durations and
    rows, ``operator`` the physical plan's nodes."""
    spark, began = s.df.sparkSession, time.time()
    plan = s.df._jdf.queryExecution().executedPlan()
    planned = time.time()
    rows = s.df.agg(F.count(F.lit(1))).first()[0]
    if kind == "query":
        return spark.createDataFrame([(int((planned - began) * 1e9), int((time.time() - planned) * 1e9), rows)], "planDuration long, executeDuration long, rows long")
    nodes = [x.strip(" +-:*()0123456789") for x in plan.toString().splitlines() if x.strip()]
    return spark.createDataFrame([(i, n[:200]) for i, n in enumerate(nodes)], "position int, node string")


def passed(s: TableStream) -> TableStream:
    return s


opaque = passed


def slurp(s: TableStream) -> TableStream:
    """Materialise a stream before going on."""
    return s.to(s.df.persist())


def sink(s: TableStream) -> None:
    s.df.write.format("noop").mode("overwrite").save()


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)
