"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one
JSON line. Each query runs to a sink that takes all rows; best of two runs."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).parent}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = [
    "flagship_downsample",
    "filter",
    "sum",
    "group_by",
    "quantile_exact_mean",
    "histogram",
    "aggregate_window_sum",
    "window_sliding",
    "pivot",
    "top",
    "last",
    "difference",
    "derivative",
    "cumulative_sum",
    "state_duration",
    "exponential_moving_average",
    "join_inner",
    "window_months",
    "monitor_state_changes",
]


def at_scale(spark, points: int) -> dict:
    """Generated series (100,000 of them, in 100 groups, a point every ten seconds):
    range, filter and sum per series or group, at a size where time grows with
    rows. Seconds and million points a second, generation included."""
    from pyspark.sql import functions as F

    from tidemill.operators import aggregates, shape, windows
    from tidemill.plans.stream import TIME, VALUE, table

    series = 100_000
    n = F.floor(F.col("id") / series)
    df = spark.range(points).select((F.col("id") % series).alias("series"), (F.col("id") % 100).alias("tag"), F.timestamp_seconds(n * 10 + 1704067200).alias(TIME), ((F.col("id") * 7919) % 1000 / 10.0 - 20).alias(VALUE))
    s = table(df, ("series",))
    seconds = points // series * 10
    half = shape.range(s, "2024-01-01T00:00:00Z", time_text(1704067200 + seconds // 2))
    runs = {
        "sum_per_series_half_range": aggregates.sum(shape.filter(half, lambda r: r["_value"] > 0)),
        "sum_per_series": aggregates.sum(s),
        "sum_by_tag": aggregates.sum(shape.group(s, ["tag"])),
        "hourly_mean_by_tag": windows.aggregate_window(shape.group(s, ["tag"]), "1h", "mean", create_empty=False),
    }
    out = {"points": points}
    for name, stream in runs.items():
        began = time.time()
        stream.df.write.format("noop").mode("overwrite").save()
        took = time.time() - began
        out[name] = {"sec": round(took, 3), "million_points_per_sec": round(points / took / 1e6, 1)}
    return out


def time_text(epoch: int) -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(epoch))


def main() -> None:
    from pyspark.sql import SparkSession

    from tidemill import queries, queries_more  # noqa: F401

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.time()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        took[name] = round(best, 3)
    points = int(os.environ.get("BENCH_POINTS", "100000000"))
    scale = at_scale(spark, points) if points else {}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "scale": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
