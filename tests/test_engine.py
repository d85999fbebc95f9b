"""Semantics of the stream operators on small literal tables."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.functions import cells, geo, maths
from tidemill.functions.bits import city64
from tidemill.operators import aggregates, extract, joins, monitor, selectors, sequences, sets, shape, windows
from tidemill.plans.duration import Duration, parse
from tidemill.plans.stream import table
from tidemill.sources import sinks, tables


def at(n):
    return datetime(2024, 1, 1, 0, 0, n)


@pytest.fixture(scope="module")
def s(spark):
    rows = [(at(0), "a", 1.0), (at(10), "a", None), (at(20), "a", 4.0), (at(30), "a", 2.0), (at(0), "b", None), (at(20), "b", 7.0)]
    return table(spark.createDataFrame(rows, "_time timestamp, tag string, _value double"), ("tag",))


def values(stream, column="_value"):
    return [r[column] for r in stream.df.orderBy("tag", "_time").collect()]


def by_tag(stream, column="_value"):
    return {r["tag"]: r[column] for r in stream.df.collect()}


def test_duration():
    assert parse("1y2mo3w") == Duration(14, 21 * 86400 * 10**6)
    assert parse("-90m").micros == -5400 * 10**6
    assert parse("1mo").after(datetime(2024, 1, 31)) == datetime(2024, 2, 29)
    assert parse("1d12h").text() == "1d12h"
    with pytest.raises(ValueError):
        parse("5 apples")


def test_null_rules(s):
    assert by_tag(aggregates.count(s)) == {"a": 4, "b": 2}
    assert by_tag(aggregates.sum(s)) == {"a": 7.0, "b": 7.0}
    assert by_tag(selectors.first(s)) == {"a": 1.0, "b": 7.0}
    assert math.isnan(by_tag(aggregates.stddev(s))["b"]) and math.isnan(by_tag(aggregates.skew(s))["b"])
    assert values(selectors.limit(selectors.sort(s, ["_value"], desc=True), 1)) == [None, None]


def test_sequences(s):
    assert values(sequences.difference(s)) == [None, 3.0, -2.0, None]
    assert values(sequences.difference(s, non_negative=True, initial_zero=True)) == [None, 3.0, 2.0, None]
    assert values(sequences.difference(s, keep_first=True, initial_zero=True)) == [0.0, None, 3.0, -2.0, None, 0.0]
    assert values(sequences.derivative(s, "10s")) == [None, 1.5, -2.0, None]
    assert values(sequences.cumulative_sum(s)) == [1.0, 1.0, 5.0, 7.0, 0.0, 7.0]
    assert values(sequences.elapsed(s, "1s"), "elapsed") == [10, 10, 10, 20]
    assert values(sequences.moving_average(s, 3)) == [2.5, 3.0, 7.0]
    assert values(sequences.state_count(s, lambda r: r["_value"] > 1), "stateCount") == [-1, -1, 1, 2, -1, 1]
    assert values(shape.fill(s, use_previous=True)) == [1.0, 1.0, 4.0, 2.0, None, 7.0]


def test_exponential_averages(spark):
    rows = [(at(i), "a", float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 10, 15])]
    s = table(spark.createDataFrame(rows, "_time timestamp, tag string, _value double"), ("tag",))
    assert values(sequences.exponential_moving_average(s, 3)) == pytest.approx([2, 3, 4, 7, 11])
    e = [2, 3, 4, 7, 11]
    ee = [3, 5, 8]
    assert values(sequences.double_ema(s, 3)) == pytest.approx([2 * x - y for x, y in zip(e[2:], ee)])
    assert len(values(sequences.triple_ema(s, 3))) == 1
    assert values(sequences.kaufmans_er(s, 3)) == [1.0] * 4
    assert len(values(sequences.kaufmans_ama(s, 3))) == 4
    out = values(sequences.relative_strength_index(s, 3))
    assert out == [100.0] * 4


def test_mode_and_quantile(spark):
    rows = [(at(i), t, v) for i, (t, v) in enumerate([("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0)])]
    s = table(spark.createDataFrame(rows, "_time timestamp, tag string, _value double"), ("tag",))
    assert by_tag(aggregates.mode(s)) == {"a": 1.0, "b": None}
    assert by_tag(aggregates.quantile(s, 0.5, method="exact_selector")) == {"a": 1.0, "b": 1.0}
    assert by_tag(aggregates.quantile(s, 0.5, method="exact_mean")) == {"a": 1.0, "b": 1.5}


def test_histogram_errors(s):
    with pytest.raises(Exception, match="greater than any bin"):
        aggregates.histogram(s, [1.0, 2.0]).df.collect()


def test_windows_and_empty(s):
    r = shape.range(s, "2024-01-01T00:00:00Z", "2024-01-01T00:00:40Z")
    out = windows.aggregate_window(r, "10s", "count")
    assert [x["_value"] for x in out.df.orderBy("tag", "_time").collect()] == [1, 1, 1, 1, 1, 0, 1, 0]
    kept = shape.filter(s, lambda r: r["_value"] > 5, on_empty="keep")
    assert by_tag(aggregates.count(kept)) == {"a": 0, "b": 1}
    months = windows.floor_time(F.lit("2024-03-31 10:00:00").cast("timestamp"), parse("2mo"))
    assert s.df.select(months).first()[0] == datetime(2024, 3, 1)


def test_pivot_unpivot(s):
    wide = shape.pivot(shape.ungroup(s), ["_time"], ["tag"])
    row = wide.df.where(F.col("_time") == "2024-01-01 00:00:20").first()
    assert (row["a"], row["b"]) == (4.0, 7.0)
    assert shape.unpivot(wide).df.count() == 4


def test_joins(s):
    other = shape.rename(shape.keep(s, ["_time", "tag", "_value"]), {"_value": "v2"})
    full = joins.full(s, shape.filter(other, lambda r: r["tag"] == "a"), lambda l, r: l["_time"] == r["_time"], lambda l, r: {"tag": l["tag"], "v": l["_value"], "w": r["v2"]})
    assert full.df.count() == 6
    with pytest.raises(ValueError):
        joins.inner(s, other, lambda l, r: l["_time"] == r["_time"], lambda l, r: {"v": l["_value"]})


def test_sets_and_extract(s):
    assert sets.diff(s, s).df.count() == 0
    sets.assert_equals("same", s, s)
    assert extract.find_column(s, lambda k: k.tag == "b", "_value") == [None, 7.0]
    assert extract.find_record(s, lambda k: k.tag == "x", 0) == {}
    assert extract.catch(lambda: extract.die("no"))["msg"] == "no"
    with pytest.raises(TypeError):
        sets.union(s, s.to(s.df.withColumn("_value", F.lit("x"))))


def test_monitor(s):
    checked = monitor.check(s, lambda r: r["_level"], crit=lambda r: r["_value"] > 3, ok=lambda r: r["_value"] <= 3)
    assert sorted(r["_level"] for r in checked.df.collect()) == ["crit", "crit", "ok", "ok", "unknown", "unknown"]
    assert monitor.state_changes(checked, "unknown", "crit").df.count() == 2


def test_annotated_csv(spark):
    text = "#datatype,string,long,dateTime:RFC3339,double,string\n#group,false,false,false,false,true\n#default,_result,,,,\n,result,table,_time,_value,host\n,,0,2024-01-01T00:00:00Z,1.5,a\n,,0,2024-01-01T00:00:10Z,,a\n"
    s = tables.from_csv(spark, text)
    assert s.key == ("host",) and [r["_value"] for r in s.df.orderBy("_time").collect()] == [1.5, None]


def test_line_protocol_round_trip(spark):
    from tidemill.streaming.ingest import decode_lines

    s = table(spark.createDataFrame([(at(1), "h 1", 2.5)], "_time timestamp, host string, v double"))
    line = s.df.select(sinks.line_protocol(s, F.lit("m"), ["host"], {"v": F.col("v")}).alias("value"))
    assert line.first()[0] == "m,host=h\\ 1 v=2.5 1704067201000000000"
    row = decode_lines(line).first()
    assert (row["_measurement"], row["tags"], row["_field"], row["_value"], row["_time"]) == ("m", {"host": "h 1"}, "v", 2.5, at(1))


def test_metrics_page(spark):
    rows = tables.scrape(spark, text='# HELP x y\nx{a="1",b="q\\"r"} 3\nup 1 1704067200000\n').df.collect()
    assert {(r["_field"], r["a"], r["_value"]) for r in rows} == {("x", "1", 3.0), ("up", None, 1.0)}


def test_cells():
    import numpy as np

    ids = cells.cell_id(np.array([40.7128, -33.86]), np.array([-74.006, 151.2]), 30)
    for i, (lat, lon) in zip(ids.tolist(), ((40.7128, -74.006), (-33.86, 151.2))):
        got = cells.centre(i)
        assert got == pytest.approx((lat, lon), abs=1e-6)
        assert cells.level_of(cells.parent(i, 10)) == 10
    grid = geo.get_grid({"lat": 40.7, "lon": -74.0, "radius": 20.0}, min_size=5)
    assert len(grid["set"]) >= 5


def test_special_functions(spark):
    x = spark.createDataFrame([(0.5,)], "x double")
    row = x.select(maths.erf(F.col("x")), maths.erfinv(F.col("x")), maths.j0(F.col("x")), maths.y0(F.col("x")), maths.gamma(F.col("x"))).first()
    assert list(row) == pytest.approx([math.erf(0.5), 0.476936276, 0.938469807, -0.444518733, math.sqrt(math.pi)], abs=1e-6)
    assert city64(b"") == 0x9AE16A3B2F90404F


def test_streaming_window(spark, tmp_path):
    from tidemill.streaming import ingest

    spark.createDataFrame([(at(i), "a", float(i)) for i in range(0, 60, 10)], "_time timestamp, tag string, _value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("_time timestamp, tag string, _value double").parquet(str(tmp_path / "in"))
    out = ingest.windowed(table(stream, ("tag",)), "30s", {"n": F.count("*"), "total": F.sum("_value")}, lateness="1s")
    q = ingest.write(out, "win_out", "complete", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n"], r["total"]) for r in spark.table("win_out").collect()) == [(3, 30.0), (3, 120.0)]


def test_box_distance_against_sampled_edges(spark):
    import random

    import numpy as np

    r = random.Random(3)
    boxes = [(10, 60, 0, 50), (-20, 30, 170, -160), (-80, -40, -30, 100), (5, 6, 5, 6)]
    for low, high, west, east in boxes:
        box = {"minLat": low, "maxLat": high, "minLon": west, "maxLon": east}
        points = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(40)]
        df = spark.createDataFrame(points, "lat double, lon double")
        out = [x[0] for x in df.select(geo.st_distance(box, {"lat": F.col("lat"), "lon": F.col("lon")}, "km")).collect()]
        width = (east - west) % 360
        t = np.linspace(0, 1, 2001)
        edge = np.concatenate([np.stack([low + (high - low) * t, np.full_like(t, x)], 1) for x in (west, east)] + [np.stack([np.full_like(t, y), west + width * t], 1) for y in (low, high)])
        for (lat, lon), got in zip(points, out):
            inside = low <= lat <= high and (lon - west) % 360 <= width
            a, b, c, d = np.radians(lat), np.radians(lon), np.radians(edge[:, 0]), np.radians(edge[:, 1])
            h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
            want = 0.0 if inside else float((2 * 6371.01 * np.arcsin(np.sqrt(np.minimum(h, 1)))).min())
            assert got == pytest.approx(want, abs=3.0)
            assert geo._angle(box, lat, lon, "km") * 6371.01 == pytest.approx(got, abs=1e-6)


def test_quantile_estimate_interpolates(spark):
    s = table(spark.createDataFrame([(at(i), "a", v) for i, v in enumerate([1.0, 2.0, 2.0, 2.0, 10.0])], "_time timestamp, tag string, _value double"), ("tag",))
    got = {q: by_tag(aggregates.quantile(s, q))["a"] for q in (0.0, 0.1, 0.2, 0.25, 0.5, 0.75, 0.85, 1.0)}
    # the i-th of n values stands at (i - 0.5) / n
    assert got == pytest.approx({0.0: 1.0, 0.1: 1.0, 0.2: 1.5, 0.25: 1.75, 0.5: 2.0, 0.75: 4.0, 0.85: 8.0, 1.0: 10.0})
    assert by_tag(aggregates.median(table(s.df.limit(2), ("tag",))))["a"] == 1.5
    many = table(spark.range(100_000).selectExpr("CAST(id * 7919 % 100000 AS DOUBLE) AS _value"))
    assert aggregates.quantile(many, 0.9).df.first()[0] == pytest.approx(90_000, rel=0.01)


def test_forecasts(spark):
    from tidemill.functions.forecast import digital_line, fit_and_forecast

    assert fit_and_forecast([1.0], 3) == ([], []) and fit_and_forecast([1.0, 2.0], 3, 4) == ([], [])
    _, future = fit_and_forecast([10.0 + 2 * i for i in range(20)], 3)
    assert future == pytest.approx([50, 52, 54], abs=0.5)
    wave = [10 + 3 * math.sin(i * math.pi / 2) + 0.1 * i for i in range(32)]
    _, future = fit_and_forecast(wave, 4, 4)
    assert future == pytest.approx([10 + 3 * math.sin(i * math.pi / 2) + 0.1 * i for i in range(32, 36)], abs=1.0)
    assert digital_line([0.0, 1e9, 2e9], [0.0, 5.0, 0.0]) == [0, 1, 2]
    assert digital_line([0.0, 1e9, 2e9], [0.0, 0.0, 0.0]) == [0, 2]


def test_nulls_in_recursions(spark):
    rows = [(at(i), "a", v) for i, v in enumerate([1.0, None, 3.0, 5.0, None, 9.0])]
    s = table(spark.createDataFrame(rows, "_time timestamp, tag string, _value double"), ("tag",))
    assert values(sequences.exponential_moving_average(s, 3)) == pytest.approx([2.0, 3.5, 3.5, 6.25])
    assert values(sequences.exponential_moving_average(s, 9)) == pytest.approx([4.5])


def test_calendar_windows_without_rows(s):
    r = shape.range(s, "2023-11-15T00:00:00Z", "2024-02-10T00:00:00Z")
    out = windows.aggregate_window(r, "1mo", "count")
    assert sorted((x["tag"], x["_time"].month, x["_value"]) for x in out.df.collect()) == sorted([(t, m, n if m == 2 and i == 2 else 0) for t, n in (("a", 4), ("b", 2)) for i, m in enumerate((12, 1, 2, 2))])


def bessel_column(spark, fn, want):
    """``fn`` at 1, 100 and values without a plain answer, and over many rows in
    one task; quadrature a row at a time took over a millisecond each."""
    import time

    given = [1.0, 100.0, 0.0, -1.0, 1e300, math.inf, math.nan, None]
    x = spark.createDataFrame(list(enumerate(given)), "i int, x double")
    got = [r["y"] for r in x.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got[-1] is None and math.isnan(got[-2]) and abs(got[-4]) < 1e-100
    assert got[:4] + [got[5]] == pytest.approx(want, abs=1e-14, nan_ok=True)
    begun = time.time()
    assert spark.range(0, 50_000, 1, 1).select(fn(F.col("id") / 1000.0 + 0.001).alias("y")).where(F.col("y").isNotNull()).count() == 50_000
    assert time.time() - begun < 15


def test_bessel_y0_of_many_rows(spark):
    bessel_column(spark, maths.y0, [0.08825696421567697, -0.07724431336508315, -math.inf, math.nan, 0.0])


def test_bessel_y1_of_many_rows(spark):
    bessel_column(spark, maths.y1, [-0.7812128213002887, -0.02037231200275932, -math.inf, math.nan, 0.0])


def test_bessel_yn_of_many_rows(spark):
    bessel_column(spark, lambda x: maths.yn(2, x), [-1.6506826068162543, 0.07683686712502797, -math.inf, math.nan, 0.0])


def test_bessel_jn_of_many_rows(spark):
    bessel_column(spark, lambda x: maths.jn(2, x), [0.1149034849319005, -0.02152875734450536, 0.0, 0.1149034849319005, 0.0])


def test_bessel_j1_of_many_rows(spark):
    bessel_column(spark, maths.j1, [0.4400505857449335, -0.07714535201411216, 0.0, -0.4400505857449335, 0.0])


def test_bessel_j0_of_many_rows(spark):
    bessel_column(spark, maths.j0, [0.7651976865579666, 0.01998585030422312, 1.0, 0.7651976865579666, 0.0])


@pytest.mark.parametrize("name, rows", [("stream_dedup", False), ("stream_filter_append", True)])
def test_what_a_stream_appends_is_not_held_by_the_driver(spark, data, name, rows):
    from tidemill import queries_more

    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    out = queries_more.QUERIES[name](spark, data)
    assert "LocalTableScan" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "FileScan parquet" in plan
    assert spark.conf.get("spark.sql.shuffle.partitions") == shuffled
    want = spark.read.parquet(f"{data}/events.parquet")
    assert (out.count() == want.where("value > 10").count()) if rows else (out.first()["n"] == want.count())


def rates_as_sql(spark, tmp_path, name):
    """A rate query against its SQL where times repeat, with other and the same
    values, and where a quotient has digits beyond what a double holds."""
    import oracle

    from tidemill import queries

    steps = [(0, 31.89), (745, 2.86), (745, 3.5), (745, 3.5), (745, 1.0), (10**9, 2.0), (2 * 86400 * 10**6, 1.0), (2 * 86400 * 10**6, 1.0), (4 * 86400 * 10**6, 7.0), (4 * 86400 * 10**6, 2.0)]
    rows = ", ".join(f"({i}, make_timestamp({us} + 1704795427720968), 1, '{k}', {v}::DOUBLE)" for k in ("a", "b") for i, (us, v) in enumerate(steps))
    oracle.duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) v(event_id, ts, user_id, event_type, value)) TO '{tmp_path}/events.parquet'")
    db = oracle.connect(str(tmp_path))
    return oracle.compare(db, queries.QUERIES[name](spark, str(tmp_path)), queries.SQL[name])


def test_derivative_over_repeated_times_as_sql(spark, tmp_path, s):
    assert rates_as_sql(spark, tmp_path, "derivative") is None
    twice = table(spark.createDataFrame([(at(0), "a", 1.0), (at(0), "a", 3.0), (at(0), "a", 3.0), (at(0), "a", 2.0), (at(10), "a", 4.0)], "_time timestamp, tag string, _value double"), ("tag",), ("_time",))
    assert values(sequences.derivative(twice, "10s")) == [None, None, None, 2.0]
    assert values(sequences.derivative(twice, "10s", by_zero=True)) == pytest.approx([math.inf, math.nan, -math.inf, 2.0], nan_ok=True)


def test_aggregate_rate_over_repeated_times_as_sql(spark, tmp_path):
    assert rates_as_sql(spark, tmp_path, "aggregate_rate") is None


def test_equal_groups_go_in_the_order_seen(spark):
    rows = [(at(0), "a", 5.0), (at(1), "b", 0.0), (at(2), None, 0.0), (at(3), "c", 9.0), (at(4), None, 9.0), (at(5), "a", 9.0), (at(6), "a", 0.0)]
    t = table(spark.createDataFrame(rows, "_time timestamp, tag string, _value double"), ("tag",))
    assert [r["tag"] for r in selectors.lowest_min(t, 2, group_columns=["tag"]).df.collect()] == ["a", "b"]
    assert [r["tag"] for r in selectors.highest_max(t, 2, group_columns=["tag"]).df.collect()] == ["a", None]
    assert selectors.highest_average(t, 9, group_columns=["tag"]).df.columns == ["tag", "_value"]
