"""Aggregates: one row per table. All are ``groupBy(key).agg``, with partial
aggregation before the shuffle; nothing is collected but a quantile's digest."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.duration import parse
from ..plans.stream import START, STOP, TIME, VALUE, TableStream, as_column, col

NAN = float("nan")


def aggregate(s: TableStream, **columns: Column) -> TableStream:
    """Any aggregates per table; empty tables are left out."""
    return s.to(s.df.groupBy(*map(col, s.key)).agg(*(c.alias(n) for n, c in columns.items())), order=(), empty=None)


def _numeric(s: TableStream, column: str) -> None:
    s.need(column)
    if not isinstance(s.df.schema[column].dataType, T.NumericType):
        raise TypeError(f"unsupported column type {s.df.schema[column].dataType.simpleString()}")


def _typed(s: TableStream, column: str, c: Column) -> Column:
    kind = s.df.schema[column].dataType
    return c.cast("long") if isinstance(kind, T.IntegralType) else c.cast(kind)


# Column forms, which windows and down-sampling share.


def count_of(s, column):
    return F.count(F.lit(1))


def sum_of(s, column):
    return _typed(s, column, F.sum(col(column)))


def mean_of(s, column):
    return F.avg(col(column).cast("double"))


def min_of(s, column):
    return F.min(col(column))


def max_of(s, column):
    return F.max(col(column))


def spread_of(s, column):
    return _typed(s, column, F.max(col(column)) - F.min(col(column)))


def stddev_of(s, column, mode="sample"):
    c = col(column).cast("double")
    if mode == "population":
        return F.stddev_pop(c)
    return F.when(F.count(c) == 1, F.lit(NAN)).otherwise(F.stddev_samp(c))


def skew_of(s, column):
    c = col(column).cast("double")
    return F.when(F.count(c) == 1, F.lit(NAN)).otherwise(F.skewness(c))


def quantile_of(s, column, q=0.5, method="estimate_tdigest", compression=1000.0):
    """``exact_mean`` interpolates between all values; the estimate between at
    most ``compression`` centroids (a mergeable sketch; as many distinct values
    are exact), each standing for as many equal values as it holds."""
    c = col(column).cast("double")
    if method == "exact_mean":
        return F.percentile(c, F.lit(float(q)))
    real = F.when(~F.isnan(c), c)
    sketch = F.histogram_numeric(real, F.lit(int(max(compression, 2))))
    at = F.lit(float(q)) * F.count(real)
    start = F.struct(F.lit(0.0).alias("n"), F.min(real).alias("x"), F.lit(None).cast("double").alias("out"))

    def step(acc, bin_):
        begin, end = acc["n"] + 0.5, acc["n"] + bin_["y"] - 0.5
        between = acc["x"] + (bin_["x"] - acc["x"]) * F.least(F.greatest(at - (acc["n"] - 0.5), F.lit(0.0)), F.lit(1.0))
        here = F.when(at <= begin, F.when(acc["n"] == 0, acc["x"]).otherwise(between)).when(at <= end, bin_["x"])
        return F.struct((acc["n"] + bin_["y"]).alias("n"), bin_["x"].alias("x"), F.coalesce(acc["out"], here).alias("out"))

    def finish(acc):
        return F.coalesce(acc["out"], acc["x"] + (F.max(real) - acc["x"]) * F.least(F.greatest((at - acc["n"] + 0.5) * 2, F.lit(0.0)), F.lit(1.0)))

    return finish(F.aggregate(F.transform(sketch, lambda b: F.struct(b["x"].cast("double").alias("x"), b["y"].cast("double").alias("y"))), start, step))


def first_of(s, column):
    """Value of the first row in order that has one."""
    return F.min_by(col(column), F.when(col(column).isNotNull(), _order(s)))


def last_of(s, column):
    return F.max_by(col(column), F.when(col(column).isNotNull(), _order(s)))


def _order(s: TableStream) -> Column:
    return F.struct(*(col(o) if isinstance(o, str) else o for o in s.order)) if s.order else F.lit(0)


def count(s: TableStream, column: str = VALUE) -> TableStream:
    """Rows, nulls included; 0 for tables known to be empty."""
    s.need(column)
    out = s.df.groupBy(*map(col, s.key)).agg(count_of(s, column).alias(column))
    if s.empty is not None:
        gone = s.empty.join(out, list(s.key), "left_anti").withColumn(column, F.lit(0).cast("long"))
        out = out.unionByName(gone)
    return s.to(out, order=(), empty=None)


def _simple(fn, numeric: bool = True):
    def op(s: TableStream, column: str = VALUE, **kw) -> TableStream:
        _numeric(s, column) if numeric else s.need(column)
        return aggregate(s, **{column: fn(s, column, **kw)})

    op.__name__ = fn.__name__.removesuffix("_of")
    op.column = fn
    return op


sum, mean, spread = _simple(sum_of), _simple(mean_of), _simple(spread_of)  # noqa: A001
stddev, skew = _simple(stddev_of), _simple(skew_of)
count.column = count_of


def quantile(s: TableStream, q: float, column: str = VALUE, method: str = "estimate_tdigest", compression: float = 1000.0) -> TableStream:
    """q-quantile: an estimate, ``exact_mean`` (interpolated) or
    ``exact_selector`` (the row at ceil(q n))."""
    if not 0 <= q <= 1:
        raise ValueError("q must be in [0, 1]")
    _numeric(s, column)
    if method == "exact_selector":
        full = s.df.where(col(column).isNotNull())
        by = Window.partitionBy(*map(col, s.key))
        ranked = full.withColumns({"__n": F.count(F.lit(1)).over(by), "__i": F.row_number().over(by.orderBy(col(column), *s.ordering()))})
        return s.to(ranked.where(F.col("__i") == F.greatest(F.ceil(F.col("__n") * F.lit(float(q))), F.lit(1))).drop("__n", "__i"), empty=None)
    if method not in ("estimate_tdigest", "exact_mean"):
        raise ValueError(f"unknown quantile method {method!r}")
    return aggregate(s, **{column: quantile_of(s, column, q, method, compression)})


def median(s: TableStream, column: str = VALUE, method: str = "estimate_tdigest", compression: float = 1000.0) -> TableStream:
    return quantile(s, 0.5, column, method, compression)


def mode(s: TableStream, column: str = VALUE) -> TableStream:
    """All most frequent non-null values, sorted, one row each; one null row if
    every value is as frequent as any other."""
    s.need(column)
    by = Window.partitionBy(*map(col, s.key))
    counted = s.df.where(col(column).isNotNull()).groupBy(*map(col, [*s.key, column])).agg(F.count(F.lit(1)).alias("__n"))
    ranked = counted.withColumns({"__top": F.max("__n").over(by), "__low": F.min("__n").over(by), "__i": F.row_number().over(by.orderBy(col(column)))})
    tied = F.col("__top") == F.col("__low")
    lone = ranked.where(F.when(tied, F.col("__i") == 1).otherwise(F.col("__n") == F.col("__top")))
    # one distinct value is a mode only by the general rule: distinct == modes gives null
    out = lone.withColumn(column, F.when(tied, F.lit(None)).otherwise(col(column))).drop("__n", "__top", "__low", "__i")
    return s.to(out, order=(column,), empty=None)


def covariance(s: TableStream, columns: Sequence[str], pearsonr: bool = False, value_dst: str = VALUE) -> TableStream:
    """Sample covariance (or Pearson's r) of two columns; NaN for under two pairs."""
    if len(columns) != 2:
        raise ValueError("covariance needs exactly two columns")
    x, y = (col(c).cast("double") for c in columns)
    for c in columns:
        _numeric(s, c)
    both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    fn = F.corr(x, y) if pearsonr else F.covar_samp(x, y)
    return aggregate(s, **{value_dst: F.when(both < 2, F.lit(NAN)).otherwise(fn)})


def cov(x: TableStream, y: TableStream, on: Sequence[str], pearsonr: bool = False) -> TableStream:
    """Covariance of two streams' values, joined on columns."""
    a = x.df.select(*map(col, on), col(VALUE).alias("x"))
    b = y.df.select(*map(col, on), col(VALUE).alias("y"))
    return covariance(TableStream(a.join(b, list(on)), tuple(k for k in x.key if k in on)), ["x", "y"], pearsonr)


def pearsonr(x: TableStream, y: TableStream, on: Sequence[str]) -> TableStream:
    return cov(x, y, on, True)


def linear_bins(start: float, width: float, count: int, infinity: bool = True) -> list[float]:
    return [float(start + i * width) for i in range(count)] + ([float("inf")] if infinity else [])


def logarithmic_bins(start: float, factor: float, count: int, infinity: bool = True) -> list[float]:
    return [float(start * factor**i) for i in range(count)] + ([float("inf")] if infinity else [])


def histogram(s: TableStream, bins: Sequence[float], column: str = VALUE, upper_bound_column: str = "le", count_column: str = VALUE, normalize: bool = False) -> TableStream:
    """Cumulative counts per upper bound. A value above the last bin is an error.

    All bins are aggregates of one pass; only then do they become rows."""
    _numeric(s, column)
    edges = sorted(float(b) for b in bins)
    c = col(column).cast("double")
    high = F.max(c)
    over = F.when(high > edges[-1], F.raise_error(F.concat(F.lit("found value greater than any bin: "), high.cast("string"))).cast("double"))
    counts = F.array(*(F.struct(F.lit(b).alias("le"), F.coalesce(F.sum(F.when(c <= b, 1.0)), F.lit(0.0)).alias("n")) for b in edges))
    out = s.df.groupBy(*map(col, s.key)).agg(counts.alias("__h"), F.count(c).cast("double").alias("__t"), over.alias("__over"))
    out = out.where(F.col("__over").isNull()).select(*map(col, s.key), "__t", F.explode("__h").alias("__b"))
    n = F.col("__b.n") / F.col("__t") if normalize else F.col("__b.n")
    return s.to(out.select(*map(col, s.key), F.col("__b.le").alias(upper_bound_column), n.alias(count_column)), order=(upper_bound_column,), empty=None)


def histogram_quantile(s: TableStream, quantile: float, count_column: str = VALUE, upper_bound_column: str = "le", value_column: str = VALUE, min_value: float = 0.0, on_nonmonotonic: str = "error") -> TableStream:
    """Quantile out of cumulative buckets, linear within a bucket. Total 0 gives
    null; ``on_nonmonotonic``: error, force (raise to the running maximum) or drop."""
    if on_nonmonotonic not in ("error", "force", "drop"):
        raise ValueError("on_nonmonotonic must be error, force or drop")
    pair = F.struct(col(upper_bound_column).cast("double").alias("le"), col(count_column).cast("double").alias("n"))
    sorted_ = s.df.where(col(count_column).isNotNull() & col(upper_bound_column).isNotNull()).groupBy(*map(col, s.key)).agg(F.array_sort(F.collect_list(pair)).alias("b"))
    raised = F.aggregate(
        "b",
        F.expr("cast(array() as array<struct<le:double,n:double>>)"),
        lambda acc, x: F.concat(acc, F.array(F.struct(x["le"].alias("le"), F.greatest(x["n"], F.coalesce(F.try_element_at(acc, F.lit(-1))["n"], x["n"])).alias("n")))),
    )
    fixed = sorted_.select("*", raised.alias("up"))
    falls = F.col("b") != F.col("up")
    if on_nonmonotonic == "drop":
        fixed = fixed.where(~falls)
    elif on_nonmonotonic == "error":
        fixed = fixed.withColumn("up", F.when(falls, F.raise_error(F.lit("histogram records counts are not monotonic")).cast("array<struct<le:double,n:double>>")).otherwise(F.col("up")))
    fixed = fixed.withColumns({"total": F.element_at("up", -1)["n"]}).withColumn("rank", F.col("total") * F.lit(float(quantile)))
    at = fixed.withColumn("i", F.array_position(F.transform("up", lambda x: x["n"] >= F.col("rank")), True).cast("int"))
    here = F.element_at("up", F.greatest(F.col("i"), F.lit(1)))
    back = F.try_element_at("up", F.greatest(F.col("i") - 1, F.lit(1)))
    low_le = F.when(F.col("i") > 1, back["le"]).otherwise(F.lit(float(min_value)))
    low_n = F.when(F.col("i") > 1, back["n"]).otherwise(F.lit(0.0))
    inside = low_le + (here["le"] - low_le) * F.when(here["n"] == low_n, 0.0).otherwise((F.col("rank") - low_n) / F.nullif(here["n"] - low_n, F.lit(0.0)))
    value = F.when(F.col("total") == 0, F.lit(None).cast("double")).when(here["le"] == float("inf"), low_le).when(here["le"] == float("-inf"), here["le"]).otherwise(inside)
    return s.to(at.select(*map(col, s.key), value.alias(value_column)), order=(), empty=None)


def reduce(s: TableStream, fn: Callable, identity: dict) -> TableStream:
    """Fold a table's rows in order with ``fn(r, accumulator) -> dict``."""
    names = [c for c in s.columns if c not in s.key]
    rows = F.array_sort(F.collect_list(F.struct(_order(s).alias("o"), F.struct(*map(col, names)).alias("r"))))
    zero = F.struct(*(as_column(v).alias(k) for k, v in identity.items()))

    class Row(dict):
        __getattr__ = dict.__getitem__

    def step(acc, x):
        record = fn(Row({n: x["r"][n] for n in names}), Row({k: acc[k] for k in identity}))
        return F.struct(*(as_column(record[k]).alias(k) for k in identity))

    out = s.df.groupBy(*map(col, s.key)).agg(rows.alias("__rows")).select(*map(col, s.key), F.aggregate("__rows", zero, step).alias("__acc"))
    return s.to(out.select(*map(col, s.key), *(F.col("__acc")[k].alias(k) for k in identity if k not in s.key)), order=(), empty=None)


def integral(s: TableStream, unit="1s", column: str = VALUE, time_column: str = TIME, interpolate: str = "") -> TableStream:
    """Area under the values, in trapezoids per ``unit``; with ``linear`` also
    out to _start and _stop. Times must not fall; repeated times count once."""
    _numeric(s, column)
    us = float(parse(unit).micros)
    rows = s.df.where(col(column).isNotNull() & col(time_column).isNotNull())
    w = s.rows()
    t, v = F.unix_micros(col(time_column)).cast("double"), col(column).cast("double")
    rows = rows.withColumns({"__t": t, "__v": v})
    # a repeated time keeps the first value
    rows = rows.withColumn("__p", F.lag("__t").over(w)).where(F.col("__p").isNull() | (F.col("__p") != F.col("__t")))
    rows = rows.withColumns({"__pt": F.lag("__t").over(w), "__pv": F.lag("__v").over(w), "__nt": F.lead("__t").over(w), "__nv": F.lead("__v").over(w)})
    area = (F.col("__v") + F.col("__pv")) / 2 * (F.col("__t") - F.col("__pt"))
    if interpolate == "linear":
        s.need(START, STOP)
        a, b = F.unix_micros(col(START)).cast("double"), F.unix_micros(col(STOP)).cast("double")
        slope_in = F.coalesce((F.col("__nv") - F.col("__v")) / (F.col("__nt") - F.col("__t")), F.lit(0.0))
        slope_out = F.coalesce((F.col("__v") - F.col("__pv")) / (F.col("__t") - F.col("__pt")), F.lit(0.0))
        head, tail = F.col("__t") - a, b - F.col("__t")
        first = F.when(F.col("__pt").isNull(), (F.col("__v") * 2 - slope_in * head) / 2 * head).otherwise(0.0)
        last = F.when(F.col("__nt").isNull(), (F.col("__v") * 2 + slope_out * tail) / 2 * tail).otherwise(0.0)
        area = F.coalesce(area, F.lit(0.0)) + first + last
    out = rows.groupBy(*map(col, s.key)).agg(F.coalesce(F.sum(area) / us, F.lit(0.0)).alias(column))
    return s.to(out, order=(), empty=None)


def time_weighted_average(s: TableStream, unit="1s", column: str = VALUE) -> TableStream:
    """Linear integral over the bounds, divided by their length in units."""
    out = integral(s, unit, column, interpolate="linear")
    span = (F.unix_micros(col(STOP)) - F.unix_micros(col(START))) / float(parse(unit).micros)
    return out.to(out.df.withColumn(column, col(column) / span))
