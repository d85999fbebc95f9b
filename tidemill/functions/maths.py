"""Math on doubles. What Spark has stays in generated code; the rest is one Arrow
batch at a time."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constants (fixed values).
pi, e = math.pi, math.e
phi = 1.618033988749895
sqrt2, sqrte, sqrtpi, sqrtphi = math.sqrt(2), math.sqrt(math.e), math.sqrt(math.pi), math.sqrt(1.618033988749895)
ln2, log2e, ln10, log10e = math.log(2), 1 / math.log(2), math.log(10), 1 / math.log(10)
maxfloat, smallest_nonzero_float = 1.797693134862315708145274237317043567981e308, 5e-324
maxint, minint, maxuint = 2**63 - 1, -(2**63), 2**64 - 1
INF, NAN = float("inf"), float("nan")


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def _native(fn):
    return lambda x: fn(_d(x))


abs_, acos, acosh, asin, asinh = map(_native, (F.abs, F.acos, F.acosh, F.asin, F.asinh))
atan, atanh, cbrt, cos, cosh = map(_native, (F.atan, F.atanh, F.cbrt, F.cos, F.cosh))
exp, expm1, sin, sinh, sqrt = map(_native, (F.exp, F.expm1, F.sin, F.sinh, F.sqrt))
tan, tanh, round_to_even, is_nan = map(_native, (F.tan, F.tanh, F.rint, F.isnan))


def _log(fn, zero=0.0):
    """Spark's logarithms are null out of their domain; these are -Inf and NaN."""

    def log(x):
        x = _d(x)
        return F.when(x == zero, -INF).when(x < zero, NAN).otherwise(fn(x))

    return log


log, log10, log2, log1p = _log(F.ln), _log(F.log10), _log(F.log2), _log(F.log1p, -1.0)


def atan2(x, y):
    return F.atan2(_d(y), _d(x))


def ceil(x):
    x = _d(x)
    return F.when(F.abs(x) < 2.0**52, F.ceil(x).cast("double")).otherwise(x)


def floor(x):
    x = _d(x)
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def trunc(x):
    x = _d(x)
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def round_(x):
    """Half away from zero."""
    x = _d(x)
    return F.when(F.abs(x) < 2.0**52, F.signum(x) * F.floor(F.abs(x) + 0.5).cast("double")).otherwise(x)


def copysign(x, y):
    return F.when(signbit(y), -F.abs(_d(x))).otherwise(F.abs(_d(x)))


def signbit(x):
    """True for negative numbers and -0."""
    x = _d(x)
    return (x < 0) | x.cast("string").startswith("-")


def dim(x, y):
    d = _d(x) - _d(y)
    return F.when(F.isnan(d), d).otherwise(F.greatest(d, F.lit(0.0)))


def exp2(x):
    return F.pow(F.lit(2.0), _d(x))


def hypot(p, q):
    return F.hypot(_d(p), _d(q))


def m_inf(sign: int) -> Column:
    return F.lit(INF if sign >= 0 else -INF)


def is_inf(f, sign: int) -> Column:
    f = _d(f)
    return (f == INF) if sign > 0 else (f == -INF) if sign < 0 else f.isin(INF, -INF)


def nan() -> Column:
    return F.lit(NAN)


def m_max(x, y):
    x, y = _d(x), _d(y)
    return F.when(F.isnan(x) | F.isnan(y), NAN).otherwise(F.greatest(x, y))


def m_min(x, y):
    x, y = _d(x), _d(y)
    return F.when(F.isnan(x) | F.isnan(y), NAN).otherwise(F.least(x, y))


def mod(x, y):
    return F.when(_d(y) == 0, NAN).otherwise(_d(x) % F.nullif(_d(y), F.lit(0.0)))


def pow_(x, y):
    return F.pow(_d(x), _d(y))


def pow10(n):
    return F.pow(F.lit(10.0), _d(n))


def ldexp(frac, exp_):
    return _d(frac) * F.pow(F.lit(2.0), _d(exp_))


def modf(f):
    whole = trunc(f)
    return F.struct(whole.alias("int"), (_d(f) - whole).alias("frac"))


def sincos(v):
    return F.struct(F.sin(_d(v)).alias("sin"), F.cos(_d(v)).alias("cos"))


def _series(fn, kind: str = "double"):
    """A pandas UDF of a scalar function of one or more doubles."""

    def one(*xs):
        if any(x is None for x in xs):
            return None
        try:
            return fn(*xs)
        except (OverflowError, ValueError):
            return NAN if kind == "double" else None

    if fn.__code__.co_argcount == 2:

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([one(x, y) for x, y in zip(a, b)])

        return lambda x, y: F.pandas_udf(two, kind)(_d(x), _d(y))

    def single(a: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in a])

    return lambda x: F.pandas_udf(single, kind)(_d(x))


def _arrow(fn):
    """An Arrow UDF of a function of an array of doubles; null stays null, NaN NaN."""

    def run(a: pa.Array) -> pa.Array:
        out = fn(a.to_numpy(zero_copy_only=False))
        return pa.array(out, mask=a.is_null().to_numpy(zero_copy_only=False), from_pandas=False)

    return lambda x: F.arrow_udf(run, "double")(_d(x))


def _gamma(x):
    return INF if x == 0 else math.gamma(x)


def _erfinv(y: float) -> float:
    if y in (1.0, -1.0):
        return math.copysign(INF, y)
    if not -1 < y < 1:
        return NAN
    w = math.log1p(-y * y)
    t = 2 / (math.pi * 0.147) + w / 2
    x = math.copysign(math.sqrt(max(math.sqrt(t * t - w / 0.147) - t, 0.0)), y)
    for _ in range(4):  # Newton's method from the closed approximation
        slope = 2 / math.sqrt(math.pi) * math.exp(-x * x)
        if not slope:
            break
        x -= (math.erf(x) - y) / slope
    return x


#: Up to here Bessel functions are recurred downwards, beyond it expanded in 1/x.
_FAR = 25.0


def _sums(x: np.ndarray, last: int, *weights: dict[int, float]) -> list[np.ndarray]:
    """Sums of weights[k] J_k(x), |x| <= _FAR, from order ``last`` down (Miller).
    What is recurred is J_k over (x/2)^k / k!, which neither overflows nor
    vanishes; J_0 + 2 J_2 + 2 J_4 + ... = 1 gives the scale."""
    half = x / 2
    square, here, after = half * half, np.ones_like(x), np.ones_like(x)
    norm = {0: 1.0} | dict.fromkeys(range(2, last + 1, 2), 2.0)
    sums = [np.zeros_like(x) for _ in (norm, *weights)]
    for k in range(last, -1, -1):
        here, after = here - after * (square / ((k + 1) * (k + 2))), here
        step = half / (k + 1)
        for s, w in zip(sums, (norm, *weights)):
            s *= step
            if k in w:
                s += w[k] * here
    return [s / sums[0] for s in sums[1:]]


def _far(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """J_0, J_1, Y_0, Y_1 beyond _FAR by Hankel's expansion."""
    sin, cos, size = np.sin(x), np.cos(x), np.sqrt(1 / (math.pi * x))
    out = []
    for n, c, s in ((0, cos + sin, sin - cos), (1, sin - cos, -sin - cos)):
        parts, term = [np.zeros_like(x), np.zeros_like(x)], np.ones_like(x)
        for k in range(24):
            parts[k % 2] += -term if k & 2 else term
            term = term * ((4 * n * n - (2 * k + 1) ** 2) / (8 * (k + 1))) / x
        p, q = parts
        out += [size * (p * c - q * s), size * (p * s + q * c)]
    return out[0], out[2], out[1], out[3]


def _first_kind(n: int, x: np.ndarray) -> np.ndarray:
    """J_n beyond _FAR: upwards to x, from there on by the ratios of neighbours."""
    a, b, *_ = _far(x)
    if n == 0:
        return a
    for k in range(1, n):
        up = k < x
        a, b = np.where(up, b, a), np.where(up, 2 * k / x * b - a, b)
    below, ratio = np.ceil(x), np.zeros_like(x)
    for k in range(n + 20 + int(math.sqrt(40 * n)) if (below < n).any() else 0, 0, -1):
        beyond = k > below
        ratio = np.where(beyond, x / np.where(beyond, 2 * k - x * ratio, 1.0), 0.0)
        b = np.where(beyond & (k <= n), b * ratio, b)
    return b


def _second_kind(n: int, x: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Y_n upwards from Y_0 and Y_1."""
    a, b = y0, y1
    for k in range(1, n):
        a, b = b, np.where(np.isinf(b), b, 2 * k / x * b - a)
    return a if n == 0 else b


def _near_second(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Y_0 and Y_1 of 0 < x <= _FAR by Neumann's series."""
    last = int(_FAR) + 50
    even = {2 * j: -2 * (-1) ** j / j for j in range(1, last // 2)}
    odd = {2 * j + 1: -((-1) ** j) * (2 * j + 1) / (j * (j + 1)) for j in range(1, last // 2)}
    j0, j1, s0, s1 = _sums(x, last, {0: 1.0}, {1: 1.0}, even, odd)
    log_ = np.log(x / 2) + np.euler_gamma
    return 2 / math.pi * (log_ * j0 + s0), 2 / math.pi * ((log_ - 1) * j1 - j0 / x + s1)


def _bessel(n: int, x: np.ndarray, second: bool = False) -> np.ndarray:
    """Integer order Bessel functions of an array, in a number of steps that
    depends on the order only."""
    sign, n, size, out = (-1.0) ** n if n < 0 else 1.0, abs(n), np.abs(x), np.full(len(x), NAN)
    out[x == INF if second else size == INF] = 0.0
    near, far = ((x > 0) & (x <= _FAR), (x > _FAR) & (x < INF)) if second else (size <= _FAR, (size > _FAR) & (size < INF))
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        if second:
            out[x == 0] = -INF
            out[near] = _second_kind(n, x[near], *_near_second(x[near]))
            out[far] = _second_kind(n, x[far], *_far(x[far])[2:])
        else:
            out[near] = _sums(x[near], max(n, int(_FAR)) + 50, {n: 1.0})[0]
            out[far] = _first_kind(n, size[far]) * np.where(x[far] < 0, (-1.0) ** n, 1.0)
    return sign * out


def _ilogb(x):
    return None if x == 0 else math.frexp(x)[1] - 1


erf, erfc, erfinv = _series(lambda x: math.erf(x)), _series(lambda x: math.erfc(x)), _series(_erfinv)
erfcinv = _series(lambda x: _erfinv(1 - x))
gamma, remainder = _series(_gamma), _series(lambda x, y: math.remainder(x, y))
j0, j1 = _arrow(lambda x: _bessel(0, x)), _arrow(lambda x: _bessel(1, x))
y0, y1 = _arrow(lambda x: _bessel(0, x, True)), _arrow(lambda x: _bessel(1, x, True))
ilogb, logb = _series(_ilogb, "long"), _series(lambda x: -INF if x == 0 else float(math.frexp(x)[1] - 1))
nextafter = _series(lambda x, y: math.nextafter(x, y))
float64bits = _series(lambda x: __import__("decimal").Decimal(struct.unpack("<Q", struct.pack("<d", x))[0]), "decimal(20,0)")


def jn(n: int, x):
    return _arrow(lambda v: _bessel(n, v))(x)


def yn(n: int, x):
    return _arrow(lambda v: _bessel(n, v, True))(x)


def float64frombits(b: Column) -> Column:
    @F.pandas_udf("double")
    def bits(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else struct.unpack("<d", struct.pack("<Q", int(x)))[0] for x in a])

    return bits(b.cast("decimal(20,0)"))


def frexp(f) -> Column:
    x = _d(f)
    exp_ = F.when(x == 0, F.lit(0)).otherwise(ilogb(x) + 1).cast("long")
    return F.struct(F.when(x == 0, x).otherwise(x / F.pow(F.lit(2.0), exp_.cast("double"))).alias("frac"), exp_.alias("exp"))


def lgamma(x) -> Column:
    value = _series(lambda v: INF if v <= 0 and v == int(v) else math.lgamma(v))(x)
    x = _d(x)
    odd = F.pmod(F.floor(x), F.lit(2)) != 0
    return F.struct(value.alias("lgamma"), F.when((x < 0) & odd, -1).otherwise(1).cast("long").alias("sign"))
