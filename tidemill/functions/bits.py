"""Bitwise operations, hashes and hex text. Unsigned numbers are decimal(20,0)
outside and 64-bit patterns inside."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO64 = str(2**64)


def _bits(x) -> Column:
    d = (x if isinstance(x, Column) else F.lit(str(x))).cast("decimal(21,0)")
    return F.when(d >= F.lit(str(2**63)).cast("decimal(21,0)"), d - F.lit(_TWO64).cast("decimal(21,0)")).otherwise(d).cast("long")


def _unsigned(x: Column) -> Column:
    d = x.cast("decimal(21,0)")
    return F.when(d < 0, d + F.lit(_TWO64).cast("decimal(21,0)")).otherwise(d).cast("decimal(20,0)")


def _s(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def sand(a, b):
    return _s(a).bitwiseAND(_s(b))


def sor(a, b):
    return _s(a).bitwiseOR(_s(b))


def snot(a):
    return F.bitwise_not(_s(a))


def sxor(a, b):
    return _s(a).bitwiseXOR(_s(b))


def sclear(a, b):
    return _s(a).bitwiseAND(F.bitwise_not(_s(b)))


def slshift(a, b: int):
    return F.shiftleft(_s(a), b) if b < 64 else F.lit(0).cast("long")


def srshift(a, b: int):
    return F.shiftright(_s(a), min(b, 63))


def uand(a, b):
    return _unsigned(_bits(a).bitwiseAND(_bits(b)))


def uor(a, b):
    return _unsigned(_bits(a).bitwiseOR(_bits(b)))


def unot(a):
    return _unsigned(F.bitwise_not(_bits(a)))


def uxor(a, b):
    return _unsigned(_bits(a).bitwiseXOR(_bits(b)))


def uclear(a, b):
    return _unsigned(_bits(a).bitwiseAND(F.bitwise_not(_bits(b))))


def ulshift(a, b: int):
    return _unsigned(F.shiftleft(_bits(a), b)) if b < 64 else F.lit(0).cast("decimal(20,0)")


def urshift(a, b: int):
    return _unsigned(F.shiftrightunsigned(_bits(a), b)) if b < 64 else F.lit(0).cast("decimal(20,0)")


def sha256(v: Column) -> Column:
    return F.sha2(v.cast("binary"), 256)


def sha1(v: Column) -> Column:
    return F.sha1(v.cast("binary"))


def md5(v: Column) -> Column:
    return F.md5(v.cast("binary"))


def b64(v: Column) -> Column:
    return F.base64(v.cast("binary"))


def _xx(v: pd.Series) -> pd.Series:
    from xxhash import xxh64_intdigest

    return pd.Series([None if x is None else str(xxh64_intdigest(x.encode())) for x in v])


def xxhash64(v: Column) -> Column:
    """XXH64 with seed 0, as decimal text."""
    return F.pandas_udf(_xx, "string")(v)


def city64(data: bytes) -> int:
    """CityHash64 of at most 16 bytes and of longer data, after its paper's rules."""
    m = 2**64 - 1
    k0, k1, k2 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F
    f64 = lambda p: int.from_bytes(data[p : p + 8], "little")
    f32 = lambda p: int.from_bytes(data[p : p + 4], "little")
    rot = lambda v, s: v if not s else (v >> s | v << (64 - s)) & m
    mix = lambda v: v ^ v >> 47
    swap = lambda v: int.from_bytes(v.to_bytes(8, "little"), "big")

    def pair(u, v, mul=0x9DDFEA08EB382D69):
        a = mix((u ^ v) * mul & m)
        return mix((v ^ a) * mul & m) * mul & m

    n = len(data)
    if n <= 16:
        if n >= 8:
            mul, a, b = k2 + n * 2 & m, f64(0) + k2 & m, f64(n - 8)
            return pair(rot(b, 37) * mul + a & m, (rot(a, 25) + b) * mul & m, mul)
        if n >= 4:
            mul = k2 + n * 2 & m
            return pair(n + (f32(0) << 3) & m, f32(n - 4), mul)
        if n:
            y, z = data[0] + (data[n >> 1] << 8), n + (data[n - 1] << 2)
            return mix((y * k2 ^ z * k0) & m) * k2 & m
        return k2
    if n <= 32:
        mul, a, b = k2 + n * 2 & m, f64(0) * k1 & m, f64(8)
        c, d = f64(n - 8) * mul & m, f64(n - 16) * k2 & m
        return pair(rot(a + b & m, 43) + rot(c, 30) + d & m, a + rot(b + k2 & m, 18) + c & m, mul)
    if n <= 64:
        mul, a, b, c, d = k2 + n * 2 & m, f64(0) * k2 & m, f64(8), f64(n - 24), f64(n - 32)
        e, f, g, h = f64(16) * k2 & m, f64(24) * 9 & m, f64(n - 8), f64(n - 16) * mul & m
        u = rot(a + g & m, 43) + (rot(b, 30) + c & m) * 9 & m
        v = (a + g ^ d) + f + 1 & m
        w = swap((u + v) * mul & m) + h & m
        x = rot(e + f & m, 42) + c & m
        y = (swap((v + w) * mul & m) + g) * mul & m
        z = e + f + c & m
        a = swap((x + z) * mul + y & m) + b & m
        return mix((z + a) * mul + d + h & m) * mul + x & m

    def weak(p, a, b):
        w, x, y, z = f64(p), f64(p + 8), f64(p + 16), f64(p + 24)
        a = a + w & m
        b = rot(b + a + z & m, 21)
        c = a
        a = a + x + y & m
        b = b + rot(a, 44) & m
        return a + z & m, b + c & m

    x = f64(n - 40)
    y = f64(n - 16) + f64(n - 56) & m
    z = pair(f64(n - 48) + n & m, f64(n - 24))
    v, w = weak(n - 64, n, z), weak(n - 32, y + k1 & m, x)
    x = x * k1 + f64(0) & m
    p, left = 0, n - 1 & ~63
    while left:
        x = rot(x + y + v[0] + f64(p + 8) & m, 37) * k1 & m
        y = rot(y + v[1] + f64(p + 48) & m, 42) * k1 & m
        x ^= w[1]
        y = y + v[0] + f64(p + 40) & m
        z = rot(z + w[0] & m, 33) * k1 & m
        v = weak(p, v[1] * k1 & m, x + w[0] & m)
        w = weak(p + 32, z + w[1] & m, y + f64(p + 16) & m)
        z, x = x, z
        p, left = p + 64, left - 64
    return pair(pair(v[0], w[0]) + mix(y) * k1 + z & m, pair(v[1], w[1]) + x & m)


def cityhash64(v: Column) -> Column:
    @F.pandas_udf("string")
    def city(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else str(city64(x.encode())) for x in a])

    return city(v)


def hmac(v: Column, key: str) -> Column:
    """HMAC-SHA1 as base64 text."""

    @F.pandas_udf("string")
    def mac(a: pd.Series) -> pd.Series:
        import base64
        import hashlib
        import hmac as h

        return pd.Series([None if x is None else base64.b64encode(h.new(key.encode(), x.encode(), hashlib.sha1).digest()).decode() for x in a])

    return mac(v)


def hex_int(v: Column) -> Column:
    """Hex text, with or without sign and 0x, as a signed number."""
    digits = F.regexp_replace(v, r"^([+-]?)0[xX]", "$1")
    size = F.conv(F.regexp_replace(digits, r"^[+-]", ""), 16, 10).cast("decimal(20,0)").cast("long")
    return F.when(digits.startswith("-"), -size).otherwise(size)


def hex_uint(v: Column) -> Column:
    return F.conv(F.regexp_replace(v, r"^0[xX]", ""), 16, 10).cast("decimal(20,0)")


def hex_string(v: Column, kind: str = "int") -> Column:
    """A number, text or bytes as lower-case hex."""
    if kind == "int":
        return F.when(v < 0, F.concat(F.lit("-"), F.lower(F.hex(-v)))).otherwise(F.lower(F.hex(v)))
    return F.lower(F.hex(_bits(v) if kind == "uint" else v))


def hex_bytes(v: Column) -> Column:
    return F.unhex(v)
