"""Unsigned 64-bit arithmetic with wrap-around, in decimals, as plain column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WRAP = 1 << 64
# The published constants of FNV-1a and of SplitMix64.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_STEP, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def unsigned(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def to_long(x: Column) -> Column:
    """The long with the same 64 bits."""
    return F.when(x >= unsigned(1 << 63), x - unsigned(WRAP)).otherwise(x).cast("long")


def from_long(x: Column) -> Column:
    d = x.cast("decimal(38,0)")
    return F.when(x < 0, d + unsigned(WRAP)).otherwise(d).cast("decimal(38,0)")


def wrapped(x: Column) -> Column:
    return (x % unsigned(WRAP)).cast("decimal(38,0)")


def times(x: Column, n: int) -> Column:
    """x * n, in two halves of n so that no product has over 38 digits."""
    high, low = n >> 32, n & 0xFFFFFFFF
    upper = ((x * F.lit(str(high)).cast("decimal(11,0)")).cast("decimal(38,0)") % unsigned(1 << 32)).cast("decimal(10,0)")
    return wrapped((upper * F.lit(str(1 << 32)).cast("decimal(11,0)")).cast("decimal(38,0)") + (x * F.lit(str(low)).cast("decimal(11,0)")).cast("decimal(38,0)"))


def narrow(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def fnv1a(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as an unsigned decimal."""
    codes = F.transform(F.filter(F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("long"))
    step = lambda h, b: times(narrow(from_long(to_long(h).bitwiseXOR(b))), FNV_PRIME)
    return F.aggregate(codes, unsigned(FNV_START), step)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def split_mix(state: Column) -> Column:
    """The output of SplitMix64 for an unsigned state that has been stepped once."""

    def shifted(x: Column, k: int) -> Column:
        return bound(to_long(x), lambda b: from_long(b.bitwiseXOR(F.shiftrightunsigned(b, k))))

    def mixed(z: Column, k: int, factor: int) -> Column:
        return bound(narrow(bound(z, lambda x: shifted(x, k))), lambda x: times(x, factor))

    z = mixed(mixed(wrapped(state + unsigned(MIX_STEP)), 30, MIX_1), 27, MIX_2)
    return bound(z, lambda x: shifted(x, 31))
