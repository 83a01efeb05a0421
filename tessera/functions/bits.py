"""Unsigned 64-bit arithmetic on longs, which Spark has signed and checked for overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW16, LOW32 = (1 << 16) - 1, (1 << 32) - 1


def signed(n: int) -> int:
    """The long with the same bits."""
    return n - (1 << 64) if n >= 1 << 63 else n


def xor_left(x: Column, by: int) -> Column:
    return x.bitwiseXOR(F.shiftleft(x, by))


def xor_right(x: Column, by: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, by))


def masked(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(signed(mask)).cast("long"))


def _product32(x: Column, c: int) -> Column:
    """x * c modulo 2^32, both below it."""
    low, high = masked(x, LOW16) * c, F.shiftrightunsigned(x, 16) * c
    return masked(low + F.shiftleft(masked(high, LOW16), 16), LOW32)


def _joined(high: Column, low: Column) -> Column:
    return F.shiftleft(masked(high, LOW32), 32).bitwiseOR(masked(low, LOW32))


def wrapping_add(x: Column, c: int) -> Column:
    """x + c modulo 2^64."""
    low = masked(x, LOW32) + (c & LOW32)
    return _joined(F.shiftrightunsigned(x, 32) + ((c >> 32) & LOW32) + F.shiftrightunsigned(low, 32), low)


def wrapping_mul(x: Column, c: int) -> Column:
    """x * c modulo 2^64, by halves of 32 bits, of which one is split again."""
    xl, xh = masked(x, LOW32), F.shiftrightunsigned(x, 32)
    cl, ch = c & LOW32, (c >> 32) & LOW32
    p, q = masked(xl, LOW16) * cl, F.shiftrightunsigned(xl, 16) * cl
    low = masked(p, LOW32) + F.shiftleft(masked(q, LOW16), 16)
    high = F.shiftrightunsigned(p, 32) + F.shiftrightunsigned(q, 16) + _product32(xh, cl) + _product32(xl, ch)
    return _joined(high + F.shiftrightunsigned(low, 32), low)


def square_low40(x: Column) -> Column:
    """Bits 0 to 39 of x * x, for x below 2^32."""
    l, h = masked(x, LOW16), F.shiftrightunsigned(x, 16)
    return masked(F.shiftleft(masked(h * h, 255), 32) + F.shiftleft(masked(2 * h * l, (1 << 24) - 1), 16) + l * l, (1 << 40) - 1)
