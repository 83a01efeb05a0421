"""Deterministic pseudorandom values and predicates as columns.

The shift counts and constants are fixed values: results are compared with
published ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.bits import LOW32, masked, square_low40, wrapping_add, wrapping_mul, xor_left, xor_right


def xorshift32(i: Column) -> Column:
    """A 32-bit value from an index, by shifts of 13, 17 and 5."""
    return masked(xor_left(xor_right(xor_left(i, 13), 17), 5), LOW32)


def random_cos(x: Column) -> Column:
    """A 28-bit value, costly to compute: shifts, a cosine, and a square.  A negative cosine counts as 0."""
    wave = F.cos(xor_right(xor_left(x, 13), 17).cast("double")) * 123456789.0
    c = xor_left(F.greatest(F.lit(0.0), wave).cast("long"), 5)
    s = masked(square_low40(c) + 9023, (1 << 40) - 1)
    return masked(xor_left(xor_right(s, 11), 9), 0xFFFFFFF)


def random_mul(i: Column) -> Column:
    """A 32-bit value from an index, by a product modulo 2^64 and shifts of 19, 23, 13, 17 and 5."""
    x = wrapping_mul(wrapping_add(i, 876998787696), 35334534876231)
    x = xor_right(xor_left(x, 19), 23)
    return masked(xor_left(xor_right(xor_left(x, 13), 17), 5), LOW32)


def selected(v: Column, mask: int = 1) -> Column:
    """Whether all bits of the mask are set in v after shifts of 11, 7 and 5."""
    x = xor_right(xor_left(xor_right(v, 11), 7), 5)
    return masked(x, mask) == mask


#: Odd divisors that are tried at once.
TRIED = 512


def is_prime(n: Column) -> Column:
    """Trial division by odd numbers.  As published: 1 counts as prime, 0 does not.

    Divisors are made a few hundred at a time, and no more of them once one
    divides, so that a row holds little whatever its size.
    """
    root = F.floor(F.sqrt(n.cast("double"))).cast("long") + 1
    three, step = F.lit(3).cast("long"), 2 * TRIED
    starts = F.sequence(three, F.greatest(root, three), F.lit(step).cast("long"))

    def divides(f: Column) -> Column:
        return (f * f <= n) & (n % f == 0)

    divided = F.exists(starts, lambda s: F.exists(F.sequence(s, F.least(s + (step - 2), F.greatest(root, s)), F.lit(2).cast("long")), divides))
    return F.when(n == 2, True).when(n % 2 == 0, False).otherwise(~divided)
