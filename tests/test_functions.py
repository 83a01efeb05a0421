import math
import random

from pyspark.sql import functions as F

from tessera.functions import bits, generators

U = (1 << 64) - 1


def shl(x, n):
    return (x << n) & U


def xorshift32(x):
    x ^= shl(x, 13)
    x ^= x >> 17
    x ^= shl(x, 5)
    return x & 0xFFFFFFFF


def random_cos(x):
    x ^= shl(x, 13)
    x ^= x >> 17
    x = int(max(0.0, math.cos(float(x)) * 123456789.0))
    x ^= shl(x, 5)
    x = (x * x + 9023) & U
    x ^= x >> 11
    x ^= shl(x, 9)
    return x & 0xFFFFFFF


def random_mul(x):
    x = (x + 876998787696) * 35334534876231 & U
    x ^= shl(x, 19)
    x ^= x >> 23
    x ^= shl(x, 13)
    x ^= x >> 17
    x ^= shl(x, 5)
    return x & 0xFFFFFFFF


def selected(v, mask):
    v ^= v >> 11
    v ^= shl(v, 7)
    v ^= v >> 5
    return v & mask == mask


def prime(n):
    if n != 2 and n % 2 == 0:
        return False
    return all(n % f for f in range(3, math.isqrt(n) + 1, 2))


def test_generators_against_unsigned_arithmetic(spark):
    starts = [0, 1 << 30, (1 << 40) - 500]
    ids = spark.createDataFrame([(s + i,) for s in starts for i in range(500)], "x long")
    rows = ids.select("x", *[f(F.col("x")).alias(f.__name__) for f in (generators.xorshift32, generators.random_mul)], generators.selected(F.col("x"), 5).alias("s")).collect()
    for r in rows:
        assert r["xorshift32"] == xorshift32(r["x"])
        assert r["random_mul"] == random_mul(r["x"])
        assert r["s"] == selected(r["x"], 5)
    for r in ids.where("x < 2000000000").select("x", generators.random_cos(F.col("x")).alias("v")).collect():
        assert r["v"] == random_cos(r["x"])


def test_wrapping_arithmetic_on_all_longs(spark):
    rng = random.Random(1)
    xs = [0, 1, U, 1 << 63, (1 << 63) - 1, 0xFFFFFFFF, 1 << 32] + [rng.getrandbits(64) for _ in range(300)]
    df = spark.createDataFrame([(bits.signed(x),) for x in xs], "x long")
    for c in (1, 35334534876231, U, 0x9E3779B97F4A7C15):
        got = df.select(bits.wrapping_mul(F.col("x"), c), bits.wrapping_add(F.col("x"), c)).collect()
        assert [(r[0], r[1]) for r in got] == [(bits.signed(x * c & U), bits.signed((x + c) & U)) for x in xs]


def test_primes(spark):
    got = {r["n"]: r["p"] for r in spark.range(0, 3000).select(F.col("id").alias("n"), generators.is_prime(F.col("id")).alias("p")).collect()}
    assert got == {n: prime(n) for n in range(3000)}
    assert (got[0], got[1], got[2], got[3], got[4], got[9], got[25]) == (False, True, True, True, False, False, False)
    big = [999_999_937, 999_999_937 * 2, 31_607**2]
    df = spark.createDataFrame([(n,) for n in big], "n long").select(generators.is_prime(F.col("n")))
    assert [r[0] for r in df.collect()] == [True, False, False]
