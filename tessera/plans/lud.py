"""LU decomposition from the command line.

    python -m tessera.plans.lud [-v] [-n threads] [-s size | -i file] [-m matrices]

The matrix comes from a file, or is made inside: by default, as published, every
entry is 10, which has no factors; product and dominant make matrices that have.
All matrices are alike.  -v multiplies the factors and says where they are wrong.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import matrix
from tessera.plans import storage
from tessera.plans.session import local_session
from tessera.sources import matrices

#: A matrix from this size on is factored by tiles.
TILED = 1024


def source(spark: SparkSession, file: str | None, size: int, count: int, kind: str) -> DataFrame:
    if count < 1:
        raise ValueError("there should be at least 1 matrix")
    if file:
        one = matrices.read_matrices(spark, file)
    elif kind == "product":
        one = matrices.product_of_factors(spark, size)
    else:
        one = matrices.square(spark, size, {"toeplitz": matrices.toeplitz(), "dominant": matrices.dominant(size)}[kind])
    copies = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("m")
    return one.select(copies, "r", "c", F.col("v").cast("float").alias("v"))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> float:
    """Prints what it does and the milliseconds that it took, which it returns."""
    read = argparse.ArgumentParser(prog="lud")
    read.add_argument("-v", "--verify", action="store_true")
    read.add_argument("-n", type=int, default=8, dest="threads")
    read.add_argument("-m", "--matrixcount", type=int, default=1)
    which = read.add_mutually_exclusive_group(required=True)
    which.add_argument("-s", "--size", type=int, default=32)
    which.add_argument("-i", "--input")
    read.add_argument("--kind", choices=("toeplitz", "product", "dominant"), default="toeplitz")
    asked = read.parse_args(argv)
    spark = spark or local_session(asked.threads, name="lud")
    print(f"Reading matrix from file {asked.input}" if asked.input else f"Making matrix of size {asked.size}")
    with storage.scope():
        a = storage.written(source(spark, asked.input, asked.size, asked.matrixcount, asked.kind), "lud-input")
        n = matrix.size(a).agg(F.max("n")).first()[0]
        began = time.perf_counter()
        factors = matrix.lu_tiled(a, kind="float32") if n >= TILED else matrix.lu(a, "float32")
        factors = storage.written(factors, "lud-factors")
        took = 1000 * (time.perf_counter() - began)
        if asked.verify:
            wrong = matrix.wrong_places(a, factors).orderBy("m", "r", "c")
            for r in wrong.limit(10).collect():
                print(f"wrong at {r['m']}, {r['r']}, {r['c']}: {r['v']} is not {r['p']}")
            print(f"{wrong.count()} places are wrong")
    print(f"Time in ms: {took:.6f}")
    return took


if __name__ == "__main__":
    main()
