"""The published cases at their sizes, over numbers of cores, with speedups.

    python -m tessera.plans.suite [--cores 1,2,4,8] [--times 1] [--results DIR] [--most-arrays 4] [CASE...]

Each case makes one value, which every run of it must give again and, where it
is known, which must be the expected one.  A line is printed as soon as a
number of cores has been timed; a result file and a plot are written per case.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.generators import random_cos, selected
from tessera.operators import compact, matrix, reduce, scan, sort
from tessera.plans import storage, timing
from tessera.plans.session import local_session
from tessera.sources.matrices import dominant, square
from tessera.sources.ranges import START, scan_input, sort_input, sum_input


@dataclass(frozen=True)
class Case:
    """A kernel at a size: run gives its value from a session; expected is that value, if it is known."""

    name: str
    title: str
    run: Callable[[SparkSession], object]
    expected: object = None


def _one(df: DataFrame) -> object:
    return df.first()[0]


def _scan(m: int, n: int = 4_194_304) -> Callable[[SparkSession], object]:
    return lambda spark: _one(scan.prefix_sum(scan_input(spark, n, m), "v", ["i"], ["m"], spread=m == 1).agg(F.max("prefix")))


def _compact(m: int, n: int = 4_194_304) -> Callable[[SparkSession], object]:
    def run(spark: SparkSession) -> object:
        rows = scan_input(spark, n, m)
        return _one(compact.compact(rows, selected(F.col("v")), ["i"], ["m"], spread=m == 1).agg(F.max("index") + 1))

    return run


def _lud(n: int, m: int) -> Callable[[SparkSession], object]:
    """Whether all factors multiply to their matrices, in single precision."""

    def run(spark: SparkSession) -> object:
        a = square(spark, n, dominant(n), m).withColumn("v", F.col("v").cast("float"))
        factors = matrix.lu(a, "float32") if m > 1 else matrix.lu_tiled(a, 128, "float32")
        return bool(_one(factors.agg(F.count_if(F.isnan("v")) == 0)))

    return run


def cases(most_arrays: int = 32) -> Iterator[Case]:
    """The published kernels; nested ones with up to so many arrays or matrices at once."""
    for n, total in ((33_555_666, 2_329_031_844_653_094), (67_110_098, 4_657_980_000_312_434)):
        yield Case(f"sum-array-{n}", f"Sum of an array (n = {n:,})", lambda spark, n=n: _one(reduce.total(sum_input(spark, n), "v")), total)
    for n, total in ((263_378, 18_308_219_158_952), (1_049_810, 72_910_026_179_690)):
        yield Case(f"sum-function-{n}", f"Sum of a function (n = {n:,})", lambda spark, n=n: _one(reduce.mapped_total(spark, START, n, random_cos)), total)
    yield Case("primes", "Primes (n = 1,048,576)", lambda spark: _one(reduce.count_primes(spark, 2, 1_048_576)), 82_025)
    for m in (1, 2, 4, 8, 16, 32):
        if m <= most_arrays:
            yield Case(f"scan-{m}", f"Prefix sums (m = {m})", _scan(m), 9_007_199_252_643_840)
            yield Case(f"compact-{m}", f"Compaction (m = {m})", _compact(m), 2_097_152)
    for n, checksum in ((262_144, 10_742_766_094), (1_048_576, 10_736_732_177)):
        yield Case(f"sort-{n}", f"Sort (n = {n:,})", lambda spark, n=n: _one(sort.checksum(sort_input(spark, n), "x", n)), checksum)
    for n, counts in ((256, (1, 2)), (512, (1, 2, 4, 8, 16, 32))):
        for m in counts:
            if m <= most_arrays:
                yield Case(f"lud-{n}-{m}", f"LU decomposition (n = {n}, m = {m})", _lud(n, m), True)


def timed(wanted: Sequence[Case], cores: Sequence[int], times: int = 1, say: Callable[[str], None] = print) -> dict[str, dict[int, float]]:
    """case -> cores -> mean seconds, after a run that warms up.  A session per number of cores, the fewest first."""
    seconds: dict[str, dict[int, float]] = {}
    for n in sorted(cores):
        if (old := SparkSession.getActiveSession()) is not None:
            old.stop()
        spark = local_session(n, name=f"suite-{n}")
        spark.sparkContext.setLogLevel("ERROR")
        for case in wanted:
            with storage.scope():
                took, value = timing.mean_seconds(lambda case=case: case.run(spark), times)
            if case.expected is not None and value != case.expected:
                raise ValueError(f"{case.name} gave {value!r} instead of {case.expected!r}")
            found = seconds.setdefault(case.name, {})
            found[n] = took
            say(f"{case.title:40} {n:02} threads {took * 1000:.0f} ms ({next(iter(found.values())) / took:.2f}x)")
        spark.stop()
    return seconds


def main(argv: Sequence[str] | None = None) -> None:
    read = argparse.ArgumentParser(prog="suite")
    read.add_argument("cases", nargs="*", help="names, or how they begin; else all")
    read.add_argument("--cores", default="1,2,4,8")
    read.add_argument("--times", type=int, default=1)
    read.add_argument("--results", default="results")
    read.add_argument("--most-arrays", type=int, default=4)
    asked = read.parse_args(argv)
    wanted = [c for c in cases(asked.most_arrays) if not asked.cases or c.name.startswith(tuple(asked.cases))]
    seconds = timed(wanted, [int(n) for n in asked.cores.split(",")], asked.times)
    folder = Path(asked.results)
    folder.mkdir(parents=True, exist_ok=True)
    for case in wanted:
        found = timing.speedups(seconds[case.name][min(seconds[case.name])], {"Spark": seconds[case.name]})
        timing.write_result(folder / f"{case.name}.dat", case.title, f"{min(seconds[case.name])} core", found)
        timing.write_plot(folder / f"{case.name}.gnuplot", case.title, f"{case.name}.dat", list(found))


if __name__ == "__main__":
    main()
