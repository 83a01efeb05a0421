"""Timing of kernels and the table of speedups that it gives.

A result file holds three comment lines and a row per thread count, its fields
parted by tabs: the count, then the speedup of each series.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "benchmark string, machine string, series string, ncpu int, speedup float"


def mean_seconds(run: Callable[[], object], times: int = 3) -> tuple[float, object]:
    """Mean of several runs after a first that warms up; every run must give what the first gave."""
    expected = run()
    began = time.perf_counter()
    for _ in range(times):
        if (got := run()) != expected:
            raise ValueError(f"a run gave {got!r}, the first {expected!r}")
    return (time.perf_counter() - began) / times, expected


def speedups(sequential: float, seconds: Mapping[str, Mapping[int, float]]) -> dict[str, dict[int, float]]:
    """series -> thread count -> how many times faster than the sequential run."""
    return {s: {n: sequential / t for n, t in by.items()} for s, by in seconds.items()}


def write_result(path: str | Path, title: str, against: str, found: Mapping[str, Mapping[int, float]]) -> None:
    counts = sorted({n for by in found.values() for n in by})
    lines = [f"# {title}", f"# Speedup compared to {against}", "\t".join(["# NCPU", *found])]
    lines += ["\t".join([str(n), *(f"{by[n]:.6g}" if n in by else "" for by in found.values())]) for n in counts]
    Path(path).write_text("\n".join(lines) + "\n")


def write_plot(path: str | Path, title: str, result: str, series: Sequence[str]) -> None:
    """A gnuplot script that draws a result file."""
    curves = ", ".join(f"'{result}' using 1:{i + 2} title '{s}' with linespoints" for i, s in enumerate(series))
    Path(path).write_text(f"set title '{title}'\nset xlabel 'Threads'\nset ylabel 'Speedup'\nset key left top\nplot {curves}\n")


def read_results(spark: SparkSession, path: str, machine: str) -> DataFrame:
    """Result files as one table; a file is read whole, its title names the benchmark."""
    files = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("lines"))
    name = F.trim(F.regexp_replace(F.get("lines", F.lit(0)), "^#", ""))
    heads = F.split(F.get("lines", F.lit(2)), "\t")
    rows = files.select(name.alias("benchmark"), heads.alias("heads"), F.explode(F.slice("lines", F.lit(4), F.greatest(F.size("lines") - 3, F.lit(0)))).alias("line")).where("trim(line) <> ''")
    cells = rows.withColumn("cells", F.split("line", "\t"))
    flat = cells.select("benchmark", F.expr("cells[0]").cast("int").alias("ncpu"), F.posexplode("cells").alias("at", "cell"), "heads")
    flat = flat.where("at > 0 and trim(cell) <> ''")
    return flat.select("benchmark", F.lit(machine).alias("machine"), F.trim(F.get("heads", F.col("at"))).alias("series"), "ncpu", F.col("cell").cast("float").alias("speedup"))
