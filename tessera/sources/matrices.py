"""Matrices in long form (m, r, c, v), and their text files.

A file holds its size n in the first line, then n lines of n numbers parted by
spaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrices(spark: SparkSession, path: str, kind: str = "float") -> DataFrame:
    """One matrix per file, m numbering the files by name; a wrong size or number raises an error.  A file is read whole."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.regexp_replace("value", r"\s+\z", ""), r"\r?\n").alias("lines"))
    names = files.select("file").distinct()
    rank = F.expr("row_number() over (order by file) - 1")  # a row per file
    files = files.join(names.select("file", rank.cast("int").alias("m")), "file")
    n = F.trim(F.get("lines", F.lit(0))).cast("int")
    checked = files.select("m", n.alias("n"), F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))).alias("rows"))
    bad_rows = F.raise_error(F.concat(F.lit("matrix should have rows: "), F.col("n").cast("string")))
    rows = checked.select("m", "n", F.explode(F.when(F.size("rows") == F.col("n"), F.transform("rows", lambda x, i: F.struct(i.alias("r"), x.alias("x")))).otherwise(bad_rows)).alias("row"))
    cells = F.split(F.trim("row.x"), " +")
    bad_cells = F.raise_error(F.concat(F.lit("row of another length: "), F.col("row.r").cast("string")))
    return rows.select("m", F.col("row.r").alias("r"), F.posexplode(F.when(F.size(cells) == F.col("n"), cells).otherwise(bad_cells)).alias("c", "x")).select(
        "m", "r", "c", F.col("x").cast(kind).alias("v")
    )


def write_matrix(df: DataFrame, path: str) -> None:
    """Writes one matrix (r, c, v) as such a file, on the driver; it must fit there."""
    rows: dict[int, dict[int, float]] = {}
    for r, c, v in df.select("r", "c", "v").collect():
        rows.setdefault(r, {})[c] = v
    with open(path, "w") as out:
        out.write(f"{len(rows)}\n")
        out.writelines(" ".join(repr(x) for _, x in sorted(rows[r].items())) + "\n" for r in sorted(rows))


def write_matrices(df: DataFrame, path: str) -> None:
    """Writes every matrix m >= 0 as such a file in a folder of its own, by one task each; their names are in the order of m."""
    cells = F.array_sort(F.collect_list(F.struct("c", F.col("v").cast("string").alias("x"))))
    rows = df.groupBy("m", "r").agg(F.array_join(F.transform(cells, lambda x: x["x"]), " ").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"])
    files = rows.groupBy("m").agg(F.concat_ws("\n", F.count("*").cast("string"), F.array_join(lines, "\n")).alias("value"))
    named = files.withColumn("matrix", F.lpad(F.col("m").cast("string"), 10, "0")).drop("m")
    named.write.partitionBy("matrix").text(path)


def read_written(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """What write_matrices() wrote, m numbering the matrices in their order."""
    return read_matrices(spark, f"{path}/matrix=*", kind)


def square(spark: SparkSession, n: int, value: Column, matrices: int = 1) -> DataFrame:
    """Every place of n by n matrices, with a value over m, r and c."""
    rows = spark.range(matrices * n * n).select(
        (F.col("id") / (n * n)).cast("int").alias("m"), ((F.col("id") / n).cast("long") % n).cast("int").alias("r"), (F.col("id") % n).cast("int").alias("c")
    )
    return rows.withColumn("v", value)


def dominant(n: int) -> Column:
    """Reproducible entries with a heavy diagonal, so that factors without pivoting are stable."""
    return F.pmod(F.hash("m", "r", "c"), F.lit(1000)) / 1000.0 + F.when(F.col("r") == F.col("c"), float(n)).otherwise(0.0)


def toeplitz(coefficient: Callable[[Column], Column] = lambda distance: F.lit(10.0)) -> Column:
    """Entries by a function of the distance from the diagonal, a column.  The published one is 10 at every distance."""
    return coefficient(F.abs(F.col("r") - F.col("c")))


def product_of_factors(spark: SparkSession, n: int, matrices: int = 1, seed: int = 1) -> DataFrame:
    """Matrices that are the product of a unit lower and an upper factor with reproducible entries in (0, 1], and so can be factored."""
    from tessera.operators.matrix import lower_unit_triangle, multiply, upper_triangle

    entry = (F.pmod(F.xxhash64("m", "r", "c", F.lit(seed)), F.lit(1000)) + 1) / 1000.0
    both = square(spark, n, entry, matrices)
    heavy = upper_triangle(both).withColumn("v", F.col("v") + F.when(F.col("r") == F.col("c"), float(n)).otherwise(0.0))
    return multiply(lower_unit_triangle(both), heavy)
