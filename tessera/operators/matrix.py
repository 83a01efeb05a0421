"""Matrices in long form (m, r, c, v): triangles, products, LU factors and their error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.storage import forget, written

#: Rows and columns of a tile.
TILE = 128


def size(a: DataFrame) -> DataFrame:
    """(m, n): rows and columns of each square matrix, by its largest index."""
    return a.groupBy("m").agg((F.greatest(F.max("r"), F.max("c")) + 1).alias("n"))


def element(a: DataFrame, r: int, c: int) -> DataFrame:
    """(m, v) at one place of every matrix."""
    return a.where((F.col("r") == r) & (F.col("c") == c)).select("m", "v")


def row_part(a: DataFrame, r: int, first: int, count: int) -> DataFrame:
    """(m, c, v): count cells of one row of every matrix, from column first on."""
    return a.where((F.col("r") == r) & (F.col("c") >= first) & (F.col("c") < first + count)).select("m", "c", "v")


def upper_triangle(a: DataFrame) -> DataFrame:
    """What is on and above the diagonal."""
    return a.where("c >= r")


def lower_unit_triangle(a: DataFrame) -> DataFrame:
    """What is below the diagonal, and ones on it."""
    return a.where("c <= r").withColumn("v", F.when(F.col("c") == F.col("r"), F.lit(1.0)).otherwise(F.col("v")).cast(a.schema["v"].dataType))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of each pair of matrices m; places that no terms reach are left out, as zeros."""
    left = a.select("m", "r", F.col("c").alias("k"), F.col("v").alias("x"))
    right = b.select("m", F.col("r").alias("k"), "c", F.col("v").alias("y"))
    return left.join(right, ["m", "k"]).groupBy("m", "r", "c").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("v"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select("m", F.col("c").alias("r"), F.col("r").alias("c"), "v")


def printed(a: DataFrame) -> DataFrame:
    """(m, r, line): rows as text."""
    cells = F.array_sort(F.collect_list(F.struct("c", F.col("v").cast("string").alias("x"))))
    return a.groupBy("m", "r").agg(F.array_join(F.transform(cells, lambda x: x["x"]), " ").alias("line"))


def factor(a: np.ndarray) -> np.ndarray:
    """L below the diagonal, its ones left out, and U on and above it.  No pivoting: a zero pivot gives inf or nan."""
    a = a.copy()
    with np.errstate(all="ignore"):
        for k in range(len(a) - 1):
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a


def _kind(kind: str) -> str:
    return {"float64": "double", "float32": "float"}[kind]


def _cells(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, c, v.  Arrow tables keep a nan apart from a null, pandas frames do not."""
    r, c, v = (table.column(x).to_numpy() for x in "rcv")
    if len(np.unique(r.astype("int64") << 32 | c)) < len(r):
        raise ValueError("a matrix has two values at one place")
    return r, c, v


def lu(a: DataFrame, kind: str = "float64") -> DataFrame:
    """Both factors of every matrix, packed in one.

    Each matrix is factored by one task, many at once; one too large for a task
    goes to lu_tiled().  A place without a value is 0, one with two an error.
    """
    key = a.schema["m"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        r, c, v = _cells(table)
        n = int(max(r.max(), c.max())) + 1
        dense = np.zeros((n, n), kind)
        dense[r, c] = v
        r, c = np.divmod(np.arange(n * n, dtype="int32"), np.int32(n))
        m = pa.array([table.column("m")[0].as_py()] * (n * n), table.schema.field("m").type)
        return pa.table({"m": m, "r": pa.array(r), "c": pa.array(c), "v": pa.array(factor(dense).ravel())})

    return a.groupBy("m").applyInArrow(run, f"m {key}, r int, c int, v {_kind(kind)}")


def _left_solved(diagonal: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What L, the unit lower part of a factored diagonal tile, must be multiplied by to give x."""
    x = x.copy()
    for i in range(1, len(x)):
        x[i] -= diagonal[i, :i] @ x[:i]
    return x


def _right_solved(diagonal: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What must be multiplied by U, the upper part of a factored diagonal tile, to give x."""
    x = x.copy()
    for j in range(x.shape[1]):
        x[:, j] = (x[:, j] - x[:, :j] @ diagonal[:j, j]) / diagonal[j, j]
    return x


def tiles(a: DataFrame, tile: int = TILE, kind: str = "float64") -> DataFrame:
    """(m, i, j, n, data): square tiles of every matrix of n rows as bytes, row by row.

    Tiles over the edge go on as the identity does, so that they factor alike;
    tiles without a value are there as zeros.
    """
    key = a.schema["m"].dataType.simpleString()
    blocks = size(a).select("m", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / tile).cast("int"))).alias("i"))
    blocks = blocks.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / tile).cast("int"))))
    given = a.select(F.col("m").alias("of"), F.floor(F.col("r") / tile).cast("int").alias("bi"), F.floor(F.col("c") / tile).cast("int").alias("bj"), "r", "c", "v")
    same = F.col("m").eqNullSafe(F.col("of")) & (F.col("i") == F.col("bi")) & (F.col("j") == F.col("bj"))

    def run(table: pa.Table) -> pa.Table:
        m, i, j, n = (table.column(x)[0].as_py() for x in "mijn")
        table = table.filter(table.column("r").is_valid())
        r, c, v = _cells(table)
        out = np.zeros((tile, tile), kind)
        if i == j:
            past = np.arange(max(0, n - i * tile), tile)
            out[past, past] = 1
        out[r - i * tile, c - j * tile] = v
        names = {"m": table.schema.field("m").type, "i": pa.int32(), "j": pa.int32(), "n": pa.int32(), "data": pa.binary()}
        return pa.table({k: pa.array([x], names[k]) for k, x in zip(names, (m, i, j, n, out.tobytes()), strict=True)})

    whole = blocks.withColumn("n", F.col("n").cast("int")).join(given, same, "left")
    return whole.groupBy("m", "i", "j").applyInArrow(run, f"m {key}, i int, j int, n int, data binary")


def _by_tile(df: DataFrame, schema: str, change, kind: str, tile: int, *inputs: str) -> DataFrame:
    """df with data made anew from its columns of tiles, a batch at a time."""
    names = [c for c in df.columns if c not in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in inputs]
            with np.errstate(all="ignore"):
                made = [change(*(np.frombuffer(x.as_py(), kind).reshape(tile, tile) for x in row)).tobytes() for row in zip(*columns, strict=True)]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(made, pa.binary())], [*names, "data"])

    return df.mapInArrow(run, schema)


def lu_tiled(a: DataFrame, tile: int = TILE, kind: str = "float64") -> DataFrame:
    """Both factors of every matrix, packed in one, by tiles: no task holds more than a few of them.

    Step k factors the diagonal tile k, solves the tiles beside and below it,
    and takes their products from the tiles within.  Only what is within goes
    on to the next step; a step's tiles are written, which cuts the lineage.
    """
    key = a.schema["m"].dataType.simpleString()
    schema = f"m {key}, i int, j int, n int, data binary"
    now = written(tiles(a, tile, kind), "tiles")
    steps = now.agg(F.max("i")).first()[0]
    done = []
    same = lambda x, y, *on: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{d}")) for c, d in on]
    for k in range(0 if steps is None else steps + 1):
        names = ["m", "i", "j", "n"]
        diagonal = written(_by_tile(now.where(f"i = {k} and j = {k}").select(*names, F.col("data").alias("x")), schema, factor, kind, tile, "x"), "diagonal")
        edge = now.where(f"(i = {k}) <> (j = {k})").alias("t").join(diagonal.alias("d"), same("t", "d", ("m", "m")))
        edge = edge.select(*[f"t.{c}" for c in names], F.col("d.data").alias("d"), F.col("t.data").alias("x"))
        top = _by_tile(edge.where(f"i = {k}"), schema, _left_solved, kind, tile, "d", "x")
        left = _by_tile(edge.where(f"j = {k}"), schema, _right_solved, kind, tile, "d", "x")
        sides = written(top.union(left), "sides")
        done += [diagonal, sides]
        if k < steps:
            rest = now.where(f"i > {k} and j > {k}").alias("t")
            rest = rest.join(sides.where(f"j = {k}").alias("l"), same("t", "l", ("m", "m"), ("i", "i")))
            rest = rest.join(sides.where(f"i = {k}").alias("u"), same("t", "u", ("m", "m"), ("j", "j")))
            rest = rest.select(*[f"t.{c}" for c in names], F.col("t.data").alias("x"), F.col("l.data").alias("l"), F.col("u.data").alias("u"))
            new = written(_by_tile(rest, schema, lambda x, l, u: x - l @ u, kind, tile, "x", "l", "u"), "tiles")
        forget(now)
        now = new if k < steps else now
    out = a.sparkSession.createDataFrame([], schema)
    for part in done:
        out = out.union(part)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, i, j, n, data in zip(*(batch.column(x) for x in range(5)), strict=True):
                i, j, n = (x.as_py() for x in (i, j, n))
                high, wide = min(tile, n - i * tile), min(tile, n - j * tile)
                v = np.frombuffer(data.as_py(), kind).reshape(tile, tile)[:high, :wide].ravel()
                r, c = np.divmod(np.arange(high * wide, dtype="int32"), np.int32(wide))
                yield pa.RecordBatch.from_arrays([pa.array([m.as_py()] * len(v), m.type), pa.array(r + i * tile, "int32"), pa.array(c + j * tile, "int32"), pa.array(v)], ["m", "r", "c", "v"])

    return out.mapInArrow(cells, f"m {key}, r int, c int, v {_kind(kind)}")


def lu_column(rows: Column, n: int) -> Column:
    """The same of one array of rows, without Python: for small n."""

    def step(a: Column, k: Column) -> Column:
        pivot_row = a[k]
        pivot = pivot_row[k]

        def row(x: Column, i: Column) -> Column:
            f = x[k] / F.nullif(pivot, F.lit(0.0))
            new = F.transform(x, lambda v, j: F.when(j < k, v).when(j == k, f).otherwise(v - f * pivot_row[j]))
            return F.when(i > k, new).otherwise(x)

        return F.transform(a, row)

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 2)), rows, step) if n > 1 else rows


def as_arrays(a: DataFrame) -> DataFrame:
    """(m, a): one array of rows per matrix."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("c", F.col("v").cast("double").alias("v")))), lambda x: x["v"])
    rows = a.groupBy("m", "r").agg(row.alias("x"))
    return rows.groupBy("m").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "x"))), lambda x: x["x"]).alias("a"))


def reconstruction_error(a: DataFrame, factors: DataFrame) -> DataFrame:
    """(m, error): the sum of |A - L U| over each matrix; nan if a factor is."""
    product = multiply(lower_unit_triangle(factors), upper_triangle(factors)).withColumnRenamed("v", "p")
    both = a.join(product, ["m", "r", "c"], "left")
    return both.groupBy("m").agg(F.sum(F.abs(F.col("v") - F.coalesce("p", F.lit(0.0)))).alias("error"))


def wrong_places(a: DataFrame, factors: DataFrame, most: float = 1e-4) -> DataFrame:
    """Where A and L U differ by more than that."""
    product = multiply(lower_unit_triangle(factors), upper_triangle(factors)).withColumnRenamed("v", "p")
    both = a.join(product, ["m", "r", "c"], "left")
    off = F.abs(F.col("v") - F.coalesce("p", F.lit(0.0)))
    return both.where((off > most) | F.isnan(off)).select("m", "r", "c", "v", "p")
