"""The kernels as registered queries over the driver's tables, and the same in DuckDB SQL.

Money is in whole cents, so that sums are exact; everything else is integers or
rounded, so both engines can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.generators import is_prime, random_cos, random_mul, selected, xorshift32
from tessera.operators import compact as compacting
from tessera.operators import matrix, reduce, scan, sort
from tessera.plans.storage import reserved
from tessera.sources.matrices import dominant, read_written, square, write_matrices
from tessera.sources.ranges import START, scan_input, sort_input, sum_input

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("long")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_cents(name: str) -> str:
    return f"CAST(round({name} * 100) AS BIGINT)"


# What the column functions are in DuckDB.  Its shifts raise on overflow, so the bits that would fall off are masked first.
_STEPS_COS = """a AS (SELECT *, xor(x, x << 13) AS x1 FROM src), b AS (SELECT *, xor(x1, x1 >> 17) AS x2 FROM a),
 c AS (SELECT *, CAST(floor(greatest(0.0, cos(CAST(x2 AS DOUBLE)) * 123456789.0)) AS UBIGINT) AS x3 FROM b),
 d AS (SELECT *, xor(x3, x3 << 5) AS x4 FROM c),
 e AS (SELECT *, CAST((CAST(x4 AS HUGEINT) * CAST(x4 AS HUGEINT) + 9023) % 1099511627776 AS UBIGINT) AS x5 FROM d),
 f AS (SELECT *, xor(x5, x5 >> 11) AS x6 FROM e), g AS (SELECT *, CAST(xor(x6, x6 << 9) & 268435455::UBIGINT AS BIGINT) AS v FROM f)"""
_STEPS_MUL = """a AS (SELECT *, CAST((CAST(x AS HUGEINT) + 876998787696) * 35334534876231 % 18446744073709551616 AS UBIGINT) AS x1 FROM src),
 b AS (SELECT *, xor(x1, (x1 & 35184372088831::UBIGINT) << 19) AS x2 FROM a), c AS (SELECT *, xor(x2, x2 >> 23) AS x3 FROM b),
 d AS (SELECT *, xor(x3, (x3 & 2251799813685247::UBIGINT) << 13) AS x4 FROM c), e AS (SELECT *, xor(x4, x4 >> 17) AS x5 FROM d),
 f AS (SELECT *, xor(x5, (x5 & 576460752303423487::UBIGINT) << 5) AS x6 FROM e), g AS (SELECT *, CAST(x6 & 4294967295::UBIGINT AS BIGINT) AS v FROM f)"""
_STEPS_XOR = """a AS (SELECT *, xor(x, x << 13) AS x1 FROM src), b AS (SELECT *, xor(x1, x1 >> 17) AS x2 FROM a),
 g AS (SELECT *, CAST(xor(x2, (x2 & 576460752303423487::UBIGINT) << 5) & 4294967295::UBIGINT AS BIGINT) AS v FROM b)"""
_STEPS_SELECTED = """a AS (SELECT *, xor(x, x >> 11) AS x1 FROM src), b AS (SELECT *, xor(x1, (x1 & 144115188075855871::UBIGINT) << 7) AS x2 FROM a),
 g AS (SELECT *, (xor(x2, x2 >> 5) & 1::UBIGINT) = 1 AS keep FROM b)"""
_EVENT = "src AS (SELECT event_id, CAST(event_id AS UBIGINT) AS x FROM events)"


def _prime_sql(n: str) -> str:
    return f"""CASE WHEN {n} = 2 THEN true WHEN {n} % 2 = 0 THEN false
 ELSE len(list_filter(range(3, CAST(floor(sqrt({n})) AS BIGINT) + 1, 2), lambda f: {n} % f = 0)) = 0 END"""


# Sums


@registered(f"SELECT CAST(sum({_sql_cents('l_extendedprice')}) AS BIGINT) AS sum_cents FROM lineitem")
def sum_array(spark, sf_dir):
    return reduce.total(_table(spark, sf_dir, "lineitem"), cents("l_extendedprice"), name="sum_cents")


@registered(
    f"SELECT l_returnflag, l_linestatus, CAST(sum({_sql_cents('l_extendedprice')}) AS BIGINT) AS sum_cents FROM lineitem GROUP BY l_returnflag, l_linestatus"
)
def sum_array_by_flag(spark, sf_dir):
    return reduce.total(_table(spark, sf_dir, "lineitem"), cents("l_extendedprice"), ["l_returnflag", "l_linestatus"], "sum_cents")


@registered(
    "SELECT CAST(sum(v) AS BIGINT) AS total FROM (WITH src AS (SELECT CAST(1073741824 + range AS UBIGINT) AS x FROM range(0, 33555666)), " + _STEPS_COS + " SELECT v FROM g)"
)
def sum_generated(spark, sf_dir):
    return reduce.total(sum_input(spark, 33_555_666), "v")


@registered(
    "SELECT CAST(sum(v) AS BIGINT) AS total FROM (WITH src AS (SELECT CAST(1073741824 + range AS UBIGINT) AS x FROM range(0, 263378)), " + _STEPS_COS + " SELECT v FROM g)"
)
def map_sum_range(spark, sf_dir):
    return reduce.mapped_total(spark, START, 263_378, random_cos)


@registered("WITH src AS (SELECT CAST(1073741824 + event_id AS UBIGINT) AS x FROM events), " + _STEPS_COS + " SELECT CAST(sum(v) AS BIGINT) AS total FROM g")
def map_sum_random_cos(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return reduce.total(events.select(random_cos(F.col("event_id") + START).alias("v")), "v")


# Generators


@registered(f"WITH {_EVENT}, {_STEPS_XOR} SELECT event_id, v FROM g")
def xorshift_project(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", xorshift32(F.col("event_id")).alias("v"))


@registered(f"WITH {_EVENT}, {_STEPS_MUL} SELECT event_id, v FROM g")
def random_mul_project(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", random_mul(F.col("event_id")).alias("v"))


@registered(f"WITH src AS (SELECT event_id, CAST(1073741824 + event_id AS UBIGINT) AS x FROM events), {_STEPS_COS} SELECT event_id, v FROM g")
def random_cos_project(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", random_cos(F.col("event_id") + START).alias("v"))


# Primes


@registered(f"SELECT o_orderkey, {_prime_sql('o_orderkey')} AS prime FROM orders")
def prime_flags(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", is_prime(F.col("o_orderkey")).alias("prime"))


@registered(f"SELECT count(*) AS primes FROM orders WHERE {_prime_sql('o_orderkey')}")
def prime_count_orders(spark, sf_dir):
    return reduce.count_where(_table(spark, sf_dir, "orders"), is_prime(F.col("o_orderkey")), name="primes")


@registered(
    """WITH small AS (SELECT n FROM range(3, 1024, 2) t(n) WHERE len(list_filter(range(3, CAST(floor(sqrt(n)) AS BIGINT) + 1, 2), lambda f: n % f = 0)) = 0),
 struck AS (SELECT DISTINCT s.n * k.range AS n FROM small s, range(3, 349526, 2) k WHERE k.range >= s.n AND s.n * k.range < 1048578)
 SELECT 1 + (SELECT count(*) FROM range(3, 1048578, 2)) - (SELECT count(*) FROM struck) AS primes"""
)
def prime_count_range(spark, sf_dir):
    return reduce.count_primes(spark, 2, 1_048_576)


# Prefix sums


@registered(f"SELECT event_id, CAST(sum({_sql_cents('value')}) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS prefix FROM events")
def scan_events(spark, sf_dir):
    return scan.prefix_sum(_table(spark, sf_dir, "events"), cents("value"), ["event_id"]).select("event_id", "prefix")


@registered(
    f"SELECT event_id, CAST(coalesce(sum({_sql_cents('value')}) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM events"
)
def scan_exclusive_events(spark, sf_dir):
    return scan.prefix_sum(_table(spark, sf_dir, "events"), cents("value"), ["event_id"], exclusive=True).select("event_id", "prefix")


@registered(
    f"SELECT event_id, CAST(1000 + sum({_sql_cents('value')}) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS prefix FROM events"
)
def scan_initial_value(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return scan.prefix_sum(events, cents("value"), ["event_id"], ["event_type"], initial=1000, spread=True).select("event_id", "prefix")


_LINE = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"


@registered(
    f"SELECT l_suppkey, {_LINE}, CAST(sum({_sql_cents('l_extendedprice')}) OVER (PARTITION BY l_suppkey ORDER BY {_LINE} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS prefix FROM lineitem"
)
def scan_by_supplier(spark, sf_dir):
    line = _LINE.split(", ")
    return scan.prefix_sum(_table(spark, sf_dir, "lineitem"), cents("l_extendedprice"), line, ["l_suppkey"]).select("l_suppkey", *line, "prefix")


@registered(
    "SELECT CAST(m AS INTEGER) AS m, CAST(max(p) AS BIGINT) AS last, CAST(bit_xor(p) AS BIGINT) AS mixed FROM (WITH src AS (SELECT m.range AS m, CAST(i.range AS UBIGINT) AS x FROM range(0, 4) m, range(0, 4194304) i), "
    + _STEPS_XOR
    + " SELECT m, CAST(sum(v) OVER (PARTITION BY m ORDER BY x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS p FROM g) GROUP BY m"
)
def scan_generated(spark, sf_dir):
    out = scan.prefix_sum(scan_input(spark, 4_194_304, 4), "v", ["i"], ["m"], spread=True)
    return out.groupBy("m").agg(F.max("prefix").alias("last"), F.bit_xor("prefix").alias("mixed"))


# Compaction


_KEPT_ORDERS = f"WITH src AS (SELECT o_orderkey, CAST(o_orderkey AS UBIGINT) AS x FROM orders), {_STEPS_SELECTED}"


@registered(_KEPT_ORDERS + " SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM g WHERE keep")
def compact_orders(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    return compacting.compact(orders, selected(F.col("o_orderkey")), ["o_orderkey"])


@registered(
    f"WITH src AS (SELECT event_type, event_id, CAST(event_id AS UBIGINT) AS x FROM events), {_STEPS_SELECTED}"
    " SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS index FROM g WHERE keep"
)
def compact_by_type(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_type", "event_id")
    return compacting.compact(events, selected(F.col("event_id")), ["event_id"], ["event_type"])


@registered(_KEPT_ORDERS + " SELECT count(*) FILTER (WHERE keep) AS kept FROM g")
def compact_count(spark, sf_dir):
    return reduce.count_where(_table(spark, sf_dir, "orders"), selected(F.col("o_orderkey")), name="kept")


@registered(
    "WITH src AS (SELECT m.range AS m, i.range AS i, CAST(i.range AS UBIGINT) AS x FROM range(0, 4) m, range(0, 4194304) i), "
    + _STEPS_XOR.replace("g AS (SELECT *,", "g0 AS (SELECT m, i,")
    + ", h AS (SELECT m, i, CAST(v AS UBIGINT) AS x, v FROM g0), "
    + _STEPS_SELECTED.replace("a AS", "sa AS").replace("b AS", "sb AS").replace("FROM src", "FROM h").replace("FROM a)", "FROM sa)").replace("FROM b)", "FROM sb)")
    + ", k AS (SELECT m, v, row_number() OVER (PARTITION BY m ORDER BY i) - 1 AS index FROM g WHERE keep)"
    " SELECT CAST(m AS INTEGER) AS m, count(*) AS kept, CAST(max(index) AS BIGINT) AS last, CAST(bit_xor(xor(v, index)) AS BIGINT) AS mixed FROM k GROUP BY m"
)
def compact_generated(spark, sf_dir):
    """Four arrays of the published size; every kept value's index goes into mixed."""
    out = compacting.compact(scan_input(spark, 4_194_304, 4), selected(F.col("v")), ["i"], ["m"], spread=True)
    return out.groupBy("m").agg(F.count("*").alias("kept"), F.max("index").alias("last"), F.bit_xor(F.col("v").bitwiseXOR(F.col("index"))).alias("mixed"))


# Sorting


@registered(
    f"SELECT cents, row_number() OVER (ORDER BY cents) - 1 AS rank FROM (SELECT {_sql_cents('l_extendedprice')} AS cents FROM lineitem)"
)
def sort_prices(spark, sf_dir):
    return sort.ranked(_table(spark, sf_dir, "lineitem").select(cents("l_extendedprice").alias("cents")), ["cents"])


@registered(
    "SELECT rank AS place, cents AS value FROM (SELECT cents, row_number() OVER (ORDER BY cents) - 1 AS rank FROM"
    f" (SELECT {_sql_cents('l_extendedprice')} AS cents FROM lineitem)) WHERE rank IN (0, 478, (SELECT count(*) FROM lineitem) // 2,"
    " (SELECT count(*) FROM lineitem) - 324, (SELECT count(*) FROM lineitem) - 1)"
)
def sort_order_stats(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select(cents("l_extendedprice").alias("cents"))
    return sort.order_statistics(items, "cents", sort.checksum_places(items.count()))


@registered(
    "SELECT CAST(sum(v) AS BIGINT) AS checksum FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rank FROM"
    f" (WITH src AS (SELECT CAST(range AS UBIGINT) AS x FROM range(0, 1048576)), {_STEPS_MUL} SELECT v FROM g)) WHERE rank IN (0, 478, 524288, 1048252, 1048575)"
)
def sort_checksum(spark, sf_dir):
    return sort.checksum(sort_input(spark, 1_048_576), "x", 1_048_576)


@registered(
    f"""WITH t AS (SELECT event_id, {_sql_cents('value')} AS v FROM events), p AS (SELECT v AS pivot_value FROM t ORDER BY event_id LIMIT 1)
 SELECT pivot_value, count(*) FILTER (WHERE v < pivot_value) AS "left", count(*) FILTER (WHERE v >= pivot_value) - 1 AS "right" FROM t, p GROUP BY pivot_value"""
)
def partition_pivot(spark, sf_dir):
    return sort.split_counts(_table(spark, sf_dir, "events").select("event_id", cents("value").alias("v")), "event_id", "v")


@registered(
    f"""WITH t AS (SELECT event_id, {_sql_cents('value')} AS v FROM events), p AS (SELECT event_id AS pivot_at, v AS pivot_value FROM t ORDER BY event_id LIMIT 1)
 SELECT event_id, v, CASE WHEN v < pivot_value THEN 'left' ELSE 'right' END AS side FROM t, p WHERE event_id <> pivot_at"""
)
def partition_rows(spark, sf_dir):
    return sort.split(_table(spark, sf_dir, "events").select("event_id", cents("value").alias("v")), "event_id", "v")


# Matrices


def _block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as matrices of 64 rows: row vec_id mod 64 of matrix vec_id div 64."""
    vectors = _table(spark, sf_dir, "embeddings")
    m, r = F.expr("cast(floor(vec_id / 64) as int)"), F.pmod("vec_id", F.lit(64)).cast("int")
    cells = vectors.select(m.alias("m"), r.alias("r"), F.posexplode("embedding").alias("c", "v"))
    return cells.select("m", "r", "c", F.col("v").cast("double").alias("v"))


def _gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label, the products of its vectors' columns, with 64 added on the diagonal."""
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("label").alias("m"), F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "v"))
    vectors = vectors.withColumn("v", F.col("v").cast("double"))
    products = matrix.multiply(matrix.transposed(vectors), vectors)
    return products.withColumn("v", F.col("v") + F.when(F.col("r") == F.col("c"), 64.0).otherwise(0.0))


_BLOCK = (
    "b AS (SELECT CAST(vec_id // 64 AS INTEGER) AS m, CAST(vec_id % 64 AS INTEGER) AS r, CAST(i.range AS INTEGER) AS c,"
    " CAST(embedding[i.range + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) i)"
)
#: The factors of the matrices of _gram(), one elimination step after another, over lists of rows.
_FACTORS = """WITH RECURSIVE
e AS (SELECT label AS m, vec_id AS k, CAST(i.range AS INTEGER) AS c, CAST(embedding[i.range + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) i),
g AS (SELECT x.m, x.c AS r, y.c, sum(x.v * y.v) + CASE WHEN x.c = y.c THEN 64 ELSE 0 END AS v FROM e x JOIN e y ON x.m = y.m AND x.k = y.k GROUP BY x.m, x.c, y.c),
w AS (SELECT m, r, list(v ORDER BY c) AS x FROM g GROUP BY m, r),
f AS (SELECT m, 1 AS k, list(x ORDER BY r) AS a FROM w GROUP BY m
 UNION ALL SELECT m, k + 1, list_transform(a, lambda x, i: CASE WHEN i <= k THEN x ELSE
   list_transform(x, lambda v, j: CASE WHEN j < k THEN v WHEN j = k THEN v / a[k][k] ELSE v - x[k] / a[k][k] * a[k][j] END) END) FROM f WHERE k < 64),
z AS (SELECT m, a FROM f WHERE k = 64),
lu AS (SELECT m, CAST(i.range AS INTEGER) AS r, CAST(j.range AS INTEGER) AS c, a[i.range + 1][j.range + 1] AS v FROM z, range(0, 64) i, range(0, 64) j),
p AS (SELECT l.m, l.r, u.c, sum(CASE WHEN l.r = l.c THEN 1 ELSE l.v END * u.v) AS v FROM lu l JOIN lu u ON l.m = u.m AND l.c = u.r AND l.c <= l.r AND u.c >= u.r GROUP BY l.m, l.r, u.c)
"""


@registered(f"WITH {_BLOCK} SELECT m, r, c, round(v, 6) AS v FROM b")
def matrix_from_embeddings(spark, sf_dir):
    return _block(spark, sf_dir).withColumn("v", F.round("v", 6))


@registered(f"WITH {_BLOCK} SELECT x.m, x.r, y.r AS c, round(sum(x.v * y.v), 6) AS v FROM b x JOIN b y ON x.m = y.m AND x.c = y.c GROUP BY x.m, x.r, y.r")
def matrix_multiply(spark, sf_dir):
    b = _block(spark, sf_dir)
    return matrix.multiply(b, matrix.transposed(b)).withColumn("v", F.round("v", 6))


@registered(f"WITH {_BLOCK} SELECT m, r, c, round(v, 6) AS v FROM b WHERE c >= r")
def upper_triangle(spark, sf_dir):
    return matrix.upper_triangle(_block(spark, sf_dir)).withColumn("v", F.round("v", 6))


@registered(f"WITH {_BLOCK} SELECT m, r, c, CASE WHEN c = r THEN 1.0::DOUBLE ELSE round(v, 6) END AS v FROM b WHERE c <= r")
def lower_unit_triangle(spark, sf_dir):
    return matrix.lower_unit_triangle(_block(spark, sf_dir)).withColumn("v", F.round("v", 6))


@registered(_FACTORS + "SELECT m, r, c, round(v, 6) + 0.0 AS v FROM lu")
def lu_by_group(spark, sf_dir):
    return matrix.lu(_gram(spark, sf_dir)).withColumn("v", F.round("v", 6) + F.lit(0.0))


@registered(_FACTORS + "SELECT m, r, c, round(v, 6) + 0.0 AS v FROM lu")
def lu_by_tiles(spark, sf_dir):
    """The same by tiles of 16, which do not divide a matrix's work among tasks of one key."""
    return matrix.lu_tiled(_gram(spark, sf_dir), 16).withColumn("v", F.round("v", 6) + F.lit(0.0))


@registered()
def lu_512(spark, sf_dir):
    """A matrix of the larger published size in single precision, by tiles of 128."""
    return matrix.lu_tiled(square(spark, 512, dominant(512)), 128, "float32")


@registered(_FACTORS + "SELECT g.m, sum(abs(g.v - coalesce(p.v, 0))) < 1e-6 AS small FROM g LEFT JOIN p USING (m, r, c) GROUP BY g.m")
def lu_error(spark, sf_dir):
    a = _gram(spark, sf_dir)
    return matrix.reconstruction_error(a, matrix.lu(a)).select("m", (F.col("error") < 1e-6).alias("small"))


@registered(_FACTORS + "SELECT g.m, count(*) FILTER (WHERE abs(g.v - coalesce(p.v, 0)) > 1e-4 OR isnan(p.v)) AS wrong FROM g LEFT JOIN p USING (m, r, c) GROUP BY g.m")
def lu_verify(spark, sf_dir):
    a = _gram(spark, sf_dir)
    wrong = matrix.wrong_places(a, matrix.lu(a)).groupBy("m").agg(F.count("*").alias("n"))
    return a.select("m").distinct().join(wrong, "m", "left").select("m", F.coalesce("n", F.lit(0)).cast("long").alias("wrong"))


@registered(
    "WITH e AS (SELECT label AS m, vec_id AS k, CAST(i.range AS INTEGER) AS c, CAST(embedding[i.range + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) i)"
    " SELECT CAST(x.m AS INTEGER) AS m, x.c AS r, y.c, round(sum(x.v * y.v) + CASE WHEN x.c = y.c THEN 64 ELSE 0 END, 6) + 0.0 AS v"
    " FROM e x JOIN e y ON x.m = y.m AND x.k = y.k GROUP BY x.m, x.c, y.c"
)
def matrix_files(spark, sf_dir):
    """Matrices written as text files and read again; labels are numbered from 0, so that m stays."""
    path = reserved(spark, "matrix-files")
    write_matrices(_gram(spark, sf_dir), path)
    return read_written(spark, path).withColumn("v", F.round("v", 6) + F.lit(0.0))


@registered("SELECT CAST(vec_id // 64 AS INTEGER) AS m, CAST(64 AS INTEGER) AS n FROM embeddings GROUP BY 1")
def matrix_size(spark, sf_dir):
    return matrix.size(_block(spark, sf_dir))


@registered(f"WITH {_BLOCK} SELECT m, c, round(v, 6) AS v FROM b WHERE r = 3 AND c BETWEEN 32 AND 63")
def matrix_row_part(spark, sf_dir):
    return matrix.row_part(_block(spark, sf_dir), 3, 32, 32).withColumn("v", F.round("v", 6))


@registered(f"WITH {_BLOCK} SELECT m, round(v, 6) AS v FROM b WHERE r = 1 AND c = 2")
def matrix_element(spark, sf_dir):
    return matrix.element(_block(spark, sf_dir), 1, 2).withColumn("v", F.round("v", 6))
