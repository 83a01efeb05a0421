import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.generators import is_prime, random_cos, selected
from tessera.operators import compact, matrix, reduce, scan, sort
from tessera.plans import lud, storage, suite
from tessera.sources import matrices, ranges


def one(df):
    return df.first()[0]


def test_published_sums_and_counts(spark):
    assert one(reduce.mapped_total(spark, ranges.START, 263_378, random_cos)) == 18_308_219_158_952
    assert one(reduce.mapped_total(spark, ranges.START, 1_049_810, random_cos)) == 72_910_026_179_690
    assert one(reduce.count_primes(spark, 2, 1_048_576)) == 82_025
    assert one(reduce.count_primes(spark, 0, 10)) == 5  # 1, 2, 3, 5 and 7


def test_prime_counts_with_and_without_a_table(spark, monkeypatch):
    want = one(spark.range(5000, 9000).where(is_prime(F.col("id"))).agg(F.count("*")))
    assert one(reduce.count_primes(spark, 5000, 4000)) == want
    assert one(reduce.count_primes(spark, 5000, 4000, segment=77)) == want
    assert one(reduce.count_primes(spark, 5, 0)) == 0
    far = 1 << 40
    assert one(reduce.count_primes(spark, far, 2000)) == sum(all(n % f for f in range(3, 1 << 20, 2)) for n in range(far + 1, far + 60, 2)) + one(reduce.count_primes(spark, far + 60, 1940))


def test_published_scan(spark):
    out = scan.prefix_sum(ranges.scan_input(spark, 1 << 18).drop("m"), "v", ["i"])
    assert one(out.agg(F.max("prefix"))) == 562_949_953_290_240


@pytest.mark.parametrize("spread", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_scans_of_groups(spark, spread, exclusive):
    rng = np.random.default_rng(2)
    rows = [(g, i, int(v)) for g, n in ((None, 5), (1, 1), (2, 300), (3, 777)) for i, v in enumerate(rng.integers(-9, 9, n))]
    rows[3] = (None, 3, None)
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "g int, i long, v long")
    want, sums = {}, {}
    for g, i, v in rows:
        before = sums.get(g, 7)
        sums[g] = before + (v or 0)
        want[g, i] = before if exclusive else sums[g]
    out = scan.prefix_sum(df, "v", ["i"], ["g"], initial=7, exclusive=exclusive, spread=spread)
    assert out.columns == ["g", "i", "v", "prefix"]
    assert {(r["g"], r["i"]): r["prefix"] for r in out.collect()} == want


def test_scan_of_nothing_and_of_everything_in_many_partitions(spark):
    df = spark.range(10_001).select((F.col("id") * 7 % 10_001).alias("i")).repartition(13)
    got = scan.prefix_sum(df, "i", ["i"]).collect()
    assert all(r["prefix"] == r["i"] * (r["i"] + 1) // 2 for r in got) and len(got) == 10_001
    assert scan.prefix_sum(df.limit(0), "i", ["i"]).count() == 0


def test_global_scan_has_no_single_task(spark):
    plan = scan.prefix_sum(spark.range(100), "id", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2  # over partitions' sums, and inside partitions


def test_compaction(spark):
    df = ranges.scan_input(spark, 1 << 18, 1)
    assert one(reduce.count_where(df, selected(F.col("v")))) == 131_072
    groups = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("i"))
    for spread in (False, True):
        out = compact.compact(groups, F.col("i") % 5 != 0, ["i"], ["g"], spread=spread).collect()
        for g in range(3):
            kept = sorted((r["index"], r["i"]) for r in out if r["g"] == g)
            assert kept == list(enumerate(i for i in range(1000) if i % 3 == g and i % 5))
    assert compact.compact(groups, F.lit(False), ["i"]).count() == 0
    assert [r["index"] for r in compact.compact(groups, F.lit(True), ["i"]).orderBy("i").collect()] == list(range(1000))


def test_published_sort_checksums(spark):
    assert one(sort.checksum(ranges.sort_input(spark, 1 << 18), "x", 1 << 18)) == 10_742_766_094


def test_sorting_with_ties(spark):
    rng = np.random.default_rng(3)
    xs = rng.integers(0, 50, 2000).tolist()
    df = spark.createDataFrame([(x,) for x in xs], "x long").repartition(7)
    got = {r["rank"]: r["x"] for r in sort.ranked(df, ["x"]).collect()}
    assert [got[i] for i in range(2000)] == sorted(xs)
    stats = sort.order_statistics(df, "x", [0, 0, 1999]).collect()
    assert sorted((r["place"], r["value"]) for r in stats) == [(0, min(xs)), (0, min(xs)), (1999, max(xs))]


def test_published_partition(spark):
    r = sort.split_counts(ranges.sort_input(spark, 1 << 20), "i", "x").first()
    assert tuple(r) == (1_441_980_778, 351_999, 696_576)


@pytest.mark.parametrize("xs", [[5, 5, 5], [1, 2, 3, 9], [9, 1, 2, 3], [4], [4, 8, 4, 1]])
def test_partition_sides(spark, xs):
    df = spark.createDataFrame(list(enumerate(xs)), "i long, x long")
    rows = sort.split(df, "i", "x").collect()
    assert sorted((r["i"], r["side"]) for r in rows) == [(i, "left" if x < xs[0] else "right") for i, x in enumerate(xs) if i]
    r = sort.split_counts(df, "i", "x").first()
    assert (r["left"], r["left"] + r["right"] + 1) == (sum(x < xs[0] for x in xs), len(xs))


def dense(df, n):
    out = {}
    for r in df.collect():
        out.setdefault(r["m"], np.zeros((n, n)))[r["r"], r["c"]] = r["v"]
    return out


@pytest.mark.parametrize("n", [1, 2, 33])
def test_lu_reconstructs(spark, n):
    a = matrices.square(spark, n, matrices.dominant(n), 3)
    f = matrix.lu(a)
    assert all(r["error"] < 1e-9 for r in matrix.reconstruction_error(a, f).collect())
    assert matrix.wrong_places(a, f).count() == 0
    mine = dense(f, n)
    for m, x in dense(a, n).items():
        assert np.allclose((np.tril(mine[m], -1) + np.eye(n)) @ np.triu(mine[m]), x)
    rows = matrix.as_arrays(a).select("m", matrix.lu_column(F.col("a"), n).alias("a")).collect()
    assert all(np.allclose(np.array(r["a"]), mine[r["m"]]) for r in rows)


def test_lu_of_the_published_size_in_single_precision(spark):
    a = matrices.square(spark, 512, matrices.dominant(512)).withColumn("v", F.col("v").cast("float"))
    error = matrix.reconstruction_error(a, matrix.lu(a, "float32")).first()["error"]
    assert error <= 10 and not math.isnan(error)


def test_lu_of_special_matrices(spark):
    identity = matrices.square(spark, 5, F.when(F.col("r") == F.col("c"), 1.0).otherwise(0.0))
    assert (dense(matrix.lu(identity), 5)[0] == np.eye(5)).all()
    flat = matrices.square(spark, 4, F.lit(10.0))
    assert matrix.wrong_places(flat, matrix.lu(flat)).count() > 0  # a zero pivot shows
    found = matrix.lu(flat).where("isnan(v) or abs(v) = double('inf')").count()
    assert found > 0


def test_triangles_products_and_printing(spark):
    a = matrices.square(spark, 6, F.hash("r", "c") % 10 / 2.0, 2)
    x = dense(a, 6)
    for got, want in ((matrix.upper_triangle(a), np.triu), (matrix.lower_unit_triangle(a), lambda v: np.tril(v, -1) + np.eye(6)), (matrix.transposed(a), np.transpose), (matrix.multiply(a, a), lambda v: v @ v)):
        assert all(np.allclose(y, want(x[m])) for m, y in dense(got, 6).items())
    assert matrix.printed(a).where("m = 0 and r = 2").first()["line"] == " ".join(str(v) for v in x[0][2])


def test_matrix_files(spark, tmp_path):
    a = matrices.square(spark, 7, matrices.dominant(7))
    for name in ("a.dat", "b.dat"):
        matrices.write_matrix(a, str(tmp_path / name))
    got = dense(matrices.read_matrices(spark, str(tmp_path), "double"), 7)
    assert len(got) == 2 and all(np.allclose(x, dense(a, 7)[0]) for x in got.values())
    for text in ("2\n1 2\n", "2\n1 2\n3\n", "2\n1 2\n3 x\n", "x\n1\n"):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad" / "c.dat").write_text(text)
        with pytest.raises(Exception, match="."):
            matrices.read_matrices(spark, str(tmp_path / "bad")).collect()


@pytest.mark.parametrize(("n", "tile"), [(1, 4), (4, 4), (33, 8), (40, 64)])
def test_lu_by_tiles_is_lu(spark, n, tile):
    a = matrices.square(spark, n, matrices.dominant(n), 3).where("r <= c or m <> 1")  # places left out are zeros
    want, got = dense(matrix.lu(a), n), dense(matrix.lu_tiled(a, tile), n)
    assert want.keys() == got.keys() and all(np.allclose(want[m], got[m]) for m in want)
    assert matrix.lu_tiled(a.limit(0), tile).count() == 0


def test_lu_by_tiles_of_the_published_size(spark):
    a = matrices.square(spark, 512, matrices.dominant(512)).withColumn("v", F.col("v").cast("float"))
    x, f = dense(a, 512)[0], dense(matrix.lu_tiled(a, 128, "float32"), 512)[0]
    error = np.abs(x - (np.tril(f, -1) + np.eye(512)) @ np.triu(f)).sum()
    assert error <= 10 and not math.isnan(error)


def test_lu_keeps_the_kind_of_its_keys(spark):
    rows = [(m, r, c, 1.0 + (r == c)) for m in (None, 1 << 40) for r in range(3) for c in range(3)]
    a = spark.createDataFrame(rows, "m long, r int, c int, v double")
    for f in (matrix.lu(a), matrix.lu_tiled(a, 2)):
        assert {r["m"] for r in f.collect()} == {None, 1 << 40} and f.count() == 18
    with pytest.raises(Exception, match="two values"):
        matrix.lu(a.union(a)).collect()


def test_generated_matrices(spark):
    a = matrices.product_of_factors(spark, 9, 2)
    assert all(r["error"] < 1e-9 for r in matrix.reconstruction_error(a, matrix.lu(a)).collect())
    flat = dense(matrices.square(spark, 4, matrices.toeplitz()), 4)[0]
    assert (flat == 10).all()
    band = dense(matrices.square(spark, 4, matrices.toeplitz(lambda d: 1.0 / (d + 1))), 4)[0]
    assert np.allclose(band, [[1 / (abs(i - j) + 1) for j in range(4)] for i in range(4)])


def test_access_to_matrices(spark):
    a = matrices.square(spark, 5, matrices.dominant(5), 2)
    x = dense(a, 5)
    assert {r["m"]: r["n"] for r in matrix.size(a).collect()} == {0: 5, 1: 5}
    assert {r["m"]: r["v"] for r in matrix.element(a, 2, 3).collect()} == {m: x[m][2, 3] for m in x}
    assert {(r["m"], r["c"]): r["v"] for r in matrix.row_part(a, 1, 2, 2).collect()} == {(m, c): x[m][1, c] for m in x for c in (2, 3)}


@pytest.mark.parametrize("held", [10, 1_000_000])
def test_order_statistics_with_nulls_and_hot_values(spark, monkeypatch, held):
    monkeypatch.setattr(sort, "HELD", held)
    rng = np.random.default_rng(5)
    xs = [None] * 7 + [3.5] * 4000 + rng.normal(size=4000).tolist()
    df = spark.createDataFrame([(x,) for x in rng.permutation(np.array(xs, object)).tolist()], "x double").repartition(5)
    order = sorted(xs, key=lambda x: (x is not None, x))
    places = [0, 6, 7, 8, 2000, 4000, 4007, 7000, len(xs) - 1, len(xs) - 1, len(xs), -1]
    got = sorted((r["place"], r["value"]) for r in sort.order_statistics(df, "x", places, accuracy=50).collect())
    assert got == sorted(((p, order[p]) for p in places if 0 <= p < len(xs)), key=lambda t: t[0])
    assert sort.order_statistics(df.limit(0), "x", [0]).count() == 0


def test_scopes_leave_nothing_behind(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    df = spark.range(5)
    with storage.scope() as keep:
        first, second = storage.written(df, "a"), storage.written(df, "b")
        keep.append(second._tessera_path)
    assert second.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST|not exist"):
        spark.read.parquet(first._tessera_path)
    storage.forget(second)
    assert before is None or before == spark.conf.get("spark.checkpoint.dir")


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "local-cluster[2,1,512]"
            getConf = staticmethod(dict)

        conf = {}

    with pytest.raises(ValueError, match="share"):
        storage.shared_dir(Cluster)


def test_lud_from_the_command_line(spark, tmp_path, capsys):
    matrices.write_matrix(matrices.square(spark, 6, matrices.dominant(6)), str(tmp_path / "six.dat"))
    assert lud.main(["-i", str(tmp_path / "six.dat"), "-m", "2", "-v"], spark) > 0
    assert "0 places are wrong" in capsys.readouterr().out
    lud.main(["-s", "5", "--kind", "product", "-v"], spark)
    assert "0 places are wrong" in capsys.readouterr().out
    lud.main(["-s", "4", "-v"], spark)  # all entries alike: there are no factors
    assert "\n0 places" not in capsys.readouterr().out
    with pytest.raises(SystemExit):
        lud.main([], spark)


def test_published_cases(spark):
    found = {c.name: c for c in suite.cases()}
    assert len(found) == 27 and len(list(suite.cases(1))) == 11
    for name in ("sum-function-263378", "primes", "lud-256-1"):
        assert found[name].run(spark) == found[name].expected
