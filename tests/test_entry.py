import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import queries as kernels
from tessera.plans import storage, timing

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            c.sql(f"create view {f[:-8]} as select * from read_parquet('{FOLDER}/{f}')")
    return c


@pytest.mark.parametrize("name", list(kernels.QUERIES))
def test_query_is_its_sql(spark, duck, name):
    folder = storage.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with storage.scope():
        got = kernels.QUERIES[name](spark, FOLDER)
        rows = sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=str)
    assert set(os.listdir(folder)) <= before
    if name not in kernels.ORACLE_SQL:
        assert name == "lu_512" and rows
        return
    want = duck.sql(kernels.ORACLE_SQL[name])
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in names)
    assert rows == sorted(duck.sql(f"select {quoted} from ({kernels.ORACLE_SQL[name]})").fetchall(), key=str)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_results_are_written_and_read(spark, tmp_path):
    seconds, value = timing.mean_seconds(lambda: 42, 2)
    assert value == 42 and seconds >= 0
    with pytest.raises(ValueError, match="first"):
        timing.mean_seconds(iter(range(9)).__next__)
    found = timing.speedups(8.0, {"window": {1: 8.0, 2: 4.0}, "spread": {1: 10.0, 2: 2.0}})
    timing.write_result(tmp_path / "scan.dat", "Scan", "one core", found)
    timing.write_plot(tmp_path / "scan.plot", "Scan", "scan.dat", list(found))
    rows = timing.read_results(spark, str(tmp_path / "scan.dat"), "here").collect()
    assert sorted(map(tuple, rows)) == [("Scan", "here", "spread", 1, pytest.approx(0.8)), ("Scan", "here", "spread", 2, 4.0), ("Scan", "here", "window", 1, 1.0), ("Scan", "here", "window", 2, 2.0)]
