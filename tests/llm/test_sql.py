import duckdb
import pytest

from tessera.llm.queries import QUERIES
from tessera.llm.sql import ORACLE_SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.sql(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    got = QUERIES[name](spark, FOLDER)
    rows = sorted(map(tuple, got.select(*sorted(got.columns)).collect()))
    assert rows == sorted(duck.sql(f"select {', '.join(sorted(got.columns))} from ({ORACLE_SQL[name]})").fetchall())
