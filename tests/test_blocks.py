import duckdb
import numpy as np
import pytest

from tessera import queries as kernels

FOLDER = "/root/testdata/sf0.001"
WANT = {
    "matrix_from_embeddings": lambda b: b,
    "matrix_multiply": lambda b: b @ b.T,
    "upper_triangle": np.triu,
    "lower_unit_triangle": lambda b: np.where(np.eye(*b.shape) == 1, 1.0, np.tril(b)),
}


@pytest.mark.parametrize("name", list(WANT))
def test_all_embeddings_are_read(spark, name):
    vectors = dict(duckdb.sql(f"select vec_id, embedding from read_parquet('{FOLDER}/embeddings.parquet')").fetchall())
    assert sorted(vectors) == list(range(len(vectors))) and len(vectors) > 64
    x = np.array([vectors[i] for i in range(len(vectors))], "float64")
    got = {(r["m"], r["r"], r["c"]): r["v"] for r in kernels.QUERIES[name](spark, FOLDER).collect()}
    n = 0
    for m in range(-(-len(x) // 64)):
        block = WANT[name](x[64 * m : 64 * m + 64])
        for r, c in np.ndindex(block.shape):
            outside = name == "upper_triangle" and c < r or name == "lower_unit_triangle" and c > r
            assert ((m, r, c) in got) == (not outside)
            if not outside:
                n += 1
                assert got[m, r, c] == pytest.approx(block[r, c], abs=2e-6)
    assert n == len(got)
