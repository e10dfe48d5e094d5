"""Every query against its SQL in DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

from volspark.plans import build, catalogue, files, flow, grids, surfaces  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    a = sorted(map(tuple, got.select(*names).collect()), key=key)
    b = sorted(want.fetchall(), key=key)
    assert len(a) == len(b) and a
    for x, y in zip(a, b, strict=True):
        assert x == y or all(p == q or (isinstance(p, float) and math.isclose(p, q, rel_tol=1e-12)) for p, q in zip(x, y, strict=True)), (x, y)
