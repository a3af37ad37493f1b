"""Every query of the library's own operators against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import annotation, details, files, pages, queries, registry, solvers  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


def _rows(frame: pd.DataFrame) -> list[str]:
    plain = lambda v: None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    expected = duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    found = registry.QUERIES[name](spark, DATA).toPandas()
    assert sorted(found.columns) == sorted(expected.columns)
    assert _rows(found) == _rows(expected)
