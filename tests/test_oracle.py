"""Every registered SQL plan against DuckDB."""

import os

import duckdb
import pytest

from scriptorium.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows_as_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    if name not in catalog.oracle_sql():
        assert df.count() > 0
        return
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, map(tuple, df.collect())) == _rows(columns, cursor.fetchall())
