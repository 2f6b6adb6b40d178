"""Every registered query that has SQL gives the SQL's rows, on the smallest tables."""

import pathlib

import duckdb
import pytest

from factloom.plans import catalogue

DATA = pathlib.Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not DATA.exists():
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, con, name):
    from verify_queries import canonical

    df = catalogue.QUERIES[name](spark, str(DATA))
    con.execute(catalogue.ORACLE[name])
    columns = [d[0] for d in con.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, con.fetchall())
