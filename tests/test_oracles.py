"""Every query with an oracle equals it, in names, types and values; the others run."""

import duckdb
import pytest

from stridelake.plans.catalog import ORACLE, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=repr)
    if name not in ORACLE:
        assert df.schema.names
        return
    want = con.sql(f"select {', '.join(cols)} from ({ORACLE[name]})")
    assert [TYPES.get(t, t) for _, t in df.select(*cols).dtypes] == [str(t) for t in want.types]
    assert got == sorted(want.fetchall(), key=repr)
