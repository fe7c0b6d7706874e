"""Queries against their SQL, on the small tables."""

import duckdb
import pytest

from stridelake.llm.oracle import ORACLE
from stridelake.llm.queries import QUERIES

D = "/root/testdata/sf0.01"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(want, key=repr)
