"""The opN_ queries with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from talus.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = queries.queries()[name](spark, DIR)
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{DIR}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in df.collect())


def test_every_operator_has_a_query():
    assert sorted(int(k.split("_")[0][2:]) for k in queries.queries()) == list(range(1, 14))
