"""Each query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from talus.plans import catalog, evaluation, files, joins, kept, matching, older, pages, people, reshape, scores, sources, staged, websites  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def table_of(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], [tuple(plain(r[k]) for k in order) for r in rows]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = table_of([tuple(r) for r in df.collect()], df.columns)
    rel = db.execute(catalog.SQL[name])
    names = [d[0] for d in rel.description]
    want = table_of(rel.fetchall(), names)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert sorted(map(str, got[1])) == sorted(map(str, want[1]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
