"""Every query with SQL gives DuckDB's rows; every query runs."""

import duckdb
import pytest

from vellum.plans import pdf_queries, queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(round(float(v), 9) + 0.0) if hasattr(v, "as_tuple") else repr(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    if name not in queries.ORACLE:
        assert rows
        return
    r = duck.sql(queries.ORACLE[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert rows == sorted([tuple(plain(x[i]) for i in at) for x in r.fetchall()])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
