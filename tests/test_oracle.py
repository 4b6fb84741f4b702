"""Every query with SQL against DuckDB."""

import duckdb
import pytest
from asterism.jobs.oracle import ORACLE_SQL
from asterism.jobs.queries import QUERIES

TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in ("embeddings", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, tables, name):
    df = QUERIES[name](spark, sf_dir)
    want = tables.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert {c: TYPES[k] for c, k in df.dtypes} == {c: str(k) for c, k in zip(want.columns, want.types, strict=True)}
    near = lambda v: round(v, 5) if isinstance(v, float) else v
    a = sorted((tuple(near(r[c]) for c in cols) for r in df.collect()), key=str)
    b = sorted((tuple(near(v) for v in (r[want.columns.index(c)] for c in cols)) for r in want.fetchall()), key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y or all(u == v or (isinstance(u, float) and abs(u - v) < 2e-5) for u, v in zip(x, y, strict=True))


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
