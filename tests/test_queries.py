"""Every query of the core beside its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from loomgraph.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return ("nan" if v != v else f"{v:.5g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [*catalogue.queries()])
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    sql = catalogue.oracle_sql().get(name)
    if sql:
        cur = db.execute(sql)
        theirs = [c[0] for c in cur.description]
        assert sorted(theirs) == cols
        assert rows == sorted(tuple(plain(r[theirs.index(c)]) for c in cols) for r in cur.fetchall())


def test_sql_names_are_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
