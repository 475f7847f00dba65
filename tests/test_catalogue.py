"""Every registered relational query against its DuckDB oracle."""

import duckdb
import pytest

from granary.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_parity(spark, duck, name):
    frame = catalogue.queries()[name](spark, DATA)
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(columns)
    order = [frame.columns.index(c) for c in columns]
    ours = sorted((tuple(r[k] for k in order) for r in frame.collect()), key=repr)
    theirs = sorted(found.fetchall(), key=repr)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())
