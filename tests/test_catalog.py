"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from tessera import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(round(float(r[k]), 6) if isinstance(r[k], float) else str(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DIR)
    found = db.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 33
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
