"""Every query of the catalogue against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from quillsieve.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(frame):
    clean = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else x.item() if hasattr(x, "item") else x
    columns = sorted(frame.columns)
    return columns, sorted((tuple(clean(x) for x in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, small, duck, name):
    got = catalogue.queries()[name](spark, small).toPandas()
    if name in catalogue.oracle_sql():
        assert rows(got) == rows(duck.execute(catalogue.oracle_sql()[name]).df())
    else:
        assert list(got.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
