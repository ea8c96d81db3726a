"""Registered queries against DuckDB at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexiloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(frame):
    cols = sorted(frame.columns)
    return cols, frame[cols].astype(str).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    if name in registry.ORACLE:
        cols, mine = plain(got)
        want_cols, want = plain(duck.execute(registry.ORACLE[name]).df())
        assert cols == want_cols
        assert mine.equals(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
