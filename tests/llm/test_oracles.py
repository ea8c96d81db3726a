"""Corpus queries with SQL against DuckDB."""

import duckdb
import pytest

from lexiloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got)
    plain = lambda f: f[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert plain(got).equals(plain(want))
