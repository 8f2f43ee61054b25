"""Every query with SQL returns what DuckDB returns for it."""

import duckdb
import pytest

from tests.test_catalogue import TABLES, _rows
from tipline.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(oracles.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())
