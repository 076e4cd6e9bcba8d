"""The queries that SQL can express, against their SQL."""

import duckdb
import pytest

from docfoundry.llm import queries
from tests.test_queries import TABLES, rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = c.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF)
    got, want = rows(df.columns, [tuple(x) for x in df.collect()]), rows(r.columns, r.fetchall())
    assert got == want and got[1]
