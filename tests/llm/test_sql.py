"""The operators' queries against their SQL."""

import duckdb
import pytest

from quern.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out, df = c.sql(SQL[name]), QUERIES[name](spark, SF)
    names = sorted(df.columns)
    assert names == sorted(out.columns)
    order = [out.columns.index(x) for x in names]
    got = sorted(repr(tuple(r[x] for x in names)) for r in df.collect())
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in out.fetchall())
