"""The queries with SQL against DuckDB on the same tables."""

import pytest

from recweld.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got == want and len(got) == 200
