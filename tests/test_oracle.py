"""Every query with SQL against DuckDB on the same tables; the others return rows."""

import decimal
import zlib

import pytest

from recweld.registry import oracle_sql, queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"linkage_scores", "pair_features", "gbt_scores", "oof_stack_scores"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float | decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW))
def test_returns_rows(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_crc_split(spark):
    got = queries()["crc_split"](spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 1000 < 200) for r in got)


def test_isotonic_is_monotone(spark):
    rows = sorted((r["score"], r["q"]) for r in queries()["isotonic_calibration"](spark, "/root/testdata/sf0.01").collect())
    assert all(a[1] <= b[1] + 1e-9 for a, b in zip(rows, rows[1:])) and all(0 <= q <= 1 for _, q in rows)
