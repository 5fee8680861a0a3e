"""Every registered query against its SQL on the smallest data."""

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
import check_oracles as check  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    got = check.rows(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got  # what SQL can't say is tested elsewhere
        return
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == check.rows(cols, cur.fetchall())
