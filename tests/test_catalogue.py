"""Every query with SQL against DuckDB on the smallest tables, and the shape of the entry point."""

import glob
import os

import duckdb
import pytest

from quarryline import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else str(x) if isinstance(x, (list, tuple)) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = db.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({SQL[name]})").fetchall()
    assert plain(df.select(*cols).collect()) == plain(want)


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["path", "impact", "position", "pct", "tier"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
