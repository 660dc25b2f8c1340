"""Every registered image query against its SQL, and the driver's entry point."""

import duckdb
import pytest

from pixelloom.plans.queries import ORACLES, QUERIES


def plain(v):
    return int(v) if isinstance(v, (float, bool)) and float(v).is_integer() else v


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, db, name):
    got = QUERIES[name](spark, sf)
    want = db.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted(([plain(v) for v in r] for r in got.select(*columns).collect()), key=str)
    assert rows and rows == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
