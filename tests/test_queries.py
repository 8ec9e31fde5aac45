"""Every registered query of the reference's operators against its SQL, at the smallest size."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from tessera.plans import registry, search_queries, text_queries, workspace_queries  # noqa: F401  (they register themselves)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def shown(rows):
    return Counter(tuple(repr(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = shown(found.select(*columns).collect())
    if name in registry.oracle_sql():
        wanted = con.sql(registry.oracle_sql()[name])
        assert sorted(wanted.columns) == columns
        assert rows == shown(wanted.select(*columns).fetchall())
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
