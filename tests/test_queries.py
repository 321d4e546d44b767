"""Every query of the library against its SQL twin, and the shape of those without one."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import rows

from codeloom.plans import registry
from codeloom.plans.bindings import TABLES

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    given = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(given)
    assert rows(found.collect(), found.columns, found.columns) == rows(want.fetchall(), found.columns, given)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs_alike_twice(spark, name):
    first, again = (QUERIES[name](spark, DATA) for _ in range(2))
    assert first.columns == again.columns
    assert sorted(map(repr, first.collect())) == sorted(map(repr, again.collect()))


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
