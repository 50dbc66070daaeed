import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# The jobs run many steps; tests/test_jobs.py covers them on literal rows.
JOBS = {n for n in entry.queries() if n.startswith(("initial_load", "update_", "reprocess"))}

needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@needs_data
@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - JOBS))
def test_query_matches_its_sql(spark, con, name):
    problem = differences(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    if problem == "no rows at all":  # Too few readings for a month: take the next larger tables.
        problem = differences(spark, connect(LARGER), name, entry.queries()[name], entry.oracle_sql()[name], LARGER)
    assert problem is None


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["station_id", "variable", "yearday", "date_label"]
    assert df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
