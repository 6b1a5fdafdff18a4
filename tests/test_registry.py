"""The registered queries: names, SQL, and a few of them end to end against DuckDB at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUICK = ["gold_zone_day_pu", "quality_counts", "reconcile_layers", "flow_matrix", "k_anonymity_documents", "stream_append_closed"]

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    rows, problem = compare(spark, connect(FOLDER), FOLDER, name)
    assert problem == "" and rows > 0


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
