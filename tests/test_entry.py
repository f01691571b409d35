import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", ["centrality", "text_search", "communities", "p2_found", "p3_found", "file_delta", "project_status", "maintenance_report", "chunked_files", "thompson_search"])
def test_queries_run(spark, name):
    df = entry.queries()[name](spark, SMALL)
    assert len(df.collect()) >= 0 and len(set(df.columns)) == len(df.columns)
