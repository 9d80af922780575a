import os

import pytest

import __spark_entry__ as entry
from registry.check import compare, database

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_agrees_with_sql(spark, connection, name):
    result = compare(spark, connection, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert result.startswith(("equal", "rows only")), result


def test_scan_findings_with_copies_within_a_repository(spark):
    # sf0.001 holds none
    folder = "/root/testdata/sf0.01"
    result = compare(spark, database(folder), folder, "scan_findings", entry.queries()["scan_findings"], entry.oracle_sql()["scan_findings"])
    assert result.startswith("equal"), result


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "repo_id"
