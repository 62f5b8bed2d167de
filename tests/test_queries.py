import pytest

import __spark_entry__ as entry
from workload import compare
from workload.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def database():
    return compare.database(FOLDER)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, database, name):
    _, problem = compare.compare(
        spark, database, FOLDER, entry.queries()[name], entry.oracle_sql()[name]
    )
    assert not problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0
