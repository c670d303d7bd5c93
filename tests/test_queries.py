"""Every registered query against its oracle, on the smallest tables."""

import os

import pytest
from compare import difference, oracle

import __spark_entry__ as driver
from sigspan.plans.oracles import DUCKDB_SQL
from sigspan.plans.queries import SPARK_QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    return oracle(SF_DIR)


def test_every_query_has_an_oracle():
    assert SPARK_QUERIES.keys() == DUCKDB_SQL.keys()
    assert driver.oracle_sql().keys() <= driver.queries().keys()


@pytest.mark.parametrize("key", list(driver.oracle_sql()))
def test_query(spark, duck, key):
    assert difference(driver.queries()[key](spark, SF_DIR), duck, driver.oracle_sql()[key]) is None


def test_flagship(spark):
    if SF_DIR.endswith("sf0.001"):
        assert driver.entry(spark).count() == 133 + 10452


def test_lines_of_a_csv_file_of_many_splits(spark, duck):
    """As a file of some megabytes has them."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "100")
    try:
        assert difference(SPARK_QUERIES["sink_csv"](spark, SF_DIR), duck, DUCKDB_SQL["sink_csv"]) is None
    finally:
        spark.conf.set(name, before)
