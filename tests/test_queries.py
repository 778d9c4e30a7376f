"""Every query with SQL against DuckDB at the smallest scale; the others for their form."""

import os

import pytest

from quillspark.plans import catalogue

from .oracle import assert_same, database

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert_same(catalogue.queries()[name](spark, FOLDER).toPandas(), con.sql(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_gives_rows(spark, name):
    if name == "bench_results" and not os.environ.get("SLOW_TESTS"):
        pytest.skip("minutes; set SLOW_TESTS to run it.  test_synthesizer runs the comparison on one dataset")
    found = catalogue.queries()[name](spark, FOLDER).toPandas()
    assert len(found) and found.notna().any().all()


def test_entry_module_agrees():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
