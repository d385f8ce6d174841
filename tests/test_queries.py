"""Every registered query against its SQL, on the smallest data set."""

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck_rows, spark_rows


@pytest.fixture(scope="module")
def results(spark, folder):
    """Futures of all queries; a session takes jobs from several threads."""
    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(lambda run: spark_rows(run(spark, folder)), run) for name, run in entry.queries().items()}


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["location", "sequence_number", "shots", "first_us", "last_us", "duration_s"]


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(results, folder, name):
    got = results[name].result()
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        assert compare(got, duck_rows(folder, sql)) is None
