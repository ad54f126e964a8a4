"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests import compare

NAMES = list(entry.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    diff, n = compare.difference(spark, con, name, sf_dir)
    assert not diff, diff


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(NAMES)


def test_entry_has_rows_and_a_schema(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
