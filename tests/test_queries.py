"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks import compare
from checks.queries import REGISTRY
from tests.conftest import SF


@pytest.fixture(scope="module")
def db():
    return compare.tables(SF)


def test_entry(spark):
    assert entry.entry(spark).first().asDict() == {"CRITICAL": 260, "HIGH": 180, "MEDIUM": 40, "LOW": 20}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", REGISTRY)
def test_query(spark, db, name):
    ok, message = compare.compare(spark, db, SF, name)
    assert ok, message
