"""Every registered query of the engine against its SQL, on a small copy of the tables."""

import pytest

from tessera.catalogue import QUERIES
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_same_as_sql(spark, con, name):
    assert difference(QUERIES[name].run(spark, FOLDER), con, QUERIES[name].sql) == ""


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs(spark, name):
    assert QUERIES[name].run(spark, FOLDER).count() >= 0
