"""Some registered queries against DuckDB; ``oracle_check.py`` runs all of them."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from spanveil.plans.oracles import all_oracles
from spanveil.plans.queries import all_queries
from tests.oracle_check import difference, duck

SMALL = "/root/testdata/sf0.001"
SOME = ["text_extraction", "detect_phone", "detect_all", "sanitize_mask", "daily_trend", "log_uploads", "role_violations"]


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, connection, name):
    assert difference(spark, connection, queries()[name], oracle_sql()[name], SMALL) is None


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    # Other packages may have queries beyond SQL, but no SQL without a query.
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 200
