"""Every registered query against its SQL, and the driver's contract."""

import pytest

import __spark_entry__ as contract
from checks.compare import connect, difference
from checks.oracle import ORACLE
from checks.queries import QUERIES
from tests.conftest import SF

# Sizes known for the adapter at this scale.
ROWS = {
    "enriched_events": 9943,
    "kpi_hour": 2073,
    "kpi_minute": 7701,
    "zscore_backfill": 133,
    "stream_buckets": 718,
}


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    assert len(got) == ROWS.get(name, len(got))
    assert difference(got, db.execute(ORACLE[name]).df()) is None


def test_known_totals(spark):
    row = QUERIES["session_funnel"](spark, SF).first()
    assert tuple(row)[:4] == (3984, 2626, 1592, 1594)
    assert (row["view_to_cart_rate"], row["cart_to_order_rate"]) == (0.606245, 1.001256)
    lost = QUERIES["cart_abandonment_sessions"](spark, SF).first()
    assert (lost["abandoned_sessions"], lost["cart_sessions"]) == (1004, 1592)


def test_contract(spark):
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= contract.queries().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()
    assert contract.entry(spark).count() > 0
