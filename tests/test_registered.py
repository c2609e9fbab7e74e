"""Every registered query against its SQL twin, on whole tables."""

import pytest

import __spark_entry__ as contract
from skyledger.operators.ordered import BLOCK_ROWS_CONF, HOT_ROWS_CONF
from skyledger.plans import catalog
from tests.compare import differences, duck

ORACLE = dict(catalog.ORACLE)
QUERIES = {name: fn for name, fn in contract.queries().items() if name in catalog.QUERIES}

# Queries whose ordered scans must give the same when every key is cut.
SPLIT = [
    "lof_departure_delay", "lof_all_types", "lof_event_fold", "crew_followup_events", "cancel_event_record",
    "times_diff", "status_diff", "prev_leg_resolved", "inbound_equipment", "stock_ledger", "order_effects",
    "stream_equipment_diff",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    text, rows = differences(spark, con, QUERIES[name], ORACLE[name], sf_dir)
    assert not text
    assert rows > 0


@pytest.mark.parametrize("name", SPLIT)
def test_split_keys_match_sql(spark, con, sf_dir, name):
    spark.conf.set(HOT_ROWS_CONF, "2")
    spark.conf.set(BLOCK_ROWS_CONF, "150")
    try:
        text, rows = differences(spark, con, QUERIES[name], ORACLE[name], sf_dir)
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
        spark.conf.unset(BLOCK_ROWS_CONF)
    assert not text
    assert rows > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
