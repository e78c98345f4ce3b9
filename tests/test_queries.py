"""Every named query against its SQL, and the counts known of the test tables."""

import compare
import pytest
from conftest import SF, SF_LARGER

import __spark_entry__ as contract
from coldwatch.plans.catalog import catalog
from coldwatch.plans.oracle import oracle_sql

QUERIES = catalog()
SQL = oracle_sql()

PER_TYPE = {
    SF: dict(TEMP_BREACH=57, HUMIDITY_BREACH=59, DOOR_VIOLATION=48, SPEED_VIOLATION=47, LOW_FUEL=125,
             BATTERY_LOW=64, TIRE_PRESSURE_LOW=102, COMPRESSOR_FAULT=46),
    SF_LARGER: dict(TEMP_BREACH=505, HUMIDITY_BREACH=586, DOOR_VIOLATION=543, SPEED_VIOLATION=468,
                    LOW_FUEL=1140, BATTERY_LOW=670, TIRE_PRESSURE_LOW=1063, COMPRESSOR_FAULT=421),
}


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert QUERIES.keys() <= contract.queries().keys()
    assert SQL.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    types, rows = compare.spark_result(QUERIES[name](spark, SF))
    expected_types, expected = compare.duck_result(duck, SQL[name])
    assert types == expected_types
    assert rows == expected
    assert rows


def test_entry(spark):
    assert contract.entry(spark).count() == 411


@pytest.mark.parametrize("sf_dir", [SF, SF_LARGER])
def test_alerts_per_type(spark, sf_dir):
    counts = QUERIES["alerts_all"](spark, sf_dir).groupBy("alert_type").count()
    assert {r["alert_type"]: r["count"] for r in counts.collect()} == PER_TYPE[sf_dir]


def test_totals_agree(spark):
    primary = QUERIES["alerts_primary"](spark, SF)
    rows = primary.count()
    by_type = QUERIES["alerts_by_type"](spark, SF).agg({"alerts": "sum"}).first()[0]
    by_severity = QUERIES["alerts_by_severity"](spark, SF).agg({"alerts": "sum"}).first()[0]
    assert rows == by_type == by_severity == 411
    assert primary.agg({"total_alerts": "sum"}).first()[0] == sum(PER_TYPE[SF].values())
