"""Every registered query against its reference SQL, on plans with and without broadcasts."""

import oracle
import pytest

import __spark_entry__ as entry_point
from assayline.plans.reference_sql import REFERENCE_SQL as SQL
from assayline.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"

# One query per join shape: they take the other way when no side may be broadcast.
SHUFFLED = (
    "abbott_error_codes",
    "activity_enriched",
    "percent_plates_my_country_site",
    "countries_sites",
    "top_codes_model",
    "country_error_series",
    "site_error_series_filled",
    "roche_errors",
    "error_rate_site",
    "kit_error_log",
    "plate_status",
    "tests_last_year",
    "test_perc_table",
    "instruments_country",
    "nearest_lab",
)


@pytest.fixture(scope="module")
def small():
    return oracle.connect(SMALL)


@pytest.fixture(scope="module")
def medium():
    return oracle.connect(MEDIUM)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, small, name):
    found = oracle.spark_result(QUERIES[name](spark, SMALL))
    assert oracle.difference(found, oracle.duckdb_result(small, SQL[name])) is None
    assert found[1].total() > 0


@pytest.mark.parametrize("name", SHUFFLED)
def test_matches_sql_without_broadcast(spark, no_broadcast, medium, name):
    found = oracle.spark_result(QUERIES[name](spark, MEDIUM))
    assert oracle.difference(found, oracle.duckdb_result(medium, SQL[name])) is None


def test_entry(spark):
    assert entry_point.entry(spark).columns == [
        "test_month_year",
        "country_code",
        "error_type_id",
        "plates_affected",
        "plates",
        "percent",
    ]
