"""Errors per test, second generation: each code of a test counted once, divided by tests.

All codes of a list count; ``max_codes`` cuts longer lists, as reports with 9 code columns did.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.functions import dates, text
from assayline.functions.nulls import percent
from assayline.operators.cleaning import instruments, model_family
from assayline.operators.lookups import attach, attach_instrument
from assayline.operators.code_rates import CODE, placed_tally
from assayline.operators.ordering import first_value

# Names of the first code slots, as fixed values; later slots are named by their number.
SLOTS = "abcdefghi"
# The one code whose description the reports replace, as fixed values.
OVERRIDES = {"6282.36": "Pipetted volume was not sufficient. Sample was not transferred"}


def _family(master: DataFrame) -> DataFrame:
    return model_family(instruments(master))


def descriptions(error_type: DataFrame, supplier_id: int = 1000) -> DataFrame:
    """One description per code of a supplier: of several the first in the file if the table has positions, else in alphabetical
    order."""
    own = error_type.filter(F.col("supplier_id") == supplier_id)
    return own.groupBy(F.col("error_type_id").alias(CODE)).agg(first_value(own, "error_type_description"))


def site_names(site: DataFrame) -> DataFrame:
    """One name per site, chosen like descriptions."""
    return site.groupBy("supplier_site_id").agg(first_value(site, "supplier_site_name"))


def _described(df: DataFrame, error_type: DataFrame, supplier_id: int, counted: bool = True) -> DataFrame:
    # On counted rows any join will do; only a fact-sized input is worth a size check.
    named = attach(df, descriptions(error_type, supplier_id), CODE, small=False if counted else None)
    shown = F.col("error_type_description")
    for code, replacement in OVERRIDES.items():
        shown = F.when(F.col(CODE) == code, F.lit(replacement)).otherwise(shown)
    return named.withColumn("error_type_description", shown)


def test_errors(
    activity: DataFrame,
    master: DataFrame,
    error_type: DataFrame,
    site: DataFrame,
    supplier_id: int = 1000,
    max_codes: int | None = None,
) -> DataFrame:
    """One row per test and different code, and one for each test without a code (``00`` models only).

    A repeated code keeps its lowest slot. That is decided inside the code list of the test, so rows
    are never shuffled. ``internal_id`` is built from the record key.
    """
    placed = attach_instrument(activity, _family(master), site_names(site), how="inner")
    listed = placed.withColumn("codes", text.code_array(F.col(CODE), max_codes)).drop(CODE)
    long = listed.withColumn(CODE, F.explode_outer(F.array_distinct("codes")))
    slot = F.coalesce(F.array_position(F.col("codes"), F.col(CODE)), F.lit(1)).cast("int")
    name = F.when(slot <= len(SLOTS), F.substring(F.lit(SLOTS), slot, F.lit(1))).otherwise(slot.cast("string"))
    named = _described(long.withColumn("name", name), error_type, supplier_id, counted=False)
    return named.select(
        F.concat(F.lit("INTERNAL-"), F.col("record_key").cast("string")).alias("internal_id"),
        "name",
        CODE,
        "error_type_description",
        "instrument_id",
        "instrument_model",
        "supplier_site_id",
        "supplier_site_name",
        "country_code",
        "test_type_id",
        "test_date",
        "is_patient_test",
        "is_control_test",
        "patient_test_error_flag",
        "control_test_error_flag",
        "excluded_test",
        dates.month_name_label(F.col("test_date")).alias("test_month_year"),
    )


def _rate(
    activity: DataFrame,
    by: Sequence[str],
    tests_by: Sequence[str],
    master: DataFrame,
    site: DataFrame | None,
    error_type: DataFrame,
    supplier_id: int,
    max_codes: int | None,
) -> DataFrame:
    """``n`` per ``by`` and code, as a percentage of the tests of its ``tests_by`` group."""
    counts = placed_tally(
        activity,
        by,
        _family(master),
        None if site is None else site_names(site),
        how="inner",
        month=dates.month_floor(F.col("test_date")) if "month" in by else None,
        max_codes=max_codes,
        once_per_test=True,
    )
    # Counted rows only: a group of this window holds one row per code and finer key.
    run = F.sum("tests").over(Window.partitionBy(*tests_by))
    rated = counts.withColumn("tests_run", run).drop("tests").filter(F.col(CODE).isNotNull())
    return _described(rated, error_type, supplier_id).withColumn("error_percent", percent("n", "tests_run"))


def error_share_all(
    activity: DataFrame,
    master: DataFrame,
    error_type: DataFrame,
    supplier_id: int = 1000,
    total_tests: int | None = None,
    max_codes: int | None = None,
) -> DataFrame:
    """Each code as a percentage of all tests, or of a given number of tests; largest first."""
    counts = placed_tally(activity, [], _family(master), how="inner", max_codes=max_codes, once_per_test=True)
    # One row per code, tests without codes under the NULL code: all tests are their sum, over counted rows only as in _rate.
    total = F.sum("tests").over(Window.partitionBy()) if total_tests is None else F.lit(total_tests)
    counts = counts.select(CODE, "n", total.alias("total")).filter(F.col(CODE).isNotNull())
    shares = _described(counts, error_type, supplier_id).withColumn("error_percent", percent("n", "total"))
    return shares.select(CODE, "error_type_description", "n", "error_percent").orderBy(F.desc("error_percent"), CODE)


def error_rate_site(
    activity: DataFrame,
    master: DataFrame,
    error_type: DataFrame,
    site: DataFrame,
    supplier_id: int = 1000,
    max_codes: int | None = None,
) -> DataFrame:
    """Each code per country and site name, as a percentage of the tests under that site name."""
    by, tests_by = ["country_code", "supplier_site_name"], ["supplier_site_name"]
    rates = _rate(activity, by, tests_by, master, site, error_type, supplier_id, max_codes)
    return rates.select(
        "country_code", "supplier_site_name", CODE, "error_type_description", "n", "tests_run", "error_percent"
    ).orderBy("supplier_site_name", F.desc("error_percent"), CODE)


def error_rate_instrument(
    activity: DataFrame,
    master: DataFrame,
    error_type: DataFrame,
    site: DataFrame,
    supplier_id: int = 1000,
    max_codes: int | None = None,
) -> DataFrame:
    """Each code per instrument, as a percentage of the tests of that instrument."""
    by = ["instrument_id", "instrument_model", "country_code", "supplier_site_name"]
    rates = _rate(activity, by, ["instrument_id"], master, site, error_type, supplier_id, max_codes)
    return rates.select(*by, CODE, "error_type_description", "n", "tests_run", "error_percent").orderBy(
        "supplier_site_name", F.desc("error_percent"), CODE
    )


def error_rate_month(
    activity: DataFrame,
    master: DataFrame,
    error_type: DataFrame,
    supplier_id: int = 1000,
    max_codes: int | None = None,
) -> DataFrame:
    """Each code per country and month, as a percentage of the tests of that country and month."""
    by = ["country_code", "month"]
    rates = _rate(activity, by, by, master, None, error_type, supplier_id, max_codes)
    return rates.orderBy("month", F.desc("error_percent"), CODE).select(
        "country_code",
        dates.month_name_label(F.col("month")).alias("test_month_year"),
        CODE,
        "error_type_description",
        "n",
        "tests_run",
        "error_percent",
    )
