"""Reagent and kit errors of one instrument model, and plates lost to control errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.functions.nulls import sum_na
from assayline.operators.cleaning import instruments, split_record_id
from assayline.operators.lookups import attach, attach_instrument
from assayline.operators.ordering import first_value
from assayline.sources.lab_csv import POSITION

KIT_MODEL = "m2000rt"
# The four control errors that make up most kit errors, as fixed values.
PLATE_CODES = (4442, 4457, 4458, 4441)
STATUSES = ("affected", "non-affected")


def _on_model(activity: DataFrame, master: DataFrame, site: DataFrame, country: DataFrame, model: str) -> DataFrame:
    """Activity of one instrument model; the country is that of the instrument's site."""
    wanted = instruments(master, "ascii").filter(F.col("instrument_model") == model)
    places = site.select("supplier_site_id", F.col("country_code").alias("site_country_code"))
    return attach_instrument(activity, wanted, places, country.select("country_code", "country_name"), how="inner")


def kit_error_log(
    activity: DataFrame,
    master: DataFrame,
    site: DataFrame,
    country: DataFrame,
    kit_codes: DataFrame,
    model: str = KIT_MODEL,
) -> DataFrame:
    """Activity rows of the model whose code is in the kit list, with that list's texts."""
    codes = kit_codes.select(
        F.col("error_code").cast("double").alias("error_type_id"), "category_message", "possible_issue", "protocol"
    )
    # The code list is the more selective side and also brings the texts, so it goes first; a code it
    # lists twice gives two rows.
    listed = attach(activity, codes, "error_type_id", "inner")
    return _on_model(listed, master, site, country, model).select(
        "instrument_id",
        "instrument_model",
        "supplier_site_id",
        "country_name",
        "test_record_id",
        "test_type_id",
        "error_type_id",
        "error_count",
        "test_date",
        "is_patient_test",
        "is_control_test",
        "patient_test_error_flag",
        "control_test_error_flag",
        "excluded_tests",
        "category_message",
        "possible_issue",
        "protocol",
    )


def kit_error_totals(
    activity: DataFrame,
    master: DataFrame,
    site: DataFrame,
    country: DataFrame,
    kit_codes: DataFrame,
    model: str = KIT_MODEL,
) -> DataFrame:
    """Total errors and category per kit code, largest first; the total is missing if one count is.

    Of several categories of a code the first in the file counts if the list has positions, else in alphabetical order.
    """
    log = kit_error_log(activity, master, site, country, kit_codes, model)
    totals = log.groupBy("error_type_id").agg(
        F.min("category_message").alias("category_message"), sum_na("error_count").alias("total_errors")
    )
    if POSITION in kit_codes.columns:
        code = F.col("error_code").cast("double").alias("error_type_id")
        first = kit_codes.groupBy(code).agg(first_value(kit_codes, "category_message"))
        totals = attach(totals.drop("category_message"), first, "error_type_id", small=False)
    shown = totals.select(
        F.col("category_message").alias("error_category"), F.col("error_type_id").alias("error_code"), "total_errors"
    )
    return shown.orderBy(F.desc_nulls_last("total_errors"), "error_code")


def kit_error_bars(totals: DataFrame) -> DataFrame:
    """The rows of the bar chart of ``kit_error_totals``: ``display_rank`` is a bar's place from below, the largest total on top;
    a missing total stands above all. A row per listed code goes through the window."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("total_errors"), "error_code"))
    return totals.withColumn("display_rank", place.cast("bigint"))


def plate_status(
    activity: DataFrame,
    master: DataFrame,
    site: DataFrame,
    country: DataFrame,
    model: str = KIT_MODEL,
    codes: Sequence[int] = PLATE_CODES,
) -> DataFrame:
    """Per country and plate, whether any of its wells has one of the control errors."""
    wells = activity.select("instrument_id", "test_record_id", "error_type_id")
    placed = split_record_id(_on_model(wells, master, site, country, model))
    spoiled = F.max(F.when(F.col("error_type_id").isin(*[float(c) for c in codes]), 1).otherwise(0))
    return (
        placed.groupBy("country_name", "plate")
        .agg(spoiled.alias("spoiled"))
        .select(
            "country_name",
            "plate",
            F.when(F.col("spoiled") == 1, STATUSES[0]).otherwise(STATUSES[1]).alias("control_errors"),
        )
    )


def plate_status_by_country(status: DataFrame) -> DataFrame:
    """Number of plates per country and status; a missing country is left out."""
    return (
        status.filter(F.col("country_name").isNotNull())
        .groupBy("country_name")
        .pivot("control_errors", list(STATUSES))
        .agg(F.count(F.lit(1)))
        .fillna(0)
    )
