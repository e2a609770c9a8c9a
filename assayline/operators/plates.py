"""Share of plates that an error code spoils, by month, country and site.

A plate is a record id without its well. Plates are counted once per month, country and instrument:
one shuffle on the plate keys, which the map-side part of the distinct has cut from wells to plates.
Model and site name hang on the instrument, so they are joined to the counts, not to the wells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.functions import dates, text
from assayline.functions.nulls import percent, sum_skip
from assayline.operators.cleaning import VIRAL_LOAD_AND_EID, filter_psm, instruments
from assayline.operators.lookups import attach, attach_instrument, attach_names

LEVELS = {
    "my": ("test_month_year",),
    "my_country": ("test_month_year", "country_code"),
    "my_country_site": ("test_month_year", "country_code", "supplier_site_name"),
}
_FACT_KEYS = ("month", "country_code", "instrument_id")
MARK_COLUMNS = (*_FACT_KEYS, "plate_id", "hit", "error_type_id")


def error_details(
    activity: DataFrame,
    master: DataFrame,
    test_type: DataFrame,
    error_type: DataFrame,
    site: DataFrame,
    groups: Sequence[str] = VIRAL_LOAD_AND_EID,
) -> DataFrame:
    """Every well with an error code, with its instrument, site and error text.

    ``error_type`` is not restricted to one supplier, so a code that several suppliers use gives one
    row for each.
    """
    coded = filter_psm(activity.filter(F.col("error_type_id").isNotNull()), test_type, groups)
    coded = coded.withColumns(
        {
            "well_number": text.well_number(F.col("test_record_id")),
            "error_type_id": text.code_text(F.col("error_type_id")),
        }
    )
    described = attach(
        coded, error_type.select("error_type_id", "error_type_name", "error_type_description"), "error_type_id"
    )
    placed = attach_instrument(described, instruments(master), site.select("supplier_site_id", "supplier_site_name"))
    return placed.select(
        "instrument_id",
        "instrument_model",
        "supplier_site_id",
        "supplier_site_name",
        "country_code",
        "well_number",
        "test_type_id",
        "test_type_psm",
        "error_type_id",
        "error_type_name",
        "error_type_description",
        "error_count",
        F.col("test_date").cast("string").alias("test_date"),
        "is_patient_test",
        "is_control_test",
        "patient_test_error_flag",
        "control_test_error_flag",
        "excluded_tests",
        dates.month_number_label(F.col("test_date")).alias("test_month_year"),
    )


def _wells(activity: DataFrame, test_type: DataFrame, groups: Sequence[str]) -> DataFrame:
    # A test type listed twice must not count twice: the plate distinct that follows sees to it.
    return filter_psm(activity, test_type, groups).select(
        dates.month_floor(F.col("test_date")).alias("month"),
        "country_code",
        "instrument_id",
        text.plate_id(F.col("test_record_id")).alias("plate_id"),
        "error_type_id",
        "error_count",
    )


def _named(counts: DataFrame, master: DataFrame, site: DataFrame) -> DataFrame:
    """Month label, model and site name for counts by month, country and instrument."""
    named = attach_names(counts, instruments(master), site.select("supplier_site_id", "supplier_site_name"))
    return named.withColumn("test_month_year", dates.month_number_label(F.col("month")))


def affected_plates(
    activity: DataFrame,
    master: DataFrame,
    test_type: DataFrame,
    site: DataFrame,
    groups: Sequence[str] = VIRAL_LOAD_AND_EID,
) -> DataFrame:
    """Plates with an error, per month, code, instrument, site name and country.

    An error without a code is a group of its own.
    """
    hits = _wells(activity, test_type, groups).filter(F.col("error_count") > 0)
    counts = (
        hits.select(*_FACT_KEYS, "plate_id", "error_type_id")
        .distinct()
        .groupBy(*_FACT_KEYS, "error_type_id")
        .agg(F.count(F.lit(1)).alias("plates_affected"))
    )
    return _named(counts, master, site).select(
        "test_month_year",
        text.code_text(F.col("error_type_id")).alias("error_type_id"),
        "instrument_model",
        "instrument_id",
        "supplier_site_name",
        "country_code",
        "plates_affected",
    )


def total_plates(
    activity: DataFrame,
    master: DataFrame,
    test_type: DataFrame,
    site: DataFrame,
    groups: Sequence[str] = VIRAL_LOAD_AND_EID,
) -> DataFrame:
    """All plates, per month, country, site name and instrument."""
    counts = (
        _wells(activity, test_type, groups)
        .select(*_FACT_KEYS, "plate_id")
        .distinct()
        .groupBy(*_FACT_KEYS)
        .agg(F.count(F.lit(1)).alias("plates"))
    )
    return _named(counts, master, site).select(
        "test_month_year", "country_code", "supplier_site_name", "instrument_model", "instrument_id", "plates"
    )


def affected_at(affected: DataFrame, level: str) -> DataFrame:
    """``affected_plates`` summed to a level; a plate seen on two instruments counts twice."""
    return affected.groupBy(*LEVELS[level], "error_type_id").agg(sum_skip("plates_affected").alias("plates_affected"))


def total_at(total: DataFrame, level: str) -> DataFrame:
    """``total_plates`` summed to a level."""
    return total.groupBy(*LEVELS[level]).agg(sum_skip("plates").alias("plates"))


def plate_marks(activity: DataFrame, test_type: DataFrame, groups: Sequence[str] = VIRAL_LOAD_AND_EID) -> DataFrame:
    """The different plates per month, country and instrument (``hit`` false), and those with an error per code (``hit`` true).

    Numerators and denominators come from one pass: each well gives one row for its plate and, if it
    has an error, a second one for its plate and code; one distinct then serves both counts.
    Operators that count plates take these marks in place of the activity, for instance those of a kept state (``plate_state``).
    """
    plain = F.struct(F.lit(False).alias("hit"), F.lit(None).cast("double").alias("error_type_id"))
    coded = F.struct(F.lit(True).alias("hit"), F.col("error_type_id").cast("double").alias("error_type_id"))
    marks = F.when(F.col("error_count") > 0, F.array(plain, coded)).otherwise(F.array(plain))
    return (
        _wells(activity, test_type, groups)
        .select(*_FACT_KEYS, "plate_id", F.inline(marks))
        .distinct()
    )


def _marked_counts(activity: DataFrame, test_type: DataFrame | None, groups: Sequence[str]) -> DataFrame:
    """Marks per month, country, instrument and code. ``activity`` may be marks, whose test types are then given."""
    marks = activity if set(MARK_COLUMNS) <= set(activity.columns) else plate_marks(activity, test_type, groups)
    return marks.groupBy(*_FACT_KEYS, "hit", "error_type_id").agg(F.count(F.lit(1)).alias("plates"))


def _shares(rolled: DataFrame, keys: Sequence[str], shown: Sequence[str]) -> DataFrame:
    """Affected plates, all plates and percentage per code, from summed marked counts ``n``."""
    # The window runs over the rolled-up rows: one per code and level key.
    all_plates = F.max(F.when(~F.col("hit"), F.col("n"))).over(Window.partitionBy(*keys))
    return (
        rolled.withColumn("plates", all_plates)
        .filter("hit")
        .select(
            *shown,
            text.code_text(F.col("error_type_id")).alias("error_type_id"),
            F.col("n").alias("plates_affected"),
            "plates",
            percent("n", "plates").alias("percent"),
        )
    )


def percent_plates(
    activity: DataFrame,
    master: DataFrame,
    test_type: DataFrame | None,
    site: DataFrame,
    level: str = "my_country",
    groups: Sequence[str] = VIRAL_LOAD_AND_EID,
) -> DataFrame:
    """Percentage of the plates of a level that each code affects, from the activity or from plate marks (without test types)."""
    keys = LEVELS[level]
    named = _named(_marked_counts(activity, test_type, groups), master, site)
    rolled = named.groupBy(*keys, "hit", "error_type_id").agg(F.sum("plates").alias("n"))
    return _shares(rolled, keys, keys)


def percent_plates_levels(
    activity: DataFrame,
    master: DataFrame,
    test_type: DataFrame | None,
    site: DataFrame,
    groups: Sequence[str] = VIRAL_LOAD_AND_EID,
) -> DataFrame:
    """``percent_plates`` of all levels from one reading of the fact, told apart by column ``level``.

    Columns that a level does not have are NULL there; a real missing country or site is NULL too,
    so only ``level`` tells them apart.
    """
    finest = LEVELS["my_country_site"]
    named = _named(_marked_counts(activity, test_type, groups), master, site)
    columns = [F.col(c) for c in (*finest, "hit", "error_type_id")]
    sets = [[F.col(c) for c in (*keys, "hit", "error_type_id")] for keys in LEVELS.values()]
    rolled = named.groupingSets(sets, *columns).agg(
        F.sum("plates").alias("n"), F.grouping("country_code").alias("_c"), F.grouping("supplier_site_name").alias("_s")
    )
    level = F.when(F.col("_c") == 1, "my").when(F.col("_s") == 1, "my_country").otherwise("my_country_site")
    keys = ("level", *finest)
    return _shares(rolled.withColumn("level", level).drop("_c", "_s"), keys, keys)
