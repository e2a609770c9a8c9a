"""Number of instruments that reported, by model and quarter."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions import dates
from assayline.operators.cleaning import instruments
from assayline.operators.lookups import attach_instrument
from assayline.operators.test_summary import widen


def _tests_after(test: DataFrame, after: dt.date | str) -> DataFrame:
    return test.filter(F.col("test_date") > F.lit(str(after)).cast("date"))


def instruments_by_quarter(
    test: DataFrame, master: DataFrame, site: DataFrame, country: DataFrame, after: dt.date | str
) -> DataFrame:
    """Tests after a date (that day itself is out) with instrument, supplier, country and quarter."""
    places = site.select(
        "supplier_site_id",
        "supplier_site_name",
        "supplier_name",
        F.col("supplier_id").alias("supplier_id_x"),
        F.col("country_code").alias("site_country_code"),
    )
    placed = attach_instrument(
        _tests_after(test, after), instruments(master, "ascii"), places, country.select("country_code", "country_name")
    )
    return placed.select(
        "instrument_id",
        "instrument_model",
        "supplier_name",
        "supplier_site_id",
        "supplier_site_name",
        "supplier_id_x",
        "country_name",
        "test_type_id",
        dates.quarter_label(dates.quarter_floor(F.col("test_date"))).alias("quarter_year"),
    )


def instrument_counts(
    test: DataFrame,
    master: DataFrame,
    site: DataFrame,
    country: DataFrame,
    after: dt.date | str,
    by_country: bool = False,
    quarters: Sequence[str] | None = None,
) -> DataFrame:
    """Different instruments per model (and country), one column per quarter.

    The fact is cut to one row per instrument and quarter before anything is joined to it.
    """
    used = _tests_after(test, after).select(
        "instrument_id", dates.quarter_floor(F.col("test_date")).alias("quarter")
    ).distinct()
    if by_country:
        places = site.select("supplier_site_id", F.col("country_code").alias("site_country_code"))
        placed = attach_instrument(
            used, instruments(master, "ascii"), places, country.select("country_code", "country_name"), counted=True
        )
        keys = ["country_name", "instrument_model"]
    else:
        placed = attach_instrument(used, instruments(master, "ascii"), counted=True)
        keys = ["instrument_model"]
    counts = (
        placed.select(*keys, "quarter", "instrument_id")
        .distinct()
        .groupBy(*keys, "quarter")
        .agg(F.count(F.lit(1)).alias("number_instruments"))
        .withColumn("quarter", dates.quarter_label(F.col("quarter")))
    )
    return widen(counts, keys, "quarter", "number_instruments", quarters)
