"""Patient tests and errors by country and test type over the last twelve months.

Every summary first sums the fact per instrument and test type, keeping how many rows and how many
values went into each sum, so that a missing value still makes the coarser total missing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions import labels
from assayline.functions.nulls import blank_to_null, n_unique, ratio
from assayline.operators.cleaning import instruments
from assayline.operators.lookups import attach, attach_instrument
from assayline.operators.wide import CELLS, cells, is_gathered

MISSING_TYPE = "NA"
MEASURES = ("tot_patient_test", "tot_patient_error")


def in_last_year(test: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Tests dated after the same day one year before ``as_of``."""
    return test.filter(F.col("test_date") > F.add_months(F.lit(str(as_of)).cast("date"), -12))


def _places(site: DataFrame) -> DataFrame:
    return site.select("supplier_site_id", F.col("country_code").alias("site_country_code"))


def tests_last_year(
    test: DataFrame,
    master: DataFrame,
    site: DataFrame,
    test_type: DataFrame,
    country: DataFrame,
    as_of: dt.date | str,
    blanks_to_null: bool = False,
) -> DataFrame:
    """Tests of the last twelve months with site, country and test type; unmatched ones stay.

    ``blanks_to_null`` is for tables read from a database, which hold missing text as ``''``.
    """
    placed = attach_instrument(
        in_last_year(test, as_of),
        instruments(master).drop("instrument_model"),
        _places(site),
        country.select("country_code", "country_name"),
    )
    typed = attach(placed, test_type.select("test_type_id", "test_type"), "test_type_id")
    rows = typed.select(
        "instrument_id",
        "supplier_site_id",
        "country_name",
        "test_id",
        "test_type_id",
        "test_type",
        "test_date",
        "tot_patient_test",
        "tot_patient_error",
    )
    return blank_to_null(rows) if blanks_to_null else rows


def sites_instruments(
    test: DataFrame, master: DataFrame, site: DataFrame, country: DataFrame, as_of: dt.date | str
) -> DataFrame:
    """Different sites and instruments per country."""
    used = in_last_year(test, as_of).select("instrument_id").distinct()
    placed = attach_instrument(
        used,
        instruments(master).drop("instrument_model"),
        _places(site),
        country.select("country_code", "country_name"),
        counted=True,
    )
    return placed.groupBy("country_name").agg(
        n_unique("supplier_site_id").alias("Total sites"), n_unique("instrument_id").alias("Total instruments")
    )


def _placed_sums(
    test: DataFrame,
    master: DataFrame,
    site: DataFrame,
    test_type: DataFrame,
    country: DataFrame,
    as_of: dt.date | str,
) -> DataFrame:
    """Sums, row numbers and value numbers per instrument and test type, with site, country and type."""
    sums = [F.count(F.lit(1)).alias("rows")]
    for m in MEASURES:
        sums += [F.sum(m).alias(m), F.count(m).alias(f"{m}_present")]
    fine = in_last_year(test, as_of).groupBy("instrument_id", "test_type_id").agg(*sums)
    placed = attach_instrument(
        fine,
        instruments(master).drop("instrument_model"),
        _places(site),
        country.select("country_code", "country_name"),
        counted=True,
    )
    typed = attach(placed, test_type.select("test_type_id", "test_type"), "test_type_id", small=False)
    return typed.withColumn("test_type", F.coalesce("test_type", F.lit(MISSING_TYPE)))


def _total(measure: str, test_type: str | None) -> Column:
    """Sum of a measure over one test type (None: over the group); missing if a value is, or if there is no such test."""

    def own(column: str) -> Column:
        return F.sum(F.col(column) if test_type is None else F.when(F.col("test_type") == test_type, F.col(column)))

    return F.when(own("rows") == own(f"{measure}_present"), own(measure))


def _country_table(placed: DataFrame, cell: Callable[[str | None], Column], columns: Sequence[str] | None) -> DataFrame:
    """One row per country: a column per test type, then the numbers of sites and instruments.

    Everything comes from one grouping of the sums, so the fact is read once. Without ``columns`` the types stay with the rows until
    ``wide.spread`` makes them columns; no job runs before.
    """
    sites = n_unique("supplier_site_id").alias("Total sites")
    instruments_ = n_unique("instrument_id").alias("Total instruments")
    if columns is not None:
        country = F.col("country_name").alias("Country")
        return placed.groupBy(country).agg(*[cell(t).alias(t) for t in columns], sites, instruments_)
    country, kind = F.col("country_name"), F.col("test_type")
    both = placed.groupingSets([[country, kind], [country]], country, kind).agg(
        cell(None).alias("cell"), sites, instruments_, F.grouping("test_type").alias("whole")
    )
    whole = [F.max(F.when(F.col("whole") == 1, F.col(f"`{n}`"))).alias(n) for n in ("Total sites", "Total instruments")]
    return both.groupBy(country.alias("Country")).agg(cells(F.when(F.col("whole") == 0, kind), F.col("cell")), *whole)


def widen(df: DataFrame, key: Sequence[str], names: str, value: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One column per value of ``names``; rows without a name go to column ``NA``.

    ``columns`` fixes the columns and their order; otherwise the names stay with the rows until ``wide.spread`` makes those seen
    columns, in alphabetical order.
    """
    labelled = df.withColumn(names, F.coalesce(names, F.lit(MISSING_TYPE)))
    if columns is None:
        return labelled.groupBy(*key).agg(cells(F.col(names), F.col(value)))
    return labelled.groupBy(*key).pivot(names, list(columns)).agg(F.first(value))


def test_table(
    test: DataFrame,
    master: DataFrame,
    site: DataFrame,
    test_type: DataFrame,
    country: DataFrame,
    as_of: dt.date | str,
    measure: str = "tot_patient_test",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Country by test type: sum of a measure, with the country's number of sites and instruments."""
    placed = _placed_sums(test, master, site, test_type, country, as_of)
    return _country_table(placed, lambda t: _total(measure, t), columns)


def error_share_table(
    test: DataFrame,
    master: DataFrame,
    site: DataFrame,
    test_type: DataFrame,
    country: DataFrame,
    as_of: dt.date | str,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Country by test type: errors as a fraction of tests, with numbers of sites and instruments."""
    placed = _placed_sums(test, master, site, test_type, country, as_of)
    return _country_table(
        placed, lambda t: ratio(_total("tot_patient_error", t), _total("tot_patient_test", t)), columns
    )


def report_period(test: DataFrame, as_of: dt.date | str) -> DataFrame:
    """First and last test date of the report."""
    return in_last_year(test, as_of).agg(
        F.min("test_date").alias("first_test_date"), F.max("test_date").alias("last_test_date")
    )


def _plain(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(labels.MISSING))


def format_report(df: DataFrame, kind: str = "number", columns: Sequence[str] | None = None) -> DataFrame:
    """The table as text: ``columns`` (default: all numeric ones) as short numbers, percentages or as they are
    (``plain``), a dash for missing. Of a table whose names are still with the rows only their values are shown as percentages."""
    shown = {"number": labels.number_text, "percent": labels.percent_text, "plain": _plain}[kind]
    numeric = [n for n, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    if columns is None and kind == "percent" and is_gathered(df):
        numeric = []
    chosen = set(numeric if columns is None else columns)

    def cell(name: str) -> Column:
        c = F.col(f"`{name}`")
        if name == CELLS:
            return F.transform_values(c, lambda _, v: shown(v))
        return shown(c) if name in chosen else _plain(c)

    return df.select(*[cell(n).alias(n) for n in df.columns])
