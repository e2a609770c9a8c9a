"""The file sets that the lab's analyses produce, from a dictionary of lab tables.

Tables come from ``sources.lab_csv.read_lab_folder``, from a database or from anywhere else; each
function returns lazy DataFrames by file name, and ``write_reports`` writes them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions import dates, labels
from assayline.operators import (
    code_rates,
    error_rates,
    instrument_summary,
    kit_errors,
    plates,
    site_match,
    test_summary,
    wide,
)
from assayline.sources.lab_csv import write_site_errors, write_table
from assayline.storage import stored

Tables = Mapping[str, DataFrame]
Reports = dict[str, DataFrame]

# Reports written as one folder per key.
PER_KEY = {"percent_plates": ["level"]}
PER_SITE = "errors_site"


def plate_reports(t: Tables) -> Reports:
    """Wells with error codes, and the share of plates per code at all levels."""
    activity, master, types, site = t["test_activity_abbott"], t["instrument_master"], t["test_type"], t["site"]
    return {
        "error_codes_plates": plates.error_details(activity, master, types, t["error_type"], site),
        "percent_plates": plates.percent_plates_levels(activity, master, types, site),
    }


def code_reports(t: Tables, after: str = "2020-11-01", excluded_country: str = "ZM") -> Reports:
    """First-generation errors per test: frequent codes, monthly series, and rates by site.

    The activity table is counted once, into a tally in the shared folder, from which all of them are made.
    """
    master = t["instrument_master"]
    activity = stored(code_rates.report_tally(t["test_activity_roche"]), "tally")
    monthly = code_rates.monthly_code_rate(activity, master)
    recent = code_rates.recent_sites(code_rates.site_monthly_code_rate(activity, master), after, excluded_country)
    return {
        "countries_sites": code_rates.countries_sites(activity, master),
        "top_codes_instrument_model": code_rates.top_codes(activity, master, ["country_code", "instrument_model"]),
        "top_codes_instrument_id": code_rates.top_codes(activity, master, ["country_code", "instrument_id"]),
        "top_codes_country": code_rates.top_codes(activity, master, ["country_code"]),
        "country_error_series": code_rates.country_error_series(monthly, excluded_country),
        "error_country_series": code_rates.error_country_series(monthly, excluded_country),
        "error_country_series_short": code_rates.error_country_series(monthly, excluded_country, after),
        "site_error_series": code_rates.gap_fill(recent, code_rates.months_seen(activity, master, after)),
        "total_errors_by_site": code_rates.total_errors_by_site(recent),
        PER_SITE: code_rates.site_code_rate(recent),
    }


def test_error_reports(t: Tables) -> Reports:
    """Second-generation errors per test: the long table and its four rate tables.

    The rate tables are made from one tally in the shared folder; only the long table reads the tests again.
    """
    activity, master, error_type, site = t["test_activity_roche"], t["instrument_master"], t["error_type"], t["site"]
    month = dates.month_floor(F.col("test_date"))
    tally = stored(code_rates.report_tally(activity, month, once_per_test=True), "tally")
    return {
        "test_errors": error_rates.test_errors(activity, master, error_type, site),
        "all_error_percentages": error_rates.error_share_all(tally, master, error_type),
        "test_errors_site": error_rates.error_rate_site(tally, master, error_type, site),
        "test_errors_instrument": error_rates.error_rate_instrument(tally, master, error_type, site),
        "test_errors_month": error_rates.error_rate_month(tally, master, error_type),
    }


def kit_reports(t: Tables) -> Reports:
    """Kit errors by code, and plates lost to control errors by country."""
    tables = t["test_activity_abbott"], t["instrument_master"], t["site"], t["country"]
    return {
        "kit_error_totals": kit_errors.kit_error_totals(*tables, t["kit_error_codes"]),
        "plate_status_by_country": kit_errors.plate_status_by_country(kit_errors.plate_status(*tables)),
    }


def summary_reports(t: Tables, as_of: dt.date) -> Reports:
    """The country tables of the last twelve months, as shown text."""
    tables = t["test"], t["instrument_master"], t["site"], t["test_type"], t["country"], as_of
    return {
        "test_sample_table": test_summary.format_report(test_summary.test_table(*tables, "tot_patient_test")),
        "test_errors_table": test_summary.format_report(test_summary.test_table(*tables, "tot_patient_error")),
        "test_perc_error_table": test_summary.format_report(test_summary.error_share_table(*tables), "percent"),
        "report_period": test_summary.report_period(t["test"], as_of),
    }


def instrument_reports(t: Tables, after: dt.date = dt.date(2021, 7, 1)) -> Reports:
    """Instruments by model and quarter, globally and by country."""
    tables = t["test"], t["instrument_master"], t["site"], t["country"], after
    return {
        "instruments_global": test_summary.format_report(instrument_summary.instrument_counts(*tables), "plain"),
        "instruments_country": test_summary.format_report(
            instrument_summary.instrument_counts(*tables, by_country=True), "plain"
        ),
    }


def site_reports(t: Tables, countries: tuple[str, ...] = site_match.SUPPLIER_COUNTRIES) -> Reports:
    """Search texts for the places of all sites, and the nearest registered lab of each active one; with the replies of a place search
    (``place_replies``) also their candidates."""
    sites = site_match.active_sites(t["supplier_geo"], t["active_locations"])
    found = {
        "site_queries": site_match.geocode_queries(t["site"], t["country"]),
        "site_matches": site_match.nearest_lab(sites, site_match.labs_in(t["datim_lab_sites"], countries)),
    }
    if "place_replies" in t:
        found["site_candidates"] = site_match.flatten_candidates(t["place_replies"])
    return found


def write_reports(reports: Reports, folder: str) -> None:
    """Write each report to ``<folder>/<name>.csv``; names that come with the data become columns here."""
    for name, df in reports.items():
        path = f"{folder}/{name}.csv"
        if name == PER_SITE:
            write_site_errors(df, path)
        else:
            write_table(wide.spread(df, F.lit(labels.MISSING)), path, PER_KEY.get(name))
