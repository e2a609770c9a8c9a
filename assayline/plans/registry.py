"""The registered queries: every operator over the lab tables, with the parameter values of the fixtures."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import dates
from assayline.functions.nulls import blank_to_null
from assayline.operators import (
    cleaning,
    code_rates,
    error_rates,
    instrument_summary,
    kit_errors,
    ordering,
    plate_state,
    plates,
    site_match,
    tally_state,
    test_summary,
    wide,
)
from assayline.plans.lab_views import ODD_TEXTS, LabViews, columns
from assayline.schemas import SCHEMAS
from assayline.session import shared_folder
from assayline.sources import key_ranges, lab_csv

# Parameter values on the test data, as fixed values.
AS_OF = dt.date(2001, 8, 1)
QUARTER_START = dt.date(2000, 7, 1)
MONTH_CUT = "2000-11-01"
EXCLUDED_COUNTRY = "C3"
LAB_COUNTRIES = tuple(f"NATION_{i}" for i in range(1, 8))
TEST_TYPES = ("HIGH", "LOW", "MEDIUM", "NOT SPECIFIED", "URGENT")
QUARTERS = tuple(dates.quarters_between(QUARTER_START, AS_OF))

Query = Callable[[SparkSession, str], DataFrame]


def _on(build: Callable[[LabViews], DataFrame]) -> Query:
    return lambda spark, folder: build(LabViews(spark, folder))


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"


# Sources and sinks


def _read_lab_csv(v: LabViews) -> DataFrame:
    folder = _new_path(v.spark, "export")
    lab_csv.write_table(v.test(), f"{folder}/test.csv")
    return lab_csv.read_lab_csv(v.spark, folder, "test")


def _read_lab_folder(v: LabViews) -> DataFrame:
    folder = _new_path(v.spark, "export")
    lab_csv.write_table(v.test().filter("tot_patient_test is null"), f"{folder}/test_20210630.csv")
    lab_csv.write_table(v.test(), f"{folder}/test_20220724.csv")
    lab_csv.write_table(v.country(), f"{folder}/country_20220724.csv")
    return lab_csv.read_lab_folder(v.spark, folder)["test"]


def _write_table_csv(v: LabViews) -> DataFrame:
    """The written text itself: every column as a string, the missing value as its token."""
    path = _new_path(v.spark, "test.csv")
    lab_csv.write_table(v.test(), path)
    return v.spark.read.option("header", True).schema(", ".join(f"{c} string" for c in SCHEMAS["test"].names)).csv(path)


def _csv_round_trip(v: LabViews) -> DataFrame:
    """Texts that a careless writer or reader would change, written and read again."""
    path = _new_path(v.spark, "error_type.csv")
    lab_csv.write_table(v.base("supplier").selectExpr(*columns(ODD_TEXTS)), path)
    return lab_csv.read_csv(v.spark, path, SCHEMAS["error_type"], line_breaks=True)


def _read_lab_columns(v: LabViews) -> DataFrame:
    """One table in files of three column orders, one of them with a column more."""
    folder = _new_path(v.spark, "export")
    names = SCHEMAS["test"].names
    orders = (names, sorted(names), [*reversed(names), "note"])
    for i, order in enumerate(orders):
        part = v.test().filter(F.col("test_id") % len(orders) == i).withColumn("note", F.lit("x")).select(*order)
        lab_csv.write_table(part, f"{folder}/test.csv/part{i}.csv")
    return lab_csv.read_lab_csv(v.spark, folder, "test")


def _read_lab_set(v: LabViews) -> DataFrame:
    """A published set; the next one is whole but not published, and one more table is only half written."""
    folder = _new_path(v.spark, "export")
    lab_csv.write_lab_folder(v.spark, {"test": v.test(), "country": v.country()}, folder, "20220724")
    lab_csv.write_table(v.test().limit(0), f"{folder}/test_20220801.csv")
    v.site().write.option("header", True).csv(f"{folder}/site_20220901.csv/half")
    return lab_csv.read_lab_folder(v.spark, folder)["test"]


def _first_in_file(v: LabViews) -> DataFrame:
    """The first test of every instrument in files in which the tests stand by falling id."""
    folder = _new_path(v.spark, "export")
    falling = v.test().repartitionByRange(4, F.desc("test_id")).sortWithinPartitions(F.desc("test_id"))
    lab_csv.write_table(falling, f"{folder}/test.csv")
    return ordering.keep_first(lab_csv.read_lab_csv(v.spark, folder, "test", position=True), ["instrument_id"]).drop(lab_csv.POSITION)


def _scan_ranges(v: LabViews) -> DataFrame:
    """Rows of each part of a split scan, by the ranges that the quantiles of its key give."""
    parts, key = 8, "tot_patient_test"
    places = [i / parts for i in range(parts + 1)]
    bounds = v.test().agg(F.percentile_approx(key, places, F.lit(1_000_000_000))).first()[0]
    conditions = key_ranges.predicates(key, key_ranges.cuts(key_ranges.Distribution(tuple(bounds)), parts))
    part = F.coalesce(*[F.when(F.expr(c), F.lit(i)) for i, c in enumerate(conditions)]).alias("part")
    found = [F.count("*").alias("rows"), F.min(key).alias("least"), F.max(key).alias("greatest")]
    return v.test().groupBy(part).agg(*found)


def _site_error_files(v: LabViews) -> DataFrame:
    path = _new_path(v.spark, "errors_site")
    lab_csv.write_site_errors(_site_code_rate(v), path)
    layout = "error_code_list string, n bigint, tests bigint, percent double, supplier_site_id bigint"
    return v.spark.read.option("header", True).option("nullValue", lab_csv.MISSING).schema(layout).csv(path)


def _blank_to_null(v: LabViews) -> DataFrame:
    return blank_to_null(v.site().withColumn("country_code", F.coalesce("country_code", F.lit(""))))


# Cleaning and plates


def _record_ids(v: LabViews) -> DataFrame:
    return v.test_activity_abbott().select("test_record_id")


def _plate_tables(v: LabViews) -> tuple[DataFrame, ...]:
    return v.test_activity_abbott(), v.instrument_master(), v.test_type(), v.site()


def _affected(v: LabViews) -> DataFrame:
    return plates.affected_plates(*_plate_tables(v))


def _total(v: LabViews) -> DataFrame:
    return plates.total_plates(*_plate_tables(v))


def _plate_levels() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for level in plates.LEVELS:
        found[f"affected_plates_{level}"] = _on(lambda v, at=level: plates.affected_at(_affected(v), at))
        found[f"total_plates_{level}"] = _on(lambda v, at=level: plates.total_at(_total(v), at))
        found[f"percent_plates_{level}"] = _on(lambda v, at=level: plates.percent_plates(*_plate_tables(v), at))
    return found


def _plate_state_shares(v: LabViews) -> DataFrame:
    """Shares from a kept state: two exports that overlap, the second one merged twice."""
    folder = _new_path(v.spark, "plates")
    activity, master, test_type, site = _plate_tables(v)
    early = activity.filter(F.col("test_date").isNull() | (F.col("test_date") < F.lit("1999-06-15").cast("date")))
    late = activity.filter(F.col("test_date") >= F.lit("1999-06-01").cast("date"))
    for export in (early, late, late):
        plate_state.merge_plates(export, test_type, folder)
    plate_state.compact(v.spark, folder)
    return plates.percent_plates(plate_state.read_marks(v.spark, folder), master, None, site)


# Codes per test


def _roche(v: LabViews) -> tuple[DataFrame, DataFrame]:
    return v.test_activity_roche(), v.instrument_master()


def _monthly(v: LabViews) -> DataFrame:
    return code_rates.monthly_code_rate(*_roche(v))


def _tally_state_rates(v: LabViews) -> DataFrame:
    """Rates from a kept state: records with wrong codes and months are replaced, records too many are removed, some come late."""
    folder = _new_path(v.spark, "tally")
    activity, master = _roche(v)
    key = F.col("record_key")
    wrong = activity.filter(key % 3 == 0).withColumns({code_rates.CODE: F.lit("1,2"), "test_date": F.add_months("test_date", 1)})
    many = activity.filter(key % 5 == 0).withColumn("record_key", -key - 1)
    tally_state.merge_records(activity.filter(key % 3 == 1).unionByName(wrong).unionByName(many), folder, batch="first")
    tally_state.merge_records(activity.filter(key % 3 == 0), folder, removed=many.select("record_key"), batch="second")
    tally_state.merge_records(activity.filter(key % 3 == 2), folder, batch="late")
    tally_state.merge_records(activity.filter(key % 3 == 2), folder, batch="late")
    return code_rates.monthly_code_rate(tally_state.read_tally(v.spark, folder), master)


def _recent(v: LabViews) -> DataFrame:
    return code_rates.recent_sites(code_rates.site_monthly_code_rate(*_roche(v)), MONTH_CUT, EXCLUDED_COUNTRY)


def _site_code_rate(v: LabViews) -> DataFrame:
    return code_rates.site_code_rate(_recent(v))


def _mean_rate(v: LabViews) -> DataFrame:
    # Rounded for comparison only: the last digits of a mean depend on the order of its terms.
    return code_rates.mean_code_rate_country(_recent(v)).withColumn("percent", F.round("percent", 9))


def _filled(v: LabViews) -> DataFrame:
    return code_rates.site_error_series(*_roche(v), MONTH_CUT, EXCLUDED_COUNTRY)


def _family_rows(v: LabViews) -> DataFrame:
    return cleaning.model_family(cleaning.enrich_activity(*_roche(v))).select(
        "record_key", "instrument_id", "instrument_model", "supplier_site_id"
    )


# Kits, summaries, sites


def _kit(v: LabViews) -> tuple[DataFrame, ...]:
    return v.test_activity_abbott(), v.instrument_master(), v.site(), v.country()


def _status(v: LabViews) -> DataFrame:
    return kit_errors.plate_status(*_kit(v))


def _tests(v: LabViews) -> tuple:
    return v.test(), v.instrument_master(), v.site(), v.test_type(), v.country(), AS_OF


def _tests_with_blanks(v: LabViews) -> DataFrame:
    """From tables as a database holds them, with blank text for a missing one."""
    test, master, site, test_type, country, as_of = _tests(v)
    blank = F.when(F.col("country_name") != "NATION_3", F.col("country_name")).otherwise(F.lit(""))
    return test_summary.tests_last_year(
        test, master, site, test_type, country.withColumn("country_name", blank), as_of, blanks_to_null=True
    )


def _test_table(v: LabViews, measure: str) -> DataFrame:
    return test_summary.test_table(*_tests(v), measure, TEST_TYPES)


def _share_table(v: LabViews) -> DataFrame:
    return test_summary.error_share_table(*_tests(v), TEST_TYPES)


def _instruments(v: LabViews) -> tuple:
    return v.test(), v.instrument_master(), v.site(), v.country(), QUARTER_START


def _replies(v: LabViews) -> DataFrame:
    """Search replies as the service nests them; a site has at most two candidates here."""
    location = F.struct(F.col("candidate_lat").alias("lat"), F.col("candidate_lon").alias("lng"))
    candidate = F.struct(
        F.col("candidate_name").alias("name"),
        F.col("candidate_address").alias("formatted_address"),
        F.struct(location.alias("location")).alias("geometry"),
    )
    found = v.place_candidates().groupBy("supplier_site_id").agg(F.collect_list(candidate).alias("candidates"))
    asked = site_match.geocode_queries(v.site(), v.country()).select("supplier_site_id", "site_name_city_country")
    return asked.join(found, "supplier_site_id", "left")


def _geo(v: LabViews) -> tuple[DataFrame, DataFrame]:
    return (
        site_match.active_sites(v.supplier_geo(), v.active_locations()),
        site_match.labs_in(v.datim_lab_sites(), LAB_COUNTRIES),
    )


QUERIES: dict[str, Query] = {
    "read_lab_csv": _on(_read_lab_csv),
    "read_lab_folder": _on(_read_lab_folder),
    "read_lab_columns": _on(_read_lab_columns),
    "read_lab_set": _on(_read_lab_set),
    "first_in_file": _on(_first_in_file),
    "scan_ranges": _on(_scan_ranges),
    "blank_to_null": _on(_blank_to_null),
    "write_table_csv": _on(_write_table_csv),
    "csv_round_trip": _on(_csv_round_trip),
    "site_error_files": _on(_site_error_files),
    "model_upper": _on(lambda v: cleaning.normalise_model(v.instrument_master(), "upper")),
    "model_ascii_lower": _on(lambda v: cleaning.normalise_model(v.instrument_master(), "ascii")),
    "active_instruments": _on(lambda v: cleaning.referenced_instruments(v.instrument_master(), v.test_activity_roche())),
    "activity_enriched": _on(lambda v: cleaning.enrich_activity(v.test_activity_abbott(), v.instrument_master())),
    "activity_hiv_tests": _on(lambda v: cleaning.filter_psm(v.test_activity_abbott(), v.test_type())),
    "model_family_filter": _on(_family_rows),
    "plate_well": _on(lambda v: cleaning.parse_plate(_record_ids(v))),
    "plate_parts": _on(lambda v: cleaning.split_record_id(_record_ids(v))),
    "abbott_error_codes": _on(
        lambda v: plates.error_details(
            v.test_activity_abbott(), v.instrument_master(), v.test_type(), v.error_type(), v.site()
        )
    ),
    "affected_plates": _on(_affected),
    "total_plates": _on(_total),
    **_plate_levels(),
    "percent_plates_levels": _on(lambda v: plates.percent_plates_levels(*_plate_tables(v))),
    "plate_state_shares": _on(_plate_state_shares),
    "tests_per_date": _on(lambda v: code_rates.tests_per_date(v.test())),
    "countries_sites": _on(lambda v: code_rates.countries_sites(*_roche(v))),
    "error_codes_long": _on(lambda v: code_rates.error_codes_long(*_roche(v))),
    "top_codes_model": _on(lambda v: code_rates.top_codes(*_roche(v), ["country_code", "instrument_model"])),
    "top_codes_instrument": _on(lambda v: code_rates.top_codes(*_roche(v), ["country_code", "instrument_id"])),
    "top_codes_country": _on(lambda v: code_rates.top_codes(*_roche(v), ["country_code"])),
    "top_codes_global": _on(lambda v: code_rates.top_codes(*_roche(v), [])),
    "top_codes_series": _on(lambda v: code_rates.top_codes_series(*_roche(v))),
    "top_codes_country_series": _on(lambda v: code_rates.top_codes_series(*_roche(v), ["country_code"])),
    "codes_nearest_month": _on(lambda v: code_rates.codes_nearest_month(*_roche(v))),
    "monthly_code_rate": _on(_monthly),
    "monthly_code_rate_15": _on(lambda v: code_rates.monthly_code_rate(*_roche(v), max_codes=15)),
    "monthly_code_rate_per_test": _on(lambda v: code_rates.monthly_code_rate(*_roche(v), denominator="tests")),
    "tally_state_rates": _on(_tally_state_rates),
    "site_monthly_code_rate": _on(lambda v: code_rates.site_monthly_code_rate(*_roche(v))),
    "site_code_rate": _on(_site_code_rate),
    "top_errors_country": _on(lambda v: code_rates.top_errors_country(_monthly(v), EXCLUDED_COUNTRY)),
    "country_error_series": _on(lambda v: code_rates.country_error_series(_monthly(v), EXCLUDED_COUNTRY)),
    "error_country_series": _on(lambda v: code_rates.error_country_series(_monthly(v), EXCLUDED_COUNTRY)),
    "error_country_series_short": _on(
        lambda v: code_rates.error_country_series(_monthly(v), EXCLUDED_COUNTRY, MONTH_CUT)
    ),
    "mean_code_rate_country": _on(_mean_rate),
    "total_errors_by_site": _on(lambda v: code_rates.total_errors_by_site(_recent(v))),
    "site_error_series_filled": _on(_filled),
    "roche_errors": _on(lambda v: error_rates.test_errors(*_roche(v), v.error_type(), v.site())),
    "roche_errors_9": _on(lambda v: error_rates.test_errors(*_roche(v), v.error_type(), v.site(), max_codes=9)),
    "error_share_all": _on(lambda v: error_rates.error_share_all(*_roche(v), v.error_type())),
    "error_rate_site": _on(lambda v: error_rates.error_rate_site(*_roche(v), v.error_type(), v.site())),
    "error_rate_instrument": _on(lambda v: error_rates.error_rate_instrument(*_roche(v), v.error_type(), v.site())),
    "error_rate_month": _on(lambda v: error_rates.error_rate_month(*_roche(v), v.error_type())),
    "kit_error_log": _on(lambda v: kit_errors.kit_error_log(*_kit(v), v.kit_error_codes())),
    "kit_error_totals": _on(lambda v: kit_errors.kit_error_totals(*_kit(v), v.kit_error_codes())),
    "kit_error_bars": _on(lambda v: kit_errors.kit_error_bars(kit_errors.kit_error_totals(*_kit(v), v.kit_error_codes()))),
    "plate_status": _on(_status),
    "plate_status_by_country": _on(lambda v: kit_errors.plate_status_by_country(_status(v))),
    "tests_last_year": _on(lambda v: test_summary.tests_last_year(*_tests(v))),
    "tests_last_year_blanks": _on(_tests_with_blanks),
    "sites_instruments_country": _on(
        lambda v: test_summary.sites_instruments(v.test(), v.instrument_master(), v.site(), v.country(), AS_OF)
    ),
    "test_sample_table": _on(lambda v: _test_table(v, "tot_patient_test")),
    "test_error_table": _on(lambda v: _test_table(v, "tot_patient_error")),
    "test_perc_table": _on(_share_table),
    "test_perc_table_seen": _on(lambda v: wide.spread(test_summary.error_share_table(*_tests(v)))),
    "instruments_country_seen": _on(
        lambda v: wide.spread(instrument_summary.instrument_counts(*_instruments(v), by_country=True))
    ),
    "report_period": _on(lambda v: test_summary.report_period(v.test(), AS_OF)),
    "display_table": _on(lambda v: test_summary.format_report(_test_table(v, "tot_patient_test"))),
    "display_table_percent": _on(lambda v: test_summary.format_report(_share_table(v), "percent", TEST_TYPES)),
    "instruments_by_quarter": _on(lambda v: instrument_summary.instruments_by_quarter(*_instruments(v))),
    "instruments_global": _on(lambda v: instrument_summary.instrument_counts(*_instruments(v), quarters=QUARTERS)),
    "instruments_country": _on(
        lambda v: instrument_summary.instrument_counts(*_instruments(v), by_country=True, quarters=QUARTERS)
    ),
    "geocode_queries": _on(lambda v: site_match.geocode_queries(v.site(), v.country())),
    "flatten_candidates": _on(lambda v: site_match.flatten_candidates(_replies(v))),
    "lab_filters": _on(lambda v: _geo(v)[1]),
    "active_lab_sites": _on(lambda v: _geo(v)[0]),
    "nearest_lab": _on(lambda v: site_match.nearest_lab(*_geo(v))),
}
