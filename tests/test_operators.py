"""Operators on small literal tables, and the invariants that tie them together."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from assayline.operators import code_rates, error_rates, kit_errors, plates, site_match, test_summary, wide
from assayline.plans.lab_views import LabViews

MEDIUM = "/root/testdata/sf0.01"
D = dt.date


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Plates

WELLS = (
    "instrument_id bigint, test_type_id string, test_record_id string, country_code string, test_date date,"
    " error_type_id double, error_count bigint"
)


@pytest.fixture
def plate_tables(rows):
    activity = rows(
        WELLS,
        (1, "vl", "d|t|B1|F|1", "C1", D(2021, 3, 2), 4442.0, 1),
        (1, "vl", "d|t|B1|F|2", "C1", D(2021, 3, 2), 4442.0, 2),
        (1, "vl", "d|t|B1|F|3", "C1", D(2021, 3, 2), None, 1),
        (1, "vl", "d|t|B2|F|1", "C1", D(2021, 3, 9), 4457.0, 0),
        (2, "vl", "d|t|B1|F|4", "C1", D(2021, 3, 2), 4442.0, 1),
        (9, "vl", "d|t|B3|F|1", None, D(2021, 3, 2), None, None),
        (1, "tb", "d|t|B4|F|1", "C1", D(2021, 3, 2), 4442.0, 1),
    )
    master = rows(
        "instrument_id bigint, instrument_model string, supplier_site_id bigint", (1, "m2000rt®", 10), (2, "m2000rt", 11)
    )
    types = rows("test_type_id string, test_type_psm string", ("vl", "VL"), ("tb", "TB"))
    site = rows("supplier_site_id bigint, supplier_site_name string", (10, "North"), (11, "South"))
    return activity, master, types, site


def test_plate_percentages(plate_tables):
    # B1 was seen on two instruments and counts twice, above and below the line.
    got = values(plates.percent_plates(*plate_tables, "my"))
    assert got == [("03-2021", "4442", 2, 4, 50.0), ("03-2021", None, 1, 4, 25.0)]
    got = values(plates.percent_plates(*plate_tables, "my_country"))
    assert got == [("03-2021", "C1", "4442", 2, 3, 200 / 3), ("03-2021", "C1", None, 1, 3, 100 / 3)]


def test_listing_an_instrument_twice_does_not_double_its_plates(plate_tables, rows):
    activity, master, types, site = plate_tables
    twice = master.unionByName(master)
    assert values(plates.total_plates(activity, twice, types, site)) == values(plates.total_plates(activity, master, types, site))
    assert values(plates.percent_plates(activity, twice, types.unionByName(types), site)) == values(
        plates.percent_plates(activity, master, types, site)
    )


def test_plate_levels_add_up(spark):
    v = LabViews(spark, MEDIUM)
    tables = v.test_activity_abbott(), v.instrument_master(), v.test_type(), v.site()
    for fine, at, column in (
        (plates.affected_plates(*tables), plates.affected_at, "plates_affected"),
        (plates.total_plates(*tables), plates.total_at, "plates"),
    ):
        sums = {fine.agg(F.sum(column)).first()[0]}
        sums |= {at(fine, level).agg(F.sum(column)).first()[0] for level in plates.LEVELS}
        assert len(sums) == 1
    shares = plates.percent_plates(*tables, "my_country_site")
    assert shares.filter("percent > 100 or percent is null").count() == 0


# Codes

TESTS = "record_key bigint, instrument_id bigint, country_code string, test_date date, error_code_list string"


@pytest.fixture
def code_tables(rows):
    activity = rows(
        TESTS,
        (1, 1, "A", D(2021, 3, 2), "x,y,x"),
        (2, 1, "A", D(2021, 3, 3), None),
        (3, 1, "A", D(2021, 3, 4), ",y,"),
        (4, 7, "A", D(2021, 3, 4), "x"),
        (5, 1, None, D(2021, 3, 4), ",".join(str(i) for i in range(17))),
    )
    master = rows(
        "instrument_id bigint, instrument_model string, supplier_site_id bigint", (1, "cobas® 4800", 10), (3, "m2000", 11)
    )
    return activity, master


def test_explode_keeps_blanks_and_cuts_off(code_tables):
    activity, _ = code_tables
    got = values(code_rates.explode_codes(activity.filter("record_key = 3").select("record_key", "error_code_list")))
    assert got == [(3, 0, ""), (3, 1, "y"), (3, 2, "")]
    long = activity.filter("record_key = 5")
    assert code_rates.explode_codes(long).count() == 17
    assert code_rates.explode_codes(long, 15).count() == 15
    assert code_rates.explode_codes(long, 9).count() == 9
    padded = code_rates.explode_codes(activity, keep_empty=True)
    assert {r["n"] for r in padded.filter("record_key < 5").groupBy("record_key").agg(F.count("*").alias("n")).collect()} == {15}
    assert padded.filter("record_key = 5").count() == 17
    assert padded.filter("record_key = 2 and error_code_list is not null").count() == 0


def test_both_denominators(code_tables):
    def of(denominator):
        found = code_rates.monthly_code_rate(*code_tables, denominator=denominator).filter("country_code = 'A'")
        return {r["error_code_list"]: (r["n"], r["tests"], r["error_percent"]) for r in found.collect()}

    # Instrument 7 is unknown, so its test is no test of a known model.
    assert of("slots") == {"x": (2, 45, 200 / 45), "y": (2, 45, 200 / 45), "": (2, 45, 200 / 45)}
    assert of("tests") == {"x": (2, 3, 200 / 3), "y": (2, 3, 200 / 3), "": (2, 3, 200 / 3)}


def test_second_generation_rows(code_tables, rows):
    error_type = rows(
        "error_type_id string, error_type_description string, supplier_id bigint",
        ("x", "ex", 1000),
        ("x", "again", 1000),
        ("y", "other supplier", 1001),
        ("6282.36", "original", 1000),
    )
    site = rows("supplier_site_id bigint, supplier_site_name string", (10, "North"))
    activity, master = code_tables
    extra = rows(TESTS, (6, 1, "A", D(2021, 4, 30), "6282.36"))
    full = activity.unionByName(extra)
    for c in ("test_type_id", "is_patient_test", "is_control_test", "patient_test_error_flag", "control_test_error_flag", "excluded_test"):
        full = full.withColumn(c, F.lit(0))
    got = error_rates.test_errors(full, master, error_type, site)
    picked = got.filter("country_code = 'A'").select("internal_id", "name", "error_code_list", "error_type_description", "test_month_year")
    assert values(picked) == sorted(
        [
            ("INTERNAL-1", "a", "x", "again", "Mar 2021"),
            ("INTERNAL-1", "b", "y", None, "Mar 2021"),
            ("INTERNAL-2", "a", None, None, "Mar 2021"),
            ("INTERNAL-3", "a", "", None, "Mar 2021"),
            ("INTERNAL-3", "b", "y", None, "Mar 2021"),
            ("INTERNAL-6", "a", "6282.36", error_rates.OVERRIDES["6282.36"], "Apr 2021"),
        ],
        key=str,
    )
    assert got.filter("internal_id = 'INTERNAL-5'").count() == 17
    cut = error_rates.test_errors(full, master, error_type, site, max_codes=9)
    assert cut.filter("internal_id = 'INTERNAL-5'").count() == 9

    shares = {r["error_code_list"]: r for r in error_rates.error_share_all(full, master, error_type).collect()}
    assert (shares["y"]["n"], shares["y"]["error_percent"]) == (2, 200 / 5)
    fixed = error_rates.error_share_all(full, master, error_type, total_tests=1000)
    assert {r["error_percent"] for r in fixed.filter("error_code_list = 'y'").collect()} == {0.2}
    month = error_rates.error_rate_month(full, master, error_type).filter("error_code_list = 'y'").collect()
    assert [(r["n"], r["tests_run"]) for r in month] == [(2, 3)]


def test_second_generation_invariants(spark):
    v = LabViews(spark, MEDIUM)
    errors = error_rates.test_errors(v.test_activity_roche(), v.instrument_master(), v.error_type(), v.site())
    keyed = errors.groupBy("internal_id", "error_code_list").agg(F.count("*").alias("n"))
    assert keyed.filter("n > 1").count() == 0
    per_test = errors.groupBy("internal_id").agg(
        F.count("*").alias("n"), F.count("error_code_list").alias("codes"), F.sum(F.when(F.col("name") == "a", 1)).alias("first")
    )
    assert per_test.filter("codes = 0 and n > 1 or first <> 1").count() == 0


def test_gap_fill_is_complete(rows):
    layout = "country_code string, supplier_site_id bigint, month date, error_code_list string, n bigint, tests bigint, percent double"
    known = rows(
        layout,
        ("A", 1, D(2021, 1, 1), "p", 1, 10, 10.0),
        ("B", 1, D(2021, 1, 1), "p", 1, 10, 20.0),
        ("A", 2, D(2021, 2, 1), "other", 1, 10, 5.0),
    )
    months = rows("month date", (D(2021, 1, 1),), (D(2021, 2, 1),))
    got = code_rates.gap_fill(known, months, ["p", "q"]).select("supplier_site_id", "error_code_list", "month", "percent", "label")
    filled = {(s, c, m): (p, t) for s, c, m, p, t in (tuple(r) for r in got.collect())}
    assert got.count() == 2 * 2 * 2 + 1  # two countries report the same site, code and month
    assert filled[(2, "q", D(2021, 2, 1))] == (0.0, "")
    assert sorted(r["label"] for r in got.filter("percent > 0").collect()) == ["10%", "20%"]


# Kits and summaries


def test_kit_totals_with_missing_count(rows):
    activity = rows(
        WELLS + ", is_patient_test int, is_control_test int, patient_test_error_flag int, control_test_error_flag int, excluded_tests int",
        (1, "vl", "d|t|B1|F|1", "C1", D(2021, 3, 2), 4441.0, 1, 1, 0, 0, 0, 0),
        (1, "vl", "d|t|B1|F|2", "C1", D(2021, 3, 2), 4441.0, None, 1, 0, 0, 0, 0),
        (1, "vl", "d|t|B2|F|1", "C1", D(2021, 3, 2), 4442.0, 4, 1, 0, 0, 0, 0),
        (1, "vl", "d|t|B3|F|1", "C1", D(2021, 3, 2), 9.0, 4, 1, 0, 0, 0, 0),
        (2, "vl", "d|t|B4|F|1", "C1", D(2021, 3, 2), 4442.0, 4, 1, 0, 0, 0, 0),
        (1, "vl", None, "C1", D(2021, 3, 2), None, 4, 1, 0, 0, 0, 0),
    )
    master = rows("instrument_id bigint, instrument_model string, supplier_site_id bigint", (1, "M2000rt®", 10), (2, "other", 10))
    site = rows("supplier_site_id bigint, country_code string", (10, "C1"))
    country = rows("country_code string, country_name string", ("C1", "Land"))
    codes = rows(
        "error_code bigint, category_message string, possible_issue string, protocol string", (4441, "a", "i", "p"), (4442, "b", "i", "p")
    )
    totals = kit_errors.kit_error_totals(activity, master, site, country, codes)
    assert [tuple(r) for r in totals.collect()] == [("b", 4442.0, 4), ("a", 4441.0, None)]
    status = kit_errors.plate_status(activity, master, site, country)
    assert values(status) == [
        ("Land", "NA NA NA NA", "non-affected"),
        ("Land", "d t B1 F", "affected"),
        ("Land", "d t B2 F", "affected"),
        ("Land", "d t B3 F", "non-affected"),
    ]
    assert values(kit_errors.plate_status_by_country(status)) == [("Land", 2, 2)]


@pytest.fixture
def summary_tables(rows):
    test = rows(
        "test_id bigint, instrument_id bigint, test_type_id string, test_date date, tot_patient_test bigint, tot_patient_error bigint",
        (1, 1, "v", D(2021, 6, 2), 10, 1),
        (2, 1, "v", D(2021, 6, 3), 30, 1),
        (3, 2, "e", D(2021, 6, 3), None, 2),
        (4, 2, "e", D(2021, 6, 4), 5, 2),
        (5, 8, "?", D(2021, 6, 4), 0, 2),
        (6, 1, "v", D(2020, 6, 1), 99, 99),
    )
    master = rows("instrument_id bigint, instrument_model string, supplier_site_id bigint", (1, "a", 10), (2, "a", 10))
    site = rows("supplier_site_id bigint, country_code string", (10, "C1"))
    types = rows("test_type_id string, test_type string", ("v", "VL"), ("e", "EID"))
    country = rows("country_code string, country_name string", ("C1", "Land"))
    return test, master, site, types, country, D(2021, 6, 1)


def test_summary_tables(summary_tables):
    tests = wide.spread(test_summary.test_table(*summary_tables, "tot_patient_test"))
    assert tests.columns == ["Country", "EID", "NA", "VL", "Total sites", "Total instruments"]
    assert values(tests) == [("Land", None, None, 40, 1, 2), (None, None, 0, None, 1, 1)]
    share = test_summary.error_share_table(*summary_tables, ["VL", "NA"])
    assert values(share) == [("Land", 0.05, None, 1, 2), (None, None, None, 1, 1)]
    shown = test_summary.format_report(share, "percent", ["VL"])
    assert values(shown) == [("Land", "5.0%", "—", "1", "2"), ("—", "—", "—", "1", "1")]
    assert test_summary.tests_last_year(*summary_tables).count() == 5


def test_names_become_columns_at_the_sink(spark, summary_tables):
    """No job runs before; values, text and order are those of columns given beforehand."""
    from assayline.functions import labels
    from assayline.operators import instrument_summary

    test, master, site, types, country, day = summary_tables
    spark.sparkContext.setJobGroup("planning", "no job")
    shares = test_summary.error_share_table(*summary_tables)
    named = {
        "tests": test_summary.format_report(test_summary.test_table(*summary_tables, "tot_patient_test")),
        "share": test_summary.format_report(shares, "percent"),
        "quarters": test_summary.format_report(instrument_summary.instrument_counts(test, master, site, country, day), "plain"),
    }
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    columns = ["EID", "NA", "VL"]
    given = {
        "tests": test_summary.format_report(test_summary.test_table(*summary_tables, "tot_patient_test", columns)),
        "share": test_summary.format_report(test_summary.error_share_table(*summary_tables, columns), "percent", columns),
        "quarters": test_summary.format_report(
            instrument_summary.instrument_counts(test, master, site, country, day, quarters=["2021 Q2"]), "plain"
        ),
    }
    for name, df in named.items():
        assert wide.is_gathered(df) and not wide.is_gathered(given[name])
        shown = wide.spread(df, F.lit(labels.MISSING))
        assert (shown.columns, values(shown)) == (given[name].columns, values(given[name]))
    assert wide.spread(given["tests"]) is given["tests"]
    none = test_summary.test_table(test.filter("false"), master, site, types, country, day)
    assert wide.spread(none).columns == ["Country", "Total sites", "Total instruments"]


# Sites


def haversine(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians((lat2 - lat1) / 2)) ** 2
    a += math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians((lon2 - lon1) / 2)) ** 2
    return 2 * 6378137.0 * math.asin(min(1.0, math.sqrt(a)))


@pytest.mark.parametrize("shuffled", [False, True])
def test_nearest_lab_against_brute_force(spark, rows, request, shuffled):
    if shuffled:
        request.getfixturevalue("no_broadcast")
    rng = random.Random(5)

    def anywhere():
        return (rng.uniform(-90, 90), rng.uniform(-180, 180))

    town = (-1.3, 36.8)
    near_town = [(town[0] + rng.gauss(0, 0.02), town[1] + rng.gauss(0, 0.02)) for _ in range(150)]
    edges = [(89.99, 10.0), (89.99, -170.0), (-90.0, 0.0), (0.0, 179.999), (0.0, -179.999), town, town]
    labs = near_town + edges + [anywhere() for _ in range(60)]
    sites = [(town[0] + rng.gauss(0, 0.05), town[1] + rng.gauss(0, 0.05)) for _ in range(80)]
    sites += [anywhere() for _ in range(80)] + edges + [(90.0, 77.0), (0.0, 180.0), (0.0, 0.0)]
    lab_rows = [(i, f"lab {i}", "x", lat, lon) for i, (lat, lon) in enumerate(labs)] + [(999, "nowhere", "x", None, 1.0)]
    site_rows = [(i, lat, lon) for i, (lat, lon) in enumerate(sites)] + [(5000, None, 3.0), (5001, None, None)]
    lab_df = rows("id bigint, name string, countryname string, latitude double, longitude double", *lab_rows)
    site_df = rows("supplier_site_id bigint, candidate_lat double, candidate_lon double", *site_rows)
    got = {r["supplier_site_id"]: r for r in site_match.nearest_lab(site_df, lab_df).collect()}
    assert len(got) == len(site_rows)
    assert got[5000]["id"] is None and got[5001]["distance_nearest_datim_loc_km"] is None
    for key, (lat, lon) in enumerate(sites):
        distances = [haversine(lat, lon, *lab) for lab in labs]
        best = min(distances)
        # The chosen lab is as near as the nearest; among exact copies it is the first.
        assert distances[got[key]["id"]] <= best + 1e-6
        assert got[key]["id"] == labs.index(labs[got[key]["id"]])
        assert got[key]["distance_nearest_datim_loc_km"] == pytest.approx(best / 1000, abs=0.0051)


def test_candidates_of_a_site_without_any(spark):
    replies = spark.sql(
        "select 1L supplier_site_id, 'a b' site_name_city_country, cast(array() as array<struct<name:string,"
        "formatted_address:string,geometry:struct<location:struct<lat:double,lng:double>>>>) candidates"
    )
    assert values(site_match.flatten_candidates(replies)) == [(1, "a b", None, None, None, None)]
    asked = site_match.geocode_queries(
        spark.sql("select 1L supplier_site_id, ' Clinique  é ' supplier_site_name, cast(null as string) city, 'C1' country_code"),
        spark.sql("select 'C1' country_code, 'Land' country_name"),
    )
    assert asked.first()["query"] == "Clinique NA Land laboratory"
