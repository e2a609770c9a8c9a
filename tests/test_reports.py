"""The whole way from a folder of exports to the written reports."""

import datetime as dt

from assayline import reports
from assayline.operators import code_rates, error_rates
from assayline.plans.lab_views import LabViews
from assayline.schemas import SCHEMAS
from assayline.sources.lab_csv import read_lab_folder, write_table

SMALL = "/root/testdata/sf0.001"


def test_folder_to_reports(spark, tmp_path):
    views = LabViews(spark, SMALL)
    for table in SCHEMAS:
        write_table(getattr(views, table)(), str(tmp_path / "in" / f"{table}_20220724.csv"))
    t = read_lab_folder(spark, str(tmp_path / "in"))
    assert set(t) == set(SCHEMAS)
    found = {
        **reports.plate_reports(t),
        **reports.code_reports(t, "2000-11-01", "C3"),
        **reports.test_error_reports(t),
        **reports.kit_reports(t),
        **reports.summary_reports(t, dt.date(2001, 8, 1)),
        **reports.instrument_reports(t, dt.date(2000, 7, 1)),
        **reports.site_reports(t, tuple(f"NATION_{i}" for i in range(1, 8))),
    }
    out = tmp_path / "out"
    reports.write_reports(found, str(out))
    assert sorted(p.name for p in out.iterdir()) == sorted(f"{name}.csv" for name in found)

    def read(path):
        return spark.read.option("header", True).csv(str(path))

    assert read(out / "total_errors_by_site.csv").columns == ["supplier_site_id", "n", "tests", "percent"]
    assert sorted(p.name for p in (out / "percent_plates.csv").glob("level=*")) == [
        "level=my",
        "level=my_country",
        "level=my_country_site",
    ]
    sites = {p.name for p in (out / "errors_site.csv").glob("supplier_site_id=*")}
    assert sites and all(len(list((out / "errors_site.csv" / s).glob("*.csv"))) == 1 for s in sites)
    assert all(read(out / f"{name}.csv").head(1) for name in found)
    for name in ("percent_plates", "test_errors_month", "errors_site"):
        assert read(out / f"{name}.csv").count() == found[name].count()
    # Reading from CSV gives what the views give.
    assert read(out / "instruments_global.csv").columns == ["instrument_model", "2000 Q3", "2000 Q4", "2001 Q1", "2001 Q2", "2001 Q3"]
    direct = reports.test_error_reports({n: getattr(views, n)() for n in SCHEMAS})["test_errors_site"]
    assert sorted(map(str, found["test_errors_site"].collect())) == sorted(map(str, direct.collect()))


def test_report_sets_count_the_tests_once(spark):
    """The counted files are made from a stored tally, and equal the single queries."""
    views = LabViews(spark, SMALL)
    t = {n: getattr(views, n)() for n in SCHEMAS}
    rows = lambda df: sorted(map(str, df.collect()))
    codes = reports.code_reports(t, "2000-11-01", "C3")
    errors = reports.test_error_reports(t)
    for name, df in {**codes, **errors}.items():
        if name != "test_errors":
            assert "orders.parquet" not in df._jdf.queryExecution().toString(), name
    activity, master = t["test_activity_roche"], t["instrument_master"]
    single = {
        "countries_sites": code_rates.countries_sites(activity, master),
        "top_codes_instrument_model": code_rates.top_codes(activity, master, ["country_code", "instrument_model"]),
        "top_codes_instrument_id": code_rates.top_codes(activity, master, ["country_code", "instrument_id"]),
        "country_error_series": code_rates.country_error_series(code_rates.monthly_code_rate(activity, master), "C3"),
    }
    recent = code_rates.recent_sites(code_rates.site_monthly_code_rate(activity, master), "2000-11-01", "C3")
    single["site_error_series"] = code_rates.gap_fill(recent, code_rates.months_seen(activity, master, "2000-11-01"))
    single["errors_site"] = code_rates.site_code_rate(recent)
    for name, df in single.items():
        assert rows(codes[name]) == rows(df), name
    second = {
        "all_error_percentages": error_rates.error_share_all(activity, master, t["error_type"]),
        "test_errors_site": error_rates.error_rate_site(activity, master, t["error_type"], t["site"]),
        "test_errors_instrument": error_rates.error_rate_instrument(activity, master, t["error_type"], t["site"]),
        "test_errors_month": error_rates.error_rate_month(activity, master, t["error_type"]),
    }
    for name, df in second.items():
        assert rows(errors[name]) == rows(df), name
