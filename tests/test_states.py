"""Kept plate marks and tallies against counting everything again."""

import datetime as dt
import pathlib
import shutil

import oracle
import pytest
from pyspark.sql import functions as F

from assayline.operators import code_rates, ordering, plate_state, plates, tally_state
from assayline.schemas import SCHEMAS
from assayline.sources import lab_csv
from assayline.state import State

ACTIVITY = (
    "instrument_id bigint, test_type_id string, test_record_id string, country_code string, test_date date,"
    " error_type_id double, error_count bigint"
)
TYPES = [("t", "T", "VL"), ("u", "U", "TB")]


def well(day, plate, well, code=None, instrument=1, country="C1", kind="t"):
    day = None if day is None else dt.date(2022, *day)
    return (instrument, kind, f"{plate}|{well}", country, day, code, 0 if code is None else 1)


def bag(df):
    return oracle.spark_result(df)


FIRST = [
    well((1, 5), "d|v|p1|l", 1), well((1, 5), "d|v|p1|l", 2, 4441.0), well((1, 9), "d|v|p2|l", 1, 4442.0, None, None),
    well((2, 1), "d|v|p3|l", 1, 4441.0), well(None, "d|v|p4|l", 1, 4441.0), well((2, 3), "d|v|p5|l", 1, kind="u"),
]
SECOND = [
    well((2, 1), "d|v|p3|l", 1, 4441.0), well((2, 1), "d|v|p3|l", 2, 4457.0), well((2, 8), "d|v|p6|l", 1), well(None, "d|v|p4|l", 2),
    well((3, 8), "d|v|p6|l", 1, 4441.0, 2, None),
]


def test_plate_state_equals_the_recount(spark, rows, tmp_path):
    folder, types = str(tmp_path), rows("test_type_id string, test_type string, test_type_psm string", *TYPES)
    master = rows("instrument_id bigint, instrument_model string, supplier_site_id bigint", (1, "a", 5), (2, "b", 6))
    site = rows("supplier_site_id bigint, supplier_site_name string", (5, "s"), (6, "q"))
    assert plate_state.merge_plates(rows(ACTIVITY, *FIRST), types, folder, batch="one") == ["2022-01", "2022-02", "none"]
    assert plate_state.merge_plates(rows(ACTIVITY, *SECOND), types, folder) == ["2022-02", "2022-03", "none"]
    whole = plates.plate_marks(rows(ACTIVITY, *FIRST, *SECOND), types)
    assert oracle.difference(bag(plate_state.read_marks(spark, folder)), bag(whole)) is None
    assert plate_state.merge_plates(rows(ACTIVITY, *SECOND), types, folder) == ["2022-02", "2022-03", "none"]  # merged again: the same
    assert plate_state.merge_plates(rows(ACTIVITY, *SECOND), types, folder, batch="one") == []
    marks = plate_state.read_marks(spark, folder)
    for level in plates.LEVELS:
        want = plates.percent_plates(rows(ACTIVITY, *FIRST, *SECOND), master, types, site, level)
        assert oracle.difference(bag(plates.percent_plates(marks, master, None, site, level)), bag(want)) is None
    plate_state.compact(spark, folder)
    assert len(State(spark, folder).paths("marks")) == 1
    assert oracle.difference(bag(plate_state.read_marks(spark, folder)), bag(whole)) is None
    with pytest.raises(ValueError, match="begun with"):
        plate_state.merge_plates(rows(ACTIVITY, *FIRST), types, folder, groups=["TB"])


def test_other_months_are_not_read(spark, rows, tmp_path):
    """The files of a month that a batch doesn't have may as well be gone."""
    folder, types = str(tmp_path / "state"), rows("test_type_id string, test_type string, test_type_psm string", *TYPES)
    plate_state.merge_plates(rows(ACTIVITY, *FIRST), types, folder)
    for month in pathlib.Path(folder, "marks").glob("*/of=2022-01"):
        for file in month.glob("*.parquet"):
            file.write_bytes(b"unreadable")
    plate_state.merge_plates(rows(ACTIVITY, *SECOND), types, folder)
    later = plate_state.read_marks(spark, folder).filter(F.col("month") >= F.lit("2022-02-01").cast("date"))
    with pytest.raises(Exception, match="(?i)parquet"):
        later.count()  # a reader of all months would have seen it
    for month in pathlib.Path(folder, "marks").glob("*/of=2022-01"):
        shutil.move(month, tmp_path)
    whole = plates.plate_marks(rows(ACTIVITY, *FIRST, *SECOND), types).filter("month is null or month > '2022-01-31'")
    assert oracle.difference(bag(plate_state.read_marks(spark, folder)), bag(whole)) is None


def test_a_batch_that_fails_changes_nothing(spark, rows, tmp_path):
    folder, types = str(tmp_path), rows("test_type_id string, test_type string, test_type_psm string", *TYPES)
    plate_state.merge_plates(rows(ACTIVITY, *FIRST), types, folder)
    before = bag(plate_state.read_marks(spark, folder))
    broken = rows(ACTIVITY, *SECOND).withColumn("instrument_id", F.expr("1 div (error_count - 1)"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        plate_state.merge_plates(broken, types, folder, batch="two")
    assert bag(plate_state.read_marks(spark, folder)) == before
    one, other = State(spark, folder), State(spark, folder)
    one.publish("three")
    with pytest.raises(RuntimeError, match="in the meantime"):
        other.publish("four")
    assert State(spark, folder).contents["batches"] == ["three"]


RECORDS = "record_key bigint, country_code string, instrument_id bigint, test_date date, error_code_list string, version int"


def record(key, day, codes, version=1, country="C1", instrument=1):
    return (key, country, instrument, None if day is None else dt.date(2022, *day), codes, version)


def recount(rows, *records):
    return code_rates.report_tally(rows(RECORDS, *records))


@pytest.mark.parametrize("buckets", [1, 64])
def test_tally_state_equals_the_recount(spark, rows, tmp_path, monkeypatch, buckets):
    monkeypatch.setattr(tally_state, "BUCKETS", buckets)
    folder = str(tmp_path)
    first = [record(i, (1, 1 + i), "a,b,a" if i % 2 else None) for i in range(9)] + [record(None, (1, 9), "a"), record(None, (1, 9), "a")]
    tally_state.merge_records(rows(RECORDS, *first), folder, batch="first")
    assert oracle.difference(bag(tally_state.read_tally(spark, folder)), bag(recount(rows, *first))) is None
    # Replaced: other codes, another month, another instrument, no change. Late: an old month. Twice in the batch: the newest counts.
    second = [record(1, (1, 2), "c"), record(2, (6, 3), "a"), record(3, (1, 4), "a,b", 1, None, None), record(5, (1, 6), "a,b,a")]
    second += [record(20, (1, 1), "z"), record(21, None, "y", 7), record(21, (1, 1), "x", 3), record(None, (1, 9), "a")]
    gone = rows("record_key bigint", (4,), (5,), (99,), (None,), (4,))
    tally_state.merge_records(rows(RECORDS, *second), folder, removed=gone, version=F.col("version"), batch="second")
    left = [r for r in first if r[0] not in (1, 2, 3, 4, 5)] + [r for r in second if r[:2] + r[5:] != (21, "C1", 3)]
    assert oracle.difference(bag(tally_state.read_tally(spark, folder)), bag(recount(rows, *left))) is None
    tally_state.merge_records(rows(RECORDS, *second), folder, batch="second")  # known by its name
    assert oracle.difference(bag(tally_state.read_tally(spark, folder)), bag(recount(rows, *left))) is None
    tally_state.compact(spark, folder)
    # Removed and come back; removed again; only removals.
    tally_state.merge_records(rows(RECORDS, record(4, (2, 2), "q")), folder)
    tally_state.merge_records(None, folder, removed=rows("record_key bigint", (6,), (4,)))
    left = [r for r in left if r[0] != 6]
    assert oracle.difference(bag(tally_state.read_tally(spark, folder)), bag(recount(rows, *left))) is None
    tally_state.merge_records(None, folder, removed=rows("record_key bigint", *[(i,) for i in range(30)]))
    left = [r for r in left if r[0] is None]
    assert oracle.difference(bag(tally_state.read_tally(spark, folder)), bag(recount(rows, *left))) is None


def test_rates_from_a_kept_tally(spark, rows, tmp_path):
    folder = str(tmp_path)
    records = [record(i, (1 + i % 5, 3), "6284.6,6282.18" if i % 3 else "6284.6", 1, f"C{i % 2}", i % 4) for i in range(40)]
    master = rows("instrument_id bigint, instrument_model string, supplier_site_id bigint", *[(i, "x 4800", i % 2) for i in range(4)])
    for part in range(4):
        tally_state.merge_records(rows(RECORDS, *records[part * 10 : part * 10 + 12]), folder)
    activity, tally = rows(RECORDS, *records), tally_state.read_tally(spark, folder)
    for report in (code_rates.monthly_code_rate, code_rates.site_monthly_code_rate, code_rates.countries_sites):
        assert oracle.difference(bag(report(tally, master)), bag(report(activity, master))) is None


LINES = "".join(f"{i % 50},{'name %d' % (997 * i % 1000)},{i}\n" for i in range(4000))


@pytest.mark.parametrize("split", [400, 3000, 1 << 27])
def test_first_row_in_the_files(spark, tmp_path, split):
    """Whatever the splits: the first row of each key as a reader of one file after the other sees it."""
    folder = tmp_path / "m.csv"
    folder.mkdir()
    names = ",".join(SCHEMAS["instrument_master"].names)
    lines = LINES.splitlines()
    for part in range(3):
        (folder / f"part-{part}.csv").write_text("\n".join([names, *lines[part::3]]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        table = lab_csv.read_csv(spark, str(folder), SCHEMAS["instrument_master"], position=True)
        if split == 400:
            assert table.rdd.getNumPartitions() > 100
        got = ordering.keep_first(table, ["instrument_id"]).drop(lab_csv.POSITION).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    first = {}
    for line in [x for part in range(3) for x in lines[part::3]]:
        key, name, site = line.split(",")
        first.setdefault(int(key), (int(key), name, int(site)))
    assert {tuple(r) for r in got} == set(first.values()) and len(got) == 50


def test_repeats_resolve_by_the_file(spark, tmp_path, rows):
    from assayline.operators import error_rates

    (tmp_path / "error_type.csv").write_text(
        "error_type_id,error_type_name,error_type_description,supplier_id\n1,n,zebra,1000\n1,n,ant,1000\n2,n,NA,1000\n2,n,bee,1000\n"
    )
    by_file = lab_csv.read_lab_csv(spark, str(tmp_path), "error_type", position=True)
    by_name = lab_csv.read_lab_csv(spark, str(tmp_path), "error_type")
    found = lambda t: {tuple(r) for r in error_rates.descriptions(t).collect()}
    assert found(by_file) == {("1", "zebra"), ("2", None)}
    assert found(by_name) == {("1", "ant"), ("2", "bee")}
    plan = error_rates.descriptions(by_file)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min_by" in plan
