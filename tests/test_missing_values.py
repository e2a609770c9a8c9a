"""The missing-value and text rules, each on a few literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assayline.functions import dates, labels, nulls, text
from assayline.operators.cleaning import instruments, split_record_id
from assayline.operators.lookups import attach, keep_listed
from assayline.operators.ranking import top_with_ties


def values(df):
    return [tuple(r) for r in df.collect()]


def test_sums_with_a_missing_value(rows):
    df = rows("k string, x bigint", ("a", 1), ("a", None), ("b", 2), ("b", 3), ("c", None))
    got = df.groupBy("k").agg(
        nulls.sum_na("x").alias("s"), nulls.sum_skip("x").alias("z"), nulls.max_na("x").alias("m")
    )
    assert sorted(values(got)) == [("a", None, 1, None), ("b", 5, 5, 3), ("c", None, 0, None)]


def test_distinct_count_counts_missing_once(rows):
    df = rows("x bigint", (1,), (None,), (1,), (None,))
    assert values(df.agg(nulls.n_unique("x"))) == [(2,)]


def test_zero_denominator_is_missing(rows):
    df = rows("n bigint, d bigint", (1, 0), (1, 4), (0, 0))
    assert values(df.select(nulls.percent("n", "d"))) == [(None,), (25.0,), (None,)]


def test_paste_writes_missing_as_text(rows):
    df = rows("a string, b string", ("x", None), (None, None))
    assert values(df.select(nulls.paste("a", "b"))) == [("x NA",), ("NA NA",)]


def test_blank_to_null(rows):
    df = rows("a string, b bigint", ("", 1), (" ", None), (None, 2))
    assert values(nulls.blank_to_null(df)) == [(None, 1), (" ", None), (None, 2)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_missing_key_matches_missing_key(rows, broadcast):
    fact = rows("k bigint, v string", (1, "a"), (None, "b"), (3, "c"))
    dim = rows("id bigint, w string", (1, "x"), (None, "y"))
    got = attach(fact, dim, [("k", "id")], small=broadcast)
    assert sorted(values(got), key=str) == [(1, "a", "x"), (3, "c", None), (None, "b", "y")]
    assert sorted(values(keep_listed(fact, dim, [("k", "id")])), key=str) == [(1, "a"), (None, "b")]
    assert values(keep_listed(fact, dim, [("k", "id")], "left_anti")) == [(3, "c")]


def test_repeated_dimension_key_repeats_rows(rows):
    got = attach(rows("k bigint", (1,)), rows("k bigint, w string", (1, "x"), (1, "y")), "k")
    assert sorted(values(got)) == [(1, "x"), (1, "y")]


def test_instrument_id_that_is_no_number(rows):
    df = rows("instrument_id string, instrument_model string, supplier_site_id bigint", ("12", "Cobas®  4800", 1), ("x", None, 2))
    assert values(instruments(df)) == [(12, "COBAS  4800", 1), (None, None, 2)]
    assert values(instruments(df, "caps").select("instrument_model")) == [("COBAS®  4800",), (None,)]
    assert values(instruments(df, "ascii").select("instrument_model")) == [("cobas 4800",), (None,)]


def test_model_ascii_order_of_steps(rows):
    df = rows("m string", (" Cobas®, 4800 ,x  ",), ("ÄÖ",))
    assert values(df.select(text.model_ascii(F.col("m")))) == [("cobas 4800 x",), ("",)]


def test_plate_and_well(rows):
    df = rows("r string", ("d|t|BC1|F|12",), ("d|t|BC1|F",), ("d|t|BC1|7|",), (None,))
    got = df.select(text.well_number(F.col("r")), text.plate_id(F.col("r")))
    assert values(got) == [("12", "d|t|BC1|F"), (None, "d|t|BC1|F"), (None, "d|t|BC1|7|"), (None, None)]


def test_record_parts_short_long_and_missing(rows):
    got = values(split_record_id(rows("test_record_id string", ("a|b|c",), ("a|b|c|d|e|f",), (None,))))
    assert got == [
        ("a|b|c", "a", "b", "c", None, None, "a b c NA"),
        ("a|b|c|d|e|f", "a", "b", "c", "d", "e", "a b c d"),
        (None, None, None, None, None, None, "NA NA NA NA"),
    ]


def test_code_as_text(rows):
    df = rows("x double", (4442.0,), (6282.18,), (None,))
    assert values(df.select(text.code_text(F.col("x")))) == [("4442",), ("6282.18",), (None,)]


def test_nearest_month(rows):
    days = [("2021-01-16", "2021-01-01"), ("2021-01-17", "2021-02-01"), ("2021-02-15", "2021-03-01"), ("2021-04-16", "2021-05-01")]
    df = rows("d string", *[(d,) for d, _ in days], (None,)).select(F.col("d").cast("date").alias("d"))
    got = [str(r[0]) for r in df.select(dates.month_nearest(F.col("d"))).collect()]
    assert got == [m for _, m in days] + ["None"]


def test_date_labels(rows):
    df = rows("d string", ("2021-08-09",)).select(F.col("d").cast("date").alias("d"))
    d = F.col("d")
    got = df.select(dates.month_number_label(d), dates.month_name_label(d), dates.quarter_label(dates.quarter_floor(d)))
    assert values(got) == [("08-2021", "Aug 2021", "2021 Q3")]
    assert dates.quarters_between(dt.date(2020, 11, 5), dt.date(2021, 4, 1)) == ["2020 Q4", "2021 Q1", "2021 Q2"]


@pytest.mark.parametrize(
    "x, label",
    [
        (0.0, "0%"),
        (0.123, "0.12%"),
        (0.125, "0.12%"),
        (1.0, "1%"),
        (9.96, "10%"),
        (99.6, "100%"),
        (123.0, "120%"),
        (0.0012, "0.0012%"),
        (0.0001, "1e-04%"),
        (0.00012, "0.00012%"),
        (0.000012, "1.2e-05%"),
        (100000.0, "1e+05%"),
    ],
)
def test_two_digit_labels(rows, x, label):
    assert values(labels.with_percent_label(rows("x double", (x,)), "x")) == [(x, label)]


def test_report_numbers(rows):
    df = rows("x double", (999.0,), (1234.0,), (4_500_000.0,), (2e9,), (None,), (-1500.0,))
    got = [r[0] for r in df.select(labels.number_text(F.col("x"))).collect()]
    assert got == ["999.00", "1.23K", "4.50M", "2.00B", "—", "-1.50K"]
    got = [r[0] for r in rows("x double", (0.0451,), (None,), (12.0,)).select(labels.percent_text(F.col("x"))).collect()]
    assert got == ["4.5%", "—", "1,200.0%"]


def test_top_keeps_ties(rows):
    df = rows("g string, c string, n bigint", ("a", "p", 3), ("a", "q", 3), ("a", "r", 2), ("b", "p", 1), (None, "z", 9))
    assert sorted(values(top_with_ties(df, ["g"], "n", 2)), key=str) == [("a", "p", 3), ("a", "q", 3), ("b", "p", 1), (None, "z", 9)]
    assert sorted(r["c"] for r in top_with_ties(df, [], "n", 3).collect()) == ["p", "q", "z"]
    assert sorted(r["c"] for r in top_with_ties(df.filter("g = 'a'"), [], "n", 9).collect()) == ["p", "q", "r"]
