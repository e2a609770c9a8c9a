"""Errors per test, first generation: lists of codes, nearest-month buckets.

Every report is made from a tally of codes (``placed_tally``): one pass over the activity table and one
shuffle of rows that are already combined.

All codes of a list count; ``max_codes`` cuts longer lists, as reports with 15 code columns did.

The first generation divides by code *slots*: each test counts ``slots`` times in a denominator, empty
slots included. ``denominator="tests"`` divides by tests instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.functions import dates, labels, text
from assayline.functions.nulls import max_na, n_unique, percent, sum_skip
from assayline.operators.cleaning import instruments, model_family
from assayline.operators.lookups import attach_instrument, dims_small, keep_listed
from assayline.operators.ranking import display_rank, top_with_ties
from assayline.storage import stored

CODE = "error_code_list"
# Code slots of a test in the first generation's denominators, and the codes of its site series, as fixed values.
SLOTS = 15
SERIES_CODES = ("6284.6", "6284.5", "6282.18", "6284.8")
MODEL_LEVEL = ("country_code", "instrument_model")
SITE_LEVEL = ("country_code", "supplier_site_id")


def _family(master: DataFrame) -> DataFrame:
    return model_family(instruments(master, "caps"))


def explode_codes(
    df: DataFrame, max_codes: int | None = None, keep_empty: bool = False, column: str = CODE, slots: int = SLOTS
) -> DataFrame:
    """One row per code of a comma list, with its ``slot`` from 0; ``max_codes`` cuts longer lists.

    ``keep_empty`` gives every test at least ``slots`` rows, unused slots with a NULL code.
    """
    codes = text.code_array(F.col(column), max_codes)
    if keep_empty:
        codes = F.coalesce(codes, F.array().cast("array<string>"))
        unused = F.greatest(F.lit(slots) - F.size(codes), F.lit(0))
        codes = F.concat(codes, F.array_repeat(F.lit(None).cast("string"), unused))
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode(codes).alias("slot", column))


def code_tally(activity: DataFrame, keys: dict[str, Column], max_codes: int | None = None, once_per_test: bool = False) -> DataFrame:
    """Per key columns and code: ``n`` codes, and the ``tests`` of which this row holds the first code.

    A test without codes counts under the NULL code, so ``tests`` summed over all codes of a key is
    its number of tests. ``once_per_test`` counts a code repeated within a test once.
    """
    codes = text.code_array(F.col(CODE), max_codes)
    if once_per_test:
        codes = F.array_distinct(codes)
    named = [column.alias(name) for name, column in keys.items()]
    # Keys are computed per test, before its codes become rows.
    exploded = activity.select(*named, codes.alias("codes")).select(*keys, F.posexplode_outer("codes").alias("slot", CODE))
    first = F.when(F.coalesce(F.col("slot"), F.lit(0)) == 0, 1).otherwise(0)
    return exploded.groupBy(*keys, CODE).agg(
        F.count(CODE).alias("n"), F.sum(first.cast("bigint")).alias("tests")
    )


def report_tally(
    activity: DataFrame, month: Column | None = None, max_codes: int | None = None, once_per_test: bool = False
) -> DataFrame:
    """The one tally from which all counted reports can be made: by country, instrument, nearest month (or ``month``) and code.

    Operators that count take it in place of the activity table; a set of reports then reads that once.
    """
    by = key_columns("country_code", "instrument_id")
    by["month"] = dates.month_nearest(F.col("test_date")) if month is None else month
    return code_tally(activity, by, max_codes, once_per_test)


def _is_tally(df: DataFrame) -> bool:
    return {"n", "tests", CODE} <= set(df.columns)


def key_columns(*names: str) -> dict[str, Column]:
    return {name: F.col(name) for name in names}


def placed_tally(
    activity: DataFrame,
    by: Sequence[str],
    master: DataFrame,
    site: DataFrame | None = None,
    how: str = "left",
    month: Column | None = None,
    max_codes: int | None = None,
    once_per_test: bool = False,
) -> DataFrame:
    """``code_tally`` by columns of the activity table, its ``month``, its instrument and its site.

    With small dimensions the tests get them by broadcast and are counted once, by the columns asked
    for. With large ones the tests are first counted by instrument, and the counts are joined.
    ``activity`` may be a ``report_tally``, whose months, widths and repetitions are then given.
    """
    if _is_tally(activity):
        placed = attach_instrument(activity, master, site, how=how, counted=True)
        return placed.groupBy(*by, CODE).agg(F.sum("n").alias("n"), F.sum("tests").alias("tests"))
    keys = key_columns(*[c for c in by if c in activity.columns], "instrument_id")
    if month is not None:
        keys["month"] = month
    if dims_small((master, site)):
        tests = activity.select(*[column.alias(name) for name, column in keys.items()], CODE)
        placed = attach_instrument(tests, master, site, how=how)
        return code_tally(placed, key_columns(*by), max_codes, once_per_test)
    tally = code_tally(activity, keys, max_codes, once_per_test)
    placed = attach_instrument(tally, master, site, how=how, counted=True)
    return placed.groupBy(*by, CODE).agg(F.sum("n").alias("n"), F.sum("tests").alias("tests"))


def tests_per_date(test: DataFrame, supplier_id: int = 1000) -> DataFrame:
    """Number of tests of one supplier per date, most first."""
    counted = test.filter(F.col("supplier_id") == supplier_id).groupBy("test_date").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "test_date")


def countries_sites(activity: DataFrame, master: DataFrame) -> DataFrame:
    """Different instruments and number of tests per country and site."""
    tests = F.sum("tests") if _is_tally(activity) else F.count(F.lit(1))
    counted = activity.groupBy("country_code", "instrument_id").agg(tests.alias("tests"))
    placed = attach_instrument(counted, instruments(master).drop("instrument_model"), counted=True)
    return placed.groupBy(*SITE_LEVEL).agg(
        n_unique("instrument_id").alias("instruments"), F.sum("tests").alias("tests")
    )


def error_codes_long(activity: DataFrame, master: DataFrame, max_codes: int | None = None) -> DataFrame:
    """One row per reported code with country, site and instrument; tests without codes drop out."""
    coded = activity.filter(F.col(CODE).isNotNull()).select("country_code", "instrument_id", CODE)
    placed = attach_instrument(coded, instruments(master, "caps"))
    return explode_codes(placed, max_codes).select(
        "country_code", "supplier_site_id", "instrument_id", "instrument_model", CODE
    )


def top_codes(
    activity: DataFrame, master: DataFrame, by: Sequence[str], k: int = 5, max_codes: int | None = None
) -> DataFrame:
    """The ``k`` most frequent codes per group, ties kept; ``by`` may be empty."""
    coded = activity.filter(F.col(CODE).isNotNull())
    if "instrument_model" in by:
        counts = placed_tally(coded, by, instruments(master, "caps").drop("supplier_site_id"), max_codes=max_codes)
    elif _is_tally(activity):
        counts = coded.groupBy(*by, CODE).agg(F.sum("n").alias("n"), F.sum("tests").alias("tests"))
    else:
        counts = code_tally(coded, key_columns(*by), max_codes)
    counts = counts.drop("tests")
    return top_with_ties(counts, by, "n", k)


def top_codes_series(
    activity: DataFrame, master: DataFrame, by: Sequence[str] = MODEL_LEVEL, k: int = 5, max_codes: int | None = None
) -> DataFrame:
    """Rows of the bar charts of ``top_codes``: a plot per leading key, a facet per group, and the bar's place."""
    return display_rank(top_codes(activity, master, by, k, max_codes), by[:-1], by, CODE, "n")


def codes_nearest_month(
    activity: DataFrame, master: DataFrame, max_codes: int | None = None, slots: int = SLOTS
) -> DataFrame:
    """One row per code slot of the tests on ``00`` models (at least ``slots``), with the nearest month."""
    placed = attach_instrument(
        activity.select("country_code", "instrument_id", "test_date", CODE), _family(master), how="inner"
    )
    return explode_codes(placed, max_codes, keep_empty=True, slots=slots).select(
        "country_code",
        "supplier_site_id",
        "instrument_model",
        "test_date",
        CODE,
        dates.month_nearest(F.col("test_date")).alias("month"),
    )


def monthly_code_rate(
    activity: DataFrame,
    master: DataFrame,
    by: Sequence[str] = MODEL_LEVEL,
    denominator: str = "slots",
    max_codes: int | None = None,
    slots: int = SLOTS,
) -> DataFrame:
    """Codes per group and nearest month as a percentage of its code slots (or of its tests)."""
    counts = placed_tally(
        activity,
        [*by, "month"],
        _family(master),
        how="inner",
        month=dates.month_nearest(F.col("test_date")),
        max_codes=max_codes,
    )
    # One row per code and group reaches this window, whatever the number of tests.
    in_group = F.sum("tests").over(Window.partitionBy(*by, "month"))
    weight = {"slots": slots, "tests": 1}[denominator]
    return (
        counts.withColumn("tests", in_group * weight)
        .filter(F.col(CODE).isNotNull())
        .withColumn("error_percent", percent("n", "tests"))
    )


def site_monthly_code_rate(
    activity: DataFrame, master: DataFrame, denominator: str = "slots", max_codes: int | None = None, slots: int = SLOTS
) -> DataFrame:
    """``monthly_code_rate`` by country and site."""
    rates = monthly_code_rate(activity, master, SITE_LEVEL, denominator, max_codes, slots)
    return rates.withColumnRenamed("error_percent", "percent")


def recent_sites(site_rate: DataFrame, after: str, excluded_country: str) -> DataFrame:
    """Site rates of the months after a date, without one country; a missing country drops too."""
    return site_rate.filter((F.col("month") > F.lit(after).cast("date")) & (F.col("country_code") != excluded_country))


def site_code_rate(recent: DataFrame) -> DataFrame:
    """Rate of each code per site over the recent months, largest first; only months with the code count."""
    known = recent.filter(F.col("supplier_site_id").isNotNull())
    return (
        known.groupBy("supplier_site_id", CODE)
        .agg(sum_skip("n").alias("n"), sum_skip("tests").alias("tests"))
        .withColumn("percent", percent("n", "tests"))
        .orderBy("supplier_site_id", F.desc("percent"), CODE)
    )


def total_errors_by_site(recent: DataFrame) -> DataFrame:
    """Codes per site over the recent months, largest rate first; ``tests`` is summed once per code row."""
    return (
        recent.groupBy("supplier_site_id")
        .agg(sum_skip("n").alias("n"), sum_skip("tests").alias("tests"))
        .withColumn("percent", percent("n", "tests"))
        .orderBy(F.desc("percent"), "supplier_site_id")
    )


def mean_code_rate_country(recent: DataFrame) -> DataFrame:
    """Unweighted mean of the site-month percentages per country and code."""
    return recent.groupBy("country_code", CODE).agg(F.avg("percent").alias("percent"))


def top_errors_country(monthly: DataFrame, excluded_country: str, k: int = 3) -> DataFrame:
    """Per country the ``k`` codes with the largest monthly percentage, ties kept."""
    peaks = (
        monthly.filter(F.col("country_code") != excluded_country)
        .groupBy("country_code", CODE)
        .agg(max_na("error_percent").alias("n"))
    )
    return top_with_ties(peaks, ["country_code"], "n", k).drop("n")


def _with_bar(df: DataFrame) -> DataFrame:
    """Centre of the bar on a time axis, and its label."""
    return labels.with_percent_label(df.withColumn("x", F.date_add("month", 14)), "error_percent")


def country_error_series(monthly: DataFrame, excluded_country: str) -> DataFrame:
    """Monthly rates of each country, for the codes that ``top_errors_country`` gives it."""
    kept = monthly.filter(F.col("country_code") != excluded_country)
    top = top_errors_country(monthly, excluded_country)
    return _with_bar(keep_listed(kept, top, ["country_code", CODE]))


def error_country_series(monthly: DataFrame, excluded_country: str, after: str | None = None) -> DataFrame:
    """Monthly rates over all models of a country, for the codes that are on top in any country.

    With ``after`` the top codes still need all months: the monthly rates are computed once, into the shared folder, and the later
    months are read from there.
    """
    if after is not None:
        monthly = stored(monthly, "monthly")
    kept = monthly.filter(F.col("country_code") != excluded_country)
    top = top_errors_country(monthly, excluded_country)
    if after is not None:
        kept = kept.filter(F.col("month") > F.lit(after).cast("date"))
    summed = (
        keep_listed(kept, top, CODE)
        .groupBy("country_code", "month", CODE)
        .agg(sum_skip("n").alias("n"), sum_skip("tests").alias("tests"))
        .withColumn("error_percent", percent("n", "tests"))
    )
    return _with_bar(summed)


def months_seen(activity: DataFrame, master: DataFrame, after: str) -> DataFrame:
    """The nearest months, after a date, in which a ``00`` model ran a test."""
    month = F.col("month") if _is_tally(activity) else dates.month_nearest(F.col("test_date"))
    seen = activity.select("instrument_id", month.alias("month")).filter(
        F.col("month") > F.lit(after).cast("date")
    )
    placed = attach_instrument(seen.distinct(), _family(master), how="inner", counted=True)
    return placed.select("month").distinct()


def site_error_series(
    activity: DataFrame, master: DataFrame, after: str, excluded_country: str, codes: Sequence[str] = SERIES_CODES
) -> DataFrame:
    """``gap_fill`` of the recent site rates over the months seen. Both come from one stored tally: the tests are read once."""
    tally = stored(report_tally(activity), "tally")
    recent = recent_sites(site_monthly_code_rate(tally, master), after, excluded_country)
    return gap_fill(recent, months_seen(tally, master, after), codes)


def gap_fill(rows: DataFrame, months: DataFrame, codes: Sequence[str] = SERIES_CODES) -> DataFrame:
    """Site rates for every site of ``rows``, listed code and month; 0 where there is no rate.

    A missing site is no site whose rates could be found: its series is all 0.

    The list of months is one value (a calendar's length); sites are spread over it by an explode.
    """
    calendar = months.agg(F.sort_array(F.collect_set("month")).alias("months")).scalar()
    # Per site at most one entry per listed code, month and country: the input is not read again.
    per_site = rows.groupBy("supplier_site_id").agg(
        F.collect_list(F.when(F.col("supplier_site_id").isNotNull() & F.col(CODE).isin(*codes), F.struct(F.col(CODE).alias("code"), "month", "percent"))).alias("known")
    )
    spine = per_site.select(
        "supplier_site_id", "known", F.explode(F.array(*[F.lit(c) for c in codes])).alias(CODE), calendar.alias("months")
    ).select("supplier_site_id", "known", CODE, F.explode("months").alias("month"))
    own = F.filter("known", lambda k: (k["code"] == F.col(CODE)) & (k["month"] == F.col("month")))
    filled = spine.select("supplier_site_id", CODE, "month", F.explode_outer(own).alias("hit")).select(
        "supplier_site_id", CODE, "month", F.coalesce("hit.percent", F.lit(0.0)).alias("percent")
    )
    labelled = labels.with_percent_label(filled.withColumn("x", F.date_add("month", 14)), "percent")
    return labelled.withColumn("label", F.when(F.col("percent") > 0, F.col("label")).otherwise(F.lit("")))
