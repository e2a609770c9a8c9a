"""Instrument names, record ids and error codes as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the record id: it ends in "|" and the number of the well; the rest names the plate by these parts.
WELL_SUFFIX = r"\|\d+$"
RECORD_PARTS = ("date", "test_type", "barcode", "log", "sample_number")


def squish(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def ascii_only(c: Column) -> Column:
    """Without the characters outside ASCII."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def model_upper(c: Column) -> Column:
    """Instrument name in upper case without the registered-trademark sign."""
    return F.replace(F.upper(c), F.lit("®"), F.lit(""))


def model_ascii(c: Column) -> Column:
    """Instrument name in lower-case ASCII: drop other characters, comma to blank, squish, lower."""
    return F.lower(squish(F.replace(ascii_only(c), F.lit(","), F.lit(" "))))


def well_number(record_id: Column) -> Column:
    """Digits after the last bar of a record id; NULL if it names no well."""
    return F.replace(F.regexp_substr(record_id, F.lit(WELL_SUFFIX)), F.lit("|"), F.lit(""))


def plate_id(record_id: Column) -> Column:
    """Record id without its well."""
    return F.regexp_replace(record_id, WELL_SUFFIX, "")


def record_part(record_id: Column, position: int) -> Column:
    """Part ``position`` (from 1) of a bar-separated record id; NULL if it has fewer parts."""
    return F.try_element_at(F.split(record_id, r"\|"), F.lit(position))


def code_text(c: Column) -> Column:
    """A code held as a number, as text: 4442.0 is ``4442`` and 6282.18 stays ``6282.18``."""
    whole = c.try_cast("bigint")
    return F.when(whole.cast("double") == c, whole.cast("string")).otherwise(c.cast("string"))


def code_array(code_list: Column, max_codes: int | None = None) -> Column:
    """The codes of a comma list, blanks between commas included: all of them, or the first ``max_codes``."""
    codes = F.split(code_list, ",")
    return codes if max_codes is None else F.slice(codes, 1, max_codes)
