"""Cleaning of instrument names and record ids, and the basic enrichment of test activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions import text
from assayline.functions.nulls import paste
from assayline.operators.lookups import attach, attach_instrument, keep_listed

VIRAL_LOAD_AND_EID = ("EID", "EID/VL", "VL")
# ``caps`` only changes case; ``upper`` also drops the trademark sign; ``ascii`` is lower-case ASCII.
STYLES = {"caps": F.upper, "upper": text.model_upper, "ascii": text.model_ascii}


def normalise_model(df: DataFrame, style: str = "upper") -> DataFrame:
    """Instrument names in one spelling: ``caps``, ``upper`` or ``ascii``."""
    return df.withColumn("instrument_model", STYLES[style](F.col("instrument_model")))


def instruments(master: DataFrame, style: str = "upper") -> DataFrame:
    """Id, normalised model and site of every instrument; an id that is no number becomes NULL."""
    return master.select(
        F.col("instrument_id").try_cast("bigint").alias("instrument_id"),
        STYLES[style](F.col("instrument_model")).alias("instrument_model"),
        "supplier_site_id",
    )


def referenced_instruments(master: DataFrame, activity: DataFrame) -> DataFrame:
    """The instruments that some activity row mentions."""
    return keep_listed(instruments(master, "caps"), activity, "instrument_id")


def enrich_activity(activity: DataFrame, master: DataFrame) -> DataFrame:
    """Activity with model and site of its instrument; rows of unknown instruments stay."""
    return attach_instrument(activity, instruments(master))


def filter_psm(activity: DataFrame, test_type: DataFrame, groups: Sequence[str] = VIRAL_LOAD_AND_EID) -> DataFrame:
    """Activity whose test type is in one of the ``groups``, with that group as ``test_type_psm``."""
    wanted = test_type.select("test_type_id", "test_type_psm").filter(F.col("test_type_psm").isin(*groups))
    return attach(activity, wanted, "test_type_id", "inner")


def model_family(df: DataFrame, marker: str = "00") -> DataFrame:
    """Rows whose model name holds ``marker`` (the 4800, 6800 and 8800 families)."""
    return df.filter(F.contains(F.col("instrument_model"), F.lit(marker)))


def parse_plate(df: DataFrame) -> DataFrame:
    """Add ``well_number`` and ``plate_id``, read from ``test_record_id``."""
    record = F.col("test_record_id")
    return df.withColumns({"well_number": text.well_number(record), "plate_id": text.plate_id(record)})


def split_record_id(df: DataFrame) -> DataFrame:
    """Add the five parts of ``test_record_id`` and ``plate``, the first four joined by a blank."""
    record = F.col("test_record_id")
    parts = {name: text.record_part(record, i + 1) for i, name in enumerate(text.RECORD_PARTS)}
    return df.withColumns(parts).withColumn("plate", paste(*text.RECORD_PARTS[:4]))
