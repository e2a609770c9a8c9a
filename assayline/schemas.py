"""Fixed schemas of the lab tables; codes that look like numbers are text (``6282.10`` is not ``6282.1``)."""

from __future__ import annotations

from pyspark.sql.types import (
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

_TEXT, _LONG, _INT, _DOUBLE, _DATE = StringType(), LongType(), IntegerType(), DoubleType(), DateType()


def _schema(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


_FLAGS = {
    "is_patient_test": _INT,
    "is_control_test": _INT,
    "patient_test_error_flag": _INT,
    "control_test_error_flag": _INT,
}

# Tables whose texts may hold line breaks. Their files are read by one task each; those of the large tables
# of numbers and codes are split.
WITH_LINE_BREAKS = {"country", "site", "instrument_master", "test_type", "error_type", "kit_error_codes", "place_candidates", "datim_lab_sites"}

# Table layouts, as fixed values.
SCHEMAS: dict[str, StructType] = {
    "country": _schema(country_code=_TEXT, country_name=_TEXT),
    "site": _schema(
        supplier_site_id=_LONG,
        supplier_site_name=_TEXT,
        country_code=_TEXT,
        city=_TEXT,
        supplier_id=_LONG,
        supplier_name=_TEXT,
    ),
    "instrument_master": _schema(instrument_id=_LONG, instrument_model=_TEXT, supplier_site_id=_LONG),
    "test_type": _schema(test_type_id=_TEXT, test_type=_TEXT, test_type_psm=_TEXT),
    "test": _schema(
        test_id=_LONG,
        instrument_id=_LONG,
        test_type_id=_TEXT,
        test_date=_DATE,
        tot_patient_test=_LONG,
        tot_patient_error=_LONG,
        supplier_id=_LONG,
    ),
    "test_activity_abbott": _schema(
        instrument_id=_LONG,
        test_type_id=_TEXT,
        test_record_id=_TEXT,
        country_code=_TEXT,
        test_date=_DATE,
        error_type_id=_DOUBLE,
        error_count=_LONG,
        **_FLAGS,
        excluded_tests=_INT,
    ),
    "test_activity_roche": _schema(
        record_key=_LONG,
        instrument_id=_LONG,
        country_code=_TEXT,
        test_date=_DATE,
        test_type_id=_TEXT,
        error_code_list=_TEXT,
        **_FLAGS,
        excluded_test=_INT,
    ),
    "error_type": _schema(
        error_type_id=_TEXT, error_type_name=_TEXT, error_type_description=_TEXT, supplier_id=_LONG
    ),
    "kit_error_codes": _schema(error_code=_LONG, category_message=_TEXT, possible_issue=_TEXT, protocol=_TEXT),
    "place_candidates": _schema(
        supplier_site_id=_LONG,
        candidate_name=_TEXT,
        candidate_address=_TEXT,
        candidate_lat=_DOUBLE,
        candidate_lon=_DOUBLE,
    ),
    "supplier_geo": _schema(supplier_site_id=_LONG, candidate_lat=_DOUBLE, candidate_lon=_DOUBLE),
    "active_locations": _schema(supplier_site_id=_LONG),
    "datim_lab_sites": _schema(id=_LONG, name=_TEXT, countryname=_TEXT, latitude=_DOUBLE, longitude=_DOUBLE),
}
