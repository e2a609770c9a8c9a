"""The lab tables as views over the TPC-H-like test tables.

The column expressions are written in the dialect that Spark SQL and DuckDB share, so that both
sides of the correctness check read the same rows; only the column bindings are shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Column bindings, as fixed values: name -> expression over the base table.
COUNTRY = {
    "country_code": "concat('C',cast(n_nationkey as string))",
    "country_name": "n_name",
}
SITE = {
    "supplier_site_id": "s_suppkey",
    "supplier_site_name": "s_name",
    "country_code": "case when s_suppkey % 11 = 0 then null else concat('C',cast(s_nationkey as string)) end",
    "city": "concat('City  ',cast(s_suppkey % 7 as string))",
    "supplier_id": "1000 + s_suppkey % 2",
    "supplier_name": "concat('Vendor',cast(s_suppkey % 2 as string))",
}
INSTRUMENT_MASTER = {
    "instrument_id": "p_partkey",
    "instrument_model": "case p_size % 4 when 0 then 'm2000rt®' when 1 then 'Cobas®  4800,  x'"
    " when 2 then 'cobas 6800' else 'Alinity m' end",
    "supplier_site_id": "case when p_partkey % 61 = 0 then null else p_partkey % 120 end",
}
TEST_TYPE = {
    "test_type_id": "o_orderpriority",
    "test_type": "substr(o_orderpriority,3,20)",
    "test_type_psm": "case substr(o_orderpriority,1,1) when '1' then 'VL' when '2' then 'EID'"
    " when '3' then 'EID/VL' when '4' then 'TB' else null end",
}
TEST = {
    "test_id": "o_orderkey",
    "instrument_id": "o_orderkey % 2100",
    "test_type_id": "o_orderpriority",
    "test_date": "cast(o_orderdate as date)",
    "tot_patient_test": "case when o_orderkey % 97 = 0 then null else cast(floor(o_totalprice/5000) as bigint) end",
    "tot_patient_error": "o_custkey % 7",
    "supplier_id": "1000 + o_orderkey % 2",
}
# The part of a record id that comes from the order, and the part that comes from the line.
RECORD_PLATE = (
    "concat(cast(cast(o_orderdate as date) as string),'|',substr(o_orderpriority,1,1),'|BC',"
    "cast(o_orderkey as string),'|',o_orderstatus)"
)
RECORD_WELL = "case when o_orderkey % 211 = 0 then '' else concat('|',cast(l_linenumber as string)) end"
ACTIVITY_ABBOTT_ORDER = {
    "instrument_id": "o_orderkey % 2100",
    "test_type_id": "o_orderpriority",
    "country_code": "case when o_orderkey % 13 = 0 then null else concat('C',cast(o_custkey % 25 as string)) end",
    "test_date": "case when o_orderkey % 103 = 0 then null else cast(o_orderdate as date) end",
}
ACTIVITY_ABBOTT_LINE = {
    "error_type_id": "case when l_discount > 0.075 then cast(4440 + l_linenumber as double) else null end",
    "error_count": "cast(case when l_discount > 0.065 then 1 + l_linenumber % 3 else 0 end as bigint)",
    "is_patient_test": "case when l_returnflag = 'N' then 0 else 1 end",
    "is_control_test": "case when l_returnflag = 'N' then 1 else 0 end",
    "patient_test_error_flag": "case when l_discount > 0.075 and l_returnflag <> 'N' then 1 else 0 end",
    "control_test_error_flag": "case when l_discount > 0.075 and l_returnflag = 'N' then 1 else 0 end",
    "excluded_tests": "0",
}
ACTIVITY_ABBOTT = {
    **ACTIVITY_ABBOTT_ORDER,
    "test_record_id": f"concat({RECORD_PLATE},{RECORD_WELL})",
    **ACTIVITY_ABBOTT_LINE,
}
ACTIVITY_ROCHE = {
    "record_key": "o_orderkey",
    "instrument_id": "o_orderkey % 2100",
    "country_code": "concat('C',cast(o_custkey % 25 as string))",
    "test_date": "case when o_orderkey % 101 = 0 then null else cast(o_orderdate as date) end",
    "test_type_id": "o_orderpriority",
    "error_code_list": "case o_orderkey % 5 when 0 then null when 1 then concat('6284.',cast(o_custkey % 9 as string))"
    " when 2 then concat('6284.',cast(o_custkey % 9 as string),',6282.',cast(o_orderkey % 37 as string))"
    " when 3 then concat('6284.',cast(o_custkey % 9 as string),',6284.',cast(o_orderkey % 9 as string),',6282.18')"
    " else concat('1,2,,4,5,6,7,8,9,10,11,12,13,14,15,16,',cast(o_custkey % 9 as string)) end",
    "is_patient_test": "case when o_orderstatus = 'F' then 0 else 1 end",
    "is_control_test": "case when o_orderstatus = 'F' then 1 else 0 end",
    "patient_test_error_flag": "0",
    "control_test_error_flag": "0",
    "excluded_test": "0",
}
ERROR_TYPE_PLATES = {
    "error_type_id": "cast(4440 + l_linenumber as string)",
    "error_type_name": "concat('name ',cast(l_linenumber as string))",
    "error_type_description": "concat('desc ',cast(l_linenumber as string))",
    "supplier_id": "cast(1001 as bigint)",
}
ERROR_TYPE_TESTS = {
    "error_type_id": "concat('6284.',cast(c_custkey % 9 as string))",
    "error_type_name": "concat('r ',cast(c_custkey % 9 as string))",
    "error_type_description": "concat('roche ',cast(c_custkey % 9 as string))",
    "supplier_id": "cast(1000 as bigint)",
}
ERROR_TYPE_ROWS = (
    ("6282.36", "r36", "original text", 1000),
    ("4441", "name dup", "second supplier", 1000),
)
KIT_ERROR_CODES = {
    "error_code": "cast(4440 + l_linenumber as bigint)",
    "category_message": "concat('cat ',cast(l_linenumber % 2 as string))",
    "possible_issue": "'issue'",
    "protocol": "'protocol'",
}
PLACE_CANDIDATES = {
    "supplier_site_id": "s_suppkey",
    "candidate_name": "concat('Place ',cast(r_regionkey as string))",
    "candidate_address": "concat(cast(r_regionkey as string),' Main St')",
    "candidate_lat": "cast((s_suppkey * 37 + r_regionkey) % 140 - 70 as double)",
    "candidate_lon": "cast((s_suppkey * 91 + r_regionkey) % 360 - 180 as double)",
}
SUPPLIER_GEO = {
    "supplier_site_id": "s_suppkey",
    "candidate_lat": "case when s_suppkey % 23 = 0 then null else cast((s_suppkey * 37) % 140 - 70 as double) end",
    "candidate_lon": "cast((s_suppkey * 91) % 360 - 180 as double)",
}
ACTIVE_LOCATIONS = {"supplier_site_id": "s_suppkey"}
ACTIVE_LOCATIONS_ROWS = "s_suppkey % 5 <> 4"
DATIM_LAB_SITES = {
    "id": "c_custkey",
    "name": "c_name",
    "countryname": "concat('NATION_',cast(c_nationkey as string))",
    "latitude": "cast((c_custkey * 53) % 160 - 80 as double)",
    "longitude": "cast((c_custkey * 29) % 360 - 180 as double)",
}
# Texts with outer blanks, quotes, backslashes, commas and line breaks; empty ones, and the missing value's own token.
ODD_TEXTS = {
    "error_type_id": "cast(s_suppkey as string)",
    "error_type_name": "case s_suppkey % 5 when 0 then ' lead' when 1 then 'trail ' when 2 then 'a, \"b\"'"
    " when 3 then concat('one',chr(10),'two') else concat('back',chr(92),'slash',chr(92)) end",
    "error_type_description": "case s_suppkey % 4 when 0 then '' when 1 then 'NA' when 2 then concat('\"',chr(13),chr(10)) else 'é ' end",
    "supplier_id": "s_suppkey",
}




def columns(binding: dict[str, str]) -> list[str]:
    return [f"{expression} as {name}" for name, expression in binding.items()]


class LabViews:
    """Lab tables as lazy DataFrames over one folder of test data."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.schemas: dict[str, StructType] = {}

    def base(self, table: str) -> DataFrame:
        # Reading the schema from the files is a job; once per table and set of views is enough.
        path = f"{self.folder}/{table}.parquet"
        if path not in self.schemas:
            self.schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self.schemas[path]).parquet(path)

    def _bound(self, table: str, binding: dict[str, str]) -> DataFrame:
        return self.base(table).selectExpr(*columns(binding))

    def country(self) -> DataFrame:
        return self._bound("nation", COUNTRY)

    def site(self) -> DataFrame:
        return self._bound("supplier", SITE)

    def instrument_master(self) -> DataFrame:
        return self._bound("part", INSTRUMENT_MASTER)

    def test_type(self) -> DataFrame:
        # Distinct on the one source column, so that only its few values get the derived columns.
        return self.base("orders").select("o_orderpriority").distinct().selectExpr(*columns(TEST_TYPE))

    def test(self) -> DataFrame:
        return self._bound("orders", TEST)

    def test_activity_abbott(self) -> DataFrame:
        # What depends on the order alone is derived once per order, not once per line.
        orders = self.base("orders").selectExpr(
            "o_orderkey", *columns(ACTIVITY_ABBOTT_ORDER), f"{RECORD_PLATE} as record_plate"
        )
        joined = self.base("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.selectExpr(
            *ACTIVITY_ABBOTT_ORDER, f"concat(record_plate,{RECORD_WELL}) as test_record_id", *columns(ACTIVITY_ABBOTT_LINE)
        )

    def test_activity_roche(self) -> DataFrame:
        return self._bound("orders", ACTIVITY_ROCHE)

    def error_type(self) -> DataFrame:
        lines = self.base("lineitem").filter("l_linenumber < 7").select("l_linenumber").distinct()
        codes = self.base("customer").select(F.expr("c_custkey % 9").alias("c_custkey")).distinct()
        values = ", ".join(f"('{code}', '{name}', '{text}', {supplier}L)" for code, name, text, supplier in ERROR_TYPE_ROWS)
        rows = self.spark.sql(f"values {values}").toDF("error_type_id", "error_type_name", "error_type_description", "supplier_id")
        return (
            lines.selectExpr(*columns(ERROR_TYPE_PLATES))
            .unionByName(codes.selectExpr(*columns(ERROR_TYPE_TESTS)))
            .unionByName(rows)
        )

    def kit_error_codes(self) -> DataFrame:
        lines = self.base("lineitem").filter("l_linenumber in (1,2,5)").select("l_linenumber").distinct()
        return lines.selectExpr(*columns(KIT_ERROR_CODES))

    def place_candidates(self) -> DataFrame:
        # Region keys below s_suppkey % 3, as an equi-join: at most two per supplier.
        numbered = self.base("supplier").filter("s_suppkey % 3 > 0").selectExpr(
            "s_suppkey", "explode(sequence(0, cast(s_suppkey % 3 as int) - 1)) as n"
        )
        return numbered.join(self.base("region"), F.col("n") == F.col("r_regionkey")).selectExpr(*columns(PLACE_CANDIDATES))

    def supplier_geo(self) -> DataFrame:
        return self._bound("supplier", SUPPLIER_GEO)

    def active_locations(self) -> DataFrame:
        return self.base("supplier").filter(ACTIVE_LOCATIONS_ROWS).selectExpr(*columns(ACTIVE_LOCATIONS))

    def datim_lab_sites(self) -> DataFrame:
        return self._bound("customer", DATIM_LAB_SITES)
