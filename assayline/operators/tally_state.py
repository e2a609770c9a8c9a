"""The tally of codes kept from export to export, with replaced, late and removed records.

A tally is a sum over records, so a record's share can be taken back. The state holds the tally and, per record key, what the key's
last record added: country, instrument, month and codes. A batch's records are looked up there by key; the tally changes by what they
add now less what they added before. Keys are kept in buckets by their hash, and a batch reads the buckets its keys are in.

Without a key a record can't be found again: it is added and stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import dates
from assayline.operators.code_rates import CODE, report_tally
from assayline.state import State

BUCKETS = 64
KEYS = ("country_code", "instrument_id", "month")
TALLY, RECORDS = "tally", "records"
TALLY_LAYOUT = f"country_code string, instrument_id bigint, month date, {CODE} string, n bigint, tests bigint"
RECORD_LAYOUT = f"record_key bigint, batch int, gone boolean, country_code string, instrument_id bigint, month date, {CODE} string, bucket int"


def _read(state: State, table: str, layout: str) -> DataFrame:
    paths = state.paths(table)
    if not paths:
        return state.spark.createDataFrame([], layout)
    return reduce(DataFrame.union, [state.spark.read.schema(layout).parquet(p) for p in paths])


def _current(records: DataFrame) -> DataFrame:
    """The last entry of each key; removed ones are marked."""
    own = [c for c in records.columns if c != "record_key"]
    last = records.groupBy("record_key").agg(F.max_by(F.struct(*own), "batch").alias("last"))
    return last.select("record_key", "last.*")


def _tallied(records: DataFrame, sign: int, once_per_test: bool) -> DataFrame:
    tally = report_tally(records, F.col("month"), once_per_test=once_per_test)
    return tally.select(*KEYS, CODE, (F.col("n") * sign).alias("n"), (F.col("tests") * sign).alias("tests"))


def read_tally(spark: SparkSession, folder: str) -> DataFrame:
    """The tally of a state, for the operators of ``code_rates`` and ``error_rates`` that count."""
    return _read(State(spark, folder), TALLY, TALLY_LAYOUT)


def merge_records(
    activity: DataFrame | None,
    folder: str,
    removed: DataFrame | None = None,
    version: Column | None = None,
    month: Column | None = None,
    once_per_test: bool = False,
    batch: str | None = None,
    spark: SparkSession | None = None,
) -> None:
    """Merges records (record_key, country_code, instrument_id, test_date, codes) into the state in a folder, which is begun if there is
    none. A record takes the place of the one with its key, whatever its month; the keys of ``removed`` lose theirs.

    Of several records of one key in a batch the one of the greatest ``version`` counts (without versions that of the greatest other
    columns, so that reruns agree). ``month`` is the month a test counts in, the nearest one by default. ``batch`` names the
    export: one that is in the state is not merged again.
    """
    given = activity if activity is not None else removed
    if given is None:
        return
    state = State(spark or given.sparkSession, folder, once_per_test=once_per_test, buckets=BUCKETS)
    if state.has(batch):
        return
    bucket = F.pmod(F.xxhash64("record_key"), F.lit(BUCKETS)).cast("int").alias("bucket")
    number = F.lit(state.number + 1).alias("batch")
    values = [*KEYS, CODE]
    new = state.spark.createDataFrame([], RECORD_LAYOUT)
    if activity is not None:
        when = dates.month_nearest(F.col("test_date")) if month is None else month
        named = activity.withColumn("month", when)
        order = F.struct((F.lit(0) if version is None else version).alias("version"), *values)
        keyed = named.filter(F.col("record_key").isNotNull())
        one = keyed.groupBy("record_key").agg(F.max(order).alias("last")).select("record_key", *[f"last.{c}" for c in values])
        loose = named.filter(F.col("record_key").isNull()).select("record_key", *values)
        new = one.union(loose).select("record_key", number, F.lit(False).alias("gone"), *values, bucket)
    if removed is not None:
        keys = removed.select(F.col("record_key").cast("bigint")).filter(F.col("record_key").isNotNull()).distinct()
        left = keys if activity is None else keys.join(new.select("record_key"), "record_key", "left_anti")
        nothing = state.spark.createDataFrame([], RECORD_LAYOUT).schema
        empty = [F.lit(None).cast(nothing[c].dataType).alias(c) for c in values]
        new = new.unionByName(left.select("record_key", number, F.lit(True).alias("gone"), *empty, bucket))
    path = state.new_path(RECORDS)
    new.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    new = state.spark.read.schema(RECORD_LAYOUT).parquet(path)
    # At most BUCKETS numbers.
    touched = [r["bucket"] for r in new.filter(F.col("record_key").isNotNull()).select("bucket").distinct().collect()]
    before = _read(state, RECORDS, RECORD_LAYOUT).filter(F.col("bucket").isin(*touched) & F.col("record_key").isNotNull())
    met = before.join(new.select("record_key"), "record_key", "left_semi")
    taken_back = _current(met).filter(~F.col("gone"))
    parts = [
        _read(state, TALLY, TALLY_LAYOUT),
        _tallied(new.filter(~F.col("gone")), 1, once_per_test),
        _tallied(taken_back, -1, once_per_test),
    ]
    summed = reduce(DataFrame.unionByName, parts).groupBy(*KEYS, CODE).agg(F.sum("n").alias("n"), F.sum("tests").alias("tests"))
    tally = state.new_path(TALLY)
    summed.filter((F.col("n") != 0) | (F.col("tests") != 0)).write.parquet(tally)
    state.publish(batch, **{TALLY: [tally], RECORDS: [*state.paths(RECORDS), path]})


def compact(spark: SparkSession, folder: str) -> None:
    """Keeps only the last entry of every key, in one folder. Records without a key are in the tally already and are dropped."""
    state = State(spark, folder)
    if state.paths(RECORDS):
        path = state.new_path(RECORDS)
        current = _current(_read(state, RECORDS, RECORD_LAYOUT).filter(F.col("record_key").isNotNull())).filter(~F.col("gone"))
        current.select(*[c.split(" ")[0] for c in RECORD_LAYOUT.split(", ")]).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        state.publish(**{RECORDS: [path]})
