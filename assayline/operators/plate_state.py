"""Plate marks kept from export to export: each export is merged into the months it touches.

Different plates can't be summed up over exports, since a plate may be in several; the marks themselves can be put together as sets.
The state holds each mark once, in files by month. A new export's marks are compared with those of its own months only, and what is
new is added; other months are neither read nor written. Merging an export twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.operators.cleaning import VIRAL_LOAD_AND_EID
from assayline.operators.plates import MARK_COLUMNS, plate_marks
from assayline.state import State

TABLE = "marks"
#: The folder of marks without a month.
NO_MONTH = "none"
LAYOUT = "month date, country_code string, instrument_id bigint, plate_id string, hit boolean, error_type_id double, of string"


def _bucket() -> Column:
    return F.coalesce(F.date_format("month", "yyyy-MM"), F.lit(NO_MONTH)).alias("of")


def _kept(state: State) -> DataFrame:
    paths = state.paths(TABLE)
    if not paths:
        return state.spark.createDataFrame([], LAYOUT)
    # Each addition is a folder of its own, with a folder per month below it.
    return reduce(DataFrame.union, [state.spark.read.schema(LAYOUT).parquet(p) for p in paths])


def read_marks(spark: SparkSession, folder: str) -> DataFrame:
    """The marks of a state, for the operators of ``plates``."""
    return _kept(State(spark, folder)).select(*MARK_COLUMNS)


def merge_plates(
    activity: DataFrame,
    test_type: DataFrame,
    folder: str,
    groups: Sequence[str] = VIRAL_LOAD_AND_EID,
    batch: str | None = None,
) -> list[str]:
    """Merges the plates of an export into the state in a folder, which is begun if there is none; the months it touches.

    The months of an export reach the driver, some characters each. A month of the state is read if the export has it. ``batch`` names
    the export: one that is in the state is not read again.
    """
    state = State(activity.sparkSession, folder, groups=list(groups))
    if state.has(batch):
        return []
    path = state.new_path(TABLE)
    marks = plate_marks(activity, test_type, groups).select(*MARK_COLUMNS, _bucket())
    staged = state.new_path("staged")
    marks.write.partitionBy("of").parquet(staged)
    marks = state.spark.read.schema(LAYOUT).parquet(staged)
    months = [row["of"] for row in marks.select("of").distinct().orderBy("of").collect()]
    known = _kept(state).filter(F.col("of").isin(*months)) if months else _kept(state)
    same = reduce(lambda a, b: a & b, [F.col(f"new.{c}").eqNullSafe(F.col(f"known.{c}")) for c in ("of", *MARK_COLUMNS)])
    added = marks.alias("new").join(known.alias("known"), same, "left_anti") if state.paths(TABLE) else marks
    added.write.partitionBy("of").parquet(path)
    state.publish(batch, **{TABLE: [*state.paths(TABLE), path]})
    return months


def compact(spark: SparkSession, folder: str) -> None:
    """Puts the additions of a state together into one folder, so that a month is few files again."""
    state = State(spark, folder)
    if len(state.paths(TABLE)) > 1:
        path = state.new_path(TABLE)
        _kept(state).hint("rebalance", "of").write.partitionBy("of").parquet(path)
        state.publish(**{TABLE: [path]})
