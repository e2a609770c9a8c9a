"""First rows in the order of the files they were read from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.sources.lab_csv import POSITION


def first_value(df: DataFrame, column: str) -> Column:
    """Aggregate: the value of a column in a group's first row, missing or not, if the table was read with positions; else the first
    one in alphabetical order."""
    return (F.min_by(column, POSITION) if POSITION in df.columns else F.min(column)).alias(column)


def keep_first(df: DataFrame, keys: Sequence[str], position: str = POSITION) -> DataFrame:
    """Of the rows that agree in some columns (missing values agree too) the first one in the files. All columns stay.

    One aggregate, combined in the tasks before the shuffle: rows of a hot key never meet in one task.
    """
    others = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*others), position).alias("_first"))
    return kept.select(*[F.col(f"_first.{c}") if c in others else F.col(c) for c in df.columns])
