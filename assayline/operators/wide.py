"""Long to wide, with columns that are named by the data.

A DataFrame's columns must be known when it is planned, and names that are in the data are known only when it has run. So the names
travel with the counted rows, as the keys of one map column (CELLS), and become columns where the table leaves Spark: ``spread`` is
the one place that runs a job. What is in front of the map and behind it stays there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.storage import stored

CELLS = "_cells"


def cells(name: Column, value: Column) -> Column:
    """Aggregate: the values of a group by name; rows for which the name is missing are left out. A name occurs once in a group of
    counted rows, so a map has at most as many entries as the report has columns."""
    return F.map_from_entries(F.collect_list(F.when(name.isNotNull(), F.struct(name, value)))).alias(CELLS)


def is_gathered(df: DataFrame) -> bool:
    return CELLS in df.columns


def spread(df: DataFrame, missing: Column | None = None) -> DataFrame:
    """A column per name in place of the map, in alphabetical order; ``missing`` stands where a row lacks a name. A table without a map
    is returned as it is. The rows are computed once, into the shared folder, and read from there for their names and their values."""
    if not is_gathered(df):
        return df
    kept = stored(df, "cells")
    names = [r["name"] for r in kept.select(F.explode(F.map_keys(CELLS)).alias("name")).distinct().orderBy("name").collect()]
    at = df.columns.index(CELLS)
    return kept.select(*_quoted(df.columns[:at]), *[_cell(n, missing) for n in names], *_quoted(df.columns[at + 1 :]))


def _cell(name: str, missing: Column | None) -> Column:
    value = F.col(CELLS)[name]
    return (value if missing is None else F.coalesce(value, missing)).alias(name)


def _quoted(names: Sequence[str]) -> list[str]:
    return [f"`{n}`" for n in names]
