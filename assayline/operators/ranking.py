"""Largest values per group, ties kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_with_ties(df: DataFrame, by: Sequence[str], order: str, k: int) -> DataFrame:
    """Rows whose ``order`` value is among the ``k`` largest of their group; all rows tied with the last stay.

    Meant for aggregated rows. Spark cuts each map task to its own best ``k`` before the shuffle.
    Without groups the limit is the k-th largest value itself, so no task sees all rows.
    """
    if by:
        best = Window.partitionBy(*by).orderBy(F.desc_nulls_last(order))
        return df.withColumn("_rank", F.rank().over(best)).filter(F.col("_rank") <= k).drop("_rank")
    smallest_kept = df.select(order).orderBy(F.desc_nulls_last(order)).limit(k).agg(F.min(order))
    return df.filter(F.col(order) >= smallest_kept.scalar())


def display_rank(df: DataFrame, plot: Sequence[str], facet: Sequence[str], category: str, value: str) -> DataFrame:
    """Add ``display_rank``: place of a category on the axis of its facet.

    A chart orders its categories by falling mean value over the whole plot (then by name), and each
    facet shows its own categories in that order.
    """
    mean = F.avg(value).over(Window.partitionBy(*plot, category))
    axis = Window.partitionBy(*facet).orderBy(F.desc("_mean"), F.asc(category))
    placed = df.withColumn("_mean", mean).withColumn("display_rank", F.row_number().over(axis).cast("bigint"))
    return placed.drop("_mean")
