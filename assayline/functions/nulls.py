"""Aggregates and arithmetic with the missing-value rules of the lab scripts.

There a plain sum over a group with one missing value is missing, while a sum told to skip missing
values is 0 for a group that has nothing else; a distinct count counts "missing" as one value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _if_complete(c: Column, value: Column) -> Column:
    return F.when(F.count(F.lit(1)) == F.count(c), value)


def sum_na(c: Column | str) -> Column:
    """Sum of a group; NULL as soon as one value is NULL."""
    c = _col(c)
    return _if_complete(c, F.sum(c))


def max_na(c: Column | str) -> Column:
    """Maximum of a group; NULL as soon as one value is NULL."""
    c = _col(c)
    return _if_complete(c, F.max(c))


def sum_skip(c: Column | str) -> Column:
    """Sum of the values that are there; 0 if there is none."""
    return F.coalesce(F.sum(_col(c)), F.lit(0))


def n_unique(c: Column | str) -> Column:
    """Number of different values, NULL counting as one of them."""
    c = _col(c)
    return F.count_distinct(c) + F.max(c.isNull().cast("int"))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as double; NULL where the denominator is 0."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def percent(numerator: Column | str, denominator: Column | str) -> Column:
    """``100 * numerator / denominator``; NULL where the denominator is 0."""
    return ratio(_col(numerator) * 100, denominator)


def paste(*cols: Column | str, sep: str = " ") -> Column:
    """Text of all columns joined by ``sep``; a missing value is written as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols])


def blank_to_null(df):
    """Empty text to NULL in every string column (databases store the missing value as ``''``)."""
    return df.select(
        *[F.nullif(F.col(f"`{n}`"), F.lit("")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes]
    )
