"""Text of numbers as the reports show them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "—"
SUFFIXES = ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"))


def with_percent_label(df: DataFrame, column: str, name: str = "label") -> DataFrame:
    """Add a percentage rounded to two significant digits as short text (``0.12%``, ``120%``, ``5e-04%``).

    Fixed notation is used unless the scientific one is shorter; 0 is ``0%``. The steps are columns of
    their own so that each is computed once.
    """
    x = F.col(column).cast("double")
    e0, r, e, m = F.col("_e0"), F.col("_r"), F.col("_e"), F.col("_m")
    steps = df.withColumn("_e0", F.floor(F.log10(F.abs(x))).cast("int"))
    scaled = F.when(e0 < 1, x * F.pow(F.lit(10.0), 1 - e0)).otherwise(x / F.pow(F.lit(10.0), e0 - 1))
    steps = steps.withColumn("_r", F.bround(scaled, 0).cast("int"))
    carried = r == 100  # 9.96 has become 10
    steps = steps.withColumns({"_e": F.when(carried, e0 + 1).otherwise(e0), "_m": F.when(carried, 10).otherwise(r)})

    one_digit = m % 10 == 0
    head, tail = F.floor(m / 10).cast("string"), (m % 10).cast("string")
    digits = F.when(one_digit, head).otherwise(m.cast("string"))
    pointed = F.when(one_digit, head).otherwise(F.concat(head, F.lit("."), tail))
    sign = F.when(e < 0, F.lit("-")).otherwise(F.lit("+"))
    scientific = F.concat(pointed, F.lit("e"), sign, F.lpad(F.abs(e).cast("string"), 2, "0"))
    fixed = (
        F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
        .when(e == 0, pointed)
        .otherwise((m * F.pow(F.lit(10.0), e - 1)).cast("bigint").cast("string"))
    )
    steps = steps.withColumns({"_fixed": fixed, "_scientific": scientific})
    shorter = F.when(F.length("_fixed") <= F.length("_scientific"), F.col("_fixed")).otherwise(F.col("_scientific"))
    text = F.concat(F.when(x == 0, F.lit("0")).otherwise(shorter), F.lit("%"))
    return steps.withColumn(name, text).drop("_e0", "_r", "_e", "_m", "_fixed", "_scientific")


def number_text(x: Column, decimals: int = 2) -> Column:
    """``1.23K``, ``4.50M``; a dash where there is no value."""
    value = x.cast("double")
    text = reduce(
        lambda rest, step: F.when(F.abs(value) >= step[0], F.concat(F.format_number(value / step[0], decimals), F.lit(step[1]))).otherwise(rest),
        reversed(SUFFIXES),
        F.format_number(value, decimals),
    )
    return F.coalesce(text, F.lit(MISSING))


def percent_text(x: Column, decimals: int = 1) -> Column:
    """A fraction as ``4.5%``; a dash where there is no value."""
    return F.coalesce(F.concat(F.format_number(x.cast("double") * 100, decimals), F.lit("%")), F.lit(MISSING))
