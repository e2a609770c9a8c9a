"""Month and quarter buckets. Buckets stay dates; labels are made last, on the small result."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_floor(d: Column) -> Column:
    """First day of the month."""
    return F.trunc(d, "MM").cast("date")


def month_nearest(d: Column) -> Column:
    """The nearest first-of-month; exactly half way goes up."""
    this = month_floor(d)
    following = F.add_months(this, 1)
    return F.when(F.datediff(following, d) <= F.datediff(d, this), following).otherwise(this)


def quarter_floor(d: Column) -> Column:
    """First day of the quarter."""
    return F.trunc(d, "QUARTER").cast("date")


def month_number_label(d: Column) -> Column:
    """``03-2021``."""
    return F.date_format(d, "MM-yyyy")


def month_name_label(d: Column) -> Column:
    """``Mar 2021``."""
    return F.date_format(d, "MMM yyyy")


def quarter_label(d: Column) -> Column:
    """``2021 Q3``."""
    return F.date_format(d, "yyyy 'Q'Q")


def quarters_between(first: dt.date, last: dt.date) -> list[str]:
    """Labels of all quarters from the one of ``first`` to the one of ``last``."""
    start = first.year * 4 + (first.month - 1) // 3
    end = last.year * 4 + (last.month - 1) // 3
    return [f"{q // 4} Q{q % 4 + 1}" for q in range(start, end + 1)]
