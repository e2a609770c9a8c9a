"""Joins in which a missing key matches a missing key, and the choice between broadcast and shuffle.

A side is broadcast only when the size that the optimizer derives from its files is within a bound.
Beyond it the join is a shuffled one, in which adaptive execution splits the partition of a hot key
(``session.SETTINGS``), that of the missing key included. No job runs while a plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Compressed bytes on disk; ten times that in memory is still easy to hold on every executor.
BROADCAST_BYTES = 16 * 1024 * 1024


def planned_bytes(df: DataFrame) -> int | None:
    """Size Spark expects, from file sizes and column widths; None if the session does not tell."""
    try:
        return int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    except AttributeError:
        return None


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` is known to be within the broadcast bound."""
    size = planned_bytes(df)
    return size is not None and size <= BROADCAST_BYTES


def _pairs(on: str | Sequence[str | tuple[str, str]]) -> list[tuple[str, str]]:
    keys = [on] if isinstance(on, str) else list(on)
    return [(k, k) if isinstance(k, str) else k for k in keys]


def _renamed(df: DataFrame, pairs: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    names = {right: f"_key_{i}" for i, (_, right) in enumerate(pairs)}
    return df.withColumnsRenamed(names), list(names.values())


def _match(left: DataFrame, pairs: list[tuple[str, str]], right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[lk].eqNullSafe(right[rk]) for (lk, _), rk in zip(pairs, keys)])


def attach(
    fact: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str | tuple[str, str]],
    how: str = "left",
    small: bool | None = None,
) -> DataFrame:
    """Add the columns of ``dim`` to ``fact``; NULL keys match NULL keys.

    ``on`` holds column names or ``(fact name, dim name)`` pairs; the key columns of ``dim`` are not
    kept. ``small`` passes on a size check that the caller has made already.
    """
    pairs = _pairs(on)
    renamed, keys = _renamed(dim, pairs)
    side = F.broadcast(renamed) if (is_small(dim) if small is None else small) else renamed
    return fact.join(side, _match(fact, pairs, renamed, keys), how).drop(*keys)


def keep_listed(df: DataFrame, listed: DataFrame, on: str | Sequence[str | tuple[str, str]], how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key occurs in ``listed`` (``left_anti``: does not occur)."""
    pairs = _pairs(on)
    # Distinct first: its map-side part shrinks a fact-sized list to its few keys before the shuffle.
    ids, keys = _renamed(listed.select(*[right for _, right in pairs]).distinct(), pairs)
    return df.join(ids, _match(df, pairs, ids, keys), how)


def dims_small(dims: Sequence[DataFrame | None]) -> bool:
    """Whether all of the dimensions (None: not used) are within the broadcast bound."""
    return all(is_small(d) for d in dims if d is not None)


def attach_instrument(
    fact: DataFrame,
    master: DataFrame,
    site: DataFrame | None = None,
    country: DataFrame | None = None,
    how: str = "left",
    counted: bool = False,
) -> DataFrame:
    """Add instrument columns by ``instrument_id``, then site columns, then country columns.

    ``site`` is keyed by ``supplier_site_id`` and holds ``site_country_code`` where ``country``
    (keyed by ``country_code``) is to follow. Small tables are broadcast one by one, so the fact is
    not moved. Otherwise the chain is built first and the fact is shuffled once.

    ``counted`` says that ``fact`` is already aggregated: then larger tables are simply joined.
    """
    if dims_small((master, site, country)):
        return _chain(attach(fact, master, "instrument_id", how, small=True), site, country, small=True)
    if counted:
        return _chain(attach(fact, master, "instrument_id", how, small=False), site, country)
    # The whole chain, as its last join leaves it partitioned by another key: a hot instrument can be
    # split only where both sides are shuffled for this very join.
    return attach(fact, _chain(master, site, country), "instrument_id", how, small=False)


def attach_names(counts: DataFrame, master: DataFrame, site: DataFrame) -> DataFrame:
    """Add ``instrument_model`` and ``supplier_site_name`` to aggregated rows by instrument.

    Unlike ``attach_instrument``, entries of one instrument that carry the same names are one group.
    """
    if dims_small((master, site)):
        names = _chain(master, site, None, small=True)
        names = names.select("instrument_id", "instrument_model", "supplier_site_name").distinct()
        return attach(counts, names, "instrument_id", small=True)
    named = _chain(attach(counts, master, "instrument_id", small=False), site, None)
    return named.drop("supplier_site_id").distinct()


def _chain(df: DataFrame, site: DataFrame | None, country: DataFrame | None, small: bool = False) -> DataFrame:
    if site is not None:
        df = attach(df, site, "supplier_site_id", small=small)
    if country is not None:
        df = attach(df, country, [("site_country_code", "country_code")], small=small)
    return df
