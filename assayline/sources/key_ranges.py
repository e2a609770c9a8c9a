"""Half-open ranges of a whole-number key that hold like numbers of rows.

A database reads a range of an indexed key through the index, so that together the ranges read the table once. Where to cut is
told by what is known of the key's distribution, most exact first: the histogram that the database keeps of the column (with its
most common values), or the quantiles of a sample of bounded size. The outermost ranges are open, so that no row is lost however
old the figures are: they decide how even the work is, never what is read. Rows without a key are a part of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import pairwise


@dataclass(frozen=True)
class Distribution:
    """What is known of a key: bounds between which equal shares of the rows lie, as in a histogram, values that are frequent by
    themselves (value, share of all rows), and the share of rows without a key."""

    bounds: tuple[int, ...] = ()
    common: tuple[tuple[int, float], ...] = ()
    missing: float = 0.0

    def steps(self) -> list[tuple[int, int, float]]:
        """Parts (least value, greatest value, share of all rows) that don't overlap but at their ends, in order: the histogram's
        spans, cut at the frequent values, which are parts of one value."""
        spread = max(0.0, 1.0 - self.missing - sum(share for _, share in self.common))
        bounds = sorted(self.bounds)
        if len(bounds) == 1:
            bounds *= 2
        spans = [(low, high, spread / (len(bounds) - 1)) for low, high in pairwise(bounds)] if bounds else []
        for value, share in sorted(self.common):
            spans = [part for span in spans for part in _parted(span, value)]
            spans.append((value, value, share))
        return sorted(spans)


def _parted(span: tuple[int, int, float], value: int) -> list[tuple[int, int, float]]:
    """A span without a value inside of it; the rows of a span are taken to be spread evenly."""
    low, high, share = span
    if not low < value < high:
        return [span]
    left = (value - low) / (high - low)
    return [(low, value - 1, share * left), (value + 1, high, share * (1 - left))]


def cuts(known: Distribution, parts: int) -> list[int]:
    """At most parts - 1 rising keys, each the least of its range, that cut the rows into shares as like as the key allows. A
    value that holds more than a share is a range of its own, since a key can't be cut inside a value."""
    steps = known.steps()
    total = sum(share for _, _, share in steps)
    if parts < 2 or total <= 0:
        return []
    target, done, found = total / parts, 0.0, []
    wanted = 1
    for low, high, share in steps:
        while wanted < parts and done + share >= target * wanted * (1 - 1e-12) and share > 0:
            inside = min(1.0, max(0.0, (target * wanted - done) / share))
            if low == high:
                # The cut nearer to the wish: before the value or behind it.
                found.append(low if inside < 0.5 else low + 1)
            else:
                found.append(high + 1 if inside >= 1 - 1e-9 else low + int((high - low) * inside))
            wanted += 1
        if low == high and share > target * (1 + 1e-9):
            found += [low, low + 1]
        done += share
    least = steps[0][0]
    return sorted({c for c in found if c > least})


def predicates(column: str, at: Sequence[int]) -> list[str]:
    """Conditions of the parts: below the first cut, from each cut to the next, from the last on, and without a key. Every row
    meets exactly one of them."""
    if not at:
        return [f"{column} IS NOT NULL", f"{column} IS NULL"]
    inner = [f"{column} >= {low} AND {column} < {high}" for low, high in pairwise(at)]
    return [f"{column} < {at[0]}", *inner, f"{column} >= {at[-1]}", f"{column} IS NULL"]


def parse_list(text: str | None) -> list[str]:
    """Entries of a list of numbers in the database's text form, {1,2,3}."""
    return [part.strip().strip('"') for part in (text or "").strip().strip("{}").split(",") if part.strip()]


def from_catalog(bounds: str | None, values: str | None, shares: str | None, missing: float | None) -> Distribution | None:
    """The distribution that a row of the database's statistics tells; None if it tells nothing."""
    edges = tuple(int(b) for b in parse_list(bounds))
    common = tuple(zip(map(int, parse_list(values)), map(float, parse_list(shares)), strict=True))
    return Distribution(edges, common, float(missing or 0.0)) if edges or common else None
