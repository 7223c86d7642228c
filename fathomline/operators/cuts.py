"""Positions of values among many sorted cuts, in two levels, so that a value is compared with a few of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cuts of a part.
FAN = 64


def shares(count: int) -> Column:
    """1/count to (count - 1)/count, as one literal: thousands of them would be slow to plan."""
    return F.split(F.lit(",".join(str(i / count) for i in range(1, count))), ",").cast("array<double>")


def two_levels(sorted_cuts: str) -> tuple[Column, Column]:
    """(first, parts): the last cut of each whole part, and the other cuts part by part."""
    first = F.filter(sorted_cuts, lambda x, i: i % FAN == FAN - 1)
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(sorted_cuts) / FAN).cast("int")), lambda i: F.slice(sorted_cuts, i * FAN + 1, F.lit(FAN - 1)))
    return first, parts


def part_of(first: str, at: Column) -> Column:
    """The part in which ``at`` stands."""
    return F.size(F.filter(first, lambda c: c <= at))


def position(part: Column, parts: str, at: Column) -> Column:
    """How many cuts are at or below ``at``, which stands in ``part``."""
    return part * FAN + F.size(F.filter(F.get(parts, part), lambda c: c <= at))
