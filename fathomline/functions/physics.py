"""Scalar expressions of travel time, dielectric constants and coordinates. Constants are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Speed of light in m/ns.
LIGHT = 0.299792458
#: A plausible dielectric constant, both ends included.
LOW, HIGH = 2.0, 30.0


def thickness_mm(twtt_ns: Column, dielectric: Column) -> Column:
    """c * t / (2 * sqrt(e)) in mm; null for negative times and constants under 1."""
    return F.when((twtt_ns >= 0) & (dielectric >= 1), F.lit(LIGHT) * twtt_ns / (2 * F.sqrt(dielectric)) * 1000)


def surface_dielectric(surface: Column, plate: Column) -> Column:
    """((1 + r) / (1 - r))^2 for a reflection ratio between 0.01 and 0.85; null beyond and where implausible."""
    r = F.abs(surface) / F.nullif(F.abs(plate), F.lit(0.0))
    e = F.pow((1 + r) / (1 - r), F.lit(2))
    return F.when((r > 0.01) & (r < 0.85) & e.between(LOW, HIGH), e)


def recursive_dielectric(upper: Column, a1: Column, a2: Column) -> Column:
    """The constant below an interface from the one above and two amplitude ratios; null where implausible."""
    under = 1 - a1 + a2
    e = upper * F.pow((1 - a1 * a1 + a2) / F.nullif(under, F.lit(0.0)), F.lit(2))
    return F.when(e.between(LOW, HIGH), e)


def resolved_dielectric(reflection: Column, analyst: Column, scan: Column) -> tuple[Column, Column]:
    """(value, source): the reflection's, else the analyst's in (1, 40], else the scan's."""
    hand = F.when((analyst > 1) & (analyst <= 40), analyst)
    value = F.coalesce(reflection, hand, scan)
    return value, F.when(reflection.isNotNull(), "reflection").when(hand.isNotNull(), "analyst").when(scan.isNotNull(), "scan").otherwise("missing")


def parsed_thickness(text: Column) -> Column:
    """mm of a number with unit mm, cm or in (also ", inch, inches); null for anything else and for no thickness."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z\"]*)\s*$", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z\"]*)\s*$", 2))
    scale = F.when(unit.isin("", "mm"), 1.0).when(unit == "cm", 10.0).when(unit.isin("in", "inch", "inches", '"'), 25.4)
    return F.when(number > 0, number * scale)


def degrees(packed: Column, hemisphere: Column) -> Column:
    """Decimal degrees of ddmm.mmmm, negative in the south and west."""
    whole = F.floor(packed / 100)
    value = whole + (packed - whole * 100) / 60
    return F.when(hemisphere.isin("S", "W"), -value).otherwise(value)


def phase_class(angle: Column, classes: int = 8) -> Column:
    """The class of an angle in radians among equal parts of the circle that begin at -pi."""
    return F.least(F.floor(F.pmod(angle + F.pi(), 2 * F.pi()) * classes / (2 * F.pi())), F.lit(classes - 1)).cast("int")


def class_distance(a: Column, b: Column, classes: int = 8) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(classes) - d)


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != ""))
