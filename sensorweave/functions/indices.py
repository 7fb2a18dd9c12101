"""Air-quality indices, labels and other scalar rules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Concentration band, index band, category.
PM25_BANDS = [
    (0.0, 30.0, 0, 50, "Good"),
    (30.0, 60.0, 51, 100, "Satisfactory"),
    (60.0, 90.0, 101, 200, "Moderate"),
    (90.0, 120.0, 201, 300, "Poor"),
    (120.0, 250.0, 301, 400, "Very Poor"),
    (250.0, 380.0, 401, 500, "Severe"),
]
# Index band, concentration band.
INDEX_BANDS = [
    (0, 50, 0.0, 12.0),
    (51, 100, 12.1, 35.4),
    (101, 150, 35.5, 55.4),
    (151, 200, 55.5, 150.4),
    (201, 300, 150.5, 250.4),
    (301, 400, 250.5, 350.4),
    (401, 500, 350.5, 500.4),
]


def _banded(x: Column, bands, value, beyond):
    out = None
    for band in bands:
        out = (F if out is None else out).when(x <= band[1], value(band))
    return F.when(x.isNotNull(), out.otherwise(beyond))


def index_of(c: Column) -> Column:
    """Index of a concentration, in the first band that reaches up to it; half to even."""
    x = F.greatest(c, F.lit(0.0))
    return _banded(F.when(c.isNotNull(), x), PM25_BANDS, lambda b: F.bround(F.lit(b[2]) + (b[3] - b[2]) * (x - b[0]) / (b[1] - b[0])), F.lit(500)).cast("int")


def category_of(c: Column) -> Column:
    return _banded(F.when(c.isNotNull(), F.greatest(c, F.lit(0.0))), PM25_BANDS, lambda b: F.lit(b[4]), F.lit(PM25_BANDS[-1][4]))


def concentration_of(index: Column) -> Column:
    """Concentration that an index stands for, to one decimal; null if negative."""
    x = F.when(index >= 0, index)
    return _banded(x, INDEX_BANDS, lambda b: F.bround(F.lit(b[2]) + (x - b[0]) * (b[3] - b[2]) / (b[1] - b[0]), 1), F.lit(INDEX_BANDS[-1][3]))


def number(text: Column) -> Column:
    """A non-negative number in a text, else null."""
    x = text.try_cast("double")
    return F.when(x >= 0, x)


def site_and_agency(name: Column) -> tuple[Column, Column]:
    """Split at the last ' - '; without one the agency is empty."""
    parts = r"^(.*) - (.*)$"
    there = name.rlike(parts)
    return F.trim(F.when(there, F.regexp_extract(name, parts, 1)).otherwise(name)), F.trim(F.when(there, F.regexp_extract(name, parts, 2)).otherwise(F.lit("")))


def code(text: Column) -> Column:
    """A code without case, full stops and underscores."""
    return F.translate(F.upper(text), "._", "")


def wind_sector(direction: Column, speed: Column, calm: float = 1.0) -> Column:
    known = direction.isNotNull() & speed.isNotNull() & (speed >= calm)
    return F.when(known & direction.between(225, 315), "onshore").when(known & direction.between(45, 135), "offshore").otherwise("unclassified")


def wrap12(x: Column) -> Column:
    """Difference of two clock times, in [-12, 12)."""
    return F.pmod(x + 12, F.lit(24.0)) - 12


def phase_hour(a: Column, b: Column) -> Column:
    return F.pmod(F.atan2(b, a) / (2 * math.pi) * 24, F.lit(24.0))


def thin(n: Column) -> Column:
    """How far a count carries."""
    return F.when(n >= 30, "interpretable").when(n >= 8, "thin").otherwise("too thin")


def sigma(value: Column, a: float, b: float, least: float) -> Column:
    return F.greatest(F.lit(a) + b * value, F.lit(least))


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded so that exact halves, which sums in another order may miss by a bit, all go up."""
    return F.round(x + 1e-9, digits)
