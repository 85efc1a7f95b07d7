"""Means, rates and roundings in integer arithmetic.

Scores are stored to 4 decimals and latencies to 2, so both are whole numbers once
scaled. Sums of whole numbers do not depend on the order in which partitions are
merged, and ratios of them are rounded half up without a floating-point tie.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_PLACES = 4
LATENCY_PLACES = 2


def idiv(a: Column, b: Column) -> Column:
    """Whole-number division."""
    return F.call_function("div", a, b)


def scaled(value: Column, places: int) -> Column:
    """A value with ``places`` decimals as a whole number."""
    return F.round(value * F.lit(float(10**places))).cast("bigint")


def score_units(value: Column) -> Column:
    return scaled(value, SCORE_PLACES)


def latency_units(value: Column) -> Column:
    return scaled(value, LATENCY_PLACES)


def unscaled(value: Column, places: int) -> Column:
    return value.cast("double") / F.lit(float(10**places))


def rounded_ratio_units(num: Column, den: Column, shift: int = 0) -> Column:
    """``num * 10**shift / den`` rounded half up; ``num`` must not be negative.

    The whole part is split off first, so that only the remainder is scaled and a sum
    over very many rows does not overflow.
    """
    up = F.lit(10**shift).cast("bigint")
    two = F.lit(2).cast("bigint")
    rest = num % den
    return idiv(num, den) * up + idiv(two * rest * up + den, two * den)


def rounded_ratio(num: Column, den: Column, from_places: int, to_places: int) -> Column:
    """The ratio of a sum in units of ``10**-from_places`` to a count, to ``to_places`` decimals."""
    if to_places < from_places:
        den = den * F.lit(10 ** (from_places - to_places)).cast("bigint")
    units = rounded_ratio_units(num, den, max(to_places - from_places, 0))
    return unscaled(units, to_places)


def flag_count(flag: Column) -> Column:
    """Sum of a boolean."""
    return F.sum(F.when(flag, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
