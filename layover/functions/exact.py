"""Aggregates whose answer does not depend on the order rows arrive in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums of doubles below this size keep 18 decimal places; beyond it they are plain sums.
LARGE = 1e17
#: Decimal places of a mean that is held against a limit or another mean.
MEAN_DIGITS = 9


def exact_sum(value: Column) -> Column:
    """Sum of doubles in decimal: the same bits on every run, however tasks are split or retried.

    Every digit down to 1e-18 counts.  Where a value is larger than ``LARGE`` or not a number, the sum
    is a plain one.
    """
    exact = F.try_sum(value.try_cast("decimal(38,18)")).cast("double")
    plain = F.sum(value)
    return F.when(F.max(F.abs(value)) < LARGE, F.coalesce(exact, plain)).otherwise(plain)


def exact_avg(value: Column) -> Column:
    """Mean of a double column, divided last."""
    return F.when(F.count(value) > 0, exact_sum(value) / F.count(value))


def comparable_avg(value: Column, digits: int = MEAN_DIGITS) -> Column:
    """Mean of a double column to hold against limits and other means: equal means are equal doubles.

    A division leaves the last bits of equal means apart (0.15 / 3 is below 0.05), which must decide nothing.
    """
    return F.round(exact_avg(value), digits)


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole`` rounded half-even, 0.0 when there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(part / whole, digits))
