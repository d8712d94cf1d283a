"""Exact ratios, percentages and output casts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_COUNT = "decimal(20,0)"


def as_count(c: Column) -> Column:
    return c.cast("bigint")


def as_double(c: Column) -> Column:
    return c.cast("double")


def pct_of_counts(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole of two counts, rounded half-up; NULL when ``whole`` is 0.

    Decimal arithmetic: a share such as 16.725 sits exactly on the rounding edge, where
    doubles would round either way.
    """
    ratio = F.try_divide(F.lit(100) * part.cast(_COUNT), whole.cast(_COUNT))
    return F.round(ratio, digits).cast("double")


def pct_of_sums(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole of two money totals, rounded half-up; NULL when ``whole`` is 0."""
    ratio = F.try_divide(part.cast("decimal(30,2)") * 100, whole.cast("decimal(30,2)"))
    return F.round(ratio, digits).cast("double")


def mean_of(value: Column, digits: int = 2) -> Column:
    """Average of a money column, rounded half-up; NULL when there is no value."""
    mean = F.try_divide(F.sum(value), F.count(value).cast(_COUNT))
    return F.round(mean, digits).cast("double")


def money_sum(value: Column) -> Column:
    return as_double(F.sum(value))


def count_true(flag: Column) -> Column:
    """Rows where the flag is true; NULL counts as false."""
    return F.count_if(flag)


def scaled_to(value: Column, maximum: Column) -> Column:
    """Bar length as a fraction of the series maximum (at least 1)."""
    return value / F.greatest(maximum, F.lit(1))
