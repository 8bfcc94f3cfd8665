"""Numeric expressions with the missing-value rules of the data model."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bloomtide.fixed_values import GDD_BASE


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nan_to_null(value: str | Column) -> Column:
    """Missing is NULL everywhere; NaN is only accepted at ingest."""
    v = _col(value)
    return F.when(~F.isnan(v), v)


def degree_days(temperature: str | Column, base: float = GDD_BASE) -> Column:
    """Degrees above the base, at least 0; missing stays missing."""
    t = _col(temperature)
    return F.when(t.isNotNull(), F.greatest(t - base, F.lit(0.0)))


def round1(value: str | Column) -> Column:
    return F.round(_col(value), 1)


SUM_ERROR = 1e-9


def truncate(value: str | Column) -> Column:
    """Towards zero, as BIGINT.

    A sum over many tasks depends in its last bits on the order of addition;
    the allowance keeps 757 from becoming 756 in some runs.
    """
    v = _col(value)
    return (v + F.signum(v) * SUM_ERROR).cast("bigint")


def whole(value: Column) -> Column:
    """Nearest whole number as text; a half goes to the even one."""
    return F.rint(value).cast("bigint").cast("string")


def capped(value: Column, limit: float | int) -> Column:
    """At most ``limit``; missing stays missing."""
    return F.when(value.isNotNull(), F.least(value, F.lit(limit)))


def percent_change(value: Column, base: Column) -> Column:
    """Deviation from ``base`` in percent, 0 where the base is not positive."""
    return F.when(base > 0, (value - base) / base * 100).otherwise(F.lit(0.0))
