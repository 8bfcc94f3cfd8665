"""Risk classes, labels and confidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bloomtide.fixed_values import (
    CLASS3_LABELS, DEFAULT_THRESHOLD, LOW_LABEL, LOW_MAX, MODERATE_MAX, RISK_LABEL,
)


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def risk_class3(value: str | Column) -> Column:
    """0 up to 30, 1 up to 80, otherwise 2; a missing value also falls to 2."""
    v = _col(value)
    return F.when(v <= LOW_MAX, 0).when(v <= MODERATE_MAX, 1).otherwise(2)


def risk_binary(value: str | Column) -> Column:
    """1 above 30, otherwise 0; missing gives 0."""
    return F.coalesce(_col(value) > LOW_MAX, F.lit(False)).cast("int")


def binary_from_class3(label: str | Column) -> Column:
    """Moderate and high together."""
    return (_col(label) > 0).cast("int")


def class3_label(label: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in CLASS3_LABELS]), _col(label).cast("int") + 1)


def label_of_class(label: str | Column) -> Column:
    """Binary class to text."""
    v = _col(label)
    return F.when(v == 0, LOW_LABEL).when(v == 1, RISK_LABEL)


def label_of_probability(p: str | Column, threshold: float | Column = DEFAULT_THRESHOLD) -> Column:
    """At risk from the threshold on; missing probability gives no label."""
    p = _col(p)
    return F.when(p >= threshold, RISK_LABEL).when(p < threshold, LOW_LABEL)


def confidence(p: str | Column) -> Column:
    """How sure the model is of its own label, in percent."""
    p = _col(p)
    return F.when(p.isNotNull(), F.greatest(p, F.lit(1.0) - p) * 100)


def any_at_risk(label_a: str | Column, label_b: str | Column) -> Column:
    return (_col(label_a) == RISK_LABEL) | (_col(label_b) == RISK_LABEL)


def worst_label(label_a: str | Column, label_b: str | Column) -> Column:
    return F.when(any_at_risk(label_a, label_b), RISK_LABEL).otherwise(LOW_LABEL)
