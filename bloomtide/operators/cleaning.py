"""Filling and dropping missing values."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def fill_constant(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    """Replace missing values of ``columns``; an unknown column only warns."""
    known = [c for c in columns if c in df.columns]
    for c in columns:
        if c not in df.columns:
            warnings.warn(f"column {c!r} does not exist", stacklevel=2)
    if not known:
        return df
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in known})


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Only rows without a missing value (in ``columns``, by default in any)."""
    return df.dropna("any", subset=list(columns) if columns is not None else None)
