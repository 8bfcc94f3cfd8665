"""Feature tables, feature lists and next-day targets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from bloomtide.fixed_values import DATE, FEATURES, POLLEN, STATION
from bloomtide.functions.calendar import calendar_parts, cyclic, season
from bloomtide.functions.numeric import degree_days
from bloomtide.functions.risk import binary_from_class3, risk_binary, risk_class3
from bloomtide.operators.cleaning import drop_incomplete
from bloomtide.operators.windows import series_window, trailing, year_window

KEYS = (STATION,)


def feature_table(
    daily: DataFrame, *, keys: Sequence[str] = KEYS, date: str = DATE, reset: str = "year"
) -> DataFrame:
    """Daily table plus calendar, weather and pollen history features.

    Degree days restart on 1 January with ``reset="year"``; ``reset=None`` lets
    them run over all rows. All windows share one partitioning and one sort.
    """
    if reset not in ("year", None):
        raise ValueError(f"reset is 'year' or None, not {reset!r}")
    parts = calendar_parts(date)
    month = parts["month"]
    base = daily.withColumns({
        **parts, "season": season(month), **cyclic(parts["doy"], month),
        "gdd_daily": degree_days("temperature"),
    })
    w = series_window(base, keys, date)
    week, three = w.rowsBetween(-7, -1), w.rowsBetween(-3, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    total = year_window(keys, date) if reset == "year" else so_far

    pollen = {}
    for p in POLLEN:
        pollen |= {f"{p}_lag{k}": F.lag(p, k).over(w) for k in (1, 2, 3)}
        pollen[f"{p}_mean3"] = trailing(p, 3, "mean", three)
    windowed = base.withColumns({
        "temp_lag1": F.lag("temperature", 1).over(w),
        "temp_roll7": trailing("temperature", 7, "mean", week),
        "precip_lag1": F.lag("precipitation", 1).over(w),
        "precip_lag2": F.lag("precipitation", 2).over(w),
        "precip_roll7": trailing("precipitation", 7, "sum", week),
        "wind_lag1": F.lag("wind", 1).over(w),
        "wind_roll7": trailing("wind", 7, "mean", week),
        **pollen,
    })
    cumulated = F.when(F.col("gdd_daily").isNotNull(), F.sum("gdd_daily").over(total))
    return windowed.withColumn("gdd_cumul", cumulated)


def feature_table_simple(
    daily: DataFrame, *, columns: Sequence[str] = POLLEN,
    keys: Sequence[str] = KEYS, date: str = DATE,
) -> DataFrame:
    """Month, day of year, lags 1 to 3 and the mean of three days up to today.

    Rows with any missing value are dropped.
    """
    w = series_window(daily, keys, date)
    out = {"month": F.month(date), "doy": F.dayofyear(date)}
    for c in columns:
        out |= {f"{c}_lag{k}": F.lag(c, k).over(w) for k in (1, 2, 3)}
        out[f"{c}_mean3"] = trailing(c, 3, "mean", w.rowsBetween(-2, 0))
    return drop_incomplete(daily.withColumns(out))


def select_features(
    df: DataFrame, features: Sequence[str] = FEATURES, *, also: Sequence[str] = ()
) -> DataFrame:
    """The named features in their order, after the columns in ``also``."""
    return df.select(*also, *features)


def target3(
    df: DataFrame, *, columns: Sequence[str] = POLLEN,
    keys: Sequence[str] = KEYS, date: str = DATE,
) -> DataFrame:
    """Three-class risk of the next day; rows with any missing value are dropped.

    The class is taken before shifting: a missing reading counts as the highest
    class, while the last day, which has no next day, has no target and goes.
    """
    w = series_window(df, keys, date)
    out = {f"risk_{c}_next": F.lead(risk_class3(c), 1).over(w) for c in columns}
    return drop_incomplete(df.withColumns(out))


def target_binary(
    df: DataFrame, *, columns: Sequence[str] = POLLEN,
    keys: Sequence[str] = KEYS, date: str = DATE,
) -> DataFrame:
    """Whether the next day is at risk; rows with any missing value are dropped."""
    w = series_window(df, keys, date)
    out = {f"risk_bin_{c}_next": F.lead(risk_binary(c), 1).over(w) for c in columns}
    return drop_incomplete(df.withColumns(out))


def target_binary_from3(df: DataFrame, *, columns: Sequence[str] = POLLEN) -> DataFrame:
    """Binary target from the three-class one."""
    return df.withColumns({
        f"risk_bin_{c}_next": binary_from_class3(f"risk_{c}_next") for c in columns
    })


def year_split(
    df: DataFrame, last_train_year: int, *, date: str = DATE
) -> tuple[DataFrame, DataFrame]:
    """Train up to and including a year, test after it.

    Written as a bound on the date itself so that it reaches the scan.
    """
    bound = F.lit(dt.date(last_train_year + 1, 1, 1))
    return df.filter(F.col(date) < bound), df.filter(F.col(date) >= bound)
