"""Scoring past dates, forecast days and precomputed features.

A model is anything with ``transform``: a fitted ``PipelineModel`` whose first
stages take feature columns. It adds ``prediction`` and, if it has one,
``probability`` (an ML vector or an array of class probabilities).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from bloomtide.fixed_values import (
    DATE, DEFAULT_THRESHOLD, FEATURE_LOOKBACK, HORIZON_DAYS, SCORE_DAYS, SOURCE_API,
    SOURCE_CACHE, SOURCE_FORECAST, STATION,
)
from bloomtide.functions.risk import label_of_class, label_of_probability
from bloomtide.operators.cleaning import drop_incomplete
from bloomtide.operators.daily import archive_plus_forecast
from bloomtide.operators.features import feature_table
from bloomtide.operators.topk import row_exact_or_fail
from bloomtide.sources.scans import horizon_scan, trailing_window_scan

KEYS = (STATION,)


def _risk_probability(df: DataFrame) -> Column:
    if "probability" not in df.columns:
        return F.lit(None).cast("double")
    kind = df.schema["probability"].dataType.typeName()
    values = F.col("probability") if kind == "array" else vector_to_array("probability")
    return F.get(values, F.lit(1))


def apply_models(rows: DataFrame, model_a, model_b) -> DataFrame:
    """Class and risk probability of both taxa, as ``class_*`` and ``proba_*``."""
    for side, model in (("a", model_a), ("b", model_b)):
        before = rows.columns
        scored = model.transform(rows)
        rows = scored.select(
            *before, F.col("prediction").cast("int").alias(f"class_{side}"),
            _risk_probability(scored).alias(f"proba_{side}"),
        )
    return rows


def _complete_features(daily: DataFrame, keys: Sequence[str], date: str, reset) -> DataFrame:
    return drop_incomplete(feature_table(daily, keys=keys, date=date, reset=reset))


def latest_features(
    complete: DataFrame, targets: DataFrame, *, days: int = SCORE_DAYS,
    keys: Sequence[str] = KEYS, date: str = DATE,
) -> DataFrame:
    """For each target the last complete feature row within the loaded days.

    ``targets`` holds the keys and ``target``, and optionally ``loaded_to``, the
    day the ``days`` are counted back from (by default the target). The first
    seven loaded days have no full history themselves, so they do not count; a
    target without a complete row disappears.

    Features and targets of a key are laid on one time line and each target
    takes the last feature row up to it: one shuffle, no join on a date range,
    no copies of targets. Both are at most one row per key and day.
    """
    values = [c for c in complete.columns if c not in keys]
    loaded_to = "loaded_to" if "loaded_to" in targets.columns else "target"
    known = complete.select(
        *keys, F.col(date).alias("_on"), F.lit(None).cast("date").alias("target"),
        F.lit(None).cast("date").alias("_first"), F.struct(*values).alias("_row"),
    )
    asked = targets.select(
        *keys, F.col("target").alias("_on"), "target",
        F.date_sub(loaded_to, days - FEATURE_LOOKBACK).alias("_first"),
    )
    # a day asked for many times is one row of the line
    line = known.unionByName(asked.distinct(), allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy("_on").rangeBetween(
        Window.unboundedPreceding, Window.currentRow  # rows of the same day included
    )
    placed = line.withColumn("_row", F.last("_row", ignorenulls=True).over(upto))
    return placed.filter(
        F.col("target").isNotNull() & (F.col("_row").getField(date) >= F.col("_first"))
    ).select(*keys, "target", "_row.*")


def _predictions(
    rows: DataFrame, model_a, model_b, keys: Sequence[str], date: str, source: Column,
    threshold: float | None,
) -> DataFrame:
    """Labels per target; by threshold where given and a probability exists.

    Rows from stored features keep the model's own label, without probabilities.
    """
    scored = apply_models(rows, model_a, model_b)
    out = {}
    for side in ("a", "b"):
        out[f"proba_{side}"] = F.when(source != SOURCE_CACHE, F.col(f"proba_{side}"))
        label = label_of_class(f"class_{side}")
        if threshold is not None:
            label = F.coalesce(label_of_probability(out[f"proba_{side}"], threshold), label)
        out[f"label_{side}"] = label
    extra = [c for c in ("horizon",) if c in rows.columns]
    return scored.select(
        *keys, F.col("target").alias("date"), F.col(date).alias("feature_date"),
        F.date_add(date, 1).alias("predicted_date"), *extra,
        *[out[n].alias(n) for n in ("label_a", "label_b", "proba_a", "proba_b")],
        source.alias("source"),
    )


def score_date(
    daily: DataFrame, targets: DataFrame, model_a, model_b, *, days: int = SCORE_DAYS,
    keys: Sequence[str] = KEYS, date: str = DATE, reset: str | None = "year",
) -> DataFrame:
    """Labels for any set of station dates, from the models' own decision.

    ``daily`` is the gap-free daily table. ``date`` of the result is the date
    asked for, ``feature_date`` the day the features describe and
    ``predicted_date`` the day after it, which the models were trained to label.
    """
    complete = _complete_features(daily, keys, date, reset)
    rows = latest_features(complete, targets, days=days, keys=keys, date=date)
    scored = _predictions(rows, model_a, model_b, keys, date, F.lit(SOURCE_API), None)
    return scored.drop("proba_a", "proba_b", "source")


def score_with_threshold(
    daily: DataFrame, targets: DataFrame, model_a, model_b, *,
    threshold: float = DEFAULT_THRESHOLD, days: int = SCORE_DAYS,
    keys: Sequence[str] = KEYS, date: str = DATE, reset: str | None = "year",
) -> DataFrame:
    """Labels by a probability threshold, with the probabilities.

    A model without probabilities keeps its own label, its probability is NULL.
    """
    complete = _complete_features(daily, keys, date, reset)
    rows = latest_features(complete, targets, days=days, keys=keys, date=date)
    return _predictions(rows, model_a, model_b, keys, date, F.lit(SOURCE_API), threshold)


def score_horizon(
    archive: DataFrame, forecast: DataFrame, today: dt.date, model_a, model_b, *,
    horizons: Sequence[int] = (1, 2, 3), threshold: float = DEFAULT_THRESHOLD,
    keys: Sequence[str] = KEYS, date: str = DATE, reset: str | None = "year",
    days: int = HORIZON_DAYS,
) -> DataFrame:
    """Labels for the coming days from archive days and forecast days together.

    Both inputs are daily tables. All horizons are scored in one pass; a day
    whose features are incomplete takes the last complete ones before it.
    """
    # Degree days since 1 January need the whole year, all else the loaded days.
    loaded = days if reset is None else max(days, today.timetuple().tm_yday)
    past = trailing_window_scan(archive, today, loaded, ts=date)
    ahead = horizon_scan(forecast, today, max(horizons), ts=date)
    both = archive_plus_forecast(past, ahead, keys=keys, date=date).drop("origin")
    complete = _complete_features(both, keys, date, reset)
    targets_ahead = F.array(*[
        F.struct(F.lit(today + dt.timedelta(days=h)).alias("target"),
                 F.lit(today).alias("loaded_to"))
        for h in horizons
    ])
    targets = both.select(*keys).distinct().select(*keys, F.inline(targets_ahead))
    rows = latest_features(
        complete, targets, days=days, keys=keys, date=date
    ).withColumn("horizon", F.date_diff(F.col("target"), F.lit(today)))
    return _predictions(rows, model_a, model_b, keys, date, F.lit(SOURCE_FORECAST), threshold)


def score_precomputed(
    features: DataFrame, target: dt.date, model_a, model_b, *,
    keys: Sequence[str] = KEYS, date: str = DATE,
) -> DataFrame:
    """Labels from stored features of exactly one date; fails without that date."""
    rows = row_exact_or_fail(features, target, keys=keys, date=date)
    rows = rows.withColumn("target", F.lit(target))
    return _predictions(rows, model_a, model_b, keys, date, F.lit(SOURCE_CACHE), None)


def score_with_fallback(
    daily: DataFrame, targets: DataFrame, stored: DataFrame, model_a, model_b, *,
    threshold: float = DEFAULT_THRESHOLD, days: int = SCORE_DAYS,
    keys: Sequence[str] = KEYS, date: str = DATE, reset: str | None = "year",
) -> DataFrame:
    """Like :func:`score_with_threshold`, falling back to stored features.

    A target without complete recent features is labelled from ``stored``, by
    the row of exactly its date and without probabilities; a target that is in
    neither is missing from the result. ``source`` says where a row comes from.
    """
    complete = _complete_features(daily, keys, date, reset)
    recent = latest_features(complete, targets, days=days, keys=keys, date=date)
    asked = targets.select(*keys, "target", F.col("target").alias(date)).distinct()
    exact = stored.join(asked, [*keys, date], "inner").select(recent.columns)
    both = recent.withColumn("source", F.lit(SOURCE_API)).unionByName(
        exact.withColumn("source", F.lit(SOURCE_CACHE))
    )
    # At most two rows per target; "api" sorts before "cache".
    rank = F.row_number().over(Window.partitionBy(*keys, "target").orderBy("source"))
    rows = both.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    return _predictions(rows, model_a, model_b, keys, date, F.col("source"), threshold)
