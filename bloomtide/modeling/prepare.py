"""Scaling, class weights and forward-chaining folds.

``fit_*`` functions run one aggregation and return a few numbers (bounded by the
number of columns, classes or folds); what they return is then applied as
literals, so applying needs neither join nor shuffle.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from bloomtide.fixed_values import DATE, FOLDS


def fit_standardizer(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each column."""
    row = df.agg(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns
    ]).first()
    return {c: (row[c]["mean"], row[c]["std"]) for c in columns}


def standardize(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Scale with fitted values; a constant column becomes 0, as its scale is 1."""
    def scaled(c: str, mean: float | None, std: float | None) -> Column:
        if mean is None:
            return F.lit(None).cast("double")
        return (F.col(c) - F.lit(mean)) / F.lit(std or 1.0)

    return df.withColumns({c: scaled(c, *fitted[c]) for c in fitted})


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """``class`` and its number of rows ``n``; rows without a label do not count."""
    return df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(
        F.count("*").alias("n")
    )


@dataclass(frozen=True)
class ClassTotals:
    """What fitting needs of the classes: three numbers, however many there are."""

    rows: int
    classes: int
    largest: int


def class_totals(df: DataFrame, label: str) -> ClassTotals:
    row = class_counts(df, label).agg(F.sum("n"), F.count("*"), F.max("class")).first()
    if not row[1]:
        raise ValueError(f"{label!r} has no values")
    return ClassTotals(row[0], row[1], int(row[2]))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``class`` and its balanced weight: rows / (number of classes * rows of the class)."""
    totals = class_totals(df, label)
    return class_counts(df, label).select(
        "class", (F.lit(totals.rows) / (F.lit(totals.classes) * F.col("n"))).alias("weight")
    )


def with_class_weights(
    df: DataFrame, label: str, weights: DataFrame | None = None, *, out: str = "weight"
) -> DataFrame:
    """Weight of each row by its class, missing for others; fitted on ``df`` itself unless given.

    ``weights`` has ``class`` and ``weight``. It is joined: Spark sends it to all
    tasks when it is small and splits a hot class when it is not.
    """
    weights = class_weights(df, label) if weights is None else weights
    by_class = weights.select(F.col("class").alias(label), F.col("weight").alias("_weight"))
    columns = [c for c in df.columns if c != out]
    return df.join(by_class, label, "left").select(
        *columns, F.col("_weight").alias(out)
    )


@dataclass(frozen=True)
class Fold:
    """Train on dates before ``test_first``, test up to ``test_last``."""

    number: int
    test_first: dt.date
    test_last: dt.date


def fold_bounds(df: DataFrame, *, splits: int = FOLDS, date: str = DATE) -> DataFrame:
    """First and last test date and date counts of each forward-chaining fold.

    Folds are cut on distinct dates, so that all stations of a date fall on the
    same side. The unpartitioned window sees one row per calendar date only.
    """
    days = df.select(F.col(date).alias("_d")).distinct()
    numbered = days.select(
        "_d", (F.row_number().over(Window.orderBy("_d")) - 1).alias("_i"),
        F.count("*").over(Window.partitionBy(F.lit(0))).alias("_n"),
    )
    size = F.floor(F.col("_n") / (splits + 1))
    fold = F.explode(F.sequence(F.lit(1), F.lit(splits)))
    placed = numbered.select("*", fold.alias("fold")).withColumn(
        "_start", F.col("_n") - (splits + 1 - F.col("fold")) * size
    )
    test = (F.col("_i") >= F.col("_start")) & (F.col("_i") < F.col("_start") + size)
    return placed.groupBy("fold").agg(
        F.min(F.when(test, F.col("_d"))).alias("test_first"),
        F.max(F.when(test, F.col("_d"))).alias("test_last"),
        F.count_if(F.col("_i") < F.col("_start")).alias("n_train_dates"),
        F.count_if(test).alias("n_test_dates"),
    )


def fit_folds(df: DataFrame, *, splits: int = FOLDS, date: str = DATE) -> list[Fold]:
    rows = fold_bounds(df, splits=splits, date=date).orderBy("fold").collect()  # `splits` rows
    if any(r["test_first"] is None for r in rows) or not rows:
        raise ValueError(f"too few dates for {splits} folds")
    return [Fold(r["fold"], r["test_first"], r["test_last"]) for r in rows]


def fold_train(df: DataFrame, fold: Fold, *, date: str = DATE) -> DataFrame:
    return df.filter(F.col(date) < F.lit(fold.test_first))


def fold_test(df: DataFrame, fold: Fold, *, date: str = DATE) -> DataFrame:
    return df.filter(F.col(date).between(F.lit(fold.test_first), F.lit(fold.test_last)))


def time_series_folds(df: DataFrame, folds: Sequence[Fold], *, date: str = DATE) -> DataFrame:
    """Each row once per fold it belongs to, with ``fold`` and ``role``."""
    table = F.array(*[
        F.struct(F.lit(f.number).alias("fold"), F.lit(f.test_first).alias("first"),
                 F.lit(f.test_last).alias("last"))
        for f in folds
    ])
    member = df.select("*", F.explode(table).alias("_f")).filter(
        F.col(date) <= F.col("_f.last")
    )
    role = F.when(F.col(date) < F.col("_f.first"), "train").otherwise("test")
    return member.withColumns({"fold": F.col("_f.fold"), "role": role}).drop("_f")
