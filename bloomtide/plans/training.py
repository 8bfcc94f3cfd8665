"""Model selection and evaluation for one taxon, from the daily table on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from bloomtide.fixed_values import DATE, FEATURES, FOLDS, GRID, STATION, TRAIN_LAST_YEAR
from bloomtide.modeling.estimators import feature_importance
from bloomtide.modeling.metrics import classification_report, confusion_matrix, overfit_gap
from bloomtide.modeling.selection import SearchResult, grid_search, mean_scores
from bloomtide.operators.features import (
    feature_table, target3, target_binary_from3, year_split,
)
from bloomtide.operators.topk import best_per_group
from bloomtide.session import materialise


@dataclass(frozen=True)
class Evaluation:
    """What is known about the chosen model of one taxon."""

    search: SearchResult
    families: DataFrame    # best combination of each model family
    report: DataFrame      # on the test years
    confusion: DataFrame   # on the test years
    gap: DataFrame         # macro F1 on train and test
    importance: DataFrame


def labelled_features(
    daily: DataFrame, *, keys: Sequence[str] = (STATION,), date: str = DATE
) -> DataFrame:
    """Complete features with the three-class and the binary target of both taxa."""
    table = feature_table(daily, keys=keys, date=date)
    return target_binary_from3(target3(table, keys=keys, date=date))


def train_and_evaluate(
    labelled: DataFrame, taxon: str, *, binary: bool = True,
    last_train_year: int = TRAIN_LAST_YEAR, features: Sequence[str] = FEATURES,
    grid: Mapping[str, Mapping[str, Sequence]] = GRID, splits: int = FOLDS, date: str = DATE,
    parallelism: int = 4,
) -> Evaluation:
    """Search on the years up to ``last_train_year``, evaluate on the years after."""
    label = f"risk_bin_{taxon}_next" if binary else f"risk_{taxon}_next"
    rows = labelled.select(date, F.col(label).cast("int").alias("label"), *features)
    train, test = year_split(rows, last_train_year, date=date)
    search = grid_search(
        train, features=features, grid=grid, splits=splits, date=date, parallelism=parallelism
    )
    split = F.when(F.year(date) <= last_train_year, "train").otherwise("test")
    # the features are computed and the model applied once, for all three measures
    predicted = materialise(
        search.model.transform(rows.withColumn("split", split)).select("split", "label", "prediction")
    )
    on_test = predicted.filter("split = 'test'")
    return Evaluation(
        search=search,
        families=best_per_group(mean_scores(search.results)),
        report=classification_report(on_test),
        confusion=confusion_matrix(on_test, (0, 1) if binary else (0, 1, 2)),
        gap=overfit_gap(predicted),
        importance=feature_importance(search.model),
    )
