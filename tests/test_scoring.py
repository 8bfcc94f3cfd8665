from __future__ import annotations

import datetime as dt

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from bloomtide.operators.features import feature_table
from bloomtide.plans import scoring
from tests.frames import D, series

FIRST = D(2024, 3, 1)


def rule(statement: str) -> PipelineModel:
    return PipelineModel([SQLTransformer(statement=f"SELECT *, {statement} FROM __THIS__")])


@pytest.fixture(scope="module")
def models(spark):
    """One model with probabilities and one without."""
    return (
        rule("CAST(pollen_a_lag1 > 30 AS DOUBLE) AS prediction, "
             "array(1 - pollen_a_lag1 / 100, pollen_a_lag1 / 100) AS probability"),
        rule("CAST(pollen_b_lag1 > 30 AS DOUBLE) AS prediction"),
    )


@pytest.fixture(scope="module")
def days(spark):
    values = [float(i % 70) for i in range(60)]
    temperature = [10.0] * 60
    temperature[40] = None  # days 40 to 47 are incomplete
    return series(spark, FIRST, {"pollen_a": values, "pollen_b": values[::-1],
                                 "temperature": temperature})


def targets(spark, *offsets):
    return spark.createDataFrame(
        [(1, FIRST + dt.timedelta(days=o)) for o in offsets], "station bigint, target date"
    )


def by_offset(df):
    return {(r["date"] - FIRST).days: r for r in df.collect()}


def test_last_complete_row_within_the_loaded_days(spark, days, models):
    got = by_offset(scoring.score_date(days, targets(spark, 5, 20, 45, 59, 65, 72, 73), *models))
    # Day 5 has no week behind it; from day 73 on, day 59 is out of reach.
    assert {o: (r["feature_date"] - FIRST).days for o, r in got.items()} == {
        20: 20, 45: 39, 59: 59, 65: 59, 72: 59
    }
    assert all(r["predicted_date"] == r["feature_date"] + dt.timedelta(days=1) for r in got.values())
    assert got[20]["label_a"] == "Faible" and got[20]["label_b"] == "À risque"


def test_equal_to_features_of_only_the_loaded_days(spark, days, models):
    """What loading twenty days and taking the last complete row would give."""
    for offset in (20, 45, 59, 65, 72, 73):
        target = FIRST + dt.timedelta(days=offset)
        loaded = days.filter(F.col("date").between(target - dt.timedelta(days=20), target))
        rows = feature_table(loaded).dropna().orderBy(F.desc("date")).limit(1).collect()
        got = scoring.score_date(days, targets(spark, offset), *models).collect()
        assert [r["feature_date"] for r in got] == [r["date"] for r in rows]


def test_threshold_and_model_without_probability(spark, days, models):
    got = by_offset(scoring.score_with_threshold(days, targets(spark, 25, 36), *models, threshold=0.3))
    assert (got[25]["proba_a"], got[25]["label_a"]) == (0.24, "Faible")
    assert (got[36]["proba_a"], got[36]["label_a"]) == (0.35, "À risque")
    assert got[25]["proba_b"] is None and got[25]["label_b"] == "À risque"
    assert got[36]["source"] == "api"


def test_horizon_in_one_pass(spark, days, models):
    today = FIRST + dt.timedelta(days=56)
    archive = days.filter(F.col("date") <= today)
    forecast = days.filter((F.col("date") > today) & (F.col("date") <= today + dt.timedelta(days=2)))
    got = by_offset(scoring.score_horizon(archive, forecast, today, *models))
    assert {o: (r["horizon"], (r["feature_date"] - FIRST).days) for o, r in got.items()} == {
        57: (1, 57), 58: (2, 58), 59: (3, 58)
    }
    assert got[59]["source"] == "forecast" and got[59]["proba_a"] == 0.57


def test_precomputed_features(spark, days, models):
    stored = feature_table(days).dropna()
    got = scoring.score_precomputed(stored, FIRST + dt.timedelta(days=36), *models).collect()
    assert len(got) == 1 and got[0]["label_a"] == "À risque" and got[0]["proba_a"] is None
    assert got[0]["source"] == "cache"
    with pytest.raises(Exception, match="no row dated"):
        scoring.score_precomputed(stored, D(2030, 1, 1), *models).collect()


def test_fallback_to_stored_features(spark, days, models):
    stored = feature_table(days).dropna()
    recent = days.filter(F.col("date") >= FIRST + dt.timedelta(days=30))
    got = by_offset(scoring.score_with_fallback(
        recent, targets(spark, 3, 20, 32, 39, 59), stored, *models, threshold=0.3
    ))
    assert {o: r["source"] for o, r in got.items()} == {
        20: "cache", 32: "cache", 39: "api", 59: "api"
    }
    # Stored rows: the model's own label (above 30), no probability.
    assert (got[32]["label_a"], got[32]["proba_a"]) == ("À risque", None)
    assert (got[39]["label_a"], got[39]["proba_a"]) == ("À risque", 0.38)
