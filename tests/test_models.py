from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from bloomtide.fixed_values import GRID
from bloomtide.modeling import certificate, estimators, metrics, prepare, selection, store
from bloomtide.modeling.tree_model import permutation_importance
from bloomtide.session import scratch_path
from bloomtide.sources.versions import Versions
from catalog import models_scoring
from tests.frames import D

FEATURES = ["x", "y"]


@pytest.fixture(scope="module")
def table(spark):
    """60 dates of 5 stations, the label mostly decided by x."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        for station in range(5):
            x, y = rng.gauss(0, 1), rng.gauss(5, 3)
            label = 0 if x + 0.1 * rng.gauss(0, 1) < 0.4 else 1 if x < 1.2 else 2
            rows.append((station, D(2024, 1, 1) + dt.timedelta(days=i), x, y, label))
    schema = "station bigint, date date, x double, y double, label int"
    return spark.createDataFrame(rows, schema).cache()


def pairs(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int")


def test_folds_of_thirteen_dates(spark):
    days = spark.createDataFrame(
        [(s, D(2024, 1, 1) + dt.timedelta(days=i)) for i in range(13) for s in range(i % 3 + 1)],
        "station int, date date",
    )
    bounds = prepare.fold_bounds(days).orderBy("fold").collect()
    assert [r["n_train_dates"] for r in bounds] == [3, 5, 7, 9, 11]
    assert [r["n_test_dates"] for r in bounds] == [2] * 5
    member = prepare.time_series_folds(days, prepare.fit_folds(days))
    ranges = member.groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("date"))).alias("a"),
        F.min(F.when(F.col("role") == "test", F.col("date"))).alias("b"),
    ).collect()
    assert all(r["a"] < r["b"] for r in ranges) and len(ranges) == 5


def test_too_few_dates_for_folds(spark):
    days = spark.createDataFrame([(D(2024, 1, 1),)], "date date")
    with pytest.raises(ValueError, match="too few"):
        prepare.fit_folds(days)


def test_standardised_by_the_population_deviation(spark, table):
    fitted = prepare.fit_standardizer(table, FEATURES)
    scaled = prepare.standardize(table, fitted)
    row = scaled.agg(F.avg("x"), F.stddev_pop("x"), F.stddev_pop("y")).first()
    assert [round(v, 9) + 0.0 for v in row] == [0.0, 1.0, 1.0]
    preparation = estimators.fit_preparation(table, table.count(), FEATURES)
    both = preparation.transform(table).select(
        vector_to_array("features")[0].alias("v"), "station", "date"
    ).join(scaled, ["station", "date"])
    assert both.agg(F.max(F.abs(F.col("v") - F.col("x")))).first()[0] < 1e-12


def test_constant_column_becomes_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    got = prepare.standardize(df, prepare.fit_standardizer(df, ["x"]))
    assert [r["x"] for r in got.collect()] == [0.0, 0.0]


def test_balanced_weights(spark):
    df = pairs(spark, [(0, 0)] * 6 + [(1, 0)] * 2 + [(None, 0)])
    weights = prepare.class_weights(df, "label")
    assert dict(weights.collect()) == {0: 8 / 12, 1: 2.0}
    total = prepare.with_class_weights(df, "label", weights).agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(8.0)
    many = spark.range(450).withColumn("label", F.col("id") % 150)
    weighted = prepare.with_class_weights(many, "label")
    assert weighted.count() == 450 and weighted.agg(F.sum("weight")).first()[0] == pytest.approx(450)
    with pytest.raises(ValueError, match="no values"):
        prepare.class_weights(many.filter("id < 0"), "label")


def test_report_of_unpredicted_and_unseen_classes(spark):
    df = pairs(spark, [(0, 0)] * 5 + [(1, 0)] * 2 + [(1, 1)] + [(0, 2)])
    got = {r["item"]: r for r in metrics.classification_report(df).collect()}
    assert got["0"]["precision"] == pytest.approx(5 / 7) and got["0"]["recall"] == pytest.approx(5 / 6)
    assert got["2"]["precision"] == 0.0 and got["2"]["recall"] == 0.0 and got["2"]["support"] == 0
    f1 = [2 * 5 / 13, 2 * 1 / 4, 0.0]
    assert got["macro avg"]["f1"] == pytest.approx(sum(f1) / 3)
    assert got["weighted avg"]["f1"] == pytest.approx((f1[0] * 6 + f1[1] * 3) / 9)
    assert metrics.macro_f1(df).first()[0] == pytest.approx(sum(f1) / 3)
    assert metrics.classification_report(df.limit(0)).count() == 0


def test_accuracy_is_trace_over_total(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.randrange(3)) for _ in range(500)]
    df = pairs(spark, rows)
    matrix = metrics.confusion_matrix(df, (0, 1, 2)).orderBy("actual").collect()
    trace = sum(matrix[i][f"predicted_{i}"] for i in range(3))
    accuracy = metrics.classification_report(df).filter("item = 'accuracy'").first()
    assert accuracy["f1"] == pytest.approx(trace / 500) and accuracy["support"] == 500


def test_confusion_matrix_keeps_empty_classes(spark):
    got = metrics.confusion_matrix(pairs(spark, [(0, 1)]), (0, 1, 2)).collect()
    assert [tuple(r) for r in got] == [(0, 0, 1, 0), (1, 0, 0, 0), (2, 0, 0, 0)]


def test_overfit_gap(spark):
    df = pairs(spark, [(0, 0), (1, 1)]).withColumn("split", F.lit("train")).unionByName(
        pairs(spark, [(0, 1), (1, 1)]).withColumn("split", F.lit("test"))
    )
    assert tuple(metrics.overfit_gap(df).first()) == (1.0, 0.333, 0.667)


def test_probability_is_the_sigmoid_of_the_coefficients(spark, table):
    binary = table.withColumn("label", (F.col("label") > 0).cast("int"))
    model = estimators.fit_logistic(binary, features=FEATURES)
    fitted = model.stages[-1]
    scaled = prepare.standardize(binary, prepare.fit_standardizer(binary, FEATURES))
    z = F.lit(fitted.intercept) + sum(
        F.lit(float(w)) * F.col(c) for w, c in zip(fitted.coefficients, FEATURES)
    )
    expected = scaled.select("station", "date", (1 / (1 + F.exp(-z))).alias("e"))
    got = model.transform(binary).select(
        "station", "date", vector_to_array("probability")[1].alias("p")
    )
    worst = got.join(expected, ["station", "date"]).agg(F.max(F.abs(F.col("p") - F.col("e"))))
    assert worst.first()[0] < 1e-9


def test_logistic_solves_the_balanced_penalised_problem(spark, table):
    """The gradient of 0.5 |w|^2 + C * sum(weight * loss) vanishes at the fit."""
    binary = table.withColumn("label", (F.col("label") > 0).cast("int"))
    c = 0.5
    model = estimators.fit_logistic(binary, c=c, features=FEATURES).stages[-1]
    rows = prepare.with_class_weights(
        prepare.standardize(binary, prepare.fit_standardizer(binary, FEATURES)), "label"
    ).collect()
    for k, name in enumerate(FEATURES):
        gradient = float(model.coefficients[k])
        for r in rows:
            z = model.intercept + sum(float(w) * r[f] for w, f in zip(model.coefficients, FEATURES))
            gradient += c * r["weight"] * (1 / (1 + math.exp(-z)) - r["label"]) * r[name]
        assert abs(gradient) < 1e-2 * len(rows) ** 0.5


@pytest.mark.parametrize("family, params", [
    ("tree", {"max_depth": None}),
    ("forest", {"trees": 5, "max_depth": 4, "min_leaf": 2}),
    ("boosted", {"rounds": 3, "max_depth": 2, "rate": 0.1}),
])
def test_every_family_learns_three_classes(spark, table, family, params):
    model = estimators.fit(table, family, params, features=FEATURES)
    accuracy = model.transform(table).agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double"))
    ).first()[0]
    assert accuracy > 0.85
    importance = estimators.feature_importance(model).collect()
    assert [r["feature"] for r in importance] == ["y", "x"]


def test_grid_has_38_combinations_in_order(spark):
    combos = selection.candidates(GRID)
    assert len(combos) == 38 and [c.position for c in combos] == list(range(38))
    assert combos[0].family == "logistic" and combos[-1].family == "boosted"


def test_grid_search_and_saved_model(spark, table):
    grid = {"logistic": {"c": (1.0, 1.0)}, "tree": {"max_depth": (1,)}}
    found = selection.grid_search(table, grid=grid, splits=3, features=FEATURES)
    results = found.results.collect()
    assert len(results) == 9 and {r["fold"] for r in results} == {1, 2, 3}
    means = {r["position"]: r["score"] for r in selection.mean_scores(found.results).collect()}
    assert means[0] == means[1] and found.best_score == pytest.approx(max(means.values()))
    assert found.best.position in (0, 2)  # equal scores: the first
    path = scratch_path(spark, "models")
    store.save_models({"a": found.model}, path)
    loaded = store.load_models(["a"], path)["a"]
    assert isinstance(loaded, PipelineModel) and estimators.features_of(loaded) == FEATURES
    columns = ["station", "date", "prediction"]
    assert sorted(loaded.transform(table).select(columns).collect()) == sorted(
        found.model.transform(table).select(columns).collect()
    )


def test_the_gradient_of_a_fit_is_zero_and_of_another_point_is_not(spark, table):
    for label in (F.col("label"), (F.col("label") > 0).cast("int")):
        rows = table.withColumn("label", label)
        model = estimators.fit_logistic(rows, c=0.5, features=FEATURES)
        found = certificate.logistic_gradient(model, rows, c=0.5).collect()
        assert max(abs(r["gradient"]) for r in found) < 1e-4
        other = estimators.fit_logistic(rows, c=0.01, features=FEATURES)
        assert max(abs(r["gradient"]) for r in certificate.logistic_gradient(other, rows, c=0.5).collect()) > 1e-3


def test_permutation_importance(spark, table):
    model = estimators.fit_forest(table, trees=20, max_depth=4, min_leaf=2, features=FEATURES)
    got = {r["feature"]: r["importance"] for r in permutation_importance(model, table).collect()}
    assert got["x"] > 0.3 and abs(got["y"]) < 0.1
    stump = estimators.fit_tree(table, max_depth=1, features=FEATURES)
    assert {r["feature"]: r["importance"] for r in permutation_importance(stump, table).collect()}["y"] == 0.0


def test_model_folder(spark, table, monkeypatch):
    path = scratch_path(spark, "models")
    with pytest.raises(store.ManifestError, match="no models"):
        store.load_models(["a"], path)
    first = estimators.fit_tree(table, max_depth=2, features=FEATURES)
    store.save_models({"a": first}, path, {"a": store.training_range(table)})
    folder, manifest = store.read_manifest(path)
    assert manifest["a"]["features"] == FEATURES and manifest["a"]["classes"] == 3
    assert manifest["a"]["trained_on"] == {"first_date": "2024-01-01", "last_date": "2024-02-29", "rows": 300}
    second = estimators.fit_logistic(table, features=FEATURES)
    with monkeypatch.context() as crash:  # the models are written, the commit is not
        def stopped(*args):
            raise InterruptedError
        crash.setattr(Versions, "commit", stopped)
        with pytest.raises(InterruptedError):
            store.save_models({"a": second}, path)
    assert store.checksum(store.load_models(["a"], path)["a"]) == store.checksum(first)
    store.save_models({"a": second}, path)
    assert isinstance(store.load_models(["a"], path, features=FEATURES)["a"], PipelineModel)
    for names, features, text in ((["b"], None, "no model"), (["a"], FEATURES[::-1], "other features")):
        with pytest.raises(store.ManifestError, match=text):
            store.load_models(names, path, features=features)
    store.save_models({"a": first}, path)
    folder, _ = store.read_manifest(path)
    estimators.fit_tree(table, max_depth=1, features=FEATURES).table(spark).write.mode("overwrite").parquet(f"{folder}/a")
    with pytest.raises(store.ManifestError, match="not the model"):
        store.load_models(["a"], path)


def test_queries_search_the_whole_grid():
    """Each family query asks for all its combinations, both taxa and both kinds of target."""
    names = {f"grid_search_{f}" for f in GRID}
    assert names <= set(models_scoring.query.__globals__["QUERIES"])
    assert len(models_scoring.SEARCHED) == 4 and sum(len(selection.candidates({f: GRID[f]})) for f in GRID) == 38
