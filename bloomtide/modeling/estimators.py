"""The four classifier families: logistic regression by Spark ML, trees by ``growth``.

A fitted model has ``transform``, which adds ``prediction`` and ``probability``. Logistic
models are Spark ML pipelines, trees, forests and boosted trees are tables of nodes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from bloomtide.fixed_values import FEATURES, LOGISTIC_MAX_ITER, SEED
from bloomtide.modeling import boosting
from bloomtide.modeling.forests import Run, depth_of
from bloomtide.modeling.growth import balanced, bin_edges, class_sizes, class_stats, grow_all, pack_rows
from bloomtide.modeling.prepare import class_totals, with_class_weights
from bloomtide.modeling.splits import exact_edges
from bloomtide.modeling.tree_model import TreeModel, importance
from bloomtide.operators.topk import sorted_importance
from bloomtide.session import materialise

#: Rows of a node that meet in one task, where its subtree is grown; nodes above are split by sums.
BOUND = 50_000
VECTOR = "features"
Model = PipelineModel | TreeModel


def fit_preparation(
    train: DataFrame, n: int, features: Sequence[str] = FEATURES
) -> PipelineModel:
    """Assemble and standardise by the population standard deviation.

    Spark's scaler divides by the sample standard deviation of the ``n`` rows,
    so its result is stretched by sqrt(n / (n - 1)).
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="_raw")
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_scaled")
    fitted = scaler.fit(assembler.transform(train))
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    stretch = ElementwiseProduct(
        scalingVec=Vectors.dense([factor] * len(features)), inputCol="_scaled", outputCol=VECTOR
    )
    return PipelineModel([assembler, fitted, stretch])


def logistic(params: Mapping[str, float | int | None], total_weight: float) -> LogisticRegression:
    """Minimises 0.5 |w|^2 + C * sum(weight * loss), divided by C * sum(weight)."""
    return LogisticRegression(
        featuresCol=VECTOR, labelCol="label", weightCol="weight", maxIter=LOGISTIC_MAX_ITER, elasticNetParam=0.0,
        regParam=1.0 / (params["c"] * total_weight), standardization=False,
    )


@dataclass(frozen=True)
class TrainingRows:
    """Rows with balanced weights and standardised vectors."""

    rows: DataFrame
    preparation: PipelineModel
    n_classes: int
    total_weight: float


def training_rows(
    train: DataFrame, label: str, features: Sequence[str] = FEATURES
) -> TrainingRows:
    """Prepare ``train``, which should be materialised: it is read several times."""
    totals = class_totals(train, label)
    preparation = fit_preparation(train, totals.rows, features)
    weighted = with_class_weights(train, label)
    vectors = preparation.transform(weighted).select(F.col(label).alias("label"), "weight", VECTOR)
    # Balanced weights add up to the number of rows.
    return TrainingRows(vectors, preparation, totals.largest + 1, float(totals.rows))


def fit_trees(rows: DataFrame, family: str, params: Mapping[str, float | int | None], features: Sequence[str],
              seed: int, bound: int, exact_bins: bool = False) -> TreeModel:
    """A tree, forest or boosted model of stored rows with an integer ``label``."""
    edges = exact_edges(rows, features) if exact_bins else bin_edges(rows, features, [F.lit(True)])[0]
    blocks = materialise(pack_rows(rows, features, ["label"], [edges], [(None, None)], None))
    try:
        counts = class_sizes(blocks).get(0, {})
        if not counts:
            raise ValueError("'label' has no values")
        n_classes, sizes = max(2, max(counts) + 1), {0: sum(counts.values())}
        weights = balanced(counts, n_classes)
        if family == "boosted":
            one = boosting.Booster(0, 0, n_classes, float(params["rate"]), depth_of(params["max_depth"]))
            nodes = pa.concat_tables(boosting.boost(blocks, [one], sizes, int(params["rounds"]), bound, keep=True))
            how = {"kind": "margins", "rate": one.rate, "penalty": one.penalty}
        else:
            forest = family == "forest"
            run = Run(0, 0, weights, (int(params["trees"]) if forest else 1,), (depth_of(params["max_depth"]),),
                      int(params["min_leaf"]) if forest else 1, sampled=forest and bool(params.get("sampled", True)))
            nodes = grow_all(blocks, run.units(0, len(features), seed), sizes, class_stats, bound)
            how = {"kind": "votes", "weights": weights}
    finally:
        blocks.unpersist()
    feature, bin_ = nodes["feature"].to_numpy(), nodes["bin"].to_numpy()
    threshold = np.array([edges[f][b] if f >= 0 else np.nan for f, b in zip(feature, bin_)], np.float64)
    columns = [nodes["unit"], nodes["node"], nodes["feature"], pa.array(threshold), nodes["gain"], nodes["sums"]]
    table = pa.table(columns, ["tree", "node", "feature", "threshold", "gain", "sums"]).combine_chunks()
    return TreeModel(features=tuple(features), n_classes=n_classes, nodes=table, **how)


def fit(
    train: DataFrame, family: str, params: Mapping[str, float | int | None], *,
    label: str = "label", features: Sequence[str] = FEATURES, seed: int = SEED,
    stored: bool = False, bound: int = BOUND, exact_bins: bool = False,
) -> Model:
    """A model of one family, with the grid's parameter names, fitted on ``train``.

    ``train`` is read several times and so materialised first, unless it is ``stored``.
    Trees leave the features as they are; only logistic models scale them. Their bins are
    cut at approximate quantiles, with ``exact_bins`` at exact ones.
    """
    rows = train.select(F.col(label).cast("int").alias("label"), *features)
    if not stored:
        rows = materialise(rows)
    try:
        if family in ("tree", "forest", "boosted"):
            return fit_trees(rows, family, params, features, seed, bound, exact_bins)
        if family != "logistic":
            raise ValueError(f"unknown model family {family!r}")
        prepared = training_rows(rows, "label", features)
        model = logistic(params, prepared.total_weight).fit(prepared.rows)
        return PipelineModel([*prepared.preparation.stages, model])
    finally:
        if not stored:
            rows.unpersist()


def fit_logistic(train: DataFrame, *, c: float = 1.0, **options) -> Model:
    return fit(train, "logistic", {"c": c}, **options)


def fit_tree(train: DataFrame, *, max_depth: int | None = 5, **options) -> Model:
    return fit(train, "tree", {"max_depth": max_depth}, **options)


def fit_forest(
    train: DataFrame, *, trees: int = 200, max_depth: int | None = 3, min_leaf: int = 10,
    sampled: bool = True, **options
) -> Model:
    """``sampled``: each tree has its own rows (bootstrap) and each node its own features."""
    params = {"trees": trees, "max_depth": max_depth, "min_leaf": min_leaf, "sampled": sampled}
    return fit(train, "forest", params, **options)


def fit_boosted(
    train: DataFrame, *, rounds: int = 200, max_depth: int = 5, rate: float = 0.1, **options
) -> PipelineModel:
    return fit(train, "boosted", {"rounds": rounds, "max_depth": max_depth, "rate": rate}, **options)


def features_of(model: Model) -> list[str]:
    """The feature list a model was fitted on, in order."""
    if isinstance(model, TreeModel):
        return list(model.features)
    for stage in model.stages:
        if isinstance(stage, VectorAssembler):
            return stage.getInputCols()
    raise ValueError("the model has no assembler stage")


def feature_importance(model: Model) -> DataFrame:
    """Importances of trees, or absolute coefficients, in ascending order.

    One row per feature. With several classes the coefficients of the first are taken.
    """
    spark = SparkSession.active()
    if isinstance(model, TreeModel):
        return importance(model.table(spark), model.features, model.kind)
    values = abs(model.stages[-1].coefficientMatrix.toArray()[0])
    rows = [(name, float(v)) for name, v in zip(features_of(model), values)]
    return sorted_importance(spark.createDataFrame(rows, "feature string, importance double"))
