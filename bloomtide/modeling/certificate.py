"""Whether a logistic fit is the optimum: the gradient of what it minimises.

0.5 |w|^2 + C * sum(weight * loss) has its minimum where every derivative is 0, so the
gradient proves a fit without a second one. It is one aggregation over the rows.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from bloomtide.modeling.estimators import VECTOR, features_of
from bloomtide.modeling.prepare import class_counts, with_class_weights


def logistic_gradient(model: PipelineModel, train: DataFrame, *, label: str = "label", c: float = 1.0) -> DataFrame:
    """``class, feature, gradient, rows, weight``; the gradient over C times the sum of weights.

    With two classes only class 1 has coefficients. ``rows`` and ``weight`` are those of
    the class.
    """
    columns = [label, *features_of(model)]
    rows = with_class_weights(train.select(*columns).filter(F.col(label).isNotNull()), label)
    scored = model.transform(rows).select(
        F.col(label).alias("_y"), "weight", vector_to_array(VECTOR).alias("_x"), vector_to_array("probability").alias("_p"))
    matrix = model.stages[-1].coefficientMatrix.toArray()
    classes = [1] if len(matrix) == 1 else list(range(len(matrix)))
    names = features_of(model)
    sums = scored.agg(F.sum("weight").alias("_w"), *[
        F.sum(F.col("weight") * (F.col("_p")[k] - (F.col("_y") == k).cast("double")) * F.col("_x")[j]).alias(f"_{k}_{j}")
        for k in classes for j in range(len(names))])
    lines = [F.struct(F.lit(k).alias("class"), F.lit(f).alias("feature"),
                      ((F.lit(float(matrix[i, j])) / c + F.col(f"_{k}_{j}")) / F.col("_w")).alias("gradient"))
             for i, k in enumerate(classes) for j, f in enumerate(names)]
    counts = class_counts(train, label).select(F.col("class").cast("int").alias("class"), F.col("n").alias("rows"))
    weights = rows.groupBy(F.col(label).cast("int").alias("class")).agg(F.first("weight").alias("weight"))
    return sums.select(F.inline(F.array(*lines))).join(counts.join(weights, "class"), "class")
