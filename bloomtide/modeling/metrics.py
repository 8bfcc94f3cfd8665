"""Classification metrics from label and prediction columns.

Each reduces the rows to one count per pair of classes in a single aggregation;
everything after that works on a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def confusion_matrix(
    df: DataFrame, classes: Sequence[int], *, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Rows: true class; one column ``predicted_<class>`` per class; zeros included."""
    counts = df.agg(*[
        F.count_if((F.col(label) == a) & (F.col(prediction) == p)).alias(f"_{a}_{p}")
        for a in classes for p in classes
    ])
    lines = F.array(*[
        F.struct(F.lit(a).alias("actual"), *[
            F.col(f"_{a}_{p}").alias(f"predicted_{p}") for p in classes
        ])
        for a in classes
    ])
    return counts.select(F.inline(lines))


def _ratio(part: Column, whole: Column) -> Column:
    """0 where undefined."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    pairs = df.groupBy(
        F.col(label).cast("int").alias("_a"), F.col(prediction).cast("int").alias("_p")
    ).agg(F.count("*").alias("_n"))
    hit = F.when(F.col("_a") == F.col("_p"), F.col("_n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("_a").alias("class"), hit.alias("tp"), F.col("_n").alias("support"),
                 none.alias("predicted")),
        F.struct(F.col("_p").alias("class"), none.alias("tp"), none.alias("support"),
                 F.col("_n").alias("predicted")),
    )
    totals = pairs.select(F.inline(sides)).groupBy("class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
    )
    return totals.withColumns({
        "precision": _ratio(F.col("tp"), F.col("predicted")),
        "recall": _ratio(F.col("tp"), F.col("support")),
        # The harmonic mean of the two, without dividing by a zero sum.
        "f1": _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")),
    })


SCORES = ("precision", "recall", "f1")


def classification_report(
    df: DataFrame, *, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted means.

    A class counts when it occurs as label or as prediction. Accuracy stands in
    the ``f1`` column of its line.
    """
    per_class = _per_class(df, label, prediction)
    levels = per_class.rollup("class").agg(
        F.grouping("class").alias("_all"), F.sum("tp").alias("_tp"),
        F.sum("support").alias("support"),
        *[F.avg(s).alias(s) for s in SCORES],
        *[F.sum(F.col(s) * F.col("support")).alias(f"_w_{s}") for s in SCORES],
    )
    empty = F.lit(None).cast("double")

    def line(name: Column, values: Sequence[Column]) -> Column:
        return F.struct(name.alias("item"), *[
            v.alias(s) for s, v in zip(SCORES, values)
        ], F.col("support").alias("support"))

    own = line(F.col("class").cast("string"), [F.col(s) for s in SCORES])
    summary = [
        line(F.lit("accuracy"), [empty, empty, _ratio(F.col("_tp"), F.col("support"))]),
        line(F.lit("macro avg"), [F.col(s) for s in SCORES]),
        line(F.lit("weighted avg"), [_ratio(F.col(f"_w_{s}"), F.col("support")) for s in SCORES]),
    ]
    return levels.select(
        F.inline(F.when(F.col("_all") == 1, F.array(*summary)).otherwise(F.array(own)))
    ).filter(F.col("support").isNotNull())


def macro_f1(df: DataFrame, *, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: the unweighted mean of the per-class F1."""
    return _per_class(df, label, prediction).agg(F.avg("f1").alias("macro_f1"))


def overfit_gap(
    rows: DataFrame, *, split: str = "split", label: str = "label",
    prediction: str = "prediction", digits: int = 3,
) -> DataFrame:
    """Macro F1 on ``train`` and ``test`` rows and their difference, rounded.

    Both splits are evaluated in one pass over the predictions.
    """
    sides = {}
    for name in ("train", "test"):
        chosen = F.col(split) == name
        sides[name] = (F.when(chosen, F.col(label)), F.when(chosen, F.col(prediction)))
    pairs = rows.groupBy(
        split, F.col(label).cast("int").alias("_a"), F.col(prediction).cast("int").alias("_p")
    ).agg(F.count("*").alias("_n"))
    hit = F.when(F.col("_a") == F.col("_p"), F.col("_n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    both = F.array(
        F.struct(F.col("_a").alias("class"), hit.alias("tp"), F.col("_n").alias("size")),
        F.struct(F.col("_p").alias("class"), none.alias("tp"), F.col("_n").alias("size")),
    )
    f1 = pairs.select(split, F.inline(both)).groupBy(split, "class").agg(
        _ratio(2 * F.sum("tp"), F.sum("size")).alias("f1")
    )
    scores = f1.agg(*[
        F.avg(F.when(F.col(split) == name, F.col("f1"))).alias(name) for name in sides
    ])
    return scores.select(
        F.round("train", digits).alias("f1_train"), F.round("test", digits).alias("f1_test"),
        F.round(F.col("train") - F.col("test"), digits).alias("gap"),
    )
