"""Fitted trees as a table of nodes, and what follows from it: scores, importances, SQL.

A model is its node table (tree, node, feature, threshold, gain, sums), the class
weights, and how trees are put together: *votes* (mean of the class shares in the leaves)
or *margins* (sums of leaf values, through sigmoid or softmax). It needs no ML runtime.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from bloomtide.modeling.growth import ROOT, Gradient
from bloomtide.operators.topk import sorted_importance

TABLE = "tree int, node long, feature string, threshold double, gain double, sums array<long>"


@dataclass(frozen=True)
class Tree:
    """Nodes in the order of their numbers; children of a split follow one another."""

    node: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray  # values up to it go left; bins while fitting
    value: np.ndarray      # a line for each node

    @cached_property
    def child(self) -> np.ndarray:
        return np.where(self.feature >= 0, np.searchsorted(self.node, self.node * 2), np.arange(len(self.node)))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Index of the leaf of each row; a NaN goes right."""
        at = np.zeros(len(x), np.int64)
        active = np.arange(len(x))
        while len(active):
            here = at[active]
            feature = self.feature[here]
            inner = feature >= 0
            active, here, feature = active[inner], here[inner], feature[inner]
            at[active] = self.child[here] + ~(x[active, feature] <= self.threshold[here])
        return at


def leaf_shares(sums: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    """Shares of the classes by weight, to 12 digits: balanced classes often tie, and then the first one counts."""
    w = sums * np.array(weights)
    total = w.sum(axis=1, keepdims=True)
    return np.round(np.divide(w, total, out=np.full(w.shape, 1.0 / w.shape[1]), where=total > 0), 12)


def leaf_values(sums: np.ndarray, rate: float, penalty: float) -> np.ndarray:
    return (-rate * (sums[:, 1] / Gradient.UNIT) / (sums[:, 2] / Gradient.UNIT + penalty))[:, None]


def link(margins: np.ndarray) -> np.ndarray:
    """Class probabilities: sigmoid of one margin, softmax of several."""
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins))
        return np.hstack([1 - p, p])
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class TreeModel:
    """``nodes`` has ``tree, node, feature (position), threshold, gain, sums``; boosted trees of class c have tree % channels = c."""

    kind: str                    # votes or margins
    features: tuple[str, ...]
    n_classes: int
    nodes: pa.Table
    weights: tuple[float, ...] = ()
    rate: float = 1.0
    penalty: float = 1.0

    @cached_property
    def trees(self) -> list[Tree]:
        t = self.nodes
        tree, node = t["tree"].to_numpy(), t["node"].to_numpy()
        order = np.lexsort([node, tree])
        feature, threshold = t["feature"].to_numpy()[order], t["threshold"].to_numpy()[order]
        sums = t["sums"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)[order]
        value = leaf_shares(sums, self.weights) if self.kind == "votes" else leaf_values(sums, self.rate, self.penalty)
        cuts = np.flatnonzero(np.diff(tree[order])) + 1
        return [Tree(*parts) for parts in zip(*(np.split(a, cuts) for a in (node[order], feature, threshold, value)))]

    @property
    def channels(self) -> int:
        return 1 if self.n_classes == 2 else self.n_classes

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "votes":
            return sum(t.value[t.leaf(x)] for t in self.trees) / max(len(self.trees), 1)
        margins = np.zeros((len(x), self.channels))
        for i, t in enumerate(self.trees):
            margins[:, i % self.channels] += t.value[t.leaf(x), 0]
        return link(margins)

    def prefix(self, trees: int) -> "TreeModel":
        """The model of the first trees (or rounds) alone."""
        keep = pa.compute.less(self.nodes["tree"], trees * (self.channels if self.kind == "margins" else 1))
        return replace(self, nodes=self.nodes.filter(keep))

    def cut(self, depth: int) -> "TreeModel":
        """The same trees grown to ``depth`` only: splits below are left out."""
        from_depth = 1 << (depth + 1)
        t = self.nodes.filter(pa.compute.less(self.nodes["node"], from_depth))
        last = t["node"].to_numpy() >= 1 << depth
        for name, empty in (("feature", -1), ("threshold", np.nan), ("gain", 0.0)):
            values = np.where(last, empty, t[name].to_numpy())
            t = t.set_column(t.schema.get_field_index(name), name, pa.array(values.astype(t[name].to_numpy().dtype)))
        return replace(self, nodes=t)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` (array of the classes) and ``prediction`` (first of the likeliest classes)."""
        names = [f"_model_x{j}" for j in range(len(self.features))]
        columns = [c for c in df.columns if c not in ("probability", "prediction")]
        wide = df.select(*columns, *[F.col(f).cast("double").alias(n) for n, f in zip(names, self.features)])
        schema = StructType([*df.select(*columns).schema.fields, StructField("probability", ArrayType(DoubleType())),
                             StructField("prediction", DoubleType())])
        model = self

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1).astype(np.float64)
                p = model.probabilities(x)
                ends = np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c) for c in columns], pa.ListArray.from_arrays(pa.array(ends), pa.array(p.ravel())),
                    pa.array(np.round(p, 9).argmax(axis=1).astype(np.float64))], schema.names)

        return wide.mapInArrow(part, schema)

    def table(self, spark: SparkSession) -> DataFrame:
        """The nodes with feature names, as a DataFrame of ``TABLE``."""
        t = self.nodes
        names = pa.array([self.features[i] if i >= 0 else None for i in t["feature"].to_pylist()], pa.string())
        threshold = pa.compute.if_else(pa.compute.greater_equal(t["feature"], 0), t["threshold"], pa.scalar(None, pa.float64()))
        t = t.set_column(2, "feature", names).set_column(3, "threshold", threshold)
        named = t.select([c.split(" ")[0] for c in TABLE.split(", ")]).combine_chunks()
        return spark.createDataFrame(named, TABLE) if t.num_rows else spark.createDataFrame([], TABLE)


def from_table(rows: pa.Table, kind: str, features: Sequence[str], n_classes: int, **options) -> TreeModel:
    """A model of the node table that ``TreeModel.table`` gives."""
    place = {f: i for i, f in enumerate(features)}
    feature = pa.array([-1 if f is None else place[f] for f in rows["feature"].to_pylist()], pa.int32())
    threshold = rows["threshold"].cast(pa.float64()).fill_null(float("nan"))
    nodes = rows.set_column(2, "feature", feature).set_column(3, "threshold", threshold)
    return TreeModel(kind, tuple(features), n_classes, nodes, **options)


def tree_expression(tree: Tree, features: Sequence[str], column: int) -> Column:
    """One column of a tree's leaf values as nested conditions: for small trees, in generated code."""
    place = {int(n): i for i, n in enumerate(tree.node)}

    def at(node: int) -> Column:
        i = place[node]
        if tree.feature[i] < 0:
            return F.lit(float(tree.value[i, column]))
        left = F.col(features[tree.feature[i]]) <= F.lit(float(tree.threshold[i]))
        return F.when(left, at(2 * node)).otherwise(at(2 * node + 1))

    return at(ROOT)


def probability_expressions(model: TreeModel) -> list[Column]:
    """The probability of each class as a column expression, without Python workers."""
    if model.kind == "votes":
        n = len(model.trees)
        return [sum((tree_expression(t, model.features, c) for t in model.trees), F.lit(0.0)) / n for c in range(model.n_classes)]
    k = model.channels
    margins = [sum((tree_expression(t, model.features, 0) for t in model.trees[c::k]), F.lit(0.0)) for c in range(k)]
    if k == 1:
        p = 1 / (1 + F.exp(-margins[0]))
        return [1 - p, p]
    total = sum((F.exp(m) for m in margins), F.lit(0.0))
    return [F.exp(m) / total for m in margins]


def permutation_importance(model: TreeModel, df: DataFrame, *, label: str = "label", seed: int = 0) -> DataFrame:
    """Macro F1 lost when a feature's values are shuffled, in ascending order.

    One pass: the rows of each batch are scored as they are and once for each feature with
    its values dealt out anew among them by a seeded hash. Only counts by (feature, class,
    predicted class) leave the tasks.
    """
    from bloomtide.modeling.growth import hashed

    names = [f"_x{j}" for j in range(len(model.features))]
    wide = df.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("_y"), *[F.col(f).cast("double").alias(n) for n, f in zip(names, model.features)])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1).astype(np.float64)
            y = batch.column("_y").to_numpy()
            for j in range(-1, len(names)):
                mixed = x.copy()
                if j >= 0:
                    mixed[:, j] = x[np.argsort(hashed(seed, j, np.arange(len(x))), kind="stable"), j]
                predicted = np.round(model.probabilities(mixed), 9).argmax(axis=1)
                pairs, n = np.unique(np.stack([y, predicted]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), j, np.int32)), pa.array(pairs[0].astype(np.int32)), pa.array(pairs[1].astype(np.int32)),
                     pa.array(n.astype(np.int64))], ["j", "y", "p", "n"])

    counts = wide.mapInArrow(part, "j int, y int, p int, n long").groupBy("j", "y", "p").agg(F.sum("n").alias("n"))
    sides = F.array(
        F.struct(F.col("y").alias("c"), F.when(F.col("y") == F.col("p"), 2 * F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("met")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("hit"), F.col("n").alias("met")))
    f1 = counts.select("j", F.inline(sides)).groupBy("j", "c").agg((F.sum("hit") / F.sum("met")).alias("f")).groupBy("j").agg(F.avg("f").alias("f"))
    plain = f1.filter("j < 0").select(F.col("f").alias("whole"))
    named = F.element_at(F.array(*[F.lit(f) for f in model.features]), F.col("j") + 1).alias("feature")
    lost = f1.filter("j >= 0").join(plain, F.lit(True)).select(named, (F.col("whole") - F.col("f")).alias("importance"))
    return sorted_importance(lost)


def importance(table: DataFrame, features: Sequence[str], kind: str) -> DataFrame:
    """Importance of each feature from a node table, in ascending order; they add up to 1.

    ``votes``: gains of a feature over those of its tree, averaged over trees that split.
    ``margins``: the mean gain of a feature's splits, over the sum of these means.
    """
    splits = table.filter(F.col("feature").isNotNull())
    if kind == "votes":
        by_tree = splits.groupBy("tree", "feature").agg(F.sum("gain").alias("g"))
        whole = splits.groupBy("tree").agg(F.sum("gain").alias("t"))
        trees = whole.agg(F.count("*").alias("n"))
        parts = by_tree.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("t")).alias("s"))
    else:
        parts = splits.groupBy("feature").agg(F.avg("gain").alias("s"))
        trees = parts.agg(F.sum("s").alias("n"))
    (n,) = trees.first()
    names = table.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    found = names.join(parts, "feature", "left").select(
        "feature", F.coalesce(F.col("s") / F.lit(float(n or 1)), F.lit(0.0)).alias("importance"))
    return sorted_importance(found)
