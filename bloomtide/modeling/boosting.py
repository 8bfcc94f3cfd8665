"""Boosted trees of second order: logistic loss for two classes, softmax for more.

A round grows one tree for each class from gradients and Hessians at the margins so far;
a split's gain is G^2 / (H + penalty) of both sides less that of the node, a leaf's value
-rate * G / (H + penalty). Any number of boosters (folds, targets, parameters) go through
their rounds together, so a round costs the same few jobs for all.

A booster with no more rows than ``bound`` is run in one task: its rows, which would meet
there for each tree, meet once and stay for all rounds. Larger ones go through their rounds
in lock step. Trees and margins are the same either way.

Margins travel with the rows. Trees of the last rounds are applied on the fly; after
``every`` rounds the rows are written with their new margins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bloomtide.modeling.growth import (
    BLOCK, NODE_FIELDS, NODES, Gradient, Grown, Rows, Unit, batch_of, grow, grow_all, nodes_of, together, unpacked,
)
from bloomtide.modeling.tree_model import Tree, leaf_values, link
from bloomtide.session import Stored

BLOCK_FIELDS = [f.split(" ")[0] for f in BLOCK.split(", ")]
COUNTS = "part int, y int, predicted int, n long"


@dataclass(frozen=True)
class Booster:
    """One boosted model: the blocks of ``source`` with margins of its own."""

    number: int
    source: int
    n_classes: int
    rate: float
    max_depth: int
    penalty: float = 1.0
    least_weight: float = 1.0

    @property
    def channels(self) -> int:
        return 1 if self.n_classes == 2 else self.n_classes

    def units(self, numbers: Iterator[int]) -> list[Unit]:
        criterion = Gradient(self.penalty, self.least_weight)
        return [Unit(next(numbers), self.number, criterion, self.max_depth, channel=c) for c in range(self.channels)]


def gradient_stats(unit: Unit, rows: Rows) -> np.ndarray:
    """Rows, gradients and Hessians of the unit's class, in whole units of 2**-20."""
    p = link(rows.margins)
    two = rows.margins.shape[1] == 1
    c = 1 if two else unit.channel
    p = p[:, c]
    use = rows.train & (rows.y >= 0)
    g = p - (rows.y == c)
    h = p * (1 - p) * (1 if two else 2)
    stats = np.stack([np.ones(len(p)), np.rint(g * Gradient.UNIT), np.maximum(np.rint(h * Gradient.UNIT), 1)], axis=1)
    return np.where(use[:, None], stats, 0).astype(np.int64)


def with_margins(blocks: DataFrame, boosters: Sequence[Booster]) -> DataFrame:
    """The blocks of each booster, margins at zero."""
    by_source: dict[int, list[Booster]] = {}
    for b in boosters:
        by_source.setdefault(b.source, []).append(b)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                for b in by_source.get(block["part"], ()):
                    margins = np.zeros((block["n"], b.channels)).tobytes()
                    yield batch_of([tuple((block | {"part": b.number, "margins": margins}).values())], BLOCK_FIELDS, BLOCK)

    return blocks.mapInArrow(part, BLOCK)


Round = dict[int, list[Tree]]  # booster -> a tree for each class


def advanced(blocks: DataFrame, rounds: Sequence[Round]) -> DataFrame:
    """The blocks with the trees of these rounds added to their margins."""
    if not rounds:
        return blocks
    rounds = list(rounds)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                rows = unpacked(block)
                margins = rows.margins.copy()
                for trees in rounds:
                    for c, tree in enumerate(trees[block["part"]]):
                        margins[:, c] += tree.value[tree.leaf(rows.bins), 0]
                yield batch_of([tuple((block | {"margins": margins.tobytes()}).values())], BLOCK_FIELDS, BLOCK)

    return blocks.mapInArrow(part, BLOCK)


def trees_of(nodes: pa.Table, units: Sequence[Unit], boosters: dict[int, Booster]) -> Round:
    """The trees of one round, thresholds in bins."""
    number, node = nodes["unit"].to_numpy(), nodes["node"].to_numpy()
    order = np.lexsort([node, number])
    number, node = number[order], node[order]
    feature, bin_ = nodes["feature"].to_numpy()[order], nodes["bin"].to_numpy()[order]
    sums = nodes["sums"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)[order]
    out: Round = {}
    for u in units:
        a, b = np.searchsorted(number, [u.number, u.number + 1])
        own = boosters[u.part]
        if a == b:  # no training rows
            tree = Tree(np.ones(1, np.int64), np.full(1, -1), np.full(1, -1), np.zeros((1, 1)))
        else:
            tree = Tree(node[a:b], feature[a:b], bin_[a:b], leaf_values(sums[a:b], own.rate, own.penalty))
        out.setdefault(u.part, []).append(tree)
    return out


Units = dict[int, list[Unit]]  # booster -> its trees of a round
AT_ROUND = "round int, " + BLOCK


def rounds_of(booster: Booster, units: Sequence[Unit], rows: Rows, rounds: int) -> Iterator[tuple[list[Grown], Rows]]:
    """The trees of each round of a booster whose rows are all here, and the rows with their new margins."""
    rows = replace(rows, margins=np.zeros((len(rows.ids), booster.channels)))
    learn = np.flatnonzero(rows.train)
    bins = rows.bins[learn]
    for _ in range(rounds):
        own = rows.take(learn)
        grown = [grow(bins, gradient_stats(u, own), u)[0] for u in units]
        margins = rows.margins.copy()
        for c, found in enumerate(grown):
            if not found.node:  # no training rows
                continue
            node, feature, bin_, _, sums = found.columns()
            order = np.argsort(node)
            tree = Tree(node[order], feature[order], bin_[order], leaf_values(sums[order], booster.rate, booster.penalty))
            margins[:, c] += tree.value[tree.leaf(rows.bins), 0]
        rows = replace(rows, margins=margins)
        yield grown, rows


def each_whole(blocks: DataFrame, boosters: Sequence[Booster], work: Callable[[Booster, Rows], pa.Table], schema: str) -> DataFrame:
    """Bring all rows of each booster together and call ``work`` on them."""
    by_source: dict[int, list[int]] = {}
    for b in boosters:
        by_source.setdefault(b.source, []).append(b.number)
    by_number = {b.number: b for b in boosters}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                for number in by_source.get(block["part"], ()):
                    yield batch_of([(number, *block.values())], ["booster", *BLOCK_FIELDS], "booster int, " + BLOCK)

    def done(table: pa.Table) -> pa.Table:
        booster = by_number[table["booster"][0].as_py()]
        return work(booster, together([unpacked(b) for b in table.drop_columns(["booster"]).to_pylist()]))

    dealt = blocks.mapInArrow(deal, "booster int, " + BLOCK).repartition(len(boosters), "booster")
    return dealt.groupBy("booster").applyInArrow(done, schema)


def rows_at(blocks: DataFrame, boosters: Sequence[Booster], units: Units, stops: Sequence[int]) -> DataFrame:
    """``AT_ROUND``: the rows of each booster with the margins of each of ``stops`` rounds."""
    def work(booster: Booster, rows: Rows) -> pa.Table:
        out = [(r, *now.packed(booster.number)) for r, (_, now) in enumerate(
            rounds_of(booster, units[booster.number], rows, max(stops)), 1) if r in stops]
        return pa.Table.from_batches([batch_of(out, ["round", *BLOCK_FIELDS], AT_ROUND)])

    return each_whole(blocks, boosters, work, AT_ROUND)


def nodes_whole(blocks: DataFrame, boosters: Sequence[Booster], units: Units, rounds: int, trees: int) -> DataFrame:
    """``NODES`` of all rounds, ``unit`` being round * trees a round + tree."""
    def work(booster: Booster, rows: Rows) -> pa.Table:
        parts = [batch_of([], NODE_FIELDS, NODES)]
        for r, (grown, _) in enumerate(rounds_of(booster, units[booster.number], rows, rounds)):
            parts += [nodes_of(r * trees + unit.number, found)
                      for unit, found in zip(units[booster.number], grown, strict=True) if found.node]
        return pa.Table.from_batches(parts)

    return each_whole(blocks, boosters, work, NODES)


def boost(blocks: DataFrame, boosters: Sequence[Booster], sizes: dict[int, int], rounds: int, bound: int, every: int = 5,
          after: dict[int, Callable[[DataFrame], None]] | None = None, keep: bool = False) -> list[pa.Table]:
    """Run all rounds; ``after[r]`` gets the rows with the margins of ``r`` rounds.

    ``sizes``: training rows of each source. With ``keep`` the node table of every round
    is returned, its ``unit`` being round * trees a round + tree.
    """
    after = after or {}
    numbers = iter(range(1 << 30))
    units = {b.number: b.units(numbers) for b in boosters}
    trees = sum(len(u) for u in units.values())
    rows_of = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # folds by targets
    small = [b for b in boosters if rows_of.get(b.source, 0) <= bound]
    large = [b for b in boosters if rows_of.get(b.source, 0) > bound]
    stored = Stored(blocks.sparkSession, "rounds")
    kept = []
    try:
        stops = sorted(r for r in after if r <= rounds)
        if small and keep:
            empty = batch_of([], NODE_FIELDS, NODES).schema
            kept.append(nodes_whole(blocks, small, units, rounds, trees).toArrow().cast(empty))
        if small and stops:
            found = stored.write(rows_at(blocks, small, units, stops))
            at = {r: found.filter(F.col("round") == r).drop("round") for r in stops}
        else:
            at = {}
        if large:
            joint = {r: lambda rows, r=r: after[r](rows.unionByName(at[r]) if r in at else rows) for r in stops}
            kept += lock_step(blocks, large, units, sizes, rounds, bound, every, joint, keep, trees)
        else:
            for r in stops:
                after[r](at[r])
    finally:
        stored.drop()
    return kept


def lock_step(blocks: DataFrame, boosters: Sequence[Booster], units_of: Units, sizes: dict[int, int], rounds: int, bound: int,
              every: int, after: dict[int, Callable[[DataFrame], None]], keep: bool, trees: int) -> list[pa.Table]:
    """``boost`` for boosters whose rows do not meet in a task: a round costs the same few jobs for all."""
    by_number = {b.number: b for b in boosters}
    units = [u for b in boosters for u in units_of[b.number]]
    own_sizes = {b.number: sizes.get(b.source, 0) for b in boosters}
    stored = Stored(blocks.sparkSession, "margins")
    tasks = blocks.sparkSession.sparkContext.defaultParallelism

    def write(df: DataFrame) -> DataFrame:
        """Few bytes are much work here, so they are spread whatever their size."""
        return stored.write(df.repartition(tasks))

    pending: list[Round] = []
    rows = write(with_margins(blocks, boosters))
    kept = []
    try:
        for r in range(1, rounds + 1):
            nodes = grow_all(advanced(rows, pending), units, own_sizes, gradient_stats, bound)
            pending.append(trees_of(nodes, units, by_number))
            if keep:
                number = pa.compute.add(nodes["unit"], pa.scalar((r - 1) * trees, pa.int32()))
                kept.append(nodes.set_column(0, "unit", number))
            if len(pending) == every or r in after:
                rows, pending = write(advanced(rows, pending)), []
            if r in after:
                after[r](rows)
    finally:
        stored.drop()
    return kept


def prediction_counts(rows: DataFrame, train: bool = False) -> DataFrame:
    """``COUNTS``: watched (or training) rows of each booster by class and predicted class."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block in batch.to_pylist():
                own = unpacked(block)
                use = (own.train == train) & (own.y >= 0)
                pairs, n = np.unique(np.stack([own.y[use], link(own.margins[use]).argmax(axis=1)]), axis=1, return_counts=True)
                out += [(block["part"], int(y), int(p), int(k)) for y, p, k in zip(*pairs, n)]
            yield batch_of(out, ["part", "y", "predicted", "n"], COUNTS)

    return rows.mapInArrow(part, COUNTS).groupBy("part", "y", "predicted").agg(F.sum("n").alias("n"))


def log_loss(rows: DataFrame) -> dict[int, float]:
    """Mean loss of the training rows of each booster."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block in batch.to_pylist():
                own = unpacked(block)
                use = own.train & (own.y >= 0)
                p = link(own.margins[use])[np.arange(int(use.sum())), own.y[use]]
                out.append((block["part"], float(-np.log(np.maximum(p, 1e-300)).sum()), int(use.sum())))
            yield batch_of(out, ["part", "loss", "n"], "part int, loss double, n long")

    sums = rows.mapInArrow(part, "part int, loss double, n long").groupBy("part").agg((F.sum("loss") / F.sum("n")).alias("loss"))
    return {r["part"]: r["loss"] for r in sums.collect()}
