"""Trees and forests: fitting one, and scoring many sizes and depths from the same trees.

A tree cut at depth d is the tree grown to depth d, and the first n trees of a forest are
the forest of n trees: splits are chosen level by level, and random choices depend on the
tree and the node only. So one forest of the largest size and depth answers for all its
prefixes; watched rows note the sums they meet at every asked depth on their way down.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bloomtide.modeling.growth import (
    DEEPEST, Gini, Rows, Unit, Upper, class_stats, finish, grow, routed, unpacked, upper_levels,
)
from bloomtide.modeling.tree_model import leaf_shares

#: Class shares are added as whole numbers of this part, so that their order does not matter.
SHARE_UNIT = 1 << 30
VOTES = "run int, depth int, after int, place long, y int, votes array<long>"


@dataclass(frozen=True)
class Run:
    """Forests that share their trees: all ``depths`` and all ``sizes`` of one part and ``min_leaf``."""

    number: int
    part: int
    weights: tuple[float, ...]
    sizes: tuple[int, ...]       # ascending
    depths: tuple[int, ...]
    min_leaf: int = 1
    sampled: bool = True         # bootstrap and a random choice of features

    def units(self, first: int, n_features: int, seed: int) -> list[Unit]:
        some = max(1, math.isqrt(n_features)) if self.sampled else None
        return [Unit(first + t, self.part, Gini(self.weights), max(self.depths), self.min_leaf, some, seed, t,
                     self.sampled, limits=tuple(sorted(self.depths))) for t in range(self.sizes[-1])]


def depth_of(given: int | None) -> int:
    return DEEPEST if given is None else int(given)


def votes(blocks: DataFrame, runs: Sequence[Run], sizes: dict[int, int], n_features: int, bound: int, seed: int) -> DataFrame:
    """``VOTES``: class shares of each watched row, summed over the trees between two sizes.

    ``after`` is the number of sizes that the trees lie beyond.
    """
    units, run_of = [], {}
    for run in runs:
        own = run.units(len(units), n_features, seed)
        units += own
        run_of |= {u.number: run for u in own}
    upper, open_ = upper_levels(blocks, units, sizes, class_stats, bound)

    def work(grown: Sequence[tuple[Unit, int, np.ndarray]], rows: Rows) -> pa.Table:
        watched = ~rows.train & (rows.y >= 0)
        at = np.flatnonzero(watched)
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for unit, node, stats in grown:
            run = run_of[unit.number]
            _, answers = grow(rows.bins, stats, unit, node, keep=False)
            top = node.bit_length() - 1
            after = sum(unit.tree >= s for s in run.sizes)
            for d in unit.limits:
                met = answers[d][at]
                if d < top:  # the answer lies above the node
                    above = upper[unit.number][node >> (top - d)][3]
                    met = np.broadcast_to(np.array(above), met.shape)
                share = np.rint(leaf_shares(met, run.weights) * SHARE_UNIT).astype(np.int64)
                key = (run.number, d, after)
                sums[key] = sums[key] + share if key in sums else share
        return vote_table(sums, rows.places[at], rows.y[at])

    below = finish(blocks, units, upper, open_, class_stats, work, VOTES)
    ends = {u: [n for n, v in tree.items() if v[0] < 0] for u, tree in upper.items()}
    if not any(ends.values()):
        return below
    return below.unionByName(votes_above(blocks, units, run_of, upper, ends))


def vote_table(sums: dict[tuple[int, int, int], np.ndarray], places: np.ndarray, y: np.ndarray) -> pa.Table:
    """Shares of the same rows for several (run, depth, after) as a table of ``VOTES``."""
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
    columns: list[list] = [[] for _ in types]
    n = len(places)
    for key, total in sums.items():
        ends = np.arange(n + 1, dtype=np.int32) * total.shape[1]
        for column, value in zip(columns, (*(np.full(n, k, np.int32) for k in key), places, y.astype(np.int32))):
            column.append(pa.array(value))
        columns[5].append(pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel())))
    return pa.table([pa.chunked_array(c, t) for c, t in zip(columns, types)], ["run", "depth", "after", "place", "y", "votes"])


def votes_above(blocks: DataFrame, units: Sequence[Unit], run_of: dict[int, Run], upper: Upper, ends: dict[int, list[int]]) -> DataFrame:
    """``VOTES`` of watched rows that come to rest in a node above the bound, where they lie."""
    by_part: dict[int, list[Unit]] = {}
    for u in units:
        if ends.get(u.number):
            by_part.setdefault(u.part, []).append(u)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                rows = unpacked(block) if block["part"] in by_part else None
                for unit in by_part.get(block["part"], ()):
                    run, tree = run_of[unit.number], upper[unit.number]
                    node = routed(tree, rows.bins)
                    at = np.flatnonzero(np.isin(node, ends[unit.number]) & ~rows.train & (rows.y >= 0))
                    if not len(at):
                        continue
                    after, sums = sum(unit.tree >= s for s in run.sizes), {}
                    for d in unit.limits:
                        met = np.array([tree[n >> max(n.bit_length() - 1 - d, 0)][3] for n in node[at].tolist()])
                        sums[(run.number, d, after)] = np.rint(leaf_shares(met, run.weights) * SHARE_UNIT).astype(np.int64)
                    yield from vote_table(sums, rows.places[at], rows.y[at]).to_batches()

    return blocks.mapInArrow(part, VOTES)


def vote_counts(votes: DataFrame, sizes: int, classes: int) -> DataFrame:
    """Rows of each (run, depth, size) by class and predicted class; ``size`` is the position among the sizes."""
    sums = [F.sum(F.when(F.col("after") <= s, F.coalesce(F.get("votes", F.lit(c)), F.lit(0)))).alias(f"v{s}_{c}")
            for s in range(sizes) for c in range(classes)]
    by_row = votes.groupBy("run", "depth", "place").agg(F.first("y").alias("y"), *sums)
    each = by_row.select("run", "depth", "y", F.posexplode(F.array(*[
        F.array(*[F.col(f"v{s}_{c}") for c in range(classes)]) for s in range(sizes)])).alias("size", "v"))
    predicted = (F.array_position("v", F.array_max("v")) - 1).cast("int")
    return each.groupBy("run", "depth", "size", "y", predicted.alias("predicted")).agg(F.count("*").alias("n"))
