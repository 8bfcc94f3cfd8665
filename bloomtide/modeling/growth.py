"""Many trees grown at once, in lock step, from binned rows.

Rows are packed in *blocks*: one table row holds some thousand training rows as byte
matrices. All trees of a search, a forest or a boosting round share the same jobs:

1. *Upper levels.* While a node has more rows than ``bound``, its cells (tree, node,
   feature, bin) are summed up in the tasks and then in Spark, and the best split of a
   node follows from the sums of its own cells. One job a level, however many trees.
2. *Subtrees.* Rows of a node within the bound are brought together, and its subtree is
   grown to the end in that task. What meets in a task is bounded by ``bound`` rows.

All sums are of integers, hence the same in any order, and both steps use the same split
search, so where a tree passes from one to the other does not change it. Random choices
are hashes of seed, tree, node, row and feature.

Nodes are numbered as in a heap: the children of ``i`` are ``2 * i`` (values up to the
threshold) and ``2 * i + 1``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ROOT = 1
BINS = 32
#: Deepest node number that fits 62 bits.
DEEPEST = 60
GAIN_DIGITS = 9
BLOCK = "part int, n int, bins binary, ids binary, places binary, y binary, train binary, margins binary"
NODES = "unit int, node long, feature int, bin int, gain double, sums array<long>"
NODE_FIELDS = ["unit", "node", "feature", "bin", "gain", "sums"]


# --- binning -------------------------------------------------------------------

def bin_edges(rows: DataFrame, features: Sequence[str], groups: Sequence) -> list[list[np.ndarray]]:
    """For each condition of ``groups`` the upper edges of the bins of each feature.

    Features with few values have a bin for each, others ``BINS`` quantiles; only these
    come to the driver. The last bin is open; nulls and NaN fall into it.
    """
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    # a row for each group and feature: a column for each would be hundreds of aggregates, of whose sketches
    # each has 410 columns, in every copy of the plan on the driver
    member = F.filter(F.array(*[F.when(g, F.lit(i)) for i, g in enumerate(groups)]), lambda i: i.isNotNull())
    values = F.array(*[F.struct(F.lit(j).alias("j"), F.nanvl(F.col(f).cast("double"), F.lit(None)).alias("v")) for j, f in enumerate(features)])
    cells = rows.select(F.explode(member).alias("i"), values.alias("values")).select("i", F.inline("values")).filter(F.col("v").isNotNull())
    found = cells.groupBy("i", "j").agg(F.percentile_approx("v", shares, 10_000).alias("q"), F.approx_count_distinct("v", 0.02).alias("n"))
    edges, few = {}, []
    for r in found.collect():  # groups by features
        edges[r["i"], r["j"]] = r["q"]
        if r["n"] <= 0.8 * BINS:  # a count that is somewhat off stays below BINS
            few.append(r["i"] * len(features) + r["j"])
    if few:
        whole = cells.filter((F.col("i") * len(features) + F.col("j")).isin(few)).groupBy("i", "j").agg(F.collect_set("v").alias("q"))
        edges |= {(r["i"], r["j"]): r["q"] for r in whole.collect()}
    return [[np.unique(np.array(edges.get((i, j), []), np.float64))[:BINS - 1] for j in range(len(features))]
            for i in range(len(groups))]


def binned(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Rows by features: the number of edges below each value."""
    out = np.empty(values.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, values[:, j], side="left")
        out[np.isnan(values[:, j]), j] = len(e)
    return out


@dataclass
class Rows:
    """The rows of one block, or of several put together."""

    bins: np.ndarray      # rows by features, 8 bits
    ids: np.ndarray       # a hash of what the row holds: equal rows are drawn alike, wherever they lie
    places: np.ndarray    # a number for each row of the table
    y: np.ndarray         # class, -1 without one
    train: np.ndarray     # False: only watched
    margins: np.ndarray   # rows by classes, or rows by 0

    def take(self, at: np.ndarray) -> "Rows":
        return Rows(*(getattr(self, f)[at] for f in self.__dataclass_fields__))

    def packed(self, part: int) -> tuple:
        return (part, len(self.ids), *(np.ascontiguousarray(getattr(self, f)).tobytes() for f in self.__dataclass_fields__))


def unpacked(block: dict) -> Rows:
    n = block["n"]
    margins = np.frombuffer(block["margins"] or b"", np.float64)
    return Rows(
        np.frombuffer(block["bins"], np.uint8).reshape(n, -1), np.frombuffer(block["ids"], np.int64),
        np.frombuffer(block["places"], np.int64), np.frombuffer(block["y"], np.int8), np.frombuffer(block["train"], np.bool_), margins.reshape(n, -1))


def together(blocks: Sequence[Rows]) -> Rows:
    """Ordered by id, so that the order of arrival does not matter."""
    all_ = Rows(*(np.concatenate([getattr(b, f) for b in blocks]) for f in Rows.__dataclass_fields__))
    return all_.take(np.argsort(all_.ids, kind="stable"))


def batch_of(tuples: Sequence[tuple], names: Sequence[str], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[f.split(" ")[1]] for f in schema.split(", ")]
    columns = list(zip(*tuples)) if tuples else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], list(names))


def pack_rows(rows: DataFrame, features: Sequence[str], labels: Sequence[str], edges: Sequence[Sequence[np.ndarray]],
              ranges: Sequence[tuple], date: str | None, block: int = 4096) -> DataFrame:
    """Blocks of every part; part ``g * len(labels) + k`` has group ``g`` and label ``k``.

    A group is (first, last) of its watched dates: rows before ``first`` train, rows up to
    ``last`` are watched; (None, None): all rows train. ``rows`` is stored, as its rows
    are named by their places.
    """
    # the hash comes last: Spark keeps what a column equals as a constraint and writes it anew for each
    # renamed column behind it, so in front of n features it would be 2**n constraints on the driver
    named = rows.select(
        F.monotonically_increasing_id().alias("_place"), (F.unix_date(date) if date else F.lit(0)).cast("int").alias("_day"),
        *[F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(f"_y{k}") for k, c in enumerate(labels)],
        *[F.col(f).cast("double").alias(f"_x{j}") for j, f in enumerate(features)],
        F.xxhash64(*[F.col(c) for c in sorted({*features, *labels, *([date] if date else [])})]).alias("_id"))
    days = [tuple(None if d is None else np.datetime64(d, "D").astype(int) for d in r) for r in ranges]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                batch = whole.slice(start, block)
                get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
                x = np.stack([get(f"_x{j}") for j in range(len(features))], axis=1).astype(np.float64)
                ids, places, day = get("_id"), get("_place"), get("_day")
                for g, (first, last) in enumerate(days):
                    train = np.ones(len(ids), np.bool_) if first is None else day < first
                    use = train if first is None else day <= last
                    if not use.any():
                        continue
                    bins = binned(x[use], edges[g])
                    for k in range(len(labels)):
                        y = get(f"_y{k}")[use].astype(np.int8)
                        packed = Rows(bins, ids[use], places[use], y, train[use], np.empty((int(use.sum()), 0))).packed(g * len(labels) + k)
                        yield batch_of([packed], [f.split(" ")[0] for f in BLOCK.split(", ")], BLOCK)

    return named.mapInArrow(part, BLOCK)


def class_sizes(blocks: DataFrame) -> dict[int, dict[int, int]]:
    """Training rows of each class of each part."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block in batch.to_pylist():
                rows = unpacked(block)
                found, n = np.unique(rows.y[rows.train & (rows.y >= 0)], return_counts=True)
                out += [(block["part"], int(c), int(k)) for c, k in zip(found, n)]
            yield batch_of(out, ["part", "y", "n"], "part int, y int, n long")

    counts: dict[int, dict[int, int]] = defaultdict(dict)
    sums = blocks.mapInArrow(part, "part int, y int, n long")
    for r in sums.groupBy("part", "y").agg(F.sum("n").alias("n")).collect():  # parts by classes
        counts[r["part"]][r["y"]] = r["n"]
    return counts


def balanced(counts: dict[int, int], classes: int) -> tuple[float, ...]:
    """Weight of each class: rows / (number of classes met * rows of the class); 0 for one not met."""
    total, met = sum(counts.values()), len(counts)
    return tuple(total / (met * counts[c]) if counts.get(c) else 0.0 for c in range(classes))


# --- split search --------------------------------------------------------------

@dataclass(frozen=True)
class Gini:
    """Channels are rows of each class; a node's score is sum(w^2) / sum(w) of class weights."""

    weights: tuple[float, ...]

    def score(self, sums: np.ndarray) -> np.ndarray:
        w = sums * np.array(self.weights)
        total = w.sum(axis=1)
        return np.divide((w * w).sum(axis=1), total, out=np.zeros(len(w)), where=total > 0)

    def enough(self, sums: np.ndarray, least: int) -> np.ndarray:
        return sums.sum(axis=1) >= max(least, 1)


@dataclass(frozen=True)
class Gradient:
    """Channels are rows, gradients and Hessians in units of 2**-20; a node's score is G^2 / (H + penalty)."""

    penalty: float = 1.0
    least_weight: float = 1.0
    UNIT = 1 << 20

    def score(self, sums: np.ndarray) -> np.ndarray:
        return (sums[:, 1] / self.UNIT) ** 2 / (sums[:, 2] / self.UNIT + self.penalty)

    def enough(self, sums: np.ndarray, least: int) -> np.ndarray:
        return (sums[:, 0] >= max(least, 1)) & (sums[:, 2] >= self.least_weight * self.UNIT)


@dataclass(frozen=True)
class Unit:
    """One tree to grow from the blocks of ``part``."""

    number: int
    part: int
    criterion: Gini | Gradient
    max_depth: int = DEEPEST
    min_leaf: int = 1
    n_features: int | None = None   # a random choice in each node; None: all
    seed: int = 0
    tree: int = 0
    bootstrap: bool = False
    channel: int = 0                # class of a boosted tree
    limits: tuple[int, ...] = ()    # depths at which watched rows are answered


def hashed(*parts) -> np.ndarray:
    """64 well-mixed bits of integers and arrays of them."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(32))
    return h


def bootstrap_weights(unit: Unit, ids: np.ndarray) -> np.ndarray:
    """How often each row is drawn: Poisson with mean 1, by a hash of seed, tree and row."""
    u = (hashed(unit.seed, unit.tree, ids) >> np.uint64(11)) / float(1 << 53)
    steps, p, total = [], np.exp(-1.0), 0.0
    for k in range(1, 12):
        total += p
        steps.append(total)
        p /= k
    return np.searchsorted(np.array(steps), u, side="right")


def chosen_features(unit: Unit, nodes: np.ndarray, n_features: int) -> np.ndarray:
    """Nodes by features to try, in ascending order."""
    if unit.n_features is None or unit.n_features >= n_features:
        return np.broadcast_to(np.arange(n_features), (len(nodes), n_features))
    h = hashed(unit.seed + 1, unit.tree, nodes[:, None], np.arange(n_features)[None, :])
    return np.sort(np.argpartition(h, unit.n_features - 1, axis=1)[:, :unit.n_features], axis=1)


def class_stats(unit: Unit, rows: Rows) -> np.ndarray:
    """Rows by classes: the weight of a training row in its class; nothing for others."""
    k = len(unit.criterion.weights)
    weight = bootstrap_weights(unit, rows.ids) if unit.bootstrap else np.ones(len(rows.ids), np.int64)
    weight = np.where(rows.train & (rows.y >= 0), weight, 0)
    return (rows.y[:, None] == np.arange(k)) * weight[:, None]


def best_splits(node: np.ndarray, slot: np.ndarray, sums: np.ndarray, totals: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Gain of each node's best split, and its cell; cells are sorted by node, slot, bin.

    Prefix sums over the bins of a feature are the left sides. Equal gains: the first
    feature, then the lowest bin.
    """
    running = np.cumsum(sums, axis=0)
    new = np.append(True, (node[1:] != node[:-1]) | (slot[1:] != slot[:-1]))
    before = np.vstack([np.zeros((1, sums.shape[1]), running.dtype), running[:-1]])[new]
    left = running - before[np.cumsum(new) - 1]
    right = totals[node] - left
    score, enough = unit.criterion.score, unit.criterion.enough
    gain = score(left) + score(right) - score(totals)[node]
    gain = np.where(enough(left, unit.min_leaf) & enough(right, unit.min_leaf), np.round(gain, GAIN_DIGITS), -np.inf)
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    best = np.maximum.reduceat(gain, starts)
    hits = np.flatnonzero(gain == best[node])
    return best, hits[np.searchsorted(node[hits], np.arange(len(totals)))]


@dataclass
class Grown:
    """Nodes of a tree or subtree as columns, in the order of their numbers within each level."""

    node: list = field(default_factory=list)
    feature: list = field(default_factory=list)
    bin: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    sums: list = field(default_factory=list)

    def add(self, node, feature, bin_, gain, sums) -> None:
        for name, value in zip(self.__dataclass_fields__, (node, feature, bin_, gain, sums)):
            getattr(self, name).append(value)

    def columns(self) -> list[np.ndarray]:
        return [np.concatenate(getattr(self, name)) for name in self.__dataclass_fields__]


def cells_of(key: np.ndarray, size: int, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur, ascending, and the sums of the rows' stats over each.

    ``key`` has a line for each tried feature; few possible keys are counted in a dense
    table, many are sorted. Sums are of whole numbers below 2**53, so exact as doubles.
    """
    flat = key.ravel()
    if size <= 4 * flat.size:
        hits = np.bincount(flat, minlength=size)
        cells = np.flatnonzero(hits)
    else:
        cells, flat = np.unique(flat, return_inverse=True)
        size = len(cells)
    sums = [np.bincount(flat, weights=np.broadcast_to(stats[:, c], key.shape).ravel(), minlength=size) for c in range(stats.shape[1])]
    if size != len(cells):
        sums = [s[cells] for s in sums]
    return cells, np.stack(sums, axis=1).astype(np.int64)


def grow(bins: np.ndarray, stats: np.ndarray, unit: Unit, root: int = ROOT, keep: bool = True) -> tuple[Grown, dict[int, np.ndarray]]:
    """The subtree below ``root``, and for each depth limit the sums a row meets there.

    Rows whose ``stats`` are zero follow the splits without having a part in them.
    """
    out = Grown()
    n, n_features = bins.shape
    columns = np.ascontiguousarray(bins.T)
    answers = {d: np.zeros_like(stats) for d in unit.limits}
    rows, depth = np.arange(n), root.bit_length() - 1
    node = np.full(n, root, np.int64)
    own = stats.astype(np.float64)
    while len(rows):
        ids, at = np.unique(node, return_inverse=True)
        totals = np.stack([np.bincount(at, weights=own[:, c], minlength=len(ids)) for c in range(stats.shape[1])], axis=1).astype(np.int64)
        for d in unit.limits:
            if depth <= d:
                answers[d][rows] = totals[at]
        best = np.full(len(ids), -np.inf)
        if depth < min(unit.max_depth, DEEPEST):
            slots = chosen_features(unit, ids, n_features)
            m = slots.shape[1]
            if m == n_features:
                tried = columns[:, rows]
            else:
                tried = columns[slots[at].T, rows[None, :]]
            key = (at * (m * BINS))[None, :] + (np.arange(m) * BINS)[:, None] + tried
            cells, sums = cells_of(key, len(ids) * m * BINS, own)
            owner, slot, bin_of = cells // (m * BINS), cells // BINS % m, cells % BINS
            best, cell = best_splits(owner, slot, sums, totals, unit)
        split = best > 0
        feature = np.full(len(ids), -1)
        bin_ = np.full(len(ids), -1)
        if split.any():
            feature[split] = slots[split, slot[cell[split]]]
            bin_[split] = bin_of[cell[split]]
        if keep:
            out.add(ids, feature, bin_, np.where(split, best, 0.0), totals)
        on = split[at]
        rows, at, own = rows[on], at[on], own[on]
        node = ids[at] * 2 + (columns[feature[at], rows] > bin_[at])
        depth += 1
    return out, answers


# --- upper levels ----------------------------------------------------------------

Stats = Callable[[Unit, Rows], np.ndarray]
Upper = dict[int, dict[int, tuple[int, int, float, list[int]]]]  # unit -> node -> feature, bin, gain, sums


def routed(tree: dict[int, tuple], bins: np.ndarray) -> np.ndarray:
    """The node each row has come to in a part of a tree."""
    node = np.full(len(bins), ROOT, np.int64)
    for parent in sorted(tree):
        feature, bin_ = tree[parent][:2]
        if feature >= 0:
            here = node == parent
            node[here] = 2 * parent + (bins[here, feature] > bin_)
    return node


def upper_levels(blocks: DataFrame, units: Sequence[Unit], sizes: dict[int, int], stats_of: Stats, bound: int) -> tuple[Upper, dict[int, list[int]]]:
    """Nodes with more than ``bound`` rows, level by level, and the open nodes below them.

    ``sizes``: rows of each part. The driver holds the few nodes above the bound.
    """
    upper: Upper = defaultdict(dict)
    big = {u.number: [ROOT] for u in units if sizes.get(u.part, 0) > bound}
    open_ = {u.number: [ROOT] for u in units if u.number not in big}
    by_number = {u.number: u for u in units}
    while big:
        parts = defaultdict(list)
        for number in big:
            parts[by_number[number].part].append(by_number[number])
        have, wanted = {k: dict(v) for k, v in upper.items() if k in big}, {k: np.array(v) for k, v in big.items()}

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.to_pylist():
                    rows = unpacked(block)
                    for unit in parts.get(block["part"], ()):
                        stats = stats_of(unit, rows)
                        node = routed(have.get(unit.number, {}), rows.bins)
                        use = np.isin(node, wanted[unit.number]) & (stats != 0).any(axis=1)
                        ids, at = np.unique(node[use], return_inverse=True)
                        if not len(ids):
                            continue
                        slots, own = chosen_features(unit, ids, rows.bins.shape[1]), stats[use]
                        for s in range(slots.shape[1]):
                            key = at << 8 | rows.bins[use][np.arange(len(at)), slots[at, s]]
                            found, place = np.unique(key, return_inverse=True)
                            sums = np.zeros((len(found), own.shape[1]), np.int64)
                            np.add.at(sums, place, own)
                            k = len(found)
                            yield pa.RecordBatch.from_arrays([
                                pa.array(np.full(k, unit.number, np.int32)), pa.array(ids[found >> 8]),
                                pa.array(slots[found >> 8, s].astype(np.int32)), pa.array((found & 255).astype(np.int32)),
                                pa.array(list(sums), pa.list_(pa.int64()))], ["unit", "node", "feature", "bin", "sums"])

        channels = max(stats_width(u) for u in units)
        parts_ = blocks.mapInArrow(cells, "unit int, node long, feature int, bin int, sums array<long>")
        summed = parts_.groupBy("unit", "node", "feature", "bin").agg(
            F.array(*[F.sum(F.get("sums", F.lit(c))) for c in range(channels)]).alias("sums"))

        def choose(table: pa.Table) -> pa.Table:
            """One node's cells, at most features by bins of them."""
            unit = by_number[table["unit"][0].as_py()]
            feature, bin_ = table["feature"].to_numpy(), table["bin"].to_numpy()
            order = np.lexsort([bin_, feature])
            sums = np.array(table["sums"].to_pylist(), dtype=object)[order][:, :stats_width(unit)].astype(np.int64)
            feature, bin_ = feature[order], bin_[order]
            total = sums[feature == feature[0]].sum(axis=0)[None, :]
            node = table["node"][0].as_py()
            deep = node.bit_length() - 1 >= unit.max_depth
            best, cell = best_splits(np.zeros(len(feature), np.int64), feature, sums, total, unit)
            split = best[0] > 0 and not deep
            row = (unit.number, node, int(feature[cell[0]]) if split else -1, int(bin_[cell[0]]) if split else -1,
                   float(best[0]) if split else 0.0, total[0].tolist())
            left = sums[(feature == feature[cell[0]]) & (bin_ <= bin_[cell[0]])].sum(axis=0).tolist() if split else []
            return pa.Table.from_batches([batch_of([(*row, left)], [*NODE_FIELDS, "left"], NODES + ", left array<long>")])

        found = summed.groupBy("unit", "node").applyInArrow(choose, NODES + ", left array<long>").collect()
        big = {}
        for r in found:
            unit = by_number[r["unit"]]
            upper[unit.number][r["node"]] = (r["feature"], r["bin"], r["gain"], r["sums"])
            if r["feature"] < 0:
                continue
            right = [a - b for a, b in zip(r["sums"], r["left"])]
            for child, sums in ((2 * r["node"], r["left"]), (2 * r["node"] + 1, right)):
                (big if n_rows(unit, sums) > bound else open_).setdefault(unit.number, []).append(child)
    return dict(upper), open_


def stats_width(unit: Unit) -> int:
    return len(unit.criterion.weights) if isinstance(unit.criterion, Gini) else 3


def n_rows(unit: Unit, sums: Sequence[int]) -> int:
    return sum(sums) if isinstance(unit.criterion, Gini) else sums[0]


# --- subtrees --------------------------------------------------------------------

def finish(blocks: DataFrame, units: Sequence[Unit], upper: Upper, open_: dict[int, list[int]], stats_of: Stats,
           work: Callable[[Sequence[tuple[Unit, int, np.ndarray]], Rows], pa.Table], schema: str,
           share: int = 25, watch: bool = True) -> DataFrame:
    """Bring the rows of each open node together and call ``work`` on them.

    Trees whose root is open see the same rows, so ``share`` of them are grown from one
    copy; ``work`` gets (unit, node, stats) for each and returns a table of ``schema``.
    Watched rows come along unless ``watch`` is False.
    """
    batches: list[tuple[int, list[Unit]]] = []  # node and its units
    roots = defaultdict(list)
    for u in units:
        for node in open_.get(u.number, ()):
            if node == ROOT:
                roots[u.part].append(u)
            else:
                batches.append((node, [u]))
    for group in roots.values():
        batches += [(ROOT, group[i:i + share]) for i in range(0, len(group), share)]
    by_part = defaultdict(list)
    for i, (node, group) in enumerate(batches):
        by_part[group[0].part].append((i, node, group))

    def deal(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for block in batch.to_pylist():
                rows = None
                for i, node, group in by_part.get(block["part"], ()):
                    rows = unpacked(block) if rows is None else rows
                    here = rows.train | watch
                    if node != ROOT:
                        here &= routed(upper[group[0].number], rows.bins) == node
                        here &= (stats_of(group[0], rows) != 0).any(axis=1) | ~rows.train
                    if here.any():
                        packed = rows.take(here).packed(block["part"])
                        yield batch_of([(i, *packed)], ["batch", *block], "batch int, " + BLOCK)

    def done(table: pa.Table) -> pa.Table:
        node, group = batches[table["batch"][0].as_py()]
        rows = together([unpacked(b) for b in table.drop_columns(["batch"]).to_pylist()])
        return work([(u, node, stats_of(u, rows)) for u in group], rows)

    # a number of its own: few bytes may be much work, which merged partitions would not spread
    n = max(1, min(len(batches), 3 * blocks.sparkSession.sparkContext.defaultParallelism))
    dealt = blocks.mapInArrow(deal, "batch int, " + BLOCK).repartition(n, "batch")
    return dealt.groupBy("batch").applyInArrow(done, schema)


def nodes_of(number: int, found: Grown) -> pa.RecordBatch:
    """``NODES`` of one tree."""
    n, f, b, g, sums = found.columns()
    ends = np.arange(len(n) + 1, dtype=np.int32) * sums.shape[1]
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(n), number, np.int32)), pa.array(n), pa.array(f.astype(np.int32)), pa.array(b.astype(np.int32)),
        pa.array(g), pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel()))], NODE_FIELDS)


def node_table(grown: Sequence[tuple[Unit, int, np.ndarray]], rows: Rows) -> pa.Table:
    """``work`` that returns the nodes."""
    parts = [batch_of([], NODE_FIELDS, NODES)]
    for unit, node, stats in grown:
        found, _ = grow(rows.bins, stats, unit, node)
        if found.node:
            parts.append(nodes_of(unit.number, found))
    return pa.Table.from_batches(parts)


def grow_all(blocks: DataFrame, units: Sequence[Unit], sizes: dict[int, int], stats_of: Stats, bound: int, share: int = 25) -> pa.Table:
    """All nodes of all units, as one table on the driver: a fitted model."""
    upper, open_ = upper_levels(blocks, units, sizes, stats_of, bound)
    lower = finish(blocks, units, upper, open_, stats_of, node_table, NODES, share, watch=False).toArrow()
    above = [(u, n, f, b, g, s) for u, tree in upper.items() for n, (f, b, g, s) in tree.items()]
    top = batch_of(above, NODE_FIELDS, NODES)
    return pa.Table.from_batches([top]) if not lower.num_rows else pa.concat_tables(
        [pa.Table.from_batches([top]), lower.cast(top.schema)])
