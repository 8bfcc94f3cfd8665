"""Grid search with forward-chaining folds, scored by macro F1.

Combinations that differ in the number of trees or rounds only, or in the depth of trees
that are grown level by level, are prefixes of one fit and are scored from it: of a fold's
24 forests 3 are grown, of its 8 boosted models 4, of its 3 trees one. 100 trees are the
first 100 of 200, and a depth of 5 is the upper part of the unlimited tree. Folds and
targets share the jobs: trees of all of them are grown in lock step.

With a log, each score is written down under what it depends on (rows, features, fold
bounds, seed, parameters); a search that is started again computes what is missing.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from bloomtide.fixed_values import DATE, FEATURES, FOLDS, GRID, SEED
from bloomtide.modeling.boosting import Booster, boost, prediction_counts
from bloomtide.modeling.estimators import BOUND, VECTOR, Model, fit, logistic, training_rows
from bloomtide.modeling.forests import Run, depth_of, vote_counts, votes
from bloomtide.modeling.growth import balanced, bin_edges, class_sizes, pack_rows
from bloomtide.modeling.metrics import macro_f1
from bloomtide.modeling.prepare import Fold, fit_folds, fold_test, fold_train
from bloomtide.session import Stored

RESULTS = "target string, position int, model string, params map<string,string>, fold int, score double"
LOG = "signature string, target string, fold int, model string, params string, score double"


@dataclass(frozen=True)
class Candidate:
    position: int
    family: str
    params: Mapping[str, float | int | None]


def candidates(grid: Mapping[str, Mapping[str, Sequence]] = GRID) -> list[Candidate]:
    """Every combination, family by family, last parameter changing fastest."""
    out = []
    for family, axes in grid.items():
        for values in itertools.product(*axes.values()):
            out.append(Candidate(len(out), family, dict(zip(axes, values))))
    return out


Key = tuple[str, int, int]  # target, fold, position
Scores = dict[Key, float]


class ResultLog:
    """Scores in a folder, each under a signature of all that it depends on."""

    def __init__(self, spark: SparkSession, path: str | None, signature: str, combos: Sequence[Candidate]):
        self.spark, self.path, self.signature = spark, path, signature
        self.names = {c.position: (c.family, json.dumps(dict(c.params), sort_keys=True)) for c in combos}

    def known(self, wanted: set[Key]) -> Scores:
        if self.path is None:
            return {}
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return {}
        rows = self.spark.read.schema(LOG).parquet(self.path).filter(F.col("signature") == self.signature)
        found = {(r["target"], r["fold"], r["model"], r["params"]): r["score"] for r in rows.collect()}  # combinations by folds
        named = {k: (k[0], k[1], *self.names[k[2]]) for k in wanted}
        return {k: found[n] for k, n in named.items() if n in found}

    def add(self, scores: Scores) -> None:
        if self.path is not None and scores:
            rows = [(self.signature, t, f, *self.names[p], s) for (t, f, p), s in scores.items()]
            self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(self.path)


def signature_of(rows: DataFrame, features: Sequence[str], folds: Sequence[Fold], seed: int) -> str:
    row = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    parts = [str(row[0]), str(row[1]), *features, *map(str, folds), str(seed)]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def f1_of(counts: Mapping[tuple[int, int], int]) -> float:
    """Macro F1 of counts by (class, predicted class)."""
    classes = {c for pair in counts for c in pair}
    each = []
    for c in classes:
        hits = counts.get((c, c), 0)
        met = sum(n * ((y == c) + (p == c)) for (y, p), n in counts.items())
        each.append(2 * hits / met if met else 0.0)
    return sum(each) / len(each) if each else 0.0


@dataclass
class Search:
    """What all families of one search share."""

    rows: DataFrame            # stored: the date, the targets, the features
    targets: tuple[str, ...]
    features: tuple[str, ...]
    folds: list[Fold]
    date: str
    seed: int
    bound: int
    parallelism: int

    def pack(self) -> tuple[DataFrame, dict[int, dict[int, int]]]:
        """Blocks of each fold and target, and their training rows by class."""
        edges = bin_edges(self.rows, self.features, [F.col(self.date) < F.lit(f.test_first) for f in self.folds])
        ranges = [(f.test_first, f.test_last) for f in self.folds]
        stored = Stored(self.rows.sparkSession, "blocks")
        blocks = stored.write(pack_rows(self.rows, self.features, self.targets, edges, ranges, self.date))
        self.drop = stored.drop
        return blocks, class_sizes(blocks)

    def part(self, target: str, fold: int) -> int:
        return [f.number for f in self.folds].index(fold) * len(self.targets) + self.targets.index(target)

    def classes(self, counts: Mapping[int, Mapping[int, int]], target: str) -> int:
        return max([2, *(c + 1 for f in self.folds for c in counts.get(self.part(target, f.number), {}))])


def search_logistic(search: Search, wanted: dict[Key, Candidate]) -> Iterable[Scores]:
    """Each combination is a fit of its own; a few run at once from driver threads."""
    jobs: dict[tuple[str, int], list[Key]] = defaultdict(list)
    for key in wanted:
        jobs[key[:2]].append(key)
    folds = {f.number: f for f in search.folds}

    def run(job: tuple[tuple[str, int], list[Key]]) -> Scores:
        (target, number), keys = job
        rows = search.rows.select(search.date, F.col(target).alias("label"), *search.features)
        prepared = training_rows(fold_train(rows, folds[number], date=search.date), "label", search.features)
        learn = prepared.rows.persist()
        held_out = prepared.preparation.transform(fold_test(rows, folds[number], date=search.date)).select("label", VECTOR).persist()
        try:
            out = {}
            for key in keys:
                model = logistic(wanted[key].params, prepared.total_weight).fit(learn)
                out[key] = macro_f1(model.transform(held_out)).first()["macro_f1"]
            return out
        finally:
            learn.unpersist(), held_out.unpersist()

    spark = search.rows.sparkSession
    with ThreadPoolExecutor(max_workers=search.parallelism) as pool:
        yield from pool.map(inheritable_thread_target(spark)(run), jobs.items())


def search_forests(search: Search, wanted: dict[Key, Candidate]) -> Iterable[Scores]:
    """Trees and forests: one forest for each fold, target and leaf size."""
    blocks, counts = search.pack()
    try:
        groups: dict[tuple, list[Key]] = defaultdict(list)
        for key, c in wanted.items():
            sampled = c.family == "forest" and bool(c.params.get("sampled", True))
            groups[(key[0], key[1], sampled, int(c.params.get("min_leaf", 1)))].append(key)
        runs, keys_of = [], {}
        for (target, fold, sampled, min_leaf), keys in groups.items():
            part = search.part(target, fold)
            sizes = tuple(sorted({int(wanted[k].params.get("trees", 1)) for k in keys}))
            depths = tuple(sorted({depth_of(wanted[k].params["max_depth"]) for k in keys}))
            weights = balanced(counts.get(part, {}), search.classes(counts, target))
            keys_of[len(runs)] = keys
            runs.append(Run(len(runs), part, weights, sizes, depths, min_leaf, sampled))
        sizes = {part: sum(c.values()) for part, c in counts.items()}
        found = vote_counts(
            votes(blocks, runs, sizes, len(search.features), search.bound, search.seed),
            max(len(r.sizes) for r in runs), max(len(r.weights) for r in runs))
        tables: dict[tuple, dict] = defaultdict(dict)
        for r in found.collect():  # runs by depths by sizes by pairs of classes
            tables[(r["run"], r["depth"], r["size"])][(r["y"], r["predicted"])] = r["n"]
        out = {}
        for run in runs:
            for key in keys_of[run.number]:
                params = wanted[key].params
                at = (run.number, depth_of(params["max_depth"]), run.sizes.index(int(params.get("trees", 1))))
                out[key] = f1_of(tables[at])
        yield out
    finally:
        search.drop()


def search_boosted(search: Search, wanted: dict[Key, Candidate]) -> Iterable[Scores]:
    """One booster for each fold, target, rate and depth; smaller numbers of rounds on the way."""
    blocks, counts = search.pack()
    try:
        groups: dict[tuple, list[Key]] = defaultdict(list)
        for key, c in wanted.items():
            groups[(key[0], key[1], float(c.params["rate"]), depth_of(c.params["max_depth"]))].append(key)
        boosters, keys_of = [], {}
        for (target, fold, rate, depth), keys in groups.items():
            keys_of[len(boosters)] = keys
            boosters.append(Booster(len(boosters), search.part(target, fold), search.classes(counts, target), rate, depth))
        stops = sorted({int(c.params["rounds"]) for c in wanted.values()})
        tables: dict[int, dict[int, dict]] = {s: defaultdict(dict) for s in stops}

        def note(rounds: int) -> Callable[[DataFrame], None]:
            def take(rows: DataFrame) -> None:
                for r in prediction_counts(rows).collect():  # boosters by pairs of classes
                    tables[rounds][r["part"]][(r["y"], r["predicted"])] = r["n"]
            return take

        sizes = {part: sum(c.values()) for part, c in counts.items()}
        boost(blocks, boosters, sizes, stops[-1], search.bound, after={s: note(s) for s in stops})
        yield {key: f1_of(tables[int(wanted[key].params["rounds"])][b.number]) for b in boosters for key in keys_of[b.number]}
    finally:
        search.drop()


WAYS = {"logistic": search_logistic, "tree": search_forests, "forest": search_forests, "boosted": search_boosted}


def search_scores(
    train: DataFrame, targets: Sequence[str], *, features: Sequence[str] = FEATURES,
    grid: Mapping[str, Mapping[str, Sequence]] = GRID, splits: int = FOLDS, date: str = DATE,
    parallelism: int = 4, seed: int = SEED, log: str | None = None, bound: int = BOUND,
) -> DataFrame:
    """``RESULTS``: the score of every combination on every fold, for each target.

    Rows without a class in a target have no part in it. ``log`` names a folder to note
    scores in and to take known ones from.
    """
    spark = train.sparkSession
    unknown = set(grid) - set(WAYS)
    if unknown:
        raise ValueError(f"unknown model families {sorted(unknown)}")
    stored = Stored(spark, "search")
    rows = stored.write(train.select(date, *[F.col(t).cast("int").alias(t) for t in targets], *features))
    try:
        search = Search(rows, tuple(targets), tuple(features), fit_folds(rows, splits=splits, date=date), date, seed, bound, parallelism)
        combos = {c.position: c for c in candidates(grid)}
        wanted = {(t, f.number, p) for t in targets for f in search.folds for p in combos}
        notes = ResultLog(spark, log, signature_of(rows, features, search.folds, seed) if log else "", list(combos.values()))
        scores = notes.known(wanted)
        for way in dict.fromkeys(WAYS.values()):
            missing = {k: combos[k[2]] for k in sorted(wanted - set(scores)) if WAYS[combos[k[2]].family] is way}
            for found in way(search, missing) if missing else ():
                notes.add(found)
                scores |= found
    finally:
        stored.drop()
    return spark.createDataFrame([
        (t, p, combos[p].family, {k: str(v) for k, v in combos[p].params.items()}, f, s)
        for (t, f, p), s in sorted(scores.items())], RESULTS)


@dataclass(frozen=True)
class SearchResult:
    """``results``: one row per combination and fold; the refitted best model."""

    results: DataFrame
    best: Candidate
    best_score: float
    model: Model


def mean_scores(results: DataFrame) -> DataFrame:
    """One row per combination (and target) with its mean score over the folds."""
    keys = [c for c in ("target", "position", "model", "params") if c in results.columns]
    return results.groupBy(*keys).agg(F.avg("score").alias("score"))


def best_of(results: DataFrame, target: str, grid: Mapping[str, Mapping[str, Sequence]] = GRID) -> tuple[Candidate, float]:
    """The combination with the highest mean score; equal scores: the first."""
    rows = mean_scores(results.filter(F.col("target") == target)).collect()  # one row a combination
    first = max(rows, key=lambda r: (r["score"], -r["position"]))
    return candidates(grid)[first["position"]], first["score"]


def grid_search(
    train: DataFrame, *, label: str = "label", features: Sequence[str] = FEATURES,
    grid: Mapping[str, Mapping[str, Sequence]] = GRID, splits: int = FOLDS,
    date: str = DATE, parallelism: int = 4, seed: int = SEED, log: str | None = None, bound: int = BOUND,
) -> SearchResult:
    """Score every combination on every fold, refit the best on all of ``train``."""
    results = search_scores(
        train, [label], features=features, grid=grid, splits=splits, date=date,
        parallelism=parallelism, seed=seed, log=log, bound=bound)
    best, score = best_of(results, label, grid)
    labelled = train.filter(F.col(label).isNotNull())
    model = fit(labelled, best.family, best.params, label=label, features=features, seed=seed, bound=bound)
    return SearchResult(results.drop("target"), best, score, model)
