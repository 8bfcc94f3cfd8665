"""Trees grown in lock step: against brute force, across the bound, as prefixes, as tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bloomtide.modeling import boosting, estimators, growth as g, metrics, selection, splits
from bloomtide.modeling.prepare import fit_folds, fold_test, fold_train
from bloomtide.modeling.tree_model import from_table, probability_expressions
from bloomtide.session import scratch_path
from tests.test_models import FEATURES, table  # noqa: F401


def nodes_of(model):
    return sorted(zip(*(model.nodes[c].to_pylist() for c in ("tree", "node", "feature", "gain", "sums"))))


def same(a, b):
    """Equal but for the NaN thresholds of leaves."""
    return nodes_of(a) == nodes_of(b) and np.array_equal(*(
        m.nodes.sort_by([("tree", "ascending"), ("node", "ascending")])["threshold"].to_numpy() for m in (a, b)), equal_nan=True)


def brute_tree(x, y, weights, depth, min_leaf, node=1):
    """{node: (feature, threshold, class counts)} by trying every value of every feature."""
    counts = [int((y == c).sum()) for c in range(len(weights))]

    def score(part):
        w = [n * v for n, v in zip([int((part == c).sum()) for c in range(len(weights))], weights)]
        return sum(v * v for v in w) / sum(w) if sum(w) else 0.0

    best = (0.0, -1, math.nan)
    if depth:
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f]):
                left = x[:, f] <= v
                if min(left.sum(), (~left).sum()) >= min_leaf:
                    gain = round(score(y[left]) + score(y[~left]) - score(y), 9)
                    if gain > best[0]:
                        best = (gain, f, v)
    out = {node: (best[1], best[2], counts)}
    if best[1] >= 0:
        left = x[:, best[1]] <= best[2]
        out |= brute_tree(x[left], y[left], weights, depth - 1, min_leaf, 2 * node)
        out |= brute_tree(x[~left], y[~left], weights, depth - 1, min_leaf, 2 * node + 1)
    return out


@pytest.fixture(scope="module")
def few(spark, table):  # noqa: F811
    """Few-valued features, so that every value has a bin of its own."""
    return table.select("date", F.round(F.col("x") * 4).alias("x"), F.round("y").cast("int").alias("y"), "label").cache()


def test_tree_against_brute_force(spark, few):
    rows = few.select("x", "y", "label").toArrow().to_pydict()
    x = np.array([rows["x"], rows["y"]], float).T
    y = np.array(rows["label"])
    n = [int((y == c).sum()) for c in range(3)]
    weights = [len(y) / (3 * v) for v in n]
    for depth in (1, 3, None):
        model = estimators.fit_tree(few, max_depth=depth, features=FEATURES)
        want = brute_tree(x, y, weights, depth or 50, 1)
        got = {n: (f, t, s) for n, f, t, s in zip(*(model.nodes[c].to_pylist() for c in ("node", "feature", "threshold", "sums")))}
        assert {k: (v[0], None if math.isnan(v[1]) else v[1], v[2]) for k, v in got.items()} == {
            k: (v[0], None if math.isnan(v[1]) else v[1], v[2]) for k, v in want.items()}


def test_native_split_search_finds_the_same_root(spark, few):
    counts = {r["label"]: r["count"] for r in few.groupBy("label").count().collect()}
    weights = dict(enumerate(g.balanced(counts, 3)))
    gains = splits.split_gains(few, FEATURES, "label", weights)
    best = max(splits.best_thresholds(gains).collect(), key=lambda r: r["gain"])
    model = estimators.fit_tree(few, max_depth=1, features=FEATURES)
    root = [r for r in model.nodes.to_pylist() if r["node"] == 1][0]
    assert (FEATURES[root["feature"]], root["threshold"], root["gain"]) == (best["feature"], best["value"], best["gain"])
    left = [r for r in model.nodes.to_pylist() if r["node"] == 2][0]
    assert left["sums"] == [best["l0"], best["l1"], best["l2"]]
    assert splits.split_gains(few.limit(0), FEATURES, "label", weights).count() == 0


@pytest.mark.parametrize("family, params", [
    ("tree", {"max_depth": None}), ("tree", {"max_depth": 2}),
    ("forest", {"trees": 4, "max_depth": None, "min_leaf": 3}),
    ("boosted", {"rounds": 3, "max_depth": 4, "rate": 0.3}),
])
def test_where_a_tree_passes_to_one_task_does_not_matter(table, family, params):  # noqa: F811
    whole = estimators.fit(table, family, params, features=FEATURES)
    for bound in (20, 90):
        assert same(estimators.fit(table, family, params, features=FEATURES, bound=bound), whole)


def test_prefixes_are_the_smaller_models(table):  # noqa: F811
    big = estimators.fit_forest(table, trees=5, max_depth=None, min_leaf=2, features=FEATURES)
    small = estimators.fit_forest(table, trees=3, max_depth=2, min_leaf=2, features=FEATURES)
    assert same(big.prefix(3).cut(2), small)
    long = estimators.fit_boosted(table, rounds=4, max_depth=2, features=FEATURES)
    assert same(long.prefix(2), estimators.fit_boosted(table, rounds=2, max_depth=2, features=FEATURES))


GRID = {"tree": {"max_depth": (1, None)}, "forest": {"max_depth": (2, None), "min_leaf": (3,), "trees": (2, 5), "sampled": (False, True)},
        "boosted": {"rate": (0.3,), "max_depth": (2,), "rounds": (2, 4)}, "logistic": {"c": (1.0,)}}


def test_search_scores_are_those_of_single_fits(spark, table):  # noqa: F811
    """But for forests that draw rows, by their place in the table, which differs here."""
    binary = table.withColumn("risk", (F.col("label") > 0).cast("int"))
    targets = ["label", "risk"]
    got = selection.search_scores(binary, targets, grid=GRID, splits=2, features=FEATURES).collect()
    assert len(got) == 2 * 2 * 13
    combos = selection.candidates(GRID)
    folds = {f.number: f for f in fit_folds(binary, splits=2)}
    for r in got:
        if r["params"].get("sampled") == "True":
            continue
        learn, test = (part(binary, folds[r["fold"]]) for part in (fold_train, fold_test))
        model = estimators.fit(learn, r["model"], combos[r["position"]].params, label=r["target"], features=FEATURES)
        score = metrics.macro_f1(model.transform(test), label=r["target"]).first()[0]
        assert score == pytest.approx(r["score"], abs=1e-12), r
    trees = {f: GRID[f] for f in ("tree", "forest", "boosted")}
    split = {(r["target"], r["fold"], r["model"], str(r["params"])): r["score"] for r in got if r["model"] != "logistic"}
    low = selection.search_scores(binary, targets, grid=trees, splits=2, features=FEATURES, bound=20).collect()
    assert {(r["target"], r["fold"], r["model"], str(r["params"])): r["score"] for r in low} == split


def test_a_restarted_search_computes_what_is_missing(spark, table, monkeypatch):  # noqa: F811
    log = scratch_path(spark, "log")
    grid = {"tree": {"max_depth": (1, 2)}, "logistic": {"c": (1.0,)}}
    options = {"splits": 2, "features": FEATURES, "log": log}
    real = selection.WAYS

    def broken(search, wanted):
        raise InterruptedError

    monkeypatch.setattr(selection, "WAYS", real | {"tree": broken, "forest": broken})
    with pytest.raises(InterruptedError):
        selection.search_scores(table, ["label"], grid=grid, **options)
    assert spark.read.parquet(log).count() == 2  # the logistic scores are there
    monkeypatch.setattr(selection, "WAYS", real | {"logistic": broken})
    first = selection.search_scores(table, ["label"], grid=grid, **options).collect()
    monkeypatch.setattr(selection, "WAYS", {f: broken for f in real})
    assert selection.search_scores(table, ["label"], grid=grid, **options).collect() == first and len(first) == 6
    with pytest.raises(InterruptedError):  # other rows have other scores
        selection.search_scores(table.filter("station > 0"), ["label"], grid=grid, **options)


def test_softmax_loss_falls_and_probabilities_add_up(spark, table):  # noqa: F811
    edges = g.bin_edges(table, FEATURES, [F.lit(True)])[0]
    blocks = g.pack_rows(table, FEATURES, ["label"], [edges], [(None, None)], None).cache()
    sizes = {0: table.count()}
    losses = []
    boosting.boost(blocks, [boosting.Booster(0, 0, 3, 0.3, 2)], sizes, 6, 50_000, every=2,
                   after={r: lambda rows: losses.append(boosting.log_loss(rows)[0]) for r in range(1, 7)})
    assert losses == sorted(losses, reverse=True) and losses[0] < math.log(3)
    model = estimators.fit_boosted(table, rounds=6, max_depth=2, rate=0.3, features=FEATURES)
    rows = model.transform(table).collect()
    assert all(sum(r["probability"]) == pytest.approx(1.0) and len(r["probability"]) == 3 for r in rows)
    assert -sum(math.log(r["probability"][r["label"]]) for r in rows) / len(rows) == pytest.approx(losses[-1], rel=1e-9)


@pytest.mark.parametrize("family, params", [
    ("tree", {"max_depth": 3}), ("forest", {"trees": 3, "max_depth": 3, "min_leaf": 2}), ("boosted", {"rounds": 2, "max_depth": 2, "rate": 0.3}),
])
def test_the_table_gives_scores_and_importances(spark, table, family, params):  # noqa: F811
    model = estimators.fit(table, family, params, features=FEATURES)
    stored = model.table(spark)
    path = scratch_path(spark, "nodes")
    stored.write.parquet(path)
    options = {"weights": model.weights} if model.kind == "votes" else {"rate": model.rate, "penalty": model.penalty}
    again = from_table(spark.read.parquet(path).toArrow(), model.kind, FEATURES, model.n_classes, **options)
    odd = table.unionByName(table.limit(1).withColumns({"x": F.lit(None).cast("double"), "y": F.lit(float("nan"))}))
    plain = model.transform(odd).select("probability").collect()
    assert again.transform(odd).select("probability").collect() == plain
    sql = table.select(F.array(*probability_expressions(model)).alias("p"))
    assert "Python" not in sql._jdf.queryExecution().executedPlan().toString()
    for a, b in zip(sql.collect(), model.transform(table).collect()):
        assert a["p"] == pytest.approx(b["probability"], abs=1e-12)
    by_hand: dict = {}
    splits_ = [r for r in model.nodes.to_pylist() if r["feature"] >= 0]
    if model.kind == "votes":
        for r in splits_:
            whole = sum(s["gain"] for s in splits_ if s["tree"] == r["tree"])
            by_hand[FEATURES[r["feature"]]] = by_hand.get(FEATURES[r["feature"]], 0) + r["gain"] / whole / len({s["tree"] for s in splits_})
    else:
        for f in FEATURES:
            gains = [r["gain"] for r in splits_ if FEATURES[r["feature"]] == f]
            by_hand[f] = sum(gains) / len(gains) if gains else 0.0
        by_hand = {f: v / sum(by_hand.values()) for f, v in by_hand.items()}
    got = {r["feature"]: r["importance"] for r in estimators.feature_importance(model).collect()}
    assert got == pytest.approx({f: by_hand.get(f, 0.0) for f in FEATURES})


def test_rows_without_class_value_or_spread(spark):
    rows = [(float(i % 3), None if i == 4 else i % 2, float("nan") if i == 5 else None if i == 6 else float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "x double, label int, y double")
    model = estimators.fit_tree(df, features=FEATURES)
    assert sum(model.nodes.filter(g.pa.compute.equal(model.nodes["node"], 1))["sums"].to_pylist()[0]) == 11
    one = estimators.fit_forest(df.filter("label = 1"), trees=2, max_depth=3, min_leaf=1, features=FEATURES)
    assert {r["prediction"] for r in one.transform(df).collect()} == {1.0}
    with pytest.raises(ValueError, match="no values"):
        estimators.fit_tree(df.filter("label > 5"), features=FEATURES)


def test_shares_of_splits_that_gain_nothing(spark):
    rows = spark.createDataFrame([(x, 0) for x in range(6)], "a int, label int")
    best = splits.best_thresholds(splits.split_gains(rows, ["a"], "label", {0: 1.0, 1: 0.0, 2: 0.0}))
    (row,) = splits.with_shares(best).collect()
    assert (row["feature"], row["value"], row["gain"], row["l0"]) == ("a", 0.0, 0.0, 1) and math.isnan(row["importance"])
    two = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "feature string, gain double")
    assert {r["feature"]: r["importance"] for r in splits.with_shares(two).collect()} == {"a": 0.25, "b": 0.75}


def test_packing_keeps_few_constraints(spark):
    """A hash in front of n renamed features would be 2**n of them once the blocks are checkpointed."""
    names = [f"f{i}" for i in range(10)]
    rows = spark.range(5).selectExpr(*[f"double(id) AS {f}" for f in names], "int(id % 2) AS label").cache()
    packed = g.pack_rows(rows, names, ["label"], [[np.array([1.0])] * len(names)], [(None, None)], None)
    assert packed._jdf.queryExecution().optimizedPlan().children().head().validConstraints().size() < 5 * len(names)


def test_a_booster_in_one_task_is_the_one_in_lock_step(spark, table):  # noqa: F811
    rows = table.select("date", "label", *FEATURES).cache()
    folds = fit_folds(rows)[-1:]
    first, last = folds[0].test_first, folds[0].test_last
    edges = g.bin_edges(rows, FEATURES, [F.col("date") < F.lit(first)])
    blocks = g.pack_rows(rows, FEATURES, ["label"], edges, [(first, last)], "date", block=64).cache()
    sizes = {p: sum(c.values()) for p, c in g.class_sizes(blocks).items()}
    total = blocks.agg(F.sum("n")).first()[0]
    assert sizes[0] < total
    boosters = [boosting.Booster(0, 0, 3, 0.3, 3), boosting.Booster(1, 0, 3, 0.1, 2)]

    def run(bound):
        seen = {}

        def note(r):
            def take(df):
                for block in df.collect():
                    own = g.unpacked(block.asDict())
                    seen.update({(r, block["part"], p): (m, t, y) for p, m, t, y in zip(
                        own.places.tolist(), map(tuple, own.margins.tolist()), own.train.tolist(), own.y.tolist())})
            return take

        tables = boosting.boost(blocks, boosters, sizes, 4, bound, every=2, after={2: note(2), 4: note(4)}, keep=True)
        nodes = sorted(tuple(map(str, r.values())) for t in tables for r in t.to_pylist())
        return seen, nodes

    one, lock, deep = run(total), run(total - 1), run(sizes[0] // 3)
    assert len(one[0]) == 2 * 2 * total and one == lock == deep


def test_bin_edges_keep_a_small_plan(spark, monkeypatch):
    """An aggregate for each group and feature would be 410 columns of a sketch for each, in every copy of the plan."""
    widths = []

    def seen(run):
        def noting(df, *args):
            todo = [df._jdf.queryExecution().optimizedPlan()]
            while todo:
                node = todo.pop()
                children = node.children()
                todo += [children.apply(i) for i in range(children.size())]
                widths.append(node.expressions().size())
            return run(df, *args)
        return noting

    names = [f"f{j}" for j in range(10)]
    rows = spark.range(90).selectExpr(*[f"double(id % {j + 2} * (id % 31)) AS {f}" for j, f in enumerate(names)], "id").cache()
    rows = rows.withColumn("f9", F.when(F.col("id") % 9 == 1, float("nan")).when(F.col("id") % 9 != 2, F.col("f9")))
    for name in ("collect", "first"):
        monkeypatch.setattr(type(rows), name, seen(getattr(type(rows), name)))
    groups = [F.col("id") < 20, F.lit(True), F.lit(False)]
    edges = g.bin_edges(rows, names, groups)
    assert widths and max(widths) <= 2 * len(names)
    monkeypatch.undo()
    table_ = rows.toArrow().to_pydict()
    for group, own in zip((20, 90, 0), edges):
        for f, found in zip(names, own):
            values = sorted(v for v, i in zip(table_[f], table_["id"]) if i < group and v is not None and not math.isnan(v))
            if len(set(values)) <= 25:
                want = sorted(set(values))
            else:
                want = sorted({values[math.ceil(k / 32 * len(values)) - 1] for k in range(1, 32)})
            assert found.tolist() == want, (group, f)
