"""Model preparation, evaluation, fitting, scoring and the stream.

Where SQL has to recompute a score the models are fixed rules (tomorrow is like today).
Of fitted models SQL recomputes what determines them: the gradient of a logistic fit, all
nodes of a tree and a forest, the best thresholds of boosting rounds, the scores of a small search.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, functions as F

from bloomtide.fixed_values import FEATURES as FEATURE_LIST, GRID, POLLEN, SEED
from bloomtide.functions import risk
from bloomtide.modeling import certificate, estimators, metrics, prepare, selection, splits, store
from bloomtide.operators import features, topk
from bloomtide.operators.daily import join_hourly
from bloomtide.plans import scoring, training
from bloomtide.schemas import JOINED_HOURLY
from bloomtide.session import scratch_path
from bloomtide.streaming import daily_stream
from catalog.registry import query, r, rounded, rs
from catalog.tree_sql import grown_nodes_sql
from catalog.views import (
    FEATURES, FEEDS, LAST_TRAIN_YEAR, TARGET, TARGETS, class3, days, pollen, seasonal_days, stored_days, stored_table,
    weather,
)


def _labelled(spark, sf_dir):
    """Complete features with both next-day classes."""
    return features.target3(features.feature_table(days(spark, sf_dir)))


def _persistence(spark, sf_dir, taxon: str = "pollen_b"):
    """Label of tomorrow, predicted to be the class of today."""
    table = _labelled(spark, sf_dir)
    split = F.when(F.year("date") <= LAST_TRAIN_YEAR, "train").otherwise("test")
    return table.select(
        "station", "date", split.alias("split"),
        F.col(f"risk_{taxon}_next").alias("label"),
        risk.risk_class3(taxon).alias("prediction"),
    )


PERSISTENCE = TARGETS + f""",
pairs AS (
  SELECT station, date, CASE WHEN year <= {LAST_TRAIN_YEAR} THEN 'train' ELSE 'test' END AS split,
         risk_pollen_b_next AS label, {class3('pollen_b')} AS prediction FROM labelled)
"""


def _f1_sql(where: str = "true") -> str:
    """Class, precision, recall, F1, support of the chosen pairs."""
    return f"""
  SELECT c.class,
    coalesce(sum(CASE WHEN label = class AND prediction = class THEN 1 END), 0) AS tp,
    coalesce(sum(CASE WHEN label = class THEN 1 END), 0) AS support,
    coalesce(sum(CASE WHEN prediction = class THEN 1 END), 0) AS predicted
  FROM (SELECT DISTINCT label AS class FROM pairs WHERE {where}
        UNION SELECT DISTINCT prediction FROM pairs WHERE {where}) c, pairs
  WHERE {where} GROUP BY c.class"""


_SCORES_SQL = """SELECT class, support,
  CASE WHEN predicted > 0 THEN tp / CAST(predicted AS DOUBLE) ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS recall,
  CASE WHEN predicted + support > 0 THEN 2 * tp / CAST(predicted + support AS DOUBLE) ELSE 0 END
    AS f1, tp"""


# --- preparation -------------------------------------------------------------

@query(f"""WITH {FEATURES} SELECT station, date, """ + ", ".join(
    r(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 "
      f"ELSE stddev_pop({c}) OVER () END", c) for c in FEATURE_LIST) + " FROM complete")
def standardize(spark, sf_dir):
    table = stored_table(spark, features.feature_table(days(spark, sf_dir)).dropna(), "features")
    fitted = prepare.fit_standardizer(table, FEATURE_LIST)
    return rounded(prepare.standardize(table, fitted).select("station", "date", *FEATURE_LIST))


@query(f"""WITH {PERSISTENCE},
t AS (SELECT * FROM pairs WHERE split = 'train'),
c AS (SELECT label, count(*) AS n FROM t GROUP BY 1)
SELECT t.station, t.date, t.label,
       {r("(SELECT sum(n) FROM c) / CAST((SELECT count(*) FROM c) * c.n AS DOUBLE)", "weight")}
FROM t JOIN c ON t.label = c.label""")
def class_weights(spark, sf_dir):
    train = stored_table(spark, _persistence(spark, sf_dir).filter("split = 'train'"), "labels")
    return rounded(prepare.with_class_weights(train.select("station", "date", "label"), "label"))


_FOLDS = f"""WITH {TARGETS},
d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n
      FROM (SELECT DISTINCT date FROM labelled) q),
f AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS fold)"""


@query(_FOLDS + """SELECT fold,
  min(date) FILTER (WHERE i >= n - (6 - fold) * (n // 6) AND i < n - (5 - fold) * (n // 6)) AS test_first,
  max(date) FILTER (WHERE i >= n - (6 - fold) * (n // 6) AND i < n - (5 - fold) * (n // 6)) AS test_last,
  count(*) FILTER (WHERE i < n - (6 - fold) * (n // 6)) AS n_train_dates,
  count(*) FILTER (WHERE i >= n - (6 - fold) * (n // 6) AND i < n - (5 - fold) * (n // 6)) AS n_test_dates
FROM d, f GROUP BY fold""")
def fold_bounds(spark, sf_dir):
    return prepare.fold_bounds(_labelled(spark, sf_dir))


@query(_FOLDS + """SELECT l.station, l.date, fold,
  CASE WHEN i < n - (6 - fold) * (n // 6) THEN 'train' ELSE 'test' END AS role
FROM labelled l JOIN d ON l.date = d.date, f WHERE i < n - (5 - fold) * (n // 6)""")
def time_series_folds(spark, sf_dir):
    rows = stored_table(spark, _labelled(spark, sf_dir).select("station", "date"), "dates")
    return prepare.time_series_folds(rows, prepare.fit_folds(rows))


# --- evaluation --------------------------------------------------------------

@query(f"WITH {PERSISTENCE} SELECT c.class AS actual, " + ", ".join(
    f"count(*) FILTER (WHERE label = c.class AND prediction = {p}) AS predicted_{p}"
    for p in (0, 1, 2)
) + " FROM (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS class) c, pairs GROUP BY c.class")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_persistence(spark, sf_dir), (0, 1, 2))


@query(f"""WITH {PERSISTENCE}, counts AS ({_f1_sql()}), s AS ({_SCORES_SQL} FROM counts)
SELECT CAST(class AS VARCHAR) AS item, {rs('precision', 'recall', 'f1')},
       CAST(support AS BIGINT) AS support FROM s
UNION ALL SELECT 'accuracy', NULL, NULL, {r('sum(tp) / CAST(sum(support) AS DOUBLE)', 'f1')},
       CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'macro avg', {r('avg(precision)', 'a')}, {r('avg(recall)', 'b')},
       {r('avg(f1)', 'c')}, CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', {r('sum(precision * support) / sum(support)', 'a')},
       {r('sum(recall * support) / sum(support)', 'b')},
       {r('sum(f1 * support) / sum(support)', 'c')}, CAST(sum(support) AS BIGINT) FROM s""")
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(_persistence(spark, sf_dir)))


@query(f"""WITH {PERSISTENCE}, a AS ({_f1_sql("split = 'train'")}), b AS ({_f1_sql("split = 'test'")}),
fa AS (SELECT avg(2 * tp / CAST(predicted + support AS DOUBLE)) AS f FROM a),
fb AS (SELECT avg(2 * tp / CAST(predicted + support AS DOUBLE)) AS f FROM b)
SELECT {r('round(fa.f, 3)', 'f1_train')}, {r('round(fb.f, 3)', 'f1_test')},
       {r('round(fa.f - fb.f, 3)', 'gap')} FROM fa, fb""")
def overfit_gap(spark, sf_dir):
    return rounded(metrics.overfit_gap(_persistence(spark, sf_dir)))


# Fixed rules in the place of fitted models: feature and threshold.
RULES = [(f, t) for f in ("pollen_b_lag1", "pollen_b_mean3", "wind_lag1") for t in (20, 26, 40)]


@query(f"""WITH {TARGETS}, s AS (""" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{f}' AS model, CAST({t} AS INTEGER) AS threshold, avg(CASE WHEN "
    f"({f} > {t}) = (risk_pollen_b_next > 0) THEN 1.0 ELSE 0.0 END) AS score FROM labelled"
    for i, (f, t) in enumerate(RULES)
) + f"""), k AS (SELECT *, row_number() OVER (PARTITION BY model
  ORDER BY round(score, 9) DESC, position) AS k FROM s)
SELECT position, model, threshold, {r('round(score, 3)', 'score')} FROM k WHERE k = 1""")
def best_per_group(spark, sf_dir):
    right = F.col("risk_pollen_b_next") > 0
    table = _labelled(spark, sf_dir).agg(*[
        F.avg(((F.col(f) > t) == right).cast("double")).alias(f"_{i}")
        for i, (f, t) in enumerate(RULES)
    ])
    results = table.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f).alias("model"),
                 F.lit(t).alias("threshold"), F.round(f"_{i}", 9).alias("score"))
        for i, (f, t) in enumerate(RULES)
    ])))
    return rounded(topk.best_per_group(results))


# --- fitted models -------------------------------------------------------------

def _split(spark, sf_dir, taxon: str = "pollen_b", binary: bool = True):
    table = training.labelled_features(seasonal_days(spark, sf_dir))
    label = f"risk_bin_{taxon}_next" if binary else f"risk_{taxon}_next"
    rows = table.select("station", "date", *FEATURE_LIST, F.col(label).alias("label"))
    return features.year_split(rows, LAST_TRAIN_YEAR)


def _train(spark, sf_dir, binary: bool = False):
    """Stored training rows that SQL can compute as well, with ``label``."""
    label = F.col("risk_pollen_b_next")
    rows = _labelled(spark, sf_dir).withColumn("label", (label > 0).cast("int") if binary else label)
    return stored_table(spark, rows.filter(F.col("year") <= LAST_TRAIN_YEAR), "train")


def _train_sql(binary: bool = False) -> str:
    label = "CASE WHEN risk_pollen_b_next > 0 THEN 1 ELSE 0 END" if binary else "risk_pollen_b_next"
    return f"""{TARGETS},
t AS (SELECT *, {label} AS label FROM labelled WHERE year <= {LAST_TRAIN_YEAR}),
w AS (SELECT label AS class, count(*) AS n,
        (SELECT count(*) FROM t) / CAST((SELECT count(DISTINCT label) FROM t) * count(*) AS DOUBLE) AS weight FROM t GROUP BY 1)"""


def _gradient_sql(binary: bool) -> str:
    return f"""WITH {_train_sql(binary)}
SELECT CAST(class AS INTEGER) AS class, feature, 0.0::DOUBLE AS gradient, n AS rows, {r('weight')}
FROM w, (SELECT unnest({list(FEATURE_LIST)}) AS feature) f {"WHERE class = 1" if binary else ""}"""


def _gradient(spark, sf_dir, binary: bool):
    train = _train(spark, sf_dir, binary)
    found = certificate.logistic_gradient(estimators.fit_logistic(train), train)
    return rounded(found.withColumn("gradient", F.abs(F.round("gradient", 3))))


@query(_gradient_sql(True))
def fit_logistic(spark, sf_dir):
    """The gradient at the fit is zero in every coefficient."""
    return _gradient(spark, sf_dir, True)


@query(_gradient_sql(False))
def fit_logistic_three_classes(spark, sf_dir):
    return _gradient(spark, sf_dir, False)


# Features with few values have a bin for each, so SQL can try every threshold.
FEW = ("season", "month", "year")


def _score_sql(side: str) -> str:
    """sum(w^2) / sum(w) of the class counts ``side``0..2 times the class weights w0..w2."""
    parts = [f"{side}{c} * w{c}" for c in range(3)]
    return f"CASE WHEN {side}0 + {side}1 + {side}2 > 0 THEN ({' + '.join(f'({p}) * ({p})' for p in parts)}) / ({' + '.join(parts)}) ELSE 0 END"


def _counts_sql(names, source: str = "t", extra: str = "") -> str:
    """Class counts left (l) and right (r) of each value, and of all rows (a)."""
    keys = f"{extra}, " if extra else ""
    long = " UNION ALL ".join(f"SELECT {keys}{i} AS pos, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, label FROM {source}" for i, f in enumerate(names))
    cells = ", ".join(f"count(*) FILTER (WHERE label = {c}) AS n{c}" for c in range(3))
    sums = ", ".join(f"CAST(sum(n{c}) OVER (PARTITION BY {keys}pos ORDER BY value) AS BIGINT) AS l{c}, "
                     f"CAST(sum(n{c}) OVER (PARTITION BY {keys}pos) AS BIGINT) AS a{c}" for c in range(3))
    return f"""values_ AS ({long}),
cells AS (SELECT {keys}pos, feature, value, {cells} FROM values_ GROUP BY ALL),
sides AS (SELECT *, a0 - l0 AS r0, a1 - l1 AS r1, a2 - l2 AS r2 FROM (SELECT *, {sums} FROM cells))"""


_WEIGHTS = "ww AS (SELECT " + ", ".join(f"coalesce(max(weight) FILTER (WHERE class = {c}), 0) AS w{c}" for c in range(3)) + " FROM w)"
_GINI = f"round({_score_sql('l')} + {_score_sql('r')} - {_score_sql('a')}, 9)"


TREES = max(GRID["forest"]["trees"])


def _nodes(spark, model, names):
    """The node table with a column for each sum; 0 for a class above those of the rows."""
    sums = [F.coalesce(F.get("sums", F.lit(i)), F.lit(0)).alias(n) for i, n in enumerate(names)]
    return model.table(spark).select("tree", "node", "feature", "threshold", "gain", *sums)


def _grown_sql(**options) -> str:
    # halves to even digits, as among many nodes some gains are halves
    gain = f"round_even(({_score_sql('l')} + {_score_sql('r')} - {_score_sql('a')}) * 1e9, 0) / 1e9"
    return grown_nodes_sql(_train_sql(), _WEIGHTS, FEATURE_LIST, gain, **options) + """
SELECT CAST(tree AS INTEGER) AS tree, node, feature, threshold, gain, n0, n1, n2 FROM nodes"""


def _exact_train(spark, sf_dir):
    """Training rows with their features to the digits that SQL has as well."""
    return stored_table(spark, rounded(_train(spark, sf_dir)), "train")


@query(_grown_sql())
def fit_tree(spark, sf_dir):
    """A tree of all features, split as long as anything is gained."""
    model = estimators.fit_tree(_exact_train(spark, sf_dir), max_depth=None, exact_bins=True)
    return _nodes(spark, model, ("n0", "n1", "n2"))


@query(_grown_sql(trees=TREES, seed=SEED))
def fit_forest(spark, sf_dir):
    """As many trees as the grid has, of drawn rows and features, split as long as anything is gained."""
    model = estimators.fit_forest(_exact_train(spark, sf_dir), trees=TREES, max_depth=None, min_leaf=1, exact_bins=True)
    return _nodes(spark, model, ("n0", "n1", "n2"))


# First round of three classes: margins 0, hence probabilities 1/3; sums in units of 2**-20.
def _gain_sql(side: str) -> str:
    return f"(g{side} / 1048576.0) * (g{side} / 1048576.0) / (h{side} / 1048576.0 + 1)"


_ROUND = f"""WITH {_train_sql()}, {_counts_sql(FEW)},
k AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS tree),
g AS (SELECT tree, pos, feature, value, l0 + l1 + l2 AS nl, r0 + r1 + r2 AS nr,
    CASE tree WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END AS yl, CASE tree WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END AS yr
  FROM sides, k),
gh AS (SELECT *, CAST(round(1048576.0 / 3) * (nl - yl) + round(-2 * 1048576.0 / 3) * yl AS BIGINT) AS gl,
    CAST(round(1048576.0 / 3) * (nr - yr) + round(-2 * 1048576.0 / 3) * yr AS BIGINT) AS gr,
    CAST(round(4 * 1048576.0 / 9) * nl AS BIGINT) AS hl, CAST(round(4 * 1048576.0 / 9) * nr AS BIGINT) AS hr FROM g WHERE nr > 0),
ga AS (SELECT *, gl + gr AS ga, hl + hr AS ha FROM gh),
best AS (SELECT *, round({_gain_sql('l')} + {_gain_sql('r')} - {_gain_sql('a')}, 9) AS gain FROM ga
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY gain DESC, pos, value) = 1)"""


@query(_ROUND + f""" SELECT tree, CAST(1 AS BIGINT) AS node, feature, value AS threshold, {r('gain')}, nl + nr AS n, ga AS g, ha AS h FROM best
UNION ALL SELECT tree, 2, NULL, NULL, {r('0', 'gain')}, nl, gl, hl FROM best
UNION ALL SELECT tree, 3, NULL, NULL, {r('0', 'gain')}, nr, gr, hr FROM best""")
def fit_boosted(spark, sf_dir):
    """One softmax round of three classes: a tree for each."""
    model = estimators.fit_boosted(_train(spark, sf_dir), rounds=1, max_depth=1, features=FEW)
    return rounded(_nodes(spark, model, ("n", "g", "h")))


@query(_ROUND + f""", m AS (SELECT feature, avg(gain) AS v FROM best GROUP BY 1)
SELECT f.feature, {r('coalesce(v, 0) / (SELECT sum(v) FROM m)', 'importance')}
FROM (SELECT unnest({list(FEW)}) AS feature) f LEFT JOIN m ON m.feature = f.feature""")
def feature_importance(spark, sf_dir):
    """Mean gain of a feature's splits in that round, summed over the node table."""
    model = estimators.fit_boosted(_train(spark, sf_dir), rounds=1, max_depth=1, features=FEW)
    return rounded(estimators.feature_importance(model))


# Whole numbers and single readings: the same in SQL to the last bit.
EXACT = ("season", "month", "year", "doy", *[f"{p}_lag{k}" for p in POLLEN for k in (1, 2, 3)])


@query(f"""WITH {_train_sql()}, {_WEIGHTS}, {_counts_sql(EXACT)},
gains AS (SELECT feature, value, {_GINI} AS gain, l0, l1, l2, a0, a1, a2 FROM sides, ww WHERE r0 + r1 + r2 > 0),
best AS (SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, value) = 1)
SELECT feature, {r('value', 'threshold')}, {r('gain / sum(gain) OVER ()', 'importance')}, l0, l1, l2 FROM best""")
def sorted_importance(spark, sf_dir):
    """Gain of the best threshold of each feature, from the exact split search."""
    train = _train(spark, sf_dir)
    weights = {r["class"]: r["weight"] for r in prepare.class_weights(train, "label").collect()}
    found = splits.best_thresholds(splits.split_gains(train, EXACT, "label", {c: weights.get(c, 0.0) for c in range(3)}))
    return rounded(topk.sorted_importance(splits.with_shares(found).select(
        "feature", F.col("value").alias("threshold"), "importance", "l0", "l1", "l2")))


_BOUNDS = "test_start AS (SELECT fold, n - (6 - fold) * (n // 6) AS a, n - (5 - fold) * (n // 6) AS b FROM f, (SELECT DISTINCT n FROM d) x)"


def _search_sql() -> str:
    """Stumps of each fold on its training dates, and their macro F1 on its test dates."""
    share = lambda side, c: f"round({side}{c} * w{c} / ({' + '.join(f'{side}{k} * w{k}' for k in range(3))}), 12)"
    first = lambda side: (f"CASE WHEN {share(side, 0)} >= {share(side, 1)} AND {share(side, 0)} >= {share(side, 2)} THEN 0 "  # noqa: E731
                          f"WHEN {share(side, 1)} >= {share(side, 2)} THEN 1 ELSE 2 END")
    pick = "CASE feature " + " ".join(f"WHEN '{c}' THEN CAST({c} AS DOUBLE)" for c in FEW) + " END"
    return _FOLDS + f""", {_BOUNDS},
m AS (SELECT l.*, l.risk_pollen_b_next AS label, fold, i < a AS train
  FROM labelled l JOIN d ON l.date = d.date, test_start s WHERE i < b),
t AS (SELECT * FROM m WHERE train),
cw AS (SELECT fold, label AS class, sum(count(*)) OVER (PARTITION BY fold) / CAST(count(*) OVER (PARTITION BY fold) * count(*) AS DOUBLE) AS weight
  FROM t GROUP BY fold, label),
ww AS (SELECT fold AS wf, {", ".join(f"coalesce(max(weight) FILTER (WHERE class = {c}), 0) AS w{c}" for c in range(3))} FROM cw GROUP BY 1),
{_counts_sql(FEW, "t", "fold")},
best AS (SELECT *, {_GINI} AS gain FROM sides JOIN ww ON wf = fold WHERE r0 + r1 + r2 > 0
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY gain DESC, pos, value) = 1),
chosen AS (SELECT fold, feature, value, {first('l')} AS pl, {first('r')} AS pr FROM best),
p AS (SELECT m.fold, label, CASE WHEN {pick} <= value THEN pl ELSE pr END AS predicted FROM m JOIN chosen c ON c.fold = m.fold WHERE NOT train),
classes AS (SELECT fold, label AS class FROM p UNION SELECT fold, predicted FROM p),
f1 AS (SELECT c.fold, class, 2 * count(*) FILTER (WHERE label = class AND predicted = class)
    / CAST(count(*) FILTER (WHERE label = class) + count(*) FILTER (WHERE predicted = class) AS DOUBLE) AS v
  FROM classes c JOIN p ON p.fold = c.fold GROUP BY 1, 2)
SELECT 'risk_pollen_b_next' AS target, CAST(0 AS INTEGER) AS position, 'tree' AS model, fold, {r('avg(v)', 'score')} FROM f1 GROUP BY fold"""


@query(_search_sql())
def grid_search_stumps(spark, sf_dir):
    """The search over folds with the smallest grid, which SQL can repeat."""
    rows = _labelled(spark, sf_dir)
    found = selection.search_scores(rows, ["risk_pollen_b_next"], features=FEW, grid={"tree": {"max_depth": (1,)}})
    return rounded(found.drop("params"))


SEARCHED = tuple(f"risk_{kind}{p}_next" for kind in ("", "bin_") for p in POLLEN)


def _search(family: str):
    def run(spark, sf_dir):
        """Both taxa, three and two classes, the whole grid of the family on five folds."""
        train, _ = features.year_split(training.labelled_features(seasonal_days(spark, sf_dir)), LAST_TRAIN_YEAR)
        results = selection.search_scores(train, SEARCHED, grid={family: GRID[family]})
        return selection.mean_scores(results).orderBy("target", "position")

    run.__name__ = f"grid_search_{family}"
    return query()(run)


for _family in GRID:
    _search(_family)


@query()
def grid_search(spark, sf_dir):
    """The best combination of each family for one target, over the whole grid."""
    train, _ = _split(spark, sf_dir)
    return topk.best_per_group(selection.mean_scores(selection.grid_search(train).results))


@query(f"""WITH {_train_sql()},
m AS (SELECT unnest(['logistic', 'forest', 'boosted']) AS name)
SELECT name, '{",".join(FEW)}' AS features, CAST(3 AS INTEGER) AS classes, CAST(min(date) AS VARCHAR) AS first_date,
  CAST(max(date) AS VARCHAR) AS last_date, count(*) AS rows, CAST(0 AS BIGINT) AS differing
FROM m, t GROUP BY name""")
def save_load_model(spark, sf_dir):
    """What the manifest says of three models, and how many predictions differ after loading."""
    train, path = _train(spark, sf_dir), scratch_path(spark, "models")
    models = {
        "logistic": estimators.fit_logistic(train, features=FEW),
        "forest": estimators.fit_forest(train, trees=5, max_depth=3, features=FEW),
        "boosted": estimators.fit_boosted(train, rounds=3, max_depth=2, features=FEW),
    }
    store.save_models(models, path, dict.fromkeys(models, store.training_range(train)))
    _, manifest = store.read_manifest(path)
    loaded = store.load_models(list(models), path, features=FEW)
    rows = []
    for name, model in models.items():
        before = model.transform(train).select("station", "date", F.col("prediction").alias("a"))
        after = loaded[name].transform(train).select("station", "date", F.col("prediction").alias("b"))
        differing = before.join(after, ["station", "date"]).filter("a <> b").count()
        entry, on = manifest[name], manifest[name]["trained_on"]
        rows.append((name, ",".join(entry["features"]), entry["classes"], on["first_date"], on["last_date"], on["rows"], differing))
    return spark.createDataFrame(
        rows, "name string, features string, classes int, first_date string, last_date string, rows long, differing long")


# --- scoring -----------------------------------------------------------------

def _rule(taxon: str) -> PipelineModel:
    """At risk like yesterday, with a probability that rises with the count."""
    p = f"1 / (1 + exp((30 - {taxon}_lag1) / 10))"
    return PipelineModel([SQLTransformer(statement=(
        f"SELECT *, CAST({taxon}_lag1 > 30 AS INT) AS prediction, "
        f"array(1 - {p}, {p}) AS probability FROM __THIS__"
    ))])


def _rules():
    return _rule("pollen_a"), _rule("pollen_b")


def _targets(table):
    return table.select("station", F.col("date").alias("target"))


def _probability(x: str) -> str:
    return f"1 / (1 + exp((30 - pollen_{x}_lag1) / 10))"


# For each date asked for, the last complete feature row of the 20 days loaded.
_PICKED = FEATURES + """,
picked AS (
  SELECT * FROM (
    SELECT t.date AS asked, c.*, row_number() OVER (
      PARTITION BY t.station, t.date ORDER BY c.date DESC) AS k
    FROM days t JOIN complete c ON c.station = t.station AND c.date <= t.date
      AND c.date >= t.date - INTERVAL 13 DAY) q
  WHERE k = 1)
"""
_DATES = """station, asked AS date, date AS feature_date,
  CAST(date + INTERVAL 1 DAY AS DATE) AS predicted_date"""


@query(f"""WITH {_PICKED} SELECT {_DATES},
CASE WHEN pollen_a_lag1 > 30 THEN 'À risque' ELSE 'Faible' END AS label_a,
CASE WHEN pollen_b_lag1 > 30 THEN 'À risque' ELSE 'Faible' END AS label_b FROM picked""")
def score_date(spark, sf_dir):
    table = stored_days(spark, sf_dir)
    return scoring.score_date(table, _targets(table), *_rules())


@query(f"""WITH {_PICKED} SELECT {_DATES},
CASE WHEN {_probability('a')} >= 0.7 THEN 'À risque' ELSE 'Faible' END AS label_a,
CASE WHEN {_probability('b')} >= 0.7 THEN 'À risque' ELSE 'Faible' END AS label_b,
{r(_probability('a'), 'proba_a')}, {r(_probability('b'), 'proba_b')}, 'api' AS source FROM picked""")
def score_with_threshold(spark, sf_dir):
    table = stored_days(spark, sf_dir)
    return rounded(scoring.score_with_threshold(
        table, _targets(table), *_rules(), threshold=0.7
    ))


@query(f"""WITH {FEATURES},
h AS (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS horizon),
picked AS (
  SELECT * FROM (
    SELECT horizon, CAST(DATE '2001-04-15' + horizon * INTERVAL 1 DAY AS DATE) AS asked, c.*,
      row_number() OVER (PARTITION BY station, horizon ORDER BY c.date DESC) AS k
    FROM h JOIN complete c ON c.date <= DATE '2001-04-15' + horizon * INTERVAL 1 DAY
      AND c.date >= DATE '2001-04-15' - INTERVAL 18 DAY) q
  WHERE k = 1)
SELECT {_DATES}, horizon,
CASE WHEN {_probability('a')} >= 0.5 THEN 'À risque' ELSE 'Faible' END AS label_a,
CASE WHEN {_probability('b')} >= 0.5 THEN 'À risque' ELSE 'Faible' END AS label_b,
{r(_probability('a'), 'proba_a')}, {r(_probability('b'), 'proba_b')}, 'forecast' AS source
FROM picked""")
def score_horizon(spark, sf_dir):
    table = stored_days(spark, sf_dir)
    archive = table.filter(F.col("date") <= F.lit(TARGET))
    forecast = table.filter(F.col("date") > F.lit(TARGET))
    return rounded(scoring.score_horizon(archive, forecast, TARGET, *_rules()))


@query(f"""WITH {FEATURES} SELECT station, date, date AS feature_date,
CAST(date + INTERVAL 1 DAY AS DATE) AS predicted_date,
CASE WHEN pollen_a_lag1 > 30 THEN 'À risque' ELSE 'Faible' END AS label_a,
CASE WHEN pollen_b_lag1 > 30 THEN 'À risque' ELSE 'Faible' END AS label_b,
CAST(NULL AS DOUBLE) AS proba_a, CAST(NULL AS DOUBLE) AS proba_b, 'cache' AS source
FROM features WHERE date = DATE '2001-04-15'""")
def score_precomputed(spark, sf_dir):
    stored = stored_table(spark, features.feature_table(days(spark, sf_dir)), "features")
    return scoring.score_precomputed(stored, TARGET, *_rules())


@query(f"""WITH {FEATURES},
live AS (
  SELECT * FROM (
    SELECT t.date AS asked, c.*, row_number() OVER (
      PARTITION BY t.station, t.date ORDER BY c.date DESC) AS k
    FROM days t JOIN complete c ON c.station = t.station AND c.date <= t.date
      AND c.date >= t.date - INTERVAL 13 DAY AND c.date >= DATE '1998-01-01' + INTERVAL 7 DAY) q
  WHERE k = 1),
stored AS (
  SELECT c.* FROM complete c WHERE NOT EXISTS (
    SELECT 1 FROM live l WHERE l.station = c.station AND l.asked = c.date))
SELECT {_DATES},
CASE WHEN {_probability('a')} >= 0.5 THEN 'À risque' ELSE 'Faible' END AS label_a,
CASE WHEN {_probability('b')} >= 0.5 THEN 'À risque' ELSE 'Faible' END AS label_b,
{r(_probability('a'), 'proba_a')}, {r(_probability('b'), 'proba_b')}, 'api' AS source FROM live
UNION ALL SELECT station, date, date, CAST(date + INTERVAL 1 DAY AS DATE),
CASE WHEN pollen_a_lag1 > 30 THEN 'À risque' ELSE 'Faible' END,
CASE WHEN pollen_b_lag1 > 30 THEN 'À risque' ELSE 'Faible' END, NULL, NULL, 'cache' FROM stored""")
def score_with_fallback(spark, sf_dir):
    """Recent days start in 1998, all older dates have stored features only."""
    table = stored_days(spark, sf_dir)
    recent = table.filter(F.col("date") >= F.lit(dt.date(1998, 1, 1)))
    stored = features.feature_table(table).dropna()
    return rounded(scoring.score_with_fallback(recent, _targets(table), stored, *_rules()))


@query()
def training_run(spark, sf_dir):
    labelled = training.labelled_features(seasonal_days(spark, sf_dir))
    done = training.train_and_evaluate(labelled, "pollen_b", last_train_year=LAST_TRAIN_YEAR)
    parts = ("families", "report", "confusion", "gap", "importance")
    rows = [
        getattr(done, part).select(F.lit(part).alias("part"), F.to_json(F.struct("*")).alias("row")) for part in parts
    ]
    return reduce(DataFrame.unionByName, rows)


@query()
def score_with_fitted_models(spark, sf_dir):
    table = seasonal_days(spark, sf_dir)
    labelled = training.labelled_features(table)
    train, _ = features.year_split(labelled, LAST_TRAIN_YEAR)
    models = [estimators.fit_logistic(train, label=f"risk_bin_{p}_next") for p in POLLEN]
    return scoring.score_with_threshold(table, _targets(table), *models)


# --- stream ------------------------------------------------------------------

@query(f"""WITH {FEEDS}
SELECT station, CAST(ts AS DATE) AS date, {r('max(pollen_a)', 'pollen_a')},
{r('max(pollen_b)', 'pollen_b')}, {r('avg(temperature)', 'temperature')},
{r('coalesce(sum(precipitation), 0)', 'precipitation')}, {r('avg(wind)', 'wind')}
FROM joined GROUP BY 1, 2
HAVING CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY
       <= (SELECT max(ts) FROM joined) - INTERVAL 2 DAY""")
def daily_aggregate_stream(spark, sf_dir):
    landed, out = scratch_path(spark, "landed"), scratch_path(spark, "stream-days")
    join_hourly(pollen(spark, sf_dir), weather(spark, sf_dir)).write.parquet(landed)
    stream = daily_stream.daily_aggregate_stream(
        daily_stream.read_hourly_stream(spark, landed, JOINED_HOURLY)
    )
    daily_stream.run_available(stream, out, scratch_path(spark, "stream-state"))
    return rounded(spark.read.parquet(out))


_LATE = f"""WITH {FEEDS},
arrived AS (SELECT *, (station + hour(ts)) % 7 = 0 AS second FROM joined),
last AS (SELECT max(ts) AS m FROM arrived WHERE NOT second),
taken AS (SELECT * FROM arrived, last WHERE NOT second OR ts >= m - INTERVAL 2 DAY),
missed AS (SELECT station, CAST(ts AS DATE) AS date, count(*) AS n FROM arrived, last WHERE second AND ts < m - INTERVAL 2 DAY GROUP BY 1, 2)"""


@query(_LATE + f"""
SELECT t.station, CAST(t.ts AS DATE) AS date, {r('max(pollen_a)', 'pollen_a')},
{r('max(pollen_b)', 'pollen_b')}, {r('avg(temperature)', 'temperature')},
{r('coalesce(sum(precipitation), 0)', 'precipitation')}, {r('avg(wind)', 'wind')}, coalesce(max(n), 0) AS late_rows
FROM taken t LEFT JOIN missed x ON x.station = t.station AND x.date = CAST(t.ts AS DATE) GROUP BY 1, 2""")
def daily_revisions_stream(spark, sf_dir):
    """A seventh of the hours lands a batch later; those within two days revise their day."""
    landed, days = scratch_path(spark, "landed"), daily_stream.RevisedDays(spark, scratch_path(spark, "revised"))
    rows = join_hourly(pollen(spark, sf_dir), weather(spark, sf_dir))
    second = (F.col("station") + F.hour("ts")) % 7 == 0
    state = scratch_path(spark, "stream-state")
    for late in (False, True):
        rows.filter(second == late).write.mode("append").parquet(landed)
        daily_stream.run_revisions(daily_stream.read_hourly_stream(spark, landed, JOINED_HOURLY), days, state)
    late = days.late_rows().select("station", "date", F.col("rows").alias("late_rows"))
    return rounded(days.days().join(late, ["station", "date"], "left").withColumn("late_rows", F.coalesce("late_rows", F.lit(0))))
