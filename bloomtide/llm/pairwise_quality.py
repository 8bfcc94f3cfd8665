"""Quality scores learned from preference pairs (Bradley-Terry).

A labelled good document is preferred to a labelled bad one. The probability of a
preference is the sigmoid of the difference of two scores, and a score is linear
in features of the text, so the weights follow from logistic loss on feature
differences, without intercept. The cut between good and bad is a quantile of
the learned scores: the share of bad documents among the labelled.

Features come from built-in functions over the whole text, in the scan. Fitting
uses at most ``max_rows`` labelled rows of each class, taken by a seeded digest
(documented bound; 8,000 by default); scoring covers every row.

Defined results: a null text is an empty one and gets a score; rows without a
label or with a null id are never learned from; without labels of both classes
all weights are 0; repeated rows get the same score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bloomtide.llm.common import BLANKS, number_of, replaced, text_of, words_of
from bloomtide.session import materialise

FEATURES = ("log_words", "word_length", "distinct_words", "upper", "marks", "exclaims", "bars", "digits", "ends",
            "dup_lines", "line_words")


def share(count: Column, of: Column) -> Column:
    return count / F.greatest(of, F.lit(1))


def with_features(rows: DataFrame, text: str = "text", name: str = "features") -> DataFrame:
    """Add ``name``: an array of doubles, in the order of ``FEATURES``."""
    body = text_of(text)
    staged = rows.withColumns({"_words": words_of(body), "_lines": F.split(body, "\n")})
    words, lines = F.col("_words"), F.col("_lines")
    n, chars = F.size(words), F.length(body)
    values = {
        "log_words": F.log1p(n),
        "word_length": share(F.length(replaced(body, BLANKS)), n),
        "distinct_words": share(F.size(F.array_distinct(words)), n),
        "upper": share(chars - F.length(F.regexp_replace(body, r"\p{Lu}+", "")), chars),
        "marks": share(number_of(body, "#*$%&<>"), chars),
        "exclaims": share(number_of(body, "!?"), n),
        "bars": share(number_of(body, "|"), n),
        "digits": share(number_of(body, "0123456789"), chars),
        "ends": share(number_of(body, "."), n),
        "dup_lines": share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": F.log1p(share(n, F.size(lines))),
    }
    return staged.withColumn(name, F.array(*[values[f].cast("double") for f in FEATURES])).drop("_words", "_lines")


@dataclass(frozen=True)
class PairwiseModel:
    """Weights of the standardised features and the cut of the latent score."""

    means: tuple[float, ...]
    deviations: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float
    spread: float

    def latent(self, features: str = "features") -> Column:
        terms = [
            (F.least(F.greatest((F.col(features)[i] - m) / d, F.lit(-20.0)), F.lit(20.0))) * w
            for i, (m, d, w) in enumerate(zip(self.means, self.deviations, self.weights, strict=True)) if d > 0 and w
        ]
        return sum(terms[1:], terms[0]) if terms else F.lit(0.0)

    def score(self, threshold: float = 0.5, features: str = "features") -> Column:
        """0 to 1, growing with the latent score; at the cut it is ``threshold``."""
        shift = F.log(F.lit(threshold / (1 - threshold)))
        z = (self.latent(features) - self.cut) / self.spread + shift
        return 1 / (1 + F.exp(-z))


def labelled_sample(labels: DataFrame, label: str, key: str, max_rows: int, seed: int) -> DataFrame:
    """At most ``max_rows`` labels of each class, the first by a seeded digest."""
    order = F.xxhash64(F.lit(seed), F.col(key))
    parts = [labels.filter(F.col(label) == c).orderBy(order, key).limit(max_rows) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def preference_pairs(sample: DataFrame, label: str, key: str, partners: int, seed: int) -> DataFrame:
    """(difference, target): each good row against ``partners`` bad ones, in both directions.

    Rows of the bounded sample are numbered in a seeded order within their class;
    number i meets the numbers i, i + 1, ... of the other class, counted round.
    """
    order = W.partitionBy(label).orderBy(F.xxhash64(F.lit(seed + 1), F.col(key)), key)
    numbered = sample.withColumn("_i", F.row_number().over(order) - 1)
    good = numbered.filter(F.col(label) == 1).select("_i", F.col("features").alias("better"))
    bad = numbered.filter(F.col(label) == 0).select(F.col("_i").alias("_j"), F.col("features").alias("worse"))
    n_bad = max(bad.count(), 1)
    met = good.select(
        "better", "_i", F.explode(F.sequence(F.lit(0), F.lit(partners - 1))).alias("_step")
    ).withColumn("_j", ((F.col("_i") * partners + F.col("_step")) % n_bad).cast("int"))
    difference = F.zip_with("better", "worse", lambda a, b: a - b)
    pairs = met.join(bad, "_j").select(difference.alias("d"), (F.col("_i") % 2 == 0).alias("as_is"))
    return pairs.select(
        F.when(F.col("as_is"), F.col("d")).otherwise(F.transform("d", lambda x: -x)).alias("difference"),
        F.col("as_is").cast("double").alias("target"))


def fit_pairwise(documents: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id",
                 text: str = "text", max_rows: int = 8000, partners: int = 4, penalty: float = 1e-3,
                 seed: int = 0) -> PairwiseModel:
    """Learn from 0/1 labels; the cut is the quantile at the share of 0.

    The sample of labels, ``2 * max_rows`` rows of two numbers at most, is sent to
    all tasks, so no text is shuffled.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, label)
    share_bad = known.agg(F.avg((F.col(label) == 0).cast("double"))).first()[0] or 0.0
    chosen = F.broadcast(labelled_sample(known, label, key, max_rows, seed))
    sample = materialise(with_features(documents.select(key, text).join(chosen, key), text).select(key, label, "features"))
    try:
        stats = sample.agg(*[f(F.col("features")[i]) for f in (F.avg, F.stddev_pop) for i in range(len(FEATURES))],
                           F.count_distinct(label)).first()
        n = len(FEATURES)
        if stats[2 * n] < 2:
            return PairwiseModel((0.0,) * n, (0.0,) * n, (0.0,) * n, 0.0, 1.0)
        means, deviations = tuple(stats[:n]), tuple(stats[n:2 * n])
        scaled = sample.withColumn("features", F.array(*[
            F.least(F.greatest((F.col("features")[i] - means[i]) / (deviations[i] or 1.0), F.lit(-20.0)), F.lit(20.0))
            for i in range(n)]))
        pairs = preference_pairs(scaled, label, key, partners, seed).select(
            array_to_vector("difference").alias("difference"), "target")
        fitted = LogisticRegression(featuresCol="difference", labelCol="target", fitIntercept=False,
                                    standardization=False, regParam=penalty, maxIter=50, tol=1e-6).fit(pairs)
        model = PairwiseModel(means, deviations, tuple(float(x) for x in fitted.coefficients), 0.0, 1.0)
        # the sample holds both classes alike: weight its rows to the labelled shares
        weights = sample.groupBy(label).agg(F.count("*").alias("n")).collect()
        counts = {r[label]: r["n"] for r in weights}
        latent = sample.select(label, model.latent().alias("latent"))
        per_class = {c: latent.filter(F.col(label) == c) for c in (0, 1)}
        grid = [i / 200 for i in range(201)]
        q = {c: per_class[c].agg(F.percentile("latent", F.array(*map(F.lit, grid)))).first()[0] for c in counts}
        cut = weighted_quantile(q[0], q[1], share_bad)
        spread = max(1e-6, (q[1][100] - q[0][100]) / 6)
        return PairwiseModel(means, deviations, model.weights, cut, spread)
    finally:
        sample.unpersist()


def weighted_quantile(bad: list[float], good: list[float], share_bad: float) -> float:
    """The latent score below which ``share_bad`` of all labelled rows lie, classes weighted by their share."""
    points = sorted([(x, share_bad / len(bad)) for x in bad] + [(x, (1 - share_bad) / len(good)) for x in good])
    below = 0.0
    for x, weight in points:
        below += weight
        if below >= share_bad:
            return x
    return points[-1][0]
