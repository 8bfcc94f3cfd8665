"""Connected components: results, and how much the driver is given to plan."""

from __future__ import annotations

import random
import re

import pytest

from bloomtide.llm import common, ngram_join
from bloomtide.llm.components import components
from tests.llm.frames import documents


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return sorted((x, root(x)) for x in parent if root(x) != x)


@pytest.fixture
def plans(monkeypatch):
    """The planned text of every table that is stored."""
    seen, store = [], common.Scratch.store

    def noted(self, df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return store(self, df)

    monkeypatch.setattr(common.Scratch, "store", noted)
    return seen


@pytest.mark.parametrize("kind", ["random", "path", "hub", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {"random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], "path": [(i, i + 1) for i in range(20)],
             "hub": [(50, rng.randrange(100)) for _ in range(60)] + [(7, 7), (200, 300)], "none": []}[kind]
    got = components(spark.createDataFrame(edges + [(None, 1)], "u long, v long")).collect()
    assert sorted(map(tuple, got)) == brute(edges)


def test_edges_that_are_stars_need_no_round(spark, plans):
    edges = spark.createDataFrame([(5, 1), (1, 6), (3, 2), (2, 3), (4, 4)], "u long, v long")
    assert sorted(map(tuple, components(edges).collect())) == [(3, 2), (5, 1), (6, 1)]
    assert len(plans) == 1


def test_plan_of_a_round_is_small(spark, plans):
    components(spark.createDataFrame([(i, i + 1) for i in range(9)], "u long, v long"))
    assert len(plans) > 1
    for plan in plans[1:]:
        assert len(re.findall("Scan parquet", plan)) <= 4


def test_classes_are_planned_once_for_all_readers(spark):
    docs = documents(spark, [(i, f"a b c d e f g h i j k l m n o p q r s {'x' if i < 3 else i}") for i in range(6)])
    left = ngram_join.one_of_each(docs, n=3, num=60)
    assert len(re.findall("Scan parquet", left._jdf.queryExecution().executedPlan().toString())) <= 4
