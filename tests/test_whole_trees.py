"""The queries of a tree and of a forest grow them to the end, as their SQL does."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bloomtide.fixed_values import FEATURES, GRID
from bloomtide.modeling import estimators, splits
from catalog import all_oracles, all_queries
from tests.compare import connect, differences

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    """Some lines for each of 130 days and five stations; a taxon that is high on hot days, most of the time."""
    rng, rows = random.Random(5), []
    for day in range(130):
        for station in range(5):
            for _ in range(rng.randint(1, 3)):
                quantity = rng.randint(1, 50)
                price = quantity * 1200.0 + rng.randint(0, 30_000)
                rows.append((station + 10 * rng.randint(0, 3), quantity, price, rng.randint(0, 10) / 100, rng.randint(0, 8) / 100,
                             rng.choice("RAAN"), dt.datetime(1998, 10, 1) + dt.timedelta(days=day)))
    names = ("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.timestamp("us"))
    path = tmp_path_factory.mktemp("lines")
    pq.write_table(pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names), path / "lineitem.parquet")
    return str(path)


@pytest.mark.parametrize("name, trees", [("fit_tree", 1), ("fit_forest", max(GRID["forest"]["trees"]))])
def test_the_whole_tree_is_that_of_the_sql(spark, sf_dir, name, trees):
    found = QUERIES[name](spark, sf_dir).cache()
    assert differences(found, connect(sf_dir), ORACLES[name]) == []
    inner = found.filter("feature IS NOT NULL")
    row = inner.agg(F.countDistinct("tree").alias("trees"), F.countDistinct("feature").alias("features"), F.max("node").alias("deep")).first()
    assert row["trees"] == trees and row["features"] > len(FEATURES) / 2 and row["deep"] >= 2 ** 5
    # nothing is left to split: a leaf has one class, or no feature that could tell its rows apart was gained from
    mixed = found.filter("feature IS NULL AND size(filter(array(n0, n1, n2), n -> n > 0)) > 1").count()
    assert mixed <= found.filter("feature IS NULL").count() / 10


def test_exact_edges(spark):
    rows = spark.range(1000).select(
        (F.col("id") * 7 % 1000).cast("double").alias("many"), (F.col("id") % 25).alias("few"),
        F.when(F.col("id") % 3 == 0, float("nan")).when(F.col("id") % 3 == 1, F.col("id") % 40).alias("odd"),
        F.lit(None).cast("double").alias("none"), F.when(F.col("id") < 900, 1.0).otherwise(F.col("id")).alias("heavy"))
    names = ["many", "few", "odd", "none", "heavy"]
    table = rows.toArrow().to_pydict()
    for name, edges in zip(names, splits.exact_edges(rows, names), strict=True):
        values = sorted(float(v) for v in table[name] if v is not None and not math.isnan(v))
        if len(set(values)) <= 25:
            want = sorted(set(values))
        else:
            want = sorted({values[math.ceil(k * len(values) / 32) - 1] for k in range(1, 32)})
        assert edges.tolist() == want, name
    assert [e.tolist() for e in splits.exact_edges(rows.limit(0), names)] == [[]] * 5


def test_a_tree_of_exact_bins(spark):
    rows = spark.range(6000).select((F.col("id") * 11 % 6000).cast("double").alias("x"), (F.col("id") * 11 % 6000 > 2999).cast("int").alias("label"))
    model = estimators.fit_tree(rows, max_depth=None, features=["x"], exact_bins=True)
    root = model.nodes.to_pylist()[0]
    assert (root["threshold"], root["sums"]) == (2999.0, [3000, 3000]) and len(model.nodes) == 3
    assert np.isnan(model.nodes["threshold"].to_numpy()).sum() == 2
