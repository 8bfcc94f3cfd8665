"""Hot keys, lost order of rows, and the shared folder of a cluster."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from bloomtide.operators import daily as d, gaps
from bloomtide.sources import fixtures
from tests.frames import T


def hot_feed(spark):
    """Half of 400,000 readings of one station within one hour, copies included."""
    rows = spark.range(400_000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 97).alias("station"),
        F.when(F.col("id") % 2 == 0, F.lit(T(2024, 5, 1)))
        .otherwise(F.lit(T(2024, 1, 1)) + F.make_dt_interval(F.lit(0), (F.col("id") % 4000).cast("int")))
        .alias("ts"),
        (F.col("id") % 131).cast("double").alias("pollen_a"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 17).cast("double").alias("pollen_b"),
    )
    return rows


def test_hot_hour_is_reduced_before_the_shuffle(spark):
    feed = hot_feed(spark)
    got = {r["station"]: r["n"] for r in gaps.step_counts(feed).filter("step_seconds = 0").collect()}
    copies = feed.groupBy("station", "ts").count().groupBy("station").agg(
        F.sum(F.col("count") - 1).alias("n")
    )
    assert got == {r["station"]: r["n"] for r in copies.collect() if r["n"]}
    assert got[0] >= 199_999
    total = gaps.step_counts(feed).groupBy("station").agg(F.sum("n").alias("n")).collect()
    rows = {r["station"]: r["count"] for r in feed.groupBy("station").count().collect()}
    assert {r["station"]: r["n"] + 1 for r in total} == rows


def test_hot_station_gives_the_same_days(spark):
    feed = hot_feed(spark)
    got = d.daily_pollen_history(feed).groupBy("station").agg(
        F.count("*").alias("days"), F.max("pollen_a").alias("peak")
    ).collect()
    want = feed.groupBy("station").agg(
        (F.date_diff(F.max(F.to_date("ts")), F.min(F.to_date("ts"))) + 1).alias("days"),
        F.max("pollen_a").alias("peak"),
    ).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_results_do_not_depend_on_partitioning(spark):
    sf = "/root/testdata/sf0.001"
    feed = fixtures.pollen_hourly(spark, sf)
    once = sorted(gaps.missing_runs(feed, "pollen_a").collect())
    mixed = feed.repartition(13, F.rand(5))
    assert sorted(gaps.missing_runs(mixed, "pollen_a").collect()) == once


CLUSTER_RUN = """
import sys
sys.path.insert(0, {root!r})
from pathlib import Path
from bloomtide.session import build_session, materialise, scratch_path, shared_dir
spark = build_session("shared", "local[2]", {{
    "spark.checkpoint.dir": {shared!r}, "spark.ui.enabled": "false"}})
assert shared_dir(spark) == {shared!r}
assert scratch_path(spark, "x").startswith({shared!r})
df = materialise(spark.range(100))
assert df.count() == 100
assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
assert any(Path({shared!r}).rglob("rdd-*")), "checkpointed below the shared folder"
"""


def test_shared_folder_of_the_session_is_used(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    code = CLUSTER_RUN.format(root=root, shared=str(tmp_path))
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")}
    done = subprocess.run([sys.executable, "-c", code], env=env, timeout=300,
                          capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]


def test_calendar_of_a_sparse_station(spark):
    df = spark.createDataFrame(
        [(1, dt.date(2000, 1, 1), 1.0), (1, dt.date(2020, 1, 1), 2.0)],
        "station int, date date, pollen_a double",
    )
    filled = d.daily_calendar(df, zero=("pollen_a",))
    assert filled.count() == (dt.date(2020, 1, 1) - dt.date(2000, 1, 1)).days + 1
    assert filled.agg(F.sum("pollen_a")).first()[0] == 3.0
