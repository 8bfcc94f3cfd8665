"""What the physical plans may and may not contain."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bloomtide.operators import daily as d, features
from bloomtide.plans.bulletin import bulletin
from bloomtide.schemas import DAILY, POLLEN_HOURLY, WEATHER_HOURLY
from bloomtide.session import scratch_path
from bloomtide.sources.files import write_table
from catalog import all_queries, views
from tests.compare import DATA

SF_DIR = f"{DATA}/sf0.001"
QUERIES = all_queries()  # plans of the corpus operators have tests of their own
# Their plans are those of a stored model, or they need more rows than this scale has.
FITTED = {
    "fit_logistic", "fit_logistic_three_classes", "fit_tree", "fit_forest", "fit_boosted",
    "feature_importance", "sorted_importance", "grid_search", "grid_search_stumps", "training_run",
    "save_load_model", "score_with_fitted_models", "time_series_folds",
    *(name for name in QUERIES if name.startswith("grid_search_")),
}
# One row per calendar date, or a few rows cut by a limit before.
SINGLE_PARTITION_ALLOWED = {"fold_bounds", "preview_side_by_side"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTED))
def test_plan_hygiene(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for node in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text, node
    if name not in SINGLE_PARTITION_ALLOWED:
        assert not re.search(
            r"Window [^\n]*\n[ :+-]*(Sort [^\n]*\n[ :+-]*)?Exchange SinglePartition", text
        ), "window over one partition"


@pytest.fixture
def no_broadcast(spark):
    """As if every table were too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def feeds(spark):
    """Both hourly feeds as stored tables."""
    out = []
    for make, schema in ((views.pollen, POLLEN_HOURLY), (views.weather, WEATHER_HOURLY)):
        path = scratch_path(spark, "feed")
        write_table(make(spark, SF_DIR), path)
        out.append(spark.read.schema(schema).parquet(path))
    return out


def count(text: str, node: str) -> int:
    return len(re.findall(rf"(?<![A-Za-z]){node} ", text))


def test_flagship_shuffles_once_per_key_and_sorts_once_per_step(spark, feeds, no_broadcast):
    table = d.daily_table(*feeds)
    text = plan(features.target3(features.feature_table(table)))
    # Two for the join, one for the day aggregate, one for all windows.
    assert count(text, "Exchange") == 4
    # Two for the join, one for the calendar, one for every feature and target.
    assert count(text, "Sort") == 4


def test_bulletin_shuffles_the_daily_table_once(spark, no_broadcast):
    path = scratch_path(spark, "days")
    write_table(views.days(spark, SF_DIR), path)
    text = plan(bulletin(spark.read.schema(DAILY).parquet(path)))
    # One for the daily table itself, two for yearly and three for day-of-year means.
    assert count(text, "Exchange") == 6 and text.count("SortMergeJoin") == 2


def test_narrow_reads(spark, feeds):
    pollen, _ = feeds
    text = plan(d.daily_pollen_history(pollen).select("station", "date", "pollen_a"))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas == ["station:bigint,ts:timestamp_ntz,pollen_a:double"]


def test_year_bound_reaches_the_files(spark):
    path = scratch_path(spark, "days")
    write_table(views.days(spark, SF_DIR), path)
    train, test = features.year_split(spark.read.schema(DAILY).parquet(path), 1999)
    assert "LessThan(date,2000-01-01)" in plan(train)
    assert "GreaterThanOrEqual(date,2000-01-01)" in plan(test)


def test_top_rows_are_cut_before_the_shuffle(spark):
    path = scratch_path(spark, "days")
    write_table(views.days(spark, SF_DIR), path)
    from bloomtide.operators.topk import latest_n

    text = plan(latest_n(spark.read.schema(DAILY).parquet(path), 3))
    assert count(text, "WindowGroupLimit") == 2 and "Partial" in text


def test_no_forbidden_calls_in_the_library():
    root = Path(__file__).resolve().parent.parent
    for file in (root / "bloomtide").rglob("*.py"):
        if "llm" in file.parts:
            continue
        source = file.read_text()
        for call in ("localCheckpoint", ".rdd", "crossJoin", "toPandas", "udf(", "broadcast("):
            assert call not in source, f"{call} in {file}"


def test_filters_on_stations_prune_partitions(spark):
    path = scratch_path(spark, "by-station")
    write_table(views.days(spark, SF_DIR), path, partition_by=("station",))
    df = spark.read.schema(DAILY).parquet(path).filter(F.col("station") == 2)
    assert re.search(r"PartitionFilters: \[[^\]]*station", plan(df))
