from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bloomtide.operators import cleaning, daily as d, features, topk, windows
from tests.frames import D, T, column, daily, pollen, series, weather


def test_daily_aggregate_of_missing_readings(spark):
    p = pollen(spark, [(1, T(2024, 1, 1, h), None, 4.0 + h) for h in range(3)])
    w = weather(spark, [(1, T(2024, 1, 1, h), None, None, 2.0) for h in range(3)])
    row = d.daily_aggregate(d.join_hourly(p, w)).first()
    assert row["pollen_a"] is None and row["pollen_b"] == 6.0
    assert row["temperature"] is None and row["precipitation"] == 0.0 and row["wind"] == 2.0


def test_only_hours_of_both_feeds_join(spark):
    p = pollen(spark, [(1, T(2024, 1, 1, 0), 1.0, 1.0), (1, T(2024, 1, 1, 1), 9.0, 9.0),
                       (2, T(2024, 1, 1, 0), 5.0, 5.0), (None, T(2024, 1, 1, 0), 7.0, 7.0)])
    w = weather(spark, [(1, T(2024, 1, 1, 0), 3.0, 0.0, 1.0), (None, T(2024, 1, 1, 0), 1.0, 1.0, 1.0)])
    assert [tuple(r)[:3] for r in d.join_hourly(p, w).collect()] == [(1, T(2024, 1, 1, 0), 1.0)]


def test_calendar_fills_gaps_per_station(spark):
    df = daily(spark, [
        (1, D(2024, 2, 28), 5.0, None, 10.0, 1.0, 2.0), (1, D(2024, 3, 1), 6.0, 7.0, 11.0, 2.0, 3.0),
        (2, D(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0),
    ])
    got = [tuple(r) for r in d.daily_calendar(df).orderBy("station", "date").collect()]
    assert got == [
        (1, D(2024, 2, 28), 5.0, 0.0, 10.0, 1.0, 2.0),
        (1, D(2024, 2, 29), 0.0, 0.0, None, 0.0, None),
        (1, D(2024, 3, 1), 6.0, 7.0, 11.0, 2.0, 3.0),
        (2, D(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0),
    ]


@pytest.mark.parametrize("rows", [[], [(1, D(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)]])
def test_empty_and_single_row_tables(spark, rows):
    df = d.daily_calendar(daily(spark, rows))
    assert features.feature_table(df).count() == len(rows)
    assert features.target3(features.feature_table(df)).count() == 0
    assert topk.latest_n(df, 3).count() == len(rows)


def test_history_has_year_and_day(spark):
    p = pollen(spark, [(1, T(2024, 12, 31, 5), 3.0, None), (1, T(2024, 12, 31, 6), 9.0, None)])
    assert tuple(d.daily_pollen_history(p).first()) == (1, D(2024, 12, 31), 9.0, 0.0, 2024, 366)


def test_archive_wins_over_forecast(spark):
    a = daily(spark, [(1, D(2024, 1, 1), 1.0, 0.0, 0.0, 0.0, 0.0)])
    f = daily(spark, [(1, D(2024, 1, 1), 2.0, 0.0, 0.0, 0.0, 0.0),
                      (1, D(2024, 1, 2), 3.0, 0.0, 0.0, 0.0, 0.0)])
    got = d.archive_plus_forecast(a, f).orderBy("date").collect()
    assert [(r["pollen_a"], r["origin"]) for r in got] == [(1.0, "archive"), (3.0, "forecast")]


def test_unknown_column_only_warns(spark):
    df = daily(spark, [(1, D(2024, 1, 1), None, 0.0, 0.0, 0.0, 0.0)])
    with pytest.warns(UserWarning, match="nope"):
        out = cleaning.fill_constant(df, ["pollen_a", "nope"])
    assert out.first()["pollen_a"] == 0.0 and out.columns == df.columns


def test_rolling_needs_all_values(spark):
    df = series(spark, D(2024, 1, 1), {"temperature": [1.0, None, 3.0, 4.0, 5.0, 6.0]})
    before = windows.rolling_prev(df, {"r": ("temperature", 3, "mean")})
    upto = windows.rolling_incl(df, {"r": ("temperature", 3, "sum")})
    assert column(before, "r") == [None, None, None, None, None, 4.0]
    assert column(upto, "r") == [None, None, None, None, 12.0, 15.0]


def test_degree_days_restart_each_year_or_run_on(spark):
    df = series(spark, D(2023, 12, 30), {"temperature": [8.0, None, 6.0, 3.0]})
    assert column(windows.gdd_by_year(df), "gdd_cumul") == [3.0, None, 1.0, 1.0]
    assert column(windows.gdd_running(df), "gdd_cumul") == [3.0, None, 4.0, 4.0]
    table = features.feature_table(df)
    assert column(table, "gdd_cumul") == [3.0, None, 1.0, 1.0]
    assert column(features.feature_table(df, reset=None), "gdd_cumul") == [3.0, None, 4.0, 4.0]


def test_lag_undoes_lead(spark):
    df = series(spark, D(2024, 1, 1), {"pollen_a": [1.0, 2.0, 3.0, 4.0]})
    both = windows.lags(windows.lead_target(df, {"n": "pollen_a"}), {"back": ("n", 1)})
    assert column(both, "back") == [None, 2.0, 3.0, 4.0]


def test_last_day_has_no_target(spark):
    df = series(spark, D(2024, 1, 1), {"pollen_a": [10.0, 50.0, 90.0], "pollen_b": [0.0, 31.0, 30.0]})
    three = features.target3(df)
    assert column(three, "risk_pollen_a_next") == [1, 2]
    assert column(features.target_binary_from3(three), "risk_bin_pollen_a_next") == [1, 1]
    assert column(features.target_binary(df), "risk_bin_pollen_b_next") == [1, 0]


def test_missing_pollen_in_the_targets(spark):
    df = series(spark, D(2024, 1, 1), {"pollen_a": [10.0, None, 20.0, 20.0]})
    assert column(features.target3(df), "risk_pollen_a_next") == [2, 0]
    assert column(features.target_binary(df), "risk_bin_pollen_a_next") == [0, 0]


def test_simple_features_drop_incomplete_rows(spark):
    df = series(spark, D(2024, 1, 1), {"pollen_a": [1.0, 2.0, 3.0, 4.0, 5.0]})
    table = features.feature_table_simple(df, columns=["pollen_a"])
    assert column(table, "date") == [D(2024, 1, 4), D(2024, 1, 5)]
    assert column(table, "pollen_a_mean3") == [3.0, 4.0]
    assert column(table, "pollen_a_lag3") == [1.0, 2.0]


def test_stations_do_not_see_each_other(spark):
    values = [float((i * 7) % 60) for i in range(40)]
    one = series(spark, D(2024, 1, 1), {"pollen_a": values, "temperature": values}, station=1)
    two = series(spark, D(2024, 1, 1), {"pollen_a": values[::-1], "wind": values}, station=2)
    alone = features.feature_table(one).orderBy("date").collect()
    together = features.feature_table(one.unionByName(two)).filter("station = 1")
    assert together.orderBy("date").collect() == alone


def test_row_at_last_previous_and_exact(spark):
    df = series(spark, D(2024, 1, 1), {"pollen_a": [1.0, 2.0, 3.0]})
    assert topk.row_at_or_last(df, D(2024, 1, 2)).first()["pollen_a"] == 2.0
    assert topk.row_at_or_last(df, D(2025, 1, 1)).first()["pollen_a"] == 3.0
    assert topk.previous_row(df, D(2024, 1, 3)).first()["pollen_a"] == 2.0
    assert topk.previous_row(df, D(2024, 1, 1)).count() == 0
    assert topk.row_exact_or_fail(df, D(2024, 1, 2)).first()["pollen_a"] == 2.0
    with pytest.raises(Exception, match="no row dated 2025-01-01"):
        topk.row_exact_or_fail(df, D(2025, 1, 1)).collect()


def test_best_per_group_takes_the_first_of_equals(spark):
    df = spark.createDataFrame(
        [(0, "a", 0.5), (1, "a", 0.75), (2, "a", 0.75), (3, "b", 0.81249)],
        "position int, model string, score double",
    )
    got = [tuple(r) for r in topk.best_per_group(df).collect()]
    assert got == [(3, "b", 0.812), (1, "a", 0.75)]


def test_year_split_is_disjoint_and_ordered(spark):
    df = series(spark, D(2023, 12, 25), {"pollen_a": [0.0] * 20})
    train, test = features.year_split(df, 2023)
    assert train.count() + test.count() == 20
    assert train.agg(F.max("date")).first()[0] == dt.date(2023, 12, 31)
    assert test.agg(F.min("date")).first()[0] == dt.date(2024, 1, 1)
