from __future__ import annotations

import datetime as dt
import random

import pytest

from bloomtide.operators import filters, gaps, profiling
from tests.frames import D, T, pollen, series


def hours(spark, values, first=T(2024, 1, 31, 20), station=1):
    return pollen(spark, [
        (station, first + dt.timedelta(hours=i), v, 0.0) for i, v in enumerate(values)
    ])


def runs(df):
    got = gaps.missing_runs(df, "pollen_a").orderBy("station", "run_start").collect()
    return [(r["run_start"].hour, r["n_missing"], r["total_missing"]) for r in got]


@pytest.mark.parametrize("values, expected", [
    ([None, None, 1.0], [(20, 2, 2)]),
    ([1.0, None], [(21, 1, 1)]),
    ([1.0, 2.0], []),
    ([None] * 8, [(20, 8, 8)]),                      # over the month boundary
    ([1.0, None, None, 1.0, None, None, None, 1.0], [(21, 2, 2), (0, 3, 5)]),
])
def test_missing_runs(spark, values, expected):
    df = hours(spark, values)
    assert runs(df) == expected
    row = gaps.missing_runs_reconcile(df, "pollen_a").first()
    assert row["status"] == "OK" and row["n_missing"] == sum(v is None for v in values)


def test_missing_runs_equal_brute_force(spark):
    rng = random.Random(7)
    rows, expected = [], []
    for station in range(3):
        total, run = 0, None
        for i in range(24 * 100):
            ts = T(2023, 12, 1) + dt.timedelta(hours=i)
            miss = rng.random() < 0.4 if i % 500 < 250 else i % 500 < 400
            rows.append((station, ts, None if miss else 1.0, 0.0))
            if miss and run:
                run[2], run[3] = ts, run[3] + 1
            elif miss:
                run = [station, ts, ts, 1]
            elif run:
                total += run[3]
                expected.append((*run, total))
                run = None
        if run:
            expected.append((*run, total + run[3]))
    got = gaps.missing_runs(pollen(spark, rows), "pollen_a")
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_steps_equal_brute_force_with_copies_and_gaps(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for station in range(3):
        stamps = sorted(
            T(2023, 11, 1) + dt.timedelta(hours=rng.choice([h, h, h + 900]))
            for h in range(1500) if rng.random() < 0.7
        )
        rows += [(station, ts, 1.0, 1.0) for ts in stamps]
        for a, b in zip(stamps, stamps[1:]):
            step = int((b - a).total_seconds())
            expected[station, step] = expected.get((station, step), 0) + 1
    rng.shuffle(rows)
    got = gaps.step_counts(pollen(spark, rows)).collect()
    assert {(r["station"], r["step_seconds"]): r["n"] for r in got} == expected


def test_steps_of_two_feeds_side_by_side(spark):
    left = hours(spark, [1.0] * 5)
    right = hours(spark, [1.0] * 3).unionByName(hours(spark, [1.0], first=T(2024, 3, 1)))
    got = {r["step_seconds"]: (r["n_left"], r["n_right"])
           for r in gaps.step_regularity(left, right).collect()}
    jump = int((T(2024, 3, 1) - T(2024, 1, 31, 22)).total_seconds())
    assert got == {3600: (4, 2), jump: (None, 1)}


def test_change_blocks_number_from_one(spark):
    df = spark.createDataFrame(
        [(1, T(2024, 1, 1, h), f) for h, f in enumerate([True, True, False, True])],
        "station bigint, ts timestamp_ntz, f boolean",
    )
    got = gaps.change_blocks(df, "f").orderBy("ts").collect()
    assert [r["block"] for r in got] == [1, 1, 2, 3]


def test_null_counts_of_two_tables(spark):
    left, right = hours(spark, [None, 1.0, None]), hours(spark, [1.0]).select("station", "pollen_b")
    got = {r["column_name"]: (r["missing_left"], r["missing_right"])
           for r in profiling.null_counts(left, right).collect()}
    assert got == {"station": (0, 0), "ts": (0, None), "pollen_a": (2, None), "pollen_b": (0, 0)}


def test_summary_of_missing_values(spark):
    got = profiling.summary_stats(hours(spark, [None, None]), ["pollen_a", "pollen_b"]).collect()
    assert {r["statistic"]: r["pollen_a"] for r in got} == {
        "max": None, "min": None, "mean": None, "sum": 0.0, "count": 0.0
    }


def test_class_shares_add_up(spark):
    df = series(spark, D(2024, 1, 1), {"pollen_a": [float(i) for i in range(300)]})
    df = df.selectExpr("date", "CAST(pollen_a > 30 AS INT) AS c", "CAST(NULL AS INT) AS n")
    got = profiling.class_distribution(df, {"pollen_a": "c", "pollen_b": "n"}).collect()
    assert sum(r["share"] for r in got if r["scope"] == "year") == pytest.approx(1.0)
    assert {(r["class"], r["n"]) for r in got if r["scope"] == "season"} == {(1, 153)}


def test_day_of_year_window_ends_at_new_year_unless_wrapped(spark):
    df = series(spark, D(2023, 12, 20), {"pollen_a": [0.0] * 20})
    plain = filters.doy_window(df, D(2024, 1, 3), 5)
    wrapped = filters.doy_window(df, D(2024, 1, 3), 5, wrap=True)
    assert plain.count() == 8 and wrapped.count() == 8 + 2
    assert filters.doy_window(df, D(2024, 1, 3), 5, exclude_year=True).count() == 0
    to_date = filters.year_to_date(df, D(2024, 1, 3))
    assert to_date.count() == 3
