from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from bloomtide.functions import calendar, numeric, risk


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_thresholds_of_both_classes(spark):
    given = [(30.0,), (30.0001,), (80.0,), (80.0001,), (None,), (0.0,)]
    got = values(spark, given, "x double", c=risk.risk_class3("x"), b=risk.risk_binary("x"))
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (2, 0), (0, 0)]


def test_nan_is_missing_after_ingest(spark):
    got = values(spark, [(math.nan,), (1.0,), (None,)], "x double", v=numeric.nan_to_null("x"))
    assert got == [(None,), (1.0,), (None,)]


def test_degree_days_never_turn_missing_into_zero(spark):
    got = values(spark, [(7.5,), (5.0,), (-3.0,), (None,)], "t double", g=numeric.degree_days("t"))
    assert got == [(2.5,), (0.0,), (0.0,), (None,)]


def test_season_by_month(spark):
    got = values(spark, [(m,) for m in range(1, 13)], "month int", s=calendar.season())
    assert [s for (s,) in got] == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 0]


def test_calendar_of_a_leap_year(spark):
    days = [(dt.date(2024, 2, 29),), (dt.date(2024, 12, 31),), (dt.date(2023, 1, 1),)]
    got = values(spark, days, "date date", **calendar.calendar_parts())
    assert got == [(60, 2, 2024), (366, 12, 2024), (1, 1, 2023)]


def test_cyclic_uses_365_days_in_leap_years_too(spark):
    got = values(spark, [(366, 12)], "doy int, month int", **calendar.cyclic())[0]
    assert got[0] == pytest.approx(math.sin(2 * math.pi * 366 / 365))
    assert got[3] == pytest.approx(1.0)


def test_date_texts(spark):
    got = values(
        spark, [(dt.date(2026, 1, 5),), (dt.date(2024, 2, 29),)], "date date",
        f=calendar.french_date(), i=calendar.iso_date(), s=calendar.slash_date(),
    )
    assert got == [
        ("Lundi 5 Janvier 2026", "2026-01-05", "05/01/2026"),
        ("Jeudi 29 Février 2024", "2024-02-29", "29/02/2024"),
    ]


def test_labels_by_threshold_and_confidence(spark):
    got = values(
        spark, [(0.5,), (0.49,), (None,)], "p double",
        l=risk.label_of_probability("p"), c=risk.confidence("p"),
    )
    assert got == [("À risque", 50.0), ("Faible", 51.0), (None, None)]


def test_truncation_survives_the_last_bit_of_a_sum(spark):
    got = values(
        spark, [(2.7,), (-2.7,), (756.9999999999999,), (None,)], "x double", t=numeric.truncate("x")
    )
    assert got == [(2,), (-2,), (757,), (None,)]


def test_naive_times_ignore_the_session_zone(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 3, 31, 2, 30, 15),), (dt.datetime(1969, 12, 31, 23, 0),)],
        "ts timestamp_ntz",
    )
    seconds = [
        (dt.datetime(2024, 3, 31, 2, 30, 15) - dt.datetime(1970, 1, 1)).total_seconds(), -3600,
    ]
    for zone in ("UTC", "Europe/Paris", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            rows = df.select(
                calendar.naive_seconds("ts").alias("s"), calendar.hour_floor("ts").alias("h")
            ).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert [r["s"] for r in rows] == seconds
        assert rows[0]["h"] == dt.datetime(2024, 3, 31, 2, 0)


def test_worst_of_two_labels(spark):
    pairs = [("Faible", "Faible"), ("Faible", "À risque"), ("À risque", "À risque")]
    got = values(
        spark, pairs, "a string, b string", r=risk.any_at_risk("a", "b"),
        w=risk.worst_label("a", "b"), n=F.lit(1),
    )
    assert got == [(False, "Faible", 1), (True, "À risque", 1), (True, "À risque", 1)]
