"""Worked examples of every indicator."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bloomtide.operators import history, indicators as k, lookups
from bloomtide.plans.bulletin import bulletin, bulletin_at
from tests.frames import D, daily, series


def last(df):
    return df.orderBy(F.desc("date")).first()


def with_baseline(df, **values):
    return df.withColumns({n: F.lit(v) for n, v in values.items()})


@pytest.mark.parametrize("a, b, name, value", [
    (5.0, 4.0, "🌳 Bouleau", 5.0), (1.0, 4.0, "🌾 Graminées", 4.0),
    (3.0, 3.0, "Égalité", 3.0), (0.0, 0.0, "Égalité", 0.0),
])
def test_dominant_taxon(spark, a, b, name, value):
    df = series(spark, D(2024, 4, 1), {"pollen_a": [a], "pollen_b": [b]})
    row = last(k.with_dominant_taxon(df))
    assert (row["dominant"], row["dominant_value"]) == (name, value)


@pytest.mark.parametrize("wind, index", [(25.0, 5.0), (60.0, 10.0), (None, 0.0), (19.9, 4.0)])
def test_wind_index(spark, wind, index):
    row = last(k.with_wind_index(series(spark, D(2024, 4, 1), {"wind": [wind]})))
    assert row["wind_index"] == index
    assert row["wind_message"].startswith(
        "Air calme" if index < 4 else "Vent modéré" if index < 7 else "Vent fort"
    )


def test_washout_of_three_days(spark):
    df = series(spark, D(2024, 4, 1), {"precipitation": [99.0, 3.0, 5.0, 4.0]})
    assert last(k.with_washout_score(df))["washout_score"] == 80
    assert k.with_washout_score(df).orderBy("date").first()["washout_score"] == 100


def test_heat_sum_starts_in_january(spark):
    df = series(spark, D(2023, 12, 30), {"temperature": [100.0, 100.0] + [105.4] * 3})
    row = last(k.with_heat_sum(df))
    assert (row["heat_sum"], row["heat_reached"], row["heat_remaining"]) == (301, True, 0)
    second = k.with_heat_sum(df).filter(F.col("date") == D(2024, 1, 2)).first()
    assert second["heat_message"] == "100°C·j avant le seuil de floraison"


def test_year_to_date_can_be_limited_in_days(spark):
    df = series(spark, D(2024, 1, 1), {"temperature": [15.0] * 10})
    assert last(k.with_heat_sum(df))["heat_sum"] == 100
    assert last(k.with_heat_sum(df, max_days=2))["heat_sum"] == 30


@pytest.mark.parametrize("mean, expected", [(2000.0, 60), (1000.0, 100), (0.0, 0), (None, 0)])
def test_season_progress(spark, mean, expected):
    df = series(spark, D(2024, 4, 1), {"pollen_a": [500.0, 300.0], "pollen_b": [100.0, 300.0]})
    df = df.withColumn("mean_total", F.lit(mean).cast("double"))
    row = last(k.with_season_progress(df))
    assert row["season_progress"] == expected
    assert row["past_peak"] == (expected > 65)


def test_seasonal_anomaly(spark):
    df = series(spark, D(2024, 4, 1), {"pollen_a": [80.0], "pollen_b": [0.0]})
    both = last(k.with_seasonal_anomaly(with_baseline(df, mean_a=55.0, mean_b=0.0)))
    assert both["anomaly"] * 2 == pytest.approx((80 / 55 - 1) * 100)  # about +45 for the one
    assert both["anomaly_message"] == "Saison +23% au-dessus de la normale"
    low = last(k.with_seasonal_anomaly(with_baseline(df, mean_a=800.0, mean_b=10.0)))
    assert low["anomaly_message"] == "Saison -95% en dessous de la normale"
    none = last(k.with_seasonal_anomaly(df.withColumns({
        "mean_a": F.lit(None).cast("double"), "mean_b": F.lit(None).cast("double")
    })))
    assert (none["anomaly"], none["anomaly_message"]) == (0.0, "Données insuffisantes")


@pytest.mark.parametrize("mean, shift, message", [
    (95.0, 12, "12 jours d'avance sur la moyenne"),
    (70.0, -13, "13 jours de retard sur la moyenne"),
    (85.9, 2, "Démarrage dans les temps habituels"),
    (None, None, "Données insuffisantes"),
])
def test_phenology_shift(spark, mean, shift, message):
    values = [0.0] * 82 + [11.0, 50.0]  # above 10 on day 83
    df = series(spark, D(2023, 1, 1), {"pollen_a": values})
    row = last(k.with_phenology_shift(df.withColumn("mean_start", F.lit(mean).cast("double"))))
    assert (row["phenology_shift"], row["shift_message"]) == (shift, message)


def test_season_not_started_yet(spark):
    df = with_baseline(series(spark, D(2023, 1, 1), {"pollen_a": [10.0]}), mean_start=95.0)
    row = last(k.with_phenology_shift(df))
    assert (row["phenology_shift"], row["shift_message"]) == (None, "Données insuffisantes")


def test_peak_vs_history(spark):
    df = series(spark, D(2024, 4, 1), {"pollen_a": [520.0, 1.0], "pollen_b": [3.0, 2.0]})
    row = last(k.with_peak_vs_history(with_baseline(df, mean_peak=380.0)))
    assert round(row["peak_change"]) == 37 and row["peak_band"] == 2
    assert last(k.with_peak_vs_history(with_baseline(df, mean_peak=0.0)))["peak_change"] == 0.0


def test_yearly_means_skip_years_without_a_start(spark):
    df = daily(spark, [
        (1, D(2022, 4, 5), 20.0, 1.0, 0.0, 0.0, 0.0), (1, D(2022, 4, 6), 40.0, 9.0, 0.0, 0.0, 0.0),
        (1, D(2023, 4, 15), 8.0, 50.0, 0.0, 0.0, 0.0), (1, D(2024, 4, 24), 11.0, 1.0, 0.0, 0.0, 0.0),
    ])
    base = history.station_baseline(df).first()
    assert base["mean_total"] == pytest.approx((70 + 58 + 12) / 3)
    assert base["mean_start"] == pytest.approx((95 + 115) / 2)
    assert base["mean_peak"] == pytest.approx(max((40 + 8 + 11) / 3, (9 + 50 + 1) / 3))
    starts = {r["year"]: r["start_doy"] for r in history.season_start(df).collect()}
    assert starts == {2022: 95, 2023: None, 2024: 115}


def test_mean_around_a_day_without_history_of_its_own(spark):
    df = daily(spark, [(1, D(2023, 12, 28), 6.0, 1.0, 0.0, 0.0, 0.0)])  # day 362
    around = {r["doy"]: r["mean_a"] for r in history.windowed_mean(df).collect()}
    assert around[366] == 6.0 and around[355] == 6.0 and 354 not in around and 1 not in around
    wrapped = {r["doy"] for r in history.windowed_mean(df, wrap=True).collect()}
    assert 3 in wrapped and 4 not in wrapped


def test_bulletin_of_a_station_without_history(spark):
    df = series(spark, D(2024, 4, 1), {"pollen_a": [80.0]})
    other = series(spark, D(2023, 4, 1), {"pollen_a": [80.0]}, station=2)
    row = bulletin(df, other).first()
    assert row["season_progress"] == 0 and row["anomaly"] == 0.0 and row["peak_change"] == 0.0
    assert row["phenology_shift"] is None


def test_bulletin_of_one_date_equals_that_row_of_all(spark):
    values = [float((i * 13) % 90) for i in range(500)]
    df = series(spark, D(2022, 11, 1), {
        c: values for c in ("pollen_a", "pollen_b", "temperature", "precipitation", "wind")
    })
    target = D(2023, 5, 5)
    every = bulletin(df).filter(F.col("date") == target).collect()
    assert bulletin_at(df, target).collect() == every and len(every) == 1
    limited = bulletin(df, history_years=(2022, 2022)).filter(F.col("date") == target).first()
    past = max(values[:61])  # November and December 2022
    so_far = max(values[61:61 + 125])
    assert limited["peak_change"] == pytest.approx((so_far / past - 1) * 100)


def test_trend_and_overlay(spark):
    df = series(spark, D(2022, 3, 1), {"pollen_a": [float(i % 60) for i in range(800)]})
    trend = k.trend(df).collect()
    assert len(trend) == 30 and trend[-1]["date"] == D(2022, 3, 1) + dt.timedelta(days=799)
    assert all(r["pollen_a_above"] == (r["pollen_a"] > 30) for r in trend)
    overlay = k.year_overlay(df, D(2023, 5, 1)).collect()
    assert {r["year"] for r in overlay} == {2022, 2024}
    assert all(r["is_latest_year"] == (r["year"] == 2024) for r in overlay)
    assert {r["doy"] for r in overlay} == set(range(91, 152))


def test_advice_and_profiles(spark):
    df = spark.createDataFrame(
        [("Faible", "Faible", 1), ("À risque", "Faible", 3)], "label_a string, label_b string, horizon int"
    )
    got = lookups.advice(df).orderBy("horizon").collect()
    assert got[0]["good_hours"] == "Toute la journée" and got[0]["avoid_hours"] is None
    assert got[0]["when"] == "Demain" and got[0]["any_risk"] is False
    assert got[1]["avoid_hours"] == "10h – 18h" and got[1]["advice"].startswith("Le bouleau est actif")
    p = spark.createDataFrame([(0.5, 0.3)], "proba_a double, proba_b double")
    labels = [(r["threshold"], r["label_a"], r["label_b"])
              for r in lookups.profile_expand(p).collect()]
    assert labels == [(0.7, "Faible", "Faible"), (0.5, "À risque", "Faible"),
                      (0.3, "À risque", "À risque")]
