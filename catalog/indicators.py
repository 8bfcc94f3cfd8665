"""History and seasonal indicators, for all stations and dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bloomtide.fixed_values import POLLEN
from bloomtide.functions import risk
from bloomtide.operators import history, indicators, lookups
from bloomtide.plans.bulletin import bulletin as all_indicators, bulletin_at, with_baselines
from catalog.registry import query, r, rounded, rs
from catalog.views import LONG_DAYS, PARTS, TARGET, days, stored_days

YEARLY = LONG_DAYS + PARTS + """,
yearly AS (
  SELECT station, year, sum(pollen_a) + sum(pollen_b) AS total, max(pollen_a) AS peak_a,
         max(pollen_b) AS peak_b, min(CASE WHEN pollen_a > 10 THEN doy END) AS start_doy
  FROM parts GROUP BY 1, 2),
baseline AS (
  SELECT station, avg(total) AS mean_total, avg(peak_a) AS mean_peak_a,
         avg(peak_b) AS mean_peak_b,
         CASE WHEN avg(peak_a) > avg(peak_b) THEN avg(peak_a) ELSE avg(peak_b) END AS mean_peak,
         avg(start_doy) AS mean_start
  FROM yearly GROUP BY 1)
"""

AROUND = """,
doys AS (SELECT CAST(unnest(range(1, 367)) AS INTEGER) AS doy),
around AS (
  SELECT p.station, d.doy, avg(p.pollen_a) AS mean_a, avg(p.pollen_b) AS mean_b
  FROM doys d JOIN parts p ON p.doy BETWEEN d.doy - 7 AND d.doy + 7 GROUP BY 1, 2)
"""

# Every indicator with running values, one row per station and date.
ALL = YEARLY + AROUND + """,
run AS (
  SELECT p.*, b.mean_total, b.mean_peak, b.mean_start, a.mean_a, a.mean_b,
    coalesce(sum(p.precipitation) OVER (PARTITION BY p.station ORDER BY p.date
             ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) AS rain3,
    coalesce(sum(CASE WHEN temperature < 5 THEN 0.0 ELSE temperature - 5 END) OVER y, 0) AS heat,
    sum(pollen_a) OVER y + sum(pollen_b) OVER y AS pollen_ytd,
    greatest(max(pollen_a) OVER y, max(pollen_b) OVER y) AS peak_ytd,
    min(CASE WHEN pollen_a > 10 THEN p.doy END) OVER y AS season_start_doy
  FROM parts p LEFT JOIN baseline b ON p.station = b.station
  LEFT JOIN around a ON p.station = a.station AND p.doy = a.doy
  WINDOW y AS (PARTITION BY p.station, p.year ORDER BY p.date ROWS UNBOUNDED PRECEDING)),
k AS (
  SELECT *,
    CASE WHEN pollen_a > pollen_b THEN '🌳 Bouleau' WHEN pollen_b > pollen_a THEN '🌾 Graminées'
         ELSE 'Égalité' END AS dominant,
    CASE WHEN pollen_a > pollen_b THEN pollen_a ELSE pollen_b END AS dominant_value,
    least(round(coalesce(wind, 0) / 50 * 10, 1), 10.0) AS wind_index,
    least(CAST(trunc(rain3 / 15 * 100 + sign(rain3 / 15 * 100) * 1e-9) AS BIGINT), 100) AS washout_score,
    CAST(trunc(heat + sign(heat) * 1e-9) AS BIGINT) AS heat_sum,
    CASE WHEN mean_total > 0 THEN least(CAST(trunc(pollen_ytd / mean_total * 100 + sign(pollen_ytd / mean_total * 100) * 1e-9) AS BIGINT), 100)
         ELSE 0 END AS season_progress,
    (CASE WHEN mean_a > 0 THEN (pollen_a - mean_a) / mean_a * 100 ELSE 0 END
     + CASE WHEN mean_b > 0 THEN (pollen_b - mean_b) / mean_b * 100 ELSE 0 END) / 2 AS anomaly,
    CAST(trunc(mean_start - season_start_doy + sign(mean_start - season_start_doy) * 1e-9) AS BIGINT) AS phenology_shift,
    CASE WHEN mean_peak > 0 THEN (peak_ytd / mean_peak - 1) * 100 ELSE 0 END AS peak_change
  FROM run)
"""

SQL = {
    "dominant": f"dominant, {r('dominant_value')}",
    "wind": f"""{r('wind_index')},
    CASE WHEN wind_index < 4 THEN 'Air calme — pollen concentré localement'
         WHEN wind_index < 7 THEN 'Vent modéré — pollen dispersé sur plusieurs km'
         ELSE 'Vent fort — pollen transporté très loin' END AS wind_message""",
    "washout": """washout_score,
    CASE WHEN washout_score < 20 THEN 'Air sec — pollen non lavé'
         WHEN washout_score < 60 THEN 'Lessivage partiel de l''atmosphère'
         ELSE 'Pluie récente — air bien nettoyé ✨' END AS washout_message""",
    "heat": """heat_sum, heat_sum >= 300 AS heat_reached,
    CASE WHEN heat_sum < 300 THEN 300 - heat_sum ELSE 0 END AS heat_remaining,
    CASE WHEN heat_sum >= 300 THEN 'Seuil bouleau (300°C·j) atteint — floraison active'
         ELSE (300 - heat_sum) || '°C·j avant le seuil de floraison' END AS heat_message""",
    "progress": """season_progress,
    CASE WHEN season_progress < 60 THEN 0 WHEN season_progress < 85 THEN 1 ELSE 2 END
      AS progress_band,
    season_progress > 65 AS past_peak,
    CASE WHEN season_progress > 65 THEN 'Le plus dur est passé 🎉' ELSE 'Saison en cours' END
      AS progress_message""",
    "anomaly": f"""{r('anomaly')},
    CASE WHEN mean_a IS NULL AND mean_b IS NULL THEN 'Données insuffisantes'
         WHEN abs(anomaly) < 15 THEN 'Dans la normale saisonnière'
         WHEN anomaly > 0 THEN printf('Saison %+.0f%% au-dessus de la normale', anomaly)
         ELSE printf('Saison %+.0f%% en dessous de la normale', anomaly) END AS anomaly_message""",
    "shift": """season_start_doy, phenology_shift,
    CASE WHEN phenology_shift IS NULL THEN 'Données insuffisantes'
         WHEN phenology_shift > 3 THEN phenology_shift || ' jours d''avance sur la moyenne'
         WHEN phenology_shift < -3 THEN (-phenology_shift) || ' jours de retard sur la moyenne'
         ELSE 'Démarrage dans les temps habituels' END AS shift_message""",
    "peak": f"""{r('peak_ytd')}, {r('peak_change')},
    CASE WHEN peak_change > 20 THEN 2 WHEN peak_change < -20 THEN 0 ELSE 1 END AS peak_band""",
}
COLUMNS = {
    "dominant": ["dominant", "dominant_value"],
    "wind": ["wind_index", "wind_message"],
    "washout": ["washout_score", "washout_message"],
    "heat": ["heat_sum", "heat_reached", "heat_remaining", "heat_message"],
    "progress": ["season_progress", "progress_band", "past_peak", "progress_message"],
    "anomaly": ["anomaly", "anomaly_message"],
    "shift": ["season_start_doy", "phenology_shift", "shift_message"],
    "peak": ["peak_ytd", "peak_change", "peak_band"],
}


def _oracle(*groups: str) -> str:
    return f"WITH {ALL} SELECT station, date, {', '.join(SQL[g] for g in groups)} FROM k"


def _result(df, *groups: str):
    return rounded(df.select("station", "date", *[c for g in groups for c in COLUMNS[g]]))


def _with_history(spark, sf_dir):
    table = stored_days(spark, sf_dir)
    return with_baselines(table, table)


# --- history -----------------------------------------------------------------

@query(f"WITH {YEARLY} SELECT station, {r('mean_total')} FROM baseline")
def annual_total_mean(spark, sf_dir):
    return rounded(history.annual_total_mean(days(spark, sf_dir)))


@query(f"WITH {YEARLY} SELECT station, {rs('mean_peak_a', 'mean_peak_b', 'mean_peak')} FROM baseline")
def annual_peak_mean(spark, sf_dir):
    return rounded(history.annual_peak_mean(days(spark, sf_dir)))


@query(f"WITH {YEARLY} SELECT station, year, start_doy FROM yearly")
def season_start(spark, sf_dir):
    return history.season_start(days(spark, sf_dir))


@query(f"WITH {YEARLY} SELECT station, {r('mean_start')} FROM baseline")
def season_start_mean(spark, sf_dir):
    return rounded(history.season_start_mean(days(spark, sf_dir)))


@query(f"WITH {YEARLY}{AROUND} SELECT station, doy, {rs('mean_a', 'mean_b')} FROM around")
def windowed_mean(spark, sf_dir):
    return rounded(history.windowed_mean(days(spark, sf_dir)))


@query(f"""WITH {LONG_DAYS} SELECT station, {r('sum(pollen_a) + sum(pollen_b)', 'total')},
{r('greatest(max(pollen_a), max(pollen_b))', 'peak')} FROM days
WHERE date BETWEEN DATE '2001-01-01' AND DATE '2001-04-15' GROUP BY station""")
def year_to_date_totals(spark, sf_dir):
    return rounded(history.year_to_date_totals(days(spark, sf_dir), TARGET))


@query(f"""WITH {YEARLY} SELECT p.station, p.date, {r('p.pollen_a', 'pollen_a')},
{r('b.mean_total', 'mean_total')}, {r('b.mean_peak', 'mean_peak')},
{r('b.mean_start', 'mean_start')} FROM parts p LEFT JOIN baseline b ON p.station = b.station""")
def attach_baseline(spark, sf_dir):
    table = stored_days(spark, sf_dir)
    return rounded(lookups.attach_baseline(
        table.select("station", "date", "pollen_a"), history.station_baseline(table)
    ))


# --- lookups -----------------------------------------------------------------

_ADVICE_SQL = """CASE label_a || '|' || label_b
  WHEN 'Faible|Faible' THEN 'Bonne nouvelle ! Les deux types de pollen sont à des niveaux bas. Profitez de l''extérieur en toute tranquillité.'
  WHEN 'Faible|À risque' THEN 'Prudence avec les graminées. Évitez les pelouses entre 12h–17h et pensez à votre traitement si vous êtes allergique.'
  WHEN 'À risque|Faible' THEN 'Le bouleau est actif aujourd''hui. Gardez les fenêtres fermées, prenez votre traitement le matin et préférez sortir tôt ou en soirée.'
  ELSE 'Journée difficile pour les allergiques ! Prenez votre traitement dès le matin, gardez les fenêtres fermées et limitez les sorties entre 10h et 18h.' END AS advice"""
_LABELS_SQL = """SELECT station, date, CAST(1 + day(date) % 3 AS INTEGER) AS horizon,
  CASE WHEN pollen_a > 30 THEN 'À risque' ELSE 'Faible' END AS label_a,
  CASE WHEN pollen_b > 30 THEN 'À risque' ELSE 'Faible' END AS label_b FROM days"""


def _labelled(spark, sf_dir):
    return days(spark, sf_dir).select(
        "station", "date", (1 + F.day("date") % 3).alias("horizon"), *[
            risk.label_of_class(risk.risk_binary(f"pollen_{s}")).alias(f"label_{s}")
            for s in "ab"
        ]
    )


@query(f"WITH {LONG_DAYS}, l AS ({_LABELS_SQL}) SELECT station, date, label_a, label_b, {_ADVICE_SQL} FROM l")
def advice_lookup(spark, sf_dir):
    return lookups.advice_lookup(_labelled(spark, sf_dir).drop("horizon"))


@query(f"""WITH {LONG_DAYS}, l AS ({_LABELS_SQL}) SELECT *, {_ADVICE_SQL},
label_a = 'À risque' OR label_b = 'À risque' AS any_risk,
CASE WHEN 'À risque' IN (label_a, label_b) THEN 'À risque' ELSE 'Faible' END AS worst,
CASE WHEN 'À risque' IN (label_a, label_b) THEN 'Avant 9h · Après 19h' ELSE 'Toute la journée' END
  AS good_hours,
CASE WHEN 'À risque' IN (label_a, label_b) THEN '10h – 18h' END AS avoid_hours,
['Demain', 'Dans 2 jours', 'Dans 3 jours'][horizon] AS "when",
['⭐⭐⭐ Très fiable', '⭐⭐ Fiable', '⭐ Estimation'][horizon] AS reliability FROM l""")
def advice(spark, sf_dir):
    return lookups.advice(_labelled(spark, sf_dir))


@query(f"""WITH {LONG_DAYS},
p AS (SELECT station, date, pollen_a / 50 AS proba_a,
             least(pollen_b / 100, 1.0) AS proba_b FROM days),
t AS (SELECT unnest(['Peu sensible 😊', 'Sensibilité normale 😐', 'Très sensible 😰']) AS profile,
             unnest([0.7, 0.5, 0.3]::DOUBLE[]) AS threshold)
SELECT station, date, {rs('proba_a', 'proba_b')}, profile, {r('threshold')},
       CASE WHEN proba_a >= threshold THEN 'À risque' ELSE 'Faible' END AS label_a,
       CASE WHEN proba_b >= threshold THEN 'À risque' ELSE 'Faible' END AS label_b
FROM p CROSS JOIN t""")
def profile_expand(spark, sf_dir):
    scored = days(spark, sf_dir).select(
        "station", "date", (F.col("pollen_a") / 50).alias("proba_a"),
        F.least(F.col("pollen_b") / 100, F.lit(1.0)).alias("proba_b"),
    )
    return rounded(lookups.profile_expand(scored))


# --- indicators --------------------------------------------------------------

@query(_oracle("dominant"))
def dominant_taxon(spark, sf_dir):
    return _result(indicators.with_dominant_taxon(days(spark, sf_dir)), "dominant")


@query(_oracle("wind"))
def wind_index(spark, sf_dir):
    return _result(indicators.with_wind_index(days(spark, sf_dir)), "wind")


@query(_oracle("washout"))
def washout_score(spark, sf_dir):
    return _result(indicators.with_washout_score(days(spark, sf_dir)), "washout")


@query(_oracle("heat"))
def heat_sum(spark, sf_dir):
    return _result(indicators.with_heat_sum(days(spark, sf_dir)), "heat")


@query(_oracle("progress"))
def season_progress(spark, sf_dir):
    return _result(indicators.with_season_progress(_with_history(spark, sf_dir)), "progress")


@query(_oracle("anomaly"))
def seasonal_anomaly(spark, sf_dir):
    return _result(indicators.with_seasonal_anomaly(_with_history(spark, sf_dir)), "anomaly")


@query(_oracle("shift"))
def phenology_shift(spark, sf_dir):
    return _result(indicators.with_phenology_shift(_with_history(spark, sf_dir)), "shift")


@query(_oracle("peak"))
def peak_vs_history(spark, sf_dir):
    return _result(indicators.with_peak_vs_history(_with_history(spark, sf_dir)), "peak")


@query(_oracle(*SQL))
def bulletin(spark, sf_dir):
    return rounded(all_indicators(stored_days(spark, sf_dir)))


@query(_oracle(*SQL) + " WHERE date = DATE '2001-04-15'")
def bulletin_of_one_date(spark, sf_dir):
    return rounded(bulletin_at(stored_days(spark, sf_dir), TARGET))


# Stations that end at different dates, most of them in the year before the target.
_CUT = " WHERE date <= DATE '2001-02-01' - CAST(station * 60 AS INTEGER)"
_CUT_ALL = ALL.replace(PARTS, PARTS.replace("FROM days)", f"FROM days{_CUT})"))


@query(f"""WITH {_CUT_ALL} SELECT station, date, {', '.join(SQL[g] for g in SQL)} FROM (
SELECT *, row_number() OVER (PARTITION BY station
  ORDER BY CASE WHEN date = DATE '2001-01-20' THEN 0 ELSE 1 END, date DESC) AS rk FROM k) q WHERE rk = 1""")
def bulletin_of_date_without_row(spark, sf_dir):
    table = stored_days(spark, sf_dir)
    end = F.date_sub(F.lit(dt.date(2001, 2, 1)), (F.col("station") * 60).cast("int"))
    return rounded(bulletin_at(table.filter(F.col("date") <= end), dt.date(2001, 1, 20)))


@query(f"WITH {ALL.replace('JOIN parts p ON', 'JOIN parts p ON p.station > 0 AND')} "
       f"SELECT station, date, {SQL['anomaly']} FROM k")
def anomaly_without_history(spark, sf_dir):
    """One station has no history."""
    table = stored_days(spark, sf_dir)
    return _result(indicators.with_seasonal_anomaly(with_baselines(table, table.filter("station > 0"))), "anomaly")


@query(f"""WITH {LONG_DAYS} SELECT station, date, {rs(*POLLEN)}, pollen_a > 30 AS pollen_a_above,
pollen_b > 30 AS pollen_b_above FROM (
SELECT *, row_number() OVER (PARTITION BY station ORDER BY date DESC) AS k FROM days) q
WHERE k <= 30""")
def trend_30d(spark, sf_dir):
    return rounded(indicators.trend(days(spark, sf_dir)))


@query(f"""WITH {LONG_DAYS}{PARTS},
n AS (SELECT * FROM parts WHERE doy BETWEEN 75 AND 135 AND year <> 2001)
SELECT station, year, doy, {rs(*POLLEN)},
       year = max(year) OVER (PARTITION BY station) AS is_latest_year FROM n""")
def year_overlay(spark, sf_dir):
    return rounded(indicators.year_overlay(days(spark, sf_dir), TARGET))
