"""Filters, joins, daily tables, windows, rows at a date, features and targets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bloomtide.fixed_values import FEATURES as FEATURE_LIST, POLLEN, WEATHER_FEATURES
from bloomtide.functions import calendar, numeric, risk
from bloomtide.operators import (
    cleaning, daily, features, filters, gaps, profiling, topk, windows,
)
from bloomtide.plans import loading
from bloomtide.session import scratch_path
from catalog.registry import query, r, rounded, rs
from catalog.views import (
    CALENDAR, FEATURES, FEEDS, HOURLY_DAILY, HOURLY_DAYS, HOURLY_TARGET, LAST_TRAIN_YEAR, LONG_DAYS, PARTS,
    TARGET, TARGETS, class3, days, hourly_days, pollen, stored_days, weather,
)

FIVE = "pollen_a, pollen_b, temperature, precipitation, wind"
FIVE_R = rs("pollen_a", "pollen_b", "temperature", "precipitation", "wind")
W = "WINDOW w AS (PARTITION BY station ORDER BY date)"


# --- flagship: two hourly feeds to labelled features -------------------------

@query(f"""WITH {HOURLY_DAYS}{PARTS},
heat AS (SELECT *, CASE WHEN temperature IS NOT NULL THEN greatest(temperature - 5, 0) END AS g
         FROM parts)
SELECT station, date, {FIVE_R}, year, month, doy,
       CAST((month % 12) // 3 AS INTEGER) AS season,
       {r("lag(temperature) OVER w", "temp_lag1")},
       {r("CASE WHEN count(temperature) OVER w7 = 7 THEN avg(temperature) OVER w7 END", "temp_roll7")},
       {r("CASE WHEN count(precipitation) OVER w7 = 7 THEN sum(precipitation) OVER w7 END", "precip_roll7")},
       {r("CASE WHEN count(wind) OVER w7 = 7 THEN avg(wind) OVER w7 END", "wind_roll7")},
       {r("CASE WHEN count(pollen_a) OVER w3 = 3 THEN avg(pollen_a) OVER w3 END", "pollen_a_mean3")},
       {r("CASE WHEN count(pollen_b) OVER w3 = 3 THEN avg(pollen_b) OVER w3 END", "pollen_b_mean3")},
       {r("CASE WHEN g IS NOT NULL THEN sum(g) OVER wy END", "gdd_cumul")},
       lead({class3("pollen_a")}) OVER w AS risk_pollen_a_next,
       lead({class3("pollen_b")}) OVER w AS risk_pollen_b_next
FROM heat
WINDOW w AS (PARTITION BY station ORDER BY date),
       w7 AS (PARTITION BY station ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
       w3 AS (PARTITION BY station ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
       wy AS (PARTITION BY station, year ORDER BY date
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def hourly_feature_table(spark, sf_dir):
    table = features.feature_table(hourly_days(spark, sf_dir))
    labelled = windows.lead_target(
        table.withColumns({f"risk_{p}": risk.risk_class3(p) for p in POLLEN}),
        {f"risk_{p}_next": f"risk_{p}" for p in POLLEN},
    )
    return rounded(labelled.select(
        "station", "date", *FIVE.split(", "), "year", "month", "doy", "season", "temp_lag1",
        "temp_roll7", "precip_roll7", "wind_roll7", "pollen_a_mean3", "pollen_b_mean3",
        "gdd_cumul", "risk_pollen_a_next", "risk_pollen_b_next",
    ))


# --- filters -----------------------------------------------------------------

INTEGER_FEATURES = ("season", "year")


def _feature_columns(names) -> str:
    return ", ".join(
        f"CAST({c} AS INTEGER) AS {c}" if c in INTEGER_FEATURES else r(c) for c in names
    )


@query(f"WITH {FEATURES} SELECT {_feature_columns(FEATURE_LIST)} FROM complete")
def select_features(spark, sf_dir):
    table = cleaning.drop_incomplete(features.feature_table(days(spark, sf_dir)))
    return rounded(features.select_features(table))


@query(f"WITH {FEATURES} SELECT station, date, {_feature_columns(WEATHER_FEATURES)} FROM complete")
def select_weather_features(spark, sf_dir):
    table = cleaning.drop_incomplete(features.feature_table(days(spark, sf_dir)))
    return rounded(features.select_features(table, WEATHER_FEATURES, also=("station", "date")))


@query(f"""WITH {FEEDS} SELECT station, ts, {FIVE_R} FROM joined
WHERE ts > TIMESTAMP '2024-01-20 23:00:00'""")
def filter_after(spark, sf_dir):
    joined = daily.join_hourly(pollen(spark, sf_dir), weather(spark, sf_dir))
    return rounded(filters.filter_after(joined, "2024-01-20 23:00:00"))


@query(f"""WITH {LONG_DAYS} SELECT station, date, {FIVE_R},
CASE WHEN year(date) <= 1999 THEN 'train' ELSE 'test' END AS split FROM days""")
def year_split(spark, sf_dir):
    train, test = features.year_split(days(spark, sf_dir), LAST_TRAIN_YEAR)
    return rounded(train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test"))
    ))


@query(f"""WITH {LONG_DAYS} SELECT station, date, {rs('pollen_a', 'pollen_b')} FROM days
WHERE dayofyear(date) BETWEEN 105 - 7 AND 105 + 7""")
def doy_window(spark, sf_dir):
    near = filters.doy_window(days(spark, sf_dir), TARGET, 7)
    return rounded(near.select("station", "date", *POLLEN))


@query(f"""WITH {LONG_DAYS} SELECT station, date, {rs('pollen_a', 'pollen_b')} FROM days
WHERE date BETWEEN DATE '2001-01-01' AND DATE '2001-04-15'""")
def year_to_date(spark, sf_dir):
    rows = filters.year_to_date(days(spark, sf_dir), TARGET)
    return rounded(rows.select("station", "date", *POLLEN))


@query(f"""WITH {FEEDS} SELECT station, ts, coalesce(pollen_a, 0) AS pollen_a,
coalesce(pollen_b, 0) AS pollen_b FROM pollen_hourly""")
def fill_constant(spark, sf_dir):
    return cleaning.fill_constant(pollen(spark, sf_dir), POLLEN)


@query(f"""WITH {FEEDS} SELECT station, ts, {FIVE_R} FROM joined
WHERE pollen_a IS NOT NULL AND pollen_b IS NOT NULL AND temperature IS NOT NULL
  AND precipitation IS NOT NULL AND wind IS NOT NULL""")
def drop_incomplete(spark, sf_dir):
    joined = daily.join_hourly(pollen(spark, sf_dir), weather(spark, sf_dir))
    return rounded(cleaning.drop_incomplete(joined))


_LABELS = """SELECT station, date,
  CASE WHEN pollen_a > 30 THEN 'À risque' ELSE 'Faible' END AS label_a,
  CASE WHEN pollen_b > 30 THEN 'À risque' ELSE 'Faible' END AS label_b FROM days"""


def _labels(spark, sf_dir):
    return days(spark, sf_dir).select("station", "date", *[
        risk.label_of_class(risk.risk_binary(f"pollen_{s}")).alias(f"label_{s}") for s in "ab"
    ])


@query(f"""WITH {LONG_DAYS}, l AS ({_LABELS})
SELECT *, label_a = 'À risque' OR label_b = 'À risque' AS any_risk,
       CASE WHEN 'À risque' IN (label_a, label_b) THEN 'À risque' ELSE 'Faible' END AS worst
FROM l""")
def any_at_risk(spark, sf_dir):
    return _labels(spark, sf_dir).withColumns({
        "any_risk": risk.any_at_risk("label_a", "label_b"),
        "worst": risk.worst_label("label_a", "label_b"),
    })


# --- joins -------------------------------------------------------------------

@query(f"WITH {FEEDS} SELECT station, ts, {FIVE_R} FROM joined")
def join_hourly(spark, sf_dir):
    return rounded(daily.join_hourly(pollen(spark, sf_dir), weather(spark, sf_dir)))


@query(f"""WITH {FEEDS},
a AS (SELECT ts, count(*) AS n_pollen FROM pollen_hourly WHERE pollen_a > 80 GROUP BY 1),
b AS (SELECT ts, count(*) AS n_wind FROM weather_hourly WHERE wind > 60 GROUP BY 1)
SELECT coalesce(a.ts, b.ts) AS ts, n_pollen, n_wind FROM a FULL JOIN b ON a.ts = b.ts""")
def align_profiles(spark, sf_dir):
    high = pollen(spark, sf_dir).filter("pollen_a > 80").groupBy("ts").agg(
        F.count("*").alias("n_pollen"))
    windy = weather(spark, sf_dir).filter("wind > 60").groupBy("ts").agg(
        F.count("*").alias("n_wind"))
    return profiling.align_profiles(high, windy, "ts")


# --- daily tables ------------------------------------------------------------

@query(f"WITH {HOURLY_DAILY} SELECT station, date, {FIVE_R} FROM daily")
def daily_aggregate(spark, sf_dir):
    joined = daily.join_hourly(pollen(spark, sf_dir), weather(spark, sf_dir))
    return rounded(daily.daily_aggregate(joined))


@query(f"WITH {HOURLY_DAYS} SELECT station, date, {FIVE_R} FROM days")
def daily_calendar(spark, sf_dir):
    return rounded(hourly_days(spark, sf_dir))


@query(f"WITH {LONG_DAYS} SELECT station, date, {FIVE_R} FROM days")
def daily_calendar_long(spark, sf_dir):
    return rounded(days(spark, sf_dir))


@query(f"""WITH {FEEDS},
d AS (SELECT station, CAST(ts AS DATE) AS date, max(pollen_a) AS pollen_a,
             max(pollen_b) AS pollen_b FROM pollen_hourly GROUP BY 1, 2),
s AS (SELECT station, min(date) AS lo, max(date) AS hi FROM d GROUP BY 1),
c AS (SELECT station, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
             INTERVAL 1 DAY)) AS DATE) AS date FROM s)
SELECT c.station, c.date, coalesce(pollen_a, 0) AS pollen_a, coalesce(pollen_b, 0) AS pollen_b,
       CAST(year(c.date) AS INTEGER) AS year, CAST(dayofyear(c.date) AS INTEGER) AS doy
FROM c LEFT JOIN d ON c.station = d.station AND c.date = d.date""")
def daily_pollen_history(spark, sf_dir):
    return daily.daily_pollen_history(pollen(spark, sf_dir))


@query(f"""WITH {HOURLY_DAYS}
SELECT station, date, {FIVE_R},
       CASE WHEN date <= DATE '2024-01-28' THEN 'archive' ELSE 'forecast' END AS origin
FROM days WHERE date <= DATE '2024-01-28' OR date >= DATE '2024-01-27'""")
def archive_plus_forecast(spark, sf_dir):
    table = hourly_days(spark, sf_dir)
    archive = table.filter(F.col("date") <= F.lit(HOURLY_TARGET))
    forecast = table.filter(F.col("date") >= F.date_sub(F.lit(HOURLY_TARGET), 1))
    return rounded(daily.archive_plus_forecast(archive, forecast))


@query(f"""WITH {FEEDS},
daily AS (
  SELECT station, CAST(ts AS DATE) AS date, max(pollen_a) AS pollen_a, max(pollen_b) AS pollen_b,
         avg(temperature) AS temperature, coalesce(sum(precipitation), 0) AS precipitation,
         avg(wind) AS wind
  FROM joined WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-28'
  GROUP BY 1, 2){CALENDAR} SELECT station, date, {FIVE_R} FROM days""")
def daily_for_date(spark, sf_dir):
    table = loading.daily_for_date(
        pollen(spark, sf_dir), weather(spark, sf_dir), HOURLY_TARGET, days=20
    )
    return rounded(table)


@query(f"""WITH {FEEDS},
daily AS (SELECT station, CAST(ts AS DATE) AS date, max(pollen_a) AS pollen_a,
  max(pollen_b) AS pollen_b, 0.0 AS temperature, 0.0 AS precipitation, 0.0 AS wind
  FROM pollen_hourly GROUP BY 1, 2){CALENDAR}
SELECT station, date, pollen_a, pollen_b, CAST(year(date) AS INTEGER) AS year,
       CAST(dayofyear(date) AS INTEGER) AS doy, 'api' AS source FROM days""")
def pollen_history(spark, sf_dir):
    return loading.pollen_history(
        spark, [("api", lambda s: pollen(s, sf_dir))], cache_path=scratch_path(spark, "history")
    )


# --- windows -----------------------------------------------------------------

@query(f"""WITH {LONG_DAYS} SELECT station, date,
{r("lag(temperature, 1) OVER w", "temp_lag1")}, {r("lag(wind, 1) OVER w", "wind_lag1")},
{r("lag(precipitation, 1) OVER w", "precip_lag1")},
{r("lag(precipitation, 2) OVER w", "precip_lag2")},
{r("lag(pollen_a, 1) OVER w", "pollen_a_lag1")}, {r("lag(pollen_a, 3) OVER w", "pollen_a_lag3")},
{r("lag(pollen_b, 2) OVER w", "pollen_b_lag2")} FROM days {W}""")
def lags(spark, sf_dir):
    spec = {
        "temp_lag1": ("temperature", 1), "wind_lag1": ("wind", 1),
        "precip_lag1": ("precipitation", 1), "precip_lag2": ("precipitation", 2),
        "pollen_a_lag1": ("pollen_a", 1), "pollen_a_lag3": ("pollen_a", 3),
        "pollen_b_lag2": ("pollen_b", 2),
    }
    return rounded(windows.lags(days(spark, sf_dir), spec).select("station", "date", *spec))


def _full(agg: str, column: str, n: int, frame: str) -> str:
    return f"CASE WHEN count({column}) OVER {frame} = {n} THEN {agg}({column}) OVER {frame} END"


@query(f"""WITH {LONG_DAYS} SELECT station, date,
{r(_full("avg", "temperature", 7, "w7"), "temp_roll7")},
{r(_full("avg", "wind", 7, "w7"), "wind_roll7")},
{r(_full("sum", "precipitation", 7, "w7"), "precip_roll7")},
{r(_full("avg", "pollen_a", 3, "w3"), "pollen_a_mean3")},
{r(_full("avg", "pollen_b", 3, "w3"), "pollen_b_mean3")}
FROM days
WINDOW w7 AS (PARTITION BY station ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
       w3 AS (PARTITION BY station ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def rolling_prev(spark, sf_dir):
    spec = {
        "temp_roll7": ("temperature", 7, "mean"), "wind_roll7": ("wind", 7, "mean"),
        "precip_roll7": ("precipitation", 7, "sum"), "pollen_a_mean3": ("pollen_a", 3, "mean"),
        "pollen_b_mean3": ("pollen_b", 3, "mean"),
    }
    return rounded(windows.rolling_prev(days(spark, sf_dir), spec).select("station", "date", *spec))


@query(f"""WITH {LONG_DAYS} SELECT station, date,
{r(_full("avg", "temperature", 3, "w3"), "temp_mean3")},
{r(_full("avg", "pollen_a", 3, "w3"), "pollen_a_mean3")}
FROM days
WINDOW w3 AS (PARTITION BY station ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def rolling_incl(spark, sf_dir):
    spec = {"temp_mean3": ("temperature", 3, "mean"), "pollen_a_mean3": ("pollen_a", 3, "mean")}
    return rounded(windows.rolling_incl(days(spark, sf_dir), spec).select("station", "date", *spec))


def _gdd(partition: str) -> str:
    return f"""WITH {LONG_DAYS},
g AS (SELECT station, date, CASE WHEN temperature < 5 THEN 0.0 ELSE temperature - 5 END AS gdd_daily
      FROM days)
SELECT station, date, {r("gdd_daily")},
{r(f"CASE WHEN gdd_daily IS NOT NULL THEN sum(gdd_daily) OVER (PARTITION BY {partition} ORDER BY date ROWS UNBOUNDED PRECEDING) END", "gdd_cumul")}
FROM g"""


@query(_gdd("station, year(date)"))
def gdd_by_year(spark, sf_dir):
    table = windows.gdd_by_year(days(spark, sf_dir))
    return rounded(table.select("station", "date", "gdd_daily", "gdd_cumul"))


@query(_gdd("station"))
def gdd_running(spark, sf_dir):
    table = windows.gdd_running(days(spark, sf_dir))
    return rounded(table.select("station", "date", "gdd_daily", "gdd_cumul"))


@query(f"""WITH {LONG_DAYS} SELECT station, date, {r("lead(pollen_a) OVER w", "next_a")},
{r("lead(pollen_b) OVER w", "next_b")} FROM days {W}""")
def lead_target(spark, sf_dir):
    table = windows.lead_target(
        days(spark, sf_dir), {"next_a": "pollen_a", "next_b": "pollen_b"}
    )
    return rounded(table.select("station", "date", "next_a", "next_b"))


@query(f"""WITH {FEEDS} SELECT station, ts,
CAST(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY station ORDER BY ts)) AS BIGINT) AS step_seconds
FROM weather_hourly""")
def step_diff(spark, sf_dir):
    return gaps.step_diff(weather(spark, sf_dir).select("station", "ts"))


@query(f"""WITH {FEEDS},
f AS (SELECT station, ts, pollen_a IS NULL AS missing FROM pollen_hourly),
c AS (SELECT *, missing IS DISTINCT FROM lag(missing) OVER (PARTITION BY station ORDER BY ts) AS ch
      FROM f)
SELECT station, ts, missing, CAST(sum(CASE WHEN ch THEN 1 ELSE 0 END)
  OVER (PARTITION BY station ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM c""")
def change_blocks(spark, sf_dir):
    flagged = pollen(spark, sf_dir).select(
        "station", "ts", F.col("pollen_a").isNull().alias("missing")
    )
    return gaps.change_blocks(flagged, "missing")


@query(f"""WITH {LONG_DAYS}, n AS (SELECT station, year(date) AS y, count(*) AS n FROM days
GROUP BY 1, 2)
SELECT station, CAST(y AS INTEGER) AS year, n, CAST(sum(n) OVER (PARTITION BY station ORDER BY y) AS BIGINT) AS total FROM n""")
def running_total(spark, sf_dir):
    counts = days(spark, sf_dir).groupBy("station", F.year("date").alias("year")).agg(
        F.count("*").alias("n")
    )
    return gaps.running_total(counts, "n", order="year", out="total")


# --- rows at a date ----------------------------------------------------------

@query(f"""WITH {LONG_DAYS} SELECT station, date, {FIVE_R} FROM (
SELECT *, row_number() OVER (PARTITION BY station ORDER BY date DESC) AS k FROM days) q
WHERE k <= 3""")
def latest_n(spark, sf_dir):
    return rounded(topk.latest_n(days(spark, sf_dir), 3))


@query(f"""WITH {LONG_DAYS} SELECT station, date, {FIVE_R} FROM (
SELECT *, row_number() OVER (PARTITION BY station
  ORDER BY CASE WHEN date = DATE '2001-11-02' THEN 0 ELSE 1 END, date DESC) AS k FROM days) q
WHERE k = 1""")
def row_at_or_last(spark, sf_dir):
    return rounded(topk.row_at_or_last(days(spark, sf_dir), dt.date(2001, 11, 2)))


@query(f"WITH {LONG_DAYS} SELECT station, date, {FIVE_R} FROM days WHERE date = DATE '2001-04-15'")
def row_exact_or_fail(spark, sf_dir):
    return rounded(topk.row_exact_or_fail(stored_days(spark, sf_dir), TARGET))


@query(f"""WITH {LONG_DAYS} SELECT station, date, {FIVE_R} FROM days
WHERE date = DATE '2001-04-14'""")
def previous_row(spark, sf_dir):
    return rounded(topk.previous_row(days(spark, sf_dir), TARGET))


# --- scalar functions --------------------------------------------------------

@query(f"WITH {LONG_DAYS}{PARTS} SELECT DISTINCT date, doy, month, year FROM parts")
def calendar_parts(spark, sf_dir):
    dates = days(spark, sf_dir).select("date").distinct()
    return dates.withColumns(calendar.calendar_parts())


@query(f"""WITH {LONG_DAYS} SELECT DISTINCT date, CASE WHEN month(date) IN (12, 1, 2) THEN 0
WHEN month(date) IN (3, 4, 5) THEN 1 WHEN month(date) IN (6, 7, 8) THEN 2 ELSE 3 END AS season
FROM days""")
def season(spark, sf_dir):
    return days(spark, sf_dir).select("date").distinct().withColumn(
        "season", calendar.season(F.month("date"))
    )


@query(f"""WITH {LONG_DAYS} SELECT DISTINCT date,
{r("sin(2 * pi() * dayofyear(date) / 365)", "doy_sin")},
{r("cos(2 * pi() * dayofyear(date) / 365)", "doy_cos")},
{r("sin(2 * pi() * month(date) / 12)", "month_sin")},
{r("cos(2 * pi() * month(date) / 12)", "month_cos")} FROM days""")
def cyclic(spark, sf_dir):
    dates = days(spark, sf_dir).select("date").distinct()
    return rounded(dates.withColumns(calendar.cyclic(F.dayofyear("date"), F.month("date"))))


@query(f"""WITH {FEEDS} SELECT station, ts, {class3("pollen_a")} AS class_a,
{class3("pollen_b")} AS class_b FROM pollen_hourly""")
def risk_class3(spark, sf_dir):
    return pollen(spark, sf_dir).select("station", "ts", *[
        risk.risk_class3(f"pollen_{s}").alias(f"class_{s}") for s in "ab"
    ])


@query(f"""WITH {FEEDS} SELECT station, ts,
CASE WHEN pollen_a > 30 THEN 1 ELSE 0 END AS risk_a,
CASE WHEN {class3("pollen_b")} > 0 THEN 1 ELSE 0 END AS risk_b FROM pollen_hourly""")
def risk_binary(spark, sf_dir):
    return pollen(spark, sf_dir).select(
        "station", "ts", risk.risk_binary("pollen_a").alias("risk_a"),
        risk.binary_from_class3(risk.risk_class3("pollen_b")).alias("risk_b"),
    )


@query(f"""WITH {HOURLY_DAYS} SELECT station, date,
{r("CASE WHEN temperature < 5 THEN 0.0 ELSE temperature - 5 END", "degree_days")} FROM days""")
def degree_days(spark, sf_dir):
    return rounded(hourly_days(spark, sf_dir).select(
        "station", "date", numeric.degree_days("temperature").alias("degree_days")
    ))


@query(f"""WITH {LONG_DAYS} SELECT DISTINCT date,
['Lundi', 'Mardi', 'Mercredi', 'Jeudi', 'Vendredi', 'Samedi', 'Dimanche'][isodow(date)] || ' ' ||
day(date) || ' ' || ['Janvier', 'Février', 'Mars', 'Avril', 'Mai', 'Juin', 'Juillet', 'Août',
'Septembre', 'Octobre', 'Novembre', 'Décembre'][month(date)] || ' ' || year(date) AS french,
strftime(date, '%Y-%m-%d') AS iso, strftime(date, '%d/%m/%Y') AS slashed FROM days""")
def french_date(spark, sf_dir):
    return days(spark, sf_dir).select("date").distinct().withColumns({
        "french": calendar.french_date(), "iso": calendar.iso_date(),
        "slashed": calendar.slash_date(),
    })


@query(f"""WITH {LONG_DAYS} SELECT station, date,
CASE WHEN pollen_a > 30 THEN 'À risque' ELSE 'Faible' END AS label_a,
CASE {class3("pollen_b")} WHEN 0 THEN 'Faible' WHEN 1 THEN 'Modéré' ELSE 'Élevé' END AS name_b,
CASE WHEN pollen_a / 50 >= 0.7 THEN 'À risque' ELSE 'Faible' END AS label_p FROM days""")
def label_class(spark, sf_dir):
    return days(spark, sf_dir).select(
        "station", "date",
        risk.label_of_class(risk.risk_binary("pollen_a")).alias("label_a"),
        risk.class3_label(risk.risk_class3("pollen_b")).alias("name_b"),
        risk.label_of_probability(F.col("pollen_a") / 50, 0.7).alias("label_p"),
    )


@query(f"""WITH {LONG_DAYS} SELECT station, date,
{r("round(wind / 50 * 10 + 1e-9, 1)", "rounded")},
CAST(trunc(wind * 7 + 1e-9) AS BIGINT) AS truncated,
{r("CASE WHEN wind > 30 THEN 30 ELSE wind END", "capped")}, {r("abs(wind - 26)", "distance")} FROM days""")
def round_trunc_cap(spark, sf_dir):
    return rounded(days(spark, sf_dir).select(
        "station", "date", numeric.round1(F.col("wind") / 50 * 10 + 1e-9).alias("rounded"),
        numeric.truncate(F.col("wind") * 7).alias("truncated"),
        numeric.capped(F.col("wind"), 30.0).alias("capped"),
        F.abs(F.col("wind") - 26).alias("distance"),
    ))


@query(f"""WITH {LONG_DAYS} SELECT station, date,
{r("CASE WHEN pollen_a >= 25 THEN pollen_a / 50 ELSE 1 - pollen_a / 50 END * 100", "confidence")}
FROM days""")
def confidence(spark, sf_dir):
    return rounded(days(spark, sf_dir).select(
        "station", "date", risk.confidence(F.col("pollen_a") / 50).alias("confidence")
    ))


@query(f"""WITH {LONG_DAYS} SELECT DISTINCT date, CAST(date + INTERVAL 3 DAY AS DATE) AS later,
CAST(date - INTERVAL 20 DAY AS DATE) AS earlier FROM days""")
def date_shift(spark, sf_dir):
    return days(spark, sf_dir).select("date").distinct().withColumns({
        "later": calendar.date_shift("date", 3), "earlier": calendar.date_shift("date", -20),
    })


# --- features and targets ----------------------------------------------------

@query(f"""WITH {FEATURES} SELECT station, date, {FIVE_R},
month, doy, {r("gdd_daily")}, {_feature_columns(FEATURE_LIST)} FROM features""")
def feature_table(spark, sf_dir):
    table = features.feature_table(days(spark, sf_dir))
    return rounded(table.select(
        "station", "date", *FIVE.split(", "), "month", "doy", "gdd_daily", *FEATURE_LIST
    ))


_SIMPLE = ", ".join(
    f"lag({p}, {k}) OVER w AS {p}_lag{k}" for p in POLLEN for k in (1, 2, 3)
) + ", " + ", ".join(f"{_full('avg', p, 3, 'w3')} AS {p}_mean3" for p in POLLEN)


@query(f"""WITH {LONG_DAYS},
s AS (SELECT *, CAST(month(date) AS INTEGER) AS month, CAST(dayofyear(date) AS INTEGER) AS doy,
             {_SIMPLE} FROM days
      WINDOW w AS (PARTITION BY station ORDER BY date),
             w3 AS (PARTITION BY station ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT station, date, {FIVE_R}, month, doy,
       {rs(*[f"{p}_{x}" for p in POLLEN for x in ("lag1", "lag2", "lag3", "mean3")])}
FROM s WHERE temperature IS NOT NULL AND wind IS NOT NULL AND pollen_a_lag3 IS NOT NULL""")
def feature_table_simple(spark, sf_dir):
    return rounded(features.feature_table_simple(days(spark, sf_dir)))


@query(f"""WITH {TARGETS} SELECT station, date, {_feature_columns(FEATURE_LIST)},
risk_pollen_a_next, risk_pollen_b_next FROM labelled""")
def target3(spark, sf_dir):
    table = features.target3(features.feature_table(days(spark, sf_dir)))
    return rounded(table.select(
        "station", "date", *FEATURE_LIST, "risk_pollen_a_next", "risk_pollen_b_next"
    ))


@query(f"""WITH {LONG_DAYS},
s AS (SELECT *, lead(CASE WHEN pollen_a > 30 THEN 1 ELSE 0 END) OVER w AS risk_bin_pollen_a_next,
             lead(CASE WHEN pollen_b > 30 THEN 1 ELSE 0 END) OVER w AS risk_bin_pollen_b_next
      FROM days {W})
SELECT station, date, {FIVE_R}, risk_bin_pollen_a_next, risk_bin_pollen_b_next FROM s
WHERE temperature IS NOT NULL AND wind IS NOT NULL AND risk_bin_pollen_a_next IS NOT NULL""")
def target_binary(spark, sf_dir):
    return rounded(features.target_binary(days(spark, sf_dir)))


@query(f"""WITH {TARGETS} SELECT station, date, risk_pollen_a_next, risk_pollen_b_next,
CASE WHEN risk_pollen_a_next >= 1 THEN 1 ELSE 0 END AS risk_bin_pollen_a_next,
CASE WHEN risk_pollen_b_next >= 1 THEN 1 ELSE 0 END AS risk_bin_pollen_b_next FROM labelled""")
def target_binary_from3(spark, sf_dir):
    table = features.target3(features.feature_table(days(spark, sf_dir)))
    return features.target_binary_from3(table).select(
        "station", "date", *[f"risk_{x}{p}_next" for x in ("", "bin_") for p in POLLEN]
    )
