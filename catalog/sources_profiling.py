"""Sources, sinks and profiles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bloomtide.fixed_values import POLLEN
from bloomtide.functions.risk import risk_class3
from bloomtide.operators import filters, gaps, profiling
from bloomtide.operators.daily import join_hourly
from bloomtide.schemas import DAILY, POLLEN_HOURLY, POLLEN_PAYLOAD, WEATHER_PAYLOAD
from bloomtide.session import scratch_path
from bloomtide.sources import chain, feed, files, fixtures, payload, scans
from catalog.registry import query, r, rounded, rs
from catalog.views import (
    FEEDS, HOURLY_DAYS, HOURLY_TARGET, LONG_DAILY, LONG_DAYS, days, hourly_days, pollen, weather,
)

SOURCE_POLLEN = {"pollen_a": "birch_pollen", "pollen_b": "grass_pollen"}


@query(f"WITH {FEEDS} SELECT station, ts, pollen_a, pollen_b FROM pollen_hourly")
def hourly_payload_rows(spark, sf_dir):
    landed = scratch_path(spark, "payloads")
    payload.payloads_from_rows(
        pollen(spark, sf_dir), {"birch_pollen": "pollen_a", "grass_pollen": "pollen_b"}
    ).write.json(landed)
    rows = payload.hourly_payload_rows(payload.read_payloads(spark, landed, POLLEN_PAYLOAD))
    return scans.canonicalize(rows)


@query(f"WITH {FEEDS} SELECT station, ts, {rs('temperature', 'precipitation', 'wind')} FROM weather_hourly")
def hourly_weather_payload_rows(spark, sf_dir):
    """Payloads as a service sends them, without a station: it is the folder they landed in."""
    landed = scratch_path(spark, "weather-payloads")
    names = {"temperature_2m": "temperature", "precipitation": "precipitation", "wind_speed_10m": "wind"}
    payload.payloads_from_rows(weather(spark, sf_dir), names).write.partitionBy("station").json(landed)
    rows = payload.hourly_payload_rows(payload.read_payloads(spark, landed, WEATHER_PAYLOAD))
    return rounded(rows.withColumnsRenamed(names))


@query(f"""WITH {LONG_DAILY} SELECT station, date,
CASE WHEN day(date) % 7 > 0 THEN {r('pollen_a').removesuffix(' AS pollen_a')} END AS pollen_a,
{rs('pollen_b', 'temperature', 'precipitation', 'wind')} FROM daily""")
def read_csv_with_nan(spark, sf_dir):
    path = scratch_path(spark, "nan-csv")
    gap = F.when(F.dayofmonth("date") % 7 == 0, float("nan")).otherwise(F.col("pollen_a"))
    files.write_table(fixtures.daily(spark, sf_dir).withColumn("pollen_a", gap), path, fmt="csv")
    return rounded(files.read_csv_dated(spark, path, DAILY))


_DAILY_ROWS = f"WITH {LONG_DAILY} SELECT station, date, {rs('pollen_a', 'pollen_b', 'temperature', 'precipitation', 'wind')} FROM daily"


@query(_DAILY_ROWS)
def read_csv_dated(spark, sf_dir):
    path = scratch_path(spark, "daily-csv")
    files.write_table(fixtures.daily(spark, sf_dir), path, fmt="csv")
    return rounded(files.read_csv_dated(spark, path, DAILY))


@query(_DAILY_ROWS)
def write_table(spark, sf_dir):
    path = scratch_path(spark, "daily-parquet")
    files.write_table(fixtures.daily(spark, sf_dir), path, partition_by=("station",))
    return rounded(spark.read.schema(DAILY).parquet(path)).select(*DAILY.fieldNames())


@query(f"WITH {LONG_DAILY} SELECT station, date, {rs('pollen_a', 'pollen_b', 'temperature', 'precipitation', 'wind')}, 'backup' AS source FROM daily")
def read_first_available(spark, sf_dir):
    missing = scratch_path(spark, "never-written")
    df = chain.read_first_available(
        spark,
        [("api", lambda s: s.read.schema(DAILY).parquet(missing)),
         ("backup", lambda s: fixtures.daily(s, sf_dir))],
        cache_path=scratch_path(spark, "cache"),
    )
    return rounded(df)


@query(f"WITH {FEEDS} SELECT station, ts, pollen_a, pollen_b FROM pollen_hourly")
def canonicalize(spark, sf_dir):
    return scans.canonicalize(pollen(spark, sf_dir).withColumnsRenamed(SOURCE_POLLEN))


def _stored_feed(spark, sf_dir):
    """The pollen feed as landed in two deliveries, stored by day and compacted."""
    path, rows = scratch_path(spark, "feed"), pollen(spark, sf_dir)
    for half in (0, 1):
        feed.append_feed(rows.filter(F.hour("ts") % 2 == half), path)
    feed.compact(spark, path, POLLEN_HOURLY, dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    return feed.read_feed(spark, path, POLLEN_HOURLY)


@query(f"""WITH {FEEDS} SELECT station, ts, pollen_a, pollen_b FROM pollen_hourly
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-28'""")
def trailing_window_scan(spark, sf_dir):
    return scans.trailing_window_scan(_stored_feed(spark, sf_dir), HOURLY_TARGET, 20).drop("day")


@query(f"""WITH {FEEDS} SELECT station, ts, pollen_a, pollen_b FROM pollen_hourly
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-28' AND DATE '2024-01-30'""")
def horizon_scan(spark, sf_dir):
    return scans.horizon_scan(_stored_feed(spark, sf_dir), dt.date(2024, 1, 27), 3).drop("day")


@query(f"""WITH {FEEDS},
l AS (SELECT unnest(['station', 'ts', 'pollen_a', 'pollen_b']) AS column_name,
             unnest([count(*) - count(station), count(*) - count(ts),
                     count(*) - count(pollen_a), count(*) - count(pollen_b)]) AS missing_left
      FROM pollen_hourly),
w AS (SELECT unnest(['station', 'ts', 'temperature', 'precipitation', 'wind']) AS column_name,
             unnest([count(*) - count(station), count(*) - count(ts), count(*) - count(temperature),
                     count(*) - count(precipitation), count(*) - count(wind)]) AS missing_right
      FROM weather_hourly)
SELECT coalesce(l.column_name, w.column_name) AS column_name, missing_left, missing_right
FROM l FULL JOIN w ON l.column_name = w.column_name""")
def null_counts(spark, sf_dir):
    return profiling.null_counts(pollen(spark, sf_dir), weather(spark, sf_dir))


def _steps_sql(table: str) -> str:
    return f"""
  SELECT step_seconds, count(*) AS n FROM (
    SELECT CAST(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY station ORDER BY ts)) AS BIGINT)
           AS step_seconds FROM {table}) q
  WHERE step_seconds IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""


@query(f"""WITH {FEEDS},
a AS ({_steps_sql('pollen_hourly')}),
b AS ({_steps_sql('weather_hourly')})
SELECT coalesce(a.step_seconds, b.step_seconds) AS step_seconds, a.n AS n_left, b.n AS n_right
FROM a FULL JOIN b ON a.step_seconds = b.step_seconds""")
def step_regularity(spark, sf_dir):
    return gaps.step_regularity(pollen(spark, sf_dir), weather(spark, sf_dir))


@query(f"""WITH {FEEDS}
SELECT 'pollen' AS source, min(ts) AS first_ts, max(ts) AS last_ts FROM pollen_hourly
UNION ALL SELECT 'weather', min(ts), max(ts) FROM weather_hourly""")
def coverage(spark, sf_dir):
    return profiling.coverage({
        "pollen": pollen(spark, sf_dir), "weather": weather(spark, sf_dir)
    })


@query(f"""WITH {FEEDS}
SELECT unnest(['station', 'ts', 'pollen_a', 'pollen_b', 'temperature', 'precipitation', 'wind'])
         AS column_name,
       unnest(['bigint', 'timestamp_ntz', 'double', 'double', 'double', 'double', 'double'])
         AS data_type,
       unnest([count(station), count(ts), count(pollen_a), count(pollen_b), count(temperature),
               count(precipitation), count(wind)]) AS n_present,
       count(*) AS n_rows, 7 AS n_columns, false AS has_time_zone
FROM joined""")
def schema_profile(spark, sf_dir):
    return profiling.schema_profile(join_hourly(pollen(spark, sf_dir), weather(spark, sf_dir)))


def _stat(name: str, a: str) -> str:
    parts = ", ".join(r(a.format(c), c) for c in POLLEN)
    return f"SELECT '{name}' AS statistic, {parts} FROM late"


@query(f"""WITH {FEEDS},
late AS (SELECT * FROM joined WHERE ts > TIMESTAMP '2024-01-20 23:00:00')
""" + " UNION ALL ".join([
    _stat("max", "max({0})"), _stat("min", "min({0})"), _stat("mean", "avg({0})"),
    _stat("sum", "coalesce(sum({0}), 0)"), _stat("count", "CAST(count({0}) AS DOUBLE)"),
]))
def summary_stats(spark, sf_dir):
    joined = join_hourly(pollen(spark, sf_dir), weather(spark, sf_dir))
    return rounded(profiling.summary_stats(
        filters.filter_after(joined, "2024-01-20 23:00:00"), POLLEN
    ))


_CLASS = "CASE WHEN {0} <= 30 THEN 0 WHEN {0} <= 80 THEN 1 ELSE 2 END"


@query(f"""WITH {LONG_DAYS},
l AS (SELECT 'pollen_a' AS taxon, {_CLASS.format('pollen_a')} AS class,
             month(date) BETWEEN 3 AND 7 AS in_season FROM days
      UNION ALL
      SELECT 'pollen_b', {_CLASS.format('pollen_b')}, month(date) BETWEEN 5 AND 9 FROM days),
c AS (SELECT taxon, class, 'year' AS scope, count(*) AS n FROM l GROUP BY 1, 2
      UNION ALL
      SELECT taxon, class, 'season', count(*) FROM l WHERE in_season GROUP BY 1, 2)
SELECT taxon, class, scope, n,
       {r("n / CAST(sum(n) OVER (PARTITION BY taxon, scope) AS DOUBLE)", "share")} FROM c""")
def class_distribution(spark, sf_dir):
    labelled = days(spark, sf_dir).withColumns({
        "class_a": risk_class3("pollen_a"), "class_b": risk_class3("pollen_b")
    })
    return rounded(profiling.class_distribution(
        labelled, {"pollen_a": "class_a", "pollen_b": "class_b"}
    ))


_RUNS = f"""WITH {FEEDS},
flagged AS (
  SELECT station, ts, pollen_a IS NULL AS miss,
         row_number() OVER (PARTITION BY station ORDER BY ts)
           - row_number() OVER (PARTITION BY station, pollen_a IS NULL ORDER BY ts) AS g
  FROM pollen_hourly),
runs AS (
  SELECT station, min(ts) AS run_start, max(ts) AS run_end, count(*) AS n_missing
  FROM flagged WHERE miss GROUP BY station, g)
"""


@query(_RUNS + """SELECT station, run_start, run_end, n_missing,
  CAST(sum(n_missing) OVER (PARTITION BY station ORDER BY run_start) AS BIGINT) AS total_missing
FROM runs""")
def missing_runs(spark, sf_dir):
    return gaps.missing_runs(pollen(spark, sf_dir), "pollen_a")


@query(_RUNS + """, f AS (SELECT station, CAST(sum(n_missing) AS BIGINT) AS n FROM runs GROUP BY 1),
t AS (SELECT station, count(*) - count(pollen_a) AS n FROM pollen_hourly GROUP BY 1)
SELECT t.station, t.n AS n_missing, coalesce(f.n, 0) AS n_in_runs,
       CASE WHEN t.n = coalesce(f.n, 0) THEN 'OK' ELSE 'MISMATCH' END AS status
FROM t LEFT JOIN f ON t.station = f.station""")
def missing_runs_reconcile(spark, sf_dir):
    return gaps.missing_runs_reconcile(pollen(spark, sf_dir), "pollen_a")


@query(f"WITH {LONG_DAILY} SELECT DISTINCT CAST(year(date) AS INTEGER) AS year FROM daily")
def distinct_sorted(spark, sf_dir):
    return profiling.distinct_sorted(fixtures.daily(spark, sf_dir), F.year("date"), "year")


@query(f"""WITH {FEEDS},
a AS (SELECT row_number() OVER (ORDER BY ts, station) AS position, * FROM pollen_hourly
      ORDER BY ts, station LIMIT 5),
b AS (SELECT row_number() OVER (ORDER BY ts, station) AS position, * FROM weather_hourly
      ORDER BY ts, station LIMIT 5)
SELECT CAST(coalesce(a.position, b.position) AS INTEGER) AS position,
       a.station AS left_station, a.ts AS left_ts, {r('a.pollen_a', 'left_pollen_a')},
       {r('a.pollen_b', 'left_pollen_b')}, b.station AS right_station, b.ts AS right_ts,
       {r('b.temperature', 'right_temperature')}, {r('b.precipitation', 'right_precipitation')},
       {r('b.wind', 'right_wind')}
FROM a FULL JOIN b ON a.position = b.position""")
def preview_side_by_side(spark, sf_dir):
    return rounded(profiling.preview_side_by_side(pollen(spark, sf_dir), weather(spark, sf_dir)))
