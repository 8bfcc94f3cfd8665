from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bloomtide.operators.daily import daily_aggregate
from bloomtide.schemas import DAILY, JOINED_HOURLY, POLLEN_PAYLOAD
from bloomtide.session import scratch_path
from bloomtide.sources import chain, feed, files, payload, scans
from bloomtide.streaming import daily_stream
from tests.frames import D, T, joined, series


def landed(spark, lines):
    path = scratch_path(spark, "json")
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    return payload.read_payloads(spark, path, POLLEN_PAYLOAD)


GOOD = ('{"station": 7, "hourly": {"time": ["2024-01-01T00:00", "2024-07-01T13:00"], '
        '"birch_pollen": [null, 2.5], "grass_pollen": [1.0, null]}}')
SHORT = ('{"station": 7, "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], '
         '"birch_pollen": [1.0], "grass_pollen": [1.0, 2.0]}}')


def test_payload_rows(spark):
    rows = scans.canonicalize(payload.hourly_payload_rows(landed(spark, [GOOD])))
    assert rows.columns == ["station", "ts", "pollen_a", "pollen_b"]
    assert [tuple(r) for r in rows.orderBy("ts").collect()] == [
        (7, T(2024, 1, 1, 0), None, 1.0), (7, T(2024, 7, 1, 13), 2.5, None)
    ]


def test_payload_in_a_source_time_zone(spark):
    rows = payload.hourly_payload_rows(landed(spark, [GOOD]), source_tz="Europe/Paris")
    assert [r["ts"] for r in rows.orderBy("ts").collect()] == [
        T(2023, 12, 31, 23), T(2024, 7, 1, 11)
    ]


def test_payload_of_unequal_arrays_fails(spark):
    with pytest.raises(Exception, match="differ in length"):
        payload.hourly_payload_rows(landed(spark, [SHORT])).collect()


def test_csv_round_trip_keeps_missing_values(spark):
    df = series(spark, D(2024, 2, 28), {"temperature": [1.5, None, 3.0]})
    path = scratch_path(spark, "csv")
    files.write_table(df, path, fmt="csv")
    back = files.read_csv_dated(spark, path, DAILY)
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        files.write_table(df, path, fmt="xlsx")


def test_source_chain(spark):
    cache = scratch_path(spark, "cache")
    missing = scratch_path(spark, "missing")
    broken = scratch_path(spark, "broken")
    spark.createDataFrame([("a,b\nnot a number,2\n",)], "value string").write.text(broken)
    good = series(spark, D(2024, 1, 1), {"pollen_a": [1.0]})
    sources = [
        ("api", lambda s: s.read.schema(DAILY).parquet(missing)),
        ("broken", lambda s: files.read_csv_dated(s, broken, DAILY)),
        ("backup", lambda s: good),
    ]
    first = chain.read_first_available(spark, sources, cache_path=cache)
    assert first.drop("source").collect() == good.collect() and first.first()["source"] == "backup"
    again = chain.read_first_available(spark, [], cache_path=cache)
    assert again.first()["source"] == "cache"
    newer = [("api", lambda s: good.withColumn("pollen_a", F.lit(2.0)))]
    forced = chain.read_first_available(spark, newer, cache_path=cache, force_reload=True)
    assert (forced.first()["source"], forced.first()["pollen_a"]) == ("api", 2.0)
    with pytest.raises(chain.NoSourceError):
        chain.read_first_available(spark, sources[:2], cache_path=cache, force_reload=True)
    kept = chain.read_first_available(spark, [], cache_path=cache)
    assert kept.first()["pollen_a"] == 2.0
    with pytest.raises(chain.NoSourceError, match="api: AnalysisException"):
        chain.read_first_available(
            spark, sources[:1], cache_path=scratch_path(spark, "empty"), force_reload=True
        )


def test_date_bounded_scans_reach_the_files(spark):
    path = scratch_path(spark, "hours")
    rows = [(1, T(2024, 1, 1) + dt.timedelta(hours=12 * i), 1.0, 1.0, 1.0, 1.0, 1.0)
            for i in range(40)]
    files.write_table(joined(spark, rows), path)
    table = spark.read.schema(JOINED_HOURLY).parquet(path)
    got = scans.trailing_window_scan(table, D(2024, 1, 10), 2)
    assert {r["ts"].date() for r in got.collect()} == {D(2024, 1, 8), D(2024, 1, 9), D(2024, 1, 10)}
    ahead = scans.horizon_scan(table, D(2024, 1, 10), 3)
    assert {r["ts"].date() for r in ahead.collect()} == {D(2024, 1, 11), D(2024, 1, 12), D(2024, 1, 13)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def land(spark, path, rows):
    joined(spark, rows).coalesce(1).write.mode("append").parquet(path)


def hours(day, values, station=1):
    return [(station, T(2024, 1, day, h), v, 1.0, 10.0, None, 3.0) for h, v in enumerate(values)]


def test_stream_equals_batch_for_closed_days(spark):
    source, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    batches = [
        hours(1, [1.0, 2.0]) + hours(2, [5.0]),
        hours(1, [1.0, 2.0, 9.0])[2:] + hours(3, [7.0]),   # one day late: kept
        hours(8, [2.0]),                                    # closes days 1 to 5
        [(1, T(2024, 1, 3, 20), 99.0, 1.0, 1.0, 1.0, 1.0)] + hours(9, [4.0]),  # too late: dropped
        hours(14, [0.0]),
    ]
    for rows in batches:
        land(spark, source, rows)
        stream = daily_stream.daily_aggregate_stream(
            daily_stream.read_hourly_stream(spark, source, JOINED_HOURLY)
        )
        daily_stream.run_available(stream, out, state)
    got = spark.read.schema(DAILY).parquet(out).orderBy("date").collect()
    kept = [r for rows in batches for r in rows if r[2] != 99.0 and r[1] < T(2024, 1, 14)]
    want = daily_aggregate(joined(spark, kept)).orderBy("date").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_stream_days_do_not_depend_on_the_session_zone(spark):
    source, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    land(spark, source, hours(1, [float(h) for h in range(24)]) + hours(9, [0.0]))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stream = daily_stream.daily_aggregate_stream(
            daily_stream.read_hourly_stream(spark, source, JOINED_HOURLY)
        )
        daily_stream.run_available(stream, out, state)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = spark.read.schema(DAILY).parquet(out).collect()
    assert [(r["date"], r["pollen_a"]) for r in got] == [(D(2024, 1, 1), 23.0)]


def test_feed_by_day_is_pruned_and_compacted(spark):
    path = scratch_path(spark, "feed")
    rows = [(1, T(2024, 1, 1) + dt.timedelta(hours=6 * i), float(i), 1.0, 1.0, 1.0, 1.0) for i in range(40)]
    df = joined(spark, rows)
    for part in range(3):
        feed.append_feed(df.filter(F.col("pollen_a") % 3 == part), path)
    stored = feed.read_feed(spark, path, JOINED_HOURLY)
    assert feed.files_per_day(stored).agg(F.max("files")).first()[0] > 1
    feed.compact(spark, path, JOINED_HOURLY, D(2024, 1, 2), D(2024, 1, 20))
    files_now = {r["day"]: r["files"] for r in feed.files_per_day(feed.read_feed(spark, path, JOINED_HOURLY)).collect()}
    assert files_now[D(2024, 1, 1)] > 1 and {n for d, n in files_now.items() if d > D(2024, 1, 1)} == {1}
    stored = feed.read_feed(spark, path, JOINED_HOURLY)
    assert sorted(stored.drop("day").collect()) == sorted(df.collect())
    scan = scans.trailing_window_scan(stored, D(2024, 1, 5), 2)
    text = scan._jdf.queryExecution().executedPlan().toString()
    assert "day" in text.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(ts" in text
    assert {r["ts"].date() for r in scan.collect()} == {D(2024, 1, 3), D(2024, 1, 4), D(2024, 1, 5)}


def test_revised_days_count_a_batch_once_and_drop_what_is_too_late(spark):
    days = daily_stream.RevisedDays(spark, scratch_path(spark, "revised"))
    row = lambda day, hour, value: (1, T(2024, 1, day, hour), value, 1.0, value, 1.0, 2.0)
    first = joined(spark, [row(1, 5, 1.0), row(5, 5, 2.0)])
    second = joined(spark, [row(1, 6, 9.0), row(4, 6, 3.0), row(5, 6, 4.0), row(6, 1, 1.0)])
    with pytest.raises(FileNotFoundError):
        days.days()
    days.add(first, 0)
    for _ in range(2):  # a batch that is run again
        days.add(second, 1)
    want = {D(2024, 1, 1): (1.0, 1.0, 1.0), D(2024, 1, 4): (3.0, 3.0, 1.0), D(2024, 1, 5): (4.0, 3.0, 2.0), D(2024, 1, 6): (1.0, 1.0, 1.0)}
    read = lambda: {r["date"]: (r["pollen_a"], r["temperature"], r["precipitation"]) for r in days.days().collect()}
    assert read() == want
    assert [tuple(r) for r in days.late_rows().collect()] == [(1, D(2024, 1, 1), 1)]
    days.compact(1)
    assert read() == want
    days.add(joined(spark, [row(6, 2, 5.0), row(2, 2, 5.0)]), 2)
    assert read() == want | {D(2024, 1, 6): (5.0, 3.0, 2.0)} and days.late_rows().agg(F.sum("rows")).first()[0] == 2
