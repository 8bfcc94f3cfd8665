"""Cases outside of the given tables: stations that end early, missing days, landed payloads, long series."""

from __future__ import annotations

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from bloomtide.operators import gaps, topk
from bloomtide.plans import scoring
from bloomtide.plans.bulletin import bulletin, bulletin_at
from bloomtide.schemas import DAILY, POLLEN_PAYLOAD
from bloomtide.session import scratch_path
from bloomtide.sources import chain, files, payload
from bloomtide.sources.versions import Versions
from tests.frames import D, series

TARGET = D(2001, 1, 15)


def stations(spark):
    """Daily rows of stations that end at the target, weeks, months and years before it."""
    out = None
    for station, last in enumerate([D(2001, 1, 20), D(2000, 12, 20), D(2000, 11, 20), D(1999, 3, 2)], 1):
        first = last - dt.timedelta(days=700)
        n = 701
        rng = random.Random(station)
        one = series(spark, first, {
            "pollen_a": [float(rng.choice([0, 2, 15, 50])) for _ in range(n)], "pollen_b": [float(rng.randint(0, 9)) for _ in range(n)],
            "temperature": [float(rng.randint(0, 25)) for _ in range(n)], "precipitation": [float(rng.randint(0, 6)) for _ in range(n)],
            "wind": [3.0] * n}, station)
        out = one if out is None else out.unionByName(one)
    return out


@pytest.mark.parametrize("options", [{}, {"max_days": 30}, {"history_years": (1998, 1999)}])
def test_bulletin_at_is_the_bulletin_of_each_stations_day(spark, options):
    daily = stations(spark).cache()
    want = topk.row_at_or_last(bulletin(daily, **options), TARGET).orderBy("station").collect()
    got = bulletin_at(daily, TARGET, **options).orderBy("station").collect()
    assert got == want and [r["date"] for r in got] == [TARGET, D(2000, 12, 20), D(2000, 11, 20), D(1999, 3, 2)]
    daily.unpersist()


def test_station_without_history_says_so(spark):
    daily = stations(spark)
    got = bulletin(daily, daily.filter("station > 1")).filter("station = 1")
    assert {tuple(r) for r in got.select("anomaly", "anomaly_message").distinct().collect()} == {(0.0, "Données insuffisantes")}


def test_missing_date_fails_whatever_is_read(spark):
    daily = stations(spark)
    for read in (lambda df: df.count(), lambda df: df.select("station").collect(), lambda df: df.select("station", "pollen_a").collect()):
        with pytest.raises(Exception, match="no row dated 2001-01-15 for 2|for 3|for 4"):
            read(topk.row_exact_or_fail(daily, TARGET))
    one = daily.filter("station = 1")
    assert topk.row_exact_or_fail(one, TARGET).first()["date"] == TARGET


class Rule:
    def transform(self, rows):
        return rows.withColumn("prediction", F.lit(1.0))


def test_stored_features_are_read_by_date(spark):
    path = scratch_path(spark, "features")
    stations(spark).write.parquet(path)
    stored = spark.read.schema(DAILY).parquet(path)
    plan = topk.row_exact_or_fail(stored.filter("station = 1"), TARGET)._jdf.queryExecution().toString()
    assert f"EqualTo(date,{TARGET})" in plan
    with pytest.raises(Exception, match="no row dated"):
        scoring.score_precomputed(stored, TARGET, Rule(), Rule()).select("station", "date", "label_a").collect()


def land(spark, text: str, folder: str = "") -> str:
    base = scratch_path(spark, "landed")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{base}/{folder}")
    return base


BARE = '{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "birch_pollen": [1.0, null], "grass_pollen": [2.0, 3.0]}}'


def test_payload_takes_its_station_from_folder_or_parameter(spark):
    given = payload.hourly_payload_rows(payload.read_payloads(spark, land(spark, BARE), POLLEN_PAYLOAD, station=7))
    found = payload.hourly_payload_rows(payload.read_payloads(spark, land(spark, BARE, "station=8"), POLLEN_PAYLOAD))
    assert [r["station"] for r in given.collect()] == [7, 7] and [r["station"] for r in found.collect()] == [8, 8]
    spread = BARE.replace(", ", ",\n  ")
    rows = payload.read_payloads(spark, land(spark, spread), POLLEN_PAYLOAD, station=7, multi_line=True)
    assert sorted(map(str, payload.hourly_payload_rows(rows).collect())) == sorted(map(str, given.collect()))


@pytest.mark.parametrize(("text", "options", "message"), [
    (BARE, {}, "without station"), (BARE.replace(", ", ",\n"), {"station": 1}, "malformed"),
    (BARE.replace("[2.0, 3.0]", "[2.0]"), {"station": 1}, "differ in length"),
    (BARE.replace('"2024-01-01T01:00"', "null"), {"station": 1}, "no time"),
])
def test_refused_payloads(spark, text, options, message):
    rows = payload.hourly_payload_rows(payload.read_payloads(spark, land(spark, text), POLLEN_PAYLOAD, **options))
    with pytest.raises(Exception, match=message):
        rows.count()


def test_nan_is_missing_in_files(spark):
    text = "station,date,pollen_a,pollen_b,temperature,precipitation,wind\n1,2024-01-01,NaN,1.0,2.0,NaN,3.0\n"
    got = files.read_csv_dated(spark, land(spark, text.strip()), DAILY).first()
    assert got["pollen_a"] is None and got["precipitation"] is None and got["wind"] == 3.0
    with pytest.raises(Exception, match="no station"):
        files.read_csv_dated(spark, land(spark, text.replace("\n1,", "\n,").strip()), DAILY).select("wind").collect()


def test_series_in_months_are_those_of_whole_series(spark):
    rng = random.Random(3)
    rows, at = [], dt.datetime(2023, 11, 1)
    for i in range(3000):
        at += dt.timedelta(hours=rng.choice([1, 1, 1, 5, 30, 900 if i % 700 == 0 else 1]))
        rows.append((i % 2, at, rng.random() < 0.8, float(rng.randint(0, 9)) if rng.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "station long, ts timestamp_ntz, flag boolean, v double")
    blocks = {(r["station"], r["ts"]): r["block"] for r in gaps.change_blocks(df, "flag").collect()}
    steps = {(r["station"], r["ts"]): r["step_seconds"] for r in gaps.step_diff(df).collect()}
    totals = {(r["station"], r["ts"]): r["t"] for r in gaps.running_total(df, "v", order="ts", out="t", monthly=True).collect()}
    plain = {(r["station"], r["ts"]): r["t"] for r in gaps.running_total(df, "v", order="ts", out="t").collect()}
    assert totals == plain
    for station in (0, 1):
        block, last = 0, None
        for s, ts, flag, _ in rows:
            if s != station:
                continue
            block += last is None or last[1] != flag
            assert blocks[s, ts] == block
            assert steps[s, ts] == (None if last is None else int((ts - last[0]).total_seconds()))
            last = ts, flag


def test_chain_keeps_a_finished_copy_and_drops_failed_ones(spark):
    base = scratch_path(spark, "chain")
    good = lambda s: s.range(3).toDF("x")
    bad = lambda s: s.range(3).select(F.raise_error(F.lit("broken")).cast("int").alias("x"))
    with pytest.raises(chain.NoSourceError):
        chain.read_first_available(spark, [("bad", bad)], cache_path=f"{base}/cache")
    assert Versions(spark, f"{base}/cache").current() is None
    assert chain.read_first_available(spark, [("good", good)], cache_path=f"{base}/cache").first()["source"] == "good"
    with pytest.raises(chain.NoSourceError):
        chain.read_first_available(spark, [("bad", bad)], cache_path=f"{base}/cache", force_reload=True)
    assert chain.read_first_available(spark, [("bad", bad)], cache_path=f"{base}/cache").count() == 3
    before = Versions(spark, f"{base}/cache").current()
    bad(spark).limit(0).write.parquet(Versions(spark, f"{base}/cache").new())  # a crash before the commit leaves this
    assert Versions(spark, f"{base}/cache").current() == before


def test_a_reader_always_finds_a_version_while_two_writers_replace_it(spark):
    path = scratch_path(spark, "cache")
    stop, seen, errors = threading.Event(), [], []

    def write(first):
        for k in range(4):
            chain.read_first_available(spark, [("x", lambda s: s.range(first + k, first + k + 3))], cache_path=path, force_reload=True)

    def read():
        while not stop.is_set():
            try:
                rows = sorted(r["id"] for r in chain.read_first_available(spark, [], cache_path=path).collect())
                seen.append(rows == list(range(rows[0], rows[0] + 3)))
            except Exception as error:
                errors.append(error)

    write(0)
    reader = threading.Thread(target=read)
    writers = [threading.Thread(target=write, args=(100 * i,)) for i in (1, 2)]
    reader.start(), [w.start() for w in writers], [w.join() for w in writers]
    stop.set(), reader.join()
    assert not errors and seen and all(seen)
    folders = Versions(spark, path)
    assert len(folders._commits()) == 12
    last = folders.current()
    folder = folders.new()
    spark.range(1).write.parquet(folder)
    folders.commit(folder, grace=0)
    assert len(folders._commits()) == 2 and folders.current() == folder and spark.read.parquet(last).count() == 3
