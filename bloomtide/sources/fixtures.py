"""The given test tables seen as hourly feeds and as a multi-year daily table.

Only the view definitions live here; all operators take canonical columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bloomtide.functions.calendar import hour_floor


def _events(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.filter(F.col("event_type").isin(*kinds)).select(
        (F.col("user_id") % 4).alias("station"), hour_floor("ts").alias("ts"),
        "event_type", "value",
    )


def _of(kind: str):
    return F.when(F.col("event_type") == kind, F.col("value"))


def pollen_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, ("click", "view")).groupBy("station", "ts").agg(
        F.max(_of("click")).alias("pollen_a"), F.max(_of("view")).alias("pollen_b")
    )


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, ("purchase", "error", "signup")).groupBy("station", "ts").agg(
        F.avg(_of("purchase")).alias("temperature"),
        F.sum(_of("error")).alias("precipitation"),
        F.avg(_of("signup")).alias("wind"),
    )


def _by_station_day(spark: SparkSession, sf_dir: str):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.groupBy(
        (F.col("l_suppkey") % 5).alias("station"), F.to_date("l_shipdate").alias("date")
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    def returned(flag: str, value):
        return F.coalesce(F.max(F.when(F.col("l_returnflag") == flag, value)), F.lit(0.0))

    return _by_station_day(spark, sf_dir).agg(
        returned("R", F.col("l_quantity")).alias("pollen_a"),
        returned("A", F.col("l_extendedprice") / 1000).alias("pollen_b"),
        (F.avg("l_quantity") / 2).alias("temperature"),
        (F.sum("l_tax") * 10).alias("precipitation"),
        (F.avg("l_extendedprice") / 1999).alias("wind"),
    )


def daily_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like :func:`daily`, with pollen seasons that can be learned.

    The counts of the other view exceed every threshold once a day has many
    rows. Here the day's mean is standardised by its number of rows and added to
    a yearly wave, so all classes occur at every scale.
    """
    def wave(peak_day: int, noise):
        angle = F.lit(2) * F.pi() * (F.dayofyear("date") - peak_day) / 365
        return F.greatest(F.lit(0.0), 10 + 70 * F.cos(angle) + 15 * noise)

    means = _by_station_day(spark, sf_dir).agg(
        ((F.avg("l_quantity") - 25.5) / 14.4 * F.sqrt(F.count("*"))).alias("_a"),
        ((F.avg("l_discount") - 0.05) / 0.0316 * F.sqrt(F.count("*"))).alias("_b"),
        (F.avg("l_quantity") / 2).alias("temperature"),
        (F.sum("l_tax") * 10).alias("precipitation"),
        (F.avg("l_extendedprice") / 1999).alias("wind"),
    )
    return means.select(
        "station", "date", wave(100, F.col("_a")).alias("pollen_a"),
        wave(170, F.col("_b")).alias("pollen_b"), "temperature", "precipitation", "wind",
    )
