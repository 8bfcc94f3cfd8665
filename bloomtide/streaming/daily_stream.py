"""Daily aggregation of hourly files as they land."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bloomtide.fixed_values import DATE, STATION, TS
from bloomtide.functions.calendar import naive_seconds
from bloomtide.sources.files import accepted
from bloomtide.sources.versions import Versions

LATENESS = "2 days"


def read_hourly_stream(
    spark: SparkSession, path: str, schema: T.StructType, *, max_files: int | None = None
) -> DataFrame:
    """Parquet files of joined hourly rows appearing below ``path``; NaN becomes missing."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return accepted(reader.parquet(path))


def daily_aggregate_stream(
    hourly: DataFrame, *, keys: tuple[str, ...] = (STATION,), ts: str = TS,
    lateness: str = LATENESS,
) -> DataFrame:
    """The daily aggregate of a stream; a day is final ``lateness`` after its end.

    Event time is the naive timestamp read as UTC, so that day windows are
    calendar days of the data whatever the session time zone. State is one row
    per open station day.
    """
    timed = hourly.withColumn("_event", F.timestamp_seconds(naive_seconds(ts)))
    days = timed.withWatermark("_event", lateness).groupBy(
        *keys, F.window("_event", "1 day").alias("_w")
    ).agg(
        F.max("pollen_a").alias("pollen_a"),
        F.max("pollen_b").alias("pollen_b"),
        F.avg("temperature").alias("temperature"),
        F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("precipitation"),
        F.avg("wind").alias("wind"),
    )
    day = F.date_from_unix_date((F.unix_seconds("_w.start") / 86400).cast("int"))
    return days.select(
        *keys, day.alias(DATE), "pollen_a", "pollen_b", "temperature", "precipitation", "wind"
    )


def run_available(days: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has landed, append finished days to Parquet, then stop.

    Running it again with the same checkpoint continues where it stopped.
    """
    query = (
        days.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", checkpoint).option("path", path)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


# --- days that late rows revise --------------------------------------------------

#: What a day is put together from; these add up over batches, in any order.
def _partials(rows: DataFrame, keys: tuple[str, ...], ts: str) -> DataFrame:
    return rows.groupBy(*keys, F.to_date(ts).alias(DATE)).agg(
        F.max("pollen_a").alias("pollen_a"), F.max("pollen_b").alias("pollen_b"),
        F.sum("temperature").alias("temperature_sum"), F.count("temperature").alias("temperature_n"),
        F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("precipitation"),
        F.sum("wind").alias("wind_sum"), F.count("wind").alias("wind_n"), F.max(ts).alias("last_ts"),
    )


def _added(partials: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return partials.groupBy(*keys, DATE).agg(
        *[F.max(c).alias(c) for c in ("pollen_a", "pollen_b")],
        *[F.sum(c).alias(c) for c in ("temperature_sum", "temperature_n", "precipitation", "wind_sum", "wind_n")],
        F.max("last_ts").alias("last_ts"),
    )


class RevisedDays:
    """Daily aggregates that rows of later batches revise, in a folder.

    ``partials/batch=<id>`` has what a batch adds to its days. A batch that is run again
    writes the same folder, so it counts once. ``base`` has versions in which the batches
    up to one are added up. A row older than ``lateness`` behind the last event of all
    earlier batches is not taken; ``late/batch=<id>`` counts such rows by day.
    """

    def __init__(self, spark: SparkSession, path: str, *, keys: tuple[str, ...] = (STATION,), ts: str = TS, lateness: str = LATENESS):
        self.spark, self.path, self.keys, self.ts, self.lateness = spark, path.rstrip("/"), keys, ts, lateness
        self.base = Versions(spark, f"{self.path}/base")

    def _stored(self, kind: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{kind}")
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _parts(self, before: int | None = None) -> DataFrame | None:
        """The base and the batches after it, those below ``before`` only."""
        found, current, upto = [], self.base.current(), -1
        if current is not None:
            base = self.spark.read.parquet(current)
            upto = self.spark.read.parquet(current).agg(F.max("upto")).first()[0]
            found.append(base.drop("upto"))
        partials = self._stored("partials")
        if partials is not None:
            later = partials.filter(F.col("batch") > upto)
            found.append((later if before is None else later.filter(F.col("batch") < before)).drop("batch"))
        return reduce(DataFrame.unionByName, found) if found else None

    def add(self, rows: DataFrame, batch: int) -> None:
        """Take a batch; for ``foreachBatch``."""
        rows = rows.persist()
        try:
            earlier = self._parts(before=batch)
            last = earlier.agg(F.max("last_ts")).first()[0] if earlier is not None else None
            bound = F.lit(last).cast("timestamp_ntz") - F.expr(f"INTERVAL {self.lateness}")
            late = F.lit(False) if last is None else F.col(self.ts) < bound
            day = F.to_date(self.ts).alias(DATE)
            rows.filter(late).groupBy(*self.keys, day).agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(
                f"{self.path}/late/batch={batch}")
            _partials(rows.filter(~late), self.keys, self.ts).write.mode("overwrite").parquet(f"{self.path}/partials/batch={batch}")
        finally:
            rows.unpersist()

    def days(self) -> DataFrame:
        """The daily table of all rows taken so far."""
        parts = self._parts()
        if parts is None:
            raise FileNotFoundError(f"no batches below {self.path}")
        mean = lambda c: F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_sum") / F.col(f"{c}_n")).alias(c)
        return _added(parts, self.keys).select(
            *self.keys, DATE, "pollen_a", "pollen_b", mean("temperature"), "precipitation", mean("wind"))

    def late_rows(self) -> DataFrame:
        """``keys, date, rows``: rows that came too late."""
        stored = self._stored("late")
        if stored is None:
            raise FileNotFoundError(f"no batches below {self.path}")
        return stored.groupBy(*self.keys, DATE).agg(F.sum("rows").alias("rows"))

    def compact(self, upto: int) -> None:
        """Add up the batches up to ``upto`` in a new base; their own folders no longer count."""
        parts = self._parts(before=upto + 1)
        if parts is not None:
            folder = self.base.new()
            _added(parts, self.keys).withColumn("upto", F.lit(upto)).write.parquet(folder)
            self.base.commit(folder)


def run_revisions(hourly: DataFrame, days: RevisedDays, checkpoint: str) -> None:
    """Process what has landed into ``days``, then stop; late rows revise their day."""
    query = (
        hourly.writeStream.foreachBatch(days.add).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
