"""Landed JSON payloads: parallel arrays per station, one row per hour out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bloomtide.fixed_values import PAYLOAD_TIME_FORMAT, STATION, TS
from bloomtide.functions.numeric import nan_to_null


def read_payloads(
    spark: SparkSession, path: str | list[str], schema: T.StructType, *,
    station: int | None = None, multi_line: bool = False,
) -> DataFrame:
    """Payload files with the given schema: one JSON object per line, or one per file.

    A service's payload does not say which station it is about. It is taken from
    ``station``, else from a folder ``station=...``, else from the payload.
    """
    payloads = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    if station is None:
        return payloads
    kind = schema[STATION].dataType if STATION in schema.fieldNames() else T.LongType()
    return payloads.withColumn(STATION, F.lit(station).cast(kind))


def hourly_payload_rows(
    payloads: DataFrame,
    *,
    keys: tuple[str, ...] = (STATION,),
    hourly: str = "hourly",
    source_tz: str | None = None,
) -> DataFrame:
    """One row per hour from ``hourly: {time: [...], variable: [...], ...}``.

    Arrays of unequal length are an error (zipping would pad them), and so are a
    payload without station, one that could not be read, and an hour without time. With
    ``source_tz`` the local times become UTC; by default they stay as they are.
    """
    names = payloads.schema[hourly].dataType.fieldNames()
    variables = [n for n in names if n != "time"]
    size = F.size(f"{hourly}.time")
    same = F.lit(True)
    for v in variables:
        same = same & (F.size(f"{hourly}.{v}") == size)
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()

    def refused(why: str):
        return F.raise_error(F.lit(why))

    checked = (
        F.when(F.col(hourly).isNull() | F.col(f"{hourly}.time").isNull(),
               refused("payload is malformed, or spreads over lines and needs multi_line"))
        .when(no_key, refused("payload without station: give it, or land it below station=..."))
        .when(same, F.col(hourly))
        .otherwise(refused("payload arrays differ in length"))
    )
    zipped = F.arrays_zip(*[F.col("_p").getField(n).alias(n) for n in names])
    rows = (
        payloads.select(*keys, checked.alias("_p"))
        .select(*keys, zipped.alias("_z"))
        .select(*keys, F.inline("_z").alias(*names))
    )
    rows = rows.filter(F.when(F.col("time").isNull(), refused("an hour has no time").cast("boolean")).otherwise(F.lit(True)))
    ts = F.to_timestamp_ntz(F.col("time"), F.lit(PAYLOAD_TIME_FORMAT))
    if source_tz is not None:
        ts = F.convert_timezone(F.lit(source_tz), F.lit("UTC"), ts)
    return rows.select(*keys, ts.alias(TS), *[nan_to_null(v).alias(v) for v in variables])


def payloads_from_rows(
    rows: DataFrame, variables: dict[str, str], *, keys: tuple[str, ...] = (STATION,), ts: str = TS
) -> DataFrame:
    """The opposite direction: one payload per key and day, for landing tests.

    A payload holds one day, so the collected arrays have at most as many
    entries as the feed has readings in a day. ``variables`` maps payload names
    to columns. Missing values stay in place: the struct is collected, not the
    value (collecting values would drop the missing ones).
    """
    reading = F.struct(
        F.date_format(ts, PAYLOAD_TIME_FORMAT).alias("time"),
        *[F.col(c).alias(v) for v, c in variables.items()],
    )
    days = rows.groupBy(*keys, F.to_date(ts).alias("_day")).agg(
        F.sort_array(F.collect_list(reading)).alias("_r")
    )
    hourly = F.struct(*[F.col("_r").getField(n).alias(n) for n in ("time", *variables)])
    return days.select(*keys, hourly.alias("hourly"))
