"""Hourly feeds stored by day: scans of a date range open the folders of its days only.

Landed files are appended as they come, so a day collects small ones; ``compact`` writes
the days of a range anew as few files, through a staged copy. The copy is complete before
the first folder is replaced; a crash in between leaves it, and compacting again repairs
the days from it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bloomtide.fixed_values import TS
from bloomtide.session import delete_path
from bloomtide.sources.files import accepted, write_table
from bloomtide.sources.versions import Versions

DAY = "day"


def append_feed(rows: DataFrame, path: str, *, ts: str = TS, mode: str = "append") -> None:
    """Add landed rows to the folders of their days."""
    write_table(rows.withColumn(DAY, F.to_date(ts)), path, partition_by=(DAY,), mode=mode)


def read_feed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The feed with its ``day``, which the scans of ``sources.scans`` put their bounds on too."""
    with_day = T.StructType([*schema.fields, T.StructField(DAY, T.DateType())])
    return accepted(spark.read.schema(with_day).parquet(path))


def files_per_day(feed: DataFrame) -> DataFrame:
    """``day, files, rows`` of a stored feed."""
    named = feed.select(DAY, F.input_file_name().alias("_file"))
    return named.groupBy(DAY).agg(F.count_distinct("_file").alias("files"), F.count("*").alias("rows"))


def compact(spark: SparkSession, path: str, schema: T.StructType, first: dt.date, last: dt.date) -> None:
    """Each day from ``first`` to ``last`` as one file, or as few as the sizes ask for."""
    staging = Versions(spark, f"{path.rstrip('/')}.staging")
    staged = staging.current()
    if staged is None:
        staged = staging.new()
        days = read_feed(spark, path, schema).filter(F.col(DAY).between(F.lit(first), F.lit(last)))
        days.hint("rebalance", F.col(DAY)).write.partitionBy(DAY).parquet(staged)
        staging.commit(staged)
    with_day = T.StructType([*schema.fields, T.StructField(DAY, T.DateType())])
    rows = spark.read.schema(with_day).parquet(staged).hint("rebalance", F.col(DAY))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    delete_path(spark, staging.path)
