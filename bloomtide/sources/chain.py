"""Ordered source chain with a write-through Parquet cache of versions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from bloomtide.fixed_values import SOURCE_CACHE
from bloomtide.sources.versions import Versions

Reader = Callable[[SparkSession], DataFrame]


class NoSourceError(RuntimeError):
    """Every source of a chain failed; the message names each failure."""


def read_first_available(
    spark: SparkSession,
    sources: Sequence[tuple[str, Reader]],
    *,
    cache_path: str,
    force_reload: bool = False,
) -> DataFrame:
    """The cached copy if there is one, else the first source that can be read.

    Spark reads lazily, so a source counts as readable once all its rows have been
    written as a new version of the cache: a file that breaks halfway makes the next
    source take over. The version before stays until the new one is complete, and readers
    of it can finish. One that was finished and cannot be read raises, so that it is never
    silently replaced. The result is always read from the cache and carries its origin in
    ``source``: ``cache`` for a copy that was already there.
    """
    versions = Versions(spark, cache_path)
    if not force_reload:
        current = versions.current()
        if current is not None:
            return spark.read.parquet(current).withColumn("source", F.lit(SOURCE_CACHE))
    failures = []
    for name, reader in sources:
        folder = versions.new()
        try:
            reader(spark).write.parquet(folder)
        except (PySparkException, Py4JJavaError, OSError) as error:
            failures.append(f"{name}: {type(error).__name__}: {str(error).splitlines()[0]}")
            versions.drop(folder)
            continue
        versions.commit(folder)
        return spark.read.parquet(folder).withColumn("source", F.lit(name))
    raise NoSourceError("; ".join(failures) or "no sources given")
