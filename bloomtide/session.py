"""Spark session settings, shared scratch space and materialisation."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on. Everything about cluster size (executors,
# memory, shuffle partitions, file split size) is left to the submitter: with
# AQE on, the initial partition number may be generous and is coalesced.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(
    app_name: str = "bloomtide",
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the library's settings; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str | None:
    """The folder every executor sees, as the session names it, or None."""
    return spark.conf.get("spark.checkpoint.dir", None) or None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder.

    Only a local session without that setting gets a temporary folder of this
    machine; on a cluster the setting is required, since executors on other
    machines could not read what was written.
    """
    base = shared_dir(spark)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # not local-cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="bloomtide-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give the context a checkpoint folder unless it already has one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "checkpoint"))


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once for many later reads.

    With a shared folder the rows go there (``checkpoint``), so the loss of an
    executor costs a re-read. Without one they are persisted, and a lost
    partition is recomputed from its lineage.
    """
    if shared_dir(df.sparkSession) is not None:
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Stored:
    """A table that is written anew again and again; each writing cuts the lineage and drops the one before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None

    def write(self, df: DataFrame) -> DataFrame:
        before, self.path = self.path, scratch_path(self.spark, self.name)
        df.write.parquet(self.path)
        if before is not None:
            delete_path(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        if self.path is not None:
            delete_path(self.spark, self.path)
            self.path = None
