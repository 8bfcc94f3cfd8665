"""CSV and Parquet tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bloomtide.fixed_values import DATE, STATION, TS
from bloomtide.functions.numeric import nan_to_null

#: Columns that a row must have a value in, where the table has them.
REQUIRED = (STATION, TS, DATE)


def accepted(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Rows as the library takes them: NaN is missing, a missing key or time is an error.

    The check is a filter, so it runs whichever columns are used later.
    """
    doubles = {c: nan_to_null(c).alias(c) for c, kind in df.dtypes if kind in ("double", "float")}
    rows = df.withColumns(doubles) if doubles else df
    for name in required:
        if name in df.columns:
            rows = rows.filter(F.when(
                F.col(name).isNull(), F.raise_error(F.lit(f"a row has no {name}")).cast("boolean")
            ).otherwise(F.lit(True)))
    return rows


def read_csv_dated(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    *,
    timestamp_format: str | None = None,
) -> DataFrame:
    """CSV with a header; date and timestamp columns are parsed by the schema.

    NaN becomes missing; a row without station or time is an error.
    """
    reader = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
    if timestamp_format is not None:
        reader = reader.option("timestampNTZFormat", timestamp_format)
    return accepted(reader.csv(path))


def read_parquet_table(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Parquet files with the given schema, under the same rules as CSV."""
    return accepted(spark.read.schema(schema).parquet(*([path] if isinstance(path, str) else path)))


def write_table(
    df: DataFrame,
    path: str,
    *,
    fmt: str = "parquet",
    partition_by: tuple[str, ...] = (),
    mode: str = "overwrite",
) -> None:
    """Write ``df`` to ``path``, creating the folder; no row index is written.

    Partitioned output is rebalanced on the partition columns first: AQE merges
    small partition values into one task and splits a hot one over many, so
    neither thousands of small files nor one giant task comes out.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: csv or parquet")
