"""Profiles of one or two tables. Each is one aggregation over the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from bloomtide.fixed_values import SEASON_MONTHS, STATION, TS


def _missing_per_column(df: DataFrame, name: str, columns: Sequence[str] | None) -> DataFrame:
    columns = list(columns or df.columns)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return row.unpivot([], columns, "column_name", name)


def align_profiles(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Two small keyed results side by side; a side without the key is NULL."""
    return left.join(right, key, "full")


def null_counts(
    left: DataFrame, right: DataFrame, *,
    left_columns: Sequence[str] | None = None, right_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Missing values per column of two tables."""
    return align_profiles(
        _missing_per_column(left, "missing_left", left_columns),
        _missing_per_column(right, "missing_right", right_columns),
        "column_name",
    )


def coverage(sources: Mapping[str, DataFrame], *, ts: str = TS) -> DataFrame:
    """First and last timestamp of each named source."""
    union = None
    for name, df in sources.items():
        part = df.select(F.lit(name).alias("source"), F.col(ts).alias("_ts"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("source").agg(
        F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts")
    )


def schema_profile(df: DataFrame) -> DataFrame:
    """Name, type, non-missing count of each column; row and column counts."""
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    zoned = F.create_map(*[
        x for name, kind in df.dtypes for x in (F.lit(name), F.lit(kind == "timestamp"))
    ])
    row = df.agg(
        F.count("*").alias("n_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns]
    )
    return row.unpivot("n_rows", df.columns, "column_name", "n_present").select(
        "column_name", types[F.col("column_name")].alias("data_type"), "n_present", "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        zoned[F.col("column_name")].alias("has_time_zone"),
    )


STATISTICS = ("max", "min", "mean", "sum", "count")


def summary_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Maximum, minimum, mean, sum and count per column, one row per statistic."""
    make = {
        "max": F.max, "min": F.min, "mean": F.avg,
        "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
        "count": lambda c: F.count(c).cast("double"),
    }
    row = df.agg(*[
        F.struct(*[make[s](F.col(c)).cast("double").alias(c) for c in columns]).alias(s)
        for s in STATISTICS
    ])
    lines = F.array(*[
        F.struct(F.lit(s).alias("statistic"), *[F.col(s)[c].alias(c) for c in columns])
        for s in STATISTICS
    ])
    return row.select(F.inline(lines))


def class_distribution(
    df: DataFrame, labels: Mapping[str, str], *, date: str = "date",
    season_months: Mapping[str, tuple[int, int]] = SEASON_MONTHS,
) -> DataFrame:
    """Rows and share per class, over the whole year and in season.

    ``labels`` maps a taxon to its class column. Missing labels are not counted.
    """
    month = F.month(date)
    per_taxon = F.array(*[
        F.struct(
            F.lit(taxon).alias("taxon"), F.col(column).alias("class"),
            month.between(*season_months[taxon]).alias("in_season"),
        )
        for taxon, column in labels.items()
    ])
    counted = (
        df.select(F.inline(per_taxon)).filter(F.col("class").isNotNull())
        .groupBy("taxon", "class")
        .agg(F.count("*").alias("year"), F.count_if("in_season").alias("season"))
        .unpivot(["taxon", "class"], ["year", "season"], "scope", "n")
        .filter("n > 0")
    )
    # A handful of rows: classes times taxa times scopes.
    total = F.sum("n").over(Window.partitionBy("taxon", "scope"))
    return counted.withColumn("share", F.col("n") / total)


def distinct_sorted(df: DataFrame, value, name: str) -> DataFrame:
    """Distinct values of an expression in ascending order."""
    return df.select(value.alias(name)).distinct().orderBy(name)


def preview_side_by_side(
    left: DataFrame, right: DataFrame, *, order: Sequence[str] = (TS, STATION), n: int = 5
) -> DataFrame:
    """The first ``n`` rows of two tables, matched by position."""
    def first(df: DataFrame, side: str) -> DataFrame:
        head = df.orderBy(*order).limit(n)  # n rows leave the executors
        position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
        return head.select(
            position.alias("position"), *[F.col(c).alias(f"{side}_{c}") for c in df.columns]
        )

    return align_profiles(first(left, "left"), first(right, "right"), "position")
