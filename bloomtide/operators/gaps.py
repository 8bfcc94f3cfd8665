"""Runs of missing values and regularity of the time step.

An hourly series is long, so none of these sorts a whole series in one task. It
is cut into calendar months, and each month is reduced to one row or a few (its
runs, its step lengths, its total, its last row). Only those meet in a window per
key; where every row gets a value, what came before its month is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bloomtide.fixed_values import STATION, TS
from bloomtide.functions.calendar import month_bucket, naive_seconds

KEYS = (STATION,)


def _block_id(keys: tuple[str, ...], order: str, flag: str):
    """Running number of the blocks of equal ``flag`` along ``order``."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.coalesce(F.col(flag) != F.lag(flag).over(w), F.lit(True)).cast("int")
    return changed, w.rowsBetween(Window.unboundedPreceding, 0)


def change_blocks(
    df: DataFrame, flag: str, *, keys: tuple[str, ...] = KEYS, ts: str = TS, out: str = "block"
) -> DataFrame:
    """Number the blocks of consecutive rows with the same flag, from 1."""
    rows = _blocks(df.withColumn("_month", month_bucket(ts)), flag, (*keys, "_month"), ts, "_in_month")
    state = F.struct(ts, F.col(flag).alias("flag"))
    months = rows.groupBy(*keys, "_month").agg(
        F.max("_in_month").alias("_blocks"), F.min(state).alias("_first"), F.max(state).alias("_last")
    )
    by_month = Window.partitionBy(*keys).orderBy("_month")
    # a month whose first flag is the last one of the month before goes on in that block
    goes_on = F.coalesce(F.col("_first.flag") == F.lag("_last").over(by_month)["flag"], F.lit(False)).cast("int")
    before = months.withColumn("_own", F.col("_blocks") - goes_on).select(
        *keys, "_month", (F.sum("_own").over(by_month) - F.col("_blocks")).alias("_before")
    )
    return _from_month(rows, before, keys).withColumn(out, F.col("_before") + F.col("_in_month")).select(*df.columns, out)


def _blocks(df: DataFrame, flag: str, keys: tuple[str, ...], ts: str, out: str) -> DataFrame:
    """Block numbers within the keys, each sorted by one task."""
    changed, running = _block_id(keys, ts, flag)
    return (
        df.withColumn("_changed", changed)
        .withColumn(out, F.sum("_changed").over(running))
        .drop("_changed")
    )


def _from_month(rows: DataFrame, months: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with what is known of their month; missing keys and times meet as equals."""
    names = (*keys, "_month")
    renamed = months.withColumnsRenamed({name: f"_of_{name}" for name in names})
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"_of_{name}"))
    return rows.join(renamed, same, "left").drop(*[f"_of_{name}" for name in names])


def running_total(
    df: DataFrame, value: str, *, keys: tuple[str, ...] = KEYS, order: str, out: str,
    monthly: bool = False,
) -> DataFrame:
    """Sum so far along ``order``; with ``monthly``, a time, a key's months are summed apart."""
    if not monthly:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(w))
    rows = df.withColumn("_month", month_bucket(order))
    so_far = Window.partitionBy(*keys, "_month").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "_month").agg(F.sum(value).alias("_sum")).select(
        *keys, "_month", F.sum("_sum").over(earlier).alias("_before"))
    total = F.when(F.col("_before").isNull(), F.col("_in_month")).otherwise(
        F.col("_before") + F.coalesce(F.col("_in_month"), F.col("_before") * 0))
    return _from_month(rows.withColumn("_in_month", F.sum(value).over(so_far)), before, keys).withColumn(
        out, total).select(*df.columns, out)


def missing_runs(
    df: DataFrame, column: str, *, keys: tuple[str, ...] = KEYS, ts: str = TS
) -> DataFrame:
    """Maximal runs of consecutive rows in which ``column`` is missing.

    One row per run: start, end, number of rows and the running number of
    missing rows of the key so far. No rows for a key without missing values.
    """
    rows = df.filter(F.col(ts).isNotNull()).select(
        *keys, ts, F.col(column).isNull().alias("_missing"), month_bucket(ts).alias("_month")
    )
    pieces = _blocks(rows, "_missing", (*keys, "_month"), ts, "_piece")
    # Grouping inside the window's own partitioning: no further shuffle.
    short = pieces.groupBy(*keys, "_month", "_piece").agg(
        F.first("_missing").alias("_missing"), F.min(ts).alias("run_start"),
        F.max(ts).alias("run_end"), F.count("*").alias("n_missing"),
    )
    # Runs that continue over a month boundary become one again.
    runs = _blocks(short, "_missing", keys, "run_start", "_run")
    merged = runs.filter("_missing").groupBy(*keys, "_run").agg(
        F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"),
        F.sum("n_missing").alias("n_missing"),
    )
    return running_total(
        merged, "n_missing", keys=keys, order="run_start", out="total_missing"
    ).select(*keys, "run_start", "run_end", "n_missing", "total_missing")


def missing_runs_reconcile(
    df: DataFrame, column: str, *, keys: tuple[str, ...] = KEYS, ts: str = TS
) -> DataFrame:
    """Whether the run lengths of each key add up to its missing values."""
    counted = df.groupBy(*keys).agg(F.count_if(F.col(column).isNull()).alias("n_missing"))
    runs = missing_runs(df, column, keys=keys, ts=ts)
    found = runs.groupBy(*keys).agg(F.sum("n_missing").alias("n_in_runs"))
    n_in_runs = F.coalesce(F.col("n_in_runs"), F.lit(0))
    return counted.join(found, list(keys), "left").select(
        *keys, "n_missing", n_in_runs.alias("n_in_runs"),
        F.when(F.col("n_missing") == n_in_runs, "OK").otherwise("MISMATCH").alias("status"),
    )


def step_diff(df: DataFrame, *, keys: tuple[str, ...] = KEYS, ts: str = TS) -> DataFrame:
    """Seconds since the previous row of the key; missing on the first."""
    rows = df.withColumn("_month", month_bucket(ts))
    inside = Window.partitionBy(*keys, "_month").orderBy(ts)
    earlier = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "_month").agg(F.max(ts).alias("_latest")).select(
        *keys, "_month", F.max("_latest").over(earlier).alias("_before"))
    own = rows.withColumn("_previous", F.lag(ts).over(inside))
    previous = F.coalesce("_previous", "_before")
    return _from_month(own, before, keys).withColumn(
        "step_seconds", naive_seconds(ts) - naive_seconds(previous)).select(*df.columns, "step_seconds")


def step_counts(df: DataFrame, *, keys: tuple[str, ...] = KEYS, ts: str = TS) -> DataFrame:
    """How often each difference between successive timestamps of a key occurs.

    Copies of a timestamp are counted before the shuffle (n copies are n - 1
    steps of length 0). A month's first row takes its predecessor from the
    latest earlier month of the key.
    """
    distinct = df.filter(F.col(ts).isNotNull()).groupBy(
        *keys, month_bucket(ts).alias("_month"), naive_seconds(ts).alias("_s")
    ).agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(*keys, "_month").orderBy("_s")
    steps = distinct.withColumn("_step", F.col("_s") - F.lag("_s").over(inside))
    short = steps.groupBy(*keys, "_month", "_step").agg(
        F.count("*").alias("_count"), F.sum(F.col("_n") - 1).alias("_copies"),
        F.min("_s").alias("_first"), F.max("_s").alias("_last"),
    )
    # Only a month's first row has no step yet, and it is its own group.
    before = Window.partitionBy(*keys).orderBy("_month").rangeBetween(
        Window.unboundedPreceding, -1
    )
    known = short.withColumn(
        "_step", F.coalesce("_step", F.col("_first") - F.max("_last").over(before))
    )
    both = F.array(
        F.struct(F.col("_step").alias("step_seconds"), F.col("_count").alias("n")),
        F.struct(F.lit(0).cast("bigint").alias("step_seconds"), F.col("_copies").alias("n")),
    )
    return (
        known.select(*keys, F.inline(both))
        .filter("step_seconds IS NOT NULL AND n > 0")
        .groupBy(*keys, "step_seconds").agg(F.sum("n").alias("n"))
    )


def step_regularity(
    left: DataFrame, right: DataFrame, *, keys: tuple[str, ...] = KEYS, ts: str = TS, top: int = 5
) -> DataFrame:
    """The most frequent steps of two feeds side by side.

    Frequencies are summed over the keys; equally frequent steps are taken in
    ascending order of length.
    """
    def most_frequent(df: DataFrame, name: str) -> DataFrame:
        total = step_counts(df, keys=keys, ts=ts).groupBy("step_seconds").agg(
            F.sum("n").alias(name)
        )
        return total.orderBy(F.desc(name), "step_seconds").limit(top)

    return most_frequent(left, "n_left").join(
        most_frequent(right, "n_right"), "step_seconds", "full"
    )
