"""Shards that match the mixture of sources: proportional stratified interleaving.

Rows of each source are shuffled by a seeded digest and ranked; the rank becomes a
fraction of the source's size, all rows are sorted by that fraction, and the
sorted row is cut into equal runs. Every run then holds each source in
proportion, to within a row or so.

Ranks are computed without a task per source: rows fall into buckets of the
order, buckets are counted and summed in two levels, and only within a bucket
are rows sorted. Buckets follow the data's size, not the number of sources.

Defined results: a null source is a source of its own; a null text has size 16;
ties of the digest (same id, same text) are repeated rows, which are
interchangeable, and rows of equal texts are placed each by its own id (law ``rows``
asks nothing of them); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bloomtide.llm.common import text_of
from bloomtide.llm.line_frequency import host_key

COARSE = 1024


def offsets_of(counts: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """(keys, bucket, before): rows in earlier buckets of the same keys.

    Two levels of sums: over at most ``COARSE`` coarse buckets a key, and within
    one coarse bucket.
    """
    coarse = F.floor(F.col(bucket) / F.lit(COARSE)).cast("long")
    fine = counts.withColumn("_coarse", coarse)
    within = W.partitionBy(*keys, "_coarse").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    earlier_in = F.coalesce(F.sum("n").over(within), F.lit(0))
    if not keys:  # a row for some millions of rows: few numbers, summed on the driver
        tops, total = [], 0
        sums = dict(fine.groupBy("_coarse").agg(F.sum("n")).collect())
        for c in range(max(sums, default=-1) + 1):
            tops.append(total)
            total += sums.get(c, 0)
        table = F.expr(f"array({', '.join(f'{t}L' for t in tops)})") if tops else F.array(F.lit(0).cast("long"))
        return fine.select(bucket, (F.get(table, F.col("_coarse").cast("int")) + earlier_in).alias("before"))
    by_coarse = fine.groupBy(*keys, "_coarse").agg(F.sum("n").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_coarse").rowsBetween(W.unboundedPreceding, -1)
    tops = by_coarse.select(*keys, "_coarse", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_top"))
    return fine.withColumn("_in", earlier_in).join(
        tops, [*keys, "_coarse"]).select(*keys, bucket, (F.col("_top") + F.col("_in")).alias("before"))


def positions(rows: DataFrame, keys: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Add the 0-based position of each row among the rows of its keys.

    ``bucket`` must not decrease in the wanted order; ``order`` sorts within one.
    """
    counts = rows.groupBy(*keys, bucket).agg(F.count("*").alias("n"))
    # dealt by key and bucket; a partitioning by the key alone, left by a join, would do for the window too
    rows = rows.repartition(*keys, bucket)
    rank = F.row_number().over(W.partitionBy(*keys, bucket).orderBy(*order))
    return rows.withColumn("_rank", rank).join(offsets_of(counts, keys, bucket), [*keys, bucket]).withColumn(
        name, F.col("before") + F.col("_rank") - 1).drop("_rank", "before", bucket)


def fraction_bucket(fraction: Column, rows: Column, rows_per_bucket: int) -> Column:
    """A bucket number that grows with a fraction in [0, 1): about so many rows in each."""
    return F.floor(fraction * F.ceil(rows / F.lit(rows_per_bucket))).cast("long")


def interleaved(documents: DataFrame, shards: int, key: str = "doc_id", source: str = "source", text: str = "text",
                seed: int = 0, rows_per_bucket: int = 4000) -> DataFrame:
    """``key, size, text_crc32, source_key, source_rank, source_rows, position, shard, slot``.

    Shards differ by one row at most (law ``rows``); slots count from 0 in each.
    """
    body = text_of(text)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.md5(body)))
    rows = documents.select(
        F.col(key), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        host_key(source).alias("source_key"), digest.alias("_digest"))
    # counted and joined by source and first digits of the digest, so a source is many keys
    rows = rows.withColumn("_part", F.substring("_digest", 1, 2))
    parts = rows.groupBy("source_key", "_part").agg(F.count("*").alias("n"))
    sizes = parts.withColumn("source_rows", F.sum("n").over(W.partitionBy("source_key"))).drop("n")
    rows = rows.join(sizes, ["source_key", "_part"]).drop("_part")
    start = F.conv(F.substring("_digest", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    ranked = positions(
        rows.withColumn("_bucket", fraction_bucket(start, F.col("source_rows"), rows_per_bucket)),
        ["source_key"], "_bucket", ["_digest"], "source_rank")
    n = documents.count()
    fraction = (F.col("source_rank") + 0.5) / F.col("source_rows")
    placed = positions(
        ranked.withColumn("_fraction", fraction).withColumn(
            "_bucket", fraction_bucket(F.col("_fraction"), F.lit(n), rows_per_bucket)),
        [], "_bucket", ["_fraction", "source_key", "_digest"], "position")
    return placed.withColumn("shard", F.expr(f"cast(position * {shards} div {max(n, 1)} as int)")).withColumn(
        "slot", F.col("position") - F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")).drop(
        "_digest", "_fraction")
