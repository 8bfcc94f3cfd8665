"""Clusters of vectors by Lloyd's rounds in integers, as column expressions only.

Components become integers, so sums, means and distances are exact and the same in
every run. ``zip_with`` and ``aggregate`` give the squared distance to each centroid
of a literal array, ``array_min`` of (distance, number) chooses the nearest and, among
equals, the smaller number. One aggregation of plain column sums by cluster moves the
centroids: every task hands on at most one row a cluster, however the vectors lie, and
the driver gets ``k`` rows.

Defined results: a vector takes part when it has exactly ``dims`` components, none
null, NaN or infinite; other rows are left out. Fewer vectors than ``k`` make as many
centroids. Repeated rows count each; rows of one id are ordered by their components. A
null id hashes as the empty text. Extra columns are dropped. An empty table gives an
empty table. A component of 2**27 or more after scaling raises ``ValueError``, as
squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from bloomtide.llm.common import Scratch

LARGEST = 1 << 27
RESULT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def finite(vector: str) -> Column:
    """Whether a vector is there and none of its components is null, NaN or infinite."""
    wrong = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~wrong


def integer_vectors(df: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``id, x``: whole vectors with each component c as floor(scale * c)."""
    kept = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(finite("v") & (F.size("v") == dims))
    return kept.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def longs(values: list[int]) -> str:
    return f"array({', '.join(f'{v}L' for v in values)})"


def nearest(centroids: list[list[int]], x: str = "x") -> Column:
    """(distance, cluster) of the nearest centroid; equal distances: the smaller number.

    Each centroid c is compared by |c|^2 - 2 x c, which adds up from |c|^2 on and lacks
    |x|^2 only, so that there is one product a component; |x|^2 is added to the least.
    """
    table = F.expr("array(" + ", ".join(
        f"named_struct('cluster', {i}, 'square', {sum(v * v for v in c)}L, 'at', {longs([-2 * v for v in c])})"
        for i, c in enumerate(centroids)) + ")")

    def total(products: Column, start: Column) -> Column:
        return F.aggregate(products, start, lambda s, v: s + v)

    def distance(c: Column) -> Column:
        return total(F.zip_with(F.col(x), c["at"], lambda a, b: a * b), c["square"])

    best = F.array_min(F.transform(table, lambda c: F.struct(distance(c).alias("distance"), c["cluster"].alias("cluster"))))
    square = total(F.transform(x, lambda a: a * a), F.lit(0).cast("long"))
    return F.struct((best["distance"] + square).alias("distance"), best["cluster"].alias("cluster"))


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    return vectors.withColumn("best", nearest(centroids)).select("*", "best.distance", "best.cluster").drop("best")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hashes of seed and id, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["x"]) for r in vectors.orderBy(digest, "x").limit(k).select("x").collect()]


def moved(vectors: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """Each centroid at the floor of the mean of its vectors; those without vectors stay."""
    sums = assigned(vectors, centroids).groupBy("cluster").agg(
        F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dims)])
    after = list(centroids)
    for r in sums.collect():  # one row a centroid
        after[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return after


@dataclass(frozen=True)
class Clusters:
    """``members``: id, distance, cluster; the centroids and the inertia of each."""

    members: DataFrame
    centroids: list[list[int]]
    inertia: list[int]


def fit_clusters(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5,
                 dims: int = 64, scale: int = 256, seed: int = 2) -> Clusters:
    """Rounds of assigning and moving, then a last assignment.

    Integer vectors and the last assignment are stored in the shared folder, the former
    only until the latter is there.
    """
    scratch = Scratch(df.sparkSession, "clusters")
    vectors = scratch.store(integer_vectors(df, key, vector, dims, scale))
    largest = vectors.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
    if largest is not None and largest >= LARGEST:
        raise ValueError(f"a component is {largest} after scaling; distances are exact below {LARGEST} only")
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return Clusters(vectors.select("id", F.lit(None).cast("long").alias("distance"), F.lit(None).cast("int").alias("cluster")), [], [])
    for _ in range(rounds):
        centroids = moved(vectors, centroids, dims)
    members = scratch.store(assigned(vectors, centroids).select("id", "distance", "cluster"))
    scratch.drop_but_last()
    totals = dict(members.groupBy("cluster").agg(F.sum("distance")).collect())
    return Clusters(members, centroids, [totals.get(i, 0) for i in range(len(centroids))])


def with_clusters(df: DataFrame, key: str = "vec_id", **options) -> DataFrame:
    """``key`` and ``RESULT`` for each whole vector; options as in ``fit_clusters``."""
    found = fit_clusters(df, key, **options)
    if not found.centroids:
        kind = df.schema[key].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, {RESULT}")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    names = F.expr("array(" + ", ".join(f"'{d}'" for d in digests) + ")")
    return found.members.select(
        F.col("id").alias(key), "cluster", "distance", F.expr(longs(found.inertia))[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(found.inertia)).cast("long").alias("inertia"), names[F.col("cluster")].alias("centroid_sha256"))
