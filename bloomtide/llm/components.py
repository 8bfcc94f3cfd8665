"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bloomtide.llm.common import Scratch


def of_both_ends(edges: DataFrame, upper: Column, lower: Column) -> DataFrame:
    """Two rows an edge, (node, x): u with ``upper`` and v with ``lower``."""
    ends = [F.struct(F.col(end).alias("node"), x.alias("x")) for end, x in (("u", upper), ("v", lower))]
    return edges.select(F.explode(F.array(*ends)).alias("end")).select("end.*")


def large_star(edges: DataFrame) -> DataFrame:
    """Point the larger neighbours of each node at its smallest neighbour, or at itself if that is smaller.

    Edges have v < u, here and in what comes out. The smallest neighbour is found
    by an aggregation that combines in the tasks first and is joined back, so a
    node with very many neighbours needs no task of its own.
    """
    least = of_both_ends(edges, F.col("v"), F.col("u")).groupBy("node").agg(F.min("x").alias("m"))
    joined = edges.join(least, F.col("v") == F.col("node"))
    return joined.select("u", F.least("v", "m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Point each node and its smaller neighbours at the smallest of them; each edge once."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    pointed = of_both_ends(edges.join(least, "u"), F.col("m"), F.col("m"))
    return pointed.filter("node <> x").select(F.col("node").alias("u"), F.col("x").alias("v")).distinct()


def only_stars(edges: DataFrame) -> bool:
    """Whether each node above another is so in one edge and is itself below none."""
    nodes = of_both_ends(edges, F.lit(1), F.lit(0)).groupBy("node").agg(F.sum("x").alias("above"), F.count("*").alias("n"))
    return not nodes.agg(F.max(F.expr("above > 0 AND n > 1"))).first()[0]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v): each node of an edge with the smallest node of its component, but for that one itself.

    ``edges`` has columns u, v of one ordered type, in any direction. Rounds grow
    with the logarithm of the longest path; edges that are stars already need none.
    The driver remembers the plans and tasks of all rounds, so there are few, with
    small plans.
    """
    scratch = Scratch(edges.sparkSession, name)
    now = scratch.store(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not only_stars(now):
        now = scratch.store(small_star(large_star(now)))
        scratch.drop_but_last()
    return now
