"""Small tables with the cases every operator must stand."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHING = ("row", "key", "name", "kept", "secrets", "n_words", "host_key", "_row", "_text", "_seed", "spans", "rank",
            "removed_lines", "label", "features", "benchmark_hits", "_words", "size", "shard", "component_id")
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi omi pi rho sigma tau ups phi chi psi omega".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame(
        [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows], DOCUMENTS)


def prose(seed: int, n: int, words: list[str] = WORDS) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "n", ".", ",", "\n"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    same = prose(1, 120)
    return [
        (0, same, "a"), (1, same, "a"), (1, same, "a"), (2, None, "a"), (3, "", None), (None, same, None), (None, None, None),
        (4, prose(2, 30_000), "b"), (5, "x" * 30_000, "b"), (6, "one two", "b"), (7, " \t\n ", "a"), (8, prose(3, 80), "c"),
        (9, prose(3, 80) + " more", "c"), (10, "词 语 ▁ 😀 é\x00 tail", "c"), (7, "other text of the same id", "a"),
    ]


def odd(spark: SparkSession) -> DataFrame:
    return documents(spark, odd_rows())


def with_clashing(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("own") for c in CLASHING})
