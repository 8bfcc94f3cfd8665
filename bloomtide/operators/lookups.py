"""Lookups and expansions by fixed tables, as literals: nothing is joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bloomtide.fixed_values import (
    ADVICE, HORIZON_TEXT, HOURS_ALL_DAY, HOURS_AVOID, HOURS_GOOD, PROFILES, STATION,
)
from bloomtide.functions.risk import any_at_risk, label_of_probability, worst_label


def advice_message(label_a: str | Column, label_b: str | Column) -> Column:
    """Message for a pair of labels."""
    table = F.create_map(*[
        x for a, b, text in ADVICE for x in (F.lit(f"{a}|{b}"), F.lit(text))
    ])
    return table[F.concat_ws("|", label_a, label_b)]


def advice_lookup(
    df: DataFrame, *, label_a: str = "label_a", label_b: str = "label_b"
) -> DataFrame:
    return df.withColumn("advice", advice_message(label_a, label_b))


def horizon_text(horizon: str | Column) -> tuple[Column, Column]:
    """When and how reliable, by days ahead."""
    def table(position: int) -> Column:
        pairs = [x for row in HORIZON_TEXT for x in (F.lit(row[0]), F.lit(row[position]))]
        return F.create_map(*pairs)[horizon if isinstance(horizon, Column) else F.col(horizon)]

    return table(1), table(2)


def advice(
    df: DataFrame, *, label_a: str = "label_a", label_b: str = "label_b",
    horizon: str | None = "horizon",
) -> DataFrame:
    """Message, any-risk flag, worst label, hours to prefer and to avoid."""
    risk = any_at_risk(label_a, label_b)
    out = {
        "advice": advice_message(label_a, label_b),
        "any_risk": risk,
        "worst": worst_label(label_a, label_b),
        "good_hours": F.when(risk, HOURS_GOOD).otherwise(HOURS_ALL_DAY),
        "avoid_hours": F.when(risk, HOURS_AVOID),
    }
    if horizon is not None:
        out["when"], out["reliability"] = horizon_text(horizon)
    return df.withColumns(out)


def profile_expand(
    df: DataFrame, *, proba_a: str = "proba_a", proba_b: str = "proba_b",
    profiles: Sequence[tuple[str, float]] = PROFILES,
) -> DataFrame:
    """Each prediction under each sensitivity profile, with its labels."""
    table = F.array(*[
        F.struct(F.lit(name).alias("profile"), F.lit(float(t)).alias("threshold"))
        for name, t in profiles
    ])
    return df.select("*", F.inline(table)).withColumns({
        "label_a": label_of_probability(proba_a, F.col("threshold")),
        "label_b": label_of_probability(proba_b, F.col("threshold")),
    })


def attach_baseline(
    df: DataFrame, baseline: DataFrame, *, keys: Sequence[str] = (STATION,)
) -> DataFrame:
    """Add each key's historical values; a key without history gets NULL.

    The baseline has one row per key. Its size grows with the number of
    stations, so how to join is left to Spark, which broadcasts it only when
    its measured size is below the session's threshold.
    """
    return df.join(baseline, list(keys), "left")
