"""Data-quality rules: count violations, and drop the offending rows where asked."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F


@dataclass(frozen=True)
class Expectation:
    """A named SQL predicate. A NULL outcome counts as a violation."""

    name: str
    predicate: str
    drops: bool = False

    def violated(self) -> Column:
        return ~F.coalesce(F.expr(self.predicate), F.lit(False))


BRONZE_RULES = (
    Expectation("valid_engagement", "likes >= 0 AND comments >= 0 AND shares >= 0"),
    Expectation("has_caption", "caption IS NOT NULL AND length(caption) > 10", drops=True),
)

SILVER_RULES = (
    Expectation("has_hashtag", "hashtag IS NOT NULL", drops=True),
    Expectation("valid_sentiment", "sentiment_score BETWEEN 0 AND 1"),
)


def keep_valid(df: DataFrame, rules: Sequence[Expectation]) -> DataFrame:
    """Apply the dropping rules only."""
    for rule in rules:
        if rule.drops:
            df = df.filter(F.expr(rule.predicate))
    return df


def expect(
    df: DataFrame, rules: Sequence[Expectation], observed_as: str | Observation
) -> DataFrame:
    """Count violations of every rule while the data passes by, then drop.

    Counts cost no extra pass. Give an `Observation` to read them in a batch job,
    or a name to find them in the progress reports of a stream.
    """
    counts = [F.count_if(rule.violated()).alias(rule.name) for rule in rules]
    return keep_valid(df.observe(observed_as, F.count(F.lit(1)).alias("rows"), *counts), rules)


def report(df: DataFrame, rules: Sequence[Expectation]) -> DataFrame:
    """One row per rule: rows seen, violations, rows the rule leaves. One aggregate."""
    counts = df.agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(rule.violated()).alias(rule.name) for rule in rules],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(rule.name).alias("rule"),
                F.lit("drop" if rule.drops else "warn").alias("action"),
                F.col("checked"),
                F.col(rule.name).alias("violations"),
                (F.col("checked") - (F.col(rule.name) if rule.drops else F.lit(0))).alias("kept"),
            )
            for rule in rules
        ]
    )
    return counts.select(F.inline(lines))
