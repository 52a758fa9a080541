"""Enriched hashtag rows -> one insight row per hashtag.

Means come from whole-number sums: the result does not depend on the order in which
partial aggregates arrive, so a retried task cannot change the last digits.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trendgap.config import DEFAULT_RULES, BrandConfig, Rules
from trendgap.schemas import INSIGHT
from trendgap.sources.storage import materialise

# Sentiment scores are summed as whole millionths.
MICRO = 1_000_000.0


def mean_engagement(rules: Rules) -> Column:
    total = F.col("likes") + F.col("comments") + F.col("shares")
    mean = F.sum(total).cast("double") / F.count(total)
    return mean / F.lit(rules.engagement_scale)


def mean_sentiment() -> Column:
    micro = F.round(F.col("sentiment_score") * F.lit(MICRO)).cast("bigint")
    return F.sum(micro).cast("double") / F.lit(MICRO) / F.count(micro)


def tag_totals(silver: DataFrame, rules: Rules = DEFAULT_RULES, *extra: Column) -> DataFrame:
    """Counts and means per hashtag. A post with unknown owner (NULL) is in neither side."""
    return silver.groupBy("hashtag").agg(
        mean_engagement(rules).alias("avg_engagement"),
        F.count(F.lit(1)).alias("post_count"),
        F.count_if(F.col("is_competitor")).alias("competitor_post_count"),
        F.count_if(~F.col("is_competitor")).alias("brand_post_count"),
        mean_sentiment().alias("avg_sentiment"),
        *extra,
    )


def brand_fit(tag: Column, engagement: Column, targets: Iterable[str], rules: Rules) -> Column:
    return (
        F.when(tag.isin(*targets), F.lit(rules.fit_target))
        .when(engagement > rules.engaged_above, F.lit(rules.fit_engaged))
        .otherwise(F.lit(rules.fit_other))
    )


def with_signals(
    totals: DataFrame, brand: BrandConfig, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Velocity, competitor dominance, brand fit and the gap flag."""
    return totals.withColumns(
        {
            "trend_velocity": F.col("post_count") / F.lit(rules.velocity_hours),
            "competitor_dominance": F.col("competitor_post_count")
            / F.greatest(F.col("post_count"), F.lit(1)),
            "brand_fit_score": brand_fit(
                F.col("hashtag"), F.col("avg_engagement"), brand.hashtags, rules
            ),
        }
    ).withColumn(
        "opportunity_gap",
        (F.col("competitor_dominance") > rules.dominance_above)
        & (F.col("brand_post_count") < rules.tag_brand_posts_below),
    )


def best_post() -> tuple[Column, Column]:
    """Caption and engagement of the most engaging post, ties to the smallest post id."""
    best_first = F.struct((-F.col("engagement_rate")).alias("rate"), "post_id")
    return (
        F.min_by("caption", best_first).alias("top_caption"),
        F.max("engagement_rate").alias("engagement_rate"),
    )


def lowest_rate() -> Column:
    """Engagement of the best post, negated; NULL (which comes first) if a post has none."""
    rate = F.col("engagement_rate")
    return F.when(F.count(rate) == F.count(F.lit(1)), F.min(-rate)).alias("lowest")


def best_posts(silver: DataFrame, sums: DataFrame, *by: str) -> DataFrame:
    """The rows of `sums` (stored, with `lowest_rate`) with rate and id of the most engaging
    post, ties to the smallest post id, and its caption as `top_caption`.

    Texts make an aggregate sort all rows that it sees. So numbers are summed first, by
    hashing, and only the posts that reach the best rate of their group get here. Posts
    below the best rates of all groups are the best of none: that test needs no group, so it
    is done where the posts come from, before whatever shuffles them.
    """
    least = sums.agg(F.max("lowest")).scalar()
    rate = F.col("engagement_rate")
    silver = silver.filter((-rate <= least) | rate.isNull())
    rates = sums.select(*[F.col(c).alias(f"_{c}") for c in by], "lowest")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    reached = reduce(lambda a, b: a & b, same) & (-F.col("engagement_rate")).eqNullSafe(F.col("lowest"))
    leaders = silver.select(*by, "engagement_rate", "post_id", "caption").join(rates, reached)
    place = F.struct((-F.col("engagement_rate")).alias("rate"), "post_id")
    best = leaders.groupBy(*[F.col(f"_{c}") for c in by]).agg(
        F.min(place).alias("place"), F.min_by("caption", place).alias("top_caption")
    )
    return sums.join(best, reduce(lambda a, b: a & b, same)).drop("lowest", *[f"_{c}" for c in by])


def top_caption(silver: DataFrame) -> DataFrame:
    rates = silver.groupBy("hashtag").agg(F.max("engagement_rate").alias("engagement_rate"), lowest_rate())
    found = best_posts(silver, materialise(rates, "best-rates"), "hashtag")
    return found.select("hashtag", "top_caption", "engagement_rate")


def _numbers() -> list[Column]:
    total = F.col("likes") + F.col("comments") + F.col("shares")
    micro = F.round(F.col("sentiment_score") * F.lit(MICRO)).cast("bigint")
    return [
        F.sum(total).alias("engagement_sum"),
        F.count(total).alias("engagement_count"),
        F.count(F.lit(1)).alias("post_count"),
        F.count_if(F.col("is_competitor")).alias("competitor_post_count"),
        F.count_if(~F.col("is_competitor")).alias("brand_post_count"),
        F.sum(micro).alias("sentiment_sum"),
        F.count(micro).alias("sentiment_count"),
        F.max("engagement_rate").alias("engagement_rate"),
    ]


def tag_sums(silver: DataFrame, *by: str) -> DataFrame:
    """Sums per hashtag (or other columns), stored. All are numbers."""
    return materialise(silver.groupBy(*(by or ("hashtag",))).agg(*_numbers(), lowest_rate()), "tag-sums")


def tag_partials(silver: DataFrame, *by: str, sums: DataFrame | None = None) -> DataFrame:
    """Sums and best post per hashtag (or other columns) of some of silver; partials of
    parts of it add up to the partials of the whole (`fold_partials`). Who gives the `sums`
    (`tag_sums`) can discard them afterwards."""
    by = by or ("hashtag",)
    found = best_posts(silver, tag_sums(silver, *by) if sums is None else sums, *by)
    return found.select(*by, *SUMS, "place", "top_caption", "engagement_rate")


def tag_partials_at_once(silver: DataFrame, *by: str) -> DataFrame:
    """The rows of `tag_partials` from one scan and one shuffle. Each task sorts its rows, which
    costs less than a second pass where many of them are the best of their group."""
    place = F.struct((-F.col("engagement_rate")).alias("rate"), "post_id")
    best = [F.min(place).alias("place"), F.min_by("caption", place).alias("top_caption")]
    found = silver.groupBy(*by).agg(*_numbers(), *best)
    return found.select(*by, *SUMS, "place", "top_caption", "engagement_rate")


SUMS = (
    "engagement_sum", "engagement_count", "post_count", "competitor_post_count",
    "brand_post_count", "sentiment_sum", "sentiment_count",
)


def fold_partials(partials: DataFrame) -> DataFrame:
    """One partial per hashtag from any number of them."""
    return partials.groupBy("hashtag").agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.min("place").alias("place"),
        F.min_by("top_caption", "place").alias("top_caption"),
        F.max("engagement_rate").alias("engagement_rate"),
    )


def _insights(folded: DataFrame, brand: BrandConfig, rules: Rules) -> DataFrame:
    mean = F.col("engagement_sum").cast("double") / F.col("engagement_count")
    feeling = F.col("sentiment_sum").cast("double") / F.lit(MICRO) / F.col("sentiment_count")
    totals = folded.withColumns(
        {"avg_engagement": mean / F.lit(rules.engagement_scale), "avg_sentiment": feeling}
    )
    return with_signals(totals, brand, rules).select(*INSIGHT.names)


def gold_from_partials(
    partials: DataFrame, brand: BrandConfig, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """The rows of `gold` over all silver that the partials came from."""
    return _insights(fold_partials(partials), brand, rules)


def gold(silver: DataFrame, brand: BrandConfig, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """All insight columns from one scan and one shuffle, for silver that tasks can sort: the
    best post is an aggregate of texts, before which each task sorts its rows."""
    totals = tag_totals(silver, rules, *best_post())
    return with_signals(totals, brand, rules).select(*INSIGHT.names)


def gold_in_passes(
    silver: DataFrame, brand: BrandConfig, rules: Rules = DEFAULT_RULES, sums: DataFrame | None = None
) -> DataFrame:
    """The rows of `gold` for silver of any size: one pass sums numbers per hashtag, a second
    one looks at the posts that reach the best rate of theirs. No task sorts all its rows."""
    return _insights(tag_partials(silver, sums=sums), brand, rules)
