"""Posts -> one enriched row per hashtag. Stateless: the same for batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trendgap.config import DEFAULT_RULES, Rules
from trendgap.functions import text
from trendgap.operators import quality
from trendgap.schemas import HASHTAG_POST


def enrich_posts(posts: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Per-post measures. Done before the explode, so once per post and not per tag."""
    return posts.withColumns(
        {
            "engagement_rate": (F.col("likes") + F.col("comments") + F.col("shares"))
            / F.lit(rules.engagement_scale),
            "sentiment_score": text.sentiment(
                F.col("caption"), rules.lexicon, rules.sentiment_step, rules.sentiment_cap
            ),
            "hour_of_day": F.hour("timestamp"),
            "date_posted": F.to_date("timestamp"),
        }
    )


def explode_tags(posts: DataFrame) -> DataFrame:
    """A repeated tag repeats the row; no tags, no row."""
    return posts.withColumn("hashtag", F.explode("hashtags"))


def hashtag_posts(posts: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Enriched rows per hashtag before the quality rules."""
    engaged = enrich_posts(posts, rules).filter(
        F.col("engagement_rate") >= F.lit(rules.min_engagement)
    )
    return explode_tags(engaged).select(*HASHTAG_POST.names)


def silver(posts: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    return quality.keep_valid(hashtag_posts(posts, rules), quality.SILVER_RULES)
