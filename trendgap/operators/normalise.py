"""Raw scraped posts -> posts of a fixed schema. One select each, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from trendgap.config import (
    DEFAULT_RULES,
    FEED_POST_FORMAT,
    STORED_POST,
    UNKNOWN_BRAND,
    BrandConfig,
    PostFormat,
    Rules,
)
from trendgap.functions import text, values
from trendgap.schemas import RAW_SCRAPE


def with_usable_caption(raw: DataFrame, min_length: int) -> DataFrame:
    """Trim captions and drop posts whose caption is missing or too short."""
    trimmed = raw.withColumn("caption", text.strip(F.col("caption")))
    return trimmed.filter(F.length("caption") >= max(min_length, 1))


def row_digest(raw: DataFrame) -> Column:
    """Stand-in id of a post that has none: the same on every retry, unlike a uuid."""
    fields = [
        F.array_join(f.name, "\x1e") if isinstance(f.dataType, ArrayType) else F.col(f.name)
        for f in raw.schema
        if f.name in RAW_SCRAPE.names
    ]
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(f, F.lit("")) for f in fields]), 256)


def with_brand(posts: DataFrame, brand: BrandConfig) -> DataFrame:
    """Add the brand found in caption or user name, and whether it is a competitor."""
    searched = posts.withColumn("searched", text.lowered(F.col("caption"), F.col("username")))
    found = searched.withColumn("brand", text.first_brand(brand, F.col("searched")))
    competitor = (F.col("brand") != brand.name) & (F.col("brand") != UNKNOWN_BRAND)
    return found.withColumn("is_competitor", competitor).drop("searched")


def normalise_posts(
    raw: DataFrame,
    brand: BrandConfig,
    default_time: Column,
    rules: Rules = DEFAULT_RULES,
    form: PostFormat = STORED_POST,
) -> DataFrame:
    """Stored flavour: brand detected, timestamp parsed.

    `default_time` replaces unreadable timestamps; pass `current_timestamp()` for
    the time of the run.
    """
    named = with_usable_caption(raw, form.min_caption).select(
        text.first_filled(F.col("id"), F.col("shortCode"), row_digest(raw)).alias("post_id"),
        "caption",
        "hashtags",
        text.first_filled(F.col("ownerUsername"), F.col("ownerId"), "").alias("username"),
        values.first_count(F.col("likesCount"), F.col("likes")).alias("likes"),
        values.first_count(F.col("commentsCount"), F.col("comments")).alias("comments"),
        text.first_filled(F.col("timestamp"), F.col("takenAtTimestamp"), "").alias("written"),
    )
    return with_brand(named, brand).select(
        "post_id",
        F.lit(form.platform).alias("platform"),
        "brand",
        text.choose_tags(
            F.col("caption"), F.col("hashtags"), form.distinct_tags, form.max_tags
        ).alias("hashtags"),
        F.substring("caption", 1, form.max_caption).alias("caption"),
        "likes",
        "comments",
        values.estimated_shares(F.col("likes"), rules.share_of_likes).alias("shares"),
        values.iso_to_utc(F.col("written"), default_time).alias("timestamp"),
        "is_competitor",
    )


def normalise_feed(
    raw: DataFrame, rules: Rules = DEFAULT_RULES, form: PostFormat = FEED_POST_FORMAT
) -> DataFrame:
    """Feed flavour: user name, thumbnail and link kept, timestamp left as text."""
    counted = with_usable_caption(raw, form.min_caption).select(
        text.first_filled(F.col("id"), row_digest(raw)).alias("post_id"),
        text.first_filled(F.col("ownerUsername"), "unknown").alias("username"),
        "caption",
        "hashtags",
        values.first_count(F.col("likesCount")).alias("likes"),
        values.first_count(F.col("commentsCount")).alias("comments"),
        text.first_filled(F.col("timestamp"), "").alias("timestamp"),
        text.first_filled(F.col("displayUrl"), F.col("previewUrl"), "").alias("thumbnail"),
        F.when(F.col("shortCode") != "", F.concat(F.lit(form.permalink), "shortCode"))
        .otherwise("")
        .alias("post_url"),
    )
    return counted.select(
        "post_id",
        F.lit(form.platform).alias("platform"),
        "username",
        F.substring("caption", 1, form.max_caption).alias("caption"),
        text.choose_tags(
            F.col("caption"), F.col("hashtags"), form.distinct_tags, form.max_tags
        ).alias("hashtags"),
        "likes",
        "comments",
        values.estimated_shares(F.col("likes"), rules.share_of_likes).alias("shares"),
        "timestamp",
        "thumbnail",
        "post_url",
    )
