"""Trend summary of a batch of feed posts for any brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trendgap.config import BrandConfig
from trendgap.functions import text, values

FALLBACK_TAG = "#Trending"


def by_engagement() -> tuple[Column, ...]:
    return F.desc("avg_engagement"), F.asc("tag")


def newest_first() -> tuple[Column, ...]:
    """By the time the feed's text stands for; texts that are no time come last. Spark
    rows have no order of arrival to go by."""
    time = values.iso_to_utc(F.col("timestamp"), F.lit(None).cast("timestamp"))
    return time.desc_nulls_last(), F.asc("post_id")


def with_mentions(posts: DataFrame, brand: BrandConfig) -> DataFrame:
    """Flag posts naming a competitor, and posts naming the brand itself."""
    lowered = posts.withColumns(
        {
            "lower_caption": text.lowered(F.col("caption")),
            "lower_user": text.lowered(F.col("username")),
        }
    )
    places = F.col("lower_caption"), F.col("lower_user")
    return lowered.withColumns(
        {
            "names_competitor": text.contains_any(brand.competitors, *places),
            "names_brand": text.contains_any([brand.name], *places),
        }
    ).drop("lower_caption", "lower_user")


def _per_tag(posts: DataFrame, brand: BrandConfig, entries: Column) -> DataFrame:
    """Counts per entry. The outer explode adds a NULL for posts without entries; the
    plain one adds a size filter that Spark moves below the normalisation of the posts,
    which would then search every caption for tags a second and a third time."""
    tagged = with_mentions(posts, brand).select(
        F.explode_outer(entries).alias("tag"),
        (F.col("likes") + F.col("comments")).alias("engagement"),
        "names_brand",
        "names_competitor",
    )
    return tagged.groupBy("tag").agg(
        F.expr("sum(engagement) div count(*)").alias("avg_engagement"),
        F.count(F.lit(1)).alias("count"),
        F.bool_or("names_brand").alias("used_by_brand"),
        F.count_if("names_brand").alias("brand_posts"),
        F.count_if("names_competitor").alias("competitor_posts"),
    )


def tag_stats(posts: DataFrame, brand: BrandConfig) -> DataFrame:
    """Per tag: occurrences, mean of likes + comments (cut to a whole number), and
    whether a post naming the brand uses it. One aggregate answers all three."""
    stats = _per_tag(posts, brand, F.col("hashtags")).filter(F.col("tag").isNotNull())
    return stats.select("tag", "avg_engagement", "count", "used_by_brand")


def top_tags(stats: DataFrame, n: int = 8) -> DataFrame:
    return stats.orderBy(*by_engagement()).limit(n)


def brand_tags(stats: DataFrame) -> DataFrame:
    """Distinct tags of the posts naming the brand."""
    return stats.filter("used_by_brand").select("tag")


def gap_tags(stats: DataFrame) -> DataFrame:
    """Tags no post naming the brand uses."""
    return stats.filter(~F.col("used_by_brand"))


def mention_counts(posts: DataFrame, brand: BrandConfig) -> DataFrame:
    return with_mentions(posts, brand).agg(
        F.count_if("names_competitor").alias("competitor_count"),
        F.count_if("names_brand").alias("brand_post_count"),
        F.count(F.lit(1)).alias("total_posts"),
    )


def first_posts(posts: DataFrame, n: int = 12) -> DataFrame:
    return posts.orderBy(*newest_first()).limit(n)


def preview(posts: DataFrame, n: int = 6, tags: int = 3) -> DataFrame:
    """Newest posts that have a caption, with their first few tags."""
    captioned = posts.filter(F.col("caption") != "")
    return first_posts(captioned, n).withColumn("hashtags", F.slice("hashtags", 1, tags))


def share_of_max(top: DataFrame) -> DataFrame:
    """Bar length of each tag in percent of the longest."""
    longest = top.agg(F.coalesce(F.nullif(F.max("avg_engagement"), F.lit(0)), F.lit(1))).scalar()
    return top.withColumn("share", F.col("avg_engagement") / longest * F.lit(100.0))


def _newest(posts: DataFrame, n: int) -> Column:
    """The newest posts as one ordered array, as a scalar subquery."""
    placed = first_posts(posts, n).select(
        F.row_number().over(Window.orderBy(*newest_first())).alias("place"),
        F.struct(*posts.columns).alias("post"),
    )
    in_order = F.array_sort(F.collect_list(F.struct("place", "post")))
    return placed.agg(F.transform(in_order, lambda p: p["post"])).scalar()


def trend_summary(
    posts: DataFrame, brand: BrandConfig, n_posts: int = 12, n_tags: int = 8
) -> DataFrame:
    """One row with everything the dashboard and the prompt need.

    Every post also counts under a tag of NULL, so the totals come out of the aggregate
    that serves the tags: one scan, plus one for the newest posts. Of the tags the brand
    uses, and of those it does not, each task passes on its first `n_tags` only.
    """
    entries = F.concat(
        F.array(F.lit(None).cast("string")),
        F.array_compact(F.coalesce("hashtags", F.array().cast("array<string>"))),
    )
    stats = _per_tag(posts, brand, entries)
    group = F.when(F.col("tag").isNotNull(), F.col("used_by_brand"))
    best_first = Window.partitionBy(group).orderBy(*by_engagement())
    leaders = stats.withColumn("place", F.row_number().over(best_first)).filter(
        F.col("place") <= n_tags
    )
    line = F.struct(
        (-F.col("avg_engagement")).alias("order"), "tag", "avg_engagement", "count"
    )
    is_tag = F.col("tag").isNotNull()
    ranked = F.array_sort(F.collect_list(F.when(is_tag, line)))
    gaps = F.array_sort(F.collect_list(F.when(is_tag & ~F.col("used_by_brand"), line)))

    def total(column: str) -> Column:
        return F.coalesce(F.max(F.when(~is_tag, F.col(column))), F.lit(0))

    fallback = brand.hashtags[0] if brand.hashtags else FALLBACK_TAG
    return leaders.agg(
        _newest(posts, n_posts).alias("posts"),
        F.transform(
            F.slice(ranked, 1, n_tags),
            lambda t: F.struct(t["tag"], t["avg_engagement"], t["count"]),
        ).alias("top_hashtags"),
        total("competitor_posts").alias("competitor_count"),
        total("brand_posts").alias("brand_post_count"),
        F.coalesce(F.get(gaps, F.lit(0))["tag"], F.lit(fallback)).alias("gap_hashtag"),
        F.coalesce(F.get(gaps, F.lit(0))["avg_engagement"], F.lit(0)).alias("gap_engagement"),
        total("count").alias("total_posts"),
    )
