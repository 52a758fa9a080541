"""Queries the dashboard and the prompt builder ask of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trendgap.functions.values import round_half_up, score_tier

PENDING, APPROVED, REJECTED, VIDEO_READY = "pending", "approved", "rejected", "video_ready"
NOT_FOUND = "not_found"


def best_fit_tags(gold: DataFrame, n: int = 3) -> DataFrame:
    return (
        gold.select("hashtag", "avg_engagement", "brand_fit_score")
        .orderBy(F.desc("brand_fit_score"), F.desc("avg_engagement"), F.asc("hashtag"))
        .limit(n)
    )


def top_gap(gaps: DataFrame, default_tag: str) -> DataFrame:
    """One row: leading tag of the gap cluster competitors own most."""
    worst = (
        gaps.filter("is_gap_cluster")
        .orderBy(F.desc("avg_competitor_dominance"), F.asc("cluster_id"))
        .limit(1)
    )
    tag = worst.agg(F.max(F.try_element_at("top_hashtags", F.lit(1))).alias("tag"))
    return tag.select(F.coalesce("tag", F.lit(default_tag)).alias("hashtag"))


def top_suggestions(suggestions: DataFrame, n: int = 3) -> DataFrame:
    """Highest viral scores, every missing field replaced by its display default."""
    best = suggestions.orderBy(F.desc_nulls_last("viral_score"), F.asc("suggestion_id")).limit(n)

    def filled(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default).alias(name)

    return best.select(
        "suggestion_id",
        filled("caption", F.lit("")),
        filled("hashtags", F.array().cast("array<string>")),
        filled("image_prompt", F.lit("")),
        filled("viral_score", F.lit(0)),
        filled("rationale", F.lit("")),
        F.coalesce(F.nullif("status", F.lit("")), F.lit(PENDING)).alias("status"),
        "video_url",
    )


def count_tags(gold: DataFrame) -> DataFrame:
    return gold.agg(F.count_distinct("hashtag").alias("trending"))


def count_gaps(gaps: DataFrame) -> DataFrame:
    return gaps.filter("is_gap_cluster").agg(F.count(F.lit(1)).alias("gaps"))


def feedback_stats(suggestions: DataFrame) -> DataFrame:
    """Counts per status, approval rate in percent, mean score of what was approved.

    Without suggestions every figure is zero.
    """

    def having(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(status)

    counted = suggestions.agg(
        F.count(F.lit(1)).alias("total"),
        *[having(s) for s in (APPROVED, REJECTED, PENDING, VIDEO_READY)],
        F.avg(
            F.when(F.col("status").isin(APPROVED, VIDEO_READY), F.col("viral_score"))
        ).alias("mean_score"),
    )
    rate = F.when(
        F.col("total") > 0, F.col(APPROVED) / F.greatest("total", F.lit(1)) * F.lit(100.0)
    ).otherwise(F.lit(0.0))
    return counted.select(
        "total",
        APPROVED,
        REJECTED,
        PENDING,
        VIDEO_READY,
        round_half_up(rate, 1).alias("approve_rate"),
        round_half_up(F.coalesce("mean_score", F.lit(0.0)), 1).alias("avg_viral_score_approved"),
    )


def status_breakdown(stats: DataFrame) -> DataFrame:
    """The four counts as rows, zeros included."""
    # Labels of the chart.
    labels = {
        "Pending": PENDING,
        "Approved": APPROVED,
        "Video Ready": VIDEO_READY,
        "Rejected": REJECTED,
    }
    lines = [
        F.struct(F.lit(label).alias("label"), F.col(status).alias("suggestions"))
        for label, status in labels.items()
    ]
    return stats.select(F.inline(F.array(*lines)))


def headline_metrics(gold: DataFrame, gaps: DataFrame, suggestions: DataFrame) -> DataFrame:
    stats = feedback_stats(suggestions)
    return stats.select(
        count_tags(gold).scalar().alias("trending"),
        count_gaps(gaps).scalar().alias("gaps"),
        F.col("total").alias("suggestions"),
        F.col(VIDEO_READY).alias("videos"),
    )


def look_up_status(ids: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Status and video link per requested id; unknown ids say so.

    Requests may repeat one id very often. With a stored table as `suggestions`, both
    join inputs are plain shuffles and adaptive execution splits the overfull one.
    """
    known = suggestions.select("suggestion_id", "status", "video_url")
    return ids.join(known, "suggestion_id", "left").withColumn(
        "status", F.coalesce("status", F.lit(NOT_FOUND))
    )


def look_up_prompt(ids: DataFrame, suggestions: DataFrame, default_prompt: str) -> DataFrame:
    """Image prompt per requested id, or the default where there is none."""
    known = suggestions.select("suggestion_id", "image_prompt")
    return ids.join(known, "suggestion_id", "left").withColumn(
        "image_prompt",
        F.coalesce(F.nullif("image_prompt", F.lit("")), F.lit(default_prompt)),
    )


def with_tier(suggestions: DataFrame) -> DataFrame:
    return suggestions.withColumn("tier", score_tier(F.col("viral_score")))
