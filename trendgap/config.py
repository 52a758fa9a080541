"""Parameters: the brand being tracked, thresholds of the rules, table names."""

from __future__ import annotations

from dataclasses import dataclass, field

# The default positive-word lexicon of the sentiment score.
POSITIVE_WORDS = (
    "glow", "natural", "clean", "pure", "love", "radiant",
    "nourish", "gentle", "organic", "earth",
)

UNKNOWN_BRAND = "Unknown"


@dataclass(frozen=True)
class BrandConfig:
    """One brand to report on. `hashtags` are its target tags, in priority order."""

    name: str
    competitors: tuple[str, ...] = ()
    hashtags: tuple[str, ...] = ()
    tone: str = ""
    audience: str = ""
    industry: str = "Beauty & Skincare"


@dataclass(frozen=True)
class Rules:
    """Every threshold in one place; the defaults reproduce the published behaviour."""

    lexicon: tuple[str, ...] = POSITIVE_WORDS
    sentiment_step: float = 0.1
    sentiment_cap: float = 1.0
    engagement_scale: float = 1000.0
    min_engagement: float = 0.01
    velocity_hours: float = 24.0
    dominance_above: float = 0.6
    tag_brand_posts_below: int = 2
    cluster_brand_posts_below: int = 3
    fit_target: float = 1.0
    fit_engaged: float = 0.7
    fit_other: float = 0.3
    engaged_above: float = 0.5
    share_of_likes: float = 0.05
    clusters: int = 5
    seed: int = 42
    text_features: int = 256


@dataclass(frozen=True)
class TableNames:
    """Every reader and writer takes its table name from here."""

    database: str = "trendgap"
    bronze: str = "raw_social_posts"
    unique: str = "unique_social_posts"
    silver: str = "cleaned_trend_metrics"
    gold: str = "brand_insights"
    gaps: str = "competitor_gaps"
    suggestions: str = "content_suggestions"
    events: str = "suggestion_events"
    refused: str = "refused_replies"

    def full(self, short: str) -> str:
        return f"{self.database}.{getattr(self, short)}"


@dataclass(frozen=True)
class PostFormat:
    """How one flavour of normalised post is cut down from a raw scrape."""

    platform: str = "Instagram"
    min_caption: int = 10
    max_caption: int = 500
    max_tags: int = 10
    distinct_tags: bool = True
    permalink: str = "https://instagram.com/p/"


STORED_POST = PostFormat()
FEED_POST_FORMAT = PostFormat(max_caption=300, max_tags=8, distinct_tags=False)

DEFAULT_RULES = Rules()
DEFAULT_TABLES = TableNames()
