"""Explicit schemas: no reader in this package infers one."""

from pyspark.sql import types as T

TEXT, LONG, INT, DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
FLAG, TIME, DATE, TEXTS = T.BooleanType(), T.TimestampType(), T.DateType(), T.ArrayType(TEXT)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# A scraped post as it arrives. Scalars are read as text: scrapers send ids and
# counts as numbers or strings, and a typed field would null the whole value.
RAW_SCRAPE = _struct(
    id=TEXT, shortCode=TEXT, caption=TEXT, hashtags=TEXTS, ownerUsername=TEXT, ownerId=TEXT,
    likesCount=TEXT, likes=TEXT, commentsCount=TEXT, comments=TEXT, timestamp=TEXT,
    takenAtTimestamp=TEXT, displayUrl=TEXT, previewUrl=TEXT,
)

POST = _struct(
    post_id=TEXT, platform=TEXT, brand=TEXT, hashtags=TEXTS, caption=TEXT, likes=LONG,
    comments=LONG, shares=LONG, timestamp=TIME, is_competitor=FLAG,
)

FEED_POST = _struct(
    post_id=TEXT, platform=TEXT, username=TEXT, caption=TEXT, hashtags=TEXTS, likes=LONG,
    comments=LONG, shares=LONG, timestamp=TEXT, thumbnail=TEXT, post_url=TEXT,
)

HASHTAG_POST = _struct(
    post_id=TEXT, platform=TEXT, brand=TEXT, hashtag=TEXT, caption=TEXT, likes=LONG,
    comments=LONG, shares=LONG, engagement_rate=DOUBLE, sentiment_score=DOUBLE,
    is_competitor=FLAG, hour_of_day=INT, date_posted=DATE, timestamp=TIME,
)

INSIGHT = _struct(
    hashtag=TEXT, avg_engagement=DOUBLE, post_count=LONG, competitor_post_count=LONG,
    brand_post_count=LONG, avg_sentiment=DOUBLE, trend_velocity=DOUBLE,
    competitor_dominance=DOUBLE, brand_fit_score=DOUBLE, opportunity_gap=FLAG,
    top_caption=TEXT, engagement_rate=DOUBLE,
)

# What insights add up from (operators/gold.py).
PARTIAL = _struct(
    hashtag=TEXT, engagement_sum=LONG, engagement_count=LONG, post_count=LONG,
    competitor_post_count=LONG, brand_post_count=LONG, sentiment_sum=LONG,
    sentiment_count=LONG, place=_struct(rate=DOUBLE, post_id=TEXT), top_caption=TEXT,
    engagement_rate=DOUBLE,
)

GAP_CLUSTER = _struct(
    cluster_id=INT, top_hashtags=TEXTS, avg_competitor_dominance=DOUBLE,
    brand_post_count=LONG, is_gap_cluster=FLAG,
)

SUGGESTION = _struct(
    suggestion_id=TEXT, caption=TEXT, hashtags=TEXTS, image_prompt=TEXT, viral_score=INT,
    rationale=TEXT, status=TEXT, video_url=TEXT, brand=TEXT, created_at=TIME,
    reject_reason=TEXT,
)

STATUS_EVENT = _struct(
    suggestion_id=TEXT, ts=TIME, seq=LONG, status=TEXT, reject_reason=TEXT, video_url=TEXT,
)

# What a rule found, and lines that are no posts (streaming/audit.py).
FIGURE = _struct(rule=TEXT, action=TEXT, checked=LONG, violations=LONG, kept=LONG)

DEAD_LETTER = _struct(file=TEXT, block_start=LONG, line=TEXT)
