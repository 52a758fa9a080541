"""Common table expressions the check SQL is put together from (DuckDB dialect)."""

from trendgap.functions.text import WHITESPACE
from trendgap.plans import fixtures as fx


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


HITS = " + ".join(f"contains(lower(caption), '{w}')::INTEGER" for w in fx.POST_RULES.lexicon)

SENTIMENT = f"least(coalesce({HITS}, 0) * 0.1::DOUBLE, 1::DOUBLE)"

BRONZE = """
bronze AS (SELECT * FROM posts WHERE caption IS NOT NULL AND length(caption) > 10)"""

EXPLODED = f"""
scored AS (
  SELECT *, (likes + comments + shares) / 1000::DOUBLE AS engagement_rate,
         {SENTIMENT} AS sentiment_score
  FROM bronze
),
exploded AS (
  SELECT post_id, platform, brand, unnest(hashtags) AS hashtag, caption, likes, comments, shares,
         engagement_rate, sentiment_score, is_competitor,
         hour(timestamp)::INTEGER AS hour_of_day, timestamp::DATE AS date_posted, timestamp
  FROM scored WHERE engagement_rate >= 0.01::DOUBLE
)"""

SILVER = EXPLODED + """,
silver AS (SELECT * FROM exploded WHERE hashtag IS NOT NULL)"""

GOLD = """
totals AS (
  SELECT hashtag,
         sum(likes + comments + shares)::DOUBLE / count(likes + comments + shares)
           / 1000::DOUBLE AS avg_engagement,
         count(*)::BIGINT AS post_count,
         sum(CASE WHEN is_competitor THEN 1 ELSE 0 END)::BIGINT AS competitor_post_count,
         sum(CASE WHEN NOT is_competitor THEN 1 ELSE 0 END)::BIGINT AS brand_post_count,
         sum(round(sentiment_score * 1000000)::BIGINT)::DOUBLE / 1000000::DOUBLE
           / count(*) AS avg_sentiment
  FROM silver GROUP BY hashtag
),
ranked AS (
  SELECT hashtag, caption AS top_caption, engagement_rate,
         row_number() OVER (PARTITION BY hashtag ORDER BY engagement_rate DESC, post_id) AS place
  FROM silver
),
signals AS (
  SELECT *, post_count / 24::DOUBLE AS trend_velocity,
         competitor_post_count / greatest(post_count, 1)::DOUBLE AS competitor_dominance,
         CASE WHEN hashtag IN ('#red', '#gear', '#ECONOMY10') THEN 1::DOUBLE
              WHEN avg_engagement > 0.5::DOUBLE THEN 0.7::DOUBLE
              ELSE 0.3::DOUBLE END AS brand_fit_score
  FROM totals
),
gold AS (
  SELECT s.hashtag, avg_engagement, post_count, competitor_post_count, brand_post_count,
         avg_sentiment, trend_velocity, competitor_dominance, brand_fit_score,
         competitor_dominance > 0.6::DOUBLE AND brand_post_count < 2 AS opportunity_gap,
         top_caption, engagement_rate
  FROM signals s LEFT JOIN ranked r ON s.hashtag = r.hashtag AND r.place = 1
)"""

TO_SILVER = (fx.POSTS_SQL, BRONZE, SILVER)
TO_GOLD = (*TO_SILVER, GOLD)

BLANKS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)

TAGGED = rf"""
usable AS (
  SELECT * REPLACE (trim(caption, {BLANKS}) AS caption) FROM scrapes
  WHERE length(trim(caption, {BLANKS})) >= 10
),
tagged AS (
  SELECT *,
         list_transform(list_filter(hashtags, lambda t: t <> ''),
                        lambda t: '#' || ltrim(t, '#')) AS given,
         list_transform(regexp_extract_all(caption, '#([\p{{L}}\p{{N}}_]+)', 1),
                        lambda t: '#' || t) AS written,
         sha256(concat_ws(chr(31), coalesce(id, ''), coalesce("shortCode", ''), caption,
                coalesce(array_to_string(hashtags, chr(30)), ''), coalesce("ownerUsername", ''),
                coalesce("ownerId", ''), coalesce("likesCount", ''), likes,
                coalesce("commentsCount", ''), comments, coalesce(timestamp, ''),
                "takenAtTimestamp", coalesce("displayUrl", ''), "previewUrl")) AS digest
  FROM usable
)"""

DETECTED = """
owned AS (
  SELECT *, coalesce(nullif("ownerUsername", ''), nullif("ownerId", ''), '') AS username
  FROM tagged
),
searched AS (SELECT *, lower(caption || ' ' || username) AS haystack FROM owned),
detected AS (
  SELECT *, CASE WHEN contains(haystack, 'src1') THEN 'src1'
                 WHEN contains(haystack, 'src2') THEN 'src2'
                 WHEN contains(haystack, 'src3') THEN 'src3'
                 WHEN contains(haystack, 'src4') THEN 'src4'
                 WHEN contains(haystack, 'src5') THEN 'src5'
                 ELSE 'Unknown' END AS brand,
         CASE WHEN len(coalesce(hashtags, []::VARCHAR[])) > 0 THEN given ELSE written END AS chosen,
         coalesce(nullif(timestamp, ''), "takenAtTimestamp") AS stamp
  FROM searched
)"""


def _count(*columns: str) -> str:
    tried = ", ".join(f"nullif(trunc({c}::DOUBLE)::BIGINT, 0)" for c in columns)
    return f"coalesce({tried}, 0)::BIGINT"


NORMALISED = f"""
counted AS (
  SELECT * REPLACE ({_count('"likesCount"', 'likes')} AS likes,
                    {_count('"commentsCount"', 'comments')} AS comments),
         TRY_CAST(substring(stamp, 1, 10)
                  || regexp_replace(substring(stamp, 11), '(Z|[+-][0-9:]+)$', '') AS TIMESTAMP)
           AS clock_time
  FROM detected
),
normalised AS (
  SELECT coalesce(nullif(id, ''), nullif("shortCode", ''), digest) AS post_id,
         'Instagram' AS platform, brand,
         list_slice(list_filter(chosen, lambda t, i: list_position(chosen, t) = i), 1, 10)
           AS hashtags,
         substring(caption, 1, 500) AS caption, likes, comments,
         greatest(trunc(likes * 0.05::DOUBLE)::BIGINT, 0) AS shares,
         coalesce(clock_time, TIMESTAMP '{fx.DEFAULT_TIME}') AS timestamp,
         brand <> 'src5' AND brand <> 'Unknown' AS is_competitor
  FROM counted
)"""

FEED = f"""
feed AS (
  SELECT coalesce(nullif(id, ''), digest) AS post_id, 'Instagram' AS platform,
         coalesce(nullif("ownerUsername", ''), 'unknown') AS username,
         substring(caption, 1, 300) AS caption,
         list_slice(CASE WHEN len(given) > 0 THEN given ELSE written END, 1, 8) AS hashtags,
         {_count('"likesCount"')} AS likes,
         {_count('"commentsCount"')} AS comments,
         greatest(trunc({_count('"likesCount"')} * 0.05::DOUBLE)::BIGINT, 0) AS shares,
         coalesce(timestamp, '') AS timestamp,
         TRY_CAST(substring(timestamp, 1, 10)
                  || regexp_replace(substring(timestamp, 11), '(Z|[+-][0-9:]+)$', '') AS TIMESTAMP)
           AS posted_at,
         coalesce(nullif("displayUrl", ''), nullif("previewUrl", ''), '') AS thumbnail,
         CASE WHEN "shortCode" <> '' THEN 'https://instagram.com/p/' || "shortCode" ELSE '' END
           AS post_url
  FROM tagged
)"""

NAMES_BRAND = "(contains(lower(caption), 'src5') OR contains(lower(username), 'src5'))"
NAMES_COMPETITOR = "(" + " OR ".join(
    f"contains(lower({c}), '{n}')" for n in fx.FEED_BRAND.competitors for c in ("caption", "username")
) + ")"

TAG_STATS = f"""
mentioned AS (
  SELECT *, {NAMES_BRAND} AS names_brand, {NAMES_COMPETITOR} AS names_competitor FROM feed
),
feed_tags AS (SELECT unnest(hashtags) AS tag, likes + comments AS eng, names_brand FROM mentioned),
brand_tags AS (SELECT DISTINCT tag FROM feed_tags WHERE names_brand),
tag_stats AS (
  SELECT tag, (sum(eng) // count(*))::BIGINT AS avg_engagement, count(*)::BIGINT AS count
  FROM feed_tags GROUP BY tag
),
top8 AS (SELECT * FROM tag_stats ORDER BY avg_engagement DESC, tag LIMIT 8),
gap_tags AS (SELECT * FROM tag_stats WHERE tag NOT IN (SELECT tag FROM brand_tags))"""

TO_FEED = (fx.SCRAPES_SQL, TAGGED, FEED)
TO_TAGS = (*TO_FEED, TAG_STATS)

ROLLUP = """
assigned AS (
  SELECT *, (ascii(substring(hashtag, 2, 1)) * 100
             + coalesce(TRY_CAST(right(hashtag, 2) AS INTEGER), 0))::INTEGER AS cluster
  FROM gold
),
cluster_order AS (
  SELECT cluster, hashtag,
         row_number() OVER (PARTITION BY cluster ORDER BY post_count DESC, hashtag) AS place
  FROM assigned
),
cluster_tags AS (
  SELECT cluster, list(hashtag ORDER BY place) AS top_hashtags
  FROM cluster_order WHERE place <= 3 GROUP BY cluster
),
cluster_totals AS (
  SELECT cluster,
         floor(sum(round(competitor_dominance * 1000000000)::BIGINT)::DOUBLE / 1000000000::DOUBLE
               / count(competitor_dominance) * 10000 + 0.5) / 10000 AS avg_competitor_dominance,
         sum(brand_post_count)::BIGINT AS brand_post_count
  FROM assigned GROUP BY cluster
),
rollup_ AS (
  SELECT t.cluster AS cluster_id, top_hashtags, avg_competitor_dominance, brand_post_count,
         avg_competitor_dominance > 0.6::DOUBLE AND brand_post_count < 3 AS is_gap_cluster
  FROM cluster_totals t JOIN cluster_tags g ON t.cluster = g.cluster
)"""

TO_ROLLUP = (*TO_GOLD, ROLLUP)

STATE = """
last_event AS (
  SELECT suggestion_id,
         arg_max(status, (ts, seq)) AS status,
         arg_max(video_url, (ts, seq)) FILTER (WHERE video_url IS NOT NULL) AS video_url,
         arg_max(reject_reason, (ts, seq)) FILTER (WHERE reject_reason IS NOT NULL)
           AS reject_reason
  FROM status_events GROUP BY suggestion_id
),
state AS (
  SELECT s.* REPLACE (coalesce(e.status, s.status) AS status,
                      coalesce(e.video_url, s.video_url) AS video_url,
                      coalesce(e.reject_reason, s.reject_reason) AS reject_reason)
  FROM suggestions s LEFT JOIN last_event e ON s.suggestion_id = e.suggestion_id
)"""

TO_STATE = (fx.SUGGESTIONS_SQL, fx.STATUS_EVENTS_SQL, STATE)

STATS = """
stats AS (
  SELECT count(*)::BIGINT AS total,
         count(*) FILTER (WHERE status = 'approved')::BIGINT AS approved,
         count(*) FILTER (WHERE status = 'rejected')::BIGINT AS rejected,
         count(*) FILTER (WHERE status = 'pending')::BIGINT AS pending,
         count(*) FILTER (WHERE status = 'video_ready')::BIGINT AS video_ready,
         avg(viral_score) FILTER (WHERE status IN ('approved', 'video_ready')) AS mean_score
  FROM state
)"""

ACCEPTED = """
accepted AS (
  SELECT j.response_id, position::INTEGER AS position, item ->> '$.caption' AS caption,
         CASE WHEN json_type(item, '$.hashtags') = 'ARRAY'
              THEN json_extract_string(item, '$.hashtags[*]')
              ELSE [item ->> '$.hashtags'] END AS hashtags,
         item ->> '$.image_prompt' AS image_prompt,
         trunc((item ->> '$.viral_score')::DOUBLE)::INTEGER AS viral_score,
         item ->> '$.rationale' AS rationale
  FROM judged j JOIN parts p ON j.response_id = p.response_id
  WHERE reason IS NULL
)"""
