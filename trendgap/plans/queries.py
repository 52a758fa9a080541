"""Every registered query: the Spark side, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trendgap.config import BrandConfig, TableNames
from trendgap.functions import text, values
from trendgap.operators import (
    brands,
    feedback,
    gaps,
    gold,
    normalise,
    quality,
    serving,
    silver,
    suggestions,
    trends,
)
from trendgap.plans import fixtures as fx, oracle_parts as sql
from trendgap.plans.medallion import (
    bronze,
    current_suggestions,
    insights_from,
    judge_replies,
    record_decisions,
    refresh_gaps,
    refresh_tables,
    silver_from,
    store_judged,
    store_replies,
)
from trendgap.plans.oracle_parts import with_
from trendgap.sources import posts as post_files
from trendgap.schemas import SUGGESTION
from trendgap.sources.storage import append_table, discard, ensure_database, materialise, shared_path
from trendgap.streaming import audit, medallion as stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(check: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its name, with its check SQL if there is any."""

    def register(fn: Query) -> Query:
        @wraps(fn)
        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = in_utc
        if check is not None:
            ORACLES[fn.__name__] = check
        return in_utc

    return register


def joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


def plain_time(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz").alias(column)


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.posts_from_lineitem(spark, sf_dir)


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_from(_posts(spark, sf_dir), fx.POST_RULES)


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights_from(_posts(spark, sf_dir), fx.POST_BRAND, fx.POST_RULES)


def _gold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insights as a stored table, for queries that read them more than once."""
    return materialise(_gold(spark, sf_dir), "gold")


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.normalise_feed(fx.scrapes_from_documents(spark, sf_dir))


def _tag_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.tag_stats(_feed(spark, sf_dir), fx.FEED_BRAND)


def _assigned(insights: DataFrame) -> DataFrame:
    """Insights with a cluster number any engine can compute, in place of KMeans."""
    letter = F.ascii(F.substring("hashtag", 2, 1))
    number = F.coalesce(F.right("hashtag", F.lit(2)).try_cast("int"), F.lit(0))
    return insights.withColumn("cluster", letter * 100 + number)


def _rollup(insights: DataFrame) -> DataFrame:
    return gaps.cluster_rollup(_assigned(insights), fx.POST_RULES)


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.current_state(
        fx.suggestions_from_customers(spark, sf_dir), fx.status_events(spark, sf_dir)
    )


# --- Medallion ------------------------------------------------------------------------

GOLD_CHECK = with_(*sql.TO_GOLD) + "SELECT * FROM gold"


@query(GOLD_CHECK)
def gold_brand_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir)


def _report_sql(source: str, *rules: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule, '{action}' AS action, count(*)::BIGINT AS checked,"
        f" count(*) FILTER (WHERE ({predicate}) IS NOT TRUE)::BIGINT AS violations,"
        + (
            f" count(*) FILTER (WHERE {predicate})::BIGINT AS kept"
            if action == "drop"
            else " count(*)::BIGINT AS kept"
        )
        + f" FROM {source}"
        for name, action, predicate in rules
    )


@query(
    with_(fx.POSTS_SQL)
    + _report_sql(
        "posts",
        ("valid_engagement", "warn", "likes >= 0 AND comments >= 0 AND shares >= 0"),
        ("has_caption", "drop", "caption IS NOT NULL AND length(caption) > 10"),
    )
)
def bronze_expectations_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_posts(spark, sf_dir), quality.BRONZE_RULES)


@query(
    with_(fx.POSTS_SQL, sql.BRONZE, sql.EXPLODED)
    + _report_sql(
        "exploded",
        ("has_hashtag", "drop", "hashtag IS NOT NULL"),
        ("valid_sentiment", "warn", "sentiment_score BETWEEN 0 AND 1"),
    )
)
def silver_expectations_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = silver.hashtag_posts(bronze(_posts(spark, sf_dir)), fx.POST_RULES)
    return quality.report(rows, quality.SILVER_RULES)


@query(with_(*sql.TO_SILVER) + "SELECT * FROM silver")
def silver_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver(spark, sf_dir).withColumn("timestamp", plain_time("timestamp"))


@query(
    with_(fx.EVENT_POSTS_SQL)
    + """
SELECT date_posted, hour_of_day, count(*)::BIGINT AS posts, sum(likes)::BIGINT AS likes
FROM (SELECT *, unnest(hashtags) AS hashtag, hour(timestamp)::INTEGER AS hour_of_day,
             timestamp::DATE AS date_posted
      FROM event_posts
      WHERE length(caption) > 10 AND (likes + comments + shares) / 1000::DOUBLE >= 0.01::DOUBLE)
GROUP BY date_posted, hour_of_day"""
)
def silver_hour_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = silver_from(fx.posts_from_events(spark, sf_dir), fx.POST_RULES)
    return rows.groupBy("date_posted", "hour_of_day").agg(
        F.count(F.lit(1)).alias("posts"), F.sum("likes").alias("likes")
    )


@query(
    with_(fx.POSTS_SQL)
    + f"SELECT post_id, coalesce({sql.HITS}, 0)::INTEGER AS hits, {sql.SENTIMENT} AS sentiment_score"
    " FROM posts"
)
def sentiment_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = fx.POST_RULES
    caption = F.col("caption")
    return _posts(spark, sf_dir).select(
        "post_id",
        text.lexicon_hits(caption, rules.lexicon).alias("hits"),
        text.sentiment(
            caption, rules.lexicon, rules.sentiment_step, rules.sentiment_cap
        ).alias("sentiment_score"),
    )


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = gold.tag_totals(_silver(spark, sf_dir), fx.POST_RULES)
    return gold.with_signals(totals, fx.POST_BRAND, fx.POST_RULES)


@query(
    with_(*sql.TO_GOLD)
    + "SELECT hashtag, avg_engagement, post_count, avg_sentiment, trend_velocity FROM gold"
)
def hashtag_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select(
        "hashtag", "avg_engagement", "post_count", "avg_sentiment", "trend_velocity"
    )


@query(
    with_(*sql.TO_GOLD)
    + "SELECT hashtag, competitor_post_count, brand_post_count, competitor_dominance FROM gold"
)
def competitor_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select(
        "hashtag", "competitor_post_count", "brand_post_count", "competitor_dominance"
    )


@query(with_(*sql.TO_GOLD) + "SELECT hashtag, brand_fit_score FROM gold")
def brand_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("hashtag", "brand_fit_score")


@query(
    with_(*sql.TO_GOLD)
    + "SELECT hashtag, competitor_dominance, brand_post_count FROM gold WHERE opportunity_gap"
)
def opportunity_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _signals(spark, sf_dir).filter("opportunity_gap")
    return found.select("hashtag", "competitor_dominance", "brand_post_count")


@query(with_(*sql.TO_GOLD) + "SELECT hashtag, top_caption, engagement_rate FROM gold")
def top_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.top_caption(_silver(spark, sf_dir))


# --- Normalisation --------------------------------------------------------------------

LIST_AS_TEXT = "* REPLACE (array_to_string(hashtags, ',') AS hashtags)"
FEED_AS_TEXT = LIST_AS_TEXT.replace("*", "* EXCLUDE (posted_at)")


def _default_time() -> Column:
    return F.lit(fx.DEFAULT_TIME).cast("timestamp")


NORMALISE_CHECK = (
    with_(fx.SCRAPES_SQL, sql.TAGGED, sql.DETECTED, sql.NORMALISED)
    + f"SELECT {LIST_AS_TEXT} FROM normalised"
)


@query(NORMALISE_CHECK)
def normalise_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = normalise.normalise_posts(
        fx.scrapes_from_documents(spark, sf_dir), fx.FEED_BRAND, _default_time()
    )
    return posts.withColumns({"hashtags": joined("hashtags"), "timestamp": plain_time("timestamp")})


@query(with_(*sql.TO_FEED) + f"SELECT {FEED_AS_TEXT} FROM feed")
def normalise_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir).withColumn("hashtags", joined("hashtags"))


@query(
    with_(fx.SCRAPES_SQL, sql.TAGGED)
    + """
SELECT id, "shortCode", array_to_string(given, ',') AS given, array_to_string(written, ',') AS written,
       digest
FROM tagged"""
)
def extract_hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    scrapes = fx.scrapes_from_documents(spark, sf_dir)
    usable = normalise.with_usable_caption(scrapes, 10)
    return usable.select(
        "id",
        "shortCode",
        F.array_join(text.clean_tags(F.col("hashtags")), ",").alias("given"),
        F.array_join(text.extract_tags(F.col("caption")), ",").alias("written"),
        normalise.row_digest(scrapes).alias("digest"),
    )


@query(
    with_(fx.SCRAPES_SQL, sql.TAGGED, sql.DETECTED)
    + """
SELECT username, brand, brand <> 'src5' AND brand <> 'Unknown' AS is_competitor,
       count(*)::BIGINT AS posts
FROM detected GROUP BY username, brand"""
)
def detect_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = normalise.with_usable_caption(fx.scrapes_from_documents(spark, sf_dir), 10)
    user = text.first_filled(F.col("ownerUsername"), F.col("ownerId"), "")
    found = normalise.with_brand(usable.select(user.alias("username"), "caption"), fx.FEED_BRAND)
    return found.groupBy("username", "brand", "is_competitor").agg(F.count(F.lit(1)).alias("posts"))


@query(
    with_(fx.SCRAPES_SQL, sql.TAGGED, sql.DETECTED)
    + """
SELECT username, brand, brand <> 'src5' AND brand <> 'Unknown' AS is_competitor,
       count(*)::BIGINT AS posts
FROM detected GROUP BY username, brand"""
)
def detect_brand_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `detect_brand`, the brands being a table."""
    usable = normalise.with_usable_caption(fx.scrapes_from_documents(spark, sf_dir), 10)
    user = text.first_filled(F.col("ownerUsername"), F.col("ownerId"), "")
    posts = usable.select(user.alias("username"), "caption")
    known = fx.brand_table(spark, fx.FEED_BRAND)
    found = brands.first_brands(posts, text.lowered(F.col("caption"), F.col("username")), known)
    own = F.col("brand").isin(fx.FEED_BRAND.name, "Unknown")
    return found.groupBy("username", "brand", (~own).alias("is_competitor")).agg(F.count(F.lit(1)).alias("posts"))


@query(
    with_(fx.POSTS_SQL, fx.PART_BRANDS_SQL)
    + """,
hits AS (
  SELECT post_id, min(struct_pack(p := priority, n := name)) AS hit
  FROM posts JOIN part_brands ON contains(lower(caption), lower(name)) GROUP BY post_id
)
SELECT coalesce(hit.n, 'Unknown') AS brand, count(*)::BIGINT AS posts, min(post_id) AS first_post
FROM posts LEFT JOIN hits USING (post_id) GROUP BY ALL"""
)
def detect_long_brand_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name, type and container word is a brand; shorter names come first."""
    found = brands.first_brands(
        _posts(spark, sf_dir).select("post_id", "caption"), F.lower("caption"), fx.part_brands(spark, sf_dir)
    )
    return found.groupBy("brand").agg(
        F.count(F.lit(1)).alias("posts"), F.min("post_id").alias("first_post")
    )


@query(
    with_(*sql.TO_SILVER)
    + """,
brand_table AS (SELECT DISTINCT p_brand AS name FROM part),
viewed AS (
  SELECT name, s.* EXCLUDE (is_competitor), s.brand <> name AND s.brand <> 'Unknown' AS is_competitor
  FROM silver s, brand_table
),
totals AS (
  SELECT name, hashtag,
         sum(likes + comments + shares)::DOUBLE / count(likes + comments + shares)
           / 1000::DOUBLE AS avg_engagement,
         count(*)::BIGINT AS post_count,
         sum(CASE WHEN is_competitor THEN 1 ELSE 0 END)::BIGINT AS competitor_post_count,
         sum(CASE WHEN NOT is_competitor THEN 1 ELSE 0 END)::BIGINT AS brand_post_count,
         sum(round(sentiment_score * 1000000)::BIGINT)::DOUBLE / 1000000::DOUBLE
           / count(*) AS avg_sentiment
  FROM viewed GROUP BY name, hashtag
),
ranked AS (
  SELECT hashtag, caption AS top_caption, engagement_rate,
         row_number() OVER (PARTITION BY hashtag ORDER BY engagement_rate DESC, post_id) AS place
  FROM silver
)
SELECT name AS brand, t.hashtag, avg_engagement, post_count, competitor_post_count, brand_post_count,
       avg_sentiment, post_count / 24::DOUBLE AS trend_velocity,
       competitor_post_count / greatest(post_count, 1)::DOUBLE AS competitor_dominance,
       CASE WHEN t.hashtag = '#' || lower(replace(name, 'Brand#', 'red')) OR t.hashtag = '#red' THEN 1::DOUBLE
            WHEN avg_engagement > 0.5::DOUBLE THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS brand_fit_score,
       competitor_post_count / greatest(post_count, 1)::DOUBLE > 0.6::DOUBLE
         AND brand_post_count < 2 AS opportunity_gap,
       top_caption, engagement_rate
FROM totals t JOIN ranked r ON r.hashtag = t.hashtag AND place = 1"""
)
def gold_for_all_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The insights of each of the brands that parts have."""
    known = fx.table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    tags = F.array(F.lit("#red"), F.concat(F.lit("#"), F.lower(F.replace("name", F.lit("Brand#"), F.lit("red")))))
    return brands.gold_for_brands(_silver(spark, sf_dir), known.withColumn("hashtags", tags), fx.POST_RULES)


@query(
    with_(fx.SCRAPES_SQL)
    + f"""
SELECT timestamp AS written,
       coalesce(TRY_CAST(substring(timestamp, 1, 10)
                || regexp_replace(substring(timestamp, 11), '(Z|[+-][0-9:]+)$', '') AS TIMESTAMP),
                TIMESTAMP '{fx.DEFAULT_TIME}') AS read
FROM scrapes"""
)
def normalise_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    scrapes = fx.scrapes_from_documents(spark, sf_dir)
    return scrapes.select(
        F.col("timestamp").alias("written"),
        values.iso_to_utc(F.col("timestamp"), _default_time()).cast("timestamp_ntz").alias("read"),
    )


@query(
    """
WITH typed AS (
  SELECT source, [' #' || lang || ' ', lang, '##' || source, '', source || '#x'] AS tags
  FROM documents
),
bare AS (
  SELECT source, tags,
         list_filter(list_transform(tags, lambda t: regexp_replace(trim(t), '^#', '')),
                     lambda t: t <> '') AS kept
  FROM typed
),
marked AS (SELECT source, tags, list_transform(kept, lambda t: '#' || t) AS marked FROM bare),
once AS (
  SELECT source, tags, list_filter(marked, lambda t, i: list_position(marked, t) = i) AS marked
  FROM marked
)
SELECT source, array_to_string(marked, ',') AS tags,
       array_to_string(list_transform(marked, lambda t: ltrim(t, '#')), ',') AS search,
       array_to_string(list_transform(tags, lambda t: regexp_replace(t, '#', '')), ',') AS names
FROM once"""
)
def config_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = fx.documents(spark, sf_dir).select(
        "source",
        F.array(
            F.concat(F.lit(" #"), "lang", F.lit(" ")),
            F.col("lang"),
            F.concat(F.lit("##"), "source"),
            F.lit(""),
            F.concat("source", F.lit("#x")),
        ).alias("typed"),
    )
    tags = text.config_tags(F.col("typed"))
    return typed.select(
        "source",
        F.array_join(tags, ",").alias("tags"),
        F.array_join(text.search_tags(tags), ",").alias("search"),
        F.array_join(text.competitor_names(F.col("typed")), ",").alias("names"),
    )


# --- Trends ---------------------------------------------------------------------------


@query(with_(*sql.TO_TAGS) + "SELECT * FROM top8")
def trend_tags_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.top_tags(_tag_stats(spark, sf_dir)).drop("used_by_brand")


@query(
    with_(*sql.TO_TAGS)
    + """
SELECT tag, avg_engagement,
       avg_engagement / coalesce(nullif(max(avg_engagement) OVER (), 0), 1)::DOUBLE * 100 AS share
FROM top8"""
)
def tag_share_of_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = trends.top_tags(_tag_stats(spark, sf_dir))
    return trends.share_of_max(top).select("tag", "avg_engagement", "share")


@query(
    with_(*sql.TO_TAGS)
    + """
SELECT count(*) FILTER (WHERE names_competitor)::BIGINT AS competitor_count,
       count(*) FILTER (WHERE names_brand)::BIGINT AS brand_post_count,
       count(*)::BIGINT AS total_posts
FROM mentioned"""
)
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.mention_counts(_feed(spark, sf_dir), fx.FEED_BRAND)


@query(with_(*sql.TO_TAGS) + "SELECT tag FROM brand_tags")
def brand_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.brand_tags(_tag_stats(spark, sf_dir))


@query(with_(*sql.TO_TAGS) + "SELECT * FROM gap_tags")
def gap_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.gap_tags(_tag_stats(spark, sf_dir)).drop("used_by_brand")


NEWEST = "posted_at DESC NULLS LAST, post_id"
FIRST_12 = f"SELECT * FROM feed ORDER BY {NEWEST} LIMIT 12"

SUMMARY_SQL = f"""
SELECT count(*) FILTER (WHERE names_competitor)::BIGINT AS competitor_count,
       count(*) FILTER (WHERE names_brand)::BIGINT AS brand_post_count,
       count(*)::BIGINT AS total_posts,
       coalesce((SELECT tag FROM gap_tags ORDER BY avg_engagement DESC, tag LIMIT 1), '#home')
         AS gap_hashtag,
       coalesce((SELECT avg_engagement FROM gap_tags ORDER BY avg_engagement DESC, tag LIMIT 1), 0)
         AS gap_engagement,
       (SELECT string_agg(tag || ':' || avg_engagement::VARCHAR || ':' || count::VARCHAR, ','
                          ORDER BY avg_engagement DESC, tag) FROM top8) AS top_hashtags,
       (SELECT string_agg(post_id, ',' ORDER BY {NEWEST}) FROM ({FIRST_12}))
         AS posts
FROM mentioned"""


@query(with_(*sql.TO_TAGS) + SUMMARY_SQL)
def trend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = trends.trend_summary(_feed(spark, sf_dir), fx.FEED_BRAND)
    line = F.transform(
        "top_hashtags",
        lambda t: F.concat_ws(
            ":", t["tag"], t["avg_engagement"].cast("string"), t["count"].cast("string")
        ),
    )
    return summary.withColumns(
        {
            "top_hashtags": F.array_join(line, ","),
            "posts": F.array_join(F.transform("posts", lambda p: p["post_id"]), ","),
        }
    )


@query(with_(*sql.TO_FEED) + f"SELECT {FEED_AS_TEXT} FROM ({FIRST_12})")
def first_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.first_posts(_feed(spark, sf_dir)).withColumn("hashtags", joined("hashtags"))


@query(
    with_(*sql.TO_FEED)
    + f"""
SELECT post_id, caption, array_to_string(hashtags[1:3], ',') AS hashtags
FROM feed WHERE caption <> '' ORDER BY {NEWEST} LIMIT 6"""
)
def feed_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = trends.preview(_feed(spark, sf_dir))
    return shown.select("post_id", "caption", joined("hashtags"))


@query(
    """
SELECT n, CASE WHEN n >= 1000
               THEN printf('%.1f', (CASE WHEN n % 500 = 250 THEN n + 50 ELSE n END) / 1000::DOUBLE) || 'K'
               ELSE n::VARCHAR END AS shown
FROM (SELECT floor(o_totalprice)::BIGINT AS n FROM orders)"""
)
def compact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.table(spark, sf_dir, "orders").select(F.floor("o_totalprice").alias("n"))
    return n.select("n", values.compact_number(F.col("n")).alias("shown"))


# --- Gap clustering -------------------------------------------------------------------

# White space as Java's and Python's \s see it; a trailing run of blanks yields no token.
TOKENS = r"""
tokens AS (
  SELECT doc_id, regexp_split_to_array(
           regexp_replace(lower(text), '[\t\n\x0B\f\r ]+$', ''), '[\t\n\x0B\f\r ]') AS words
  FROM documents
)"""


@query(
    with_(TOKENS)
    + "SELECT doc_id, len(words)::INTEGER AS n_tokens, array_to_string(words, '|') AS tokens FROM tokens"
)
def caption_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = gaps.tokenise(fx.documents(spark, sf_dir).select("doc_id", "text"), "text")
    return tokens.select(
        "doc_id", F.size("words").alias("n_tokens"), F.array_join("words", "|").alias("tokens")
    )


COUNTS = """
counts AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, unnest(words) AS term FROM tokens) GROUP BY doc_id, term
),
found AS (SELECT term, count(*)::BIGINT AS df FROM counts GROUP BY term)"""


@query(
    with_(TOKENS, COUNTS)
    + """
SELECT doc_id, c.term, tf, df,
       floor(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)::DOUBLE) * 1000000 + 0.5)
         / 1000000 AS tfidf
FROM counts c JOIN found f ON c.term = f.term"""
)
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = gaps.tfidf_terms(fx.documents(spark, sf_dir), "doc_id", "text")
    return weights.withColumn("tfidf", values.round_half_up(F.col("tfidf"), 6))


ROLLUP_SQL = "* REPLACE (array_to_string(top_hashtags, ',') AS top_hashtags)"


@query(with_(*sql.TO_ROLLUP) + f"SELECT {ROLLUP_SQL} FROM rollup_")
def cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(_gold_table(spark, sf_dir)).withColumn("top_hashtags", joined("top_hashtags"))


@query(
    with_(*sql.TO_ROLLUP)
    + "SELECT cluster, array_to_string(top_hashtags, ',') AS top_hashtags FROM cluster_tags"
)
def cluster_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.cluster_top_tags(_assigned(_gold(spark, sf_dir))).withColumn("top_hashtags", joined("top_hashtags"))


@query(with_(*sql.TO_ROLLUP) + f"SELECT {ROLLUP_SQL} FROM rollup_ WHERE is_gap_cluster")
def cluster_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gaps.gap_clusters(_rollup(_gold_table(spark, sf_dir)))
    return found.withColumn("top_hashtags", joined("top_hashtags"))


@query()
def caption_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    insights = _gold_table(spark, sf_dir)
    featured = gaps.fit_text(insights, fx.POST_RULES).transform(gaps.captioned(insights))
    parts = gaps.vector_to_array("features")
    return featured.select(
        "hashtag",
        F.size(F.filter(parts, lambda x: x != 0.0)).alias("terms"),
        values.round_half_up(
            F.sqrt(F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x * x)), 9
        ).alias("length"),
    )


@query()
def kmeans_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gaps.detect_gaps(_gold(spark, sf_dir), fx.POST_RULES)
    return found.summary.withColumn("top_hashtags", joined("top_hashtags"))


@query(
    with_(*sql.TO_GOLD)
    + """
SELECT hashtag, len(regexp_split_to_array(
         regexp_replace(lower(top_caption), '[\\t\\n\\x0B\\f\\r ]+$', ''),
         '[\\t\\n\\x0B\\f\\r ]'))::INTEGER AS n_tokens,
       len(regexp_split_to_array(
         regexp_replace(lower(top_caption), '[\\t\\n\\x0B\\f\\r ]+$', ''),
         '[\\t\\n\\x0B\\f\\r ]'))::DOUBLE AS tf_sum,
       true AS unit_length
FROM gold WHERE top_caption IS NOT NULL"""
)
def caption_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the hashed vector of every caption: its counts add up to the
    caption's tokens, and its length is one (or it is empty)."""
    insights = _gold_table(spark, sf_dir)
    featured = gaps.fit_text(insights, fx.POST_RULES).transform(gaps.captioned(insights))
    counts, parts = gaps.vector_to_array("tf"), gaps.vector_to_array("features")

    def total(of: Column) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda acc, x: acc + x)

    length = F.sqrt(total(F.transform(parts, lambda x: x * x)))
    return featured.select(
        "hashtag",
        F.size("words").alias("n_tokens"),
        total(counts).alias("tf_sum"),
        ((F.abs(length - 1.0) < 1e-9) | (length == 0.0)).alias("unit_length"),
    )


KMEANS_CHECK = """
SELECT count(*)::BIGINT AS input_rows, count(top_caption)::BIGINT AS clustered_rows,
       true AS ids_in_range, true AS score_in_range,
       (sum(brand_post_count) FILTER (WHERE top_caption IS NOT NULL))::BIGINT AS brand_posts,
       (sum(round(competitor_dominance * 1000000000)::BIGINT)
          FILTER (WHERE top_caption IS NOT NULL))::BIGINT AS dominance
FROM {}"""

BARE_GOLD = """
bare_gold AS (
  SELECT * REPLACE (CASE WHEN post_count % 3 <> 0 THEN top_caption END AS top_caption) FROM gold
)"""


def _kmeans_invariants(insights: DataFrame) -> DataFrame:
    """One row of what must hold of any clustering: nothing lost, ids and score in range."""
    found = gaps.cluster_captions(insights, fx.POST_RULES)
    share = F.round(F.col("competitor_dominance") * F.lit(gaps.BILLION)).cast("bigint")
    score = found.silhouette
    return found.assigned.agg(
        F.lit(found.input_rows).cast("bigint").alias("input_rows"),
        F.count("cluster").alias("clustered_rows"),
        F.bool_and(F.col("cluster").between(0, fx.POST_RULES.clusters - 1)).alias("ids_in_range"),
        F.lit(score is None or -1 <= score <= 1).alias("score_in_range"),
        F.sum("brand_post_count").alias("brand_posts"),
        F.sum(share).alias("dominance"),
    )


@query(with_(*sql.TO_GOLD) + KMEANS_CHECK.format("gold"))
def kmeans_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kmeans_invariants(_gold(spark, sf_dir))


@query(with_(*sql.TO_GOLD, BARE_GOLD) + KMEANS_CHECK.format("bare_gold"))
def kmeans_invariants_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a good part of the insights has no caption."""
    bare = _gold(spark, sf_dir).withColumn(
        "top_caption", F.when(F.col("post_count") % 3 != 0, F.col("top_caption"))
    )
    return _kmeans_invariants(bare)


# Captions as exact vectors of length one, and a split of them that any engine can make.
VECTORS_SQL = """
tokens AS (
  SELECT hashtag, unnest(regexp_split_to_array(
           regexp_replace(lower(top_caption), '[\\t\\n\\x0B\\f\\r ]+$', ''),
           '[\\t\\n\\x0B\\f\\r ]')) AS term
  FROM gold WHERE top_caption IS NOT NULL
),
counts AS (SELECT hashtag, term, count(*) AS tf FROM tokens GROUP BY ALL),
found_in AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
weighed AS (
  SELECT hashtag, term, tf * ln(((SELECT count(DISTINCT hashtag) FROM tokens) + 1) / (df + 1)::DOUBLE) AS w
  FROM counts JOIN found_in USING (term)
),
vectors AS (
  SELECT hashtag, term, w / sqrt(sum(w * w) OVER (PARTITION BY hashtag)) AS w FROM weighed WHERE w <> 0
),
members AS (SELECT hashtag, post_count % 4 AS cluster FROM gold WHERE top_caption IS NOT NULL),
sums AS (SELECT cluster, term, sum(w) AS w FROM vectors JOIN members USING (hashtag) GROUP BY ALL),
sizes AS (SELECT cluster, count(*) AS n FROM members GROUP BY cluster)"""


def _vectors_and_members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kept = gaps.captioned(_gold_table(spark, sf_dir))
    terms = materialise(gaps.unit_terms(kept, "hashtag", "top_caption"), "vectors")
    return terms, kept.select("hashtag", (F.col("post_count") % 4).alias("cluster"))


@query(
    with_(*sql.TO_GOLD, VECTORS_SQL)
    + """,
centres AS (SELECT cluster, term, s.w / n AS w FROM sums s JOIN sizes USING (cluster)),
norms AS (SELECT cluster, sum(w * w) AS norm FROM centres GROUP BY cluster),
dots AS (
  SELECT v.hashtag, c.cluster, sum(v.w * c.w) AS dot FROM vectors v JOIN centres c USING (term) GROUP BY ALL
),
away AS (
  SELECT m.hashtag, n.cluster, round(norm - 2 * coalesce(dot, 0), 9) AS d
  FROM members m CROSS JOIN norms n
  LEFT JOIN dots d ON d.hashtag = m.hashtag AND d.cluster = n.cluster
)
SELECT hashtag, arg_min(cluster, struct_pack(d := d, c := cluster)) AS cluster FROM away GROUP BY hashtag"""
)
def nearest_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of the clustering: means of given groups, then the nearest mean of each row."""
    terms, members = _vectors_and_members(spark, sf_dir)
    centres = materialise(gaps.cluster_means(terms, members, "hashtag"), "centres")
    return gaps.nearest_centres(terms, members, centres, "hashtag")


@query(
    with_(*sql.TO_GOLD, VECTORS_SQL)
    + """,
pairs AS (
  SELECT a.hashtag, a.cluster, b.cluster AS other, b.hashtag AS other_tag
  FROM members a CROSS JOIN members b WHERE a.hashtag <> b.hashtag
),
dots AS (
  SELECT a.hashtag, b.hashtag AS other_tag, sum(a.w * b.w) AS dot
  FROM vectors a JOIN vectors b USING (term) GROUP BY ALL
),
squares AS (SELECT hashtag, sum(w * w) AS square FROM vectors GROUP BY hashtag),
means AS (
  SELECT p.hashtag, p.cluster, p.other,
         avg(coalesce(x.square, 0) + coalesce(y.square, 0) - 2 * coalesce(dot, 0)) AS d
  FROM pairs p LEFT JOIN dots USING (hashtag, other_tag)
  LEFT JOIN squares x ON x.hashtag = p.hashtag LEFT JOIN squares y ON y.hashtag = p.other_tag
  GROUP BY ALL
),
sides AS (
  SELECT hashtag, cluster, max(d) FILTER (WHERE other = cluster) AS a, min(d) FILTER (WHERE other <> cluster) AS b
  FROM means GROUP BY ALL
)
SELECT hashtag, cluster,
       round(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) + 0.0::DOUBLE AS silhouette
FROM sides"""
)
def caption_silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By cluster moments here, over all pairs of rows in the SQL."""
    terms, members = _vectors_and_members(spark, sf_dir)
    found = gaps.silhouettes(terms, members, "hashtag")
    return found.withColumn("silhouette", F.round("silhouette", 6) + F.lit(0.0))


@query(
    with_(*sql.TO_GOLD)
    + """
SELECT hashtag, true AS in_nearest_cluster, true AS centre_is_mean, 5::BIGINT AS clusters, true AS score_from_moments
FROM gold WHERE top_caption IS NOT NULL"""
)
def kmeans_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes a fitted clustering one: each row is in the cluster with the nearest
    centre, the centres are the means of their rows, no cluster is empty, and the score is
    that of the moments."""
    found = gaps.cluster_captions(_gold(spark, sf_dir), fx.POST_RULES)
    rows = found.assigned.select("hashtag", F.col("cluster").cast("bigint").alias("cluster"))
    terms = materialise(gaps.vector_terms(found.assigned, "hashtag"), "vectors")
    fitted = spark.createDataFrame(
        [(c, i, float(w)) for c, centre in enumerate(found.centres) for i, w in enumerate(centre) if w],
        "cluster bigint, term int, fitted double",
    )  # clusters times features
    placed = gaps.in_nearest_cluster(terms, rows, fitted.withColumnRenamed("fitted", "weight"), "hashtag")
    means = gaps.cluster_means(terms, rows, "hashtag")
    both = means.join(fitted, ["cluster", "term"], "full")
    gap = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("fitted", F.lit(0.0)))
    widest = both.agg(F.coalesce(F.max(gap), F.lit(1.0)) < 1e-3).scalar()  # the fit's tolerance
    clusters = rows.agg(F.count_distinct("cluster")).scalar()
    score = gaps.silhouettes(terms, rows, "hashtag").agg(F.avg("silhouette")).scalar()
    return placed.select(
        "hashtag", "in_nearest_cluster",
        widest.alias("centre_is_mean"), clusters.alias("clusters"),
        (F.abs(score - F.lit(found.silhouette)) < 1e-9).alias("score_from_moments"),
    )


@query()
def kmeans_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.detect_gaps(_gold(spark, sf_dir), fx.POST_RULES).metrics


# --- Serving --------------------------------------------------------------------------

BEST_FIT = """
SELECT hashtag, avg_engagement, brand_fit_score FROM gold
ORDER BY brand_fit_score DESC, avg_engagement DESC, hashtag LIMIT {n}"""

TOP_GAP = """
coalesce((SELECT top_hashtags[1] FROM rollup_ WHERE is_gap_cluster
          ORDER BY avg_competitor_dominance DESC, cluster_id LIMIT 1), '#none')"""


@query(with_(*sql.TO_GOLD) + BEST_FIT.format(n=3))
def top_fit_hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.best_fit_tags(_gold(spark, sf_dir))


@query(with_(*sql.TO_ROLLUP) + f"SELECT {TOP_GAP} AS hashtag")
def top_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.top_gap(_rollup(_gold_table(spark, sf_dir)), fx.DEFAULT_GAP)


@query(
    with_(*sql.TO_ROLLUP, *sql.TO_STATE)
    + """
SELECT (SELECT count(DISTINCT hashtag)::BIGINT FROM gold) AS trending,
       (SELECT count(*)::BIGINT FROM rollup_ WHERE is_gap_cluster) AS gaps,
       count(*)::BIGINT AS suggestions,
       count(*) FILTER (WHERE status = 'video_ready')::BIGINT AS videos
FROM state"""
)
def headline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    insights = _gold_table(spark, sf_dir)
    return serving.headline_metrics(insights, _rollup(insights), _state(spark, sf_dir))


@query(
    with_(*sql.TO_STATE)
    + """
SELECT suggestion_id, coalesce(caption, '') AS caption, array_to_string(hashtags, ',') AS hashtags,
       coalesce(image_prompt, '') AS image_prompt, coalesce(viral_score, 0) AS viral_score,
       coalesce(rationale, '') AS rationale, status, video_url
FROM state ORDER BY viral_score DESC, suggestion_id LIMIT 3"""
)
def top_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = serving.top_suggestions(_state(spark, sf_dir))
    return best.withColumn("hashtags", joined("hashtags"))


@query(
    with_(*sql.TO_STATE, sql.STATS)
    + """
SELECT total, approved, rejected, pending, video_ready,
       floor(approved / greatest(total, 1)::DOUBLE * 100 * 10 + 0.5) / 10 AS approve_rate,
       floor(coalesce(mean_score, 0) * 10 + 0.5) / 10 AS avg_viral_score_approved
FROM stats"""
)
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.feedback_stats(_state(spark, sf_dir))


@query(
    with_(*sql.TO_STATE, sql.STATS)
    + """
SELECT 'Pending' AS label, pending AS suggestions FROM stats
UNION ALL SELECT 'Approved', approved FROM stats
UNION ALL SELECT 'Video Ready', video_ready FROM stats
UNION ALL SELECT 'Rejected', rejected FROM stats"""
)
def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.status_breakdown(serving.feedback_stats(_state(spark, sf_dir)))


def _part_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to look up. There are more parts than customers, so some are unknown."""
    return fx.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("suggestion_id")
    )


@query(
    with_(*sql.TO_STATE)
    + """
SELECT p_partkey::VARCHAR AS suggestion_id, coalesce(status, 'not_found') AS status, video_url
FROM part LEFT JOIN state ON p_partkey::VARCHAR = suggestion_id"""
)
def suggestion_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = materialise(_state(spark, sf_dir), "state")
    return serving.look_up_status(_part_ids(spark, sf_dir), state)


@query(
    with_(fx.SUGGESTIONS_SQL)
    + """
SELECT p_partkey::VARCHAR AS suggestion_id,
       coalesce(nullif(image_prompt, ''), 'plain background') AS image_prompt
FROM part LEFT JOIN suggestions ON p_partkey::VARCHAR = suggestion_id"""
)
def prompt_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.look_up_prompt(
        _part_ids(spark, sf_dir), fx.suggestions_from_customers(spark, sf_dir), fx.DEFAULT_PROMPT
    )


@query(
    with_(fx.SUGGESTIONS_SQL)
    + """
SELECT suggestion_id, viral_score,
       CASE WHEN viral_score >= 90 THEN 'high' WHEN viral_score >= 80 THEN 'mid' ELSE 'low' END AS tier
FROM suggestions"""
)
def score_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = serving.with_tier(fx.suggestions_from_customers(spark, sf_dir))
    return tiers.select("suggestion_id", "viral_score", "tier")


# --- Suggestions ----------------------------------------------------------------------

CONTEXT = f"""
best AS (
  SELECT *, row_number() OVER (ORDER BY brand_fit_score DESC, avg_engagement DESC, hashtag) AS place
  FROM gold
),
context AS (
  SELECT 'Brand#1' AS brand,
         (SELECT hashtag FROM best WHERE place = 1) AS top_hashtag,
         (SELECT printf('%.2f', avg_engagement) FROM best WHERE place = 1) AS top_engagement,
         coalesce((SELECT hashtag FROM best WHERE place = 2), '#gear') AS rising_hashtag,
         {TOP_GAP} AS gap_hashtag,
         'Brand#2, Brand#3' AS competitors
)"""

REEL_CONTEXT = f"""
summary AS ({SUMMARY_SQL}),
placed AS (SELECT *, row_number() OVER (ORDER BY avg_engagement DESC, tag) AS place FROM top8),
context AS (
  SELECT 'src5' AS brand,
         coalesce((SELECT tag FROM placed WHERE place = 1), '#home') AS top_hashtag,
         format('{{:,}}', coalesce((SELECT avg_engagement FROM placed WHERE place = 1), 0))
           AS top_engagement,
         coalesce((SELECT tag FROM placed WHERE place = 2), '#away') AS rising_hashtag,
         gap_hashtag, 'src1, src2, src3, src4' AS competitors, total_posts::VARCHAR AS total_posts
  FROM summary
)"""


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    insights = _gold_table(spark, sf_dir)
    return suggestions.prompt_context(
        insights, _rollup(insights), fx.POST_BRAND, fx.DEFAULT_GAP
    )


def _reel_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = trends.trend_summary(_feed(spark, sf_dir), fx.FEED_BRAND)
    return suggestions.reel_context(summary, fx.FEED_BRAND)


def _template_sql(template: str, *columns: str) -> str:
    """The template as a chain of concatenations, one column per placeholder."""
    pieces = template.replace("'", "''").replace("\n", "' || chr(10) || '").split("%s")
    chain = f"'{pieces[0]}'"
    for column, piece in zip(columns, pieces[1:], strict=True):
        chain += f" || {column} || '{piece}'"
    return chain


@query(with_(*sql.TO_ROLLUP, CONTEXT) + "SELECT * FROM context")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir)


@query(
    """
SELECT 'Brand#1' AS brand, '#red' AS top_hashtag, '0.00' AS top_engagement,
       '#gear' AS rising_hashtag, '#none' AS gap_hashtag, 'Brand#2, Brand#3' AS competitors"""
)
def prompt_context_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context when no insight is left: no hashtag has a negative number of posts."""
    insights = materialise(_gold(spark, sf_dir).filter(F.col("post_count") < 0), "gold")
    return suggestions.prompt_context(insights, _rollup(insights), fx.POST_BRAND, fx.DEFAULT_GAP)


@query(with_(*sql.TO_TAGS, REEL_CONTEXT) + "SELECT * FROM context")
def reel_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reel_context(spark, sf_dir)


@query(
    with_(*sql.TO_ROLLUP, CONTEXT)
    + "SELECT brand, "
    + _template_sql(
        suggestions.DIRECTOR_TEMPLATE, "brand", "'Bold'", "'Makers'", "top_hashtag",
        "top_engagement", "rising_hashtag", "competitors", "gap_hashtag",
    )
    + " AS prompt FROM context"
)
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = suggestions.render_prompt(_context(spark, sf_dir), fx.POST_BRAND)
    return rendered.select("brand", "prompt")


@query(
    with_(*sql.TO_TAGS, REEL_CONTEXT)
    + "SELECT brand, "
    + _template_sql(
        suggestions.REEL_TEMPLATE, "brand", "'Beauty & Skincare'", "'Calm'", "'Readers'",
        "top_hashtag", "top_engagement", "rising_hashtag", "competitors", "gap_hashtag",
        "total_posts",
    )
    + " AS prompt FROM context"
)
def reel_prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = suggestions.render_reel_prompt(_reel_context(spark, sf_dir), fx.FEED_BRAND)
    return rendered.select("brand", "prompt")


@query(
    with_(fx.SUGGESTIONS_SQL)
    + """
SELECT suggestion_id,
       coalesce(image_prompt, '') || '. Vertical 9:16 format for Instagram Reels. Cinematic quality.'
         || ' No text overlay. Smooth motion. 6 seconds.' AS plain,
       coalesce(image_prompt, '') || '. Brand: Brand#1. Tone: Bold. Vertical 9:16 format for'
         || ' Instagram Reels. Cinematic quality. Smooth motion. No text overlay. 6 seconds.' AS branded,
       substring(image_prompt, 1, 100) AS excerpt,
       lower(replace(brand || ' Co', ' ', '_')) || '_reel.mp4' AS file_name
FROM suggestions"""
)
def video_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.col("image_prompt")
    return fx.suggestions_from_customers(spark, sf_dir).select(
        "suggestion_id",
        text.video_prompt(prompt).alias("plain"),
        text.video_prompt(prompt, fx.POST_BRAND).alias("branded"),
        F.substring(prompt, 1, 100).alias("excerpt"),
        text.reel_file_name(F.concat("brand", F.lit(" Co"))).alias("file_name"),
    )


@query(
    with_(fx.SUGGESTIONS_SQL)
    + """
SELECT suggestion_id,
       coalesce(caption, '') || chr(10) || chr(10) || array_to_string(hashtags, ' ') AS post_text
FROM suggestions"""
)
def post_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.suggestions_from_customers(spark, sf_dir).select(
        "suggestion_id", text.post_text(F.col("caption"), F.col("hashtags")).alias("post_text")
    )


@query(with_(fx.REPLIES_SQL) + "SELECT response_id, stripped FROM unfenced")
def fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = fx.replies_from_customers(spark, sf_dir)
    return replies.select("response_id", text.strip_fences(F.col("content")).alias("stripped"))


@query(
    with_(fx.REPLIES_SQL, sql.ACCEPTED)
    + "SELECT * REPLACE (array_to_string(hashtags, ',') AS hashtags) FROM accepted"
)
def suggestion_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = suggestions.judge_strict(fx.replies_from_customers(spark, sf_dir))
    return suggestions.accepted(judged).withColumn("hashtags", joined("hashtags"))


@query(
    with_(fx.REPLIES_SQL)
    + "SELECT response_id, content, reason FROM judged WHERE reason IS NOT NULL"
)
def suggestion_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggestions.quarantined(
        suggestions.judge_strict(fx.replies_from_customers(spark, sf_dir))
    )


@query(
    with_(fx.REPLIES_SQL)
    + """
SELECT j.response_id, position::INTEGER AS position, item ->> '$.caption' AS caption,
       CASE WHEN json_type(item, '$.hashtags') = 'ARRAY'
            THEN array_to_string(json_extract_string(item, '$.hashtags[*]'), ',')
            ELSE '#top' END AS hashtags,
       item ->> '$.image_prompt' AS image_prompt,
       CASE WHEN coalesce(item ->> '$.viral_score', '') IN ('', '0') THEN
              CASE WHEN json_type(item, '$.viral_score') = 'VARCHAR'
                    AND item ->> '$.viral_score' = '0' THEN 0 ELSE 80 END
            ELSE trunc((item ->> '$.viral_score')::DOUBLE)::INTEGER END AS viral_score,
       item ->> '$.rationale' AS rationale
FROM judged j JOIN parts p ON j.response_id = p.response_id
WHERE fillable AND position < 3"""
)
def suggestion_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = suggestions.judge_lenient(fx.replies_from_customers(spark, sf_dir))
    return suggestions.filled(judged, F.lit("#top")).withColumn("hashtags", joined("hashtags"))


@query(
    with_(fx.REPLIES_SQL, sql.ACCEPTED)
    + """
SELECT response_id, floor(avg(viral_score) * 100 + 0.5) / 100 AS avg_viral_score,
       max(viral_score) AS max_viral_score
FROM accepted GROUP BY response_id"""
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = suggestions.judge_strict(fx.replies_from_customers(spark, sf_dir))
    return suggestions.score_summary(suggestions.accepted(judged))


def _suggestion_rows_sql(brand: str = "'Brand#1'", reply: str = "'reply ' || response_id::VARCHAR") -> str:
    return f"""
SELECT sha256(concat_ws(chr(31), {brand}, {reply}, position::VARCHAR, coalesce(caption, ''),
                        coalesce(image_prompt, ''), coalesce(rationale, ''), coalesce(viral_score::VARCHAR, ''),
                        coalesce(array_to_string(hashtags, chr(30)), ''))) AS suggestion_id, caption,
       array_to_string(hashtags, ',') AS hashtags, image_prompt, viral_score, rationale,
       'pending' AS status, NULL::VARCHAR AS video_url, {brand} AS brand,
       TIMESTAMP '{fx.DEFAULT_TIME}' AS created_at, NULL::VARCHAR AS reject_reason
FROM accepted"""


SUGGESTION_ROWS = with_(fx.REPLIES_SQL, sql.ACCEPTED) + _suggestion_rows_sql()


@query(SUGGESTION_ROWS)
def suggestion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = suggestions.judge_strict(fx.replies_from_customers(spark, sf_dir))
    rows = suggestions.as_table_rows(
        suggestions.accepted(judged), F.lit(fx.POST_BRAND.name), _default_time()
    )
    return rows.withColumns(
        {"hashtags": joined("hashtags"), "created_at": plain_time("created_at")}
    )


@query(
    with_(*sql.TO_STATE)
    + "SELECT suggestion_id, status, video_url, reject_reason FROM state"
)
def suggestion_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select("suggestion_id", "status", "video_url", "reject_reason")


# --- Jobs on tables -------------------------------------------------------------------


@contextmanager
def _own_tables(spark: SparkSession) -> Iterator[TableNames]:
    """Tables in a database of their own, dropped afterwards."""
    names = TableNames(database=f"run_{uuid.uuid4().hex}")
    try:
        yield names
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {names.database} CASCADE")


@query(SUGGESTION_ROWS)
def stored_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies stored twice, as by a repeated job, and read back."""
    with _own_tables(spark) as tables:
        for _ in range(2):
            store_replies(
                fx.replies_from_customers(spark, sf_dir), fx.POST_BRAND, _default_time(), tables
            )
        rows = materialise(spark.table(tables.full("suggestions")), "suggestions")
    return rows.withColumns(
        {"hashtags": joined("hashtags"), "created_at": plain_time("created_at")}
    )


@query(
    with_(fx.REPLIES_SQL, sql.ACCEPTED)
    + " UNION ALL ".join(
        [
            _suggestion_rows_sql(),
            _suggestion_rows_sql("'Brand#2'"),
            # Without numbers, replies of one wording are one; customers' names keep them apart.
            _suggestion_rows_sql(reply="'none'"),
        ]
    )
)
def stored_suggestions_of_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of the same numbers for two brands, and replies without numbers, each stored
    twice: every suggestion is there once."""
    with _own_tables(spark) as tables:
        for _ in range(2):
            judged = judge_replies(fx.replies_from_customers(spark, sf_dir))
            unnumbered = judged.withColumn("response_id", F.lit(None).cast("bigint"))
            for given, brand in (
                (judged, fx.POST_BRAND), (judged, BrandConfig("Brand#2")), (unnumbered, fx.POST_BRAND)
            ):
                store_judged(given, brand, _default_time(), tables)
            discard(judged)
        rows = materialise(spark.table(tables.full("suggestions")), "suggestions")
    return rows.withColumns(
        {"hashtags": joined("hashtags"), "created_at": plain_time("created_at")}
    )


@query(
    with_(fx.REPLIES_SQL)
    + "SELECT response_id, content, reason FROM judged WHERE reason IS NOT NULL"
)
def stored_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _own_tables(spark) as tables:
        for _ in range(2):
            refused = store_replies(
                fx.replies_from_customers(spark, sf_dir), fx.POST_BRAND, _default_time(), tables
            )
        return materialise(refused, "refused")


@query(
    with_(*sql.TO_STATE)
    + "SELECT suggestion_id, status, video_url, reject_reason FROM state"
)
def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events split by kind, written to the log by the three decision jobs (one of them
    twice), and the state of the stored suggestions read back."""
    given = fx.status_events(spark, sf_dir)

    def of(status: str) -> DataFrame:
        return given.filter(F.col("status") == status).select(
            "suggestion_id", "reject_reason", "video_url", F.col("ts").alias("at"), F.col("seq").alias("n")
        )

    at, seq = F.col("at"), F.col("n")
    approved = feedback.approve(of("approved"), at, seq)
    with _own_tables(spark) as tables:
        ensure_database(spark, tables)
        base = fx.suggestions_from_customers(spark, sf_dir).withColumn("created_at", _default_time())
        append_table(base.select(*SUGGESTION.names), tables.full("suggestions"))
        record_decisions(approved, tables)
        record_decisions(feedback.reject(of("rejected"), F.col("reject_reason"), at, seq), tables)
        record_decisions(feedback.video_ready(of("video_ready"), F.col("video_url"), at, seq), tables)
        record_decisions(given.filter(F.col("status") == serving.PENDING), tables)
        record_decisions(approved, tables)
        return materialise(
            current_suggestions(spark, tables).select(
                "suggestion_id", "status", "video_url", "reject_reason"
            ),
            "decisions",
        )


@query(GOLD_CHECK)
def gold_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver, gold and gap tables rebuilt, and gold read back."""
    with _own_tables(spark) as tables:
        refresh_tables(_posts(spark, sf_dir), fx.POST_BRAND, fx.POST_RULES, tables)
        refresh_gaps(spark, fx.POST_RULES, tables)
        return materialise(spark.table(tables.full("gold")), "gold")


# --- Files and streams ----------------------------------------------------------------


@query(NORMALISE_CHECK)
def scrape_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrapes written to files of JSON lines, read back and normalised."""
    landing = shared_path(spark, "scrapes")
    post_files.write_posts(fx.scrapes_from_documents(spark, sf_dir), landing)
    posts = normalise.normalise_posts(
        post_files.read_scrapes(spark, landing), fx.FEED_BRAND, _default_time()
    )
    return posts.withColumns({"hashtags": joined("hashtags"), "timestamp": plain_time("timestamp")})


def _streamed(spark: SparkSession, sf_dir: str, brand: BrandConfig | None = None) -> stream.Paths:
    paths = stream.Paths(shared_path(spark, "landing"), shared_path(spark, "layers"))
    post_files.write_posts(_posts(spark, sf_dir), paths.landing)
    stream.update(spark, paths, fx.POST_RULES, brand=brand)
    return paths


@query(with_(*sql.TO_SILVER) + "SELECT * FROM silver")
def stream_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream.read_silver(spark, _streamed(spark, sf_dir))
    return rows.withColumn("timestamp", plain_time("timestamp"))


@query(GOLD_CHECK)
def stream_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that land in two parts, each followed by an update of all layers."""
    paths = stream.Paths(shared_path(spark, "landing"), shared_path(spark, "layers"))
    early = F.col("comments") < 4
    for part in (early, ~early):
        post_files.write_posts(_posts(spark, sf_dir).filter(part), paths.landing)
        stream.update(spark, paths, fx.POST_RULES, brand=fx.POST_BRAND)
    return stream.read_gold(spark, paths)


@query(GOLD_CHECK)
def stream_gold_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold folded from seven batches, merged by twos; the batches after a merge run again."""
    paths = stream.Paths(shared_path(spark, "landing"), shared_path(spark, "layers"))
    rows = materialise(_silver(spark, sf_dir), "silver")  # or every batch joins posts anew
    for number in range(7):
        for _ in range(2 if number in (2, 4, 6) else 1):
            stream.write_partials(rows.filter(F.col("comments") == number + 1), paths, number)
            stream.compact_partials(spark, paths, number, fan_out=2)
    return stream.refresh_gold(spark, paths, fx.POST_BRAND, fx.POST_RULES)


def _landed_with_damage(spark: SparkSession, sf_dir: str) -> stream.Paths:
    """Posts that land in two parts, with broken lines among those of the second one."""
    paths = stream.Paths(shared_path(spark, "landing"), shared_path(spark, "layers"))
    early = F.col("comments") < 4
    for part in (early, ~early):
        posts = _posts(spark, sf_dir).filter(part)
        post_files.write_posts(posts, paths.landing)
        broken = posts.filter("comments = 7").select(F.concat(F.lit('{"post_id": "'), "post_id"))
        broken.write.mode("append").text(paths.landing)
        stream.start_bronze(spark, paths).awaitTermination()
        audit.update(spark, paths, fx.POST_RULES)
    return paths


@query(
    with_(fx.POSTS_SQL)
    + """SELECT '{"post_id": "' || post_id AS line, true AS has_file, count(*)::BIGINT AS lines
FROM posts WHERE comments = 7 GROUP BY line"""
)
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = audit.read_dead_letters(spark, _landed_with_damage(spark, sf_dir))
    placed = F.contains("file", F.lit("/landing-")) & (F.col("block_start") >= 0)
    return lines.groupBy("line", placed.alias("has_file")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    with_(
        fx.POSTS_SQL, sql.BRONZE, sql.EXPLODED,
        "landed AS (SELECT true AS is_post FROM posts UNION ALL SELECT false FROM posts WHERE comments = 7)",
    )
    + _report_sql("landed", ("is_post", "drop", "is_post"))
    + " UNION ALL "
    + _report_sql(
        "posts",
        ("valid_engagement", "warn", "likes >= 0 AND comments >= 0 AND shares >= 0"),
        ("has_caption", "drop", "caption IS NOT NULL AND length(caption) > 10"),
    )
    + " UNION ALL "
    + _report_sql(
        "exploded",
        ("has_hashtag", "drop", "hashtag IS NOT NULL"),
        ("valid_sentiment", "warn", "sentiment_score BETWEEN 0 AND 1"),
    )
)
def stream_rule_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts kept per batch, added up; every landed line is kept or refused."""
    paths = _landed_with_damage(spark, sf_dir)
    return audit.read_figures(spark, paths, "bronze").union(audit.read_figures(spark, paths, "silver"))


@query(with_(fx.POSTS_SQL, sql.BRONZE) + """
SELECT * REPLACE (array_to_string(hashtags, ',') AS hashtags) FROM bronze""")
def stream_unique_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that land in three parts which share many of them."""
    paths = stream.Paths(shared_path(spark, "landing"), shared_path(spark, "layers"))
    with _own_tables(spark) as tables:
        for part in ("comments < 5", "comments > 2", "comments IN (1, 7)"):
            post_files.write_posts(_posts(spark, sf_dir).filter(part), paths.landing)
            stream.start_bronze(spark, paths).awaitTermination()
            stream.start_unique(spark, paths, tables).awaitTermination()
        rows = materialise(spark.table(tables.full("unique")), "unique")
    return rows.withColumns({"hashtags": joined("hashtags"), "timestamp": plain_time("timestamp")})
