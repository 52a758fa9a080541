"""Inputs of the shapes this package works on, derived from the star-schema tables.

Each fixture exists twice, as a DataFrame and as a DuckDB common table expression of the
same rows. All of them cover whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trendgap.config import BrandConfig, Rules
from trendgap.schemas import RAW_SCRAPE

POST_BRAND = BrandConfig(
    name="Brand#1",
    competitors=("Brand#2", "Brand#3"),
    hashtags=("#red", "#gear", "#ECONOMY10"),
    tone="Bold",
    audience="Makers",
)
POST_RULES = Rules(
    lexicon=("red", "blue", "new", "gear", "ring", "bolt", "hot", "small", "widget", "by")
)
FEED_BRAND = BrandConfig(
    name="src5",
    competitors=("src1", "src2", "src3", "src4"),
    hashtags=("#home", "#away"),
    tone="Calm",
    audience="Readers",
)
DEFAULT_TIME = "2000-01-01 00:00:00"
DEFAULT_GAP = "#none"
DEFAULT_PROMPT = "plain background"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Brands as tables -----------------------------------------------------------------


def brand_table(spark: SparkSession, brand: BrandConfig) -> DataFrame:
    """Competitors before the own brand, in the order given."""
    rows = list(enumerate((*brand.competitors, brand.name)))
    return spark.createDataFrame(rows, "priority bigint, name string").select("name", "priority")


def part_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, and the parts of their types, as brands; shorter ones first."""
    parts = table(spark, sf_dir, "part")
    names = parts.select(F.explode(F.array_append(F.split("p_type", " "), F.col("p_name"))).alias("name"))
    return names.distinct().select("name", F.length("name").cast("bigint").alias("priority"))


PART_BRANDS_SQL = """
part_brands AS (
  SELECT DISTINCT name, length(name)::BIGINT AS priority
  FROM (SELECT unnest(list_append(string_split(p_type, ' '), p_name)) AS name FROM part)
)"""


# --- Posts from order lines -----------------------------------------------------------


def posts_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    word = [F.split_part("p_name", F.lit(" "), F.lit(n)) for n in (1, 2)]
    hash_ = F.lit("#")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws(
            "-",
            *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            F.date_format("l_shipdate", "yyyyMMdd"),
        ).alias("post_id"),
        F.when(F.col("l_linestatus") == "O", "Instagram").otherwise("X").alias("platform"),
        F.col("p_brand").alias("brand"),
        F.array(
            F.concat(hash_, word[0]),
            F.concat(hash_, word[1]),
            F.concat(hash_, "p_type", F.col("p_size").cast("string")),
        ).alias("hashtags"),
        F.when(F.col("l_linenumber") == 7, None)
        .when(F.col("l_linenumber") == 6, F.substring("p_name", 1, 10))
        .otherwise(F.concat("p_name", F.lit(" "), "p_type", F.lit(" by "), "p_brand"))
        .alias("caption"),
        F.when(F.col("l_returnflag") == "R", F.lit(0).cast("bigint"))
        .otherwise(F.lit(20) * F.col("l_quantity").cast("bigint"))
        .alias("likes"),
        F.col("l_linenumber").cast("bigint").alias("comments"),
        F.round(F.col("l_tax") * F.lit(100.0)).cast("bigint").alias("shares"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        (F.col("p_brand") != POST_BRAND.name).alias("is_competitor"),
    )


POSTS_SQL = """
posts AS (
  SELECT concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR,
                   l_suppkey::VARCHAR, strftime(l_shipdate, '%Y%m%d')) AS post_id,
         CASE WHEN l_linestatus = 'O' THEN 'Instagram' ELSE 'X' END AS platform,
         p_brand AS brand,
         ['#' || split_part(p_name, ' ', 1), '#' || split_part(p_name, ' ', 2),
          '#' || p_type || p_size::VARCHAR] AS hashtags,
         CASE WHEN l_linenumber = 7 THEN NULL
              WHEN l_linenumber = 6 THEN substring(p_name, 1, 10)
              ELSE p_name || ' ' || p_type || ' by ' || p_brand END AS caption,
         CASE WHEN l_returnflag = 'R' THEN 0 ELSE 20 * l_quantity::BIGINT END::BIGINT AS likes,
         l_linenumber::BIGINT AS comments,
         round(l_tax * 100)::BIGINT AS shares,
         l_shipdate AS timestamp,
         p_brand <> 'Brand#1' AS is_competitor
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


# --- Posts from events ----------------------------------------------------------------


def posts_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.concat(F.lit("user"), (F.col("user_id") % 6).cast("string"))
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("post_id"),
        F.lit("Instagram").alias("platform"),
        owner.alias("brand"),
        F.array(
            F.concat(F.lit("#"), "event_type"), F.concat(F.lit("#k"), (k % 20).cast("string"))
        ).alias("hashtags"),
        F.concat("event_type", F.lit(" event "), F.col("event_id").cast("string")).alias("caption"),
        F.floor("value").cast("bigint").alias("likes"),
        (F.col("user_id") % 10).cast("bigint").alias("comments"),
        F.lit(0).cast("bigint").alias("shares"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (owner != "user0").alias("is_competitor"),
    )


EVENT_POSTS_SQL = """
event_posts AS (
  SELECT event_id::VARCHAR AS post_id, 'Instagram' AS platform,
         'user' || (user_id % 6)::VARCHAR AS brand,
         ['#' || event_type,
          '#k' || (json_extract_string(props, '$.k')::BIGINT % 20)::VARCHAR] AS hashtags,
         event_type || ' event ' || event_id::VARCHAR AS caption,
         floor(value)::BIGINT AS likes, (user_id % 10)::BIGINT AS comments, 0::BIGINT AS shares,
         ts AS timestamp, 'user' || (user_id % 6)::VARCHAR <> 'user0' AS is_competitor
  FROM events
)"""


# --- Scrapes from documents -----------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _cycle(*options: Column | None) -> Column:
    """A different option on every doc_id in turn."""
    turn = (F.col("doc_id") % len(options) + 1).cast("int")
    return F.elt(turn, *[F.lit(None).cast("string") if o is None else o for o in options])


def scrapes_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    clock = F.concat(
        F.lit("2024-01-"),
        F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"),
        F.lit("T"),
        F.lpad((F.col("doc_id") % 24).cast("string"), 2, "0"),
        F.lit(":30:00"),
    )
    tags = F.concat(F.lit(" #"), "lang", F.lit(" #Café_"), "source")
    preview = F.concat(F.lit("http://img/"), doc)
    return documents(spark, sf_dir).select(
        _cycle(doc, doc, doc, F.lit(""), None).alias("id"),
        _cycle(F.concat(F.lit("p"), doc), None, F.lit("")).alias("shortCode"),
        F.when(F.col("doc_id") % 2 == 0, F.concat("text", tags)).otherwise(F.col("text")).alias("caption"),
        F.when(F.col("doc_id") % 3 == 1, F.array().cast("array<string>"))
        .when(F.col("doc_id") % 3 == 2, F.array(F.lit("##a"), F.lit("a"), F.lit("")))
        .alias("hashtags"),
        _cycle(F.col("source"), F.col("source"), F.col("source"), None, F.lit("")).alias("ownerUsername"),
        F.col("source").alias("ownerId"),
        _cycle(None, F.lit("0"), F.col("n_chars").cast("string"), F.lit("12.7")).alias("likesCount"),
        (F.col("doc_id") % 1000).cast("string").alias("likes"),
        (F.col("n_chars") % 50).cast("string").alias("commentsCount"),
        F.lit("3").alias("comments"),
        _cycle(
            F.concat(clock, F.lit("Z")),
            F.concat(clock, F.lit("+05:30")),
            clock,
            F.lit("yesterday"),
            F.substring(clock, 1, 10),
            F.concat(clock, F.lit(".250-0800")),
            F.lit(""),
        ).alias("timestamp"),
        clock.alias("takenAtTimestamp"),
        _cycle(F.lit(""), preview, None).alias("displayUrl"),
        preview.alias("previewUrl"),
    ).select(*RAW_SCRAPE.names)


SCRAPES_SQL = """
clocks AS (
  SELECT *, '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T'
            || lpad((doc_id % 24)::VARCHAR, 2, '0') || ':30:00' AS clock
  FROM documents
),
scrapes AS (
  SELECT doc_id,
         CASE doc_id % 5 WHEN 3 THEN '' WHEN 4 THEN NULL ELSE doc_id::VARCHAR END AS id,
         CASE doc_id % 3 WHEN 0 THEN 'p' || doc_id::VARCHAR WHEN 2 THEN '' END AS "shortCode",
         CASE WHEN doc_id % 2 = 0 THEN text || ' #' || lang || ' #Café_' || source
              ELSE text END AS caption,
         CASE doc_id % 3 WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN ['##a', 'a', ''] END AS hashtags,
         CASE doc_id % 5 WHEN 3 THEN NULL WHEN 4 THEN '' ELSE source END AS "ownerUsername",
         source AS "ownerId",
         CASE doc_id % 4 WHEN 1 THEN '0' WHEN 2 THEN n_chars::VARCHAR WHEN 3 THEN '12.7' END
           AS "likesCount",
         (doc_id % 1000)::VARCHAR AS likes,
         (n_chars % 50)::VARCHAR AS "commentsCount", '3' AS comments,
         CASE doc_id % 7 WHEN 0 THEN clock || 'Z' WHEN 1 THEN clock || '+05:30' WHEN 2 THEN clock
              WHEN 3 THEN 'yesterday' WHEN 4 THEN substring(clock, 1, 10)
              WHEN 5 THEN clock || '.250-0800' ELSE '' END AS timestamp,
         clock AS "takenAtTimestamp",
         CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'http://img/' || doc_id::VARCHAR END
           AS "displayUrl",
         'http://img/' || doc_id::VARCHAR AS "previewUrl"
  FROM clocks
)"""


# --- Suggestions, status events, model replies ----------------------------------------


def suggestions_from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("suggestion_id"),
        F.when(key % 11 != 0, F.concat("c_name", F.lit(" likes "), "c_mktsegment")).alias("caption"),
        F.array(
            F.concat(F.lit("#"), F.lower("c_mktsegment")),
            F.concat(F.lit("#n"), F.col("c_nationkey").cast("string")),
        ).alias("hashtags"),
        F.when(key % 10 == 0, None)
        .when(key % 10 == 1, "")
        .otherwise(F.concat(F.lit("A view of "), "c_name"))
        .alias("image_prompt"),
        (key % 101).cast("int").alias("viral_score"),
        F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("rationale"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("video_url"),
        F.col("c_mktsegment").alias("brand"),
        F.lit(None).cast("string").alias("reject_reason"),
    )


SUGGESTIONS_SQL = """
suggestions AS (
  SELECT c_custkey::VARCHAR AS suggestion_id,
         CASE WHEN c_custkey % 11 <> 0 THEN c_name || ' likes ' || c_mktsegment END AS caption,
         ['#' || lower(c_mktsegment), '#n' || c_nationkey::VARCHAR] AS hashtags,
         CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'A view of ' || c_name END
           AS image_prompt,
         (c_custkey % 101)::INTEGER AS viral_score,
         'nation ' || c_nationkey::VARCHAR AS rationale, 'pending' AS status,
         NULL::VARCHAR AS video_url, c_mktsegment AS brand, NULL::VARCHAR AS reject_reason
  FROM customer
)"""


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    event = F.col("event_id").cast("string")
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").cast("string").alias("suggestion_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_id").alias("seq"),
            F.when(kind == "click", "approved")
            .when(kind == "error", "rejected")
            .when(kind == "purchase", "video_ready")
            .when(kind == "signup", "pending")
            .alias("status"),
            F.when(
                kind == "error", F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string"))
            ).alias("reject_reason"),
            F.when(kind == "purchase", F.concat(F.lit("http://v/"), event)).alias("video_url"),
        )
        .filter(F.col("status").isNotNull())
    )


STATUS_EVENTS_SQL = """
status_events AS (
  SELECT user_id::VARCHAR AS suggestion_id, ts, event_id AS seq,
         CASE event_type WHEN 'click' THEN 'approved' WHEN 'error' THEN 'rejected'
              WHEN 'purchase' THEN 'video_ready' ELSE 'pending' END AS status,
         CASE WHEN event_type = 'error' THEN 'r' || (event_id % 5)::VARCHAR END AS reject_reason,
         CASE WHEN event_type = 'purchase' THEN 'http://v/' || event_id::VARCHAR END AS video_url
  FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup')
)"""


def replies_from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model reply per three customers, damaged in turn in one of ten ways."""
    key = F.col("c_custkey")
    kind = F.expr("(c_custkey div 3) % 10")
    name = F.col("c_name")
    score = F.when(kind == 6, F.concat(F.lit('"'), (key % 101).cast("string"), F.lit('"'))).when(
        kind == 7, F.lit("null")
    ).when(kind == 8, F.lit('"high"')).when(
        kind == 9, F.concat((key % 101).cast("string"), F.lit(".9"))
    ).otherwise((key % 101).cast("string"))
    tags = F.when(
        kind.isin(6, 7), F.concat(F.lit('"#'), F.lower("c_mktsegment"), F.lit('"'))
    ).otherwise(
        F.concat(
            F.lit('["#'), F.lower("c_mktsegment"), F.lit('", "#n'),
            F.col("c_nationkey").cast("string"), F.lit('"]'),
        )
    )
    why = F.when((kind == 4) & (key % 3 == 1), F.lit("")).otherwise(F.lit(', "rationale": "fits"'))
    item = F.concat(
        F.lit('{"caption": "'), name, F.lit('", "hashtags": '), tags,
        F.lit(', "image_prompt": "A view of '), name, F.lit('", "viral_score": '), score,
        why, F.lit("}"),
    )
    dropped = (kind == 3) & (key % 3 == 2)
    grouped = (
        table(spark, sf_dir, "customer")
        .select(F.expr("c_custkey div 3").alias("response_id"), key.alias("k"),
                F.when(~dropped, item).alias("item"))
        .groupBy("response_id")
        .agg(F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("k", "item")))).alias("items"))
    )
    body = F.concat(F.lit("["), F.array_join(F.transform("items", lambda i: i["item"]), ", "), F.lit("]"))
    damage = F.col("response_id") % 10
    return grouped.select(
        "response_id",
        F.when(damage == 1, F.concat(F.lit("```\n"), body, F.lit("\n```")))
        .when(damage == 2, F.concat(F.lit(" ```json\n"), body, F.lit("\n``` done")))
        .when(damage == 5, F.concat(body, F.lit(" Hope this helps!")))
        .otherwise(body)
        .alias("content"),
    )


REPLIES_SQL = """
items AS (
  SELECT c_custkey // 3 AS response_id, c_custkey AS k, (c_custkey // 3) % 10 AS kind,
         '{"caption": "' || c_name || '", "hashtags": '
         || CASE WHEN (c_custkey // 3) % 10 IN (6, 7) THEN '"#' || lower(c_mktsegment) || '"'
                 ELSE '["#' || lower(c_mktsegment) || '", "#n' || c_nationkey::VARCHAR || '"]' END
         || ', "image_prompt": "A view of ' || c_name || '", "viral_score": '
         || CASE (c_custkey // 3) % 10 WHEN 6 THEN '"' || (c_custkey % 101)::VARCHAR || '"'
                 WHEN 7 THEN 'null' WHEN 8 THEN '"high"'
                 WHEN 9 THEN (c_custkey % 101)::VARCHAR || '.9'
                 ELSE (c_custkey % 101)::VARCHAR END
         || CASE WHEN (c_custkey // 3) % 10 = 4 AND c_custkey % 3 = 1 THEN ''
                 ELSE ', "rationale": "fits"' END || '}' AS item
  FROM customer
),
bodies AS (
  SELECT response_id, any_value(kind) AS kind,
         '[' || string_agg(item, ', ' ORDER BY k)
                  FILTER (WHERE NOT (kind = 3 AND k % 3 = 2)) || ']' AS body
  FROM items GROUP BY response_id
),
replies AS (
  SELECT response_id,
         CASE kind WHEN 1 THEN '```' || chr(10) || body || chr(10) || '```'
                   WHEN 2 THEN ' ```json' || chr(10) || body || chr(10) || '``` done'
                   WHEN 5 THEN body || ' Hope this helps!' ELSE body END AS content
  FROM bodies
),
unfenced AS (
  SELECT response_id, content,
         CASE WHEN trim(content) LIKE '```%' THEN
           trim(regexp_replace(split_part(trim(content), '```', 2), '^json', ''), ' ' || chr(10))
         ELSE trim(content) END AS stripped
  FROM replies
),
parsed AS (
  SELECT response_id, content, stripped,
         CASE WHEN json_valid(stripped) THEN stripped::JSON END AS value
  FROM unfenced
),
parts AS (
  SELECT response_id, i AS position, json_extract(value, '$[' || i::VARCHAR || ']') AS item
  FROM parsed, LATERAL (SELECT unnest(range(json_array_length(value)::BIGINT)) AS i)
  WHERE json_type(value) = 'ARRAY'
),
checked AS (
  SELECT response_id, count(*) AS n,
         bool_and(list_has_all(json_keys(item),
           ['caption', 'hashtags', 'image_prompt', 'viral_score', 'rationale'])) AS complete,
         bool_and(CASE WHEN json_type(item, '$.viral_score') = 'VARCHAR'
                       THEN TRY_CAST(item ->> '$.viral_score' AS INTEGER)
                       ELSE TRY_CAST(trunc(TRY_CAST(item ->> '$.viral_score' AS DOUBLE)) AS INTEGER)
                  END IS NOT NULL) AS scored,
         bool_and(CASE WHEN coalesce(item ->> '$.viral_score', '') IN ('', '0') THEN true
                       WHEN json_type(item, '$.viral_score') = 'VARCHAR'
                       THEN TRY_CAST(item ->> '$.viral_score' AS INTEGER) IS NOT NULL
                       ELSE TRY_CAST(item ->> '$.viral_score' AS DOUBLE) IS NOT NULL
                  END) AS fillable
  FROM parts GROUP BY response_id
),
judged AS (
  SELECT p.response_id, p.content,
         CASE WHEN value IS NULL THEN 'not JSON'
              WHEN json_type(value) <> 'ARRAY' THEN 'not an array'
              WHEN n <> 3 THEN 'expected 3 suggestions, got ' || n::VARCHAR
              WHEN NOT complete THEN 'missing keys'
              WHEN NOT scored THEN 'score is not a whole number' END AS reason,
         fillable
  FROM parsed p LEFT JOIN checked c ON p.response_id = c.response_id
)"""
