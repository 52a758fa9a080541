"""The batch form of the layers, and the jobs built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trendgap.config import DEFAULT_RULES, DEFAULT_TABLES, BrandConfig, Rules, TableNames
from trendgap.operators import feedback, gaps, quality, serving, suggestions
from trendgap.operators.gold import gold_in_passes, tag_sums
from trendgap.operators.silver import silver
from trendgap.schemas import GAP_CLUSTER, INSIGHT, STATUS_EVENT, SUGGESTION
from trendgap.sources import storage


def bronze(posts: DataFrame) -> DataFrame:
    return quality.keep_valid(posts, quality.BRONZE_RULES)


def silver_from(posts: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    return silver(bronze(posts), rules)


def insights_from(
    posts: DataFrame, brand: BrandConfig, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    return gold_in_passes(silver_from(posts, rules), brand, rules)


def refresh_tables(
    posts: DataFrame,
    brand: BrandConfig,
    rules: Rules = DEFAULT_RULES,
    tables: TableNames = DEFAULT_TABLES,
) -> None:
    """Rebuild silver and gold from a batch of posts."""
    spark = posts.sparkSession
    storage.ensure_database(spark, tables)
    storage.overwrite_table(silver_from(posts, rules), tables.full("silver"))
    rows = spark.table(tables.full("silver"))
    sums = tag_sums(rows)
    storage.overwrite_table(gold_in_passes(rows, brand, rules, sums), tables.full("gold"))
    storage.discard(sums)


def refresh_gaps(
    spark: SparkSession, rules: Rules = DEFAULT_RULES, tables: TableNames = DEFAULT_TABLES
) -> gaps.GapReport:
    """Cluster the gold table and replace the table of gap clusters."""
    storage.ensure_database(spark, tables)
    insights = storage.read_table(spark, tables.full("gold"), schema=INSIGHT)
    found = gaps.detect_gaps(insights, rules)
    storage.overwrite_table(found.gaps, tables.full("gaps"))
    return found


def store_replies(
    replies: DataFrame,
    brand: BrandConfig,
    created_at: Column | None = None,
    tables: TableNames = DEFAULT_TABLES,
) -> DataFrame:
    """Append the suggestions of well-formed replies and, to a table of their own, the
    refused replies with the reason; return the table of those. Ids follow from brand,
    reply, position and content, so storing a batch again adds nothing, and another brand's
    replies of the same numbers are others."""
    judged = judge_replies(replies)
    refused = store_judged(judged, brand, created_at, tables)
    storage.discard(judged)
    return refused


def judge_replies(replies: DataFrame) -> DataFrame:
    """Replies read and judged once, to be stored for any number of brands."""
    return storage.materialise(suggestions.judge_strict(replies), "judged")


def store_judged(
    judged: DataFrame,
    brand: BrandConfig,
    created_at: Column | None = None,
    tables: TableNames = DEFAULT_TABLES,
) -> DataFrame:
    """`store_replies` from replies that are judged already."""
    spark = judged.sparkSession
    storage.ensure_database(spark, tables)
    at = F.current_timestamp() if created_at is None else created_at
    rows = suggestions.as_table_rows(suggestions.accepted(judged), F.lit(brand.name), at)
    storage.append_new(rows, tables.full("suggestions"), "suggestion_id", volatile=("created_at",))
    storage.append_new(suggestions.quarantined(judged), tables.full("refused"), "response_id", "content")
    return spark.table(tables.full("refused"))


def record_decisions(events: DataFrame, tables: TableNames = DEFAULT_TABLES) -> None:
    """Append status events (`feedback.approve`, `reject`, `video_ready`) to the log; the
    same events again add nothing."""
    storage.ensure_database(events.sparkSession, tables)
    storage.append_new(
        events.select(*STATUS_EVENT.names), tables.full("events"), "suggestion_id", "ts", "seq", "status"
    )


def current_suggestions(spark: SparkSession, tables: TableNames = DEFAULT_TABLES) -> DataFrame:
    """The suggestion table with the latest decision laid over each row."""
    return feedback.current_state(
        storage.read_table(spark, tables.full("suggestions"), schema=SUGGESTION),
        storage.read_table(spark, tables.full("events"), schema=STATUS_EVENT),
    )


def dashboard(spark: SparkSession, tables: TableNames = DEFAULT_TABLES) -> DataFrame:
    """The headline figures from the stored tables; missing tables count as empty."""
    return serving.headline_metrics(
        storage.read_table(spark, tables.full("gold"), schema=INSIGHT),
        storage.read_table(spark, tables.full("gaps"), schema=GAP_CLUSTER),
        current_suggestions(spark, tables),
    )


def director_prompt(
    spark: SparkSession, brand: BrandConfig, default_gap: str, tables: TableNames = DEFAULT_TABLES
) -> DataFrame:
    """The prompt for the next suggestions from the stored tables."""
    context = suggestions.prompt_context(
        storage.read_table(spark, tables.full("gold"), schema=INSIGHT),
        storage.read_table(spark, tables.full("gaps"), schema=GAP_CLUSTER),
        brand,
        default_gap,
    )
    return suggestions.render_prompt(context, brand)
