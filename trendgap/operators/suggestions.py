"""Prompt context, and the way from a model's reply to rows of the suggestion table.

Replies are JSON text of unknown shape, so they are parsed as VARIANT: it keeps apart a
missing key, a null, a number and a string, which a fixed struct cannot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trendgap.config import BrandConfig
from trendgap.functions.text import strip_fences
from trendgap.functions.values import round_half_up
from trendgap.operators import serving
from trendgap.operators.serving import PENDING
from trendgap.operators.trends import FALLBACK_TAG
from trendgap.schemas import SUGGESTION

# The keys a strict reply must have, and the score of an unscored idea.
REQUIRED_KEYS = ("caption", "hashtags", "image_prompt", "viral_score", "rationale")
DEFAULT_SCORE = 80
PER_REPLY = 3

DIRECTOR_TEMPLATE = (
    "Write three Instagram posts for %s as a JSON array.\n"
    "Tone: %s\nAudience: %s\n"
    "Trending now: %s (engagement score %s)\nRising: %s\n"
    "Gap: %s post about %s, we do not.\n"
    "Give each post the keys " + ", ".join(REQUIRED_KEYS) + "."
)

REEL_TEMPLATE = (
    "Plan three Instagram Reels for %s (%s) as a JSON array.\n"
    "Tone: %s\nAudience: %s\n"
    "Trending now: %s (%s engagements per post)\nRising: %s\n"
    "Gap: %s post about %s, we do not.\nPosts analysed: %s\n"
    "Give each reel the keys " + ", ".join(REQUIRED_KEYS) + "."
)


# --- Prompt ---------------------------------------------------------------------------


def _nth(rows: Column, n: int, field: str) -> Column:
    return F.get(rows, F.lit(n))[field]


def prompt_context(
    gold: DataFrame, gaps: DataFrame, brand: BrandConfig, default_gap: str
) -> DataFrame:
    """One row of facts for the post prompt, from the insight and gap tables."""
    best = serving.best_fit_tags(gold, 2)
    ranked = best.agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("brand_fit_score")).alias("fit"),
                    (-F.col("avg_engagement")).alias("engagement"),
                    "hashtag",
                )
            )
        ).alias("best")
    )
    first = brand.hashtags[0] if brand.hashtags else FALLBACK_TAG
    top = F.coalesce(_nth(F.col("best"), 0, "hashtag"), F.lit(first))
    rising = F.lit(brand.hashtags[1]) if len(brand.hashtags) > 1 else top
    engagement = F.coalesce(-_nth(F.col("best"), 0, "engagement"), F.lit(0.0))
    return ranked.select(
        F.lit(brand.name).alias("brand"),
        top.alias("top_hashtag"),
        F.format_string("%.2f", engagement).alias("top_engagement"),
        F.coalesce(_nth(F.col("best"), 1, "hashtag"), rising).alias("rising_hashtag"),
        serving.top_gap(gaps, default_gap).scalar().alias("gap_hashtag"),
        F.lit(", ".join(brand.competitors)).alias("competitors"),
    )


def reel_context(summary: DataFrame, brand: BrandConfig) -> DataFrame:
    """One row of facts for the reel prompt, from a trend summary."""
    first = brand.hashtags[0] if brand.hashtags else FALLBACK_TAG
    top = F.coalesce(_nth(F.col("top_hashtags"), 0, "tag"), F.lit(first))
    rising = F.lit(brand.hashtags[1]) if len(brand.hashtags) > 1 else top
    engagement = F.coalesce(_nth(F.col("top_hashtags"), 0, "avg_engagement"), F.lit(0))
    return summary.select(
        F.lit(brand.name).alias("brand"),
        top.alias("top_hashtag"),
        F.format_number(engagement, 0).alias("top_engagement"),
        F.coalesce(_nth(F.col("top_hashtags"), 1, "tag"), rising).alias("rising_hashtag"),
        F.coalesce("gap_hashtag", top).alias("gap_hashtag"),
        F.lit(", ".join(brand.competitors) or "Competitors").alias("competitors"),
        F.col("total_posts").cast("string").alias("total_posts"),
    )


def render_prompt(
    context: DataFrame, brand: BrandConfig, template: str = DIRECTOR_TEMPLATE
) -> DataFrame:
    return context.withColumn(
        "prompt",
        F.format_string(
            template,
            "brand",
            F.lit(brand.tone),
            F.lit(brand.audience),
            "top_hashtag",
            "top_engagement",
            "rising_hashtag",
            "competitors",
            "gap_hashtag",
        ),
    )


def render_reel_prompt(
    context: DataFrame, brand: BrandConfig, template: str = REEL_TEMPLATE
) -> DataFrame:
    return context.withColumn(
        "prompt",
        F.format_string(
            template,
            "brand",
            F.lit(brand.industry),
            F.lit(brand.tone),
            F.lit(brand.audience),
            "top_hashtag",
            "top_engagement",
            "rising_hashtag",
            "competitors",
            "gap_hashtag",
            "total_posts",
        ),
    )


# --- Parsing --------------------------------------------------------------------------


def with_value(replies: DataFrame) -> DataFrame:
    """Add `value`, the JSON value in the text as a VARIANT; NULL for any other text.

    The parser stops after the first complete value. A second element with the text's
    own digest shows whether everything before it was one value. Each step is a column
    of its own because the next uses it more than once.
    """
    body, parts = F.col("_body"), F.col("_parts")
    framed = F.concat(F.lit("["), body, F.lit(',"'), F.md5(body), F.lit('"]'))
    whole = F.try_variant_get(F.get(parts, F.lit(1)), "$", "string") == F.md5(body)
    return (
        replies.withColumn("_body", strip_fences(F.col("content")))
        .withColumn("_parts", F.try_variant_get(F.try_parse_json(framed), "$", "array<variant>"))
        .withColumn("value", F.when((F.size(parts) == 2) & whole, F.get(parts, F.lit(0))))
        .drop("_body", "_parts")
    )


def _read_items(value: Column) -> Column:
    """Everything the checks and the table need of each suggestion of an array.

    Keys are looked up once, by one cast of the whole array; an element that is no object is
    NULL then. What several results need is a field of the step before, as a lambda computes
    an expression again wherever it stands.
    """

    def read(field: Column, kind: str) -> Column:
        return F.try_variant_get(field, "$", kind)

    def parts(item: Column) -> Column:
        return F.struct(
            item.alias("raw"),
            read(item["hashtags"], "array<string>").alias("tag_list"),
            (F.schema_of_variant(item["viral_score"]) == "STRING").alias("is_text"),
            read(item["viral_score"], "string").alias("text"),
            read(item["viral_score"], "double").alias("number"),
        )

    def results(part: Column) -> Column:
        raw, as_text, number = part["raw"], part["text"], part["number"]
        is_text = F.coalesce(part["is_text"], F.lit(False))
        # A JSON null is a variant; only a missing key gives NULL here.
        present = [raw[key].isNotNull() for key in REQUIRED_KEYS]
        blank = as_text.isNull() | as_text.isin("", "{}", "[]") | (
            ~is_text & F.coalesce(number == 0.0, F.lit(False))
        )
        return F.struct(
            raw.isNotNull().alias("is_object"),
            reduce(lambda a, b: a & b, present).alias("is_complete"),
            read(raw["caption"], "string").alias("caption"),
            part["tag_list"].alias("tag_list"),
            F.when(part["tag_list"].isNull(), read(raw["hashtags"], "string")).alias("tag_text"),
            read(raw["image_prompt"], "string").alias("image_prompt"),
            F.when(is_text, as_text.try_cast("int")).otherwise(number.try_cast("int")).alias("score"),
            # The lenient reading: missing, null, zero, false or empty count as unscored.
            blank.alias("is_blank"),
            read(raw["rationale"], "string").alias("rationale"),
        )

    fields = ", ".join(f"{key}: variant" for key in REQUIRED_KEYS)
    return F.transform(F.transform(read(value, f"array<struct<{fields}>>"), parts), results)


def with_items(replies: DataFrame) -> DataFrame:
    """Add `is_json` and `items`, the suggestions read (NULL where the reply is no array).

    The result passes through an array of one. Filters on what was read stay above it;
    below, they would read every reply again for each condition.
    """
    read = with_value(replies).select(
        *replies.columns,
        F.struct(
            F.col("value").isNotNull().alias("is_json"),
            _read_items(F.col("value")).alias("items"),
        ).alias("read"),
    )
    return read.select(*replies.columns, F.inline(F.array("read")))


def judge_strict(replies: DataFrame, per_reply: int = PER_REPLY) -> DataFrame:
    """Add `reason`, why a reply is refused; NULL if it is fine."""
    items = F.col("items")
    count = F.concat(
        F.lit(f"expected {per_reply} suggestions, got "), F.size(items).cast("string")
    )
    reason = (
        F.when(~F.col("is_json"), "not JSON")
        .when(items.isNull(), "not an array")
        .when(F.size(items) != per_reply, count)
        .when(F.exists(items, lambda i: ~i["is_object"]), "suggestion is not an object")
        .when(F.exists(items, lambda i: ~i["is_complete"]), "missing keys")
        .when(F.exists(items, lambda i: i["score"].isNull()), "score is not a whole number")
    )
    return with_items(replies).withColumn("reason", reason)


def _filled_score(item: Column) -> Column:
    return F.when(item["is_blank"], F.lit(DEFAULT_SCORE)).otherwise(item["score"])


def judge_lenient(replies: DataFrame) -> DataFrame:
    """A reply passes with one object or more and every score readable or blank."""
    items = F.col("items")
    reason = (
        F.when(~F.col("is_json"), "not JSON")
        .when(items.isNull() | (F.size(items) < 1), "not a filled array")
        .when(F.exists(items, lambda i: ~i["is_object"]), "suggestion is not an object")
        .when(F.exists(items, lambda i: _filled_score(i).isNull()), "score is not a whole number")
    )
    return with_items(replies).withColumn("reason", reason)


def _each_item(judged: DataFrame, items: Column, tags: Column, score: Column) -> DataFrame:
    """One row per suggestion of the accepted replies, in the order of the reply."""
    carried = [c for c in judged.columns if c not in ("content", "is_json", "items", "reason")]
    passed = judged.filter(F.col("reason").isNull())
    each = passed.select(*carried, F.posexplode(items).alias("position", "item"))
    return each.select(
        *carried,
        "position",
        "item.caption",
        tags.alias("hashtags"),
        "item.image_prompt",
        score.alias("viral_score"),
        "item.rationale",
    )


def accepted(judged: DataFrame) -> DataFrame:
    """Suggestions of strictly judged replies; a single tag becomes a list of one."""
    tags = F.coalesce("item.tag_list", F.array("item.tag_text"))
    return _each_item(judged, F.col("items"), tags, F.col("item.score"))


def filled(judged: DataFrame, top_tag: Column, keep: int = PER_REPLY) -> DataFrame:
    """First `keep` suggestions of leniently judged replies, gaps filled with defaults."""
    tags = F.coalesce("item.tag_list", F.array(top_tag))
    return _each_item(judged, F.slice("items", 1, keep), tags, _filled_score(F.col("item")))


def quarantined(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNotNull()).drop("is_json", "items")


def score_summary(suggestions: DataFrame, key: str = "response_id") -> DataFrame:
    return suggestions.groupBy(key).agg(
        round_half_up(F.avg("viral_score"), 2).alias("avg_viral_score"),
        F.max("viral_score").alias("max_viral_score"),
    )


def suggestion_id(brand: Column, key: Column, position: Column) -> Column:
    """Digest of brand, reply, position and content: a repeated run yields the same ids,
    and replies of one number, or of none, differ by what they say and for whom."""
    texts = [F.coalesce(c, F.lit("")) for c in ("caption", "image_prompt", "rationale")]
    reply = F.when(key.isNull(), "none").otherwise(F.concat(F.lit("reply "), key.cast("string")))
    parts = (
        brand, reply, position.cast("string"), *texts, F.col("viral_score").cast("string"),
        F.array_join("hashtags", "\x1e"),
    )
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def as_table_rows(
    suggestions: DataFrame, brand: Column, created_at: Column, key: str = "response_id"
) -> DataFrame:
    """Rows ready to append, with their ids."""
    identity = suggestion_id(brand, F.col(key), F.col("position"))
    added = {
        "suggestion_id": identity,
        "status": F.lit(PENDING),
        "video_url": F.lit(None),
        "brand": brand,
        "created_at": created_at,
        "reject_reason": F.lit(None),
    }
    return suggestions.select(
        *[
            added.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in SUGGESTION
        ]
    )
