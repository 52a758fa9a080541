"""Brands as a table: detection in texts, and insights for every brand at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trendgap.config import DEFAULT_RULES, UNKNOWN_BRAND, Rules
from trendgap.operators.gold import MICRO, tag_partials_at_once
from trendgap.sources.storage import materialise

GRAM = 3
SHORT_LIST = 64


def grams(text: Column, size: int) -> Column:
    """Every different run of `size` characters. A look-ahead moves on by one character,
    so the time grows with the length of the text and not with its square."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def all_grams(text: Column, sizes: list[int]) -> Column:
    return reduce(F.concat, (grams(text, n) for n in sizes))


def posted(brands: DataFrame, seen: DataFrame) -> DataFrame:
    """gram, key, name, priority: each brand under that of its grams which the fewest texts
    have. `seen` counts the texts per gram; a gram in no text makes the brand not occur."""
    own = brands.select(
        "key", "name", "priority", F.explode(all_grams(F.col("key"), [1, 2, GRAM])).alias("gram")
    )
    # A name shorter than a gram is its own gram.
    own = own.filter(F.length("gram") == F.least(F.length("key"), F.lit(GRAM)))
    counted = own.join(seen, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = F.min(F.struct("texts", "gram")).alias("rarest")
    return (
        counted.groupBy("key", "name", "priority")
        .agg(rarest)
        .filter("rarest.texts > 0")
        .select(F.col("rarest.gram").alias("gram"), "key", "name", "priority")
    )


def first_brands(texts: DataFrame, lower_text: Column, brands: DataFrame) -> DataFrame:
    """The rows with `brand`: of the names that occur in the lower-case text the one with the
    smallest priority, ties to the smaller name; 'Unknown' where none does.

    `brands` has `name` and `priority` and may be long: an inverted index of character
    trigrams finds the candidates, instead of one test per name and text. A brand is
    posted under its rarest trigram only, texts meet it by that trigram, and a substring
    test decides. A trigram that a third of all texts have is split by Spark, its join
    being skewed on one side only. Names without characters occur nowhere; a NULL text has
    no brand.

    A list of up to SHORT_LIST names is tested name by name as the texts are read: grams of
    every text would take longer, and nothing has to be stored or shuffled.
    """
    known = brands.filter(F.length("name") > 0).select(F.lower("name").alias("key"), "name", "priority")
    known = known.groupBy("key").agg(F.min(F.struct("priority", "name")).alias("b"))
    known = materialise(known.select("key", "b.name", "b.priority"), "brands")
    if known.count() <= SHORT_LIST:
        return _first_of_few(texts, lower_text, known)
    rows = materialise(
        texts.select(
            F.monotonically_increasing_id().alias("row"), lower_text.alias("haystack"),
            F.struct(*[F.col(f"`{c}`") for c in texts.columns]).alias("given"),
        ),
        "texts",
    )
    lengths = known.select(F.least(F.length("key"), F.lit(GRAM)).alias("n")).distinct()
    sizes = sorted(r["n"] for r in lengths.collect()) or [GRAM]  # three numbers at most

    wanted = known.select(F.explode(all_grams(F.col("key"), sizes)).alias("gram")).distinct()
    found = rows.select("row", F.explode(all_grams(F.col("haystack"), sizes)).alias("gram"))
    seen = found.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    index = materialise(posted(known, seen), "postings")
    candidates = found.join(index, "gram").select("row", "key", "name", "priority")
    tested = rows.join(candidates, "row", "left").select(
        "row", "given",
        F.when(F.contains("haystack", "key"), F.struct("priority", "name")).alias("hit"),
    )
    return tested.groupBy("row").agg(F.min("hit").alias("hit"), F.first("given").alias("given")).select(
        "given.*", F.coalesce("hit.name", F.lit(UNKNOWN_BRAND)).alias("brand")
    )


def _first_of_few(texts: DataFrame, lower_text: Column, known: DataFrame) -> DataFrame:
    in_order = known.agg(F.array_sort(F.collect_list(F.struct("priority", "name", "key")))).scalar()
    given = texts.select(F.struct(*[F.col(f"`{c}`") for c in texts.columns]).alias("given"), lower_text.alias("haystack"))
    hits = F.filter("in_order", lambda b: F.contains("haystack", b["key"]))
    found = given.withColumn("in_order", in_order).withColumn("hit", F.get(hits, F.lit(0)))
    return found.select("given.*", F.coalesce("hit.name", F.lit(UNKNOWN_BRAND)).alias("brand"))


# --- Insights for every brand ----------------------------------------------------------


def tag_owner_partials(silver: DataFrame) -> DataFrame:
    """Sums and best post per hashtag and owner: the base that every brand's view comes
    from. Posts are read once and shuffled once, whatever the number of brands."""
    return tag_partials_at_once(silver, "hashtag", "brand")


def tag_views(partials: DataFrame) -> DataFrame:
    """Per hashtag the totals, the best post, and the posts of each owner in `owners`, a map
    with one entry per owner that has any."""
    return partials.groupBy("hashtag").agg(
        *[F.sum(c).alias(c) for c in ("engagement_sum", "engagement_count", "post_count", "sentiment_sum", "sentiment_count")],
        F.min_by("top_caption", "place").alias("top_caption"),
        F.max("engagement_rate").alias("engagement_rate"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("brand").isNotNull(), F.struct("brand", "post_count")))
        ).alias("owners"),
    )


def gold_for_brands(
    silver: DataFrame, brands: DataFrame, rules: Rules = DEFAULT_RULES, only_own_tags: bool = False
) -> DataFrame:
    """The rows of `gold` for every brand of a table (name, hashtags: its target tags),
    with `brand` before them.

    For a brand, the posts of all other known owners are those of competitors; posts of
    unknown owners count with its own, and posts without an owner in neither side. So its
    counts are totals minus own, and only insights are multiplied by brands, not posts.
    `only_own_tags` leaves out tags that a brand neither posts on nor targets: their views
    are the same for all such brands.
    """
    config = F.struct(F.col("name"), F.coalesce("hashtags", F.array().cast("array<string>")).alias("targets"))
    every = brands.agg(F.array_sort(F.collect_list(config)).alias("all"))  # as long as the brand table
    views = tag_views(tag_owner_partials(silver)).withColumn("view", F.explode(every.scalar()))
    own = F.coalesce(F.element_at("owners", F.col("view.name")), F.lit(0))
    unknown = F.when(
        F.col("view.name") != UNKNOWN_BRAND, F.coalesce(F.element_at("owners", F.lit(UNKNOWN_BRAND)), F.lit(0))
    ).otherwise(F.lit(0))
    owned = F.aggregate(F.map_values("owners"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    targeted = F.array_contains("view.targets", F.col("hashtag"))
    if only_own_tags:
        views = views.filter((own > 0) | targeted)
    counted = views.select(
        F.col("view.name").alias("brand"), "hashtag",
        (F.col("engagement_sum").cast("double") / F.col("engagement_count") / F.lit(rules.engagement_scale)).alias("avg_engagement"),
        "post_count", (owned - own - unknown).alias("competitor_post_count"), (own + unknown).alias("brand_post_count"),
        (F.col("sentiment_sum").cast("double") / F.lit(MICRO) / F.col("sentiment_count")).alias("avg_sentiment"),
        targeted.alias("targeted"), "top_caption", "engagement_rate",
    )
    dominance = F.col("competitor_post_count") / F.greatest(F.col("post_count"), F.lit(1))
    fit = (
        F.when(F.col("targeted"), F.lit(rules.fit_target))
        .when(F.col("avg_engagement") > rules.engaged_above, F.lit(rules.fit_engaged))
        .otherwise(F.lit(rules.fit_other))
    )
    return counted.select(
        "brand", "hashtag", "avg_engagement", "post_count", "competitor_post_count", "brand_post_count",
        "avg_sentiment", (F.col("post_count") / F.lit(rules.velocity_hours)).alias("trend_velocity"),
        dominance.alias("competitor_dominance"), fit.alias("brand_fit_score"),
        ((dominance > rules.dominance_above) & (F.col("brand_post_count") < rules.tag_brand_posts_below)).alias("opportunity_gap"),
        "top_caption", "engagement_rate",
    )
