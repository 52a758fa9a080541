import random
from collections import defaultdict

import pytest
from conftest import values
from pyspark.sql import functions as F

from trendgap.config import BrandConfig
from trendgap.operators import trends
from trendgap.schemas import FEED_POST

BRAND = BrandConfig("Own", competitors=("Rival", "Other"), hashtags=("#mine",))


def feed(spark, rows):
    base = dict(post_id="p", platform="X", username="u", caption="c", hashtags=[], likes=0,
                comments=0, shares=0, timestamp="", thumbnail="", post_url="")
    return spark.createDataFrame(
        [tuple({**base, **r}[n] for n in FEED_POST.names) for r in rows], FEED_POST
    )


def random_rows(seed, n=200):
    rng = random.Random(seed)
    words = ["own", "OWNED", "rival", "the Other", "neutral", ""]
    return [
        dict(
            post_id=f"{i:04}", username=rng.choice(["ann", "rivalry", "own_shop"] + ["bob"] * 9),
            caption=rng.choice(words + ["neutral"] * 9),
            hashtags=[f"#{rng.randrange(20)}" for _ in range(rng.randrange(4))],
            likes=rng.randrange(50), comments=rng.randrange(50), timestamp=rng.choice(
                [f"2024-01-{rng.randrange(10, 29)}T0{rng.randrange(10)}:00:00" + rng.choice(["", "Z", "+05:30"]),
                 "yesterday", ""]
            ),
        )
        for i in range(n)
    ]


def expected_summary(rows, brand):
    """The summary by plain loops, ties broken as documented."""

    def names(post, name):
        return name.lower() in post["caption"].lower() or name.lower() in post["username"].lower()

    engagement = defaultdict(list)
    for post in rows:
        for tag in post["hashtags"]:
            engagement[tag].append(post["likes"] + post["comments"])
    means = sorted(((-(sum(v) // len(v)), t) for t, v in engagement.items()))
    own = [p for p in rows if names(p, brand.name)]
    used = {t for p in own for t in p["hashtags"]}
    gaps = [(t, -e) for e, t in means if t not in used]
    clock = lambda p: p["timestamp"][:19] if p["timestamp"][:2] == "20" else ""
    newest = sorted(sorted(rows, key=lambda p: p["post_id"]), key=clock, reverse=True)
    return dict(
        posts=[p["post_id"] for p in newest[:12]],
        top_hashtags=[(t, -e, len(engagement[t])) for e, t in means[:8]],
        competitor_count=sum(any(names(p, c) for c in brand.competitors) for p in rows),
        brand_post_count=len(own),
        gap_hashtag=gaps[0][0] if gaps else brand.hashtags[0],
        gap_engagement=gaps[0][1] if gaps else 0,
        total_posts=len(rows),
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_summary_matches_plain_loops(spark, seed):
    rows = random_rows(seed)
    got = trends.trend_summary(feed(spark, rows), BRAND).collect()
    assert len(got) == 1
    row = got[0].asDict()
    row["posts"] = [p.post_id for p in row["posts"]]
    row["top_hashtags"] = [tuple(t) for t in row["top_hashtags"]]
    assert row == expected_summary(rows, BRAND)


def test_summary_parts_agree_with_their_operators(spark):
    posts = feed(spark, random_rows(4))
    row = trends.trend_summary(posts, BRAND).first()
    stats = trends.tag_stats(posts, BRAND)
    assert [tuple(t) for t in row.top_hashtags] == values(
        trends.top_tags(stats), "tag", "avg_engagement", "count"
    )
    assert values(trends.mention_counts(posts, BRAND)) == [
        (row.competitor_count, row.brand_post_count, row.total_posts)
    ]
    gap = values(trends.top_tags(trends.gap_tags(stats), 1), "tag") or [(BRAND.hashtags[0],)]
    assert gap == [(row.gap_hashtag,)]
    assert {t for (t,) in values(trends.brand_tags(stats))}.isdisjoint(
        t for (t,) in values(trends.gap_tags(stats), "tag")
    )


def test_summary_keeps_whole_posts(spark):
    post = trends.trend_summary(feed(spark, [dict(caption="own words", likes=5)]), BRAND).first().posts[0]
    assert post.asDict().keys() == set(FEED_POST.names) and post.likes == 5


def test_summary_of_nothing(spark):
    row = trends.trend_summary(feed(spark, []), BRAND).first()
    assert (row.posts, row.top_hashtags, row.total_posts) == ([], [], 0)
    assert (row.competitor_count, row.brand_post_count) == (0, 0)
    assert (row.gap_hashtag, row.gap_engagement) == ("#mine", 0)
    bare = BrandConfig("Own")
    assert trends.trend_summary(feed(spark, []), bare).first().gap_hashtag == "#Trending"


def test_no_gap_when_the_brand_uses_every_tag(spark):
    rows = [dict(caption="own", hashtags=["#a", "#b"], likes=9), dict(hashtags=["#a"])]
    row = trends.trend_summary(feed(spark, rows), BRAND).first()
    assert (row.gap_hashtag, row.gap_engagement, len(row.top_hashtags)) == ("#mine", 0, 2)


def test_posts_without_tags_still_count(spark):
    rows = [dict(hashtags=None, caption="own"), dict(hashtags=[]), dict(hashtags=["#a"])]
    row = trends.trend_summary(feed(spark, rows), BRAND).first()
    assert (row.total_posts, row.brand_post_count) == (3, 1)
    assert [t.tag for t in row.top_hashtags] == ["#a"]


def test_mean_is_cut_to_a_whole_number(spark):
    rows = [dict(hashtags=["#a"], likes=1), dict(hashtags=["#a", "#a"], likes=2)]
    assert values(trends.tag_stats(feed(spark, rows), BRAND)) == [("#a", 1, 3, False)]


def test_share_of_max(spark):
    rows = [dict(hashtags=["#a"], likes=8), dict(hashtags=["#b"], likes=2)]
    top = trends.top_tags(trends.tag_stats(feed(spark, rows), BRAND))
    assert values(trends.share_of_max(top), "tag", "share") == [("#a", 100.0), ("#b", 25.0)]
    idle = trends.top_tags(trends.tag_stats(feed(spark, [dict(hashtags=["#a"])]), BRAND))
    assert values(trends.share_of_max(idle), "share") == [(0.0,)]


def test_texts_that_are_no_time_are_not_the_newest(spark):
    rows = [dict(post_id=i, timestamp=t) for i, t in (
        ("a", "yesterday"), ("b", ""), ("c", "2024-01-02T10:00:00Z"), ("d", "2024-01-02"),
        ("e", "2024-01-02T10:00:00.123456789+01:00"), ("f", None), ("g", "20240102T103000Z"))]
    order = [i for (i,) in values(trends.first_posts(feed(spark, rows)), "post_id")]
    assert order == ["g", "e", "c", "d", "a", "b", "f"]


def test_preview(spark):
    rows = [dict(post_id=str(i), caption="" if i == 0 else "text", timestamp=f"2024-01-0{i % 5 + 1}",
                 hashtags=["#1", "#2", "#3", "#4"]) for i in range(9)]
    shown = values(trends.preview(feed(spark, rows)), "post_id", "hashtags")
    assert [i for i, _ in shown] == ["4", "3", "8", "2", "7", "1"]
    assert all(tags == ["#1", "#2", "#3"] for _, tags in shown)


def test_one_hot_tag_reaches_the_final_task_pre_aggregated(spark):
    posts = spark.range(200_000).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in FEED_POST if f.name not in
          ("post_id", "hashtags", "likes", "comments", "caption", "username")],
        F.col("id").cast("string").alias("post_id"),
        F.array(F.when(F.col("id") % 3 == 0, "#hot").otherwise(F.concat(F.lit("#"), (F.col("id") % 997).cast("string")))).alias("hashtags"),
        F.lit(1).cast("bigint").alias("likes"), F.lit(1).cast("bigint").alias("comments"),
        F.lit("c").alias("caption"), F.lit("u").alias("username"),
    ).select(*FEED_POST.names)
    stats = trends.tag_stats(posts, BRAND)
    assert stats.filter("tag = '#hot'").first()["count"] == 66_667
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2
