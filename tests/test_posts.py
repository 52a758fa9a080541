from datetime import date, datetime

import pytest
from conftest import values
from pyspark.sql import Observation, functions as F

from trendgap.config import BrandConfig, Rules
from trendgap.operators import gold, normalise, quality, silver
from trendgap.plans import medallion
from trendgap.schemas import FEED_POST, HASHTAG_POST, INSIGHT, POST, RAW_SCRAPE
from trendgap.sources import posts as files, storage

BRAND = BrandConfig("Own", competitors=("Rival",), hashtags=("#t",))


def scrapes(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in RAW_SCRAPE.names) for r in rows], RAW_SCRAPE)


def posts(spark, *rows):
    base = dict(
        post_id="p", platform="X", brand="Rival", hashtags=["#t"], caption="a caption of use",
        likes=10, comments=0, shares=0, timestamp=datetime(2024, 5, 6, 7, 8), is_competitor=True,
    )
    return spark.createDataFrame([tuple({**base, **r}[n] for n in POST.names) for r in rows], POST)


def normalised(spark, *rows):
    at = F.lit("2000-01-01 00:00:00").cast("timestamp")
    return normalise.normalise_posts(scrapes(spark, *rows), BRAND, at)


def test_normalise_posts(spark):
    frame = normalised(
        spark,
        dict(
            id="7", caption="  Rival makes #fine things " + "x" * 600, ownerUsername="me",
            likesCount="0", likes="41", commentsCount="3", timestamp="2024-01-02T03:04:05+09:00",
        ),
    )
    assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in POST]
    row = frame.first()
    assert (row.post_id, row.brand, row.hashtags, row.is_competitor) == ("7", "Rival", ["#fine"], True)
    assert (row.likes, row.comments, row.shares) == (41, 3, 2)
    assert row.caption.startswith("Rival makes") and len(row.caption) == 500
    assert row.timestamp == datetime(2024, 1, 2, 3, 4, 5)


def test_brand_and_tags_are_searched_in_the_whole_caption(spark):
    row = normalised(spark, dict(id="1", caption="y" * 5000 + " own #late")).first()
    assert (row.brand, row.hashtags, row.is_competitor) == ("Own", ["#late"], False)


def test_short_captions_go(spark):
    kept = normalised(
        spark,
        dict(id="9", caption=" 123456789 "), dict(id="10", caption=" 1234567890\t"),
        dict(id="none"), dict(id="blank", caption="   "),
    )
    assert values(kept, "post_id") == [("10",)]
    # Ten characters pass here, but not the rule of the bronze layer.
    assert medallion.bronze(kept).count() == 0


def test_post_ids(spark):
    rows = [dict(id="", shortCode="sc", caption="some caption"), dict(caption="some caption"),
            dict(caption="some caption"), dict(caption="some caption", likes="1")]
    ids = [r.post_id for r in normalised(spark, *rows).collect()]
    assert ids[0] == "sc"
    assert ids[1] == ids[2] != ids[3] and len(ids[1]) == 64


def test_normalise_feed(spark):
    frame = normalise.normalise_feed(
        scrapes(
            spark,
            dict(id="1", caption="look at #this #this", hashtags=[""], likesCount="100",
                 likes="7", previewUrl="pre", shortCode="abc"),
            dict(id="2", caption="look at that thing", ownerUsername="u", displayUrl="dis",
                 timestamp="2024", commentsCount="2"),
        )
    )
    assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in FEED_POST]
    assert values(frame) == [
        ("1", "Instagram", "unknown", "look at #this #this", ["#this", "#this"], 100, 0, 5, "",
         "pre", "https://instagram.com/p/abc"),
        ("2", "Instagram", "u", "look at that thing", [], 0, 2, 0, "2024", "dis", ""),
    ]


def test_scrape_files_accept_numbers_and_text(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"id": 5, "caption": "a long caption", "likesCount": 12, "commentsCount": "3"}\n'
        "not json at all\n"
        '{"id": "6", "caption": "another caption", "hashtags": ["x"], "likesCount": null}\n'
    )
    feed = normalise.normalise_feed(files.read_scrapes(spark, str(tmp_path)))
    got = sorted(values(feed, "post_id", "likes", "comments", "hashtags"))
    assert got == [("5", 12, 3, []), ("6", 0, 0, ["#x"])]


def test_posts_survive_their_files(spark, tmp_path):
    frame = posts(spark, dict(post_id="1", caption="emoji 🌿 caption"), dict(post_id="2", hashtags=None, likes=None))
    files.write_posts(frame, str(tmp_path / "batch"))
    files.write_posts(frame.limit(1), str(tmp_path / "batch"))
    assert sorted(values(files.read_posts(spark, str(tmp_path / "batch"))), key=str) == sorted(
        values(frame.union(frame.limit(1))), key=str
    )


RULES = (
    quality.Expectation("positive", "likes > 0"),
    quality.Expectation("tagged", "size(hashtags) > 0", drops=True),
)


def test_expectations_count_null_as_violation(spark):
    frame = posts(spark, dict(likes=None), dict(likes=0, hashtags=None), dict(likes=3, hashtags=[]))
    assert values(quality.report(frame, RULES)) == [
        ("positive", "warn", 3, 2, 3),
        ("tagged", "drop", 3, 2, 1),
    ]
    seen = Observation("rules")
    assert quality.expect(frame, RULES, seen).count() == 1
    assert seen.get == {"rows": 3, "positive": 2, "tagged": 2}


def test_bronze_needs_more_than_ten_characters(spark):
    frame = posts(spark, dict(caption="1234567890"), dict(caption="12345678901"), dict(caption=None))
    assert values(medallion.bronze(frame), "caption") == [("12345678901",)]


def test_silver(spark):
    frame = silver.silver(
        posts(spark, dict(hashtags=["#a", "#a", None], caption="pure love", likes=1234, comments=5, shares=6))
    )
    assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in HASHTAG_POST]
    row = ("p", "X", "Rival", "#a", "pure love", 1234, 5, 6, 1.245, 0.2, True, 7, date(2024, 5, 6),
           datetime(2024, 5, 6, 7, 8))
    assert values(frame) == [row, row]


@pytest.mark.parametrize(
    ("likes", "kept"), [(10, 1), (9, 0), (None, 0)]
)
def test_silver_engagement_floor(spark, likes, kept):
    assert silver.silver(posts(spark, dict(likes=likes))).count() == kept


def test_silver_without_tags_has_no_rows(spark):
    assert silver.silver(posts(spark, dict(hashtags=None), dict(hashtags=[]))).count() == 0


def test_gold_counts(spark):
    frame = posts(
        spark,
        dict(post_id="1", is_competitor=True), dict(post_id="2", is_competitor=True),
        dict(post_id="3", is_competitor=False, brand="Unknown"), dict(post_id="4", is_competitor=None),
    )
    insight = gold.gold(silver.silver(frame), BRAND)
    assert [(f.name, f.dataType) for f in insight.schema] == [(f.name, f.dataType) for f in INSIGHT]
    row = insight.first()
    # A NULL owner is in neither count but in the total; an unknown brand is not a competitor.
    assert (row.post_count, row.competitor_post_count, row.brand_post_count) == (4, 2, 1)
    assert row.competitor_dominance == 0.5 and row.opportunity_gap is False
    assert row.trend_velocity == 4 / 24.0 and row.brand_fit_score == 1.0


@pytest.mark.parametrize(
    ("rivals", "own", "gap"), [(4, 1, True), (4, 2, False), (3, 2, False), (1, 0, True)]
)
def test_opportunity_gap(spark, rivals, own, gap):
    rows = [dict(post_id=f"r{i}") for i in range(rivals)]
    rows += [dict(post_id=f"o{i}", is_competitor=False) for i in range(own)]
    assert gold.gold(silver.silver(posts(spark, *rows)), BRAND).first().opportunity_gap is gap


def test_brand_fit(spark):
    frame = posts(
        spark, dict(hashtags=["#t"]), dict(hashtags=["#engaged"], likes=501), dict(hashtags=["#weak"], likes=500)
    )
    got = dict(values(gold.gold(silver.silver(frame), BRAND), "hashtag", "brand_fit_score"))
    assert got == {"#t": 1.0, "#engaged": 0.7, "#weak": 0.3}


def test_brand_without_target_tags(spark):
    insight = gold.gold(silver.silver(posts(spark, dict())), BrandConfig("Own")).first()
    assert insight.brand_fit_score == 0.3


def test_top_caption_ties_go_to_the_smallest_id(spark):
    frame = silver.silver(
        posts(
            spark,
            dict(post_id="b", caption="second caption", likes=99),
            dict(post_id="a", caption="first caption", likes=99),
            dict(post_id="0", caption="weak caption", likes=98),
        )
    )
    assert values(gold.top_caption(frame)) == [("#t", "first caption", 0.099)]
    assert values(gold.gold(frame, BRAND), "top_caption", "engagement_rate") == [("first caption", 0.099)]


def test_gold_equals_totals_joined_to_the_ranked_window(spark):
    rows = [
        dict(post_id=str(i), hashtags=[f"#{i % 7}", f"#{i % 3}"], likes=(i * 37) % 50 + 10,
             caption=f"caption number {i} glow" if i % 2 else f"caption number {i}", is_competitor=i % 4 != 0)
        for i in range(300)
    ]
    frame = silver.silver(posts(spark, *rows)).repartition(5, "post_id")
    rules = Rules()
    joined = gold.with_signals(gold.tag_totals(frame, rules), BRAND, rules).join(
        gold.top_caption(frame), "hashtag", "left"
    )
    assert sorted(values(gold.gold(frame, BRAND, rules))) == sorted(values(joined.select(*INSIGHT.names)))


def test_gold_does_not_depend_on_partitioning(spark):
    rows = [dict(post_id=str(i), likes=10 + i % 13, caption=f"natural {i} pure") for i in range(500)]
    frame = silver.silver(posts(spark, *rows))
    results = {tuple(values(gold.gold(frame.repartition(n), BRAND))) for n in (1, 3, 11)}
    assert len(results) == 1


def test_insights_are_summed_without_a_sort_of_all_rows(spark, monkeypatch):
    """Only posts that reach the best rate of their hashtag meet an aggregate that sorts."""
    stored = []
    monkeypatch.setattr(gold, "materialise", lambda df, label: (stored.append(df), storage.materialise(df, label))[1])
    rows = silver.silver(posts(spark, dict(likes=900), dict(post_id="p2", likes=30)))
    assert values(gold.gold_in_passes(rows, BRAND)) == values(gold.gold(rows, BRAND))
    gold.top_caption(rows).collect()
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in stored]
    assert len(plans) == 2 and all("HashAggregate" in p and "SortAggregate" not in p for p in plans)


def test_best_post_among_ties_and_unknown_rates(spark):
    rows = spark.createDataFrame(
        [("#a", 0.5, "p2", "second"), ("#a", 0.5, "p1", "first"), ("#a", 0.1, "p0", "weak"), ("#b", 0.2, "p3", "known"),
         ("#b", None, "p4", "unknown"), (None, 0.3, "p5", "untagged")],
        "hashtag string, engagement_rate double, post_id string, caption string",
    )
    want = [("#a", "first", 0.5), ("#b", "unknown", 0.2), (None, "untagged", 0.3)]
    assert sorted(values(gold.top_caption(rows)), key=str) == sorted(want, key=str)


def test_landed_files_are_compressed_and_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LINES_PER_FILE", 2)
    rows = posts(spark, *[dict(post_id=f"p{i}", caption=None if i % 2 else "a caption of use") for i in range(5)]).coalesce(1)
    files.write_posts(rows, path := str(tmp_path / "landing"))
    assert len(list((tmp_path / "landing").glob("*.json.gz"))) == 3
    assert sorted(values(files.read_posts(spark, path)), key=str) == sorted(values(rows), key=str)


def test_posts_that_lead_no_hashtag_are_dropped_before_their_join(spark):
    """Of order lines joined with parts, only those that may be the best reach the join."""
    rows = [
        dict(post_id="a", hashtags=["#x"], likes=900), dict(post_id="b", hashtags=["#x"], likes=30),
        dict(post_id="c", hashtags=["#y"], likes=400), dict(post_id="d", hashtags=["#y"], likes=40),
    ]
    given = posts(spark, *rows)
    captions = given.select("post_id", "caption").hint("merge")
    joined = silver.silver(given.drop("caption").join(captions, "post_id").select(*POST.names))
    sums = gold.tag_sums(joined)
    found = gold.best_posts(joined, sums, "hashtag")
    assert sorted((r["hashtag"], r["place"]["post_id"]) for r in found.collect()) == [("#x", "a"), ("#y", "c")]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    bound = [k for k, line in enumerate(plan) if "Filter" in line and "scalar-subquery" in line]
    join = [k for k, line in enumerate(plan) if "Join Inner" in line and "post_id" in line]
    assert bound and join and min(bound) > min(join)
