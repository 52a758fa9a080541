import json
from datetime import datetime

import pytest
from conftest import values
from pyspark.sql import functions as F

from trendgap.config import BrandConfig
from trendgap.operators import feedback, serving, suggestions
from trendgap.plans import medallion
from trendgap.schemas import GAP_CLUSTER, INSIGHT, STATUS_EVENT, SUGGESTION

BRAND = BrandConfig("Own", competitors=("A", "B"), hashtags=("#x", "#y"), tone="Bold", audience="All")


def item(**changes):
    base = dict(caption="c", hashtags=["#a"], image_prompt="p", viral_score=90, rationale="r")
    base.update(changes)
    return {k: v for k, v in base.items() if v != "absent"}


def replies(spark, *contents):
    rows = [(i, c if isinstance(c, str) or c is None else json.dumps(c)) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "response_id bigint, content string")


def reason(spark, judge, content):
    return judge(replies(spark, content)).first().reason


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        ([item()] * 3, None),
        ("```json\n" + json.dumps([item()] * 3) + "\n```", None),
        ("sorry", "not JSON"),
        (None, "not JSON"),
        ("", "not JSON"),
        (json.dumps([item()] * 3) + " done", "not JSON"),
        (json.dumps([item()] * 3) + "]", "not JSON"),
        (json.dumps([item()] * 3) + ', "x"', "not JSON"),
        (json.dumps([item()] * 3)[:-1], "not JSON"),
        ({"caption": "c"}, "not an array"),
        ("12", "not an array"),
        ("null", "not an array"),
        ([item()] * 2, "expected 3 suggestions, got 2"),
        ([item()] * 4, "expected 3 suggestions, got 4"),
        ([], "expected 3 suggestions, got 0"),
        ([item(), item(), 5], "suggestion is not an object"),
        ([item(), item(), None], "suggestion is not an object"),
        ([item(), item(rationale="absent"), item()], "missing keys"),
        ([item(), item(rationale=None), item()], None),  # a null is there
        ([item(viral_score="87"), item(viral_score=87.9), item(viral_score=True)], None),
        ([item(viral_score="87.5")] * 3, "score is not a whole number"),
        ([item(viral_score="high")] * 3, "score is not a whole number"),
        ([item(viral_score=None)] * 3, "score is not a whole number"),
        ([item(viral_score=[1])] * 3, "score is not a whole number"),
    ],
)
def test_strict_judgement(spark, content, expected):
    assert reason(spark, suggestions.judge_strict, content) == expected


def test_accepted_suggestions(spark):
    content = [item(caption="1", viral_score="87"), item(caption="2", hashtags="#one", viral_score=87.9),
               item(caption="ü 🌿", hashtags=[], extra=1)]
    got = suggestions.accepted(suggestions.judge_strict(replies(spark, "bad", content)))
    assert values(got) == [
        (1, 0, "1", ["#a"], "p", 87, "r"),
        (1, 1, "2", ["#one"], "p", 87, "r"),
        (1, 2, "ü 🌿", [], "p", 90, "r"),
    ]
    refused = suggestions.quarantined(suggestions.judge_strict(replies(spark, "bad", content)))
    assert values(refused) == [(0, "bad", "not JSON")]


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        ([item()], None),
        ([item()] * 5, None),
        ([], "not a filled array"),
        ({"a": 1}, "not a filled array"),
        ("sorry", "not JSON"),
        ([3], "suggestion is not an object"),
        ([{}], None),
        ([item(viral_score="high")], "score is not a whole number"),
        # All ideas are checked, also those cut off afterwards.
        ([item()] * 3 + [item(viral_score="high")], "score is not a whole number"),
    ],
)
def test_lenient_judgement(spark, content, expected):
    assert reason(spark, suggestions.judge_lenient, content) == expected


@pytest.mark.parametrize(
    ("score", "expected"),
    [(95, 95), ("95", 95), (95.9, 95), (0, 80), (0.0, 80), (None, 80), ("absent", 80), ("", 80),
     (False, 80), ("0", 0), (True, 1), (-3, -3), ([], 80), ({}, 80)],
)
def test_lenient_score(spark, score, expected):
    judged = suggestions.judge_lenient(replies(spark, [item(viral_score=score)]))
    assert values(suggestions.filled(judged, F.lit("#top")), "viral_score") == [(expected,)]


def test_lenient_fill(spark):
    content = [item(hashtags="#one"), item(hashtags="absent"), item(caption="absent"), item(caption="cut")]
    judged = suggestions.judge_lenient(replies(spark, content))
    got = values(suggestions.filled(judged, F.lit("#top")), "position", "caption", "hashtags")
    assert got == [(0, "c", ["#top"]), (1, "c", ["#top"]), (2, None, ["#a"])]


def test_score_summary(spark):
    content = [item(viral_score=s) for s in (94, 87, 79)]
    accepted = suggestions.accepted(suggestions.judge_strict(replies(spark, content)))
    assert values(suggestions.score_summary(accepted)) == [(0, 86.67, 94)]


def test_each_key_of_a_suggestion_is_read_once(spark):
    plan = suggestions.judge_strict(replies(spark, [item()] * 3))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructField(caption,VariantType") == 1 and "$." not in plan


def test_storing_replies(spark, tables):
    content = [item()] * 3
    first = medallion.store_replies(replies(spark, content, "bad"), BRAND, tables=tables)
    assert values(first, "response_id", "reason") == [(1, "not JSON")]
    stored = spark.table(tables.full("suggestions"))
    assert [(f.name, f.dataType) for f in stored.schema] == [(f.name, f.dataType) for f in SUGGESTION]
    rows = stored.collect()
    assert {(r.status, r.brand, r.video_url, r.reject_reason) for r in rows} == {("pending", "Own", None, None)}
    assert len({r.suggestion_id for r in rows}) == 3 and all(r.created_at for r in rows)
    again = medallion.store_replies(replies(spark, content, "bad"), BRAND, tables=tables)
    assert spark.table(tables.full("suggestions")).count() == 3
    assert values(again, "response_id", "reason") == [(1, "not JSON")]


def test_replies_of_other_brands_and_without_numbers(spark, tables):
    given = replies(spark, [item(caption="one"), item(caption="two"), item(caption="three")], "bad")
    none = given.withColumn("response_id", F.lit(None).cast(given.schema["response_id"].dataType))
    for _ in range(2):
        for rows, brand in ((given, BRAND), (given, BrandConfig("Other")), (none, BRAND)):
            refused = medallion.store_replies(rows, brand, tables=tables)
    stored = spark.table(tables.full("suggestions")).collect()
    assert len(stored) == len({r.suggestion_id for r in stored}) == 9
    assert sorted({(r.brand, r.caption) for r in stored}) == [(b, c) for b in ("Other", "Own") for c in ("one", "three", "two")]
    assert sorted(map(repr, values(refused, "response_id"))) == ["(1,)", "(None,)"]
    # The same number with another text later is another suggestion.
    later = replies(spark, [item(caption="new"), item(caption="two"), item(caption="three")])
    medallion.store_replies(later, BRAND, tables=tables)
    assert spark.table(tables.full("suggestions")).count() == 10


def test_decisions_end_to_end(spark, tables):
    medallion.store_replies(replies(spark, [item()] * 3), BRAND, tables=tables)
    ids = sorted(i for (i,) in values(spark.table(tables.full("suggestions")), "suggestion_id"))
    at = F.lit(datetime(2024, 1, 1))

    def one(i):
        return spark.createDataFrame([(ids[i],)], "suggestion_id string")

    def state():
        rows = values(medallion.current_suggestions(spark, tables), "suggestion_id", "status", "video_url", "reject_reason")
        return [r[1:] for r in sorted(rows)]

    assert state() == [("pending", None, None)] * 3
    for _ in range(2):
        medallion.record_decisions(feedback.approve(one(0), at, F.lit(1)), tables)
        medallion.record_decisions(feedback.reject(one(1), F.lit("dull"), at, F.lit(2)), tables)
        medallion.record_decisions(feedback.video_ready(one(0), F.lit("http://v"), at, F.lit(3)), tables)
    assert spark.table(tables.full("events")).count() == 3
    assert state() == [("video_ready", "http://v", None), ("rejected", None, "dull"), ("pending", None, None)]
    assert values(medallion.dashboard(spark, tables)) == [(0, 0, 3, 1)]
    prompt = medallion.director_prompt(spark, BRAND, "#none", tables).first().prompt
    assert "null" not in prompt and "(engagement score 0.00)" in prompt


# --- Serving --------------------------------------------------------------------------


def table(spark, **rows):
    """Suggestions by id; a value is a (status, score) pair."""
    at = datetime(2024, 1, 1)
    data = [(i, "c", ["#a"], "p", score, "r", status, None, "Own", at, None) for i, (status, score) in rows.items()]
    return spark.createDataFrame(data, SUGGESTION)


def test_feedback_stats(spark):
    rows = table(spark, a=("approved", 90), b=("approved", 81), c=("rejected", 1), d=("pending", 2),
                 e=("video_ready", 70), f=(None, 5))
    assert values(serving.feedback_stats(rows)) == [(6, 2, 1, 1, 1, 33.3, 80.3)]
    breakdown = serving.status_breakdown(serving.feedback_stats(rows))
    assert values(breakdown) == [("Pending", 1), ("Approved", 2), ("Video Ready", 1), ("Rejected", 1)]


def test_feedback_stats_of_nothing_are_zeros(spark):
    assert values(serving.feedback_stats(table(spark))) == [(0, 0, 0, 0, 0, 0.0, 0.0)]


def test_top_suggestions_fill_missing_fields(spark):
    rows = table(spark, a=("approved", 5), b=(None, None), c=("", 9), d=("pending", 9))
    got = values(serving.top_suggestions(rows, 4), "suggestion_id", "status", "viral_score")
    assert got == [("c", "pending", 9), ("d", "pending", 9), ("a", "approved", 5), ("b", "pending", 0)]


def test_look_ups(spark):
    rows = table(spark, a=("approved", 5)).withColumn("image_prompt", F.lit(""))
    ids = spark.createDataFrame([("a",), ("zz",)], "suggestion_id string")
    assert sorted(values(serving.look_up_status(ids, rows))) == [("a", "approved", None), ("zz", "not_found", None)]
    assert sorted(values(serving.look_up_prompt(ids, rows, "plain"))) == [("a", "plain"), ("zz", "plain")]


def test_a_hot_id_is_split_over_tasks(spark, tmp_path):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    path = str(tmp_path / "suggestions")
    spark.range(5000).select(
        F.col("id").cast("string").alias("suggestion_id"), F.lit("pending").alias("status"),
        F.lit("http://v").alias("video_url"),
    ).write.parquet(path)
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        wide = F.sha2(F.col("id").cast("string"), 256)
        asked = spark.range(0, 30_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, "7").otherwise(F.col("id").cast("string")).alias("suggestion_id"),
            wide.alias("asked_by"),
        )
        found = serving.look_up_status(asked, spark.read.parquet(path))
        rows = found.collect()
        assert len(rows) == 30_000
        assert sum(r.suggestion_id == "7" and r.status == "pending" for r in rows) == 10_001
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def clusters(spark, *rows):
    return spark.createDataFrame(list(rows), GAP_CLUSTER)


def test_top_gap(spark):
    found = clusters(spark, (0, ["#a"], 0.9, 0, False), (1, ["#b", "#c"], 0.7, 0, True), (2, ["#d"], 0.8, 0, True))
    assert values(serving.top_gap(found, "#none")) == [("#d",)]
    assert values(serving.top_gap(clusters(spark, (0, [], 0.9, 0, True)), "#none")) == [("#none",)]
    assert values(serving.top_gap(clusters(spark), "#none")) == [("#none",)]


def gold(spark, *rows):
    return spark.createDataFrame(
        [(h, e, 1, 1, 0, 0.0, 0.0, 1.0, fit, True, "c", 1.0) for h, e, fit in rows], INSIGHT
    )


def test_best_fit_and_context(spark):
    tags = gold(spark, ("#b", 1.0, 0.7), ("#a", 2.345, 0.7), ("#c", 9.0, 0.3), ("#d", 2.345, 0.7))
    assert values(serving.best_fit_tags(tags), "hashtag") == [("#a",), ("#d",), ("#b",)]
    context = suggestions.prompt_context(tags, clusters(spark), BRAND, "#none")
    assert values(context) == [("Own", "#a", "2.35", "#d", "#none", "A, B")]
    single = suggestions.prompt_context(gold(spark, ("#a", 2.0, 0.7)), clusters(spark), BRAND, "#none")
    assert single.first().rising_hashtag == "#y"
    prompt = suggestions.render_prompt(context, BRAND).first().prompt
    for part in ("Own", "Bold", "All", "#a", "2.35", "#d", "A, B", "#none"):
        assert part in prompt


def summary(spark, top, gap="#g"):
    kind = "top_hashtags array<struct<tag:string,avg_engagement:bigint,count:bigint>>, gap_hashtag string, total_posts bigint"
    return spark.createDataFrame([(top, gap, 1234)], kind)


def test_reel_context(spark):
    full = suggestions.reel_context(summary(spark, [("#a", 12345, 3), ("#b", 5, 1)]), BRAND)
    assert values(full) == [("Own", "#a", "12,345", "#b", "#g", "A, B", "1234")]
    single = suggestions.reel_context(summary(spark, [("#a", 7, 1)]), BRAND)
    assert single.first().rising_hashtag == "#y"
    bare = suggestions.reel_context(summary(spark, [], None), BrandConfig("Own"))
    assert values(bare) == [("Own", "#Trending", "0", "#Trending", "#Trending", "Competitors", "1234")]
    assert "1234" in suggestions.render_reel_prompt(full, BRAND).first().prompt


def test_headline_metrics(spark):
    got = serving.headline_metrics(
        gold(spark, ("#a", 1.0, 0.3), ("#b", 1.0, 0.3)),
        clusters(spark, (0, ["#a"], 0.9, 0, True), (1, ["#b"], 0.1, 0, False)),
        table(spark, a=("video_ready", 1), b=("pending", 1), c=("pending", 1)),
    )
    assert values(got) == [(2, 1, 3, 1)]


# --- Status changes -------------------------------------------------------------------


def at(second):
    return F.lit(datetime(2024, 1, 1, 0, 0, second))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "suggestion_id string")


def test_events_have_the_log_schema(spark):
    events = feedback.reject(ids(spark, "a"), F.lit("it's off"), at(1), F.lit(1))
    assert [(f.name, f.dataType) for f in events.schema] == [(f.name, f.dataType) for f in STATUS_EVENT]
    assert values(events, "status", "reject_reason", "video_url") == [("rejected", "it's off", None)]


def test_last_event_wins_and_values_stay(spark):
    base = table(spark, a=("pending", 1), b=("pending", 2), c=("pending", 3))
    events = (
        feedback.approve(ids(spark, "a", "b", "ghost"), at(1), F.lit(1))
        .union(feedback.video_ready(ids(spark, "a"), F.lit("http://v"), at(2), F.lit(2)))
        .union(feedback.reject(ids(spark, "a"), F.lit("late"), at(3), F.lit(3)))
        .union(feedback.reject(ids(spark, "b"), F.lit("tie"), at(1), F.lit(0)))
    )
    state = feedback.current_state(base, events)
    assert state.columns == base.columns
    assert sorted(values(state, "suggestion_id", "status", "video_url", "reject_reason")) == [
        ("a", "rejected", "http://v", "late"),  # any status may follow any other
        ("b", "approved", None, "tie"),  # same time: the higher sequence number
        ("c", "pending", None, None),
    ]


def test_no_events(spark):
    base = table(spark, a=("pending", 1))
    none = spark.createDataFrame([], STATUS_EVENT)
    assert values(feedback.current_state(base, none)) == values(base)
