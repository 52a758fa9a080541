import json
import time

import pytest
from conftest import values
from test_posts import BRAND, posts

from trendgap.operators.gold import gold
from trendgap.plans.medallion import silver_from
from trendgap.sources import posts as files
from trendgap.streaming import medallion as stream


@pytest.fixture
def paths(tmp_path):
    (tmp_path / "landing").mkdir()
    return stream.Paths(str(tmp_path / "landing"), str(tmp_path / "layers"))


def batch(spark, start, n):
    return posts(
        spark,
        *[dict(post_id=f"{i:04}", hashtags=[f"#{i % 5}", "#all"], likes=i % 30, shares=i % 2,
               caption=None if i % 11 == 0 else f"natural caption {i}") for i in range(start, start + n)],
    )


def test_stream_equals_batch_and_reads_each_file_once(spark, paths):
    first, second = batch(spark, 0, 60), batch(spark, 60, 40)
    files.write_posts(first, paths.landing)
    stream.update(spark, paths, max_files=1, brand=BRAND)
    assert sorted(values(stream.read_silver(spark, paths))) == sorted(values(silver_from(first)))
    assert sorted(values(stream.read_gold(spark, paths))) == sorted(values(gold(silver_from(first), BRAND)))
    stream.update(spark, paths, brand=BRAND)
    assert stream.read_silver(spark, paths).count() == silver_from(first).count()
    files.write_posts(second, paths.landing)
    stream.update(spark, paths, brand=BRAND)
    both = silver_from(first.union(second))
    assert sorted(values(stream.read_silver(spark, paths))) == sorted(values(both))
    want = sorted(values(gold(both, BRAND)))
    assert sorted(values(stream.read_gold(spark, paths))) == want
    assert sorted(values(stream.refresh_gold(spark, paths, BRAND))) == want
    assert sorted(values(stream.recomputed_gold(spark, paths, BRAND))) == want


def test_a_replayed_batch_replaces_itself_and_silver_is_not_read_again(spark, paths):
    parts = [silver_from(batch(spark, 0, 50)), silver_from(batch(spark, 50, 50))]
    for number in (0, 1, 1):
        stream.write_partials(parts[number], paths, number)
    # There is no silver folder at all: a refresh needs the partials only.
    got = stream.refresh_gold(spark, paths, BRAND)
    assert sorted(values(got)) == sorted(values(gold(parts[0].union(parts[1]), BRAND)))


def test_landing_folder_is_made(spark, tmp_path):
    fresh = stream.Paths(str(tmp_path / "not" / "yet"), str(tmp_path / "layers"))
    stream.start_bronze(spark, fresh).awaitTermination()
    files.write_posts(batch(spark, 0, 5), fresh.landing)
    stream.start_bronze(spark, fresh).awaitTermination()
    assert spark.read.parquet(fresh.table("bronze")).count() > 0


def test_malformed_lines_do_not_stop_the_stream(spark, paths):
    lines = [
        json.dumps({"post_id": "ok", "caption": "a caption of use", "hashtags": ["#a"], "likes": 20,
                    "comments": 1, "shares": 1, "extra": 1}),
        json.dumps({"post_id": "bad likes", "caption": "a caption of use", "hashtags": ["#a"],
                    "likes": "many", "comments": 1, "shares": 1}),
        "{broken",
        "",
    ]
    with open(f"{paths.landing}/a.json", "w") as out:
        out.write("\n".join(lines))
    query = stream.start_bronze(spark, paths)
    query.awaitTermination()
    bronze = spark.read.parquet(paths.table("bronze"))
    assert sorted(values(bronze, "post_id", "likes")) == [("bad likes", None), ("ok", 20)]
    seen = query.lastProgress["observedMetrics"]["bronze_rules"]
    assert (seen["valid_engagement"], seen["has_caption"]) == (2, 1)
    stream.start_silver(spark, paths).awaitTermination()
    assert values(stream.read_silver(spark, paths), "post_id") == [("ok",)]


def test_periodic_trigger(spark, paths):
    query = stream.start_bronze(spark, paths, every="1 second")
    try:
        files.write_posts(batch(spark, 1, 5), paths.landing)
        for _ in range(60):
            query.processAllAvailable()
            try:
                if spark.read.parquet(paths.table("bronze")).count() == 5:
                    break
            except Exception:  # noqa: BLE001 - nothing written yet
                pass
            time.sleep(0.5)
        assert spark.read.parquet(paths.table("bronze")).count() == 5
    finally:
        query.stop()
