from conftest import values
from test_streaming import batch, paths  # noqa: F401 - a fixture

from pyspark.sql import functions as F
from trendgap.operators import quality
from trendgap.operators.silver import hashtag_posts
from trendgap.plans.medallion import bronze
from trendgap.sources import posts as files, storage
from trendgap.streaming import audit, medallion as stream, runs


def test_kept_and_refused_lines_make_up_what_landed(spark, paths, tmp_path):  # noqa: F811
    first, second = batch(spark, 0, 30), batch(spark, 30, 20)
    files.write_posts(first, paths.landing)
    bad = ["{", "no json", '{"post_id": "7", "likes": "many", "caption": "a usable caption"}', '{"likes": 3}', "[1]"]
    (tmp_path / "landing" / "bad.json").write_text("\n".join(bad) + "\n")
    stream.start_bronze(spark, paths).awaitTermination()
    audit.update(spark, paths, max_files=1)
    files.write_posts(second, paths.landing)
    stream.start_bronze(spark, paths).awaitTermination()
    audit.update(spark, paths, max_files=1)
    audit.update(spark, paths)  # nothing new
    letters = audit.read_dead_letters(spark, paths)
    assert sorted(values(letters, "line")) == [("[1]",), ("no json",), ("{",)]
    assert all(r["file"].endswith("bad.json") and r["block_start"] == 0 for r in letters.collect())
    figures = {r["rule"]: tuple(r)[1:] for r in audit.read_figures(spark, paths, "bronze").collect()}
    assert figures["is_post"] == ("drop", 55, 3, 52)
    # A field that cannot be read is NULL, and the rule on it is broken.
    assert figures["valid_engagement"] == ("warn", 52, 2, 52)
    rows = hashtag_posts(bronze(first.union(second)))
    want = sorted(values(quality.report(rows, quality.SILVER_RULES)))
    assert sorted(values(audit.read_figures(spark, paths, "silver"))) == want


def test_a_replayed_batch_counts_once(spark, paths):  # noqa: F811
    rows = quality.report(batch(spark, 0, 12), quality.BRONZE_RULES)
    for number in (0, 1, 1, 2, 2):
        audit._keep(spark, paths, "figures/bronze", rows.select(*audit.FIGURE.names), number)
    got = {r["rule"]: r["checked"] for r in audit.read_figures(spark, paths, "bronze").collect()}
    assert set(got.values()) == {36}
    assert len(runs.standing(spark, paths.table("figures/bronze"))) == 3
    assert audit.read_figures(spark, paths, "silver").isEmpty() and audit.read_dead_letters(spark, paths).isEmpty()


def test_unique_posts_across_batches(spark, paths, tables):  # noqa: F811
    one = batch(spark, 0, 40)
    changed = one.filter("post_id = '0003'").withColumn("likes", F.lit(999).cast("bigint"))
    for part in (one, batch(spark, 20, 40), changed, one):
        files.write_posts(part, paths.landing)
        stream.start_bronze(spark, paths).awaitTermination()
        stream.start_unique(spark, paths, tables, max_files=2).awaitTermination()
    got = spark.table(tables.full("unique"))
    assert sorted(values(got)) == sorted(values(bronze(batch(spark, 0, 60))))
    assert values(spark.table(tables.full("unique") + "_clashes"), "post_id", "likes") == [("0003", 999)]
    assert storage.BUCKET not in got.columns
