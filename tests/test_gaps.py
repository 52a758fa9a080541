import math
import random
from collections import Counter

import pytest
from conftest import values
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trendgap.config import Rules
from trendgap.operators import gaps
from trendgap.sources.storage import materialise
from trendgap.schemas import GAP_CLUSTER, INSIGHT


def insights(spark, rows):
    base = dict(hashtag="#t", avg_engagement=1.0, post_count=1, competitor_post_count=1, brand_post_count=0,
                avg_sentiment=0.0, trend_velocity=0.0, competitor_dominance=1.0, brand_fit_score=0.3,
                opportunity_gap=True, top_caption="text", engagement_rate=1.0)
    return spark.createDataFrame([tuple({**base, **r}[n] for n in INSIGHT.names) for r in rows], INSIGHT)


def varied(spark, n=60):
    topics = ["clean beauty serum", "red winter coat", "fast gaming laptop", "fresh pasta dinner"]
    return insights(
        spark,
        [dict(hashtag=f"#{i:03}", top_caption=f"{topics[i % 4]} word{i % 9}", post_count=i,
              competitor_dominance=(i % 10) / 10, brand_post_count=i % 2) for i in range(n)],
    )


def test_clustering_invariants(spark):
    gold = varied(spark)
    found = gaps.cluster_captions(gold)
    rows = values(found.assigned, "hashtag", "cluster")
    assert found.input_rows == len(rows) == len({h for h, _ in rows}) == 60
    assert {c for _, c in rows} <= set(range(5))
    assert -1.0 <= found.silhouette <= 1.0


def test_same_seed_same_clusters(spark):
    gold = varied(spark)
    first = sorted(values(gaps.cluster_captions(gold).assigned, "hashtag", "cluster"))
    again = sorted(values(gaps.cluster_captions(gold.repartition(7)).assigned, "hashtag", "cluster"))
    assert first == again


def test_features_have_unit_length(spark):
    gold = insights(spark, [dict(hashtag=f"#{i}", top_caption=c) for i, c in enumerate(["a b", "b c", "b", ""])])
    featured = gaps.fit_text(gold).transform(gold)
    norms = [math.sqrt(sum(x * x for x in v)) for (v,) in values(featured, vector_to_array("features"))]
    assert all(n == pytest.approx(1.0) or n == 0.0 for n in norms)


def test_fewer_captions_than_clusters(spark):
    gold = insights(spark, [dict(hashtag=f"#{i}", top_caption=["one", "two"][i % 2]) for i in range(6)])
    found = gaps.cluster_captions(gold)
    assert {c for _, c in values(found.assigned, "hashtag", "cluster")} == {0, 1}


def test_one_caption_only(spark):
    report = gaps.detect_gaps(insights(spark, [dict(hashtag="#a"), dict(hashtag="#b")]))
    assert values(report.summary) == [(0, ["#a", "#b"], 1.0, 0, True)]
    assert values(report.metrics) == [(2, None, 1)]


def test_no_captions_at_all(spark):
    report = gaps.detect_gaps(insights(spark, [dict(top_caption=None)]))
    assert report.summary.count() == report.gaps.count() == 0
    assert values(report.metrics) == [(1, None, 0)]


def test_input_rows_count_rows_without_a_caption(spark):
    rows = [dict(hashtag="#a"), dict(hashtag="#b"), dict(hashtag="#c", top_caption=None)]
    report = gaps.detect_gaps(insights(spark, rows))
    assert values(report.metrics) == [(3, None, 1)]
    assert values(report.summary, "top_hashtags") == [(["#a", "#b"],)]


def test_mean_dominance_is_the_same_however_rows_are_dealt(spark):
    gold = insights(
        spark, [dict(hashtag=f"#{i}", competitor_dominance=1 / (i % 97 + 1)) for i in range(1, 500)]
    ).withColumn("cluster", F.col("post_count") * 0)
    found = {
        values(gaps.cluster_rollup(gold.repartition(n)), "avg_competitor_dominance")[0] for n in (1, 3, 16)
    }
    assert len(found) == 1


def test_report(spark):
    report = gaps.detect_gaps(varied(spark))
    assert [(f.name, f.dataType) for f in report.summary.schema] == [(f.name, f.dataType) for f in GAP_CLUSTER]
    rows = report.summary.collect()
    assert sum(r.brand_post_count for r in rows) == 30
    for r in rows:
        assert 1 <= len(r.top_hashtags) <= 3
        assert r.is_gap_cluster == (r.avg_competitor_dominance > 0.6 and r.brand_post_count < 3)
    metrics = report.metrics.first()
    assert metrics.input_rows == 60
    assert metrics.n_gap_clusters == sum(r.is_gap_cluster for r in rows)
    assert metrics.silhouette == round(metrics.silhouette, 4)


def test_rollup(spark):
    rows = [("#b", 5, 0.5, 1), ("#a", 5, 0.7, 1), ("#c", 9, 0.66666, 0), ("#d", 1, 0.9, 0)]
    gold = insights(
        spark,
        [dict(hashtag=h, post_count=n, competitor_dominance=d, brand_post_count=b) for h, n, d, b in rows],
    ).withColumn("cluster", F.lit(3))
    # Most posts first, ties by name; the mean is rounded before it is compared.
    assert values(gaps.cluster_rollup(gold)) == [(3, ["#c", "#a", "#b"], 0.6917, 2, True)]
    strict = Rules(cluster_brand_posts_below=2)
    assert gaps.gap_clusters(gaps.cluster_rollup(gold, strict)).count() == 0


def test_top_tags_of_a_huge_cluster_are_cut_before_the_shuffle(spark):
    gold = spark.range(50_000).select(
        (F.col("id") % 2).alias("cluster"), F.col("id").alias("post_count"),
        F.concat(F.lit("#"), F.col("id").cast("string")).alias("hashtag"),
    )
    top = gaps.cluster_top_tags(gold)
    assert sorted(values(top)) == [(0, ["#49998", "#49996", "#49994"]), (1, ["#49999", "#49997", "#49995"])]
    plan = top._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_tokens(spark):
    frame = spark.createDataFrame([("A  b\tC \n",)], "t string")
    assert values(gaps.tokenise(frame, "t").select("words")) == [(["a", "", "b", "c"],)]


def test_tfidf_terms_match_plain_loops(spark):
    texts = ["the cat the dog", "the bird", "a CAT", "", "the the the"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    n, words = len(texts), [t.lower().split(" ") for t in texts]
    df = Counter(w for ws in words for w in set(ws))
    expected = {
        (i, w): (tf, df[w], pytest.approx(tf * math.log((n + 1) / (df[w] + 1))))
        for i, ws in enumerate(words)
        for w, tf in Counter(ws).items()
    }
    weights = gaps.tfidf_terms(frame.union(spark.createDataFrame([(9, None)], frame.schema)), "id", "t")
    assert {(i, w): (tf, d, x) for i, w, tf, d, x in values(weights)} == expected
    assert weights.count() == len(expected)
    assert gaps.tfidf_terms(frame.limit(0), "id", "t").isEmpty()


def test_terms_are_counted_without_a_shuffle_of_pairs(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(
        gaps, "materialise",
        lambda df, label: (plans.update({label: df._jdf.queryExecution().executedPlan().toString()}), materialise(df, label))[1],
    )
    frame = spark.createDataFrame([(1, "b a b"), (2, " "), (None, "a")], "id bigint, t string")
    found = values(gaps.tfidf_terms(frame, "id", "t").select("id", "term", "tf", "df"))
    assert sorted(found, key=str) == [(1, "a", 1, 2), (1, "b", 2, 1), (None, "a", 1, 2)]
    assert "Exchange" not in plans["term-counts"]
    # Rows of one key are one document for its counts.
    found = values(gaps.tfidf_terms(frame.union(frame.limit(1)), "id", "t").select("id", "term", "tf", "df"))
    assert sorted(found, key=str) == [(1, "a", 2, 2), (1, "b", 4, 1), (None, "a", 1, 2)]


def test_a_term_of_every_document_is_split_over_tasks(spark):
    docs = spark.range(0, 60_000, 1, 4).select(
        "id", F.concat(F.lit("hot rare"), (F.col("id") % 2003).cast("string"))
    ).toDF("id", "t")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        weights = gaps.tfidf_terms(docs, "id", "t")
        rows = {r.term: (r.n, r.df) for r in weights.groupBy("term").agg(
            F.count(F.lit(1)).alias("n"), F.max("df").alias("df")).collect()}
        weights.collect()
        plan = weights._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows["hot"] == (60_000, 60_000) and len(rows) == 2004
    assert all(n == df for n, df in rows.values())
    assert "skew=true" in plan and "Broadcast" not in plan
    # The join reads what was counted, never the texts.
    assert "UDF" not in plan and "explode" not in plan


def points(spark, *rows):
    """(key, cluster, vector) as terms and members; zeros are not terms."""
    terms = [(k, i, float(w)) for k, _, v in rows for i, w in enumerate(v) if w]
    return (
        spark.createDataFrame(terms, "key int, term int, weight double"),
        spark.createDataFrame([(k, c) for k, c, _ in rows], "key int, cluster int"),
    )


def test_silhouettes_equal_the_evaluator(spark):
    import random

    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.linalg import Vectors

    rng = random.Random(8)
    rows = [(k, rng.choice([0, 0, 0, 1, 3]), [rng.choice([0, 0, rng.random()]) for _ in range(6)]) for k in range(80)]
    rows += [(80, 7, [1.0, 0, 0, 0, 0, 0]), (81, 0, [0.0] * 6)]  # alone in its cluster; no terms
    terms, members = points(spark, *rows)
    found = gaps.silhouettes(terms, members, "key")
    assert found.count() == len(rows)
    vectors = spark.createDataFrame([(float(c), Vectors.dense(v)) for _, c, v in rows], ["prediction", "features"])
    want = ClusteringEvaluator().evaluate(vectors)
    assert abs(found.selectExpr("avg(silhouette)").first()[0] - want) < 1e-9
    assert {r["key"]: r["silhouette"] for r in found.collect()}[80] == 0


def test_nearest_centres(spark):
    terms, keys = points(spark, (1, 0, [1, 0]), (2, 0, [0, 1]), (3, 0, [0, 0]), (4, 0, [1, 1]), (5, 0, [0, 3]))
    centres = spark.createDataFrame(
        [(9, 0, 1.0), (4, 1, 1.0), (6, 1, 1.0), (7, 1, 9.0)], "cluster int, term int, weight double"
    )
    got = dict(values(gaps.nearest_centres(terms, keys, centres, "key")))
    assert got == {1: 9, 2: 4, 3: 4, 4: 4, 5: 4}  # ties to the smaller number
    nothing = spark.createDataFrame([(2, None, None)], centres.schema)
    got = dict(values(gaps.nearest_centres(terms, keys, centres.union(nothing), "key")))
    assert got[3] == 2 and got[1] == 9
    means = gaps.cluster_means(*points(spark, (1, 0, [1, 0]), (2, 0, [0, 1]), (3, 1, [4, 0])), "key")
    assert sorted(values(means)) == [(0, 0, 0.5), (0, 1, 0.5), (1, 0, 4.0)]


def test_the_fit_goes_on_until_rows_and_centres_agree(spark):
    """26 passes; after 20 of them centres are not yet the means of their rows."""
    words = random.Random(5)
    captions = [" ".join(words.choices([f"w{j}" for j in range(30)], k=5)) for _ in range(900)]
    found = gaps.cluster_captions(
        insights(spark, [dict(hashtag=f"#t{i:04d}", top_caption=c) for i, c in enumerate(captions)])
    )
    rows = values(found.assigned, vector_to_array("features"), "cluster")
    for number, centre in enumerate(found.centres):
        mine = [v for v, c in rows if c == number]
        assert all(sum(xs) / len(mine) == pytest.approx(x, abs=1e-9) for xs, x in zip(zip(*mine), centre))


def test_either_of_two_equally_near_clusters_is_nearest(spark):
    terms = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 1.0)], "k string, term int, weight double")
    centres = spark.createDataFrame(
        [(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 0.5), (2, 1, 1.0)], "cluster bigint, term int, weight double"
    )
    members = spark.createDataFrame([("a", 1), ("b", 1)], "k string, cluster bigint")
    found = gaps.in_nearest_cluster(terms, members, centres, "k")
    assert sorted(values(found)) == [("a", 1, True), ("b", 1, False)]
