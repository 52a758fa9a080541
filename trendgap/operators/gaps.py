"""Competitor-gap clustering of hashtags by the wording of their top captions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from trendgap.config import DEFAULT_RULES, Rules
from trendgap.functions.values import round_half_up
from trendgap.sources.storage import discard, materialise

ROWS_PER_TASK = 20_000
# The fit goes on until no centre moves; the number of passes only ends one that never settles.
PASSES, STANDSTILL = 1_000, 1e-9
BILLION = 1_000_000_000.0


def captioned(gold: DataFrame) -> DataFrame:
    return gold.filter(F.col("top_caption").isNotNull())


def tokenise(df: DataFrame, text: str, words: str = "words") -> DataFrame:
    """Lower-case, split at white space."""
    return Tokenizer(inputCol=text, outputCol=words).transform(df)


def text_stages(rules: Rules = DEFAULT_RULES) -> list:
    """Words -> hashed term counts -> inverse document frequency -> unit length."""
    return [
        Tokenizer(inputCol="top_caption", outputCol="words"),
        HashingTF(numFeatures=rules.text_features, inputCol="words", outputCol="tf"),
        IDF(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="features", p=2.0),
    ]


def fit_text(gold: DataFrame, rules: Rules = DEFAULT_RULES) -> PipelineModel:
    return Pipeline(stages=text_stages(rules)).fit(captioned(gold))


def term_counts(words: str) -> tuple[Column, Column, Column]:
    """Three columns that build on each other: the words in order, where each term begins among
    them, and an array of the terms with their counts, after the document itself under NULL."""
    ordered = F.sort_array(words)
    n = F.size("_ordered")
    at = F.filter(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (i == 0) | (F.get("_ordered", i) != F.get("_ordered", i - 1)),
    )
    terms = F.transform(
        "_at",
        lambda i, k: F.struct(
            F.get("_ordered", i).alias("term"),
            (F.coalesce(F.get("_at", k + 1), n) - i).cast("bigint").alias("tf"),
        ),
    )
    itself = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).cast("bigint").alias("tf")))
    return ordered, at, F.concat(itself, terms)


def tfidf_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Exact TF-IDF weight of every term in every document, without hashing.

    One pass over the texts counts the terms of each document, and the document itself
    under a term of NULL. That needs no shuffle, unless a key has several rows. Counts and
    document frequencies are stored, so both sides of their join are bare shuffles and
    adaptive execution splits the rows of a term that most documents have.
    """
    words = tokenise(docs.select(key, text).filter(F.col(text).isNotNull()), text)
    ordered, at, terms = term_counts("words")
    counted = words.select(key, ordered.alias("_ordered")).withColumn("_at", at)
    # Outer, or Spark tests the size of the list below the tokeniser and runs that again.
    each = counted.select(key, F.explode_outer(terms).alias("_each")).select(key, "_each.term", "_each.tf")
    if not docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        each = each.groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    counts = materialise(each, "term-counts")
    found_in = materialise(
        counts.filter(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("df")),
        "document-frequencies",
    )
    n_docs = counts.filter(F.col("term").isNull()).agg(F.coalesce(F.sum("tf"), F.lit(0))).scalar()
    idf = F.log((n_docs + F.lit(1)) / (F.col("df") + F.lit(1)))
    weighed = found_in.withColumn("_idf", idf)  # once per term, not per document
    return counts.join(weighed, "term").select(
        key, "term", "tf", "df", (F.col("tf") * F.col("_idf")).alias("tfidf")
    )


def usable_clusters(features: DataFrame, wanted: int) -> int:
    """KMeans cannot have more centres than there are different points."""
    points = features.select(F.xxhash64(vector_to_array("features"))).distinct()
    return points.limit(wanted).count()


def evenly_placed(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Same rows, same partitions, same order on every run and cluster: KMeans samples
    its first centres partition by partition. Many passes follow, so tasks are not small."""
    tasks = rows // ROWS_PER_TASK + 1
    return df.repartition(tasks, key).sortWithinPartitions(key)


@dataclass(frozen=True)
class Clustering:
    """Captioned rows with their cluster, the number of all rows given, the quality of the
    split (None for one cluster), the fitted centres, if there are any, and the stored
    frames that `assigned` is read from."""

    assigned: DataFrame
    input_rows: int
    silhouette: float | None
    centres: tuple = ()
    stored: tuple[DataFrame, ...] = ()


def cluster_captions(gold: DataFrame, rules: Rules = DEFAULT_RULES) -> Clustering:
    """Assign every captioned hashtag to a cluster.

    Passes over the data repeat, so the input and the feature vectors are each written
    once to shared storage; the fits read those. The fit ends at a standstill: cut off after
    a number of passes, rows would be left outside the cluster nearest to them.
    """
    given = materialise(gold, "cluster-input")
    kept, total = captioned(given), given.count()
    rows = kept.count()
    if rows == 0:
        return Clustering(kept.withColumn("cluster", F.lit(0)), total, None, stored=(given,))
    featured = fit_text(kept, rules).transform(kept).drop("words", "tf", "tfidf")
    features = materialise(featured, "features")
    k = usable_clusters(features, rules.clusters)
    if k < 2:
        return Clustering(features.withColumn("cluster", F.lit(0)), total, None, stored=(given, features))
    model = KMeans(
        k=k, seed=rules.seed, featuresCol="features", predictionCol="cluster", maxIter=PASSES, tol=STANDSTILL
    ).fit(evenly_placed(features, "hashtag", rows))
    assigned = model.transform(features)
    score = None
    if sum(size > 0 for size in model.summary.clusterSizes) > 1:
        score = ClusteringEvaluator(
            predictionCol="cluster", featuresCol="features", metricName="silhouette"
        ).evaluate(assigned)
    return Clustering(assigned, total, score, tuple(model.clusterCenters()), (given, features))


# --- Clusters checked by joins ---------------------------------------------------------


def unit_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Exact TF-IDF weights of every document, scaled to length one: key, term, weight.
    Terms that all documents have weigh nothing and are left out."""
    terms = tfidf_terms(docs, key, text).filter("tfidf <> 0").select(key, "term", "tfidf")
    terms = materialise(terms, "weights")
    lengths = terms.groupBy(key).agg(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("length"))
    return terms.join(lengths, key).select(key, "term", (F.col("tfidf") / F.col("length")).alias("weight"))


def vector_terms(features: DataFrame, key: str, vector: str = "features") -> DataFrame:
    """The parts of vectors that are not zero: key, term (their number), weight."""
    parts = features.select(key, F.posexplode(vector_to_array(vector)).alias("term", "weight"))
    return parts.filter("weight <> 0")


def cluster_sums(terms: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Sums of the members' weights: cluster, term, weight."""
    return terms.join(members, key).groupBy("cluster", "term").agg(F.sum("weight").alias("weight"))


def cluster_means(terms: DataFrame, members: DataFrame, key: str) -> DataFrame:
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sums = cluster_sums(terms, members, key)
    return sums.join(sizes, "cluster").select("cluster", "term", (F.col("weight") / F.col("n")).alias("weight"))


def _products(terms: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Per key the products with all vectors (cluster, term, weight) that share a term with
    it, as a map from cluster; no more entries than clusters."""
    dots = (
        terms.join(vectors.withColumnRenamed("weight", "other"), "term")
        .groupBy(key, "cluster")
        .agg(F.sum(F.col("weight") * F.col("other")).alias("dot"))
    )
    return dots.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "dot"))).alias("dots"))


def _distances(terms: DataFrame, keys: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """The columns of `keys`, and `away`: per cluster its number and the squared distance (to
    nine digits, less the squared length of the row, which is the same for all centres)."""
    norms = centres.groupBy("cluster").agg(F.coalesce(F.sum(F.col("weight") * F.col("weight")), F.lit(0.0)).alias("norm"))
    all_norms = norms.agg(F.array_sort(F.collect_list(F.struct("cluster", "norm")))).scalar()
    away = F.transform(
        F.col("all_norms"),
        lambda c: F.struct(
            F.round(c["norm"] - 2 * F.coalesce(F.element_at("dots", c["cluster"]), F.lit(0.0)), 9).alias("d"),
            c["cluster"].alias("cluster"),
        ),
    )
    dots = _products(terms, centres, key)
    given = keys.join(dots, key, "left").withColumn("all_norms", all_norms)
    return given.select(*keys.columns, away.alias("away"))


def nearest_centres(terms: DataFrame, keys: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """key and the cluster whose centre (cluster, term, weight) is nearest, ties to the smaller
    number: a join of sparse rows with the centres, instead of a pass over dense vectors.
    `keys` names all rows, as one without weights has no terms. Every cluster of a centre
    without weights is missing from `centres`, so give such a one a term of NULL."""
    away = _distances(terms, keys.select(key), centres, key)
    return away.select(key, F.array_min("away")["cluster"].alias("cluster"))


def in_nearest_cluster(terms: DataFrame, members: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """key, cluster, and whether no centre is nearer than that of the row's own cluster. Of
    centres that are equally near, any will do."""
    away = _distances(terms, members.select(key, "cluster"), centres, key)
    own = F.filter("away", lambda c: c["cluster"] == F.col("cluster"))
    near = F.exists(own, lambda c: c["d"] <= F.array_min("away")["d"] + F.lit(2e-9))
    return away.select(key, "cluster", near.alias("in_nearest_cluster"))


def silhouettes(terms: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """key, cluster and silhouette (squared distances) of every member.

    Mean distances to a cluster follow from its moments: number, sum of squared lengths,
    sum of its rows. So no pair of rows is looked at; all is linear in the weights.
    """
    squares = terms.groupBy(key).agg(F.sum(F.col("weight") * F.col("weight")).alias("square"))
    rows = members.select(key, "cluster").join(squares, key, "left").fillna(0.0, ["square"])
    moments = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("square").alias("squares"))
    every = moments.agg(F.array_sort(F.collect_list(F.struct("cluster", "n", "squares")))).scalar()
    dots = _products(terms, cluster_sums(terms, members, key), key)
    with_dots = rows.join(dots, key, "left").withColumn("every", every)

    def mean_to(c: Column) -> Column:
        dot = F.coalesce(F.element_at("dots", c["cluster"]), F.lit(0.0))
        return F.col("square") + (c["squares"] - 2 * dot) / c["n"]

    own = F.filter("every", lambda c: c["cluster"] == F.col("cluster"))[0]
    others = F.transform(F.filter("every", lambda c: c["cluster"] != F.col("cluster")), mean_to)
    found = with_dots.select(
        key, "cluster", own["n"].alias("n"), F.array_min(others).alias("b"),
        # The mean over the others of the own cluster leaves the row itself out.
        F.when(own["n"] > 1, mean_to(own) * own["n"] / (own["n"] - 1)).alias("a"),
    )
    widest = F.greatest("a", "b")
    score = F.when((F.col("n") == 1) | (widest == 0), 0.0).otherwise((F.col("b") - F.col("a")) / widest)
    return found.select(key, "cluster", score.alias("silhouette"))


def cluster_top_tags(assigned: DataFrame, n: int = 3) -> DataFrame:
    """The n most used hashtags per cluster, as an array.

    A cluster may hold most of all hashtags: the rank filter leaves n rows per cluster
    and task before anything is shuffled or collected.
    """
    most_used = Window.partitionBy("cluster").orderBy(F.desc("post_count"), F.asc("hashtag"))
    leaders = (
        assigned.select("cluster", "hashtag", "post_count")
        .withColumn("rank", F.row_number().over(most_used))
        .filter(F.col("rank") <= n)
    )
    in_order = F.array_sort(F.collect_list(F.struct("rank", "hashtag")))
    return leaders.groupBy("cluster").agg(
        F.transform(in_order, lambda t: t["hashtag"]).alias("top_hashtags")
    )


def gap_flag(rules: Rules) -> Column:
    return (F.col("avg_competitor_dominance") > rules.dominance_above) & (
        F.col("brand_post_count") < rules.cluster_brand_posts_below
    )


def cluster_rollup(assigned: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """One row per cluster: leading hashtags, mean dominance, brand posts, gap flag.

    The mean is of whole billionths, so the order in which rows arrive does not matter.
    """
    share = F.round(F.col("competitor_dominance") * F.lit(BILLION)).cast("bigint")
    mean = F.sum(share).cast("double") / F.lit(BILLION) / F.count(share)
    totals = assigned.groupBy("cluster").agg(
        round_half_up(mean, 4).alias("avg_competitor_dominance"),
        F.sum("brand_post_count").alias("brand_post_count"),
    )
    return (
        totals.join(cluster_top_tags(assigned), "cluster")
        .withColumn("is_gap_cluster", gap_flag(rules))
        .select(
            F.col("cluster").cast("int").alias("cluster_id"),
            "top_hashtags",
            "avg_competitor_dominance",
            "brand_post_count",
            "is_gap_cluster",
        )
    )


def gap_clusters(rollup: DataFrame) -> DataFrame:
    return rollup.filter("is_gap_cluster")


@dataclass(frozen=True)
class GapReport:
    summary: DataFrame
    gaps: DataFrame
    metrics: DataFrame


def detect_gaps(gold: DataFrame, rules: Rules = DEFAULT_RULES) -> GapReport:
    """Cluster, roll up, and keep the clusters competitors own."""
    found = cluster_captions(gold, rules)
    summary = materialise(cluster_rollup(found.assigned, rules), "clusters")
    discard(*found.stored)
    gaps = gap_clusters(summary)
    score = None if found.silhouette is None else round(found.silhouette, 4)
    metrics = gaps.agg(F.count(F.lit(1)).alias("n_gap_clusters")).select(
        F.lit(found.input_rows).cast("bigint").alias("input_rows"),
        F.lit(score).cast("double").alias("silhouette"),
        "n_gap_clusters",
    )
    return GapReport(summary, gaps, metrics)
