"""What the rules found in a stream, kept per batch, and the lines that are no posts.

An audit is a stream of its own over what a layer reads. Each micro-batch writes its counts
and its refused lines to folders named by the batch, so a replayed batch replaces what it
wrote; folders of earlier batches are merged in tiers. Counts are taken while the batch is
written, in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from trendgap.config import DEFAULT_RULES, Rules
from trendgap.operators import quality
from trendgap.operators.silver import hashtag_posts
from trendgap.schemas import DEAD_LETTER, FIGURE, POST
from trendgap.sources import storage
from trendgap.streaming import medallion, runs

CORRUPT = "_corrupt_record"
# A rule on lines, before those on posts. A line with a field that cannot be read stays, the
# field being NULL, if at least its post_id can.
PARSED = quality.Expectation("is_post", f"{CORRUPT} IS NULL OR post_id IS NOT NULL", drops=True)


def lines_schema() -> T.StructType:
    return T.StructType([*POST.fields, T.StructField(CORRUPT, T.StringType())])


def dead_letters(lines: DataFrame) -> DataFrame:
    """The refused lines with their file and where the block that they were read in begins."""
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col(CORRUPT).alias("line"),
        F.col("post_id"),
    ).filter(PARSED.violated()).select("file", "block_start", "line")


def _counts(rules: Sequence[quality.Expectation], among: Column) -> list[Column]:
    return [F.count_if(among & rule.violated()).alias(rule.name) for rule in rules]


def _figures(spark: SparkSession, rules: Sequence[quality.Expectation], checked: int, found: dict) -> DataFrame:
    """One row per rule, as in `quality.report`."""
    rows = [
        (r.name, "drop" if r.drops else "warn", checked, found[r.name], checked - (found[r.name] if r.drops else 0))
        for r in rules
    ]
    return spark.createDataFrame(rows, FIGURE)


def _keep(spark: SparkSession, paths: medallion.Paths, what: str, rows: DataFrame, batch: int) -> None:
    folder = paths.table(what)
    rows.write.mode("overwrite").parquet(f"{folder}/{runs.name(batch, batch)}")
    fold, schema = (totals, FIGURE) if rows.columns == FIGURE.names else (lambda df: df, DEAD_LETTER)
    runs.compact(spark, folder, batch, fold, schema)


def start_bronze_audit(
    spark: SparkSession, paths: medallion.Paths, every: str | None = None, max_files: int = medallion.MAX_FILES
) -> StreamingQuery:
    """Counts of landed lines, of those that are no posts, and of the bronze rules."""
    storage.ensure_folder(spark, paths.landing)
    lines = (
        spark.readStream.schema(lines_schema()).option("maxFilesPerTrigger", max_files)
        .option("columnNameOfCorruptRecord", CORRUPT).json(paths.landing)
        .select("*", "_metadata")
    )

    def keep(rows: DataFrame, batch: int) -> None:
        seen = Observation()
        parsed = ~PARSED.violated()
        counted = rows.observe(
            seen, F.count(F.lit(1)).alias("rows"), F.count_if(parsed).alias("parsed"),
            *_counts((PARSED,), F.lit(True)), *_counts(quality.BRONZE_RULES, parsed),
        )
        _keep(spark, paths, "dead_letters", dead_letters(counted), batch)
        found = seen.get
        figures = _figures(spark, (PARSED,), found["rows"], found).union(
            _figures(spark, quality.BRONZE_RULES, found["parsed"], found)
        )
        _keep(spark, paths, "figures/bronze", figures, batch)

    return medallion._writer(lines, paths, "bronze_audit", every).foreachBatch(keep).start()


def start_silver_audit(
    spark: SparkSession,
    paths: medallion.Paths,
    rules: Rules = DEFAULT_RULES,
    every: str | None = None,
    max_files: int = medallion.MAX_FILES,
) -> StreamingQuery:
    """Counts of the silver rules over the rows that they are applied to."""
    reader = spark.readStream.schema(POST).option("maxFilesPerTrigger", max_files)

    def keep(rows: DataFrame, batch: int) -> None:
        seen = Observation()
        judged = hashtag_posts(rows, rules).select("hashtag", "sentiment_score")  # what the rules look at
        counted = judged.observe(
            seen, F.count(F.lit(1)).alias("rows"), *_counts(quality.SILVER_RULES, F.lit(True))
        )
        counted.write.format("noop").mode("overwrite").save()
        _keep(spark, paths, "figures/silver", _figures(spark, quality.SILVER_RULES, seen.get["rows"], seen.get), batch)

    stream = reader.parquet(paths.table("bronze"))
    return medallion._writer(stream, paths, "silver_audit", every).foreachBatch(keep).start()


def totals(figures: DataFrame) -> DataFrame:
    return figures.groupBy("rule", "action").agg(
        *[F.sum(c).alias(c) for c in ("checked", "violations", "kept")]
    )


def read_figures(spark: SparkSession, paths: medallion.Paths, layer: str) -> DataFrame:
    """The report of all batches so far, as `quality.report` gives it for a table."""
    folder = paths.table(f"figures/{layer}")
    return totals(runs.read(spark, folder, runs.standing(spark, folder), FIGURE))


def read_dead_letters(spark: SparkSession, paths: medallion.Paths) -> DataFrame:
    folder = paths.table("dead_letters")
    return runs.read(spark, folder, runs.standing(spark, folder), DEAD_LETTER)


def update(
    spark: SparkSession, paths: medallion.Paths, rules: Rules = DEFAULT_RULES, max_files: int = medallion.MAX_FILES
) -> None:
    """Bring the audits up to date with what has landed and with bronze."""
    start_bronze_audit(spark, paths, max_files=max_files).awaitTermination()
    start_silver_audit(spark, paths, rules, max_files=max_files).awaitTermination()
