"""Post files -> bronze -> silver -> partial insights as streams, gold folded from those."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from trendgap.config import DEFAULT_RULES, DEFAULT_TABLES, BrandConfig, Rules, TableNames
from trendgap.operators import quality
from trendgap.operators.gold import fold_partials, gold_from_partials, gold_in_passes, tag_partials, tag_sums
from trendgap.operators.silver import hashtag_posts
from trendgap.schemas import HASHTAG_POST, INSIGHT, PARTIAL, POST
from trendgap.sources import storage
from trendgap.sources.posts import read_posts_stream
from trendgap.streaming import runs


# Files per micro-batch. A backlog is worked off in steps that can each be repeated.
MAX_FILES = 10_000


@dataclass(frozen=True)
class Paths:
    """Where the layers live; the checkpoints hold what has been read already."""

    landing: str
    root: str

    def table(self, layer: str) -> str:
        return f"{self.root}/{layer}"

    def checkpoint(self, layer: str) -> str:
        return f"{self.root}/_checkpoints/{layer}"


def _writer(df: DataFrame, paths: Paths, layer: str, every: str | None) -> DataStreamWriter:
    """One run over what is there, or a run `every` so often."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return (
        df.writeStream.outputMode("append")
        .option("checkpointLocation", paths.checkpoint(layer))
        .queryName(f"{layer}:{paths.root}")
        .trigger(**trigger)
    )


def start_bronze(
    spark: SparkSession, paths: Paths, every: str | None = None, max_files: int = MAX_FILES
) -> StreamingQuery:
    storage.ensure_folder(spark, paths.landing)
    posts = read_posts_stream(spark, paths.landing, max_files)
    valid = quality.expect(posts, quality.BRONZE_RULES, "bronze_rules")
    writer = _writer(valid, paths, "bronze", every).option("compression", storage.CODEC)
    return writer.format("parquet").start(paths.table("bronze"))


def start_silver(
    spark: SparkSession,
    paths: Paths,
    rules: Rules = DEFAULT_RULES,
    every: str | None = None,
    max_files: int = MAX_FILES,
) -> StreamingQuery:
    reader = spark.readStream.schema(POST).option("maxFilesPerTrigger", max_files)
    enriched = hashtag_posts(reader.parquet(paths.table("bronze")), rules)
    valid = quality.expect(enriched, quality.SILVER_RULES, "silver_rules")
    return _writer(valid, paths, "silver", every).format("parquet").start(paths.table("silver"))


def read_silver(spark: SparkSession, paths: Paths) -> DataFrame:
    return spark.read.schema(HASHTAG_POST).parquet(paths.table("silver"))


def start_unique(
    spark: SparkSession,
    paths: Paths,
    tables: TableNames = DEFAULT_TABLES,
    every: str | None = None,
    max_files: int = MAX_FILES,
) -> StreamingQuery:
    """Bronze posts into a table that holds every post once, whatever batches it came in and
    however far apart. There is no watermark: the ids of all time are looked up, but only
    in the folders that the ids of the batch fall in. A replayed batch adds nothing. The
    first of several posts with one id stays, later ones of another content are kept apart."""
    storage.ensure_database(spark, tables)
    reader = spark.readStream.schema(POST).option("maxFilesPerTrigger", max_files)

    def keep(rows: DataFrame, batch: int) -> None:
        storage.append_new(rows, tables.full("unique"), "post_id")

    writer = _writer(reader.parquet(paths.table("bronze")), paths, "unique", every)
    return writer.foreachBatch(keep).start()


def write_partials(silver: DataFrame, paths: Paths, batch: int) -> None:
    """Partial insights of one micro-batch in a folder of its own: a replayed batch
    replaces what it wrote before."""
    folder = f"{paths.table('partials')}/{runs.name(batch, batch)}"
    sums = tag_sums(silver)
    tag_partials(silver, sums=sums).write.mode("overwrite").parquet(folder)
    storage.discard(sums)


def read_partials(spark: SparkSession, paths: Paths) -> DataFrame:
    """Partials of all batches, each batch once."""
    folder = paths.table("partials")
    return runs.read(spark, folder, runs.standing(spark, folder), PARTIAL)


def compact_partials(
    spark: SparkSession, paths: Paths, before: int, fan_out: int = runs.FAN_OUT
) -> None:
    """Fold the partials of batches below `before`, which must be committed, into runs of
    `fan_out`, `fan_out`^2, ... batches."""
    runs.compact(spark, paths.table("partials"), before, fold_partials, PARTIAL, fan_out)


def start_gold(
    spark: SparkSession,
    paths: Paths,
    brand: BrandConfig,
    rules: Rules = DEFAULT_RULES,
    every: str | None = None,
    max_files: int = MAX_FILES,
    fan_out: int = runs.FAN_OUT,
) -> StreamingQuery:
    """Reads each silver row once. After each micro-batch gold is folded anew from the
    partials. Those of earlier batches are merged in tiers, so a refresh reads a few rows
    per hashtag, however many batches there were. A batch begins only when the one before
    is committed, so what is merged is never replayed."""
    reader = spark.readStream.schema(HASHTAG_POST).option("maxFilesPerTrigger", max_files)

    def refresh(rows: DataFrame, batch: int) -> None:
        write_partials(rows, paths, batch)
        compact_partials(spark, paths, batch, fan_out)
        refresh_gold(spark, paths, brand, rules)

    writer = _writer(reader.parquet(paths.table("silver")), paths, "gold", every)
    return writer.foreachBatch(refresh).start()


def refresh_gold(
    spark: SparkSession, paths: Paths, brand: BrandConfig, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Insights folded from all partials, as a new version: whoever reads gold meanwhile
    has the version before."""
    insights = gold_from_partials(read_partials(spark, paths), brand, rules)
    storage.write_version(insights, paths.table("gold"))
    return read_gold(spark, paths)


def read_gold(spark: SparkSession, paths: Paths) -> DataFrame:
    """The newest version; before the first one there are no insights."""
    path = storage.newest_version(spark, paths.table("gold"))
    return storage.empty(spark, INSIGHT) if path is None else spark.read.schema(INSIGHT).parquet(path)


def recomputed_gold(
    spark: SparkSession, paths: Paths, brand: BrandConfig, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """The same insights from all of silver, as a check of the folded ones."""
    return gold_in_passes(read_silver(spark, paths), brand, rules)


def update(
    spark: SparkSession,
    paths: Paths,
    rules: Rules = DEFAULT_RULES,
    max_files: int = MAX_FILES,
    brand: BrandConfig | None = None,
) -> None:
    """Bring bronze and silver, and for a brand gold, up to date with what has landed."""
    start_bronze(spark, paths, max_files=max_files).awaitTermination()
    start_silver(spark, paths, rules, max_files=max_files).awaitTermination()
    if brand is not None:
        start_gold(spark, paths, brand, rules, max_files=max_files).awaitTermination()
