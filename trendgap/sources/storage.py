"""Shared storage for intermediate results, and tables of the catalog."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from trendgap.config import DEFAULT_TABLES, TableNames


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster names for shared intermediate data, or
    else beside the tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
    return f"{base.rstrip('/')}/trendgap/{label}-{uuid.uuid4().hex}"


# Of what is written here, and of bronze: about a third less than Spark's default.
CODEC = "zstd"

_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: later passes neither recompute the lineage nor depend on
    the executors that produced it."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", CODEC).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what `materialise` wrote for these frames, once nothing reads it any more."""
    for frame in frames:
        path = _PATHS.pop(frame, None)
        if path is not None:
            delete_folder(frame.sparkSession, path)


# --- Folders, in whatever file system their paths name ----------------------------------


def _place(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def ensure_folder(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.mkdirs(place)


def delete_folder(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Give a finished folder its name; what had that name goes first."""
    files, place = _place(spark, source)
    _, to = _place(spark, target)
    files.delete(to, True)
    if not files.rename(place, to):
        raise OSError(f"cannot move {source} to {target}")


def finished_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders that a write to Parquet has finished, sorted."""
    files, place = _place(spark, path)
    if not files.exists(place):
        return []
    names = [f.getPath().getName() for f in files.listStatus(place) if f.isDirectory()]
    return sorted(
        n for n in names if n[0] not in "_." and files.exists(_place(spark, f"{path}/{n}/_SUCCESS")[1])
    )


# --- Versions: readers see the old rows or the new ones ----------------------------------

KEPT_VERSIONS = 2


def write_version(df: DataFrame, path: str) -> str:
    """Write the rows to a new folder under `path`, after which readers of the newest one see
    them. The version before stays for those who still read it; older ones go."""
    spark = df.sparkSession
    before = finished_folders(spark, path)
    number = int(before[-1].removeprefix("version-")) + 1 if before else 0
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    df.write.parquet(draft)
    move_folder(spark, draft, target := f"{path}/version-{number:012d}")
    for old in before[: 1 - KEPT_VERSIONS]:
        delete_folder(spark, f"{path}/{old}")
    return target


def newest_version(spark: SparkSession, path: str) -> str | None:
    found = finished_folders(spark, path)
    return f"{path}/{found[-1]}" if found else None


def ensure_database(spark: SparkSession, tables: TableNames = DEFAULT_TABLES) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {tables.database}")


def _is_view(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table) and spark.catalog.getTable(table).tableType == "VIEW"


def _versions(spark: SparkSession, table: str) -> str:
    database, _, name = table.rpartition(".")
    where = spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri
    return f"{where.rstrip('/')}/_versions/{name}"


def overwrite_table(df: DataFrame, table: str) -> None:
    """Replace rows and schema without a gap: the rows are written beside the old ones, then
    the name, a view, is switched to them. Readers that began before go on with the old
    rows. A frame without rows leaves an empty table of its schema."""
    spark = df.sparkSession
    path = write_version(df, _versions(spark, table))
    if spark.catalog.tableExists(table) and not _is_view(spark, table):
        spark.sql(f"DROP TABLE {table}")  # made by a plain append
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM parquet.`{path}`")


def append_table(df: DataFrame, table: str) -> None:
    spark = df.sparkSession
    if not _is_view(spark, table):
        df.write.mode("append").format("parquet").saveAsTable(table)
    elif path := newest_version(spark, _versions(spark, table)):
        df.write.mode("append").parquet(path)
        spark.catalog.refreshTable(table)
    else:
        raise ValueError(f"{table} has keys: use append_new")


# Columns of a ledger besides those of its table.
BUCKET, CONTENT = "_bucket", "_content"
BUCKETS = 16

# Rows that a task appends, so that small batches leave few files in the folders.
APPENDED = 250_000

# Bytes that a task holds of each of the files that it has open, one in every folder.
ROW_GROUP = 16 << 20

# Stands for the number of a row that the table holds.
HELD = -1


def append_new(df: DataFrame, table: str, *keys: str, volatile: tuple[str, ...] = ()) -> None:
    """Append the rows that are not stored yet: the same batch stored twice leaves the rows
    of one, and no row is lost. A table has the same keys at every append.

    A row is known by its keys, NULL being equal to NULL; where a key is NULL, by its whole
    content as well (but for `volatile` columns, such as the time of storing). Rows that
    share all their keys with a row of another content go to `<table>_clashes`; of several
    such rows in one batch the one with the smallest digest is stored.

    Rows live in `<table>_ledger`, in folders by a hash of their keys, and `table` is a view
    of it: an append reads the keys and digests of the folders that its own keys fall in,
    nothing else.

    Batch and table meet by two numbers, hashes of the keys and of the digest. Rows of one
    key hash that all share the other one as well are one row, stored or new (128 bits agree).
    Keys and digests themselves are compared for the rest alone: rows of one key and several
    contents, or of several keys with one hash. Whole rows are not shuffled: the numbers of
    those to store come back as bits.
    """
    spark, ledger = df.sparkSession, f"{table}_ledger"
    _take_in(spark, table, keys, volatile)
    other = F.when(_complete(keys), F.lit("")).otherwise(F.col(CONTENT)).alias("_other")
    hashed = _hashed(keys, other).alias("_key")
    # Written apart first: a table cannot be read and appended to in one job.
    given = materialise(df.select("*", F.monotonically_increasing_id().alias("_row")), "given-rows")
    marked = _marked(given, keys, (*volatile, "_row"))
    known, held = spark.catalog.tableExists(ledger), None
    met = marked.select(hashed, F.xxhash64(CONTENT).alias("_hash"), "_row")
    if known:
        folders = sorted(r[BUCKET] for r in marked.select(BUCKET).distinct().collect())  # BUCKETS at most
        held = spark.table(ledger).filter(F.col(BUCKET).isin(folders))
        met = met.union(held.select(hashed, F.xxhash64(CONTENT), F.lit(HELD)))
    # Most keys are met once in a task: to combine them before the shuffle would only fill memory.
    judged = met.repartition("_key").groupBy("_key").agg(
        F.min("_hash").alias("_least"), F.max("_hash").alias("_most"), F.min("_row").alias("_row")
    )
    agree = F.col("_least") == F.col("_most")
    verdicts = materialise(
        judged.filter(~agree | (F.col("_row") != HELD)).select(
            F.when(agree, F.col("_row")).alias("_row"), F.when(~agree, F.col("_key")).alias("_key")
        ),
        "verdicts",
    )
    found = verdicts.agg(F.count("_row").alias("fresh"), F.count("_key").alias("unclear")).first()
    count, fresh = found["fresh"], verdicts.filter("_row IS NOT NULL").select("_row")
    clashing, open_keys = 0, None
    if found["unclear"]:
        unclear = verdicts.filter("_key IS NOT NULL").select("_key")
        open_keys = materialise(_compared(marked, held, unclear, keys, hashed, other), "open-keys")
        more = open_keys.agg(F.count_if("_is_fresh").alias("fresh"), F.count_if("_is_clash").alias("clashing")).first()
        count, clashing = count + more["fresh"], more["clashing"]
        fresh = fresh.union(open_keys.filter("_is_fresh").select("_row"))
    if count or not known:
        rows = marked if count == given.count() else _numbered(marked, fresh)
        rows = rows.select(*df.columns, CONTENT, BUCKET).coalesce(count // APPENDED + 1)
        _into_folders(rows, ledger)
    shown = ", ".join(f"`{c}`" for c in df.columns)
    spark.sql(f"CREATE VIEW IF NOT EXISTS {table} AS SELECT {shown} FROM {ledger}")
    if clashing:
        kept = open_keys.filter("_is_clash").select(BUCKET, *keys, "_other", "_stands")
        new = marked.select(BUCKET, *keys, other, CONTENT, "_row").alias("n")
        pairs = new.join(kept.alias("s"), _same("n", "s", keys)).filter(f"n.{CONTENT} <> s._stands")
        clashes = _numbered(marked, pairs.select("n._row")).select(*df.columns, F.col(CONTENT).alias("clash"))
        append_new(clashes, f"{table}_clashes", *keys, "clash", volatile=volatile)
    discard(*[f for f in (given, verdicts, open_keys) if f is not None])


def _hashed(keys: tuple[str, ...], other: Column) -> Column:
    return F.xxhash64(*[F.col(k).cast("string") for k in keys], other)


def _compared(
    marked: DataFrame, held: DataFrame | None, unclear: DataFrame, keys: tuple[str, ...], hashed: Column, other: Column
) -> DataFrame:
    """Of the keys whose hashes are unclear, those that are new or clash: `_is_fresh` with the
    row to store, `_is_clash` with the digest that stands. Keys and digests are compared."""
    new = marked.select(BUCKET, *keys, other, hashed, "_row", F.col(CONTENT).alias("_new"))
    met = new.join(unclear, "_key", "left_semi").withColumn("_old", F.lit(None).cast("string"))
    if held is not None:
        old = held.select(BUCKET, *keys, other, hashed, F.col(CONTENT).alias("_old"))
        met = met.unionByName(old.join(unclear, "_key", "left_semi"), allowMissingColumns=True)
    judged = met.groupBy(BUCKET, *keys, "_other").agg(
        F.min("_new").alias("_least"), F.max("_new").alias("_most"), F.min_by("_row", "_new").alias("_row"),
        F.max("_old").alias("_held"),
    ).withColumn("_stands", F.coalesce("_held", "_least"))
    # Neither is true of a key that this batch does not have.
    is_clash = F.coalesce((F.col("_least") != F.col("_stands")) | (F.col("_most") != F.col("_stands")), F.lit(False))
    judged = judged.withColumns({"_is_fresh": F.col("_held").isNull(), "_is_clash": is_clash})
    return judged.filter("_is_fresh OR _is_clash")


# Rows that an entry of the table of bits tells of, in words of 64.
SPAN = 512


def _numbered(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows whose `_row` is among the numbers. These are sent to all tasks as bits, about a
    quarter of a byte a row, so that the rows need not be shuffled."""
    span, word = F.expr(f"_row div {SPAN}").alias("_span"), F.expr(f"_row % {SPAN} div 64")
    bit = F.expr("shiftleft(1L, cast(_row % 64 AS int))")
    words = [F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"_{i}") for i in range(SPAN // 64)]
    table = numbers.groupBy(span).agg(*words)
    picked = F.element_at(F.array(*[F.col(f"_{i}") for i in range(SPAN // 64)]), (word + 1).cast("int"))
    return rows.withColumn("_span", span).join(F.broadcast(table), "_span").filter(picked.bitwiseAND(bit) != 0)


@contextmanager
def _open_folders(spark: SparkSession) -> Iterator[None]:
    """Tasks keep a file open in each folder they write to, instead of sorting their rows. When
    as many are open as are allowed, they sort the rest: so one more is."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BUCKETS + 1)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _into_folders(rows: DataFrame, ledger: str) -> None:
    with _open_folders(rows.sparkSession):
        writer = rows.write.mode("append").option("compression", CODEC).option("parquet.block.size", ROW_GROUP)
        writer.partitionBy(BUCKET).format("parquet").saveAsTable(ledger)


def _same(left: str, right: str, keys: tuple[str, ...]) -> Column:
    pairs = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in (*keys, "_other")]
    return (F.col(f"{left}.{BUCKET}") == F.col(f"{right}.{BUCKET}")) & _all(pairs)


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def _complete(keys: tuple[str, ...]) -> Column:
    return _all([F.col(k).isNotNull() for k in keys])


def _marked(df: DataFrame, keys: tuple[str, ...], volatile: tuple[str, ...]) -> DataFrame:
    """With the folder and the digest of the content of each row."""
    content = F.to_json(F.struct(*sorted(set(df.columns) - set(volatile))), {"ignoreNullFields": "false"})
    return df.withColumns(
        {
            CONTENT: F.sha2(content, 256),
            BUCKET: F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(BUCKETS)).cast("int"),
        }
    )


def _take_in(spark: SparkSession, table: str, keys: tuple[str, ...], volatile: tuple[str, ...]) -> None:
    """Rows that a plain append has stored under the name go to the ledger as they are."""
    if spark.catalog.tableExists(table) and not _is_view(spark, table):
        _into_folders(_marked(spark.table(table), keys, volatile), f"{table}_ledger")
        spark.sql(f"DROP TABLE {table}")


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_table(
    spark: SparkSession,
    table: str,
    default: DataFrame | None = None,
    schema: StructType | None = None,
) -> DataFrame:
    """The table if it exists and has rows, else `default`, else no rows of `schema`."""
    if spark.catalog.tableExists(table):
        found = spark.table(table)
        if default is None or not found.isEmpty():
            return found
    if default is not None:
        return default
    if schema is None:
        raise ValueError(f"{table} does not exist and neither default nor schema is given")
    return empty(spark, schema)
