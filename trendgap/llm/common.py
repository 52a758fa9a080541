"""Reading the input tables, and what queries keep between their steps."""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's modules, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="package-")) / "trendgap_modules.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for module in sorted(package.rglob("*.py")):
            archive.write(module, str(module.relative_to(package.parent)))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster names for shared files, as a URI. Where
    none is named, as in tests on one machine, a temporary folder becomes that folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


# While it is set, Spark deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Written once and read back: later steps do not compute it again, nor need the
    executors that made it. The shuffle files of its making are let go at once."""
    spark = frame.sparkSession
    path = shared_folder(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(frame.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what `stored` wrote for these frames, once nothing reads it any more."""
    for frame in frames:
        path = _PATHS.pop(frame, None)
        if path is not None:
            context = frame.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def numbered(documents: DataFrame) -> DataFrame:
    """Stored with a number of its own for each row: row, text, and all other columns in
    the struct `document`, where their names clash with nothing."""
    others = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    return stored(
        documents.select(
            F.monotonically_increasing_id().alias("row"), "text", F.struct(*others).alias("document")
        ),
        "numbered",
    )


def restored(frame: DataFrame, documents: DataFrame, **changed) -> DataFrame:
    """The columns of `documents` again, some of them computed anew."""
    return frame.select(
        *(
            changed[c].cast(documents.schema[c].dataType).alias(c) if c in changed
            else F.col("text") if c == "text"
            else F.col("document").getField(c).alias(c)
            for c in documents.columns
        )
    )
