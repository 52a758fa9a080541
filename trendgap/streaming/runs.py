"""Results of micro-batches that add up, in folders named by the batches they cover.

Every batch writes a run of its own. Runs of `fan_out` successive batches are merged into
one, runs of those again, and so on, so that n batches leave about fan_out * log(n) folders.
A merged run is written under a draft name first. While it and what it was merged from are
both there, only the wider one stands; the others are deleted afterwards, by the next merge
if this one breaks off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from trendgap.sources import storage

FAN_OUT = 8
Run = tuple[int, int]


def name(first: int, last: int) -> str:
    return f"batches-{first:012d}-{last:012d}"


def _range(folder: str) -> Run:
    first, last = folder.removeprefix("batches-").split("-")
    return int(first), int(last)


def widest(found: list[Run]) -> list[Run]:
    """The runs that no other one covers, in order."""
    out: list[Run] = []
    for run in sorted(found, key=lambda r: (r[0], -r[1])):
        if not out or run[1] > out[-1][1]:
            out.append(run)
    return out


def merges(found: list[Run], before: int, fan_out: int) -> list[tuple[Run, list[Run]]]:
    """What to merge, in this order: the run to be, and those it is made of. Only batches
    below `before` are touched, and only whole blocks of fan_out^k of them."""
    now, out, width = widest(found), [], fan_out
    while width <= before:
        blocks: dict[int, list[Run]] = {}
        for run in now:
            block = run[0] // width
            if run[1] < (block + 1) * width <= before:
                blocks.setdefault(block, []).append(run)
        for block, members in blocks.items():
            if len(members) > 1:
                whole = (block * width, (block + 1) * width - 1)
                out.append((whole, members))
                now = [r for r in now if r not in members] + [whole]
        now.sort()
        width *= fan_out
    return out


def standing(spark: SparkSession, folder: str) -> list[Run]:
    """The finished runs that cover each batch once."""
    return widest([_range(n) for n in storage.finished_folders(spark, folder)])


def read(spark: SparkSession, folder: str, which: list[Run], schema: StructType) -> DataFrame:
    if not which:
        return storage.empty(spark, schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{name(*run)}" for run in which])


def compact(
    spark: SparkSession,
    folder: str,
    before: int,
    fold: Callable[[DataFrame], DataFrame],
    schema: StructType,
    fan_out: int = FAN_OUT,
) -> None:
    """Merge what can be merged of the batches below `before`, and delete what was merged."""
    found = [_range(n) for n in storage.finished_folders(spark, folder)]
    for whole, members in merges(found, before, fan_out):
        draft = f"{folder}/_draft-{name(*whole)}"
        fold(read(spark, folder, members, schema)).write.mode("overwrite").parquet(draft)
        storage.move_folder(spark, draft, f"{folder}/{name(*whole)}")
        found.append(whole)
    for run in set(found) - set(widest(found)):
        storage.delete_folder(spark, f"{folder}/{name(*run)}")
