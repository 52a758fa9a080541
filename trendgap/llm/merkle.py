"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections.

A text is cut into paragraphs at line ends and each paragraph into sentences, the leaves
(a sentence without an end is cut after 40 characters). Paragraphs are grouped into
sections: a section ends at an empty line or with a paragraph whose hash is divisible by
four, so an inserted paragraph moves no later section bound. The hash of a node covers
the hashes of its children.

The fingerprint is written as `root:leaves|leaves|...`, the root with 32 hexadecimal
digits, a leaf with six, one group of leaves per section. Equal texts give equal
fingerprints; different roots are told apart by comparing section by section
(`changed_sections`). Likeness is twice the number of leaves in common over the number of
leaves in both, 1 for equal roots.

Null texts count as empty; the empty text has a root and no leaves. Rows are taken in
ascending order of (doc_id, text), null ids first; repeated ids are separate rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from trendgap.llm.common import ship
from trendgap.llm.order import bucket_bounds, bucket_of

LEAF = re.compile(r"[^.!?]{1,40}[.!?]*|[.!?]+")
LEAF_DIGITS = 6


def tree(text: str) -> tuple[str, list[list[str]]]:
    """Root, and the leaf hashes of every section."""
    sections: list[list[str]] = []
    nodes: list[str] = []
    paragraphs: list[str] = []
    leaves: list[str] = []

    def close() -> None:
        if paragraphs:
            nodes.append(xxhash.xxh128_hexdigest("".join(paragraphs)))
            if leaves:
                sections.append(leaves.copy())
            paragraphs.clear()
            leaves.clear()

    for paragraph in text.split("\n"):
        hashes = [xxhash.xxh32_hexdigest(x.encode())[:LEAF_DIGITS] for x in LEAF.findall(paragraph)]
        # Short leaf hashes are enough for likeness; equality needs the wide one.
        node = xxhash.xxh128_hexdigest(paragraph.encode())
        paragraphs.append(node)
        leaves.extend(hashes)
        if not paragraph or int(node[-1], 16) % 4 == 0:
            close()
    close()
    return xxhash.xxh128_hexdigest("".join(nodes)), sections


def fingerprint(text: str) -> str:
    root, sections = tree(text)
    return f"{root}:{'|'.join(map(''.join, sections))}"


def leaves_of(mark: str) -> Counter[str]:
    body = mark.partition(":")[2].replace("|", "")
    return Counter(body[i : i + LEAF_DIGITS] for i in range(0, len(body), LEAF_DIGITS))


def likeness(a: str, b: str) -> float:
    if a[:32] == b[:32]:
        return 1.0
    left, right = leaves_of(a), leaves_of(b)
    total = left.total() + right.total()
    return 2 * (left & right).total() / total if total else 0.0


def changed_sections(a: str, b: str) -> list[int]:
    """Numbers of the sections of `a` that are not sections of `b`."""
    if a[:32] == b[:32]:
        return []
    known = set(b.partition(":")[2].split("|"))
    return [i for i, x in enumerate(a.partition(":")[2].split("|")) if x not in known]


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by the beginning of the next one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


OUT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, "
    "n_sections int, sections_changed int"
)


def with_next(documents: DataFrame) -> DataFrame:
    """Every document once in its key range, and the first one of the next range again
    (`is_tail`), so that each task has the successor of its last row. The first of all
    follows the last."""
    ship(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    bounds = bucket_bounds(docs, "doc_id")

    # Ids and where they are null, apart: a pandas column with nulls would hold floats.
    key = (F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull())

    @F.pandas_udf("int")
    def bucket(ids: pd.Series, missing: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(ids.to_numpy(), missing.to_numpy(), bounds))

    # One row per key range, at most order.MAX_BUCKETS.
    firsts = (
        docs.select("doc_id", bucket(*key).alias("bucket"))
        .groupBy("bucket")
        .agg(F.min("doc_id").alias("first"))
        .orderBy("bucket")
        .collect()
    )
    used = [r["bucket"] for r in firsts]
    before = {r["first"]: used[i - 1] for i, r in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, missing: pd.Series) -> pd.Series:
        own = bucket_of(ids.to_numpy(), missing.to_numpy(), bounds).tolist()
        keys = [None if gone else i for i, gone in zip(ids.tolist(), missing.tolist())]
        return pd.Series(
            [[2 * b, 2 * before[k] + 1] if k in before else [2 * b] for k, b in zip(keys, own)]
        )

    return (
        docs.select("doc_id", "text", F.explode(places(*key)).alias("place"))
        .select("doc_id", "text", F.shiftright("place", 1).alias("bucket"), (F.col("place") % 2).alias("is_tail"))
        .repartition(max(1, len(used)), "bucket")
        .sortWithinPartitions("bucket", "is_tail", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    )


def merkle_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited form (see `edited`), and how alike the
    fingerprint is to that of the edited text and of the next document."""
    import hashlib
    from itertools import chain

    from pyspark.sql.pandas.types import to_arrow_schema

    typed = documents.sparkSession.createDataFrame([], OUT).schema
    arrow = to_arrow_schema(typed)

    def row(doc_id: int | None, text: str, mark: str, following: str, next_mark: str) -> tuple:
        changed = edited(text, following)
        new = mark if changed == text else fingerprint(changed)
        return (
            doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, new,
            likeness(mark, new), likeness(mark, next_mark),
            mark.count("|") + 1 if len(mark) > 33 else 0, len(changed_sections(mark, new)),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(
            zip(*(b.column(c).to_pylist() for c in ("bucket", "is_tail", "doc_id", "text")))
            for batch in batches
            for b in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256))
        )
        held: tuple | None = None
        done: list[tuple] = []
        for bucket, tail, doc_id, text in rows:
            text = text or ""
            if tail and held is None:
                continue  # a further row with the id of the first one
            mark = fingerprint(text)
            if held is not None:
                done.append(row(*held, text, mark))
            held = None if tail else (doc_id, text, mark)
            if len(done) == 256:
                yield from_rows(done)
                done = []
        if done:
            yield from_rows(done)

    def from_rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow
        )

    return with_next(documents).mapInArrow(run, typed)
