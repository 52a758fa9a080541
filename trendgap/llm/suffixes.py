"""Repeated passages, byte by byte: every byte inside a string of `length` (200) bytes that
also starts anywhere else is removed.

All starts of such strings ("windows") are suffixes cut at 200 bytes; a window is repeated
if another suffix has a common extension of 200 bytes with it. Extensions are compared by
prefix polynomial hashes: two running sums per text, with different bases, give the hash
of any of its substrings in constant time.

Sorting every suffix of a corpus would move each byte of it many times through a shuffle.
So suffixes are first brought together by anchors. The anchor of a window is the place of
the smallest hash among its substrings of `gram` (100) bytes; it depends on the window
alone, so equal windows have it at the same distance. The windows of a text fall into
runs with one anchor. The common extension of the members of a group is then found by a
search over blocks of windows, coarse to fine: a run, cells of `cell` (8) windows, single
windows. A block has an inner string, which all its windows share, and an outer one, which
they make up together:

* outer string met twice: all windows of the block are repeated;
* inner string met once: none of them is;
* else the block is cut into smaller ones for the next level. Of blocks with one outer
  string, one stands for all.

Collisions: inner and outer string are hashed with different bases, and members agree only
if both hashes do, that is in 128 bits. Hashes are counted with map-side combining and
joined back, so that a passage of a third of all documents never meets in one task.

Null and empty texts have no bytes; texts shorter than 200 bytes lose nothing. Rows get a
number of their own, so repeated ids and equal rows are separate rows (and equal texts of
200 bytes or more remove each other wholly).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from trendgap.llm.batches import Texts, arrow_map, chunks, mixed
from trendgap.llm.common import discard, numbered, restored, ship, stored

LENGTH = 200
GRAM = 100
CELL = 8
MOST_POWERS = 4 << 20
CHUNK = 1 << 19

# Odd bases of the two polynomials, modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
# What stands for each byte in them.
BYTES = [mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (3, 5)]


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64; kept, as every chunk needs the same ones."""
    out = _POWERS.get(base)
    if out is None or len(out) < count:
        out = np.ones(max(count, 1 << 16), np.uint64)
        done = 1
        while done < len(out):
            more = min(done, len(out) - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        if count <= MOST_POWERS:
            _POWERS[base] = out
    return out[:count]


class Hashes:
    """Prefix hashes of a byte array; `of` hashes many of its substrings at once."""

    def __init__(self, data: np.ndarray, bases: int = 2) -> None:
        n = len(data) + 1
        self.powers, self.sums = [], []
        for base, table in list(zip(BASES, BYTES))[:bases]:
            sums = np.zeros(n, np.uint64)
            np.cumsum(table[data] * powers(pow(base, -1, 1 << 64), n - 1), out=sums[1:])
            self.powers.append(powers(base, n))
            self.sums.append(sums)

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        sums = self.sums[which]
        return mixed((sums[ends] - sums[starts]) * self.powers[which][starts])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for every i, by doubling."""
    out, done = values.copy(), 1
    while done * 2 <= width:
        np.minimum(out[:-done], out[done:], out=out[:-done])
        done *= 2
    rest = width - done
    if rest:
        np.minimum(out[:-rest], out[rest:], out=out[:-rest])
    return out


def runs(texts: Texts, hashes: Hashes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window) of each run, as places in the chunk."""
    n = len(texts.bytes)
    ends = np.repeat(texts.starts[1:], texts.lengths)
    place = np.arange(n)
    starts = np.flatnonzero(place + gram <= ends)
    key = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    key[starts] = hashes.of(starts, starts + gram, 0)
    key = (key & ~np.uint64(0xFFFFFFFF)) | place.astype(np.uint64)
    windows = np.flatnonzero(place + length <= ends)
    if not len(windows):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    owner = (sliding_min(key, length - gram + 1)[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    lasts = np.append(begins[1:], len(windows)) - 1
    return owner[begins], windows[begins], windows[lasts]


# `place` packs the first window, how far the anchor is from it (16 bits), and the last one.
BLOCK = "inner bigint, outer bigint, row bigint, place bigint"


def blocks_of(
    hashes: Hashes, at: np.ndarray, rows: np.ndarray, inner: tuple, outer: tuple,
    anchor: np.ndarray, first: np.ndarray, last: np.ndarray,
) -> list:
    """Columns of BLOCK. `at` is where each text begins; places count from there.
    How a block lies about its anchor is part of both strings."""
    near, far = mixed((anchor - first).astype(np.uint64)), mixed((last - anchor + 512).astype(np.uint64))
    lies = mixed((anchor - inner[0]).astype(np.uint64))
    return [
        (hashes.of(*inner, 0) ^ lies).view(np.int64),
        (hashes.of(*outer, 1) ^ near ^ (far * np.uint64(3))).view(np.int64),
        rows,
        ((first - at) << 32) | ((anchor - first) << 16) | (last - first),
    ]


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of packed places."""
    first = place >> 32
    return first + ((place >> 16) & 0xFFFF), first, first + (place & 0xFFFF)


def first_level(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """A block for every run of windows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for part in chunks(batches, limit=CHUNK):
            texts = Texts(part)
            hashes = Hashes(texts.bytes)
            anchor, first, last = runs(texts, hashes, length, gram)
            text = np.searchsorted(texts.starts, anchor, side="right") - 1
            number = np.asarray(part.column("row"))[text]
            yield blocks_of(
                hashes, texts.starts[text], number, (anchor, anchor + gram),
                (first, last + length), anchor, first, last,
            )

    return arrow_map(rows.select("row", "text"), emit, BLOCK)


def next_level(rows: DataFrame, open_blocks: DataFrame, length: int, cell: int) -> DataFrame:
    """The open blocks cut into cells of `cell` windows, counted from their anchor."""
    wanted = open_blocks.groupBy("row").agg(
        F.collect_list("place").alias("blocks")
    )  # of one text: as many as it has blocks

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for part in chunks(batches, limit=CHUNK):
            texts = Texts(part)
            hashes = Hashes(texts.bytes)
            lists = part.column("blocks")
            text = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))
            at = texts.starts[text]
            anchor, first, last = unpacked(np.asarray(lists.flatten()))
            # Cells by distance from the anchor: number of the first and of the last one.
            far, near = (anchor - first) // cell, (anchor - last) // cell
            count = far - near + 1
            block = np.repeat(np.arange(len(anchor)), count)
            number = near[block] + np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
            anchor, at = anchor[block] + at[block], at[block]
            begin = np.maximum(anchor - number * cell - cell + 1, first[block] + at)
            end = np.minimum(anchor - number * cell, last[block] + at)
            # What all windows of a whole cell share.
            inner = (anchor - number * cell, anchor - number * cell - cell + 1 + length)
            row = np.asarray(part.column("row"))[text[block]]
            yield blocks_of(hashes, at, row, inner, (begin, end + length), anchor, begin, end)

    joined = rows.select("row", "text").join(wanted, "row")
    return arrow_map(joined, emit, BLOCK)


def without(blocks: DataFrame, gone: DataFrame) -> DataFrame:
    """row and place of the blocks that are not among `gone`. A block is known by these two, so
    each is met twice at most, and nothing is looked up by the strings that many blocks share."""
    marked = blocks.select("row", "place", F.lit(False).alias("gone")).union(
        gone.select("row", "place", F.lit(True))
    )
    left = marked.groupBy("row", "place").agg(F.max("gone").alias("gone"))
    return left.where("NOT gone").drop("gone")


def judge(blocks: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(repeated blocks, open blocks) of one level, each stored as row and place."""
    inner = blocks.groupBy("inner").agg(
        F.count("*").alias("n"), F.min("outer").alias("low"), F.max("outer").alias("high")
    )
    inner = stored(
        inner.where("n > 1").select("inner", F.expr("low = high").alias("whole")), f"{label}-inner"
    )
    met = stored(blocks.join(inner, "inner"), f"{label}-met")
    mixed_ = met.where("NOT whole")
    outer = stored(
        mixed_.groupBy("inner", "outer").agg(
            F.count("*").alias("n"), F.first("row").alias("row"), F.first("place").alias("place")
        ),
        f"{label}-outer",
    )
    once = outer.where("n = 1")
    single = stored(once.select("inner").distinct(), f"{label}-single")
    still_open = stored(outer.join(single, "inner").select("row", "place"), f"{label}-open")
    repeated = met.where("whole").select("row", "place").union(without(mixed_, once))
    repeated = stored(repeated, f"{label}-repeated")
    discard(inner, met, outer, single)
    return repeated, still_open


OUT = (
    "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
    "kept binary, starts array<int>, ends array<int>"
)


def removed_spans(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of bytes covered by the windows first..last."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(last[order] + length)
    begins = np.append(True, first[1:] > end[:-1])
    return first[begins], end[np.append(np.flatnonzero(begins)[1:] - 1, len(end) - 1)]


def repeated_blocks(rows: DataFrame, length: int, gram: int, cell: int) -> DataFrame:
    """row and the packed places of its repeated blocks, for rows with any."""
    # Cheap to make again for the second pass over them, and large to keep.
    found, still_open = judge(first_level(rows, length, gram), "runs")
    for size in (cell, 1):
        blocks = stored(next_level(rows, still_open, length, size), f"cells-{size}")
        discard(still_open)
        repeated, still_open = judge(blocks, f"cells-{size}")
        discard(blocks)
        found = found.union(repeated)
    discard(still_open)
    return found.groupBy("row").agg(F.collect_list("place").alias("blocks"))


def kept_parts(texts: Texts, lists: pa.Array, length: int) -> Iterator[tuple]:
    """For every text (removed starts, removed ends, bytes kept)."""
    for text, blocks in zip(texts.each(), lists):
        start = end = np.zeros(0, np.int64)
        if blocks.is_valid:
            _, first, last = unpacked(np.asarray(blocks.values))
            start, end = removed_spans(first, last, length)
        edges = [0, *np.stack((start, end), 1).ravel().tolist(), len(text)]
        yield start, end, b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(
    documents: DataFrame, length: int = LENGTH, gram: int = GRAM, cell: int = CELL
) -> DataFrame:
    """Columns as in OUT for every row: what is left (`kept`, bytes that may begin or end
    inside a character) and the removed spans."""
    rows = numbered(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    blocks = repeated_blocks(rows, length, gram, cell)
    joined = rows.join(blocks, "row", "left").select("document.doc_id", "text", "blocks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for part in chunks(batches, limit=CHUNK):
            texts = Texts(part)
            found = [
                (size, size - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept, start, end)
                for size, (start, end, kept) in zip(
                    texts.lengths.tolist(), kept_parts(texts, part.column("blocks"), length)
                )
            ]
            yield [part.column("doc_id"), *zip(*found)]

    return arrow_map(joined, cut, OUT)


def without_repeats(
    documents: DataFrame, length: int = LENGTH, gram: int = GRAM, cell: int = CELL
) -> DataFrame:
    """All documents with the repeated passages taken out of their texts, where characters
    cut in two go too. n_chars, if there is one, is counted again; other columns stay."""
    rows = numbered(documents)
    blocks = repeated_blocks(rows, length, gram, cell)
    joined = rows.join(blocks, "row", "left").drop("row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=CHUNK):
            left = [
                kept.decode("utf-8", "ignore")
                for _, _, kept in kept_parts(Texts(part), part.column("blocks"), length)
            ]
            given = part.column("text").is_null().to_pylist()
            texts = pa.array([None if gone else t for gone, t in zip(given, left)], pa.string())
            yield pa.RecordBatch.from_arrays([texts, part.column("document")], names=["text", "document"])

    ship(documents.sparkSession)
    kept = joined.mapInArrow(cut, joined.drop("blocks").schema)
    return restored(kept, documents, n_chars=F.length("text"))
