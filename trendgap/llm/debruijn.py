"""Substring dedup on a De Bruijn graph: words inside a window of `size` (13) words go if the
same window also starts in a document with a smaller id.

A window is an edge of the graph: it leads from its first twelve words to its last twelve.
Only edges that occur twice are of interest, and edges that are always met one after the
other are one path, so the graph is built in three steps:

1. Edges with one minimizer. The anchor of a window is its group of `gram` (6) words with
   the smallest hash; it depends on the window alone. Successive windows with one anchor
   are a path without branches as far as their text goes, and travel as one row (`inner`:
   hash of the anchor, `outer`: hash of all words of the path). An anchor met once holds
   no repeated edge. An anchor with one `outer` is one repeated path. Of all others, each
   different path is cut once into single edges, and those are counted.
2. Compaction. Of two repeated edges or paths that follow each other in a document, the
   link is counted too. If it is met as often as either of them, then no occurrence of one
   is without the other: the node between them does not branch (the end of a document
   counts as a branch), and a join of the links back to the occurrences merges them. What
   is left in a document are the longest spans that always occur whole.
3. Verification. The words of every span are read at their coordinates in the source and
   hashed anew (128 bits). Spans with one digest have one smallest doc_id; occurrences in
   documents with a larger one are removed.

Counts are combined before each shuffle. A path of a third of all documents is one row of
the counts; the rows of its occurrences meet that in joins whose skewed side Spark splits.

Null texts have no words. A null doc_id is neither smaller nor larger than another: such
rows lose nothing and make no other row lose. Rows of one id are separate rows; they do
not make each other lose. Very long texts are never cut: a task holds about a hundred bytes
a word of its longest text. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from trendgap.llm.batches import Texts, arrow_map, chunks, mixed
from trendgap.llm.common import discard, numbered, stored
from trendgap.llm.suffixes import BASES, Hashes, powers, sliding_min, unpacked

SIZE = 13
GRAM = 6
CHUNK = 1 << 19
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of a chunk: their hashes in one sequence, and where each text begins in it."""

    def __init__(self, texts: Texts) -> None:
        inside = ~BLANKS[texts.bytes]
        edge = np.zeros(len(inside) + 1, bool)
        edge[texts.starts] = True  # a word ends with its text
        before = np.append(False, inside[:-1]) if len(inside) else inside
        after = np.append(inside[1:], False) if len(inside) else inside
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(starts, texts.starts)
        hashes = Hashes(texts.bytes)
        n = len(starts) + 1
        self.powers, self.sums = [], []
        for which, base in enumerate(BASES):
            sums = np.zeros(n, np.uint64)
            np.cumsum(hashes.of(starts, ends, which) * powers(pow(base, -1, 1 << 64), n - 1), out=sums[1:])
            self.powers.append(powers(base, n))
            self.sums.append(sums)

    def of(self, first: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Hash of the words first..end-1 for many ranges at once."""
        sums = self.sums[which]
        return mixed((sums[end] - sums[first]) * self.powers[which][first])

    def paths(self, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first window, last window) of every run of windows with one anchor."""
        n = int(self.bounds[-1])
        place, ends = np.arange(n), np.repeat(self.bounds[1:], np.diff(self.bounds))
        starts = np.flatnonzero(place + gram <= ends)
        key = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        key[starts] = self.of(starts, starts + gram, 0)
        key = (key & ~np.uint64(0xFFFFFFFF)) | place.astype(np.uint64)
        windows = np.flatnonzero(place + size <= ends)
        if not len(windows):
            return windows, windows, windows
        least = sliding_min(key, size - gram + 1)[windows]
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begins = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        lasts = np.append(begins[1:], len(windows)) - 1
        return anchor[begins], windows[begins], windows[lasts]


PATH = "inner bigint, outer bigint, row bigint, place bigint"


def paths(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """Edges with one anchor as one row each. `place` packs the first window of the text,
    how far the anchor is from it, and how far the last window is."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for part in chunks(batches, limit=CHUNK):
            words = Words(Texts(part))
            anchor, first, last = words.paths(size, gram)
            text = np.searchsorted(words.bounds, first, side="right") - 1
            lies = mixed(((anchor - first) << 8 | (last - first)).astype(np.uint64) + np.uint64(1))
            yield [
                words.of(anchor, anchor + gram, 0).view(np.int64),
                (words.of(first, last + size, 1) ^ lies).view(np.int64),
                np.asarray(part.column("row"))[text],
                ((first - words.bounds[text]) << 32) | ((anchor - first) << 16) | (last - first),
            ]

    return arrow_map(rows.select("row", "text"), emit, PATH)


def single_edges(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Every window of the wanted paths (inner, outer, row, place, n): its hash (a, b), that of
    it and one more word (link, check; null at the end of the path), which path it is from,
    how far into it, and how often that path occurs."""
    lists = wanted.groupBy("row").agg(
        F.collect_list(F.struct("place", "inner", "outer", "n")).alias("paths")
    )  # of one text

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for part in chunks(batches, limit=CHUNK):
            words = Words(Texts(part))
            lists = part.column("paths")
            text = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(lists)))
            path = lists.flatten()
            place, inner, outer, n = (np.asarray(path.field(f)) for f in ("place", "inner", "outer", "n"))
            _, first, last = unpacked(place)
            count = last - first + 1
            of = np.repeat(np.arange(len(first)), count)
            step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            at = first[of] + step + words.bounds[text[of]]
            last = step + 1 == count[of]
            more = np.where(last, at + size, at + size + 1)
            yield [
                words.of(at, at + size, 0).view(np.int64), words.of(at, at + size, 1).view(np.int64),
                pa.array(words.of(at, more, 0).view(np.int64), mask=last),
                pa.array(words.of(at, more, 1).view(np.int64), mask=last),
                inner[of], outer[of], step, n[of],
            ]

    joined = rows.select("row", "text").join(lists, "row")
    return arrow_map(
        joined, emit,
        "a bigint, b bigint, link bigint, check bigint, inner bigint, outer bigint, step int, n bigint",
    )


def paths_between_branches(edges: DataFrame) -> DataFrame:
    """inner, outer, and the repeated windows of that path as an array of (step, windows, a, b,
    total): successive windows are one where neither ever occurs without the other."""
    often = edges.groupBy("a", "b").agg(F.sum("n").alias("total")).where("total > 1")
    links = (
        edges.where("link IS NOT NULL").groupBy("link", "check").agg(F.sum("n").alias("linked")).where("linked > 1")
    )
    # Stored, so that the joins get exchanges of their own, whose hot keys Spark can split.
    often, links = stored(often, "often"), stored(links, "often-linked")
    known = edges.join(often.hint("shuffle_hash"), ["a", "b"])
    lists = (
        known.join(links.hint("shuffle_hash"), ["link", "check"], "left")
        .groupBy("inner", "outer")
        .agg(F.collect_list(F.struct("step", "a", "b", "total", "linked")).alias("edges"))
    )  # of one path: at most size - gram + 1

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for part in batches:
            lists = part.column("edges")
            of = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(lists)))
            edge = lists.flatten()
            linked = np.asarray(edge.field("linked").fill_null(0))
            step, a, b, total = (np.asarray(edge.field(f)) for f in ("step", "a", "b", "total"))
            order = np.lexsort((step, of))
            of, step, a, b, total, linked = (x[order] for x in (of, step, a, b, total, linked))
            plain = np.append(False, (
                (of[1:] == of[:-1]) & (step[1:] == step[:-1] + 1)
                & (total[1:] == total[:-1]) & (linked[:-1] == total[1:])
            )) if len(of) else np.zeros(0, bool)
            begins = np.flatnonzero(~plain)
            windows = np.diff(np.append(begins, len(of)))
            bounds = np.searchsorted(of[begins], np.arange(part.num_rows + 1))
            merged = pa.StructArray.from_arrays(
                [pa.array(step[begins]), pa.array(windows.astype(np.int32)), *map(pa.array, (a[begins], b[begins], total[begins]))],
                ["step", "windows", "a", "b", "total"],
            )
            yield [
                part.column("inner"), part.column("outer"),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), merged),
            ]

    return arrow_map(
        lists, merge,
        "inner bigint, outer bigint, edges array<struct<step:int,windows:int,a:bigint,b:bigint,total:bigint>>",
    )


def repeated_edges(rows: DataFrame, size: int, gram: int) -> tuple[DataFrame, list[DataFrame]]:
    """row, first (window), windows, a, b (identity of the edge or path), n (how often it
    occurs) for every occurrence of what occurs more than once; no two of a row overlap.
    Also the stored frames that it reads."""
    found = paths(rows, size, gram)  # cheap to make again, and large to keep
    anchors = found.groupBy("inner").agg(
        F.count("*").alias("n"), F.min("outer").alias("low"), F.max("outer").alias("high")
    )
    anchors = stored(
        anchors.where("n > 1").select("inner", "n", F.expr("low = high").alias("whole")), "anchors"
    )
    met = stored(found.join(anchors.hint("shuffle_hash"), "inner"), "met-paths")
    discard(anchors)
    several = met.where("NOT whole").drop("whole", "n")
    different = several.groupBy("inner", "outer").agg(
        F.count("*").alias("n"), F.first("row").alias("row"), F.first("place").alias("place")
    )
    edges = stored(single_edges(rows, different, size), "single-edges")
    lists = stored(paths_between_branches(edges), "edges-of-paths")
    discard(edges)
    first = F.expr("cast(shiftright(place, 32) as int)")
    whole = met.where("whole").select(
        "row", first.alias("first"), F.expr("cast(place & 65535 as int) + 1").alias("windows"),
        F.col("inner").alias("a"), F.col("outer").alias("b"), "n",
    )
    parts = (
        several.join(lists.hint("shuffle_hash"), ["inner", "outer"])
        .select("row", first.alias("first"), F.explode("edges").alias("e"))
        .select(
            "row", (F.col("first") + F.col("e.step")).alias("first"), "e.windows",
            "e.a", "e.b", F.col("e.total").alias("n"),
        )
    )
    return whole.unionByName(parts), [met, lists]


def compacted(edges: DataFrame, read: list[DataFrame]) -> DataFrame:
    """row and its edges as an array of (first, windows, inside): `inside` says that it
    belongs to one path with the edge before it. Discards what the edges are read from."""
    order = Window.partitionBy("row").orderBy("first")
    follows = (F.lag(F.expr("first + windows")).over(order) == F.col("first")) & (
        F.lag("n").over(order) == F.col("n")
    )
    linked = edges.select(
        "row", "first", "windows", "n",
        F.when(follows, F.xxhash64(F.lag("a").over(order), "a")).alias("link"),
        F.when(follows, F.xxhash64(F.lag("b").over(order), "b")).alias("check"),
    )
    linked = stored(linked, "linked-edges")
    discard(*read)
    tested = linked.where("link IS NOT NULL")
    plain = (
        tested.groupBy("link", "check")
        .agg(F.count("*").alias("met"), F.min("n").alias("n"))
        .where("met = n")
        .select("link", "check")
    )
    plain = stored(plain, "plain-links")
    inside = tested.join(plain.hint("shuffle_hash"), ["link", "check"]).select(
        "row", "first", "windows", F.lit(True).alias("inside")
    )
    inside = stored(inside, "inside-edges")
    # The same edges once more, not marked; where both are met the mark counts.
    every = linked.select("row", "first", "windows", F.lit(False).alias("inside")).union(inside)
    return every.groupBy("row").agg(
        F.collect_list(F.struct("first", "windows", "inside")).alias("edges")
    )  # of one text


def spans_of(edges: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of the paths that a row's edges make up."""
    first, windows = np.asarray(edges.field("first")), np.asarray(edges.field("windows"))
    inside = np.asarray(edges.field("inside").cast(pa.int8())).astype(bool)
    joined = first[inside]
    first, windows = first[~inside], windows[~inside]
    order = np.argsort(first)
    first, windows = first[order], windows[order]
    begins = np.flatnonzero(~np.isin(first, joined, assume_unique=True))
    return first[begins], np.add.reduceat(windows, begins) if len(begins) else begins


def normal(text: bytes) -> tuple[bytes, list[int], list[int]]:
    """The words of a text with one space between them; where each begins and ends."""
    words = text.split()
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist() if words else []
    return b" ".join(words), [0, *(e + 1 for e in ends[:-1])], ends


def sources(rows: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """row and what is removed of it, as an array of (first word, end, source): spans that
    also occur in a document with a smaller id, `source` being the smallest one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for part in chunks(batches, limit=CHUNK):
            columns: list[list] = [[], [], [], [], [], []]
            lists = part.column("edges")
            for text, row, doc_id, own in zip(
                Texts(part).each(), part.column("row").to_pylist(), part.column("doc_id").to_pylist(), lists
            ):
                first, windows = spans_of(own.values)
                end = first + windows + size - 1
                line, begins, ends = normal(text)
                for a, b in zip(first.tolist(), end.tolist()):
                    digest = xxhash.xxh3_128_intdigest(line[begins[a] : ends[b - 1]])
                    values = (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63), row, doc_id, a, b
                    for column, value in zip(columns, values):
                        column.append(value)
            yield columns

    given = rows.select("row", "document.doc_id", "text").join(edges, "row")
    found = arrow_map(
        given, read, "digest bigint, check bigint, row bigint, doc_id bigint, first int, end int"
    )
    found = stored(found, "spans")
    smallest = found.groupBy("digest", "check").agg(
        F.min("doc_id").alias("source"), F.max("doc_id").alias("largest")
    )
    # Stored, so that the join gets exchanges of its own, whose hot keys Spark can split.
    smallest = stored(smallest.where("source < largest").drop("largest"), "sources")
    return (
        found.join(smallest.hint("shuffle_hash"), ["digest", "check"])
        .where("doc_id > source")
        .groupBy("row")
        .agg(F.collect_list(F.struct("first", "end", "source")).alias("spans"))
    )


OUT = (
    "doc_id bigint, n_words bigint, n_removed bigint, kept string, "
    "spans array<struct<first:int,end:int,source:bigint>>"
)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for part in chunks(batches, limit=CHUNK):
        totals, removed, kept, spans = [], [], [], part.column("spans")
        for text, own in zip(Texts(part).each(), spans):
            words = text.split()
            totals.append(len(words))
            if not own.is_valid:
                removed.append(0)
                kept.append(b" ".join(words).decode())
                continue
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, np.asarray(own.values.field("first")), 1)
            np.add.at(edges, np.asarray(own.values.field("end")), -1)
            gone = np.cumsum(edges)[:-1] > 0
            removed.append(int(gone.sum()))
            kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
        yield [part.column("doc_id"), totals, removed, kept, spans]


def remove_repeated_spans(documents: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Columns as in OUT for every row: its words, how many of them go, those that stay with
    one space between them, and the removed spans in words with the id of their source
    (spans may overlap)."""
    if not 1 <= gram <= size < 256:
        raise ValueError("windows hold at most 255 words, and at least the words of a gram")
    rows = numbered(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    found = stored(sources(rows, compacted(*repeated_edges(rows, size, gram)), size), "removed-spans")
    return arrow_map(
        rows.join(found, "row", "left").select("document.doc_id", "text", "spans"), cut, OUT
    )
