"""SimHash near-duplicates by an inverted index over byte positions.

A fingerprint has 64 bits, eight positional bytes. Two fingerprints that differ in at most
`distance` bits (2) share at least `8 - distance` of them (6): that is the guaranteed
minimum of the count filter. A posting list of one (position, byte) holds 1/256 of all
documents or more, and tallies over it would pair them all, so a posting here is keyed by
as many positional bytes as a pair must share: every choice of six positions (28 of
them) and the six bytes there. A pair reaches the minimum exactly if it meets in a
posting. All members of a posting differ in two bytes only, so a posting has at most
65,536 different fingerprints however many documents there are, and the partners of a
member are found by looking up the 136 other values of those two bytes that lie within
two bits, not by pairing.

A found pair is verified: the shared bytes are tallied and the differing bits counted.
Since only components are asked for, a posting hands on one link per member and
component within the posting; no link between different fingerprints is lost for that.
Documents of one fingerprint are one node. Components come from repeated rounds of
joins (every node and its smaller neighbours are linked to the smallest one), stored
after each round.

Words are runs of other than ASCII white space, A-Z lower-cased; shingles are three words
(fewer words: the whole sequence; no word: fingerprint zero, linked like any other).
Null texts count as empty. Repeated ids are separate rows with the same component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from trendgap.llm.batches import Texts, arrow_map, map_texts
from trendgap.llm.common import discard, numbered, restored, stored

POSITIONS = 8
DISTANCE = 2
SHINGLE = 3
SEED = 42
POSTINGS = list(combinations(range(POSITIONS), POSITIONS - DISTANCE))
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# Differences of two bytes (16 bits) of one or two bits.
NEAR = np.array(sorted({(1 << i) | (1 << j) for i in range(16) for j in range(16)}), np.uint32)


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    words = text.translate(LOWER).split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[: len(words) - size]]
    return [whole[a : b - 1] for a, b in zip(starts, ends[size - 1 :])]


def fingerprint(text: bytes) -> int:
    hashes = [xxhash.xxh64_intdigest(x, SEED) for x in shingles(text)]
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[i : i + (1 << 14)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a signed 64-bit number."""

    def mark(texts: Texts) -> dict[str, object]:
        found = np.array([fingerprint(t) for t in texts.each()], np.uint64).view(np.int64)
        return {"doc_id": texts.column("doc_id"), "mark": found}

    return map_texts(
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"),
        mark,
        "doc_id bigint, mark bigint",
    )


def postings(marks: DataFrame) -> DataFrame:
    """The 28 postings of every mark: which positions (`choice`) and their bytes, packed."""
    keys = []
    for number, chosen in enumerate(POSTINGS):
        mask = sum(0xFF << (8 * p) for p in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(
            F.struct(
                F.lit(number).cast("tinyint").alias("choice"),
                F.col("mark").bitwiseAND(F.lit(signed)).alias("bytes"),
            )
        )
    return marks.select("mark", F.explode(F.array(*keys)).alias("k")).select("k.*", "mark")


def links_within(choice: int, marks: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(mark, smaller mark of its component in this posting, shared bytes, bits apart),
    one row per mark but the smallest of each component."""
    free = [p for p in range(POSITIONS) if p not in POSTINGS[choice]]
    wide = marks.view(np.uint64)
    low = sum(
        ((wide >> np.uint64(8 * p)) & np.uint64(255)) << np.uint64(8 * i)
        for i, p in enumerate(free)
    ).astype(np.uint32)
    order = np.argsort(low)
    known = low[order]
    found = []
    for delta in NEAR:
        other = known ^ delta
        at = np.minimum(np.searchsorted(known, other), len(known) - 1)
        hit = np.flatnonzero((known[at] == other) & (at > np.arange(len(known))))
        found.append(np.stack((order[hit], order[at[hit]])))
    pairs = np.concatenate(found, axis=1)
    if not pairs.shape[1]:
        return []
    apart = np.bitwise_count(wide[pairs[0]] ^ wide[pairs[1]])
    differing = (wide[pairs[0]] ^ wide[pairs[1]]).view(np.uint8).reshape(-1, POSITIONS)
    shared = (differing == 0).sum(1)
    keep = (shared >= POSITIONS - DISTANCE) & (apart <= DISTANCE)
    out, parent = [], list(range(len(marks)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, same, bits in zip(*pairs[:, keep].tolist(), shared[keep].tolist(), apart[keep].tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(marks[a]), int(marks[b]), same, bits))
    return out


def links(marks: DataFrame) -> DataFrame:
    """Verified links between different marks that join all marks within the distance."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            rows: list[tuple] = []
            for choice, members in zip(batch.column("choice").to_pylist(), batch.column("marks")):
                rows += links_within(choice, np.asarray(members.values))
            yield list(zip(*rows)) or [[], [], [], []]

    lists = (
        postings(marks)
        .groupBy("choice", "bytes")
        .agg(F.collect_list("mark").alias("marks"))
        .where(F.size("marks") > 1)
        .select("choice", "marks")
    )
    return arrow_map(lists, verify, "a bigint, b bigint, shared_bytes int, bits_apart int")


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node that it is connected to, for edges (a, b).

    Each round links every node to the smallest of its neighbourhood, first the larger
    neighbours (large star), then the smaller ones (small star); the number of rounds
    grows with the logarithm of the longest chain. Rounds are stored, so a lost executor
    costs one round at most. It ends when a round changes nothing.
    """
    now = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    signature = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        before, large = now, stored(large, "large-star")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(smallest, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(smallest.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = stored(small, "small-star")
        discard(before, large)
        # A round that leaves the same set of edges is the last one.
        was, signature = signature, now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if was == signature:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    marks = stored(fingerprints(documents), "fingerprints")
    distinct = marks.groupBy("mark").agg(F.min("doc_id").alias("first_id"))
    distinct = stored(distinct, "marks")
    found = components(links(distinct.select("mark")))
    roots = distinct.join(found, distinct["mark"] == found["node"], "left").select(
        "mark", "first_id", F.coalesce("root", "mark").alias("root")
    )
    ids = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = roots.join(ids, "root").select("mark", "component_id")
    return marks.join(classes, "mark").select(
        "doc_id",
        F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """One document of each component, all columns unchanged: the one with the smallest
    doc_id (null ids last); of repeated ids any one."""
    rows = numbered(documents)
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
    doc_id = F.col("document.doc_id")
    places = rows.select("row", F.struct(doc_id.isNull(), doc_id, "row").alias("place"))
    kept = (
        found.select(F.col("doc_id").alias("row"), "component_id")
        .join(places, "row")
        .groupBy("component_id")
        .agg(F.min("place").alias("place"))
        .select(F.col("place.row").alias("row"))
    )
    return restored(rows.join(stored(kept, "kept-rows"), "row", "left_semi"), documents)
