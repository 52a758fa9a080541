"""Benchmark decontamination with spaced seeds.

Texts are sequences of words (runs of ASCII letters and digits and of characters beyond
ASCII, A-Z lower-cased). A document is contaminated by a benchmark item if somewhere the
two agree, word by word without gaps, in at least `WINDOW - SUBSTITUTIONS` (10) of
`WINDOW` (12) words; items of fewer words must stand in the document whole.

Candidates come from seeds: the words at six places of a fixed mask, hashed together, at
every place of both sides. The masks are made of blocks of three words, two of the four
blocks of a window each; two substitutions can touch two blocks, so two untouched ones
remain and one of the masks meets them: no overlap is missed. Hits are verified along
their diagonal: all windows over the item are counted, whatever the seed was.

The benchmark is the stated query set. Its seeds are looked up in blocks of bounded size
(`block_words`), each a sorted array that goes to every task; documents are not shuffled.
Several rows with one item_id are separate items. Null and empty texts on either side meet
nothing, and neither does an item without a word. Null ids are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trendgap.llm.batches import MIX, Texts, arrow_map, chunks, keep_rows, mixed, row_sums
from trendgap.llm.licenses import WORDS
from trendgap.llm.suffixes import Hashes

WINDOW = 12
SUBSTITUTIONS = 2
# 1 is a place that counts; blocks of three, two at a time.
MASKS = ("111111", "111000111", "111000000111")
BLOCK_WORDS = 200_000
FILTER_BITS = 20

PLAIN = np.frombuffer(WORDS, np.uint8)


def word_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words begin."""
    data = PLAIN[texts.bytes]
    solid = data != 0x20
    first = np.zeros(len(data) + 1, bool)
    first[texts.starts] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:-1]
    words = Hashes(data, 1).of(np.flatnonzero(begin), np.flatnonzero(end) + 1, 0)
    return words, np.append(0, np.cumsum(row_sums(begin, texts.starts)))


def seeds(words: np.ndarray, bounds: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of a mask at every place where it fits into its text."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero(np.arange(len(words)) + len(mask) <= ends)
    total = np.full(len(at), len(mask), np.uint64)
    for offset, sign in enumerate(mask):
        if sign == "1":
            total = (total ^ words[at + offset]) * MIX
            total ^= total >> np.uint64(31)
    return mixed(total), at


class Block:
    """Items with their words, and all their seeds sorted by hash."""

    def __init__(self, item_ids: list, texts: list[str]) -> None:
        self.item_ids = item_ids
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        self.words, self.bounds = word_hashes(Texts(batch))
        sizes = np.diff(self.bounds)
        self.masks = list(MASKS)
        self.masks += ["1" * int(n) for n in np.unique(sizes[(sizes > 0) & (sizes < WINDOW)])]
        item = np.repeat(np.arange(len(sizes)), sizes)
        hashes, places = [], []
        for mask in self.masks:
            found, at = seeds(self.words, self.bounds, mask)
            own = sizes[item[at]]
            # Long items by the masks of a window, short ones by the mask of their length.
            keep = own >= WINDOW if mask in MASKS else own == len(mask)
            if mask in MASKS and len(mask) < WINDOW and set(mask) == {"1"}:
                keep = (own >= WINDOW) | (own == len(mask))
            hashes.append(found[keep])
            places.append(at[keep])
        order = np.argsort(np.concatenate(hashes), kind="stable")
        self.hashes = np.concatenate(hashes)[order]
        self.places = np.concatenate(places)[order]
        self.item = item
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the documents, place in the items) of equal seeds."""
        left, right = [], []
        for mask in dict.fromkeys(self.masks):
            found, at = seeds(words, bounds, mask)
            maybe = self.filter[found >> np.uint64(64 - FILTER_BITS)]
            found, at = found[maybe], at[maybe]
            low = np.searchsorted(self.hashes, found, side="left")
            count = np.searchsorted(self.hashes, found, side="right") - low
            left.append(np.repeat(at, count))
            skipped = np.cumsum(count) - count
            right.append(self.places[np.repeat(low - skipped, count) + np.arange(count.sum())])
        return np.concatenate(left), np.concatenate(right)

    def overlaps(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple]:
        """(text, item, agreeing words, first word, last word) of verified overlaps, the
        best diagonal of each text and item."""
        left, right = self.hits(words, bounds)
        if not len(left):
            return []
        text = np.searchsorted(bounds, left, side="right") - 1
        item = self.item[right]
        start = left - bounds[text] - (right - self.bounds[item])
        best: dict[tuple[int, int], tuple] = {}
        for t, i, shift in np.unique(np.stack((text, item, start), 1), axis=0).tolist():
            own = self.words[self.bounds[i] : self.bounds[i + 1]]
            there = words[bounds[t] : bounds[t + 1]]
            begin, end = max(0, -shift), min(len(own), len(there) - shift)
            same = own[begin:end] == there[begin + shift : end + shift]
            width = min(WINDOW, len(own))
            need = width - SUBSTITUTIONS if width == WINDOW else width
            if len(same) < width:
                continue
            total = np.append(0, np.cumsum(same))
            good = np.flatnonzero(total[width:] - total[:-width] >= need)
            if not len(good):
                continue
            covered = np.zeros(len(same), bool)
            for k in good:
                covered[k : k + width] = True
            agreeing = int((same & covered).sum())
            span = (begin + shift + int(good[0]), begin + shift + int(good[-1]) + width - 1)
            row = (agreeing, -span[0], span[1])
            if row > best.get((t, i), (0,)):
                best[t, i] = row
        return [(t, i, n, -a, b) for (t, i), (n, a, b) in best.items()]


OUT = (
    "doc_id bigint, item_id bigint, agreeing_words int, item_words int, overlap double, "
    "first_word int, last_word int"
)


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of about `block_words` words."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(
        "text IS NOT NULL"
    )
    size = items.agg(F.sum(F.size(F.split("text", "[^A-Za-z0-9]+")))).first()[0] or 0
    count = size // block_words + 1
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        rows = items.where(number == k).orderBy("item_id", "text").collect()
        if rows:
            yield Block([r["item_id"] for r in rows], [r["text"] for r in rows])


def contaminated(
    documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """A row for every document and benchmark item that overlap; columns as in OUT."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def look(block: Block) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)  # bounded by block_words

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
            known = sent.value
            for part in chunks(batches):
                words, bounds = word_hashes(Texts(part))
                found = known.overlaps(words, bounds)
                if not found:
                    continue
                texts, items, agreeing, first, last = map(list, zip(*found))
                sizes = np.diff(known.bounds)[items]
                yield [
                    part.column("doc_id").take(pa.array(texts)),
                    [known.item_ids[i] for i in items],
                    agreeing, sizes, np.array(agreeing) / sizes, first, last,
                ]

        return arrow_map(rows, emit, OUT)

    found = None
    for block in blocks(benchmark, block_words):
        one = look(block)
        found = one if found is None else found.union(one)
    return spark.createDataFrame([], OUT) if found is None else found


def clean(documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, unchanged, that overlap no benchmark item."""

    def without(frame: DataFrame, block: Block) -> DataFrame:
        sent = frame.sparkSession.sparkContext.broadcast(block)  # bounded by block_words

        def wanted(texts: Texts) -> np.ndarray:
            keep = np.ones(len(texts), bool)
            keep[[t for t, *_ in sent.value.overlaps(*word_hashes(texts))]] = False
            return keep

        return keep_rows(frame, wanted)

    for block in blocks(benchmark, block_words):
        documents = without(documents, block)
    return documents
