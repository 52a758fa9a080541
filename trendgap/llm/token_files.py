"""Token ids in binary files, and reading them back.

A document is tokenised where it is read; its ids travel as bytes to the task of its key
range, which writes one file per range, documents in ascending order of doc_id, null ids
first, repeated ids by the bytes of their tokens. A file is a row of blocks, each
self-contained:

    magic "TIDS", documents, tokens, ranked ids, data bytes    4 bytes + 4 x uint32
    doc_ids (int64), null flags (uint8), lengths (uint32)      one per document
    ids by falling frequency in this block                     uint32 each
    control bytes                                              two bits per token
    data bytes

A token is stored as the rank of its id in 1 to 4 bytes; its control bits say how many
less one. Frequent ids have small ranks and so take one byte. Four tokens share a control
byte. Decoding looks each control byte up in a table of four lengths, finds the places of
all tokens with one running sum, and gathers the bytes; no loop over tokens.

A file is written under a temporary name and moved, so a repeated task replaces its own
file by the same bytes. Null and empty texts hold the end id alone.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trendgap.llm.batches import Texts, arrow_map, chunks, row_sums
from trendgap.llm.order import bucket_bounds, bucket_of

HEAD = struct.Struct("<4s4I")
MAGIC = b"TIDS"
BLOCK_TOKENS = 1 << 20
MAX_UNITS = 600_000  # units kept per worker with their ids
END_ID = 2

# For each control byte the lengths of its four tokens.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_block(doc_ids: list[int | None], tokens: list[np.ndarray]) -> bytes:
    """One block of whole documents; `tokens` are uint32 arrays."""
    flat = np.concatenate([np.zeros(0, np.uint32), *tokens])
    counts = np.bincount(flat)
    ids = np.flatnonzero(counts)
    order = np.lexsort((ids, -counts[ids]))
    rank_of = np.zeros(len(counts), "<u4")
    rank_of[ids[order]] = np.arange(len(ids))
    ranks = rank_of[flat]
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    bits = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    bits[: len(ranks)] = sizes - 1
    control = (bits.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    kept = np.arange(4) < sizes[:, None]
    data = ranks.view(np.uint8).reshape(-1, 4)[kept]
    return b"".join(
        (
            HEAD.pack(MAGIC, len(tokens), len(flat), len(ids), len(data)),
            np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
            np.array([i is None for i in doc_ids], np.uint8).tobytes(),
            np.array([len(t) for t in tokens], "<u4").tobytes(),
            ids[order].astype("<u4").tobytes(),
            control.tobytes(),
            data.tobytes(),
        )
    )


def decode_file(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, lengths, all ids) of every block."""
    at = 0

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(content, kind, count, at)
        at += found.nbytes
        return found

    while at < len(content):
        magic, documents, tokens, ranked, size = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at += HEAD.size
        keys, missing = take(documents, "<i8"), take(documents, "u1")
        lengths = take(documents, "<u4").astype(np.int64)
        ids = take(ranked, "<u4")
        control, data = take(-(-tokens // 4), "u1"), take(size, "u1")
        sizes = LENGTHS[control].reshape(-1)[:tokens]
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        ranks = np.zeros(tokens, np.uint32)
        for byte in range(4):
            has = sizes > byte
            if not has.any():
                break
            ranks[has] |= data[starts[has] + byte].astype(np.uint32) << np.uint32(8 * byte)
        doc_ids = [None if gone else k for k, gone in zip(keys.tolist(), missing.tolist())]
        yield doc_ids, lengths, ids[ranks]


class Tokenizer:
    """A tokenizers model with the ids of the units met so far.

    The model lower-cases a text, drops white space and cuts the rest into units (letters,
    single digits, other signs) that it encodes one by one. A word is what stands between
    ASCII white space. Words of ASCII and Latin-1 letters, digits and signs are cut here,
    for a whole chunk at once, and each distinct unit is given to the model once. Any
    other word is one unit that goes through the whole model: with an apostrophe (its
    pattern has endings like 's), with < (special strings), or with other characters.
    """

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer as Model
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = Model.from_str(model)
        if any("<" not in t.content for t in self.model.get_added_tokens_decoder().values()):
            raise ValueError("special strings without < are not supported")
        self.kind = "<u4" if self.model.get_vocab_size() > 0x10000 else "<u2"
        self.units: dict[str, bytes] = {}
        # The characters that stand for the bytes of each plain character.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        plain = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0x100))]
        self.signs = {ord(c): level.pre_tokenize_str(c)[0][0] for c in plain}

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def encode(self, unit: str) -> bytes:
        if PLAIN(unit):
            return self.packed([t.id for t in self.model.model.tokenize(unit.translate(self.signs))])
        return self.packed(self.model.encode(unit, add_special_tokens=False).ids)

    def ids(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk in order, and how many each text has."""
        data = texts.bytes
        kinds = KIND[data]
        # The second byte of a Latin-1 letter (not the signs × and ÷) after its first one.
        lead = data == 0xC3
        second = np.zeros(len(data), bool)
        second[1:] = lead[:-1] & (data[1:] != 0x97) & (data[1:] != 0xB7)
        kinds[second] = LETTER
        kinds[lead & ~np.append(second[1:], False)] = OTHER
        first = np.zeros(len(data) + 1, bool)
        first[texts.starts] = True
        first = first[:-1]
        # Words that hold any other byte become one unit.
        edge = first | (kinds == SPACE)
        edge[1:] |= kinds[:-1] == SPACE
        words = np.append(np.flatnonzero(edge), len(data))
        hard = row_sums(kinds == OTHER, words) > 0
        if hard.any():
            kinds[np.repeat(hard, np.diff(words))] = OTHER
        begins = first | (kinds == DIGIT)
        begins[1:] |= kinds[1:] != kinds[:-1]
        solid = kinds != SPACE
        begins &= solid
        small = np.where(kinds == OTHER, data, SMALL[data])
        small[second & (kinds == LETTER) & (data < 0x9F)] += 0x20
        kept = small[solid]
        offsets = np.append(np.flatnonzero(begins[solid]), len(kept)).astype(np.int32)
        units = pa.StringArray.from_buffers(
            len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(kept)
        ).dictionary_encode()
        if len(self.units) > MAX_UNITS:
            self.units.clear()
        known, parts = self.units, []
        for unit in units.dictionary.to_pylist():
            found = known.get(unit)
            if found is None:
                found = known[unit] = self.encode(unit)
            parts.append(found)
        table = np.frombuffer(b"".join(parts), self.kind)
        sizes = np.array([len(x) for x in parts], np.int64) // table.itemsize
        firsts = np.cumsum(sizes) - sizes
        which = np.asarray(units.indices)
        size = sizes[which]
        at = np.repeat(firsts[which] - np.cumsum(size) + size, size)
        at += np.arange(len(at))
        per_text = np.append(0, np.cumsum(row_sums(begins, texts.starts)))
        return table[at], row_sums(size, per_text)


SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[[ord("'"), ord("<")]] = OTHER
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[ord("A") : ord("Z") + 1] = KIND[ord("a") : ord("z") + 1] = LETTER
KIND[0xC3] = LETTER
SMALL = np.arange(256, dtype=np.uint8)
SMALL[ord("A") : ord("Z") + 1] += 32
PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+").fullmatch


_KEPT: dict[int, Tokenizer] = {}


def tokenizer(model: str) -> Tokenizer:
    """One per Python worker and model."""
    key = hash(model)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Tokenizer(model)
    return _KEPT[key]


def tokenised(documents: DataFrame, model: str, bounds: np.ndarray) -> DataFrame:
    """bucket, doc_id and ids of every document, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        own = tokenizer(model)
        end = own.packed([END_ID])
        for part in chunks(batches):
            keys = part.column("doc_id")
            buckets = bucket_of(
                keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False), bounds
            )
            ids, sizes = own.ids(Texts(part))
            raw = ids.tobytes()
            ends = (np.cumsum(sizes) * ids.itemsize).tolist()
            yield [buckets, keys, [raw[a:b] + end for a, b in zip([0, *ends], ends)]]

    return arrow_map(
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"),
        run,
        "bucket int, doc_id bigint, ids binary",
    )


def write_token_files(documents: DataFrame, model: str, folder: str) -> DataFrame:
    """Write the files of all documents; one row per file: bucket, path, tokens.

    `folder` must be one that every executor can reach.
    """
    bounds = bucket_bounds(documents, "doc_id")
    ordered = (
        tokenised(documents, model, bounds)
        .repartition(len(bounds) + 2, "bucket")
        .sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "ids")
    )
    kind = tokenizer(model).kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        rows = (
            row
            for batch in batches
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "ids")))
        )
        for bucket, own in groupby(rows, key=lambda r: r[0]):
            draft = f"{base}/.{bucket}-{uuid.uuid4().hex}"
            total = 0
            with store.open_output_stream(draft) as out:
                keys: list[int | None] = []
                parts: list[np.ndarray] = []
                held = 0
                for _, key, ids in own:
                    keys.append(key)
                    parts.append(np.frombuffer(ids, kind).astype(np.uint32))
                    held += len(parts[-1])
                    if held >= BLOCK_TOKENS:
                        out.write(encode_block(keys, parts))
                        total, held, keys, parts = total + held, 0, [], []
                if parts:
                    out.write(encode_block(keys, parts))
                    total += held
            store.move(draft, f"{base}/{bucket:06d}.tids")
            yield [[bucket], [f"{bucket:06d}.tids"], [total]]

    return arrow_map(ordered, run, "bucket int, file string, n_tokens bigint")


OUT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone.

    `files` are the rows of `write_token_files`, one per file, already stored.
    """
    spark = files.sparkSession
    # One row per key range, at most order.MAX_BUCKETS.
    sizes = {r["bucket"]: r["n_tokens"] for r in files.collect()}
    if not sizes:
        return spark.createDataFrame([], OUT)
    starts, total = {}, 0
    for bucket in sorted(sizes):
        starts[bucket] = total
        total += sizes[bucket]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            for path, content in zip(
                batch.column("path").to_pylist(), batch.column("content")
            ):
                at = starts[int(path.rpartition("/")[2].partition(".")[0])]
                for doc_ids, lengths, ids in decode_file(content.as_py()):
                    ends = np.cumsum(lengths)
                    raw = ids.astype("<u4").tobytes()
                    sums = [
                        zlib.crc32(raw[4 * (e - n) : 4 * e])
                        for e, n in zip(ends.tolist(), lengths.tolist())
                    ]
                    yield [doc_ids, ends - lengths + at, lengths, sums]
                    at += int(lengths.sum())

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tids").load(folder)
    return arrow_map(found.select("path", "content"), run, OUT)
