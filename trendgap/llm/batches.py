"""Texts as numpy arrays inside Spark tasks.

An operator maps over Arrow batches. A batch holds up to 10,000 rows, so it is cut into
chunks of a few megabytes first; a single text is never cut. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from trendgap.llm.common import ship

CHUNK_BYTES = 1 << 20


class Texts:
    """One chunk: the bytes of all its texts in one array, and where each begins."""

    def __init__(self, batch: pa.RecordBatch, column: str = "text") -> None:
        self.batch = batch
        texts = batch.column(column).cast(pa.string()).fill_null("")
        n, at = len(texts), texts.offset
        _, offsets, data = texts.buffers()
        bounds = (
            np.frombuffer(offsets, np.int32)[at : at + n + 1].astype(np.int64)
            if n
            else np.zeros(1, np.int64)
        )
        raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        self.bytes = raw[bounds[0] : bounds[-1]]
        self.starts = bounds - bounds[0]

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def column(self, name: str) -> pa.Array:
        return self.batch.column(name)

    def each(self) -> Iterator[bytes]:
        """Every text as UTF-8 bytes."""
        whole = self.bytes.tobytes()
        bounds = self.starts.tolist()
        return (whole[a:b] for a, b in zip(bounds, bounds[1:]))

    def row_of_byte(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.lengths)


def chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, at least one row each."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)) + 64
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Spark keeps the worker, and
    what it holds would stand beside the memory of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # the GNU C library has it
        trim(0)


def map_texts(
    frame: DataFrame,
    per_chunk: Callable[[Texts], dict[str, object]],
    schema: str,
    column: str = "text",
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """Apply a function of a chunk that returns its output columns by name."""
    ship(frame.sparkSession)
    typed = frame.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(typed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, column, limit):
            columns = per_chunk(Texts(part, column))
            yield pa.RecordBatch.from_arrays(
                [as_array(columns[f.name], f.type) for f in arrow], schema=arrow
            )

    return frame.mapInArrow(run, typed)


def arrow_map(
    frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: str
) -> DataFrame:
    """mapInArrow for a generator that yields lists of columns."""
    ship(frame.sparkSession)
    typed = frame.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(typed)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(parts):
            yield pa.RecordBatch.from_arrays(
                [as_array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
            )

    return frame.mapInArrow(batches, typed)


def keep_rows(frame: DataFrame, wanted: Callable[[Texts], np.ndarray]) -> DataFrame:
    """The rows, all columns unchanged, for which a function of a chunk says so."""
    ship(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            yield part.filter(pa.array(wanted(Texts(part))))

    return frame.mapInArrow(run, frame.schema)


def as_array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values.cast(kind)
    return pa.array(values, type=kind)


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values[starts[i]:starts[i + 1]] for every i, zero for empty ranges.

    Whole numbers stay exact; for floats the running total costs a few last digits, so
    those are added range by range.
    """
    if values.dtype.kind in "iub":
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[starts[1:]] - total[starts[:-1]]
    out = np.zeros((len(starts) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=np.float64)
    return out


# Fixed odd multiplier of splitmix-style mixing (2^64 / golden ratio).
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x * MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x
