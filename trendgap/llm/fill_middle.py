"""Fill-in-middle transformation: texts cut into prefix, middle and suffix at unit bounds.

All bytes of a chunk of texts get a character class, and the classes one wavelet matrix.
A unit (line, word, sentence) ends after any character of some classes, so the units before
a place are the sum of a few ranks, and the place of a cut is found by bisection on those
sums, for all texts of the chunk at once. Characters in a range are its bytes without the
continuation bytes, again two ranks.

Which units are cut at, and the form, are drawn from the SHA-256 of seed and doc_id, so they
depend on nothing else; rows of one id have the same draws. A text stays plain if it is empty,
if it holds one of the marks, or if the draw says so.

Null texts count as empty; a null id is written as nothing in the hash. Very long texts are
never cut into chunks: a task holds about twelve bytes a byte of its longest text. Columns
other than doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from trendgap.llm.batches import Texts, map_texts
from trendgap.llm.wavelet import WaveletMatrix

OTHER, NEWLINE, BLANK, STOP, CONTINUED = range(5)
LEVELS = 3
UNITS = {"line": (NEWLINE,), "word": (NEWLINE, BLANK), "sentence": (NEWLINE, STOP)}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# Class of every byte.
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[list(b" \t\v\f\r")] = BLANK
CLASSES[list(b".!?")] = STOP
CLASSES[ord("\n")] = NEWLINE
CLASSES[0x80:0xC0] = CONTINUED


@dataclass(frozen=True)
class Draws:
    """Seed, the unit to cut at, how many of 100 texts are transformed, and how many of
    100 of those have the suffix first."""

    seed: int = 7
    unit: str = "line"
    rate: int = 100
    suffix_first: int = 50

    def of(self, doc_id: int | None) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


OUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def transformed(texts: Texts, draws: Draws) -> dict[str, object]:
    """Columns of OUT for a chunk."""
    matrix = WaveletMatrix(CLASSES[texts.bytes], LEVELS)
    begins, ends = texts.starts[:-1], texts.starts[1:]
    enders = UNITS[draws.unit]
    before = matrix.count(enders, begins)
    whole = matrix.count(enders, ends) - before
    # What stands after the last end of a unit is one more unit.
    filled = np.flatnonzero(ends > begins)
    last_ends = matrix.count(enders, ends[filled]) > matrix.count(enders, ends[filled] - 1)
    n = whole.copy()
    n[filled] += ~last_ends

    ids = texts.column("doc_id").to_pylist()
    drawn = np.array([draws.of(i) for i in ids], np.int64).reshape(-1, 4)
    one, two = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)

    def place(units: np.ndarray) -> np.ndarray:
        """Where the given number of units ends."""
        return matrix.first(enders, begins, ends, before + units)

    def chars(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high - low - matrix.rank(CONTINUED, high) + matrix.rank(CONTINUED, low)

    first, second = place(np.minimum(one, two)), place(np.maximum(one, two))
    sizes = zip(chars(begins, first).tolist(), chars(first, second).tolist())
    cuts = zip((first - begins).tolist(), (second - begins).tolist())
    forms, outputs, lengths = [], [], []
    for raw, draw, (a, b), size in zip(texts.each(), drawn.tolist(), cuts, sizes):
        marked = any(mark.encode() in raw for mark in (PREFIX, SUFFIX, MIDDLE))
        if not raw or marked or draw[2] % 100 >= draws.rate:
            forms.append("plain")
            outputs.append(raw.decode())
            lengths.append((None, None))
            continue
        prefix, middle, suffix = raw[:a].decode(), raw[a:b].decode(), raw[b:].decode()
        lengths.append(size)
        if draw[3] % 100 < draws.suffix_first:
            forms.append("spm")
            outputs.append(f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
        else:
            forms.append("psm")
            outputs.append(f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")
    return {
        "doc_id": texts.column("doc_id"), "n": n, "form": forms, "output": outputs,
        "prefix_chars": [p for p, _ in lengths], "middle_chars": [m for _, m in lengths],
    }


def fill_in_middle(documents: DataFrame, draws: Draws = Draws()) -> DataFrame:
    """doc_id, number of units, form, characters of prefix and middle (null if plain) and
    the transformed text of every row."""
    return map_texts(
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"),
        lambda texts: transformed(texts, draws),
        OUT,
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. The marks occur once each, as no text that
    holds one is transformed."""

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, left, -1), right, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
        .otherwise(output)
    )
