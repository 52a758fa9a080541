"""Substring dedup against all windows of all documents."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import frame, pairs
from trendgap.llm import debruijn
from trendgap.llm.batches import Texts


def plainly(rows, size):
    smallest, out = {}, []
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k : k + size])
                smallest[key] = min(i, smallest.get(key, i))
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and smallest[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(map(repr, out))


def dense(seed, vocabulary, documents):
    """Short cycles, shared lines, copies with changed words, repeated and missing ids."""
    rng = random.Random(seed)
    lines = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(3, 40))] for _ in range(12)]
    rows = []
    for _ in range(documents):
        text = [w for _ in range(rng.randint(0, 6)) for w in rng.choice(lines)]
        for _ in range(rng.randint(0, 2)):
            if text:
                text[rng.randrange(len(text))] = f"new{rng.randrange(9)}"
        gaps = rng.choice([" ", "\n", " \t ", "\r\n"])
        rows.append((rng.choice([None, *range(-3, 60)]), gaps.join(text) or None))
    return rows


@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
def test_substring_dedup(request, table):
    df = request.getfixturevalue(table)
    found = debruijn.remove_repeated_spans(df)
    got = found.select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(repr(tuple(r)) for r in got) == plainly(pairs(df), 13)


@pytest.mark.parametrize(
    "seed,vocabulary,size,gram", [(1, 2, 5, 2), (3, 1, 4, 4), (4, 400, 13, 6), (6, 50, 1, 1)]
)
def test_dense_text(spark, seed, vocabulary, size, gram):
    rows = dense(seed, vocabulary, 90)
    found = debruijn.remove_repeated_spans(frame(spark, rows).repartition(5), size, gram)
    got = found.collect()
    assert sorted(repr(tuple(r)[:4]) for r in got) == plainly([(i, t or "") for i, t in rows], size)
    for r in got:  # the spans are what is removed, and their sources are earlier documents
        covered = {p for s in r["spans"] or [] for p in range(s["first"], s["end"])}
        assert len(covered) == r["n_removed"]
        assert all(s["source"] < r["doc_id"] for s in r["spans"] or [])


def test_paths_are_compacted(spark):
    """A passage of three documents is one span in each, not one span per window."""
    passage = " ".join(f"p{k}" for k in range(300))
    rows = [(k, " ".join(f"own{k}x{j}" for j in range(40)) + f" {passage} end{k}") for k in range(3)]
    found = debruijn.remove_repeated_spans(frame(spark, rows)).collect()
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"] or []] for r in found}
    assert spans == {0: [], 1: [(40, 340, 0)], 2: [(40, 340, 0)]}


def test_a_branch_ends_a_path(spark):
    """Documents 1 and 2 go on differently after the first half that both share with 0."""
    words = [f"p{k}" for k in range(60)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:30])), (2, " ".join(words[:30] + ["x", "y"])), (3, " ".join(words))]
    found = debruijn.remove_repeated_spans(frame(spark, rows)).collect()
    spans = {r["doc_id"]: sorted(tuple(s) for s in r["spans"] or []) for r in found}
    assert spans[1] == spans[2] == [(0, 30, 0)]
    assert spans[3] == [(0, 30, 0), (18, 60, 0)]  # windows 0-17 of four documents, then of two


def test_a_hot_passage_and_a_long_text(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, f"a{k} {passage} b{k}" if k % 3 == 0 else f"only {k}") for k in range(3000)]
    long = " ".join(f"q{k % 70_000}" for k in range(220_000))
    assert len(long) > 2 * debruijn.CHUNK
    rows += [(5000, long), (5001, f"z {long[: len(long) // 2]}")]
    found = debruijn.remove_repeated_spans(frame(spark, rows).repartition(8))
    got = {r["doc_id"]: r["n_removed"] for r in found.select("doc_id", "n_removed").collect()}
    assert all(got[k] == (40 if k % 3 == 0 and k else 0) for k in range(3000))
    assert got[5000] == 0 and got[5001] >= len(long[: len(long) // 2].split()) - 1


def test_words_of_a_chunk():
    values = ["", " a  bc\n", "d", "\t", "e f"]
    texts = Texts(pa.RecordBatch.from_arrays([pa.array(values)], ["text"]))
    words = debruijn.Words(texts)
    assert words.bounds.tolist() == [0, 0, 2, 3, 3, 5]
    seen = defaultdict(set)
    for k, w in enumerate(["a", "bc", "d", "e", "f"]):
        seen[int(words.of(np.array([k]), np.array([k + 1]), 0)[0])].add(w)
    assert len(seen) == 5
