"""Fill-in-middle texts against a plain restatement; the wavelet matrix against counting."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import frame, pairs
from trendgap.llm.fill_middle import Draws, fill_in_middle, restored
from trendgap.llm.wavelet import WaveletMatrix

PATTERNS = {
    "line": r"[^\n]*\n|[^\n]+",
    "word": r"[^ \t\v\f\r\n]*[ \t\v\f\r\n]|[^ \t\v\f\r\n]+",
    "sentence": r"[^.!?\n]*[.!?\n]|[^.!?\n]+",
}


def plainly(doc_id, text, draws):
    units = re.findall(PATTERNS[draws.unit], text)
    n = len(units)
    h = hashlib.sha256(f"{draws.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or c % 100 >= draws.rate:
        return doc_id, n, "plain", None, None, text
    if d % 100 < draws.suffix_first:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


MARKED = [(50, "a\n<P>b"), (51, "<M>"), (52, "<S>\n\n"), (53, "<P"), (54, "\n"), (55, "\n\n\n"), (56, "a\nb"),
          (57, "<\nP>\n<S\n>\nM>"), (58, "ä\n日本\n😀" * 9), (59, "a. b! c?\n d"), (60, "end\n")]


@pytest.mark.parametrize("draws", [Draws(), Draws(3, "word", 60, 20), Draws(9, "sentence", 100, 100)])
@pytest.mark.parametrize("table", ["odd", "documents", "nothing", "marked"])
def test_fill_in_middle(spark, request, table, draws):
    df = frame(spark, MARKED) if table == "marked" else request.getfixturevalue(table)
    rows = pairs(df)
    found = fill_in_middle(df, draws)
    got = sorted(repr(tuple(r)) for r in found.collect())
    assert got == sorted(repr(plainly(i, t, draws)) for i, t in rows)
    back = found.select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted(map(repr, pairs(back))) == sorted(map(repr, rows))


def test_a_text_longer_than_a_chunk(spark):
    text = "".join(f"line {k} ä\n" * (1 + k % 3) for k in range(90_000))
    assert len(text.encode()) > 2 << 20
    for row in fill_in_middle(frame(spark, [(1, text), (2, "x"), (3, text[:-1])])).collect():
        given = {1: text, 2: "x", 3: text[:-1]}[row["doc_id"]]
        assert tuple(row) == plainly(row["doc_id"], given, Draws())


def test_ranks_of_a_wavelet_matrix():
    rng = np.random.default_rng(5)
    for size in (0, 1, 63, 64, 65, 1000):
        values = rng.integers(0, 5, size).astype(np.uint8)
        matrix = WaveletMatrix(values, 3)
        places = np.arange(size + 1)
        for v in range(8):
            assert matrix.rank(v, places).tolist() == [int((values[:i] == v).sum()) for i in range(size + 1)]
        both = np.cumsum(np.append(0, (values == 1) | (values == 3)))
        for wanted in range(int(both[-1]) + 2):
            at = matrix.first((1, 3), np.array([0]), np.array([size]), np.array([wanted]))[0]
            assert at == min(size, int(np.searchsorted(both, wanted)))
