"""Token counts, token files, fingerprints: exact against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import in_order, pairs
from trendgap.llm import merkle, token_counts, token_files
from trendgap.llm.batches import Texts, row_sums
from trendgap.llm.common import shared_folder, stored

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def as_texts(values):
    return Texts(pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["text"]))


@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
def test_token_counts(request, sp, table):
    df = request.getfixturevalue(table)
    got = sorted((str(r[0]), *r[1:]) for r in token_counts.token_counts(df, PIECES).collect())
    want = sorted(
        (str(i), len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in pairs(df)
    )
    assert got == want


def test_transducer_on_random_text(sp):
    random.seed(5)
    pieces = [sp.id_to_piece(i).replace("▁", " ") for i in range(300, 32000, 7)]
    texts = ["".join(random.choices(pieces, k=random.randint(0, 60))) for _ in range(800)]
    signs = "ab  \n\tthe éñ日本語한😀.1▁"
    texts += ["".join(random.choices(signs, k=random.randint(0, 300))) for _ in range(800)]
    texts += [" " * n for n in range(80)] + ["a" + " " * 70 + "b", "日" * 700]
    data, bounds = token_counts.with_begin(as_texts([t.replace("▁", " ") for t in texts]))
    machine = token_counts.transducer(open(PIECES, "rb").read())
    found = row_sums(machine.emissions(data), bounds)
    found[[not t for t in texts]] = 0
    assert found.tolist() == [len(x) for x in sp.encode(texts)]


def test_transducer_starts_again_when_full(sp, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 60)
    machine = token_counts.Transducer(open(PIECES, "rb").read())
    for text in ("some words of one text", "and quite other ones", "some words of one text"):
        data, bounds = token_counts.with_begin(as_texts([text]))
        assert row_sums(machine.emissions(data), bounds)[0] == len(sp.encode(text))


@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
def test_token_files(spark, request, table):
    df = request.getfixturevalue(table)
    folder = shared_folder(spark, "ids")
    files = token_files.write_token_files(df, open(WORDS).read(), folder)
    got = token_files.read_token_files(stored(files, "files"), folder).collect()
    model = Tokenizer.from_file(WORDS)
    at, want = 0, []
    found = [
        (i, np.array([*model.encode(t, add_special_tokens=False).ids, 2], "<u4")) for i, t in pairs(df)
    ]
    found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].astype("<u2").tobytes()))
    for i, ids in found:
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_units_as_the_library_has_them():
    random.seed(2)
    signs = list("aAéß0 12.,'s't\n\t\x1c\x1d\x85\xa0　éİſﬁ日本한😀½²_-<|>endÀÇŒŸǅª×÷ÿĿŉ\xad\x7f")
    signs += ["<|endoftext|>", "<|startoftext|>", "'re", "'LL", "́", "​", "﻿", "\0"]
    texts = ["".join(random.choices(signs, k=random.randint(0, 40))) for _ in range(4000)]
    texts += [chr(c) for c in range(1, 0x250)] + [f"a{chr(c)}B" for c in range(1, 0x250)]
    ids, sizes = token_files.tokenizer(open(WORDS).read()).ids(as_texts(texts))
    got = np.split(ids, np.cumsum(sizes)[:-1])
    want = Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)
    assert [g.tolist() for g in got] == [w.ids for w in want]


def test_blocks_round_trip_with_ids_of_all_lengths():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, top, n).astype(np.uint32) for top, n in ((3, 9), (70_000, 200_000), (5, 0), (9, 3))]
    keys = [4, None, -7, 2**50]
    raw = token_files.encode_block(keys, docs) * 2
    blocks = list(token_files.decode_file(raw))
    assert len(blocks) == 2
    for doc_ids, lengths, ids in blocks:
        assert doc_ids == keys and lengths.tolist() == [len(d) for d in docs]
        assert ids.tolist() == np.concatenate(docs).tolist()
    # The most frequent ids take one byte and two bits.
    small = token_files.encode_block([1], [np.full(10_000, 49_000, np.uint32)])
    assert len(small) < 10_000 * 1.26 + 50


@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
def test_merkle(request, table):
    df = request.getfixturevalue(table)
    rows = in_order(pairs(df))
    want = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        new = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        a, b, c = (merkle.fingerprint(x) for x in (text, new, following))
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b,
                     merkle.likeness(a, b), merkle.likeness(a, c)))
    got = merkle.merkle_fingerprints(df).drop("n_sections", "sections_changed").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_merkle_locates_edits():
    lines = [f"Paragraph {k} says something. And more of it." for k in range(60)]
    other = lines.copy()
    other[30] = "Quite another paragraph."
    a, b = (merkle.fingerprint("\n".join(x)) for x in (lines, other))
    assert a != b and 0.9 < merkle.likeness(a, b) < 1
    assert 1 <= len(merkle.changed_sections(a, b)) <= 2
    inserted = lines[:10] + ["A new line."] + lines[10:]
    assert len(merkle.changed_sections(a, merkle.fingerprint("\n".join(inserted)))) <= 2
    assert merkle.likeness(a, a) == 1 and merkle.changed_sections(a, a) == []
    assert merkle.fingerprint("a\nb") != merkle.fingerprint("a\nb\n")
