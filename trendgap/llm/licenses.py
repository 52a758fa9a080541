"""Licence scans with a positional index of rare words.

Words are the runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
lower-cased. Two things are looked for in every text.

Base phrases: all places where the words of a phrase stand one after another.

Templates: an index holds every template's words with their positions and their inverse
document frequency (IDF), counted over all documents. A template needs `votes` distinct
words of the text at one relative position of text and template (within `slack` words, as
words may be missing or added). Every
place of a template holds all its mandatory phrases, so the word of highest IDF among those
is looked up first, in texts that hold all the others too: each of its places proposes the
relative positions whose window it stands in. All postings (word, position) of the template
then vote at the proposed positions, compared with the text by position. A place with
enough votes is verified last: all mandatory phrases of the template must stand within its
length and slack. The score is the IDF-weighted share of the template's words that stand at
their place, 1 for a whole copy; a text with base labels alone scores BASE_SCORE.

A text is read whole and by one task, whatever its length: memory grows with its words (a
few dozen bytes each) and with the proposed places, never with pairs of them.
Null texts count as empty: no words, no labels, empty label lists, score 0. Repeated ids
stay separate rows. A word that no document has does not matter to any IDF.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from trendgap.llm.batches import Texts, map_texts

# Words of the phrases, and their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
BASE_SCORE = 0.5


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: tuple[str, ...]


# Public licence notices, whole where they are short.
TEMPLATES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted", "without restriction"),
    ),
    Template("mit", "Released under the MIT License", ("the mit license",)),
    Template(
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at",
        ("apache license version 2", "in compliance with the license"),
    ),
    Template(
        "apache-2", "Licensed under the Apache License, Version 2.0", ("apache license version 2",)
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        ("redistribution and use", "source and binary forms"),
    ),
    Template(
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version",
        ("gnu general public license", "version 3"),
    ),
    Template(
        "gpl-3",
        "This work is licensed under the GNU General Public License, version 3",
        ("gnu general public license version 3",),
    ),
    Template(
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license v 2",),
    ),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain",
        ("free and unencumbered software", "public domain"),
    ),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
        "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
        ("permission is hereby granted", "copies or substantial portions of the software"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution",
        ("source and binary forms", "redistributions in binary form must reproduce"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies",
        ("with or without fee", "permission notice appear in all copies"),
    ),
    Template(
        "lgpl-3",
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 3 of the License, or (at your option) any later version",
        ("gnu lesser general public license", "version 3"),
    ),
    Template(
        "agpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version",
        ("gnu affero general public license", "version 3"),
    ),
    Template(
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event "
        "will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely",
        ("without any express or implied warranty", "alter it and redistribute it freely"),
    ),
)

# Bytes of words as they are, A-Z lower-cased; every other byte becomes a blank.
WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A
    else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
    else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Byte offsets of a phrase in blank-joined words with a blank at either end."""
    needle, found, at = b" " + phrase + b" ", [], -1
    while (at := joined.find(needle, at + 1)) >= 0:
        found.append(at)
    return found


@dataclass
class Index:
    """Positional postings of all template words, in the order of their IDF."""

    templates: tuple[Template, ...]
    idf: dict[bytes, float]
    votes: int
    slack: int
    code: dict[bytes, int] = field(default_factory=dict)  # by IDF, the rarest word is 0
    words: list[list[bytes]] = field(default_factory=list)
    mandatory: list[list[list[int]]] = field(default_factory=list)  # phrases as codes
    needed: list[set[int]] = field(default_factory=list)  # all words of those
    postings: list[dict[int, np.ndarray]] = field(default_factory=list)  # positions by word
    least: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        rarest = sorted(template_words(self.templates), key=lambda w: (-self.idf[w], w))
        self.code = {word: number for number, word in enumerate(rarest)}
        for template in self.templates:
            words = words_of(template.text.encode())
            self.words.append(words)
            phrases = [words_of(m.encode()) for m in template.mandatory]
            self.mandatory.append([[self.code[w] for w in phrase] for phrase in phrases])
            self.needed.append({c for phrase in self.mandatory[-1] for c in phrase})
            if not self.needed[-1]:
                raise ValueError(f"a template without mandatory phrase: {template.label}")
            codes = np.array([self.code[w] for w in words], np.int32)
            self.postings.append({c: np.flatnonzero(codes == c) for c in sorted(set(codes.tolist()))})
            self.least.append(min(self.votes, len(self.postings[-1])))

    def find(self, words: list[bytes]) -> dict[str, float]:
        """Labels of the templates found, with the best score of each."""
        shared = {self.code[w] for w in self.code.keys() & set(words)}
        met = [
            number
            for number, needed in enumerate(self.needed)
            if needed <= shared
            and sum(c in shared for c in self.postings[number]) >= self.least[number]
        ]
        found: dict[str, float] = {}
        if not met:
            return found
        codes = np.fromiter((self.code.get(w, -1) for w in words), np.int32, len(words))
        for number in met:
            own, label = self.words[number], self.templates[number].label
            for shift in self.candidates(number, codes).tolist():
                start = max(0, shift - self.slack)
                part = words[start : shift + len(own) + self.slack]
                score = self.score(own, part, shift - start)
                found[label] = max(found.get(label, 0.0), score)
        return found

    def candidates(self, number: int, codes: np.ndarray) -> np.ndarray:
        """Relative positions of text and template with enough distinct words in place and
        all mandatory phrases near."""
        slack, length = self.slack, len(self.words[number])
        rare = np.flatnonzero(codes == min(self.needed[number]))
        # Windows that hold one of these, as a sweep: places may be many, shifts are not.
        begins = np.maximum(rare - length - slack + 1, 1 - length)
        ends = np.minimum(rare + slack + 1, len(codes))
        size = len(codes) + length
        edges = np.bincount(begins + length - 1, minlength=size) - np.bincount(
            ends + length - 1, minlength=size
        )
        shifts = np.flatnonzero(np.cumsum(edges) > 0) - (length - 1)
        framed = np.full(len(codes) + 2 * (length + slack), -1, np.int32)
        framed[length : length + len(codes)] = codes
        tally = np.zeros(len(shifts), np.int32)
        exact = np.zeros(len(shifts), bool)  # whether a word stands without any slack
        for code, positions in self.postings[number].items():
            here = np.zeros(len(shifts), bool)
            for at in positions.tolist():
                base = shifts + (at + length)
                hit = framed[base] == code
                exact |= hit
                here |= hit
                for d in range(1, slack + 1):
                    here |= framed[base + d] == code
            tally += here
        shifts = shifts[exact & (tally >= self.least[number])]
        for phrase in self.mandatory[number]:
            if not len(shifts):
                break
            whole = max(0, len(codes) - len(phrase) + 1)
            starts = np.flatnonzero(codes[:whole] == phrase[0])
            for n, code in enumerate(phrase[1:], 1):
                starts = starts[codes[starts + n] == code]
            ends = np.append(starts + len(phrase), len(codes) + 2 * (length + slack))
            first = np.searchsorted(starts, np.maximum(shifts - slack, 0))
            shifts = shifts[ends[first] <= shifts + length + slack]
        return shifts

    def score(self, own: list[bytes], part: list[bytes], shift: int) -> float:
        total = kept = 0.0
        for position, word in enumerate(own):
            total += self.idf[word]
            at = position + shift
            if word in part[max(0, at - self.slack) : at + self.slack + 1]:
                kept += self.idf[word]
        return kept / total if total else 0.0


def template_words(templates: tuple[Template, ...]) -> list[bytes]:
    parts = [part for t in templates for part in (t.text, *t.mandatory)]
    return sorted({w for part in parts for w in words_of(part.encode())})


def inverse_document_frequencies(
    documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES
) -> dict[bytes, float]:
    """IDF of every template word over all documents; as many numbers as template words."""
    vocabulary = template_words(templates)
    known = set(vocabulary)

    def count(texts: Texts) -> dict[str, object]:
        seen: dict[bytes, int] = {}
        for text in texts.each():
            for word in known.intersection(words_of(text)):
                seen[word] = seen.get(word, 0) + 1
        return {"word": list(seen), "n": list(seen.values())}

    counted = map_texts(documents.select("text"), count, "word binary, n bigint")
    found = {
        bytes(r["word"]): r["n"]
        for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()
    }
    total = documents.count()
    return {w: math.log((total + 1) / (found.get(w, 0) + 0.5)) for w in vocabulary}


def license_scan(
    documents: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    phrases: tuple[tuple[str, str], ...] = BASE_PHRASES,
    votes: int = 4,
    slack: int = 3,
) -> DataFrame:
    """Phrases and licences of every text; columns as in OUT."""
    index = Index(templates, inverse_document_frequencies(documents, templates), votes, slack)
    base = [(b" ".join(words_of(p.encode())), label) for p, label in phrases]

    def scan(texts: Texts) -> dict[str, object]:
        columns: dict[str, list] = {name: [] for name in NAMES}
        for text in texts.each():
            words = words_of(text)
            joined = b" " + b" ".join(words) + b" "
            places: list[int] = []
            labels: dict[str, float] = {}
            for phrase, label in base:
                if hits := phrase_places(joined, phrase):
                    labels[label] = BASE_SCORE
                    places += hits
            known = sorted(labels)
            for label, score in index.find(words).items():
                labels[label] = max(score, labels.get(label, 0.0))
            row = (
                len(words),
                len(places),
                joined.count(b" ", 0, min(places)) if places else None,
                joined.count(b" ", 0, max(places)) if places else None,
                ",".join(known),
                ",".join(sorted(labels)),
                max(labels.values(), default=0.0),
            )
            for name, value in zip(NAMES, row):
                columns[name].append(value)
        return {"doc_id": texts.column("doc_id"), **columns}

    return map_texts(
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), scan, OUT
    )


OUT = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double"
)
NAMES = [c.split()[0] for c in OUT.split(", ")][1:]
