"""Language identification with interpolated Kneser-Ney character models.

Text is folded to letters and blanks: letters lower-cased, every run of other characters
one blank, a blank before the text. A character model of order `order` (5) is learnt for each
language from the n-gram counts of all training texts (counted in tasks, summed with
map-side combining). Below the highest order a gram counts by the number of different
characters it has been seen after, as Kneser and Ney have it; each order is discounted by
n1 / (n1 + 2 n2) and interpolated with the next lower one, the lowest with an even spread.

Grams are packed in 64 bits (12 per character) and kept in one sorted array per order,
with a row of log-probabilities for all languages; a lookup is a binary search. What a
language has not seen is filled in from its lower orders when the model is built, so only
grams that no language has seen back off at run time.

A text gets the language with the lowest cross-entropy per character. Its score is the
softmax over the languages of -cross-entropy times a scale; scale and the rejection
threshold of each language are fitted on a bounded sample of the training texts
(`calibration_rows`). A text above its language's threshold, the `reject` quantile of
its sampled cross-entropies with a margin, is marked `rejected`, and keeps its label.

Counts, discounts, continuation counts and the totals of histories are taken in Spark over
all training texts, for every order, before anything is left out. What a task holds of
them is bounded: per order and language the most frequent `max_grams` grams (fewer if there
are so many languages that the table would pass MAX_CELLS; of the last count that does not
fit whole, a share by hash), so no language is left without any. The probability of a gram
that was left out goes to the lower orders of its history, so the model stays a whole one.

Repeated ids and equal rows each count. Very long texts are never cut: a task holds about
a hundred bytes a character of its longest text.

Null texts and texts without a letter are `und` with score 0. Rows without a language are
not learnt from. Without any training row everything is `und`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trendgap.llm.batches import arrow_map, chunks, row_sums
from trendgap.llm.common import discard, stored

ORDER = 5
BITS = 12
UNKNOWN = "und"
MAX_GRAMS = 500_000
MAX_COUNT = 65_535
MILLION = 1_000_000
MAX_CELLS = 32_000_000  # log-probabilities of the highest order
CALIBRATION_ROWS = 2_000
REJECT = 0.999
MARGIN = 0.15  # nats per character above that quantile
CHUNK = 1 << 20
BLANK = 32


def fold_table() -> np.ndarray:
    """For each code point of the basic plane: 0 for a blank, else a code of 12 bits."""
    table = np.zeros(0x10000, np.uint16)
    for c in range(0x10000):
        char = chr(c)
        if char.isalpha():
            small = ord(char.lower()[0])
            # Characters beyond 12 bits share codes; that only blurs them a little.
            table[c] = small if small < 0x1000 else 0x800 + (small * 40503 >> 4) % 0x800
    return table


_TABLE: list[np.ndarray] = []


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts one after another, and where each begins. Every text begins with
    a blank that stands for what is before it; blanks never follow one another in a text."""
    if not _TABLE:
        _TABLE.append(fold_table())
    values = [v or "" for v in texts.to_pylist()]
    points = np.frombuffer("\n".join(["", *values]).encode("utf-32-le"), np.uint32)
    first = np.cumsum([0, *(len(v) + 1 for v in values)])
    high = points >= 0x10000
    codes = _TABLE[0][np.where(high, 0, points)]
    if high.any():  # letters of the further planes share one code
        letters = [c for c in np.unique(points[high]).tolist() if chr(c).isalpha()]
        codes[np.isin(points, letters)] = 0xFFF
    codes[codes == 0] = BLANK
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != BLANK) | (codes[:-1] != BLANK)
    keep[first[:-1]] = True
    return codes[keep].astype(np.uint64), np.append(0, np.cumsum(keep))[first]


def grams(codes: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """For each place the packed gram that ends there; blanks before the text's first."""
    out = codes.copy()
    depth = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
    for back in range(1, order):
        before = np.full(len(codes), BLANK, np.uint64)
        before[back:] = np.where(depth[back:] >= back, codes[:-back], np.uint64(BLANK))
        out |= before << np.uint64(BITS * back)
    return out


def training(documents: DataFrame) -> DataFrame:
    """Texts and languages to learn from: not held out, with a language."""
    return documents.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def gram_counts(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n over all rows of `documents`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        totals: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

        def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for part in chunks(batches, limit=CHUNK):
            codes, starts = folded(part.column("text"))
            found = grams(codes, starts, order)
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                own = np.repeat(langs == lang, np.diff(starts))
                own[starts[:-1][np.diff(starts) > 0]] = False  # the blank before a text
                own = np.flatnonzero(own)
                keys, n = np.unique(found[: len(codes)][own], return_counts=True)
                totals[lang].append((keys, n))
                if len(totals[lang]) == 16:
                    totals[lang] = [joined(totals[lang])]
                if len(totals[lang][0][0]) > 2_000_000:  # hand on what has gathered
                    keys, n = joined(totals.pop(lang))
                    yield [pa.array([lang] * len(keys)), keys.view(np.int64), n]
        for lang, parts in totals.items():
            keys, n = joined(parts)
            yield [pa.array([lang] * len(keys)), keys.view(np.int64), n]

    counted = arrow_map(documents.select("lang", "text"), count, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # per order, sorted
    logs: list[np.ndarray]  # per order, a row per key, a column per language
    backoff: list[np.ndarray]  # per order: log weight of the next lower order after a key
    floors: np.ndarray  # of a character that no language has seen
    scale: float = 1.0
    thresholds: np.ndarray | None = None

    def entropies(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Mean of -log p per character after the first blank; a row per text."""
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        todo = np.arange(len(codes))
        full = grams(codes, starts, len(self.keys))
        for order in range(len(self.keys), 0, -1):
            mask = np.uint64((1 << BITS * order) - 1)
            keys = self.keys[order - 1]
            wanted = full[todo] & mask
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            out[todo[hit]] += self.logs[order - 1][at[hit]]
            todo = todo[~hit]
            if order > 1 and len(todo):
                before = (full[todo] & mask) >> np.uint64(BITS)
                keys = self.keys[order - 2]
                at = np.minimum(np.searchsorted(keys, before), len(keys) - 1)
                hit = keys[at] == before
                out[todo[hit]] += self.backoff[order - 2][at[hit]]
        out[todo] += self.floors
        first = starts[:-1][np.diff(starts) > 0]
        out[first] = 0  # the blank before a text is given
        lengths = np.maximum(np.diff(starts) - 1, 1)
        return -row_sums(out, starts) / lengths[:, None]


@dataclass
class Level:
    """Grams of one language and order: sorted, how often each counts, how often its history
    counts with all grams there are, and the discount of the order."""

    grams: np.ndarray
    n: np.ndarray
    total: np.ndarray
    discount: float


def discount_of(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """The model from the grams of the highest order and their counts, by language."""
    levels: dict[str, list[Level]] = {}
    for lang, (grams_, n) in counts.items():
        place = np.argsort(grams_)
        grams_, n = grams_[place], n[place].astype(np.float64)
        own: list[Level] = []
        for k in range(order, 0, -1):
            _, at = np.unique(grams_ >> np.uint64(BITS), return_inverse=True)
            discount = discount_of((n == 1).sum(), (n == 2).sum())
            own.insert(0, Level(grams_, n, np.bincount(at, n)[at], discount))
            # A shorter gram counts once for each character it has followed.
            grams_, kinds = np.unique(grams_ & np.uint64((1 << BITS * (k - 1)) - 1), return_counts=True)
            n = kinds.astype(np.float64)
        levels[lang] = own
    return assembled(levels, order)


def assembled(by_language: dict[str, list[Level]], order: int) -> Model:
    languages = sorted(by_language)
    levels = [by_language[lang] for lang in languages]
    keys: list[np.ndarray] = []
    for k in reversed(range(order)):
        found = [own[k].grams for own in levels]
        if keys:  # the ending and the history of every longer one are looked up as well
            mask = np.uint64((1 << BITS * (k + 1)) - 1)
            found += [keys[0] & mask, keys[0] >> np.uint64(BITS)]
        keys.insert(0, np.unique(np.concatenate(found)))
    even = 1.0 / (len(keys[0]) + 1)
    logs = [np.zeros((len(keys[k]), len(languages)), np.float32) for k in range(order)]
    backoff = [np.zeros((len(keys[k]), len(languages)), np.float32) for k in range(order - 1)]
    floors = np.full(len(languages), np.log(even), np.float32)
    for column, own in enumerate(levels):
        below = np.full(len(keys[0]), even)  # probabilities of the order below, for its keys
        for k, level in enumerate(own):
            grams_, share = level.grams, (level.n - level.discount) / level.total
            history, at = np.unique(grams_ >> np.uint64(BITS), return_inverse=True)
            # All that the kept grams do not take.
            weight = np.maximum(1 - np.bincount(at, share, len(history)), 1e-9)
            # All keys of any language, seen by this one or not.
            before = keys[k] >> np.uint64(BITS)
            p = np.ones(len(keys[k]))
            if len(history):
                where = np.minimum(np.searchsorted(history, before), len(history) - 1)
                p = np.where(history[where] == before, weight[where], 1.0)
            if k:
                tail = keys[k] & np.uint64((1 << BITS * k) - 1)
                p = p * below[np.searchsorted(keys[k - 1], tail)]
                backoff[k - 1][np.searchsorted(keys[k - 1], history), column] = np.log(weight)
            else:
                p = p * below
                if len(history):
                    floors[column] = np.log(weight[0] * even)
            p[np.searchsorted(keys[k], grams_)] += share
            logs[k][:, column] = np.log(p)
            below = p
    return Model(languages, keys, logs, backoff, floors)


def most_frequent(level: DataFrame, max_grams: int) -> tuple[dict[str, float], pa.Table]:
    """The discount of each language over all grams of an order; and of each the most
    frequent grams with their counts and the totals of their histories, as lang, gram, n, total."""
    capped = F.least("n", F.lit(MAX_COUNT))
    # How many grams have each count: at most MAX_COUNT numbers per language.
    steps = level.groupBy("lang", capped.alias("n")).count().orderBy(F.desc("n")).collect()
    sizes: dict[str, dict[int, int]] = defaultdict(dict)
    for lang, n, grams_with in steps:
        sizes[lang][n] = grams_with
    allowed = max(1, min(max_grams, MAX_CELLS // max(1, len(sizes) ** 2)))
    wanted = F.lit(False)
    for lang, with_count in sizes.items():
        left, last, share = allowed, 1, MILLION
        for n, grams_with in with_count.items():
            last, share = n, min(MILLION, MILLION * left // grams_with)
            left -= grams_with
            if left <= 0:
                break
        inside = (capped > last) | ((capped == last) & (F.pmod(F.xxhash64("gram"), F.lit(MILLION)) < share))
        wanted = wanted | ((F.col("lang") == lang) & inside)
    history = F.shiftright("gram", BITS).alias("history")
    totals = level.groupBy("lang", history).agg(F.sum("n").alias("total"))
    kept = level.where(wanted).select("lang", "gram", "n", history).join(totals, ["lang", "history"])
    discounts = {lang: discount_of(c.get(1, 0), c.get(2, 0)) for lang, c in sizes.items()}
    return discounts, kept.select("lang", "gram", "n", "total").toArrow()


def learn(
    documents: DataFrame,
    order: int = ORDER,
    max_grams: int = MAX_GRAMS,
    calibration_rows: int = CALIBRATION_ROWS,
) -> Model | None:
    """The calibrated model of all training rows of `documents`; None without any."""
    level = stored(gram_counts(training(documents), order), "gram-counts")
    levels: dict[str, list[Level]] = defaultdict(list)
    for k in range(order, 0, -1):
        discounts, kept = most_frequent(level, max_grams)
        langs = kept.column("lang").combine_chunks().dictionary_encode()
        which = np.asarray(langs.indices)
        grams_ = np.asarray(kept.column("gram")).view(np.uint64)
        n, total = (np.asarray(kept.column(c)).astype(np.float64) for c in ("n", "total"))
        names = langs.dictionary.to_pylist()
        for lang, discount in discounts.items():
            own = np.flatnonzero(which == names.index(lang)) if lang in names else np.zeros(0, np.int64)
            own = own[np.argsort(grams_[own])]
            levels[lang].insert(0, Level(grams_[own], n[own], total[own], discount))
        longer = level
        if k > 1:
            # A shorter gram counts once for each character it has followed.
            shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("gram")
            level = stored(longer.groupBy("lang", shorter).agg(F.count("*").alias("n")), "shorter-grams")
        discard(longer)
    if not levels:
        return None
    model = assembled(levels, order)
    marked = training(documents).select("lang", "text", F.xxhash64("doc_id", "text").alias("mark"))
    # The texts with the smallest marks; first the marks alone.
    smallest = marked.select("mark").orderBy("mark").limit(calibration_rows)
    limit = smallest.agg(F.max("mark")).first()[0]
    sample = marked.where(F.col("mark") <= limit).limit(calibration_rows).toArrow()
    entropies, truth = [], []
    for part in chunks(iter(sample.combine_chunks().to_batches()), limit=CHUNK):
        codes, starts = folded(part.column("text"))
        some = np.diff(starts) > 1
        entropies.append(model.entropies(codes, starts)[some])
        truth += [x for x, y in zip(part.column("lang").to_pylist(), some) if y]
    scores = np.concatenate(entropies)
    columns = np.array([model.languages.index(x) if x in model.languages else -1 for x in truth])
    scores, columns = scores[columns >= 0], columns[columns >= 0]
    scales = np.array([1, 2, 4, 8, 16, 32, 64], float)
    losses = [
        -np.mean(np.log(softmax(-scores * s)[np.arange(len(columns)), columns] + 1e-12))
        for s in scales
    ]
    model.scale = float(scales[int(np.argmin(losses))])
    model.thresholds = np.array(
        [
            np.quantile(own, REJECT) + MARGIN if len(own := scores[columns == i, i]) else np.inf
            for i in range(len(model.languages))
        ]
    )
    return model


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


OUT = (
    "doc_id bigint, held_out boolean, lang_pred string, score double, "
    "cross_entropy double, rejected boolean"
)


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """Columns as in OUT for every row."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # bounded by max_grams

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        known = sent.value
        for part in chunks(batches, limit=CHUNK):
            n = part.num_rows
            keys, held = part.column("doc_id"), part.column("held_out")
            if known is None:
                yield [keys, held, [UNKNOWN] * n, [0.0] * n, [None] * n, [True] * n]
                continue
            codes, starts = folded(part.column("text"))
            some = np.diff(starts) > 1
            entropy = known.entropies(codes, starts)
            best = entropy.argmin(1)
            lowest = entropy[np.arange(n), best]
            sure = softmax(-entropy * known.scale)[np.arange(n), best]
            yield [
                keys,
                held,
                [known.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some)],
                np.where(some, sure, 0.0),
                pa.array(lowest, mask=~some),
                ~some | (lowest > known.thresholds[best]),
            ]

    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        "text",
    )
    return arrow_map(rows, score, OUT)
