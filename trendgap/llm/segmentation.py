"""SentencePiece encoding by sampling segmentations without replacement, and decoding.

The pieces of a model span a lattice over a text: an edge for every piece that stands at a
place, and one of byte pieces for a character that is no piece. A BPE model has ranks, not
probabilities, so an edge weighs 1 / (rank + SHIFT), as in Zipf's law, to the power of
`sharpness`; a byte weighs as the rarest piece. The probability of a segmentation is the
product of its edges over the sum for all segmentations of the text.

The `k` segmentations are those with the largest log-probability plus Gumbel noise, that
is a sample of k without replacement. They are found by A-star search from the top: the
perturbed value of the best segmentation below a place is the place's own, and that of all
others is drawn below it, given their mass, which the backward sums of the lattice give
exactly. So the best one is a walk that draws each edge by its mass; the next one leaves a
found one at the place whose other edges hold the largest value of all, and walks on from
there. Segmentations are distinct by construction. The inclusion score is the probability
1 - exp(-exp(log p - t)) that a segmentation is in the sample, t being the largest
perturbed value left outside.

All random numbers are hashes of the row key, the number of the segmentation and the place
in the text: they do not depend on how rows are dealt to tasks.

No piece holds a blank after another character, so the lattice falls into words; the
lattices of the distinct words of a chunk are built once and walked by all their places in
lockstep.

Null and empty texts have one segmentation, without pieces. A text with fewer than k
segmentations gives all of them, with inclusion score 1. Repeated ids are separate rows;
equal rows get equal samples.
"""

from __future__ import annotations

import pathlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from trendgap.llm.batches import MIX, arrow_map, chunks, mixed, row_sums
from trendgap.llm.suffixes import BASES, powers

K = 2
SHIFT = 10.0
CHUNK = 3 << 18
FILTER_BITS = 20
BLANK = 0x2581
NEVER = -np.inf


class Pieces:
    """The pieces of a model by hash of their characters, with weights."""

    def __init__(self, model: bytes, sharpness: float) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        texts, ids, self.byte_ids = [], [], np.zeros(256, np.int64)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                texts.append(piece)
                ids.append(i)
        if any("▁" in p.lstrip("▁") for p in texts):
            raise ValueError("pieces with a blank inside are not supported")
        self.longest = max(map(len, texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        hashes = Points(points).of(starts, ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(ids)[order]
        # Where the hashes with each beginning start: -1 for none, else at most `most` on.
        begins = self.hashes >> np.uint64(64 - FILTER_BITS)
        self.slots = np.full(1 << FILTER_BITS, -1, np.int32)
        self.slots[begins[::-1]] = np.arange(len(begins), dtype=np.int32)[::-1]
        self.most = int(np.bincount(begins.astype(np.int64)).max())
        weight = -sharpness * np.log(np.arange(len(ids)) + 1 + SHIFT)
        self.weights = weight[order]
        self.byte_weight = float(weight.min())
        # The bytes that each id stands for, as one table; blanks as blanks.
        out = [b""] * sp.get_piece_size()
        for text, i in zip(texts, ids):
            out[i] = text.replace("▁", " ").encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        self.sizes = np.array([len(x) for x in out])
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(out), np.uint8)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are pieces, their places in the table)."""
        slot = self.slots[wanted >> np.uint64(64 - FILTER_BITS)]
        maybe = np.flatnonzero(slot >= 0)
        slot, wanted = slot[maybe], wanted[maybe]
        which, index = [], []
        for step in range(self.most):
            at = np.minimum(slot + step, len(self.hashes) - 1)
            hit = self.hashes[at] == wanted
            which.append(maybe[hit])
            index.append(at[hit])
        return np.concatenate(which), np.concatenate(index)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of many id sequences, and where each begins. The blank before the
        first piece is not part of a text."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.firsts[ids] - ends + sizes, sizes) + np.arange(int(sizes.sum()))
        data = self.bytes[at]
        places = np.append(0, ends)[bounds]
        full = np.diff(places) > 0
        drop = places[:-1][full]
        keep = np.ones(len(data), bool)
        keep[drop] = data[drop] != 0x20
        return data[keep], np.append(0, np.cumsum(keep))[places]


class Points:
    """Prefix hashes of code points."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points) + 1
        self.sums = np.zeros(n, np.uint64)
        inverse = powers(pow(BASES[0], -1, 1 << 64), n - 1)
        np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * inverse, out=self.sums[1:])
        self.powers = powers(BASES[0], n)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.powers[starts])


class Lattice:
    """The lattices of many words.

    A place is a word and a number of characters that remain of it. Places are numbered by
    that distance first and by the rank of the word second, longest words first, so that
    backward sums go through them in order: place = base[distance] + rank. The edges of a
    place lie one after another: `size` characters, piece `ids` (-1: bytes), conditional
    log-probability `log`, and `chances`, the running sum of their probabilities.
    """

    def __init__(self, pieces: Pieces, points: np.ndarray, bounds: np.ndarray) -> None:
        self.points = points
        self.lengths = np.diff(bounds)
        order = np.argsort(-self.lengths, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        deepest = int(self.lengths.max(initial=0))
        active = np.searchsorted(-self.lengths[order], -np.arange(1, deepest + 1), "right")
        self.base = np.concatenate(([0, 0], np.cumsum(active)))
        n = int(self.base[-1])
        self.distance = np.repeat(np.arange(1, deepest + 1), active)
        self.char = bounds[1:][order][np.arange(n) - self.base[self.distance]] - self.distance
        hashes = Points(points)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(n, np.int64)
        for size in range(1, min(pieces.longest, deepest) + 1):
            first = int(self.base[size])  # places with fewer characters come before
            at = self.char[first:]
            which, index = pieces.find(hashes.of(at, at + size))
            found.append((which + first, index))
            count[found[-1][0]] += 1
            if size == 1:
                unknown = np.flatnonzero(count == 0)
                count[unknown] = 1
        self.first = np.append(0, np.cumsum(count))
        edges = int(self.first[-1])
        self.size, self.ids = np.ones(edges, np.int64), np.full(edges, -1, np.int32)
        weight = np.zeros(edges)
        filled = np.zeros(n, np.int64)
        for size, (place, index) in enumerate(found, 1):
            filled[place] += 1
            at = self.first[place + 1] - filled[place]  # the longest edges first
            self.size[at], self.ids[at], weight[at] = size, pieces.ids[index], pieces.weights[index]
            if size == 1 and n:
                at = self.first[unknown]
                filled[unknown] = 1
                point = points[self.char[unknown]]
                wide = 1 + (point > 0x7F).astype(int) + (point > 0x7FF) + (point > 0xFFFF)
                weight[at] = pieces.byte_weight * wide
        # Backward sums; what remains after an edge may be nothing, which has mass one.
        place = np.repeat(np.arange(n), count)
        after = self.distance[place] - self.size
        target = np.where(after > 0, self.base[after] + place - self.base[self.distance[place]], n)
        mass = np.zeros(n + 1)
        for distance in range(1, deepest + 1):
            a, b = int(self.base[distance]), int(self.base[distance + 1])
            e, f = int(self.first[a]), int(self.first[b])
            weight[e:f] += mass[target[e:f]]
            mass[a:b] = np.logaddexp.reduceat(weight[e:f], self.first[a:b] - e)
        self.log = weight - mass[place]
        total = np.append(0, np.cumsum(np.exp(self.log)))
        self.chances = total[1:] - total[self.first[:-1]][place]
        self.chances[self.first[1:] - 1] = 1.0

    def ragged(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges of each place, and which of the places each belongs to."""
        count = self.first[place + 1] - self.first[place]
        own = np.repeat(np.arange(len(place)), count)
        return np.repeat(self.first[place] - np.cumsum(count) + count, count) + np.arange(len(own)), own


def uniform(key: np.ndarray, place: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on row key, place and stream alone."""
    x = mixed(mixed(key ^ mixed(place.astype(np.uint64) + np.uint64(1))) + np.uint64(stream))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@dataclass
class Path:
    """A segmentation of every text: its tokens one after another."""

    bounds: np.ndarray  # of the texts
    occurrence: np.ndarray  # the word of each token
    place: np.ndarray  # in the lattice
    edge: np.ndarray
    value: np.ndarray  # largest perturbed value of the unused other edges
    used: np.ndarray  # bits of the edges that found segmentations took
    perturbed: np.ndarray  # of each text
    alive: np.ndarray  # texts that have this segmentation


class Sampler:
    """Segmentations of the texts of one chunk."""

    def __init__(self, pieces: Pieces, texts: list[str], keys: np.ndarray) -> None:
        self.pieces, self.keys = pieces, keys
        marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        self.text_bounds = np.cumsum([0, *map(len, marked)])
        blank = points == BLANK
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin[self.text_bounds[:-1][np.diff(self.text_bounds) > 0]] = True
        self.starts = np.append(np.flatnonzero(begin), len(points))
        self.word_bounds = np.append(0, np.cumsum(row_sums(begin, self.text_bounds)))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.word_bounds))
        lengths = np.diff(self.starts)
        words = pa.Array.from_buffers(
            pa.large_binary(), len(lengths),
            [None, pa.py_buffer((self.starts * 4).astype(np.int64)), pa.py_buffer(points)],
        ).dictionary_encode()
        self.word = np.asarray(words.indices).astype(np.int64)
        distinct = words.dictionary.to_pylist()
        bounds = np.cumsum([0, *(len(w) // 4 for w in distinct)])
        self.lattice = Lattice(pieces, np.frombuffer(b"".join(distinct), np.uint32), bounds)
        if np.diff(self.lattice.first).max(initial=0) > 63:
            raise ValueError("more than 63 pieces begin at one place")  # a bit each in `used`
        self.length = lengths
        self.rank = self.lattice.rank[self.word]

    def position(self, occurrence: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The character of the text at a place of one of its words."""
        end = self.starts[occurrence + 1] - self.text_bounds[self.text[occurrence]]
        return end - self.lattice.distance[place]

    def random(self, occurrence: np.ndarray, place: np.ndarray, stream: int) -> np.ndarray:
        key = self.keys[self.text[occurrence]]
        return uniform(key, self.position(occurrence, place), stream)

    def walk(self, occurrence: np.ndarray, remaining: np.ndarray, stream: int) -> tuple:
        """Tokens of each start to the end of its word: (count per start, places, edges)."""
        lattice = self.lattice
        left, count, steps = remaining.copy(), np.zeros(len(remaining), np.int64), []
        live = np.flatnonzero(left > 0)
        while len(live):
            place = lattice.base[left[live]] + self.rank[occurrence[live]]
            chance = self.random(occurrence[live], place, stream)
            edge = lattice.first[place]
            passed = np.flatnonzero(lattice.chances[edge] < chance)
            while len(passed):
                edge[passed] += 1
                passed = passed[lattice.chances[edge[passed]] < chance[passed]]
            steps.append((live, place, edge))
            count[live] += 1
            left[live] -= lattice.size[edge]
            live = live[left[live] > 0]
        first = np.cumsum(count) - count
        places, edges = np.zeros(count.sum(), np.int64), np.zeros(count.sum(), np.int64)
        for k, (live, place, edge) in enumerate(steps):
            places[first[live] + k], edges[first[live] + k] = place, edge
        return count, places, edges

    def others(self, place: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Log of the mass of the edges of each place that are not used."""
        edge, own = self.lattice.ragged(place)
        free = (used[own] >> (edge - self.lattice.first[place][own])) & 1 == 0
        mass = np.bincount(own, np.exp(self.lattice.log[edge]) * free, len(place))
        with np.errstate(divide="ignore"):
            return np.log(mass)

    def below(self, bound: np.ndarray, place: np.ndarray, mass: np.ndarray,
              occurrence: np.ndarray, stream: int) -> np.ndarray:
        """The largest perturbed value of edges of log-mass `mass`, given it is under `bound`."""
        noise = -np.log(-np.log(self.random(occurrence, place, stream)))
        with np.errstate(over="ignore", invalid="ignore"):
            return np.where(np.isneginf(mass), NEVER, -np.logaddexp(-bound, -(mass + noise)))

    def first(self) -> Path:
        everything = np.arange(len(self.word))
        count, place, edge = self.walk(everything, self.length, 0)
        occurrence = np.repeat(everything, count)
        bounds = np.append(0, np.cumsum(count))[self.word_bounds]
        n = len(self.keys)
        gumbel = -np.log(-np.log(uniform(self.keys, np.zeros(n, np.int64), 1)))
        return self.finish(bounds, occurrence, place, edge, gumbel, np.ones(n, bool),
                           np.zeros(n, np.int64), 2)

    def finish(self, bounds: np.ndarray, occurrence: np.ndarray, place: np.ndarray,
               edge: np.ndarray, gumbel: np.ndarray, alive: np.ndarray, fresh: np.ndarray,
               stream: int) -> Path:
        """The values of what each token leaves aside; the first `fresh` tokens of a text
        are those of another segmentation, where their values count."""
        log = self.lattice.log[edge]
        total = np.append(0, np.cumsum(log))
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        before = total[:-1] - total[bounds[:-1]][text]
        used = np.int64(1) << (edge - self.lattice.first[place])
        chance = np.exp(log)
        with np.errstate(divide="ignore"):
            rest = np.log1p(-np.minimum(chance, 1.0))
        sure = np.flatnonzero(chance > 1 - 1e-6)  # the difference to one says too little
        rest[sure] = self.others(place[sure], used[sure])
        value = self.below(gumbel[text], place, before + rest, occurrence, stream)
        value[np.arange(len(text)) - bounds[text] < fresh[text]] = NEVER
        return Path(bounds, occurrence, place, edge, value, used, gumbel, alive)

    def best(self, paths: list[Path]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the largest value left: (value, which path, which token)."""
        n = len(self.keys)
        value, which, token = np.full(n, NEVER), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for number, path in enumerate(paths):
            full = np.flatnonzero(np.diff(path.bounds) > 0)
            if not len(full):
                continue
            top = np.full(n, NEVER)
            top[full] = np.maximum.reduceat(path.value, path.bounds[:-1][full])
            text = np.repeat(np.arange(n), np.diff(path.bounds))
            hit = np.flatnonzero((path.value == top[text]) & (path.value > NEVER))
            where = np.zeros(n, np.int64)
            where[text[hit][::-1]] = hit[::-1]
            better = top > value
            value[better], which[better], token[better] = top[better], number, where[better]
        return value, which, token

    def following(self, paths: list[Path]) -> Path:
        """The next segmentation of every text that has one."""
        number = len(paths)
        value, which, token = self.best(paths)
        alive = value > NEVER
        branch = np.zeros(len(value), np.int64)  # tokens kept of the path that is left
        none = np.zeros(0, np.int64)
        heads, starts = [(none,) * 4], [(none,) * 3]
        lattice = self.lattice
        for index, path in enumerate(paths):
            own = np.flatnonzero(alive & (which == index))
            at = token[own]
            place, word = path.place[at], path.occurrence[at]
            branch[own] = at - path.bounds[own]
            # The edge is drawn among the unused ones by mass, and is used from now on.
            edges, group = lattice.ragged(place)
            free = (path.used[at][group] >> (edges - lattice.first[place][group])) & 1 == 0
            edges, group = edges[free], group[free]
            total = np.append(0, np.cumsum(np.exp(lattice.log[edges])))
            ends = np.cumsum(np.bincount(group, minlength=len(own)))
            low, high = total[np.append(0, ends[:-1])[: len(own)]], total[ends]
            drawn = low + self.random(word, place, 8 * number) * (high - low)
            chosen = np.clip(np.searchsorted(total, drawn) - 1, np.append(0, ends[:-1])[: len(own)], ends - 1)
            edge = edges[chosen]
            path.used[at] |= np.int64(1) << (edge - lattice.first[place])
            kept_log = np.append(0, np.cumsum(lattice.log[path.edge]))
            before = kept_log[at] - kept_log[path.bounds[own]]
            rest = before + self.others(place, path.used[at])
            path.value[at] = self.below(value[own], place, rest, word, 8 * number + 1)
            rank = np.arange(branch[own].sum()) - np.repeat(
                np.cumsum(branch[own]) - branch[own], branch[own]
            )
            kept = np.repeat(path.bounds[own], branch[own]) + rank
            heads.append((np.repeat(own, branch[own]), path.occurrence[kept], path.place[kept], path.edge[kept]))
            heads.append((own, word, place, edge))
            starts.append((own, word, lattice.distance[place] - lattice.size[edge]))
        own, occurrence, remaining = (np.concatenate(x) for x in zip(*starts))
        # The rest of the word, and all words of the text after it.
        rest = self.word_bounds[1:][own] - occurrence - 1
        later = np.repeat(occurrence + 1 - np.cumsum(rest) + rest, rest) + np.arange(rest.sum())
        lanes = np.concatenate((occurrence, later))
        count, walked, edges = self.walk(
            lanes, np.concatenate((remaining, self.length[later])), 8 * number + 2
        )
        lane = np.repeat(lanes, count)
        heads.append((self.text[lane], lane, walked, edges))
        text, occurrence, place, edge = (np.concatenate(x) for x in zip(*heads))
        order = np.argsort(self.starts[occurrence + 1] - lattice.distance[place])
        bounds = np.append(0, np.cumsum(np.bincount(text, minlength=len(value))))
        return self.finish(
            bounds, occurrence[order], place[order], edge[order], value, alive, branch + 1,
            8 * number + 3,
        )

    def sample(self, k: int) -> tuple[list[Path], np.ndarray]:
        """k paths, and the largest perturbed value left outside of them for each text."""
        paths = [self.first()]
        while len(paths) < k:
            paths.append(self.following(paths))
        return paths, self.best(paths)[0]

    def ids(self, path: Path) -> tuple[np.ndarray, np.ndarray]:
        """Token ids and where each text's begin; a character of bytes gives several."""
        ids = self.lattice.ids[path.edge].astype(np.int64)
        unknown = np.flatnonzero(ids < 0)
        if not len(unknown):
            return ids, path.bounds
        chars = self.lattice.points[self.lattice.char[path.place[unknown]]]
        raw = [chr(c).encode() for c in chars.tolist()]
        extra = np.ones(len(ids), np.int64)
        extra[unknown] = [len(x) for x in raw]
        ends = np.cumsum(extra)
        out = np.repeat(ids, extra)
        out[out < 0] = self.pieces.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.append(0, ends)[path.bounds]


_KEPT: dict[tuple[int, float], Pieces] = {}


def pieces_of(model: bytes, sharpness: float) -> Pieces:
    """One per Python worker and model."""
    key = (hash(model), sharpness)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Pieces(model, sharpness)
    return _KEPT[key]


OUT = (
    "doc_id bigint, n_samples int, n_tokens array<int>, ids_crc32 array<bigint>, "
    "log_prob array<double>, perturbed array<double>, inclusion array<double>, "
    "round_trip boolean, ids array<binary>"
)


def sample_segmentations(
    documents: DataFrame, model_path: str, k: int = K, sharpness: float = 1.0, ids: bool = True
) -> DataFrame:
    """Columns as in OUT for every row, samples by falling perturbed value. `ids` holds
    little-endian unsigned 32-bit numbers (null if not asked for), `ids_crc32` their
    checksums; `round_trip` says whether all of them decode to the text."""
    model = pathlib.Path(model_path).read_bytes()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        pieces = pieces_of(model, sharpness)
        for part in chunks(batches, limit=CHUNK):
            texts = [t or "" for t in part.column("text").to_pylist()]
            keys = mixed(np.asarray(part.column("key")).view(np.uint64) + MIX)
            sampler = Sampler(pieces, texts, keys)
            paths, outside = sampler.sample(k)
            n = len(texts)
            rows: list[list] = [[[] for _ in range(n)] for _ in range(6)]
            good = np.ones(n, bool)
            plain = [t.replace("▁", " ").encode() for t in texts]
            for path in paths:
                found, bounds = sampler.ids(path)
                log = row_sums(sampler.lattice.log[path.edge], path.bounds)
                with np.errstate(over="ignore"):
                    included = -np.expm1(-np.exp(log - outside))
                raw = found.astype("<u4").tobytes()
                decoded, places = pieces.decode(found, bounds)
                decoded = decoded.tobytes()
                for i in np.flatnonzero(path.alive).tolist():
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    own = raw[4 * a : 4 * b]
                    good[i] &= decoded[places[i] : places[i + 1]] == plain[i]
                    values = (b - a, zlib.crc32(own), float(log[i]), float(path.perturbed[i]),
                              float(included[i]), own if ids else None)
                    for column, value in zip(rows, values):
                        column[i].append(value)
            yield [part.column("doc_id"), [len(x) for x in rows[0]], *rows[:5], good,
                   rows[5] if ids else [None] * n]

    keyed = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(F.col("doc_id").cast("bigint")).alias("key"),
        "text",
    )
    return arrow_map(keyed, emit, OUT)


def decode(encoded: DataFrame, model_path: str, column: str = "ids") -> DataFrame:
    """doc_id and text of rows (doc_id, ids as little-endian unsigned 32-bit numbers)."""
    model = pathlib.Path(model_path).read_bytes()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        pieces = pieces_of(model, 1.0)
        for part in chunks(batches, column):
            rows = [np.frombuffer(x or b"", "<u4") for x in part.column(column).to_pylist()]
            bounds = np.cumsum([0, *map(len, rows)])
            data, places = pieces.decode(np.concatenate([np.zeros(0, np.uint32), *rows]), bounds)
            whole = data.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(places, places[1:])]
            yield [part.column("doc_id"), texts]

    chosen = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), column)
    return arrow_map(chosen, emit, "doc_id bigint, text string")
