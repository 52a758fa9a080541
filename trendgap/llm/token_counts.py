"""Token counts from a tokenizer compiled into a finite-state transducer.

A SentencePiece BPE model is turned into a deterministic transducer over UTF-8 bytes. A
state remembers the longest end of the text that still can grow into a piece, and, for
every place inside it, the last token of the encoding up to there and the difference in
count. A transition reads one byte and is annotated with the number of tokens that the
encoding grows by (it can shrink). States are made when first met and kept per Python
worker; when a table passes MAX_STATES it starts again, so memory is bounded.

Why a state is enough: in a BPE encoding every two neighbours are an encoding of their
own joined text, and of all tokens that end at a place only one continues a valid
encoding. Runs of blanks follow their own rule (their merges come last) and a blank after
another character always begins a token, whatever came before.

A chunk of the input is cut into lanes of equal length. Each lane is first run from an
unknown state, which every blank resolves: its state map is then constant, the end state
and the count after the first blank. The maps are composed from left to right by a scan
that hands each lane the end state of the lane before it; the head of the lane, up to its
first blank, is run from there. Lanes without any blank have no constant map and take
one further round each.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from trendgap.llm.batches import Texts, map_texts, row_sums

LANE = 128
MAX_STATES = 120_000
MAX_PAIRS = 300_000
BLANK = "▁"
DEAD = "\0"  # no token can begin at this place any more
BEGIN = 0xFF  # stands before every text; no UTF-8 text holds this byte
SHIFT, OFFSET = 6, 32  # a transition is packed as next state and emitted count

# The first states. The unknown ones wait for a blank after another character.
AFTER_OTHER, AFTER_BLANK, FIRST_RUN = 0, 1, 2
LONGEST_RUN = 32


class Transducer:
    """Transitions of one model, made on demand."""

    def __init__(self, model: bytes) -> None:
        self.model = model
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.score = {
            sp.id_to_piece(i): sp.get_score(i)
            for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))
        }
        self.extensions: dict[str, list[str]] = {}
        for piece in self.score:
            for n in range(1, len(piece)):
                self.extensions.setdefault(piece[:n], []).append(piece)
        mixed = [p for p in self.score if BLANK in p[1:] and set(p) != {BLANK}]
        if mixed:
            raise ValueError(f"pieces with a blank inside are not supported: {mixed[:3]}")
        one = len(sp.encode("a"))
        if one != len(sp.encode("a a")) - 1 or sp.encode(""):
            raise ValueError("the model does not put a blank before each text")
        # The text of n blanks gets one more in front.
        self.run = [0, 1, *(len(sp.encode(" " * n)) for n in range(1, LONGEST_RUN))]
        longer = len(sp.encode(" " * (LONGEST_RUN + 16)))
        if longer != len(sp.encode(" " * LONGEST_RUN)) + 1:
            raise ValueError("runs of blanks do not repeat after 16")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.kept: dict[tuple[str, str], str | None] = {}
        self.split: dict[str, tuple[str, str] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.pairs.clear()
        self.kept.clear()
        self.keys: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.table = np.full(1024 * 256, -1, np.int32)
        for key in (("wait", 0), ("wait", 1), *(("run", n) for n in range(1, LONGEST_RUN + 1))):
            self.state(key)

    def state(self, key: tuple) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.keys)
            self.keys.append(key)
            if len(self.keys) * 256 > len(self.table):
                more = np.full(len(self.table), -1, np.int32)
                self.table = np.concatenate((self.table, more))
        return self.ids[key]

    def halves(self, token: str) -> tuple[str, str] | None:
        """The two tokens that BPE joins last when it forms `token`; None if it does not
        form it, or if it is one character."""
        if token not in self.split:
            parts = list(token)
            while len(parts) > 2:
                found = [
                    (-self.score[a + b], i)
                    for i, (a, b) in enumerate(zip(parts, parts[1:]))
                    if a + b in self.score
                ]
                if not found:
                    break
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.split[token] = tuple(parts) if len(parts) == 2 else None
        return self.split[token]

    def exists(self, token: str) -> bool:
        return token in self.score and (len(token) == 1 or self.halves(token) is not None)

    def follows(self, last: str | None, token: str) -> bool:
        """Whether `token` can stand after `last` (None: after a place nothing spans).

        The merges that made both are taken back, the latest first; the pair holds if no
        merge across the border would have been due before the one taken back."""
        if last is None:
            return self.exists(token)
        pair = (last, token)
        if pair not in self.pairs:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[pair] = self.exists(token) and self.holds(last, token)
        return self.pairs[pair]

    def holds(self, left: str, right: str) -> bool:
        rank = lambda x: -self.score[x] if len(x) > 1 else -1.0
        due = (float("inf"), 0)  # what a merge across must come before; 0 is leftmost
        while True:
            across = left + right
            if across in self.score and (-self.score[across], 1) < due:
                return False
            a, b = rank(left), rank(right)
            if a < 0 and b < 0:
                return True
            if a > b:
                due, left = (a, 0), self.halves(left)[1]
            else:  # of equal merges the left one comes first, so the border is due before
                due, right = (b, 2), self.halves(right)[0]

    def compile(self, state: int, byte: int) -> None:
        key, emitted = self.step(self.keys[state], byte)
        target = self.state(key)
        self.table[state * 256 + byte] = (target << SHIFT) | (emitted + OFFSET)

    def step(self, key: tuple, byte: int) -> tuple[tuple, int]:
        kind = key[0]
        if byte == BEGIN:
            return ("run", 1), self.run[1]
        if kind == "wait":
            if byte != 0x20:
                return ("wait", 0), 0
            return (("wait", 1), 0) if key[1] else (("run", 1), self.run[1])
        if kind == "part":
            _, held, before = key
            raw = held + bytes([byte])
            if len(raw) < 2 + (raw[0] >= 0xE0) + (raw[0] >= 0xF0):
                return ("part", raw, before), 0
            return self.read(before, raw.decode())
        if byte >= 0xC0:
            return ("part", bytes([byte]), key), 0
        if byte == 0x20:
            if kind == "run":
                n = key[1]
                if n == LONGEST_RUN:  # the same place of the next sixteen
                    return ("run", n - 15), self.run[n - 15] + 1 - self.run[n]
                return ("run", n + 1), self.run[n + 1] - self.run[n]
            return ("run", 1), self.run[1]
        return self.read(key, chr(byte))

    def read(self, key: tuple, char: str) -> tuple[tuple, int]:
        """The state after one more character that is not a blank."""
        if key[0] == "run":
            n = key[1]
            text, places = BLANK, ((None, self.run[n - 1] - self.run[n]), (BLANK, 0))
        else:
            _, text, places = key
        if char not in self.score:  # one token for each byte; nothing spans it
            return ("text", "", ((None, 0),)), len(char.encode())
        grown = text + char
        for size in range(len(grown), 0, -1):
            token = grown[-size:]
            last, count = places[-size]
            if last != DEAD and token in self.score and self.follows(None, token) and self.follows(last, token):
                break
        else:
            raise ValueError(f"no token ends {grown!r}")
        emitted = count + 1
        places = (*((t, c - emitted) for t, c in places), (token, 0))
        # Only what can matter later stays in the state, so that many prefixes share one.
        places = places[-len(grown) - 1 :]
        ends = [
            (self.relevant(grown[i:], last) if last != DEAD else DEAD, count)
            for i, (last, count) in enumerate(places[:-1])
        ]
        ends = [(last, count) if last != DEAD else (DEAD, 0) for last, count in ends]
        alive = next((i for i, (last, _) in enumerate(ends) if last != DEAD), len(grown))
        grown = grown[alive:]
        if not grown:
            return ("text", "", ((None, 0),)), emitted
        return ("text", grown, (*ends[alive:], places[-1])), emitted

    def relevant(self, rest: str, last: str | None) -> str | None:
        """What must be known of the token before a place, when `rest` stands behind it:
        DEAD if no longer token can begin there, None if every one can, else the token."""
        key = (rest, last or "")
        if key not in self.kept:
            longer = self.extensions.get(rest, ())
            found: str | None = last
            if not longer:
                found = DEAD
            elif last is not None and len(longer) <= 32:
                can = {self.follows(last, token) for token in longer}
                found = last if len(can) == 2 else None if can == {True} else DEAD
            self.kept[key] = found
        return self.kept[key]

    def walk(self, states: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One byte for many lanes: next states and emitted counts."""
        at = states * 256 + column
        packed = self.table[at]
        if len(packed) and packed.min() < 0:
            for pair in np.unique(at[packed < 0]).tolist():
                self.compile(pair >> 8, pair & 255)
            packed = self.table[at]
        return packed >> SHIFT, (packed & ((1 << SHIFT) - 1)) - OFFSET

    def emissions(self, data: np.ndarray) -> np.ndarray:
        """The emitted count at each byte; texts follow one another, BEGIN before each."""
        if len(self.keys) > MAX_STATES:
            self.reset()
        lanes = -(-len(data) // LANE)
        padded = np.full(lanes * LANE, BEGIN, np.uint8)
        padded[: len(data)] = data
        columns = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
        out = np.zeros((LANE, lanes), np.int8)
        before = np.concatenate(([0], columns[-1, :-1]))
        states = np.where((before == 0x20) | (before == BEGIN), AFTER_BLANK, AFTER_OTHER).astype(np.int64)
        heads = np.full(lanes, LANE)  # the step at which a lane leaves the unknown states
        for k in range(LANE):
            was = states
            states, out[k] = self.walk(states, columns[k])
            heads[(was < FIRST_RUN) & (states >= FIRST_RUN)] = k
        # Hand the end states on. A lane without a blank learns its end only then.
        todo = np.flatnonzero(heads > 0)
        while len(todo):
            ready = todo[states[todo - 1] >= FIRST_RUN]
            head, now = heads[ready], states[ready - 1]
            for k in range(int(head.max())):
                live = head > k
                lane = ready[live]
                now[live], out[k, lane] = self.walk(now[live], columns[k, lane])
            whole = head == LANE
            states[ready[whole]] = now[whole]
            todo = np.setdiff1d(todo, ready)
        return out.T.reshape(-1)[: len(data)]


_KEPT: dict[int, Transducer] = {}


def transducer(model: bytes) -> Transducer:
    """One per Python worker and model."""
    key = hash(model)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Transducer(model)
    return _KEPT[key]


def with_begin(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with BEGIN before every text, and where each text begins."""
    bounds = texts.starts + np.arange(len(texts) + 1)
    data = np.full(bounds[-1], BEGIN, np.uint8)
    own = np.ones(len(data), bool)
    own[bounds[:-1]] = False
    data[own] = texts.bytes
    return data, bounds


def token_counts(documents: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, bytes, tokens and whether tokens exceed `limit`, for every row.

    Null and empty texts have no bytes and no tokens. Repeated ids stay separate rows.
    """
    model = Path(model_path).read_bytes()

    def count(texts: Texts) -> dict[str, object]:
        plain = texts
        if b"\xe2\x96\x81" in texts.bytes.tobytes():  # the model's own sign for a blank
            replaced = pc.replace_substring(texts.column("text"), BLANK, " ")
            plain = Texts(pa.RecordBatch.from_arrays([replaced], ["text"]))
        data, bounds = with_begin(plain)
        found = row_sums(transducer(model).emissions(data), bounds)
        found[plain.lengths == 0] = 0
        return {
            "doc_id": texts.column("doc_id"),
            "n_bytes": texts.lengths,
            "n_tokens": found,
            "over_limit": found > limit,
        }

    return map_texts(
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"),
        count,
        "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    )
