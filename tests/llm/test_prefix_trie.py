"""Prefix tries against a trie built turn by turn."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from trendgap.llm.prefix_trie import prefix_trie, rebuilt, sequences

SCHEMA = StructType([
    StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()),
    StructField("text", StringType()),
    # Names that the operator uses for columns of its own.
    StructField("path", StringType()), StructField("n", StringType()), StructField("names", LongType()),
])


def remainder(a, b):
    return a - b * int(a / b)


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def own_turns(rows):
    """Turns of every conversation, in order."""
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            found.setdefault(c, []).append((turn, role or "", text or ""))
    for turns in found.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, digest(*t[1:]), f"{len(t[2]):010x}"))
    return {c: [t[1:] for t in turns] for c, turns in found.items()}


def heads_replaced(found):
    out = {}
    for c, turns in found.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = found.get(c - remainder(c, 100), [])[:h] + turns[h:]
    return out


def plainly(found):
    members = {}
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        stack, out = [node], []
        while stack:
            x = stack.pop()
            out.append(x)
            stack += children.get(x, [])
        return out

    rows = []
    for node, cs in members.items():
        subtree = below(node)
        ends = ",".join(str(c) for c in sorted(cs) if len(found[c]) == len(node))
        rows.append((
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children.get(node, [])),
            sum(x not in children for x in subtree),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in subtree if x),
            hashlib.sha256(ends.encode()).hexdigest(), digest(*node[-1]) if node else None,
        ))
    return sorted(map(repr, rows))


def talk(seed, conversations, turns, texts):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 5000), conversations):
        rows += [
            (c, rng.choice([None, k, k, k]), rng.choice(["user", "assistant", None, ""]),
             rng.choice([None, "", *(f"tä{j}" for j in range(texts))]))
            for k in range(rng.randint(1, turns))
        ]
    return rows + [(None, 1, "user", "no conversation"), (None, None, None, None)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", "n", 3) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("limit,shape", [(7, (1, 150, 6, 1)), (200_000, (2, 200, 4, 3)), (40, (3, 40, 12, 2))])
def test_prefix_trie(spark, limit, shape):
    rows = talk(*shape)
    df = table(spark, rows)
    found = own_turns(rows)
    got = prefix_trie(sequences(df), limit)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plainly(found)
    if limit == 200_000:
        got = prefix_trie(rebuilt(sequences(df)), limit)
        assert sorted(repr(tuple(r)) for r in got.collect()) == plainly(heads_replaced(found))


def test_long_shared_beginnings_and_copies(spark):
    """A long chain above a burst, a third of equal conversations, one that ends inside."""
    opening = [("user" if k % 2 else "assistant", f"turn {k}") for k in range(60)]
    found = {k: opening + [("user", f"own {k % 7}"), ("user", f"end {k}")] for k in range(90)}
    found |= {k: opening + [("user", "same")] for k in range(100, 145)}
    found |= {200: opening, 201: opening[:20], 202: [], 203: [("user", "x" * 300_000)]}
    rows = [(c, k, *t) for c, turns in found.items() for k, t in enumerate(turns)]
    del found[202]  # no row, no conversation
    got = prefix_trie(sequences(table(spark, rows)), 200).collect()
    assert sorted(repr(tuple(r)) for r in got) == plainly(found)


def test_empty_and_turnless(spark):
    assert prefix_trie(sequences(table(spark, []))).isEmpty()
    # Conversation 1 takes the only turn of conversation 0 and has none of its own left.
    for c in (3, 6):
        rows = [(100 + c, 0, "user", "a")]
        got = prefix_trie(rebuilt(sequences(table(spark, rows)))).collect()
        assert sorted(repr(tuple(r)) for r in got) == plainly(heads_replaced(own_turns(rows)))
