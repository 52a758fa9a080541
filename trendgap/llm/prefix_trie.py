"""Prefix trie of conversations, built as burst tries.

A turn is named by the MD5 of its role and text and by its length, 42 hexadecimal digits, so
that texts are read once and never shuffled; a conversation is the string of its turns'
names, its path. Equal paths are one row with their number, smallest conv_id and the digest
of all their ids.

Paths start in one container under the root, and every container has a head, the node that
all its paths go through. A container that holds more than `limit` turns bursts: its paths
share some turns beyond the head (found from the smallest and the largest path alone),
which become a chain of nodes, and are dealt to containers by the turn id that follows
those. Bursting skips what all share, so every burst parts a container for sure. The rest
are sorted and swept into nodes, a container at a time; then the chains of the burst ones
are added from the last round back to the root.

Containers are counted and their smallest and largest path found with partial results
before each shuffle. Ids of a hot path are joined to long strings in key ranges first and
digested in order, string after string, so they never meet in memory. A single
conversation is never cut: a task holds about a hundred bytes a turn of its longest one.

Turns are ordered by `turn`, nulls first; ties by the digest of role and text. Null role and
text are empty. Rows without a conv_id belong to no conversation and are left out. An
empty table has no nodes, not even a root. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trendgap.llm.batches import arrow_map
from trendgap.llm.common import discard, stored

NAME = 42  # characters of a turn in a path: 32 of its digest, 10 of its length
LIMIT = 200_000  # turns of a container
EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and the names of its turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    name = F.concat(digest, F.lpad(F.lower(F.hex(F.length(text))), NAME - 32, "0"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct("turn", name.alias("name")).alias("t")
    )
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))  # of one conversation
    return ordered.select("conv_id", F.col("ts.name").alias("names"))


def rebuilt(found: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """Sequences whose first h turns are those of the first conversation of their block of
    ids, h = crc32(decimal conv_id) % (most + 1); fewer if that one has fewer. The
    remainder of a negative id has its sign, as in SQL."""
    found = stored(found, "sequences")
    heads = found.where(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("first"), F.slice("names", 1, most).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    none = F.array().cast("array<string>")
    joined = found.withColumn("first", F.expr(f"conv_id - conv_id % {block}")).join(heads, "first", "left")
    return joined.select(
        "conv_id",
        F.concat(
            F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("names", h + 1, F.size("names"))
        ).alias("names"),
    )


PATHS = "path string, n bigint, conv_id bigint, ends_sha256 string"


def distinct_paths(found: DataFrame) -> DataFrame:
    """Columns of PATHS: every different path, how many conversations it has, the smallest
    of their ids, and the SHA-256 of all their ids in order, joined by commas."""
    paths = found.select("conv_id", F.array_join("names", "").alias("path"))
    paths = paths.withColumn("key", F.md5(F.col("path").cast("binary")))

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for part in batches:
            if not part.num_rows:
                continue
            keys = part.column("key").to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            ids = part.column("conv_id").to_pylist()
            edges = [*begins.tolist(), len(ids)]
            groups = [ids[a:b] for a, b in zip(edges, edges[1:])]
            first = part.take(pa.array(begins))
            yield [
                first.column("key"), first.column("path"), [g[0] for g in groups],
                [len(g) for g in groups], [",".join(map(str, g)) for g in groups],
            ]

    parts = arrow_map(
        paths.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id"),
        join_ids, "key string, path string, conv_id bigint, n bigint, ids string",
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        key, path, n, smallest, sha = None, "", 0, 0, hashlib.sha256()
        done: list[tuple] = []
        for part in batches:
            columns = (part.column(c).to_pylist() for c in ("key", "path", "conv_id", "n", "ids"))
            for k, p, first, count, ids in zip(*columns):
                if k == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        done.append((path, n, smallest, sha.hexdigest()))
                    key, path, n, smallest, sha = k, p, 0, first, hashlib.sha256()
                n += count
                sha.update(ids.encode())
            if done:
                yield list(zip(*done))
                done = []
        if key is not None:
            yield [[path], [n], [smallest], [sha.hexdigest()]]

    return arrow_map(parts.repartition("key").sortWithinPartitions("key", "conv_id"), digest, PATHS)


BURSTS = (
    "container string, conv_id bigint, n bigint, depth int, parent_conv_id bigint, burst string, "
    "chain string"
)


def overfull(members: DataFrame, limit: int) -> DataFrame:
    """Columns of BURSTS for the containers that burst. `depth` is that of their head, and
    `chain` the path of the last node that all members go through. The one container
    under the root always bursts."""
    found = members.groupBy("container").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.first("depth").alias("depth"),
        F.first("parent_conv_id").alias("parent_conv_id"), F.first("burst").alias("burst"),
        F.min("path").alias("low"), F.max("path").alias("high"),
        F.count("*").alias("paths"), F.sum(F.length("path") / NAME).alias("turns"),
    )
    found = found.where(f"depth = 0 OR (paths > 1 AND turns > {limit})").drop("paths", "turns")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for part in batches:
            ends = zip(part.column("low").to_pylist(), part.column("high").to_pylist())
            common = [commonprefix(e) for e in ends]
            yield [*part.columns[:6], [c[: len(c) // NAME * NAME] for c in common]]

    return arrow_map(found, shared, BURSTS)


def burst(members: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(settled members, bursts) of every round, from members in one container. A burst has the digest of the ids of the
    path that ends with its chain, if there is one."""
    settled, rounds = [], []
    while True:
        bursts = stored(overfull(members, limit), "bursts")
        if bursts.isEmpty():
            discard(bursts)
            return [*settled, members], rounds
        split = members.join(
            bursts.select("container", F.col("conv_id").alias("least"), "chain"), "container", "left"
        )
        split = stored(split, "split-containers")
        ended = split.where("path = chain").select("container", "ends_sha256")
        rounds.append(stored(bursts.join(ended, "container", "left"), "burst-containers"))
        settled.append(split.where("chain IS NULL").drop("least", "chain"))
        after = F.length("chain") + NAME
        members = split.where("length(path) > length(chain)").select(
            "path", "n", "conv_id", "ends_sha256",
            F.md5(F.substring(F.col("path"), F.lit(1), after).cast("binary")).alias("container"),
            (after / NAME).cast("int").alias("depth"), F.col("least").alias("parent_conv_id"),
            F.col("container").alias("burst"),
        )


NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, turn_id string, burst string"
)


def swept(members: DataFrame) -> DataFrame:
    """Columns of NODES for all nodes of the containers, from their heads down. A head has
    the name of the burst container above it."""

    def nodes(rows: list[tuple]) -> Iterator[tuple]:
        """All nodes of one container, whose paths are sorted."""
        top, parent_conv_id, above = rows[0][5:]
        depths, parents, names, ends = [], [], [], []
        convs, counts, chars = [], [], []
        line: list[int] = []  # nodes of the last path, from the head down
        before = ""
        for path, n, conv_id, digest, *_ in rows:
            same = len(commonprefix((before, path))) // NAME if before else top - 1
            del line[same - top + 1 :]
            for depth in range(same + 1, len(path) // NAME + 1):
                name = path[(depth - 1) * NAME : depth * NAME]
                parents.append(line[-1] if line else -1)
                line.append(len(depths))
                depths.append(depth)
                names.append(name[:32])
                chars.append(int(name[32:], 16))
                ends.append(EMPTY)
                convs.append(conv_id)
                counts.append(0)
            ends[line[-1]] = digest
            counts[line[-1]] += n
            convs[line[-1]] = min(conv_id, convs[line[-1]])
            before = path
        children, leaves, saved = ([0] * len(depths) for _ in range(3))
        for i in reversed(range(len(depths))):  # children come after their parents
            saved[i] += (counts[i] - 1) * chars[i]
            leaves[i] = leaves[i] or 1
            if (up := parents[i]) >= 0:
                counts[up] += counts[i]
                convs[up] = min(convs[up], convs[i])
                children[up] += 1
                leaves[up] += leaves[i]
                saved[up] += saved[i]
        for i, up in enumerate(parents):
            yield (
                convs[i], depths[i], convs[up] if up >= 0 else parent_conv_id, counts[i],
                children[i], leaves[i], saved[i], ends[i], names[i], above if up < 0 else None,
            )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        wanted = ("path", "n", "conv_id", "ends_sha256", "container", "depth", "parent_conv_id", "burst")
        held: list[tuple] = []
        name, done = None, []
        for part in batches:
            for path, n, conv_id, digest, container, *rest in zip(*(part.column(c).to_pylist() for c in wanted)):
                if container != name and held:
                    done.extend(nodes(held))
                    held = []
                    if len(done) > 10_000:
                        yield list(zip(*done))
                        done = []
                name = container
                held.append((path, n, conv_id, digest, container, *rest))
        if held:
            done.extend(nodes(held))
        if done:
            yield list(zip(*done))

    return arrow_map(members.repartition("container").sortWithinPartitions("container", "path"), sweep, NODES)


def chains(bursts: DataFrame, below: DataFrame) -> DataFrame:
    """Columns of NODES for the chains of one round of bursts. `below` has, for the heads of
    the containers that they burst into: burst, n_leaves, saved_tokens."""
    sums = below.groupBy("burst").agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"),
    )
    joined = bursts.join(sums.withColumnRenamed("burst", "container"), "container", "left")
    wanted = (
        "chain", "depth", "conv_id", "n", "parent_conv_id", "burst", "ends_sha256", "n_children",
        "n_leaves", "saved_tokens",
    )

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for part in batches:
            done: list[tuple] = []
            for chain, head, conv_id, n, parent, above, digest, children, leaves, saved in zip(
                *(part.column(c).to_pylist() for c in wanted)
            ):
                children, leaves, saved = children or 0, leaves or 1, saved or 0
                for depth in range(len(chain) // NAME, head - 1, -1):
                    name = chain[max(0, depth - 1) * NAME : depth * NAME]
                    saved += (n - 1) * int(name[32:] or "0", 16)
                    done.append((
                        conv_id, depth, parent if depth == head else conv_id, n, children, leaves, saved,
                        digest or EMPTY, name[:32] or None, above if depth == head else None,
                    ))
                    children, digest = 1, None
            if done:
                yield list(zip(*done))

    return arrow_map(joined.select(*wanted), nodes, NODES)


def prefix_trie(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Every node of the trie of the sequences (conv_id, names), as NODES without `burst`:
    smallest member, depth, its parent's smallest member, members, children, childless
    nodes below or at it, characters saved below and at it by storing a turn once, digest
    of the ids of the conversations that end there, and the digest of its last turn."""
    paths = distinct_paths(found).select(
        "*", F.lit("").alias("container"), F.lit(0).alias("depth"),
        F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(None).cast("string").alias("burst"),
    )
    paths = stored(paths, "paths")
    settled, rounds = burst(paths, limit)
    members = settled[0]
    for more in settled[1:]:
        members = members.unionByName(more)
    nodes = stored(swept(members), "swept-nodes")
    heads = nodes.where("burst IS NOT NULL").select("burst", "n_leaves", "saved_tokens")
    for bursts in reversed(rounds):
        chain = stored(chains(bursts, heads), "chains")
        heads = heads.unionByName(
            chain.where("burst IS NOT NULL").select("burst", "n_leaves", "saved_tokens")
        )
        nodes = nodes.unionByName(chain)
    return nodes.drop("burst")
