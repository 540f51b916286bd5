"""A trie of conversations: every different beginning of them is a node.

A conversation is its path: a mark of 24 bytes per turn, a digest of role and text and the length of the text.
In the order of paths each subtree is one stretch. Paths are cut into shards in that order; a shard encodes its
part of the trie as balanced parentheses and reads all figures of a subtree from cumulative arrays between a
node's parentheses. What a shard shares with its neighbours is a beginning of its first and of its last path,
the spines; figures of these few nodes are added up over shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from minutary.llm.batches import map_arrow
from minutary.llm.parens import Parens, least_between
from minutary.session import settle

MARK_BYTES = 24
KEY_BYTES = 16
ROOT_KEY = bytes(KEY_BYTES)
TURNS_PER_PART = 1 << 21
TURNS_PER_SHARD = 1 << 17
NO_ENDS = hashlib.sha256(b"").hexdigest()
FINAL, SHARED, PIECE = 0, 1, 2

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_ROWS = f"{NODE}, kind int, shard long, key binary, parent_key binary, first_id long, ids string"
NAMES = [field.split()[0] for field in NODE.split(", ")]


# ---- paths ----


def mark() -> Column:
    """24 bytes for a turn: half of a SHA-256 of its role and text, and the bytes of its text."""
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    digest = F.substring(F.unhex(F.sha2(said, 256)), 1, 16)
    return F.concat(digest, F.unhex(F.lpad(F.hex(F.octet_length("text").cast("long")), 16, "0")))


def marked(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, mark) of turns that have a conversation; a null role or text counts as empty."""
    filled = {name: F.coalesce(F.col(name), F.lit("")) for name in ("role", "text")}
    known = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text").withColumns(filled)
    return known.select("conv_id", "turn", mark().alias("mark"))


def _path(marks: Column) -> Column:
    return F.unhex(F.array_join(F.transform(marks, F.hex), ""))


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path) of the conversations as they are."""
    return _gathered(marked(turns), ["conv_id"]).select("conv_id", _path(F.col("marks")).alias("path"))


def _gathered(marks: DataFrame, keys: list[str]) -> DataFrame:
    """The marks of each conversation in order of turns, those without a number first; turns of
    the same number go by mark. A conversation is one row of 24 bytes per turn."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "mark")))
    return marks.groupBy(*keys).agg(F.transform(ordered, lambda each: each["mark"]).alias("marks"))


def shared_start_paths(turns: DataFrame, of: int = 5, starts: int = 9) -> DataFrame:
    """(conv_id, path) after each conversation c begins as conversation c - c % `of` does: with the first h
    turns of that one, h being the crc32 of c modulo `starts`, and its own from there on.

    The conversations that share a start lie in one partition, so marks are shuffled once.
    """
    base = (F.col("conv_id") - F.col("conv_id") % of).alias("base")
    placed = marked(turns).select(base, "conv_id", "turn", "mark").repartition("base")
    family = Window.partitionBy("base")
    head = F.when(F.col("conv_id") == F.col("base"), F.slice("marks", 1, starts - 1))
    own = _gathered(placed, ["base", "conv_id"]).withColumn("head", F.max(head).over(family))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % starts).cast("int")
    none = F.array().cast("array<binary>")
    borrowed = F.coalesce(F.slice("head", F.lit(1), h), none)
    return own.select("conv_id", _path(F.concat(borrowed, F.slice("marks", h + 1, F.size("marks")))).alias("path"))


# ---- shards ----


class Shard(NamedTuple):
    """Rows of one stretch, and the paths right before and after it, if there are any."""

    number: int
    before: bytes | None
    paths: list[bytes]
    ids: list[int]
    after: bytes | None


def _cut(batches: Iterator[pa.RecordBatch], turns: int) -> Iterator[Shard]:
    """Shards of about `turns` turns from rows in order of (part, side, path, conv_id), where side 0 is
    the path before a part and side 2 the path after it."""
    part, number, size = None, 0, 0
    before: bytes | None = None
    held, ids = [], []

    def shard(after: bytes | None) -> Shard:
        return Shard((part << 32) + number, before, held, ids, after)

    for batch in batches:
        for own, side, path, conv in zip(*[batch.column(name).to_pylist() for name in ("part", "side", "path", "conv_id")]):
            if own != part:
                if held:
                    yield shard(None)
                part, number, size, before, held, ids = own, 0, 0, None, [], []
            if side == 0:
                before = path
                continue
            if held and (side == 2 or size >= turns):
                yield shard(path)
                number, size, before, held, ids = number + 1, 0, held[-1], [], []
            if side == 1:
                held.append(path)
                ids.append(conv)
                size += len(path) // MARK_BYTES + 1
    if held:
        yield shard(None)


def _marks(path: bytes) -> np.ndarray:
    return np.frombuffer(path, dtype=">u8").reshape(-1, 3)


def _in_common(a: bytes | None, b: bytes | None) -> int:
    """Turns with which both begin; -1 if one is not there, as then not even the root is shared."""
    if a is None or b is None:
        return -1
    size = min(len(a), len(b))
    differ = (_marks(a[:size]) != _marks(b[:size])).any(axis=1)
    return int(differ.argmax()) if differ.any() else size // MARK_BYTES


def _counted(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes laid end to end, each place's run and place within it."""
    run = np.repeat(np.arange(len(size)), size)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)


def _neighbours_in_common(marks: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each path, turns in common with the one before (0 for the first)."""
    found = np.minimum(sizes, np.append(0, sizes[:-1]))
    path, at = _counted(found)
    differ = (marks[firsts[path] + at] != marks[firsts[path - 1] + at]).any(axis=1)
    np.minimum.at(found, path[differ], at[differ])
    return found


def _spine_keys(path: bytes, depth: int) -> list[bytes]:
    """Keys of the nodes of a path down to `depth`: each from its parent's and its turn's mark."""
    keys = [ROOT_KEY]
    for at in range(depth):
        keys.append(hashlib.sha256(keys[-1] + path[at * MARK_BYTES : (at + 1) * MARK_BYTES]).digest()[:KEY_BYTES])
    return keys


def _ends_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def encode(shard: Shard) -> dict:
    """Columns of `_ROWS`: the nodes of a shard; shared ones have a key and only what this shard adds."""
    # Equal paths stand together: one end each.
    new = [at for at, path in enumerate(shard.paths) if at == 0 or path != shard.paths[at - 1]]
    different = [shard.paths[at] for at in new]
    ends_at = [*new[1:], len(shard.paths)]
    sizes = np.array([len(path) // MARK_BYTES for path in different])
    firsts = np.cumsum(sizes) - sizes
    marks = _marks(b"".join(different))
    common = _neighbours_in_common(marks, firsts, sizes)
    opened = sizes - common

    # Parentheses: the root's, then for each path those that end and those that begin.
    closed = np.append(np.append(0, sizes[:-1] - common[1:]), sizes[-1] + 1)
    runs = np.empty(2 * len(sizes) + 2, dtype=np.int64)
    runs[0], runs[1::2], runs[2::2] = 1, closed, opened
    tree = Parens(np.repeat(np.arange(len(runs)) % 2 == 0, runs))

    # Nodes in preorder, the root first.
    path, at = _counted(opened)
    depth = np.append(0, common[path] + at + 1)
    text_bytes = np.append(0, marks[firsts[path] + common[path] + at, 2]).astype(np.int64)
    count = len(depth)
    end_node = np.where(opened > 0, np.cumsum(opened), 0)
    ended, low = np.zeros(count, dtype=np.int64), np.full(count, np.iinfo(np.int64).max)
    ended[end_node] = np.diff([*new, len(shard.paths)])
    low[end_node] = [shard.ids[start] for start in new]
    by_depth = np.sort(depth * count + np.arange(count))
    parent = by_depth[np.searchsorted(by_depth, (depth - 1) * count + np.arange(count)) - 1] % count
    parent[0] = -1

    # The part of the first path that earlier shards have too, and of the last that later ones have.
    left, right = _in_common(shard.before, different[0]), _in_common(different[-1], shard.after)
    keys: list[bytes | None] = [None] * count
    for node, key in enumerate(_spine_keys(different[0], left) if left >= 0 else []):
        keys[node] = key
    for down, key in enumerate(_spine_keys(different[-1], right) if right >= 0 else []):
        keys[int(by_depth[np.searchsorted(by_depth, (down + 1) * count) - 1] % count)] = key
    owned = np.arange(count) > left

    closes = tree.find_close()
    until = np.arange(count) + (closes - tree.opens + 1) // 2
    if right == sizes[-1]:  # it goes on in the next shard, or its last copy is there
        tree.leaves[tree.opens[end_node[-1]]] = False
    leaf_rank = tree.leaf_rank()

    def within(values: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(values))
        return sums[until] - sums[:count]

    n_convs = within(ended)
    conv = least_between(low, np.arange(count), until)
    digests = [NO_ENDS] * count
    pieces = []
    for node, start, end in zip(end_node.tolist(), new, ends_at):
        if keys[node] is None:
            digests[node] = _ends_digest(shard.ids[start:end])
        else:
            pieces.append((keys[node], shard.ids[start], ",".join(map(str, shard.ids[start:end]))))

    shared = np.array([key is not None for key in keys])
    under_shared = np.append(False, shared[parent[1:]])
    parent_conv = [None if at < 0 or hidden else int(conv[at]) for at, hidden in zip(parent.tolist(), under_shared)]
    more, none = len(pieces), [None] * len(pieces)
    zeros = [0] * more
    return {
        "conv_id": [*conv.tolist(), *none],
        "depth": [*depth.tolist(), *none],
        "parent_conv_id": [*parent_conv, *none],
        "n_convs": [*n_convs.tolist(), *zeros],
        "n_children": [*np.bincount(parent[1:][owned[1:]], minlength=count).tolist(), *zeros],
        "n_leaves": [*(leaf_rank[closes] - leaf_rank[tree.opens]).tolist(), *zeros],
        "saved_tokens": [*within(text_bytes * n_convs - text_bytes * owned).tolist(), *zeros],
        "ends_sha256": [*digests, *none],
        "kind": [*np.where(shared, SHARED, FINAL).tolist(), *[PIECE] * more],
        "shard": [shard.number] * (count + more),
        "key": [*keys, *[key for key, _, _ in pieces]],
        "parent_key": [*[keys[at] if hidden else None for at, hidden in zip(parent.tolist(), under_shared)], *none],
        "first_id": [*[None] * count, *[first for _, first, _ in pieces]],
        "ids": [*[None] * count, *[ids for _, _, ids in pieces]],
    }


def _parts(paths: DataFrame, turns: int, partitions: int) -> DataFrame:
    """(part, side, path, conv_id): paths in ranges of about equal size, each with the last path before it and the
    first after it. A path of very many copies is several ranges, as ids go into the order."""
    placed = settle(paths.repartitionByRange(partitions, "path", "conv_id").withColumn("part", F.spark_partition_id().cast("long")))
    # One row per range.
    bounds = placed.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    row = Window.orderBy("part")
    beside = bounds.select("part", F.lag("last").over(row).alias("before"), F.lead("first").over(row).alias("after"))
    guards = [
        beside.filter(F.col(name).isNotNull()).select("part", F.lit(side).alias("side"), F.col(name).alias("path"))
        for side, name in ((0, "before"), (2, "after"))
    ]
    rows = placed.select("part", F.lit(1).alias("side"), "path", "conv_id")
    every = rows.unionByName(guards[0].unionByName(guards[1]), allowMissingColumns=True)
    return every.repartition(partitions, "part").sortWithinPartitions("part", "side", "path", "conv_id")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Hash the pieces of each key one after the other, as they come sorted."""
    key, digest = None, None
    for batch in batches:
        done = []
        for own, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if own != key:
                done += [(key, digest.hexdigest())] if digest else []
                key, digest = own, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield {"key": [pair[0] for pair in done], "ends": [pair[1] for pair in done]}
    if digest:
        yield {"key": [key], "ends": [digest.hexdigest()]}


def nodes(paths: DataFrame, turns_per_shard: int = TURNS_PER_SHARD) -> DataFrame:
    """Per node of the trie of `paths` (conv_id, path), from the textless root of depth 0: conv_id, the smallest
    member; depth; parent_conv_id, the parent's smallest member (null for the root); n_convs, members;
    n_children; n_leaves, childless nodes in the subtree; saved_tokens, over the subtree the bytes of each node's
    text for every member but one; ends_sha256, of the ids that end there, ascending and joined by commas.

    A conversation without turns ends at the root. Without conversations there is no node. A repeated
    (conv_id, path) is two members.
    """
    spark = paths.sparkSession
    paths = settle(paths)
    turns = paths.agg(F.sum(F.octet_length("path") / MARK_BYTES + 1)).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(turns) // TURNS_PER_PART + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for shard in _cut(batches, turns_per_shard):
            yield encode(shard)

    found = settle(map_arrow(_parts(paths, turns_per_shard, partitions), run, _ROWS))
    partial = found.filter(F.col("kind") == SHARED)
    pieces = found.filter(F.col("kind") == PIECE).select("key", "first_id", "ids")
    sorted_pieces = pieces.repartition("key").sortWithinPartitions("key", "first_id")
    ends = map_arrow(sorted_pieces, _digests, "key binary, ends string")
    sums = [F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.min(name).alias(name) for name in ("conv_id", "depth", "parent_key")]
    merged = settle(
        partial.groupBy("key").agg(*same, *sums).join(ends, "key", "left")
        .withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS)))
    )
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    spine = merged.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("_parent")).select(*NAMES)
    # A node right below a spine looks its parent up by shard, so that no key has more rows than a shard.
    by_shard = partial.select("shard", F.col("key").alias("parent_key")).join(parents, "parent_key")
    final = found.filter(F.col("kind") == FINAL)
    below = final.filter("parent_key IS NOT NULL").join(by_shard, ["shard", "parent_key"])
    below = below.withColumn("parent_conv_id", F.col("_parent")).select(*NAMES)
    return final.filter("parent_key IS NULL").select(*NAMES).unionByName(below).unionByName(spine)
