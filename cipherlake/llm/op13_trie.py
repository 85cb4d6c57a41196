"""Prefix trie of conversations, in balanced parentheses.

A conversation is a path of turns; a turn is a 128-bit digest of role and text, so texts are read once and not exchanged.
Paths are sorted across the cluster and cut into shards of neighbours, so a subtree lies in one shard or in a few that
follow each other. A shard writes its part of the trie as balanced parentheses (a node is "(", its children, ")") with
blocks that keep the least and greatest excess of opening ones. Finding the closing parenthesis of a node then skips whole
blocks and delimits the subtree; ranks of "()" before its two ends count its leaves, and differences of running sums over
nodes in preorder give its conversations and what sharing saves.

Only nodes on a shard's first or last path can have parts in other shards. These spines are written with partial counts and
merged by the digest of the path; what a spine node adds to its ancestors after the merge runs up one of the paths it lies
on. Identical conversations are split between shards like others, so a group of any size is no task's burden; memory of
a task is its shard and the longest conversation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.llm.common import cut

SHARD_TURNS = 1_000_000
BLOCK, FAN = 256, 64


def turn_digest(role: Column, text: Column) -> Column:
    """Hex digest of a turn; null counts as empty."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): each conversation's turns as (turn, digest, bytes of text), by turn (null first), equal turns by
    digest. Rows without a conversation id are left out; rows equal in all of these are turns of their own."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one = F.struct(F.col(turn_col).alias("turn"), turn_digest(F.col(role_col), F.col(text_col)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), one.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))


class Parentheses:
    """Balanced parentheses with range min-max blocks of the excess, in two levels."""

    def __init__(self, bits: np.ndarray):
        self.excess = np.cumsum(np.where(bits, 1, -1))
        self.least, self.greatest = self._levels(np.minimum), self._levels(np.maximum)
        self.opens = np.concatenate([[0], np.cumsum(bits)])  # rank of "(" before a place

    def _levels(self, pick: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.excess)
        low = pick.reduceat(self.excess, np.arange(0, n, BLOCK)) if n else np.empty(0, np.int64)
        return low, pick.reduceat(low, np.arange(0, len(low), FAN)) if n else low

    def findclose(self, at: int) -> int:
        """Place of the parenthesis that closes the one at `at`: the first later place of an excess smaller by one than
        after the opening."""
        want, block = int(self.excess[at]) - 1, at // BLOCK
        end = (block + 1) * BLOCK
        inside = self.excess[at + 1 : end] == want
        if inside.any():
            return at + 1 + int(inside.argmax())
        return self._first(self._next(block, want), want)

    def _next(self, block: int, want: int) -> int:
        """First later block whose range holds the excess."""
        stop = (block // FAN + 1) * FAN
        near = (self.least[0][block + 1 : stop] <= want) & (self.greatest[0][block + 1 : stop] >= want)
        if near.any():
            return block + 1 + int(near.argmax())
        top = block // FAN + 1
        top += int(((self.least[1][top:] <= want) & (self.greatest[1][top:] >= want)).argmax())
        part = slice(top * FAN, (top + 1) * FAN)
        return top * FAN + int(((self.least[0][part] <= want) & (self.greatest[0][part] >= want)).argmax())

    def _first(self, block: int, want: int) -> int:
        return block * BLOCK + int((self.excess[block * BLOCK : (block + 1) * BLOCK] == want).argmax())


class Shard(NamedTuple):
    """A part of the trie, nodes in preorder."""

    bits: np.ndarray
    place: np.ndarray  # of the node's "("
    depth: np.ndarray
    parent: np.ndarray  # -1 for the root
    size: np.ndarray  # bytes of the last text
    ends: np.ndarray  # conversations that end at the node
    least: np.ndarray  # smallest conversation of the subtree
    key: list[bytes]  # digest of the path
    spine: np.ndarray  # 1: on the first path, 2: on the last, 3: on both


def build(rows: Iterator[tuple[int, list[str], list[int]]]) -> Shard | None:
    """The part of the trie of conversations that come in the order of their paths."""
    bits, place, depth, parent, size, ends, least, key = [True], [0], [0], [-1], [0], [0], [None], [hashlib.md5().digest()]
    stack, hashes, before, first = [0], [hashlib.md5()], [], None

    def pop() -> None:
        v = stack.pop()
        hashes.pop()
        bits.append(False)
        up = parent[v]
        if up >= 0:
            least[up] = least[v] if least[up] is None else min(least[up], least[v])

    for conv, path, texts in rows:
        same = 0
        while same < len(path) and same < len(before) and path[same] == before[same]:
            same += 1
        while len(stack) > same + 1:
            pop()
        for d in range(same, len(path)):
            h = hashes[-1].copy()
            h.update(path[d].encode())
            place.append(len(bits))
            bits.append(True)
            depth.append(d + 1)
            parent.append(stack[-1])
            size.append(texts[d])
            ends.append(0)
            least.append(None)
            key.append(h.digest())
            stack.append(len(depth) - 1)
            hashes.append(h)
        v = stack[-1]
        ends[v] += 1
        least[v] = conv if least[v] is None else min(least[v], conv)
        first = first or list(stack)
        before = path
    if first is None:
        return None
    last = list(stack)
    while stack:
        pop()
    spine = np.zeros(len(depth), np.int8)
    spine[first] |= 1
    spine[last] |= 2
    numbers = (np.array(x, np.int64) for x in (place, depth, parent, size, ends, least))
    return Shard(np.array(bits), *numbers, key, spine)


def counted(shard: Shard) -> pd.DataFrame:
    """Counts of each node's part in the shard. What spine nodes themselves add is left out of leaves and savings, and
    children on spines out of children: it is known after the merge only."""
    tree, inner = Parentheses(shard.bits), shard.spine == 0
    close = np.array([tree.findclose(int(p)) for p in shard.place], np.int64)
    v, end = tree.opens[shard.place], tree.opens[close]  # the subtree's nodes in preorder
    leaf_pairs = np.zeros(len(shard.bits) + 1, np.int64)
    pairs = shard.place[~shard.bits[shard.place + 1] & inner]
    leaf_pairs[pairs + 1] = 1
    leaf_pairs = np.cumsum(leaf_pairs)  # rank of "()" before a place
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    convs = sums(shard.ends)
    n_convs = convs[end] - convs[v]
    saved = sums(np.where(inner, (n_convs - 1) * shard.size, 0))
    children = np.bincount(shard.parent[inner], minlength=len(v))  # inner nodes have parents
    hidden = shard.parent >= 0
    hidden[hidden] = shard.spine[shard.parent[hidden]] > 0
    known = np.where(hidden | (shard.parent < 0), 0, shard.least[shard.parent])
    return pd.DataFrame({"conv_id": shard.least, "depth": shard.depth, "bytes": shard.size, "n_convs": n_convs, "n_children": children, "n_leaves": leaf_pairs[close] - leaf_pairs[shard.place],
                         "saved": saved[end] - saved[v], "parent_conv_id": pd.array(known, "Int64"), "key": shard.key,
                         "parent_key": [shard.key[p] if h else None for p, h in zip(shard.parent, hidden, strict=True)], "side": shard.spine})


_ROW = "shard int, side int, conv_id long, depth long, bytes long, n_convs long, n_children long, n_leaves long, saved long, parent_conv_id long, key binary, parent_key binary"
_NODE = ("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def _shards(sorted_paths: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = build((int(c), list(p), list(t)) for b in batches for c, p, t in zip(b["conv"], b["path"], b["bytes"], strict=True))
        if shard is None:
            return
        out = counted(shard).assign(shard=TaskContext.get().partitionId())
        both = out[out["side"] == 3].assign(side=2, n_convs=0, n_children=0, n_leaves=0, saved=0)  # such a node is on two paths, but counts once
        out = pd.concat([out.assign(side=np.where(out["side"] == 3, 1, out["side"])), both])
        for at in range(0, len(out), 50_000):
            yield out.iloc[at : at + 50_000][[c.split()[0] for c in _ROW.split(", ")]]

    return sorted_paths.mapInPandas(run, _ROW)


def _merged(spines: DataFrame) -> DataFrame:
    """Nodes of the spines as a whole, with the key of the parent."""
    whole = spines.groupBy("key", "parent_key", "depth", "bytes").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.min(F.struct("shard", "side")).alias("owner"))
    on_spines = whole.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    whole = cut(whole.join(on_spines, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"))
    # what a node adds to itself and its ancestors runs up the path of its owner
    adds = whole.select("owner", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    rows = spines.select(F.struct("shard", "side").alias("owner"), "depth", "key").join(adds, ["owner", "depth"], "left")
    up = Window.partitionBy("owner").orderBy(F.col("depth").desc())
    rows = rows.select("key", *[F.sum(F.coalesce(c, F.lit(0))).over(up).alias(c) for c in ("leaf", "own")])
    rows = rows.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    return whole.join(rows, "key").select("key", "parent_key", "conv_id", "depth", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
                                          (F.col("saved") + F.col("own")).alias("saved_tokens"))


def path_key(path: Column) -> Column:
    """Digest of a path of turn digests."""
    return F.unhex(F.md5(F.array_join(path, "")))


def trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of (conv, path of digests, bytes of each turn's text), one row per node:

    key (digest of the path), conv_id (smallest conversation through the node), depth, parent_conv_id (null for the root),
    n_convs (conversations through it), n_children, n_leaves (childless nodes of its subtree, itself included) and
    saved_tokens (bytes of last texts times conversations beyond the first, summed over the subtree). Conversations
    without turns end at the root. An empty table has no root. `conv` is taken as unique."""
    stored = cut(sequences.select("conv", "path", "bytes"))
    turns = stored.agg(F.sum(F.size("path") + 1)).first()[0] or 0
    shards = max(int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    ranged = stored.repartitionByRange(shards, "path", "conv").sortWithinPartitions("path", "conv")
    parts = cut(_shards(ranged))
    whole = cut(_merged(parts.where("side > 0").drop("parent_conv_id")))
    names = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    inner = parts.where("side = 0").withColumnRenamed("saved", "saved_tokens")
    below = inner.where(F.col("parent_key").isNotNull()).drop("parent_conv_id").join(names, "parent_key").withColumnRenamed("parent", "parent_conv_id")
    spine = whole.join(names, "parent_key", "left").withColumnRenamed("parent", "parent_conv_id")
    return inner.where(F.col("parent_key").isNull()).select(*_NODE).unionByName(below.select(*_NODE)).unionByName(spine.select(*_NODE))


def ends(sequences: DataFrame) -> DataFrame:
    """(key, conv): the node at which each conversation ends."""
    return sequences.select(path_key(F.col("path")).alias("key"), "conv")


def id_digests(ended: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ascending decimal ids that end at a node, joined by commas. Ids are sorted by
    Spark and streamed through the hash, so a node of very many ids is read in bounded memory."""
    sorted_ = ended.repartition("key").sortWithinPartitions("key", "conv")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, h = None, None
        for b in batches:
            keys, convs = b["key"].tolist(), b["conv"].tolist()
            done, at = [], 0
            while at < len(keys):
                to = at
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if keys[at] != key:
                    if h is not None:
                        done.append((key, h.hexdigest()))
                    key, h = keys[at], hashlib.sha256()
                else:
                    h.update(b",")
                h.update(",".join(map(str, convs[at:to])).encode())
                at = to
            yield pd.DataFrame(done, columns=["key", "ends_sha256"])
        if h is not None:
            yield pd.DataFrame([(key, h.hexdigest())], columns=["key", "ends_sha256"])

    return sorted_.mapInPandas(run, "key binary, ends_sha256 string")
