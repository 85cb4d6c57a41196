"""Best-fit-decreasing packing into id matrices.

Documents become token ids; overlong ones are split without loss. The pieces of a block are placed from longest to
shortest; a segment tree over free space finds the fullest sequence that still has room. Each packed row holds
the ids as little-endian unsigned integers padded to the row length, the cumulative segment lengths, the positions at
which position ids start again from 0 and the pieces it is made of, so that every document can be put together again.

Shuffles: one, of the pieces with two or four bytes an id. A task packs blocks of a bounded number of ids, so its memory
doesn't depend on the input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm import tokens

CAPACITY = 2048
BLOCK_IDS = 4_000_000
ROW = ("sequence_id long, n_ids int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, "
       "pieces array<int>, starts array<long>")


class FreeSpace:
    """Segment tree over the free spaces 0..capacity; a node knows how many open sequences lie below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, bin_id: int) -> None:
        self.bins[free].append(bin_id)
        node = self.size + free
        while node:
            self.count[node] += 1
            node >>= 1

    def take_least(self, need: int) -> tuple[int, int] | None:
        """Remove and return (free, bin) with the least free space of at least `need`."""
        node = self.size + need
        if not self.count[node]:
            while node > 1 and not (node % 2 == 0 and self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.size
        bin_id = self.bins[free].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return free, bin_id


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of the pieces of each sequence."""
    tree, bins = FreeSpace(capacity), []
    for k in np.argsort(-lengths, kind="stable"):
        n = int(lengths[k])
        free, bin_id = tree.take_least(n) or (capacity, len(bins))
        if bin_id == len(bins):
            bins.append([])
        bins[bin_id].append(int(k))
        if free > n:
            tree.add(free - n, bin_id)
    return bins


def split(docs: DataFrame, capacity: int, vocabulary: str, id_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of documents with their ids."""
    kind = f"<u{id_bytes}"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(vocabulary).ids
        for batch in batches:
            for part in np.array_split(np.arange(len(batch)), -(-len(batch) // 1000)):
                rows = []
                for doc_id, text in zip(batch["doc_id"].iloc[part], batch["text"].iloc[part], strict=True):
                    ids = encode(text).astype(kind)
                    rows += [(doc_id, k, at, n, ids[at : at + n].tobytes()) for k, (at, n) in enumerate(tokens.pieces(len(ids), capacity))]
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])

    return (docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInPandas(cut, "doc_id string, piece int, start long, length int, ids binary"))


def pack_matrices(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_bytes: int = 2, pad_id: int = 0,
                  block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed sequence of `capacity` ids.

    id_bytes: 2 holds vocabularies under 65,536 ids, 4 any. cu_seqlens starts with 0 and ends with n_ids; ids from n_ids
    on are padding. position_resets are the row positions where a piece starts. Null and empty texts hold the separator
    alone; null and repeated ids are packed like any other. Other columns aren't looked at; no rows give no rows."""
    vocabulary = vocabulary or tokens.default_vocabulary()
    kind = f"<u{id_bytes}"

    def rows_of(block: pd.DataFrame, first: int) -> pd.DataFrame:
        out = []
        doc_ids, piece, start, ids = (block[c].tolist() for c in ("doc_id", "piece", "start", "ids"))
        for k, members in enumerate(best_fit_decreasing(block["length"].to_numpy(), capacity)):
            data = b"".join(ids[m] for m in members)
            ends = np.cumsum([len(ids[m]) // id_bytes for m in members]).tolist()
            n = ends[-1]
            data += np.full(capacity - n, pad_id, kind).tobytes()
            out.append((first + k, n, data, [0, *ends], [0, *ends[:-1]], [None if doc_ids[m] is None else int(doc_ids[m]) for m in members], [piece[m] for m in members], [start[m] for m in members]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, held, size = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for at in range(0, len(batch), 500):
                held.append(batch.iloc[at : at + 500])
                size += int(held[-1]["length"].sum())
                if size >= block_ids:
                    out = rows_of(pd.concat(held), made)
                    made, held, size = made + len(out), [], 0
                    yield out
        if held:
            yield rows_of(pd.concat(held), made)

    rows = split(docs, capacity, vocabulary, id_bytes, id_col, text_col)
    key = F.xxhash64("doc_id", "piece", "length")
    return rows.repartition(key).sortWithinPartitions(key, "doc_id", "piece", "ids").mapInPandas(place, ROW)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write the rows as Parquet: input_ids of a row group is a matrix of fixed-width rows."""
    packed.write.mode("error").parquet(path)
