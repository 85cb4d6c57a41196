"""Best-fit packing, bounded-space and online.

Pieces of documents arrive one after another. A fixed number of bins is open. A bitset over free space tells, in one
step, the open bin with the least room that still takes the piece; the piece goes there, or into a new bin. When too
many bins are open, the fullest closes first. Each task packs its own share of the pieces with its own open bins, so
a task needs memory for the open bins only and at most that many sequences per task end up short of full.

Shuffles: one, of short piece rows (no text, no ids). Order inside a task is fixed by sorting, so a repeated task packs
alike."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm import tokens

CAPACITY = 2048
OPEN_BINS = 512
# ids travel as text through Python, where a column of integers with nulls would become floating
PIECE = "doc_id string, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, sequence_id long, offset long"


class OpenBins:
    """The open bins by free space, with a bitset of the free spaces in use."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.count, self.made = capacity, most, 0, 0
        self.by_free: dict[int, list[tuple[int, int]]] = {}
        self.bits = 0

    def _put(self, free: int, bin_id: int) -> None:
        if free == 0:  # full bins close at once
            return
        self.by_free.setdefault(free, []).append((bin_id, self.capacity - free))
        self.bits |= 1 << free
        self.count += 1

    def _take(self, free: int) -> tuple[int, int]:
        stack = self.by_free[free]
        bin_id, filled = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_id, filled

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        roomy = self.bits >> length
        if roomy:
            free = length + (roomy & -roomy).bit_length() - 1
            bin_id, offset = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_id, offset, free = self.made, 0, self.capacity
            self.made += 1
        self._put(free - length, bin_id)
        return bin_id, offset


def pieces_of(docs: DataFrame, capacity: int, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: place in its document, length and crc32 of its little-endian unsigned 32-bit ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(vocabulary).ids
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text)
                for k, (at, n) in enumerate(tokens.pieces(len(ids), capacity)):
                    rows.append((doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(cut, PIECE)


def pack(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, vocabulary: str | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with the sequence and the offset they got.

    Null and empty texts hold the separator alone. Documents of null or repeated id are packed like any other. Other
    columns of the input aren't looked at. An empty table gives no rows."""
    vocabulary = vocabulary or tokens.default_vocabulary()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, task = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            spots = [bins.place(n) for n in batch["length"]]
            yield batch.assign(sequence_id=[task + b for b, _ in spots], offset=[at for _, at in spots])

    rows = pieces_of(docs, capacity, vocabulary, id_col, text_col)
    dealt = rows.repartition(F.xxhash64("doc_id", "piece", "ids_crc32"))
    placed = dealt.sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece").mapInPandas(place, PLACED)
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))
