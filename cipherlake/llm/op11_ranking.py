"""Ranked lexical search, reversed: the queries are indexed, the documents are streamed.

The items to search for are few and the documents many, so the inverted index is over the items: for each of their terms
the items that hold it, and how often. It goes to the tasks in blocks of a bounded size. A first pass over the documents
counts what weights need (documents, terms, documents by term); a second streams each document's term counts through the
index and keeps a bounded heap of the best documents for each item. Heaps of all tasks meet in two steps, so that no task
reads more than a share of them. Texts are never exchanged, and a document is read whole.

Weights and scores are integers from floors, so that results don't depend on the order of additions."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.llm.common import cut

TOP = 20
BLOCK_BYTES = 32_000_000
SALTS = 256
B_PERCENT = 25  # weight of a document's length
K_TENTHS = 12  # saturation of term counts
SCALE = 1_000_000_000
# letters and digits stay, capitals become small, other ASCII becomes blank; bytes of other letters stay
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Index(NamedTuple):
    items: list[int | None]  # ids
    number: dict[bytes, int]  # of terms
    starts: np.ndarray  # first posting of each term, and the end
    item: np.ndarray  # postings: the item,
    repeats: np.ndarray  # and how often it holds the term


class Statistics(NamedTuple):
    documents: int  # with a term
    length: int  # of all documents, in terms
    weight: np.ndarray  # of each term of the index


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


def index_of(items: list[tuple[int | None, str | None]]) -> Index:
    """Inverted index of items; items without a term are in it, too, and find nothing."""
    counts = [Counter(terms(t)) for _, t in items]
    number = {w: k for k, w in enumerate(sorted({w for c in counts for w in c}))}
    rows = sorted((number[w], k, n) for k, c in enumerate(counts) for w, n in c.items())
    term, item, repeats = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    return Index([i for i, _ in items], number, np.searchsorted(term, np.arange(len(number) + 1)), item, repeats)


def statistics(docs: DataFrame, index, size: int) -> Statistics:
    """Counts over all documents, for the index in a broadcast variable with `size` terms."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, total, documents, length = index.value.number.get, np.zeros(size, np.int64), 0, 0
        for b in batches:
            for t in b["text"]:
                words = terms(t)
                documents += bool(words)
                length += len(words)
                total[[k for k in map(get, set(words)) if k is not None]] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": np.concatenate([at, [-1, -2]]), "n": np.concatenate([total[at], [documents, length]])})

    held = {r["term"]: r["n"] for r in docs.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents = held.get(-1, 0)
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(k, 0) + 1))) for k in range(size)]
    return Statistics(documents, held.get(-2, 0), np.array(weight, np.int64))


def scores(index: Index, known: Statistics, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Items that share a term with a document, and their scores."""
    found = [k for k in map(index.number.get, words) if k is not None]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    term, tf = np.unique(np.array(found, np.int64), return_counts=True)
    norm = 100 - B_PERCENT + (B_PERCENT * len(words) * known.documents) // known.length
    gain = known.weight[term] * ((SCALE * tf) // (1000 * tf + K_TENTHS * norm))
    lens = index.starts[term + 1] - index.starts[term]
    at = np.arange(lens.sum()) + np.repeat(index.starts[term] - (np.cumsum(lens) - lens), lens)
    items, place = np.unique(index.item[at], return_inverse=True)
    total = np.zeros(len(items), np.int64)
    np.add.at(total, place, np.repeat(gain, lens) * index.repeats[at])
    return items, total


def _best(docs: DataFrame, index, known: Statistics, top: int) -> DataFrame:
    """(item, doc_id, score): the best `top` documents of each task for each item (numbered as in the index)."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = index.value
        heaps: dict[int, list] = {}
        least = np.ones(len(own.items), np.int64)  # scores below can't enter
        for b in batches:
            for doc_id, text in zip(b["doc_id"].tolist(), b["text"], strict=True):
                items, total = scores(own, known, terms(text))
                may = total >= least[items]
                for k, score in zip(items[may].tolist(), total[may].tolist(), strict=True):
                    entry = (score, doc_id == doc_id and doc_id is not None, -int(doc_id) if doc_id == doc_id and doc_id is not None else 0)
                    heap = heaps.setdefault(k, [])
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == top:
                        least[k] = heap[0][0]
        salt = TaskContext.get().partitionId() % SALTS
        rows = [(k, salt, -i if there else None, s) for k, heap in heaps.items() for s, there, i in heap]
        for at in range(0, len(rows), 100_000):
            part = rows[at : at + 100_000]
            yield pd.DataFrame({"item": [r[0] for r in part], "salt": [r[1] for r in part], "doc_id": pd.array([r[2] for r in part], "Int64"), "score": [r[3] for r in part]})

    return docs.mapInPandas(search, "item long, salt int, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, item_col: str = "item_id", item_text_col: str = "text",
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents with the highest scores above 0 for each item, from rank 1.

    Equal scores are in the order of ids, null last. Rows are documents of their own, also rows with equal ids or texts.
    Items equal in id and text are one item; items of equal id and different texts, or with a null id, are items of their
    own. Null and empty texts have no terms: such documents aren't found and such items find nothing. Empty tables give
    no rows. Other columns aren't looked at. Long texts are read whole."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        made = index_of([(r["item"], r["text"]) for r in got])
        if not made.number:
            continue
        index = spark.sparkContext.broadcast(made)
        known = statistics(rows, index, len(made.number))
        if known.length:
            order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
            part = _best(rows, index, known, top)
            for keys in (("item", "salt"), ("item",)):
                part = part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
            ids = F.array(*[F.lit(i).cast("long") for i in made.items]) if len(made.items) <= 1000 else None
            if ids is not None:
                named = part.withColumn("item_id", F.element_at(ids, (F.col("item") + 1).cast("int")))
            else:
                named = part.join(spark.createDataFrame(list(enumerate(made.items)), "item long, item_id long"), "item")
            out = out.unionByName(cut(named.select("item_id", "rank", "doc_id", "score")))
        index.destroy()
    return out
