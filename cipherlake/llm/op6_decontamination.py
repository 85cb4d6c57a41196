"""Benchmark decontamination: rare seeds and local alignment.

Benchmark items are split into words (lower case, outer punctuation dropped). Seeds are their runs of `n` words that are
rare: their words' frequencies over the whole corpus make the run carry at least `min_bits` bits. An item keeps its eight
most telling runs even if they carry less, so none is without seeds. Frequencies are of words, not of runs, so a passage
that leaked into a third of the corpus doesn't stop being a seed.

A document's seeds of an item name windows of the document, somewhat longer than the item. Smith-Waterman aligns window
and item word by word; the score is the best local alignment as a share of a perfect one, so that edits, insertions and
reorderings within it lower the score instead of hiding the copy.

Items of fewer than `n` words are found where their words follow each other, all of them.

Items go to the tasks in blocks of a bounded number of words, each block against all documents; documents are never
exchanged."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.common import Memo

SEED_WORDS = 4
MIN_BITS = 24.0
ALWAYS = 8
THRESHOLD = 0.5
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


class Index(NamedTuple):
    items: list[int]  # ids
    words: list[np.ndarray]  # the items' words as numbers from 1
    number: dict[str, int]
    seeds: np.ndarray  # sorted codes
    owner: np.ndarray  # item of each seed
    place: np.ndarray  # where the seed starts in the item
    n: int
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # for lengths under n, sorted codes of the items and their numbers


def plain(word: str) -> str:
    return _EDGES.sub("", word.lower())


def numbering(number: dict[str, int]) -> Memo:
    """Numbers of raw words: the benchmark's from 1, 0 for others, -1 for what has no letter or digit."""

    def of(word: str) -> int:
        low = word.lower()
        found = number.get(low)
        if found is None:
            inner = low if low.isalnum() else plain(low)
            found = number.get(inner, 0) if inner else -1
        return found

    return Memo(of, 400_000)


def codes(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n words; 0 where a word isn't the benchmark's."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out, known = np.zeros(len(ids) - n + 1, np.uint64), np.ones(len(ids) - n + 1, bool)
    for k in range(n):
        part = ids[k : len(ids) - n + 1 + k]
        out = out * np.uint64(1_000_003) + part.astype(np.uint64)
        known &= part > 0
    return np.where(known, (out << np.uint64(1)) | np.uint64(1), np.uint64(0))


def _next_row(up: np.ndarray, window: np.ndarray, word: int, first: int, steps: np.ndarray, floor: int) -> np.ndarray:
    """The row below `up` of an alignment's scores; its first cell is given, no cell is under the floor."""
    h = np.empty_like(up)
    h[0] = first
    np.maximum(up[:-1] + np.where(window == word, np.int32(MATCH), np.int32(MISMATCH)), up[1:] + GAP, out=h[1:])
    np.maximum(h, floor, out=h)
    h += steps
    np.maximum.accumulate(h, out=h)
    h -= steps
    return h


def local_alignment(window: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int, int]:
    """(score, start and end in the window, start and end in the item) of the best local alignment. Words numbered 0
    match nothing. Two rows of scores are held: the first pass gives the end; a second one, backwards from there, gives the
    nearest start that reaches the score. An alignment with a score above 0 spans fewer than three times as many words of the
    window as of the item, so the second pass looks no further back."""
    steps = np.arange(len(window) + 1, dtype=np.int32) * -GAP
    row, score, end_i, end_j = np.zeros(len(window) + 1, np.int32), 0, 0, 0
    for i, word in enumerate(item, 1):
        row = _next_row(row, window, word, 0, steps, 0)
        j = int(row.argmax())
        if row[j] > score:
            score, end_i, end_j = int(row[j]), i, j
    if not score:
        return 0, 0, 0, 0, 0
    back = window[max(0, end_j - 3 * end_i) : end_j][::-1]
    steps = steps[: len(back) + 1]
    row, never = -steps, np.iinfo(np.int32).min // 2
    for i, word in enumerate(item[:end_i][::-1], 1):
        row = _next_row(row, back, word, i * GAP, steps, never)
        j = int(row.argmax())
        if row[j] == score:
            return score, end_j - j, end_j, end_i - i, end_i
    raise AssertionError("an alignment that ends somewhere starts somewhere")


def fit(docs: DataFrame, benchmark: DataFrame, n: int = SEED_WORDS, min_bits: float = MIN_BITS, block_words: int = BLOCK_WORDS,
        item_col: str = "item_id", text_col: str = "text", item_text_col: str = "text") -> list[Index]:
    """An index for each block of items. Null texts, null ids and items without a word are left out."""
    items = benchmark.where(F.col(item_text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * block_words)))
    out = []
    for k in range(blocks):
        rows = sorted({(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()})
        out.append(_index([(i, [w for w in map(plain, t.split()) if w]) for i, t in rows], docs, text_col, n, min_bits))
    return out


def _index(items: list[tuple[int, list[str]]], docs: DataFrame, text_col: str, n: int, min_bits: float) -> Index:
    items = [(i, w) for i, w in items if w]
    number = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in items for w in ws}))}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, memo = np.zeros(len(number) + 2, np.int64), numbering(number)
        for b in batches:
            for t in b["text"]:
                words = Counter(t.split())
                at = np.fromiter((memo[w] for w in words), np.int64, len(words))
                np.add.at(total, at, np.fromiter(words.values(), np.int64, len(words)))
        at = np.nonzero(total[:-1])[0]  # the last is for what has no letter or digit
        yield pd.DataFrame({"word": at.astype(np.int32), "n": total[at]})

    bits = np.full(len(number) + 1, 40.0)
    if items:
        texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"))
        rows = texts.mapInPandas(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        every = sum(r["n"] for r in rows)
        for r in rows:
            bits[r["word"]] = np.log2(every / r["n"])
    found: list[tuple[int, int, int]] = []
    words = [np.array([number[w] for w in ws], np.int64) for _, ws in items]
    short: dict[int, list[tuple[int, int]]] = {}
    for k, ids in enumerate(words):
        if len(ids) < n:
            short.setdefault(len(ids), []).append((int(codes(ids, len(ids))[0]), k))
            continue
        told = np.convolve(bits[ids], np.ones(n), "valid")
        keep = told >= min(min_bits, np.sort(told)[::-1][: ALWAYS][-1])
        found += [(int(c), k, int(p)) for p, c in enumerate(codes(ids, n)) if keep[p]]
    found.sort()
    return Index([i for i, _ in items], words, number, np.array([c for c, _, _ in found], np.uint64), np.array([k for _, k, _ in found], np.int64), np.array([p for _, _, p in found], np.int64), n,
                 {size: (np.array([c for c, _ in sorted(own)], np.uint64), np.array([k for _, k in sorted(own)], np.int64)) for size, own in sorted(short.items())})


def _whole(index: Index, ids: np.ndarray) -> dict[int, tuple[int, int]]:
    """First span of each short item whose words all follow each other in a document."""
    out: dict[int, tuple[int, int]] = {}
    for size, (code, owner) in index.short.items():
        own, first = np.unique(codes(ids, size), return_index=True)
        place = np.minimum(np.searchsorted(own, code), max(0, len(own) - 1))
        for k in np.flatnonzero(own[place] == code) if len(own) else ():
            at = int(first[place[k]])
            out[int(owner[k])] = (at, at + size)
    return out


def _windows(index: Index, at: np.ndarray, code: np.ndarray, n_words: int) -> dict[int, list[list[int]]]:
    """Windows [from, to) of a document for each item, from seed hits; windows that overlap are one."""
    spans: dict[int, list[list[int]]] = {}
    lo, hi = np.searchsorted(index.seeds, code, "left"), np.searchsorted(index.seeds, code, "right")
    for p, first, last in zip(at, lo, hi, strict=True):
        for s in range(first, last):
            k, size = int(index.owner[s]), len(index.words[index.owner[s]])
            start = int(p) - int(index.place[s])
            span = [max(0, start - size // 2), min(n_words, start + size + size // 2 + 1)]
            own = spans.setdefault(k, [])
            if own and span[0] <= own[-1][1]:
                own[-1][0], own[-1][1] = min(own[-1][0], span[0]), max(own[-1][1], span[1])
            else:
                own.append(span)
    return spans


LEAK = "array<struct<item_id:bigint,score:double,start_word:int,end_word:int,item_start:int,item_end:int>>"


def leaks(indexes: list[Index], text: Column, threshold: float = THRESHOLD) -> Column:
    """The items whose copy a text holds, one entry for each item with its best alignment: score, span in the text's
    words (split at white space, those without a letter or digit aside) and span in the item's words. Null and empty
    texts hold none."""

    def of(index: Index) -> Column:
        memo: list[Memo] = []

        @F.pandas_udf(LEAK)
        def run(texts: pd.Series) -> pd.Series:
            if not memo:
                memo.append(numbering(index.number))
            return pd.Series([one(t, memo[0]) for t in texts])

        def one(t: str | None, number: Memo) -> list:
            if not t or not index.items:
                return []
            words = t.split()
            ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            ids = ids[ids >= 0]
            code = codes(ids, index.n)
            at = np.nonzero(code)[0] if len(index.seeds) else np.empty(0, np.int64)
            near = np.searchsorted(index.seeds, code[at])
            at = at[index.seeds[np.minimum(near, len(index.seeds) - 1)] == code[at]] if len(at) else at
            out = [(index.items[k], 1.0, a, b, 0, b - a) for k, (a, b) in _whole(index, ids).items()]
            for k, spans in _windows(index, at, code[at], len(ids)).items():
                item, best = index.words[k], (0.0, 0, 0, 0, 0)
                for lo, hi in spans:
                    score, a, b, c, d = local_alignment(ids[lo:hi], item)
                    if score / (MATCH * len(item)) > best[0]:
                        best = (score / (MATCH * len(item)), lo + a, lo + b, c, d)
                if best[0] >= threshold:
                    out.append((index.items[k], *best))
            return [dict(zip(("item_id", "score", "start_word", "end_word", "item_start", "item_end"), x, strict=True)) for x in sorted(out)]

        return run(text.cast("string"))

    return F.concat(*[of(i) for i in indexes]) if len(indexes) > 1 else of(indexes[0])
