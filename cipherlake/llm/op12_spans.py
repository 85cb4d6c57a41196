"""Substring dedup by compaction of a de Bruijn graph.

Each window of `k` words is an edge from its first k - 1 words to its last k - 1; a document is a walk. Edges that several
documents walk are repeated; where all walks through an edge come from one and go on to one other, the edge belongs to a
path without branches, and the whole path is one span that every walk takes as a whole.

1. Only a window's minimiser, the smallest hash of its runs of `gram` words, is exchanged first (about a fifth of the
   windows have one of their own): windows whose minimiser only one text holds can't be repeated.
2. Texts that are equal word by word are one walk, that of their smallest id; it stands for the others. Walks are numbered
   in the order of ids, so that one number, the coordinate, names a place in the corpus and its order.
3. The other windows are counted by hash: smallest and largest coordinate, and whether the words before and after are
   always the same. Two edges next to each other in the earliest source are one path if the first is always followed
   and the second always preceded by one word (joins on coordinates). Each path is then its two ends.
4. The ends are joined with all places that hold them. Source coordinates verify a span: both ends must be there, at the
   path's length, and the sum of a second hash over the windows between must equal that of the earliest source.
5. Verified spans that a smaller id holds leave the document, by lists of short rows; texts meet those lists once.

Groups are split: counts are partial aggregates, joins have one row for each key on one side, and nothing is gathered but
the spans of one document."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.llm.common import Memo, release
from cipherlake.operators.ordering import global_index
from cipherlake.session import scratch

WORDS, GRAM = 13, 5
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PRINT = np.uint64((1 << 61) - 1)
NO_ID = (1 << 63) - 1  # the place of null ids in the order


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of other characters than ASCII white space."""
    return (text or "").encode().split()


def _hashes(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def runs(ids: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of n words: a polynomial of the words' hashes, mixed."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    last = len(ids) - n + 1
    h = ids[:last].copy()
    for j in range(1, n):
        h *= _ODD[seed]
        h += ids[j : last + j]
    for shift in (np.uint64(32), np.uint64(29)):
        h ^= h >> shift
        h *= _MIX
    return h ^ (h >> np.uint64(32))


def minimisers(ids: np.ndarray, k: int, gram: int) -> np.ndarray:
    """The smallest hash of the runs of `gram` words of each window of k words."""
    if len(ids) < k:
        return np.empty(0, np.uint64)
    h, wide = runs(ids, gram, 2), 1
    while wide * 2 <= k - gram + 1:  # smallest of 1, 2, 4 .. neighbours
        h, wide = np.minimum(h[:-wide], h[wide:]), wide * 2
    rest = k - gram + 1 - wide
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def stretches(values: np.ndarray) -> np.ndarray:
    """Where stretches of equal neighbours start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _profiles(rows: DataFrame, k: int, gram: int) -> DataFrame:
    """(id, hash, n, print, minimisers) of each row: number of words, digest of the words, distinct minimisers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(word_hash, 1_000_000)
        for b in batches:
            for lo in range(0, len(b), 500):
                part, out = b.iloc[lo : lo + 500], []
                for text in part["text"]:
                    words = words_of(text)
                    least = minimisers(_hashes(words, memo), k, gram)
                    out.append((len(words), xxhash.xxh3_128_hexdigest(b" ".join(words)), np.unique(least[stretches(least)]).view(np.int64)))
                yield pd.DataFrame({"id": part["id"], "hash": part["hash"], "n": [o[0] for o in out], "print": [o[1] for o in out], "minimisers": [o[2] for o in out]})

    return rows.mapInPandas(run, "id long, hash long, n long, print string, minimisers array<long>")


def _edges(walks: DataFrame, k: int, gram: int, shift: int) -> DataFrame:
    """(edge, at, before, after, sum) of the windows with a shared minimiser: hash, coordinate, the words next to the
    window (0: none) and the sum of a second hash over the document's earlier windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(word_hash, 1_000_000)
        made, size = [], 0
        for b in batches:
            for ref, text, shared in zip(b["ref"], b["text"], b["shared"], strict=True):
                ids = _hashes(words_of(text), memo)
                least = minimisers(ids, k, gram).view(np.int64)
                at = stretches(least)
                keep = np.flatnonzero(np.repeat(np.isin(least[at], np.asarray(shared, np.int64)), np.diff(np.append(at, len(least)))))
                around = np.concatenate([[np.uint64(0)], ids | np.uint64(1), [np.uint64(0)]])
                second = np.concatenate([[np.uint64(0)], np.cumsum(runs(ids, k, 1))]) & _PRINT
                made.append(np.stack([runs(ids, k)[keep].view(np.int64), keep + (int(ref) << shift), around[keep].view(np.int64), around[keep + k + 1].view(np.int64), second[keep].view(np.int64)]))
                size += len(keep)
                if size >= 100_000:
                    yield pd.DataFrame(np.concatenate(made, 1).T, columns=["edge", "at", "before", "after", "sum"])
                    made, size = [], 0
        if made:
            yield pd.DataFrame(np.concatenate(made, 1).T, columns=["edge", "at", "before", "after", "sum"])

    return walks.select("ref", "text", "shared").mapInPandas(run, "edge long, at long, before long, after long, sum long")


def _stored(df: DataFrame, path: str) -> DataFrame:
    """Store df as a table in the shared folder, have Spark remove the exchanges behind it, and go on from the table.
    Spark's event queues hold the plan of the last job until another one ends, so a small one comes in between."""
    df.write.parquet(path)
    df.sparkSession.range(1).collect()
    time.sleep(0.3)
    release(df.sparkSession)
    return df.sparkSession.read.parquet(path)


def paths(edges: DataFrame, folder: str) -> DataFrame:
    """(edge, path, offset, last): the two ends (one, if they are the same edge) of each path without branches of edges
    that several documents hold; path is the coordinate of its start in the earliest source, offset the end's place in it."""
    counted = edges.groupBy("edge").agg(F.min("at").alias("at"), F.max("doc").alias("most"), F.min("doc").alias("least"),
                                        *[(F.min(c) == F.max(c)).alias(f"one_{c}") for c in ("before", "after")]).where("least < most")
    counted = _stored(counted.select("edge", "at", "least", "one_before", "one_after"), f"{folder}/repeated")
    after = counted.select((F.col("at") - 1).alias("at"), F.col("one_before").alias("next_one"))
    before = counted.select((F.col("at") + 1).alias("at"), F.col("one_after").alias("last_one"))
    linked = counted.join(after, "at", "left").join(before, "at", "left")
    starts = ~F.coalesce(F.col("one_before") & F.col("last_one"), F.lit(False))
    stops = ~F.coalesce(F.col("one_after") & F.col("next_one"), F.lit(False))
    limits = linked.select("edge", "at", F.col("least").alias("doc"), starts.alias("starts"), stops.alias("stops")).where("starts or stops")
    along = Window.partitionBy("doc").orderBy("at")
    start = F.last(F.when(F.col("starts"), F.col("at")), True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    stop = F.first(F.when(F.col("stops"), F.col("at")), True).over(along.rowsBetween(0, Window.unboundedFollowing))
    return limits.select("edge", start.alias("path"), (F.col("at") - start).alias("offset"), (stop - start).alias("last"))


def spans(edges: DataFrame, ends: DataFrame, k: int, folder: str) -> DataFrame:
    """(at, path, length in words): the places where a path's verified copies start, the earliest one left out."""
    found = edges.join(ends, "edge").select("path", "last", "offset", (F.col("at") - F.col("offset")).alias("at"), "sum")
    copies = found.groupBy("path", "last", "at").agg(F.max(F.when(F.col("offset") == 0, F.col("sum"))).alias("head"), F.max(F.when(F.col("offset") == F.col("last"), F.col("sum"))).alias("tail"))
    copies = copies.where("head is not null and tail is not null").select("path", "last", "at", F.pmod(F.col("tail") - F.col("head"), F.lit(int(_PRINT) + 1)).alias("print"))
    copies = _stored(copies, f"{folder}/copies")
    source = copies.where("at = path").select("path", F.col("print").alias("source_print"))
    return copies.where("at != path").join(source, "path").where("print = source_print").select("at", "path", (F.col("last") + k).alias("length"))


def repeated(docs: DataFrame, k: int = WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, spans): for each text of a document that loses words, its id (NO_ID: null), the hash of the text and
    the spans that go, as (start, length, source_id, source_start) in words."""
    spark = docs.sparkSession
    folder = scratch(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"), F.col(text_col).cast("string").alias("text"))
    profiles = _stored(_profiles(rows.where(F.length("text") > 0), k, gram).where(F.col("n") >= k), f"{folder}/profiles")
    number = F.conv(F.substring("print", 1, 15), 16, 10).cast("long")
    single = profiles.select(number.alias("walk"), F.explode("minimisers").alias("minimiser"))
    shared = _stored(single.groupBy("minimiser").agg(F.min("walk").alias("low"), F.max("walk").alias("high")).where("low < high").select("minimiser"), f"{folder}/shared")
    firsts = profiles.groupBy("print").agg(F.min(F.struct("id", "hash", "n")).alias("f")).select("print", "f.*")
    held = profiles.select("id", "hash", F.explode("minimisers").alias("minimiser")).join(shared, "minimiser").groupBy("id", "hash").agg(F.collect_set("minimiser").alias("shared"))
    candidates = _stored(firsts.join(held, ["id", "hash"]), f"{folder}/candidates")
    walks = _stored(global_index(candidates, "id", "hash", name="ref"), f"{folder}/walks")
    longest, count = walks.agg(F.max("n"), F.count("*")).first()
    shift = int(longest or 1).bit_length()
    if shift + int(count).bit_length() > 62:
        raise ValueError("coordinates of more than 62 bits")
    texts = rows.join(walks.select("id", "hash", "ref", "shared"), ["id", "hash"]).dropDuplicates(["id", "hash"])
    edges = _stored(_edges(texts, k, gram, shift), f"{folder}/edges")
    ends = _stored(paths(edges.withColumn("doc", F.shiftright("at", shift)), folder), f"{folder}/ends")
    low = walks.groupBy("id").agg(F.min("ref").alias("low"))  # of the rows of one id none is earlier
    names = walks.select("ref", "id", "print").join(low, "id")
    place = lambda c: F.col(c).bitwiseAND(F.lit((1 << shift) - 1))
    found = spans(edges, ends, k, folder).withColumns({"ref": F.shiftright("at", shift), "source": F.shiftright("path", shift)})
    found = found.join(names, "ref").where("source < low")
    found = found.join(names.select(F.col("ref").alias("source"), F.col("id").alias("source_id")), "source")
    one = F.struct(place("at").alias("start"), "length", F.when(F.col("source_id") != NO_ID, F.col("source_id")).alias("source_id"), place("path").alias("source_start"))
    own = found.groupBy("print").agg(F.sort_array(F.collect_list(one)).alias("own"))
    # a row of the walk's smallest id loses the walk's spans, a copy under a larger id all its words
    per_row = profiles.select("id", "hash", "n", "print").distinct().join(firsts.select("print", F.col("id").alias("first")), "print").join(own, "print", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("length"), F.col("first").alias("source_id"), F.lit(0).cast("long").alias("source_start")))
    out = per_row.withColumn("spans", F.when(F.col("id") > F.col("first"), whole).otherwise(F.col("own"))).where("spans is not null")
    return _stored(out.select("id", "hash", "spans"), f"{folder}/spans")


def _kept(text: Column, gone: Column) -> Column:
    """Words, words removed, and the other words joined by a space."""

    @F.pandas_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def run(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.DataFrame:
        out = []
        for t, s, n in zip(texts, starts, lengths, strict=True):
            words = words_of(t)
            if s is not None and len(s):
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, np.asarray(s, np.int64), 1)
                np.add.at(depth, np.asarray(s, np.int64) + np.asarray(n, np.int64), -1)
                kept = [w for w, d in zip(words, np.cumsum(depth), strict=False) if d == 0]
            else:
                kept = words
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return run(text, F.transform(gone, lambda s: s["start"]), F.transform(gone, lambda s: s["length"]))


def dedup(docs: DataFrame, k: int = WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept, spans), one row per input row: the words that are in no window of k words that also
    starts in a document with a smaller id, joined by a space, and the spans that went.

    Words are runs of other characters than ASCII white space, compared as they are. Windows are judged on the input.
    Null ids come after all others; rows of equal ids take nothing from each other, and rows equal in id and text lose
    the same. Null, empty and blank texts have no words. Other columns aren't looked at. Texts are read whole."""
    gone = repeated(docs, k, gram, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"id": F.coalesce(F.col("own_id").cast("long"), F.lit(NO_ID)), "hash": F.xxhash64("text")})
    out = rows.join(gone, ["id", "hash"], "left").withColumn("found", _kept(F.col("text"), F.col("spans")))
    empty = F.array().cast("array<struct<start:bigint,length:bigint,source_id:bigint,source_start:bigint>>")
    return out.select(F.col("own_id").alias(id_col), "found.n_words", "found.n_removed", "found.kept", F.coalesce("spans", empty).alias("spans"))
