"""Line dedup by pairwise alignment.

Documents are sequences of line hashes. A seed is the shortest run of lines that starts or ends at a line and has at least
`min_words` words: much rarer than a line, so short lines that thousands of documents share (licences, headings) bring no
pairs by themselves. Each seed pairs every later document with the first document that holds it, so a seed in thousands of
documents gives as many pairs, not their square. A pair is aligned by patience diff: lines that are unique in both
documents anchor the alignment, the longest increasing chain of anchors is kept, and the gaps are aligned alike; a gap
without such lines is anchored at runs of two, four, eight lines and so on, the shortest that are unique in both. Aligned
runs with at least `min_words` words are deleted from the later document; nothing else is.

One alignment can't bring together blocks in another order, blocks that shared short lines cross, or blocks that come twice.
So only lines in seeds that both documents hold take part, and while any such seed isn't wholly deleted, the rest is
aligned again. Once that leaves more than half of them, each is aligned by itself with its place in the earlier
document, so that the number of rounds is logarithmic.

Each line of a run of that size lies in a seed within the run: one that starts or ends at the line or, where the run has
fewer words on either side, the one that starts the run. So any line in a run of `min_words` words that some earlier document
has goes, also where different documents hold the two ends of a block. Only hashes are joined and aligned; texts are
exchanged once, to meet the list of their deleted lines."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.common import cut

MIN_WORDS = 20
KEY = "struct<missing:boolean,id:bigint,hash:bigint>"


def row_key(id_col: Column, text: Column) -> Column:
    """Place of a document in the order of ids (null last; rows of equal id by a hash of the text)."""
    return F.struct(id_col.isNull().alias("missing"), F.coalesce(id_col.cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("hash"))


def _hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text), "big", signed=True)


def profile_of(text: str, min_words: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Numbers, hashes and word counts of the lines that aren't blank, and the hashes of the seeds."""
    at, hashes, words = [], [], []
    for k, line in enumerate(text.split("\n")):
        plain = line.split()
        if plain:
            at.append(k)
            hashes.append(_hash(" ".join(plain)))
            words.append(len(plain))
    seeds = [hashes[k] if end == k + 1 else _hash(",".join(map(str, hashes[k:end]))) for k, end in shortest_runs(words, min_words)]
    return at, hashes, words, seeds


def shortest_runs(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(start, end) of the runs with at least min_words words that are the shortest to start or the shortest to end at a line."""
    runs, end, size = set(), 0, 0
    for k in range(len(words)):
        while end < len(words) and size < min_words:
            size += words[end]
            end += 1
        if size < min_words:
            break
        runs.add((k, end))
        size -= words[k]
    start = size = 0
    for k, n in enumerate(words):
        size += n
        while start < k and size - words[start] >= min_words:
            size -= words[start]
            start += 1
        if size >= min_words:
            runs.add((start, k + 1))
    return sorted(runs)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (index in a, index in b), increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, from_, to = todo.pop()
        while lo < hi and from_ < to and a[lo] == b[from_]:
            out.append((lo, from_))
            lo, from_ = lo + 1, from_ + 1
        while lo < hi and from_ < to and a[hi - 1] == b[to - 1]:
            hi, to = hi - 1, to - 1
            out.append((hi, to))
        if lo >= hi or from_ >= to:
            continue
        chain = [(lo + i, from_ + j) for i, j in _increasing(_anchors(a[lo:hi], b[from_:to]))]
        out += chain
        if chain:
            for (i, j), (p, q) in zip([(lo - 1, from_ - 1), *chain], [*chain, (hi, to)], strict=True):
                todo.append((i + 1, p, j + 1, q))
    return sorted(out)


def _anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places in a and b, in the order of b, of common lines that are unique in both; without any, of the shortest common
    runs of 2, 4, 8, ... lines that are. Where no length has any, the occurrences of the least frequent common run of the
    longest length that has common ones meet in their order."""
    step, pairs = 1, []
    while True:
        left, right = Counter(a), Counter(b)
        common = [x for x in right if x in left]
        if not common:
            return pairs
        place = {x: k for k, x in enumerate(a)}
        unique = [(place[x], k) for k, x in enumerate(b) if right[x] == 1 and left.get(x) == 1]
        if unique:
            return unique
        rarest = min(common, key=lambda x: left[x] * right[x])
        pairs = list(zip([k for k, x in enumerate(a) if x == rarest], [k for k, x in enumerate(b) if x == rarest], strict=False))
        number: dict[tuple[int, int], int] = {}
        a, b = ([number.setdefault(x, len(number)) for x in zip(s, s[step:], strict=False)] for s in (a, b))
        step *= 2


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain that increases in the first number; pairs come in the order of the second."""
    ends, tails, before = [], [], []
    for n, (i, _) in enumerate(pairs):
        k = bisect_left(ends, i)
        before.append(tails[k - 1] if k else -1)
        if k == len(ends):
            ends.append(i)
            tails.append(n)
        else:
            ends[k], tails[k] = i, n
    chain, n = [], tails[-1] if tails else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    return chain[::-1]


def _long_runs(pairs: list[tuple[int, int]], words: list[int], min_words: int) -> set[int]:
    """Indices of b in aligned runs (next to each other in both) with at least min_words words."""
    out, run = set(), []
    for i, j in [*pairs, (-9, -9)]:
        if run and (i != run[-1][0] + 1 or j != run[-1][1] + 1):
            if sum(words[q] for _, q in run) >= min_words:
                out.update(q for _, q in run)
            run = []
        run.append((i, j))
    return out


def repeated(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Indices of b in aligned runs with at least min_words words; aligned again and again until no run of that size that
    a has too is left."""
    size = dict(zip(b, words, strict=True))
    places: dict[tuple[int, ...], list[int]] = {}
    for p, q in shortest_runs([size.get(x, min_words) for x in a], min_words):  # lines that b lacks match nothing
        places.setdefault(tuple(a[p:q]), []).append(p)
    left = [(p, q) for p, q in shortest_runs(words, min_words) if tuple(b[p:q]) in places]
    gone: set[int] = set()
    while left:
        in_b = {k for p, q in left for k in range(p, q)}
        in_a = {k for run in {tuple(b[p:q]) for p, q in left} for p in places[run] for k in range(p, p + len(run))}
        # lines out of the seeds are told apart, so that they meet nothing
        pairs = patience([(0, x) if k in in_a else (1, k) for k, x in enumerate(a)], [(0, x) if k in in_b else (2, k) for k, x in enumerate(b)])
        gone |= _long_runs(pairs, words, min_words)
        before, left = len(left), [(p, q) for p, q in left if not gone.issuperset(range(p, q))]
        if 2 * len(left) > before:
            for p, q in left:
                at = places[tuple(b[p:q])][0]
                gone |= {p + k for k in _long_runs(patience(a[at : at + q - p], b[p:q]), words[p:q], min_words)}
            break
    return sorted(gone)


def find(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(key, removed line numbers, keys' ids of the earlier documents) of the documents that lose lines."""

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.iloc[lo : lo + 1000]
                rows = [profile_of(t or "", min_words) for t in part["text"]]
                yield pd.DataFrame({"missing": part["missing"], "id": part["id"], "hash": part["hash"]}
                                   | {c: [r[k] for r in rows] for k, c in enumerate(("at", "lines", "words", "seeds"))})

    keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    made = keyed.where(F.length("text") > 0).select("key.*", "text").mapInPandas(profile, "missing boolean, id long, hash long, at array<int>, lines array<long>, words array<int>, seeds array<long>")
    profiles = cut(made.select(F.struct("missing", "id", "hash").alias("key"), "at", "lines", "words", "seeds").where(F.size("seeds") > 0).dropDuplicates(["key"]))
    seeds = profiles.select("key", F.explode(F.array_distinct("seeds")).alias("seed"))
    owners = seeds.groupBy("seed").agg(F.min("key").alias("owner"), F.max("key").alias("last")).where("owner < last").select("seed", "owner")
    pairs = seeds.join(owners, "seed").where("owner < key").select("key", "owner").distinct()
    earlier = profiles.select(F.col("key").alias("owner"), F.col("lines").alias("earlier"))
    both = pairs.join(earlier, "owner").join(profiles.select("key", "at", "lines", "words"), "key")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gone = [[int(at[q]) for q in repeated(list(a), list(x), list(w), min_words)] for a, x, w, at in zip(b["earlier"], b["lines"], b["words"], b["at"], strict=True)]
            yield pd.DataFrame({"missing": b["missing"], "id": b["id"], "hash": b["hash"], "owner": b["owner"], "gone": gone})

    owner_id = F.when(~F.col("owner.missing"), F.col("owner.id")).cast("string").alias("owner")
    aligned = both.select("key.*", owner_id, "earlier", "at", "lines", "words").mapInPandas(align, "missing boolean, id long, hash long, owner string, gone array<int>")
    hit = aligned.where(F.size("gone") > 0)
    return hit.groupBy(F.struct("missing", "id", "hash").alias("key")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("removed"), F.array_sort(F.collect_set(F.col("owner").cast("long"))).alias("sources"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", prefix: str = "dedup_") -> DataFrame:
    """The input's rows and columns with the repeated lines gone from the text, and three more columns: <prefix>lines
    (lines before), <prefix>removed (numbers of the deleted lines, from 0) and <prefix>sources (ids of the documents
    that keep them, null ids left out). The names of those must not be among the input's.

    Earlier means a smaller id; null ids come last, rows of equal id are ordered by a hash of the text. Rows equal in id
    and text are one document and stay alike. Null and empty texts stay as they are and repeat nothing. A document that
    is a copy as a whole keeps its row with an empty text, blank lines aside. Words are split at white space, and
    lines are compared with white space evened out."""
    found = find(docs, min_words, id_col, text_col)
    key, removed, sources = (f"{prefix}{c}" for c in ("key", "removed", "sources"))
    keyed = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
    joined = keyed.join(found.select(F.col("key").alias(key), F.col("removed").alias(removed), F.col("sources").alias(sources)), key, "left").drop(key)
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(removed))
    text = F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n"))
    count = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], count.alias(f"{prefix}lines"),
                         F.coalesce(removed, F.array().cast("array<int>")).alias(removed), F.coalesce(sources, F.array().cast("array<bigint>")).alias(sources))
