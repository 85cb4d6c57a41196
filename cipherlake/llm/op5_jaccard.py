"""N-gram Jaccard self-join by token-combination prefixes.

A document's set holds its distinct word shingles as hashes. Two documents link when the Jaccard similarity of their sets
reaches the threshold. With all tokens in one order, rare ones first, a document of n tokens shares with any partner
one of its first p = n - ceil(t n) + 1 tokens (t: the threshold). Classes of tokens by the number of documents that
hold them:

* unique tokens (one document) take up places of the prefix and are never indexed;
* rare tokens (up to `rare` documents) of the prefix are indexed alone;
* if the prefix reaches frequent tokens, it is extended to 2 (1 - t) n + 2 tokens, and combinations of two frequent tokens
  that follow each other are indexed. A and B differ in at most 2 (1 - t) n places, weighted as they break neighbours in
  A, so at least two common tokens follow each other in both extended prefixes: no link is lost, and a token in thousands
  of documents never brings its documents together by itself. This holds for thresholds above 2/3; for 2/3 and less
  frequent tokens of the prefix are indexed alone like rare ones.

Only documents with at least t n tokens that others hold can have a partner; the rest ends here. Candidates are verified on
whole sets: common tokens are never unique, so a document's shared tokens and its size suffice, and texts are read once.

Groups don't become all their pairs: in each index entry, all documents meet one of them first, the one with the fewest
unique tokens. Only entries whose documents aren't in one component then go on, and what stars can't join is compared in
tiles, where counts of tokens in hashed cells bound the overlap of two sets from above; pairs that pass are verified.

How tokens are counted: tasks send, for each range of hash values, one block of sorted tokens with their documents (about
six bytes a token). A range counts its tokens and answers each sender with those that others hold. Blocks are bounded in
size, and hot tokens count once for each document, whatever their range. Tokens are 48 bits of a 64-bit hash there: a chance
equality of two of a pair's tokens is as likely in a large corpus as in a small one, about n^2 / 2^48."""

from __future__ import annotations

import hashlib
import logging
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.common import Memo, cut, release
from cipherlake.llm.components import components

LOG = logging.getLogger(__name__)
WIDTH = 5
SIMILARITY = (75, 100)
RARE = 16
CHUNK_TOKENS, CHUNK_DOCS = 1_000_000, 60_000
TILE = 2000
RANGE_CHARS = 48_000_000  # characters of text whose tokens, about 8 million, one range counts
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[3]
    h = (h ^ (h >> np.uint64(29))) * _ODD[4]
    return h ^ (h >> np.uint64(32))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shingles(text: str | None, width: int, memo: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text: A-Z lower-cased, words split at ASCII white space. Fewer words
    than `width` are one shingle; no words, none."""
    words = (text or "").encode().lower().split()
    ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if not len(ids):
        return ids
    size = min(width, len(ids))
    h = np.full(len(ids) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mixed(h * _ODD[0] + ids[k : len(ids) - size + 1 + k] * _ODD[1] + _ODD[2])
    return np.unique(h)


def _pack(tokens: np.ndarray, docs: np.ndarray) -> bytes:
    """A block of ascending tokens and their documents: byte planes of the differences and of the documents. The last
    plane of each holds few different values and is coded, the others are as good as random."""
    steps = np.diff(tokens, prepend=np.uint64(0))
    first, steps[0] = steps[0], 0
    width = 4 if int(steps.max()) < 1 << 32 else 8
    steps = steps.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    docs = docs.astype("<u2").view(np.uint8).reshape(-1, 2).T
    return bytes([width]) + int(first).to_bytes(8, "little") + len(tokens).to_bytes(4, "little") + steps[:-1].tobytes() + docs[0].tobytes() + zlib.compress(steps[-1].tobytes() + docs[1].tobytes(), 1)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, first, n = block[0], int.from_bytes(block[1:9], "little"), int.from_bytes(block[9:13], "little")
    plain = np.frombuffer(block, np.uint8, n * width, 13).reshape(width, n)
    coded = np.frombuffer(zlib.decompress(block[13 + n * width :]), np.uint8).reshape(2, n)
    steps = np.ascontiguousarray(np.concatenate([plain[:-1], coded[:1]]).T).view(f"<u{width}").reshape(-1).astype(np.uint64)
    docs = np.ascontiguousarray(np.stack([plain[-1], coded[1]]).T).view("<u2").reshape(-1)
    return np.cumsum(steps) + np.uint64(first), docs


def least_common(n: int, similarity: tuple[int, int]) -> int:
    """Tokens that a set of n shares with any partner at least."""
    return -(-similarity[0] * n // similarity[1])


def signatures(tokens: np.ndarray, counts: np.ndarray, n: int, similarity: tuple[int, int], rare: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set of n tokens, and how many tokens of the set come before each (0 for combinations, where
    nothing follows from it); given are the tokens that other documents hold and how many hold them."""
    order = np.lexsort((tokens, counts))
    tokens, counts, unique = tokens[order], counts[order], n - len(tokens)
    short = n - least_common(n, similarity) + 1 - unique  # of the tokens given
    if short <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    alone = tokens[:short][counts[:short] <= rare]
    places = unique + np.arange(len(alone))
    if counts[short - 1] <= rare:
        return alone, places
    if 3 * similarity[0] <= 2 * similarity[1]:  # too few common tokens for neighbouring pairs
        return tokens[:short], unique + np.arange(short)
    longer = 2 * (similarity[1] - similarity[0]) * n // similarity[1] + 2 - unique
    frequent = tokens[:longer][counts[:longer] > rare]
    return np.concatenate([alone, _mixed(_mixed(frequent[:-1] + _ODD[0]) + frequent[1:])]), np.concatenate([places, np.zeros(max(0, len(frequent) - 1), np.int64)])


def histogram(tokens: np.ndarray, n: int) -> bytes | None:
    """Counts of tokens in a power of two of cells, at least n; the sum of the smaller counts of two sets' cells is no
    less than the number of their common tokens. None where a count doesn't fit into a byte."""
    cells = 1 << max(6, (n - 1).bit_length())
    counts = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def bounded_pairs(n: np.ndarray, hist: list[bytes | None], wanted: Callable[[np.ndarray, np.ndarray], np.ndarray], similarity: tuple[int, int],
                  strip: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of wanted rows, i before j, whose sizes and histograms allow the similarity."""
    size = np.array([0 if h is None else len(h) for h in hist])
    kinds = sorted(set(size.tolist()))
    rows = {k: np.flatnonzero(size == k) for k in kinds}
    counts = {k: np.frombuffer(b"".join(hist[r] for r in rows[k]), np.uint8).reshape(-1, k) for k in kinds if k}
    for a, low in enumerate(kinds):
        for high in kinds[a:]:
            if low and high > 4 * low:  # sizes too far apart for a similarity of one half
                continue
            other = counts[high].reshape(len(rows[high]), -1, low).sum(1, dtype=np.uint16) if low and high > low else counts.get(low)
            step = max(1, strip // max(1, len(rows[high]) * max(1, low)))
            for at in range(0, len(rows[low]), step):
                i, j = np.meshgrid(rows[low][at : at + step], rows[high], indexing="ij")
                common = np.ceil((n[i] + n[j]) * similarity[0] / sum(similarity))
                may = wanted(i, j) & (np.minimum(n[i], n[j]) * similarity[1] >= np.maximum(n[i], n[j]) * similarity[0])
                if low == high:
                    may &= i < j
                p, q = np.nonzero(may)
                if low:
                    bound = np.concatenate([np.minimum(counts[low][at + p[k : k + 5000]], other[q[k : k + 5000]]).sum(1, dtype=np.int64) for k in range(0, len(p), 5000)] or [np.empty(0, np.int64)])
                    fits = bound >= common[p, q]
                    p, q = p[fits], q[fits]
                if len(p):
                    yield i[p, 0], j[0, q]


def _blocks(docs: DataFrame, width: int, ranges: int) -> DataFrame:
    """(part, chunk, body): for part < ranges a block of tokens of that range; else the chunk's documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(word_hash)
        task, made = TaskContext.get().partitionId(), 0
        ids, prints, sets, size = [], [], [], 0

        def flush() -> pd.DataFrame:
            chunk = task << 24 | made
            lens = np.array([len(s) for s in sets])
            tokens = np.concatenate(sets) >> np.uint64(16)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], np.repeat(np.arange(len(sets)), lens)[order]
            part = (tokens >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)
            starts = np.flatnonzero(np.diff(part, prepend=np.uint64(ranges + 1)))
            ends = np.append(starts, len(part))[1:]
            rows = [(int(part[a]), _pack(tokens[a:b], owner[a:b])) for a, b in zip(starts, ends, strict=True)]
            about = "\n".join(f"{f}{n} {'' if i is None else i}" for i, f, n in zip(ids, prints, lens, strict=True))
            rows.append((ranges + chunk % ranges, about.encode()))
            return pd.DataFrame({"part": [p for p, _ in rows], "chunk": chunk, "body": [b for _, b in rows]})

        for b in batches:
            for doc_id, text in zip(b["id"], b["text"], strict=True):
                found = shingles(text, width, memo)
                ids.append(doc_id)
                prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest())
                sets.append(found)
                size += len(found)
                if size >= CHUNK_TOKENS or len(sets) >= CHUNK_DOCS:
                    yield flush()
                    made, size = made + 1, 0
                    ids, prints, sets = [], [], []
        if sets:
            yield flush()

    return docs.mapInPandas(run, "part long, chunk long, body binary")


_ANSWER = np.dtype([("doc", "<u2"), ("count", "<u4"), ("token", "<u8")])


def _answers(blocks: DataFrame, ranges: int) -> DataFrame:
    """(chunk, about, body): the tokens of a chunk's documents that other documents hold, with their counts."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= ranges:
            return pd.DataFrame({"chunk": group["chunk"], "about": True, "body": group["body"]})
        group = group.sort_values("chunk")
        parts = [_unpack(b) for b in group["body"]]
        tokens, docs = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        source = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(p[0]) for p in parts])
        order = np.argsort(tokens, kind="stable")
        tokens, docs, source = tokens[order], docs[order], source[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        n = np.repeat(np.diff(np.append(starts, len(tokens))), np.diff(np.append(starts, len(tokens))))
        keep = n > 1
        tokens, docs, source, n = tokens[keep], docs[keep], source[keep], n[keep]
        order = np.argsort(source, kind="stable")
        out = np.empty(len(order), _ANSWER)
        out["doc"], out["count"], out["token"] = docs[order], n[order], tokens[order]
        cuts = np.searchsorted(source[order], np.arange(len(parts) + 1))
        rows = [(c, out[a:b]) for c, a, b in zip(group["chunk"], cuts[:-1], cuts[1:], strict=True) if b > a]
        bodies = [b"".join(r[f].tobytes() for f in ("doc", "count", "token")) for _, r in rows]
        return pd.DataFrame({"chunk": [c for c, _ in rows], "about": False, "body": bodies})

    return blocks.groupBy("part").applyInPandas(run, "chunk long, about boolean, body binary")


def _sets(answers: DataFrame, similarity: tuple[int, int], rare: int) -> DataFrame:
    """One row per document: ref (a number of its own), id, print (equal for equal sets), n, and for documents that may
    have a partner (of a chunk's equal sets the first) their shared tokens and index entries."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lines = [x for b in group["body"][group["about"]] for x in b.decode().split("\n")]
        docs, counts, tokens = [], [], []
        for body in group["body"][~group["about"]]:
            n = len(body) // _ANSWER.itemsize
            docs.append(np.frombuffer(body, "<u2", n))
            counts.append(np.frombuffer(body, "<u4", n, 2 * n))
            tokens.append(np.frombuffer(body, "<u8", n, 6 * n))
        doc, count, token = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (docs, counts, tokens))
        order = np.argsort(doc, kind="stable")
        doc, count, token = doc[order], count[order], token[order]
        cuts = np.searchsorted(doc, np.arange(len(lines) + 1))
        rows, seen = [], set()
        for k, line in enumerate(lines):
            about, _, doc_id = line.partition(" ")
            name, n = about[:32], int(about[32:])
            own, held = token[cuts[k] : cuts[k + 1]], count[cuts[k] : cuts[k + 1]]
            live = n > 0 and len(own) >= least_common(n, similarity) and name not in seen
            if live:
                seen.add(name)
            entries, places = signatures(own, held, n, similarity, rare) if live else (None, None)
            rows.append((key[0] << 16 | k, doc_id or None, name, n, own.astype(np.int64) if live else None, entries.view(np.int64) if live else None, places, histogram(own, n) if live else None))
        return pd.DataFrame(rows, columns=["ref", "id", "print", "n", "tokens", "entries", "places", "cells"])

    return answers.groupBy("chunk").applyInPandas(run, "ref long, id string, print string, n long, tokens array<long>, entries array<long>, places array<int>, cells binary")


def _tiled(members: DataFrame, pool: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of documents of different components that share an entry and that sizes and histograms allow.

    Entries often have much the same documents, so documents that entries connect form a family; a family is compared
    as one group where that is less work than its entries one by one. Documents of a group are dealt to tiles of about
    TILE by a hash; a task compares two tiles and gives back only pairs that pass the bound, so a group of very many
    documents is neither gathered in one task nor made all its pairs."""
    families = components(members.select("ref", F.col("main_ref").alias("hub")), "ref", "hub").select(F.col("node").alias("ref"), F.col("root").alias("family"))
    rows = cut(members.join(families, "ref").select("entry", "ref", "n", "root", "members", "family"))
    whole = rows.groupBy("family").agg(F.count_distinct("ref").cast("double").alias("docs"), F.sum(F.col("members").cast("double")).alias("work"))
    rows = rows.join(whole, "family").withColumn("as_family", F.col("docs") * F.col("docs") <= F.col("work"))
    one = rows.where("as_family").groupBy("ref").agg(*[F.first(c).alias(c) for c in ("n", "root", "family", "docs")])
    rows = rows.where("not as_family").select(F.lit(False).alias("kind"), F.col("entry").alias("group"), "ref", "n", "root", "members").unionAll(
        one.select(F.lit(True), "family", "ref", "n", "root", F.col("docs").cast("long")))
    rows = rows.join(pool.select("ref", "cells"), "ref").withColumn("tiles", F.ceil(F.col("members") / TILE).cast("int"))
    own = F.pmod(F.xxhash64("ref"), F.col("tiles")).cast("int")
    rows = rows.withColumn("tile", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumns({"low": F.least("tile", "with"), "high": F.greatest("tile", "with")}).drop("tiles", "with")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ref, root, n, tile = (group[c].to_numpy() for c in ("ref", "root", "n", "tile"))
        apart = key[2] != key[3]
        wanted = lambda i, j: (root[i] != root[j]) & (tile[i] != tile[j] if apart else True)
        found = list(bounded_pairs(n.astype(np.int64), group["cells"].tolist(), wanted, similarity))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        return pd.DataFrame({"a": np.minimum(ref[i], ref[j]), "b": np.maximum(ref[i], ref[j])})

    return rows.groupBy("kind", "group", "low", "high").applyInPandas(compare, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of refs whose sets reach the similarity."""
    tokens = sets.where(F.col("tokens").isNotNull())
    left = pairs.join(tokens.select(F.col("ref").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a")), "a")
    both = left.join(tokens.select(F.col("ref").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b")), "b")
    common = F.size(F.array_intersect("t_a", "t_b"))
    return both.withColumn("common", common).where(F.col("common") * similarity[1] >= (F.col("n_a") + F.col("n_b") - F.col("common")) * similarity[0]).select("a", "b")


def classes(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY, rare: int = RARE, ranges: int | None = None,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Null and empty texts, and texts of white space alone, have no shingles and link with nothing. Rows of equal ids are
    rows of their own. A null id is a component's smallest only where it has no other; components of rows without links
    are their own ids. Very long texts are documents like others. Other columns aren't looked at; an empty table gives no
    rows. `similarity` is a fraction of at least one half, as (numerator, denominator)."""
    if not similarity[1] <= 2 * similarity[0] <= 2 * similarity[1]:
        raise ValueError("similarity must be from 1/2 to 1")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    if ranges is None:  # as many as the texts ask for, so that what one task counts doesn't grow with the corpus
        chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
        ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE_CHARS))
    sets = cut(_sets(_answers(_blocks(rows, width, ranges), ranges), similarity, rare).withColumn("id", F.col("id").cast(kind)))
    release(spark)

    def may_link(x: str, y: str) -> Column:
        """Sizes and places that allow a link: a pair's first common token has only uncommon ones before it, in either
        set, and they can't be more than the sizes allow. (Later common tokens may be passed over: the first isn't.)"""
        n_x, n_y = F.col(f"{x}n"), F.col(f"{y}n")
        common = F.ceil((n_x + n_y) * similarity[0] / (similarity[0] + similarity[1]))
        return (F.least(n_x, n_y) * similarity[1] >= F.greatest(n_x, n_y) * similarity[0]) & (F.col(f"{x}place") <= n_x - common) & (F.col(f"{y}place") <= n_y - common)

    # the member of an entry that meets the others is the one with the fewest tokens of its own: the original of a group
    # of near copies links with all of them, which two copies with different changes may not
    apart = ((F.col("n") - F.size("tokens")) * 1000 / F.col("n")).cast("int").alias("apart")
    member = sets.where(F.size("entries") > 0).select("ref", F.col("n").cast("int").alias("n"), apart, F.inline(F.arrays_zip("entries", "places")))
    member = member.select(F.col("entries").alias("entry"), "apart", "ref", "n", F.col("places").alias("place")).repartition("entry")
    doc = F.struct("apart", "ref", "n", "place")
    first = member.groupBy("entry").agg(F.min(doc).alias("c"), F.max("ref").alias("most"), F.min("ref").alias("least")).where("least < most").select(
        "entry", F.col("c.ref").alias("c_ref"), F.col("c.n").alias("c_n"), F.col("c.place").alias("c_place"))
    member = cut(member.join(first, "entry"))  # entries with more than one document
    pool = cut(sets.select("ref", "n", "tokens", "cells").join(member.select("ref").distinct(), "ref", "left_semi"))
    release(spark)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    met = member.where((F.col("ref") != F.col("c_ref")) & may_link("", "c_"))
    # each document meets the one of them with which it shares most entries; the rounds below see to the others
    met = met.groupBy("ref", "c_ref").agg(F.count("*").alias("shared")).groupBy("ref").agg(F.max_by("c_ref", F.struct("shared", "c_ref")).alias("c_ref"))
    links = linked(met.select(*pair("ref", "c_ref")).distinct(), pool, similarity)
    same = sets.where(F.col("entries").isNotNull()).groupBy("print").agg(F.min("ref").alias("a"), F.max("ref").alias("z")).where("a < z")
    copies = sets.where(F.col("entries").isNotNull()).select("print", F.col("ref").alias("b")).join(same, "print").where("a < b").select("a", "b")
    links = cut(links.unionAll(copies).distinct())
    del met, copies, same, first
    release(spark)
    roots = components(links, "a", "b")

    # entries that still hold more than one component: the most central document outside the main component meets those
    # of other components, as long as entries are larger than a tile and that joins enough; the rest is compared in tiles
    left, before = member.select("entry", "apart", "ref", "n", "place"), None
    while True:
        held = left.join(roots.select(F.col("node").alias("ref"), "root"), "ref", "left").withColumn("root", F.coalesce("root", "ref"))
        mixed = held.groupBy("entry").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"), F.min(F.struct("apart", "ref", "root")).alias("first")).where("low < high")
        open_ = cut(held.join(mixed.select("entry", "members", F.col("first.root").alias("main"), F.col("first.ref").alias("main_ref")), "entry"))
        left = open_.select("entry", "apart", "ref", "n", "place")
        members, work = open_.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("root") != F.col("main"), F.col("members"))), F.lit(0))).first()
        LOG.debug("entries of several components: %d members, %d pairs", members, work)
        if members == 0:
            break
        last = work <= TILE * members or (before is not None and work > 0.7 * before)
        before = work
        if last:
            found = _tiled(open_, pool, similarity)
        else:
            outside = open_.where("root != main").groupBy("entry").agg(F.min(F.struct("apart", "ref", "n", "place", "root")).alias("c"))
            outside = outside.select("entry", *[F.col(f"c.{c}").alias(f"c_{c}") for c in ("ref", "n", "place", "root")])
            found = open_.join(outside, "entry").where((F.col("root") != F.col("c_root")) & may_link("", "c_")).select(*pair("ref", "c_ref"))
        more = cut(linked(found.distinct(), pool, similarity))
        # what is joined already stands as stars around the roots; only those and the new links go through the rounds again
        joined = roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        del held, mixed, found
        roots = components(joined.unionAll(more), "a", "b")
        if last:
            break

    # documents of equal sets share a print; each print hangs on one component
    by_print = (sets.where(F.col("entries").isNotNull()).select("print", "ref").join(roots.select(F.col("node").alias("ref"), "root"), "ref", "left")
                .groupBy("print").agg(F.min(F.coalesce("root", "ref")).alias("root")))
    groups = sets.where("n > 0").groupBy("print").agg(F.min("id").alias("least")).join(by_print, "print", "left")
    group = F.coalesce(F.col("root").cast("string"), F.col("print"))
    groups = groups.withColumn("group", group)
    least = groups.groupBy("group").agg(F.min("least").alias("component"))
    named = groups.join(least, "group").select("print", "component")
    out = sets.select("id", "n", "print").join(named, "print", "left")
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
