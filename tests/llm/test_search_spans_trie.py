import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cipherlake.llm import catalog, op11_ranking, op12_spans, op13_trie
from tests.llm.fixtures import documents, edge_docs, edge_rows, no_docs, prose

NAMES = ["op11_ranked_search", "op12_substring_dedup", "op13_conversation_trie"]


def text_rows(df):
    return sorted(map(str, df))


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf_dir)
    want = con.sql(catalog.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert text_rows(tuple(r) for r in got.collect()) == text_rows(tuple(r[k] for k in at) for r in want.fetchall())


# --- ranked search

def plain_rank(docs, items, top=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    made = [(i, words(t)) for i, t in docs]
    n_docs, length = sum(bool(w) for _, w in made), sum(len(w) for _, w in made)
    df = Counter(w for _, ws in made for w in set(ws))
    out = []
    for item, text in set(items):
        scored = []
        for i, ws in made:
            tf, total = Counter(ws), 0
            for w in words(text):
                if tf[w]:
                    total += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * tf[w] // (1000 * tf[w] + 12 * (75 + 25 * len(ws) * n_docs // length)))
            if total > 0:
                scored.append((-total, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


ITEMS = [(1, "alpha Beta gamma, 3x"), (1, "alpha Beta gamma, 3x"), (1, "other text"), (None, "under"), (2, None), (3, ""), (4, "?!"), (5, "ÜMLÄÜT 你好 Ärger ärger"), (6, "a a a A text"), (7, "missing-word")]


def test_ranked_search_against_brute_force(spark):
    docs = [(r[0], r[1]) for r in edge_rows()] + [(100 + k, prose(k, 30, 60)) for k in range(60)] + [(200 + k % 7, "alpha text 3x Ärger") for k in range(40)]
    items = ITEMS + [(20 + k, prose(70 + k, 25, 60)) for k in range(12)]
    for blocks in (32_000_000, 200):
        got = op11_ranking.rank(documents(spark, docs).repartition(5), spark.createDataFrame(items, "item_id long, text string"), top=6, block_bytes=blocks)
        assert text_rows(tuple(r) for r in got.collect()) == text_rows(plain_rank(docs, items, 6))


def test_ranked_search_on_edges(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({"score": F.lit(1), "rank": F.lit("x"), "doc_id": F.lit(None).cast("long")})
    got = op11_ranking.rank(edge_docs(spark), items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert text_rows(tuple(r) for r in got.collect()) == text_rows(plain_rank([(r[0], r[1]) for r in edge_rows()], ITEMS))
    assert op11_ranking.rank(no_docs(spark), items).collect() == [] and op11_ranking.rank(edge_docs(spark), items.limit(0)).collect() == []


def test_heaps_keep_the_smallest_ids_of_equal_scores(spark):
    docs = spark.range(0, 3000, 1, 7).select((3000 - F.col("id")).alias("doc_id"), F.lit("same words here").alias("text"))
    got = op11_ranking.rank(docs.unionByName(documents(spark, [(9000 + k, "else") for k in range(3000)])), spark.createDataFrame([(1, "words")], "item_id long, text string"))
    assert sorted((r["rank"], r["doc_id"]) for r in got.collect()) == [(k, k) for k in range(1, 21)]


# --- substring dedup

def plain_spans(rows, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    place = [(i is None, i or 0) for i, _ in rows]
    first = {}
    for p, ws in zip(place, words, strict=True):
        for s in range(len(ws) - k + 1):
            g = tuple(ws[s : s + k])
            first[g] = min(first.get(g, p), p)
    out = []
    for (i, _), p, ws in zip(rows, place, words, strict=True):
        gone = {q for s in range(len(ws) - k + 1) if first[tuple(ws[s : s + k])] < p for q in range(s, s + k)}
        out.append((i, len(ws), len(gone), " ".join(w for q, w in enumerate(ws) if q not in gone)))
    return out


def run_spans(spark, rows, **options):
    return [tuple(r)[:4] for r in op12_spans.dedup(documents(spark, rows).repartition(3), **options).collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_against_brute_force(spark, seed):
    """Random walks over few words, so that there are loops, branches, repeats within a text and across many."""
    r = random.Random(seed)
    rows = []
    for n in range(60):
        words = [str(r.randint(0, 3)) for _ in range(r.randint(0, 40))]
        if rows and r.random() < 0.6:  # a piece of an earlier text
            piece = (r.choice(rows)[1] or "").split()
            words[3:3] = piece[r.randint(0, 5) : r.randint(5, 40)]
        rows.append((r.choice([None, n, n % 7, 100 - n]), r.choice([" ", "\n", " \t"]).join(words)))
    rows += [rows[3], rows[3], (rows[4][0], " " + rows[4][1]), (1000, "0 " * 200), (1001, "0 " * 90), (1002, "0 1 " * 60), (1003, "1 0 " * 60)]
    assert text_rows(run_spans(spark, rows, k=6, gram=3)) == text_rows(plain_spans(rows, 6))


def test_substring_dedup_of_passages(spark):
    """Passages shared by many texts, near copies, copies; spans name a source that holds the same words."""
    shared = [prose(10 + k, 60) for k in range(4)]
    rows = [(n, " ".join([prose(100 + n, 40 + n), shared[n % 4] if n % 3 else "", prose(200 + n, 30), shared[(n + 1) % 4] if n % 2 else "", "end"])) for n in range(50)]
    rows += [(60 + n, rows[n][1].replace("end", f"end {n} x")) for n in range(20)] + [(90, rows[7][1]), (91, rows[7][1]), (None, rows[8][1]), (-3, rows[9][1])]
    assert text_rows(run_spans(spark, rows)) == text_rows(plain_spans(rows, 13))
    texts = {i: t.split() for i, t in rows}
    checked = 0
    for r in op12_spans.dedup(documents(spark, rows)).collect():
        for s in r["spans"]:
            assert texts[r["doc_id"]][s["start"] : s["start"] + s["length"]] == texts[s["source_id"]][s["source_start"] : s["source_start"] + s["length"]]
            assert r["doc_id"] is None or s["source_id"] < r["doc_id"]
            checked += 1
    assert checked > 40


def test_paths_are_as_long_as_the_passage(spark):
    """A passage that a hundred texts hold is one path: two ends stand for all its windows."""
    passage = " ".join(f"p{k}" for k in range(300))
    rows = [(n, f"a{n} {passage} b{n}") for n in range(100)]
    got = op12_spans.dedup(documents(spark, rows)).collect()
    assert all(len(r["spans"]) == 1 and r["n_removed"] == 300 and r["spans"][0]["source_id"] == 0 for r in got if r["doc_id"])


def test_spans_whose_sums_differ_are_not_taken(spark, tmp_path):
    """A chance equality of hashes doesn't remove words: coordinates and second hashes must agree with the source."""
    edges = [(1, 100, 7), (2, 130, 57), (1, 900, 4), (2, 930, 54), (1, 1900, 4), (2, 1930, 55), (1, 2900, 4), (2, 2931, 54)]
    ends = spark.createDataFrame([(1, 100, 0, 30), (2, 100, 30, 30)], "edge long, path long, offset long, last long")
    got = op12_spans.spans(spark.createDataFrame(edges, "edge long, at long, sum long"), ends, 13, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(900, 100, 43)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.integers(2, 14), st.integers(1, 14))
def test_minimisers_are_the_smallest_of_each_window(ids, k, gram):
    gram = min(gram, k)
    ids = np.array(ids, np.uint64)
    h = op12_spans.runs(ids, gram, 2)
    assert op12_spans.minimisers(ids, k, gram).tolist() == [int(h[s : s + k - gram + 1].min()) for s in range(len(ids) - k + 1)]


def test_substring_dedup_on_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    out = op12_spans.dedup(edge_docs(spark))
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept", "spans"]
    assert text_rows(tuple(r)[:4] for r in out.collect()) == text_rows(plain_spans(rows, 13))
    assert op12_spans.dedup(no_docs(spark)).collect() == []
    clash = documents(spark, rows).withColumns({c: F.lit("x") for c in ("id", "hash", "ref", "spans", "n", "kept")})
    assert text_rows(tuple(r)[:4] for r in op12_spans.dedup(clash).collect()) == text_rows(plain_spans(rows, 13))


# --- conversation trie

def plain_trie(paths):
    members = {}
    for c, p in paths:
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ended = sorted(c for c, q in paths if tuple(q) == p)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], sum(not kids[q] for q in below),
                    sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below), hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()))
    return out


def plain_rebuilt(turns):
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            digest = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (role or "", text or "")))
    own = {c: [x[3] for x in sorted(ts)] for c, ts in own.items()}
    out = []
    for c, ts in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, int(math.copysign(abs(c) // 5 * 5, c)) if c else 0
        out.append((c, own.get(base, [])[:h] + ts[h:]))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, depth int"


def run_trie(spark, turns, **options):
    rebuilt = catalog.rebuilt_conversations(spark.createDataFrame([(*t, "x", 1) for t in turns], CONVERSATIONS))
    nodes = op13_trie.trie(rebuilt, **options).join(op13_trie.id_digests(op13_trie.ends(rebuilt)), "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    return [(*(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), r["ends_sha256"] or none) for r in nodes.collect()]


def made_turns(seed, convs, length):
    r = random.Random(seed)
    return [(c, r.choice([t, t, t, None, 1]), r.choice(["user", "assistant", None]), r.choice(["hi", "hello", "né 你", "", None])) for c in range(-12, convs) for t in range(r.randint(1, length))]


@pytest.mark.parametrize(("seed", "convs", "length", "shard"), [(1, 40, 12, 10), (2, 150, 4, 30), (3, 60, 9, 1_000_000), (4, 25, 1, 3)])
def test_trie_against_brute_force(spark, seed, convs, length, shard):
    """From one shard to one for every few turns, with spines that span several."""
    turns = made_turns(seed, convs, length)
    assert text_rows(run_trie(spark, turns, shard_turns=shard)) == text_rows(plain_trie(plain_rebuilt(turns)))


def test_trie_of_equal_and_long_conversations(spark):
    turns = [(5 * c, t, "u", "same") for c in range(80) for t in range(3)] + [(1000, t, "u", "same" if t < 300 else f"{t}") for t in range(700)] + [(None, 1, "u", "no id")]
    assert text_rows(run_trie(spark, turns, shard_turns=60)) == text_rows(plain_trie(plain_rebuilt(turns)))


def test_trie_on_edges(spark):
    assert run_trie(spark, []) == [] and run_trie(spark, [(None, None, None, None)]) == []
    for turns in ([(1, None, None, None)], [(1, 1, "u", "a"), (1, 1, "u", "a"), (0, 1, "u", "a")], [(-1, 3, None, "x" * 100_000), (-5, None, "", "")]):
        assert text_rows(run_trie(spark, turns)) == text_rows(plain_trie(plain_rebuilt(turns)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.booleans())
def test_findclose_and_ranks(steps, deep):
    bits, stack, close = [], [], {}
    for x in steps:
        for _ in range(2000 if deep and x == 3 else x):
            stack.append(len(bits))
            bits.append(True)
        if stack:
            close[stack.pop()] = len(bits)
            bits.append(False)
    while stack:
        close[stack.pop()] = len(bits)
        bits.append(False)
    tree = op13_trie.Parentheses(np.array(bits, bool))
    for at in [*list(close)[:: max(1, len(close) // 50)], *list(close)[:5]]:
        assert tree.findclose(at) == close[at]
        assert tree.opens[close[at]] - tree.opens[at] == sum(bits[at : close[at]])
