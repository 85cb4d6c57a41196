import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cipherlake.llm import op1_lines, op5_jaccard, op6_decontamination, op9_neighbours
from cipherlake.llm.components import components
from tests.llm.fixtures import documents, edge_docs, edge_rows, no_docs, prose


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_components_of_chains_stars_and_cycles(spark):
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5), (400, 399)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    clean = [p for p in pairs if None not in p and p[0] != p[1]]
    want = roots(clean, {x for p in clean for x in p})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


# --- line dedup

def plain_lines(text):
    return [" ".join(x.split()) for x in text.split("\n")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=40), st.lists(st.integers(0, 12), max_size=40))
def test_patience_gives_a_common_subsequence(a, b):
    pairs = op1_lines.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    if set(a) & set(b):
        assert pairs
    assert op1_lines.patience(a, a) == [(k, k) for k in range(len(a))]


def line_documents():
    r = random.Random(5)
    shared = [[prose(900 + k * 10 + j, 15) for j in range(4)] for k in range(4)]
    rows = []
    for k in range(40):
        lines = [prose(5000 + k * 50 + j, r.randint(4, 25)) for j in range(r.randint(2, 8))] + ["All rights reserved."]
        for block in r.sample(shared, r.randint(0, 2)):
            at = r.randint(0, len(lines))
            lines[at:at] = block
        rows.append((k, "\n".join(lines)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "\n\n" + rows[4][1].replace(" ", "  ") + "\n"), (103, "All rights reserved.\nshort")]
    return rows


def test_line_dedup_against_all_pairs(spark):
    """All lines of runs of at least 20 words that an earlier document has are gone, and nothing else than what
    aligning with every earlier document one by one would delete."""
    rows = line_documents()
    got = {r["doc_id"]: r for r in op1_lines.dedup(documents(spark, rows)).collect()}
    made = {i: op1_lines.profile_of(t, 20) for i, t in rows}
    changed = 0
    for i, text in rows:
        at, lines, words, _ = made[i]
        most = {at[q] for j, _ in rows if j < i for q in op1_lines.repeated(made[j][1], lines, words, 20)}
        runs = {tuple(made[j][1][a:b]) for j, _ in rows if j < i for a in range(len(made[j][1])) for b in range(a + 1, len(made[j][1]) + 1)}
        least = {at[q] for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if sum(words[a:b]) >= 20 and sum(words[a : b - 1]) < 20 and tuple(lines[a:b]) in runs for q in range(a, b)}
        gone = set(got[i]["dedup_removed"])
        assert least <= gone <= most
        assert got[i]["text"] == ("\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone) if gone else text)
        changed += bool(gone)
    assert changed > 10
    assert got[100]["text"] == got[101]["text"] == "" and got[102]["text"].strip() == "" and got[103]["dedup_removed"] == []
    assert got[100]["dedup_sources"][0] == 3


def test_line_dedup_keeps_clean_documents_and_edges(spark):
    docs = edge_docs(spark)
    out = op1_lines.dedup(docs)
    assert out.columns == [*docs.columns, "dedup_lines", "dedup_removed", "dedup_sources"]
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert op1_lines.dedup(no_docs(spark)).collect() == []
    twice = documents(spark, [(None, prose(1, 60)), (4, prose(1, 60)), (4, prose(1, 60)), (None, prose(1, 60))])
    assert sorted((str(r["doc_id"]), len(r["text"]) > 0) for r in op1_lines.dedup(twice).collect()) == [("4", True), ("4", True), ("None", False), ("None", False)]


def test_blocks_that_shared_short_lines_cross(spark):
    """A block goes wherever it lies between lines that both documents have, however many of those there are."""
    long, block, short = prose(11, 60), [prose(20 + k, 15) for k in range(4)], [f"heading {k}" for k in range(6)]
    rows = [(1, "\n".join(["l1", long])), (2, "\n".join([long, "l1"])), (3, "\n".join([*short, *block])), (4, "\n".join([*block, *short]))]
    got = {r["doc_id"]: r for r in op1_lines.dedup(documents(spark, rows)).collect()}
    assert got[2]["text"] == "l1" and got[2]["dedup_sources"] == [1]
    assert got[4]["text"] == "\n".join(short) and got[4]["dedup_sources"] == [3]
    assert got[1]["dedup_removed"] == got[3]["dedup_removed"] == []


def test_block_ends_beyond_the_first_holder(spark):
    """The end of a block goes although the first holder of its seeds lacks it; sources name both."""
    x, y, z = prose(30, 25), prose(31, 8), prose(32, 6)
    rows = [(1, "\n".join(["a b", x, "c d"])), (2, "\n".join(["e f", x, y, z, "g h"])), (3, "\n".join(["i j", x, y, z, "k l"])), (4, "\n".join(["m n", z, x, "o p"]))]
    got = {r["doc_id"]: (r["text"], r["dedup_sources"]) for r in op1_lines.dedup(documents(spark, rows)).collect()}
    assert got == {1: (rows[0][1], []), 2: ("\n".join(["e f", y, z, "g h"]), [1]), 3: ("i j\nk l", [1, 2]), 4: (f"m n\n{z}\no p", [1])}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=25), st.lists(st.integers(1, 9), max_size=25))
def test_repeated_is_every_common_run(a, b):
    words = lambda x: [3 * k for k in x]
    runs = {tuple(a[p:q]) for p in range(len(a)) for q in range(p + 1, len(a) + 1)}
    want = {k for p in range(len(b)) for q in range(p + 1, len(b) + 1) if sum(words(b[p:q])) >= 20 and tuple(b[p:q]) in runs for k in range(p, q)}
    assert op1_lines.repeated(a, b, words(b), 20) == sorted(want)


def test_nothing_goes_without_alignment(monkeypatch):
    """Lines go because they are aligned: without an alignment none does."""
    a, b = [1, 2, 3, 4, 9, 5, 6], [5, 6, 7, 1, 2, 3]
    words = [15, 15, 4, 15, 15, 4]
    assert op1_lines.repeated(a, b, words, 20) == [0, 1, 3, 4, 5]
    monkeypatch.setattr(op1_lines, "patience", lambda x, y: [])
    assert op1_lines.repeated(a, b, words, 20) == []


@pytest.mark.parametrize("kinds", [2, 8, 1000])
def test_long_repetitive_documents(kinds):
    """Tens of thousands of lines of few kinds, in another order too, take seconds, not hours."""
    r = random.Random(kinds)
    a, b = ([r.randrange(kinds) for _ in range(30_000)] for _ in range(2))
    start = time.monotonic()
    assert op1_lines.repeated(a, a[15_000:] + a[:15_000], [10] * 30_000, 20) == list(range(30_000))
    runs = set(zip(a, a[1:]))
    assert op1_lines.repeated(a, b, [10] * 30_000, 20) == sorted({k + d for k, x in enumerate(zip(b, b[1:])) if x in runs for d in (0, 1)})
    assert op1_lines.repeated([0, 1] * 15_000, [1, 1, 0] * 10_000, [10] * 30_000, 20) == list(range(1, 30_000))
    assert time.monotonic() - start < 60


# --- Jaccard join

@pytest.mark.parametrize("a, b, similarity", [([1, 2, 3, 4], [1, 3, 5, 4], (60, 100)), ([1], [1, 2], (50, 100)), ([1, 3], [1, 2, 3], (2, 3))])
def test_sets_of_frequent_tokens_share_an_entry_at_low_similarities(a, b, similarity):
    entries = [set(op5_jaccard.signatures(np.array(x, np.uint64), np.array([100 + t for t in x]), len(x), similarity, 16)[0].tolist()) for x in (a, b)]
    assert entries[0] & entries[1]


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[k : k + 5]) for k in range(len(words) - 4)])


def edited(text, rng, share):
    return " ".join(rng.choice(["new", "other", "word"]) + str(rng.randint(0, 999)) if rng.random() < share else w for w in text.split())


def jaccard_documents():
    r = random.Random(8)
    rows = [(k, prose(100 + k, r.randint(3, 150))) for k in range(60)]
    base = prose(7, 120)
    rows += [(1000 + k, edited(base, r, 0.02)) for k in range(70)]  # a large group of near copies: frequent tokens
    passage = prose(9, 60)
    rows += [(2000 + k, f"{passage} {prose(3000 + k, r.choice([5, 8, 12, 40]))}") for k in range(50)]  # one passage in all
    rows += [(3000 + k, edited(rows[k % 60][1], r, 0.01)) for k in range(60)] + [(4000 + k, rows[k][1].upper()) for k in range(5)]
    rows += [(5000, "a b c"), (5001, "A  b\tC"), (5002, "c b a"), (5003, ""), (5004, None), (5005, "a b c"), (5006, "ümlaut"), (5007, "ÜMLAUT")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("similarity", "rare"), [((75, 100), 16), ((75, 100), 2), ((50, 100), 3), ((9, 10), 4)])
def test_jaccard_against_all_pairs(spark, similarity, rare):
    rows = jaccard_documents()
    sets = {i: plain_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b]
             and (c := len(sets[a] & sets[b])) * similarity[1] >= similarity[0] * (len(sets[a]) + len(sets[b]) - c)]
    want = roots(links, ids)
    got = op5_jaccard.classes(documents(spark, rows), similarity=similarity, rare=rare).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_similar_sets_share_an_index_entry(data):
    """Any two sets at the threshold, any token counts: the entries of both have one in common."""
    a = data.draw(st.sets(st.integers(0, 60), min_size=1, max_size=40))
    x = data.draw(st.sets(st.sampled_from(sorted(a)), max_size=len(a) // 3))
    y = data.draw(st.sets(st.integers(100, 130), max_size=len(a) // 3))
    b = (a - x) | y
    common = len(a & b)
    if a == b or 100 * common < 75 * (len(a) + len(b) - common):
        return
    count = {t: data.draw(st.integers(2, 40)) if t in (a & b) else data.draw(st.integers(1, 40)) for t in sorted(a | b)}
    entries = []
    for s in (a, b):
        shared = np.array(sorted(t for t in s if count[t] > 1), np.uint64)
        entries.append(set(op5_jaccard.signatures(shared, np.array([count[int(t)] for t in shared]), len(s), (75, 100), 16)[0].tolist()))
    assert entries[0] & entries[1]


def test_histogram_bounds_lose_no_similar_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 48, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base[: rng.integers(60, 300)])[: rng.integers(50, 300)], rng.integers(0, 1 << 48, rng.integers(0, 60), dtype=np.uint64)])) for _ in range(60)]
    n = np.array([len(x) for x in sets])
    root = np.arange(60) // 2
    hist = [op5_jaccard.histogram(x, len(x)) if k % 9 else None for k, x in enumerate(sets)]
    got = {tuple(sorted(p)) for i, j in op5_jaccard.bounded_pairs(n, hist, lambda i, j: root[i] != root[j], (75, 100), strip=3000) for p in zip(i.tolist(), j.tolist(), strict=True)}
    inter = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    every = [(a, b) for a in range(60) for b in range(a + 1, 60) if root[a] != root[b]]
    similar = {(a, b) for a, b in every if 100 * inter(a, b) >= 75 * (n[a] + n[b] - inter(a, b))}
    assert similar and similar <= got < set(every)


def test_token_blocks_come_back():
    rng = np.random.default_rng(1)
    for tokens in (np.sort(rng.integers(0, 1 << 48, 500, dtype=np.uint64)), np.array([7], np.uint64), np.array([1, 1, 2, (1 << 48) - 1], np.uint64)):
        docs = rng.integers(0, 60_000, len(tokens))
        t, d = op5_jaccard._unpack(op5_jaccard._pack(tokens, docs))
        assert (t == tokens).all() and (d == docs).all()


def test_jaccard_edges(spark):
    rows = op5_jaccard.classes(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    assert sorted(str(r["component_id"]) for r in rows if r["n_shingles"] == 0) == ["2", "3", "4", "None"]
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] == 1) == [(1, 1)] * 3
    assert op5_jaccard.classes(no_docs(spark)).collect() == []
    same = op5_jaccard.classes(documents(spark, [(None, prose(1, 30)), (9, prose(1, 30)), (8, prose(1, 30))])).collect()
    assert {r["component_id"] for r in same} == {8}
    with pytest.raises(ValueError):
        op5_jaccard.classes(no_docs(spark), similarity=(40, 100))


# --- decontamination

def plain_alignment(window, item):
    h = np.zeros((len(item) + 1, len(window) + 1), int)
    for i, x in enumerate(item, 1):
        for j, y in enumerate(window, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=25), st.lists(st.integers(1, 6), min_size=1, max_size=15))
def test_local_alignment_equals_the_plain_recurrence(window, item):
    score, a, b, c, d = op6_decontamination.local_alignment(np.array(window), np.array(item))
    assert score == plain_alignment(window, item)
    if score:
        assert plain_alignment(window[a:b], item[c:d]) == score


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    r = random.Random(3)
    items = [(k, prose(700 + k, 25)) for k in range(20)] + [(50, None), (51, "too short"), (53, "Zebra, quagga!"), (54, "..."), (55, "  "), (None, prose(1, 20)), (52, items_text := prose(760, 30))]
    docs, want = [(k, prose(k, 200)) for k in range(60)], set()
    for k in range(20):
        words = items[k][1].split()
        for i in r.sample(range(0, len(words), 5), 3):
            words[i] = "changed"
        docs += [(100 + k, f"{prose(200 + k, 60)} {items[k][1].upper().replace(' ', ', ')} {prose(300 + k, 60)}"), (200 + k, f"{prose(400 + k, 300)}\n{' '.join(words)}"), (300 + k, " ".join(items[k][1].split()[:6]))]
        want |= {(100 + k, k), (200 + k, k)}
    docs += [(400, f"{items[1][1]} {prose(2, 80)} {items_text}"), (401, None), (402, ""), (403, f"{prose(9, 30)} is too short; {prose(8, 30)} TOO\nshort"), (404, "quagga zebra too shorts"), (405, "zebra quagga")]
    want |= {(400, 1), (400, 52), (403, 51), (405, 53)}
    d, b = documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    for block_words in (1_000_000, 200):
        indexes = op6_decontamination.fit(d, b, block_words=block_words)
        assert (len(indexes) > 1) == (block_words == 200)
        got = d.select("doc_id", F.explode(op6_decontamination.leaks(indexes, F.col("text"))).alias("x")).select("doc_id", "x.*").collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
        assert all(0.5 <= r["score"] <= 1 and r["start_word"] < r["end_word"] for r in got)


def test_items_of_few_words_are_found_whole(spark):
    """An item below the seeds' length is found where its words follow each other, at its first place."""
    d = documents(spark, [(1, "one, two three"), (2, "two one three two one"), (3, "one"), (4, "three"), (5, "One - two"), (6, None)])
    b = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "two one"), (4, "two one")], "item_id long, text string")
    got = d.select("doc_id", F.explode(op6_decontamination.leaks(op6_decontamination.fit(d, b), F.col("text"))).alias("x")).select("doc_id", "x.*").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1.0, 0, 2, 0, 2), (1, 2, 1.0, 2, 3, 0, 1), (2, 2, 1.0, 2, 3, 0, 1), (2, 3, 1.0, 0, 2, 0, 2), (2, 4, 1.0, 0, 2, 0, 2), (4, 2, 1.0, 0, 1, 0, 1), (5, 1, 1.0, 0, 2, 0, 2)]


def test_alignment_memory_is_that_of_a_few_rows():
    """A window of a million words with an item of 300 takes a few rows, not the whole matrix (2.4 GB)."""
    rng = np.random.default_rng(2)
    item, window = rng.integers(1, 50, 300), rng.integers(0, 50, 1_000_000)
    window[700_000:700_300] = item
    window[700_100] = 0
    tracemalloc.start()
    try:
        score, a, b, c, d = op6_decontamination.local_alignment(window, item)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (score, a, b, c, d) == (2 * 299 - 1, 700_000, 700_300, 0, 300)
    assert peak < 150_000_000


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, prose(5, 20))], "item_id long, text string")
    for d, b in ((edge_docs(spark), bench), (no_docs(spark), bench), (edge_docs(spark), bench.limit(0))):
        rows = d.select(op6_decontamination.leaks(op6_decontamination.fit(d, b), F.col("text")).alias("x")).collect()
        assert len(rows) == d.count() and all(r["x"] == [] for r in rows)


# --- embeddings

def vectors(seed, n, width):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * np.linspace(2, 0.2, width)
    x[n // 2 : n // 2 + n // 5] = x[0] + rng.normal(0, 0.05, (n // 5, width))
    x[-20:] = x[1]
    return x


@pytest.mark.parametrize(("width", "threshold", "tile"), [(24, 0.95, 64), (3, 0.999, 40), (24, 0.8, 4096)])
def test_neighbours_against_all_pairs(spark, width, threshold, tile):
    x = vectors(6, 400, width)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= threshold) & ~np.eye(len(x), dtype=bool)
    want = roots(np.argwhere(near).tolist(), range(len(x)))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = op9_neighbours.near_duplicates(df, threshold=threshold, tile=tile).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(near.sum(1).tolist()))
    assert {r["vec_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_neighbours_edges(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [2.0, 0.0], "b"), (2, None, None), (3, [0.0, 0.0], ""), (4, [float("nan"), 1.0], ""), (5, [float("inf"), 1.0], ""), (6, [None, 1.0], ""), (7, [], ""),
            (8, [1.0, 0.0, 0.0], ""), (None, [1.0, 0.0], "x"), (9, [1e300, 1e298], ""), (10, [1e-300, 0.0], ""), (None, None, ""), (11, [-1.0, 0.0], "")]
    got = op9_neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert by[1] == [(4, 1, True)] * 2 and by[9] == [(4, 1, False)] and by[10] == [(4, 1, False)]
    assert sorted(by[None], key=str) == sorted([(4, 1, False), (0, None, False)], key=str)
    assert all(by[k] == [(0, k, True)] for k in (2, 3, 4, 5, 6, 7, 8, 11))
    assert op9_neighbours.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []
