import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from cipherlake.llm import op3_packing, op4_matrices, tokens
from tests.llm.fixtures import edge_docs, edge_rows, no_docs


TOKENIZER = Tokenizer.from_file(tokens.default_vocabulary())


def plain_ids(text):
    tok = TOKENIZER
    return [*tok.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_equal_the_vocabularys_own_library(spark, sf_dir):
    encode = tokens.encoder(tokens.default_vocabulary()).ids
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + [r[1] for r in edge_rows()]
    texts += ["don't  we'll\n\n x\r\n\t y", " lead", "trail ", "    　 a", "<|endoftext|><|endoftext|> x<|endoftext|>"]
    for t in texts:
        assert encode(t).tolist() == plain_ids(t)


def test_pieces_cut_long_documents_only():
    assert tokens.pieces(2048, 2048) == [(0, 2048)]
    assert tokens.pieces(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]
    assert tokens.pieces(4096, 2048) == [(0, 2048), (2048, 2048)]


def check_packed(rows, texts, capacity):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    for doc_id, own in texts.items():
        ids = np.array(plain_ids(own), "<u4")
        got = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(len(got))) and sum(r["length"] for r in got) == len(ids)
        for r in got:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert len(got) == -(-len(ids) // capacity)
    return len(by_sequence), total / capacity


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_is_whole_and_tight(spark, sf_dir, capacity):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = op3_packing.pack(docs, capacity=capacity).collect()
    used, least = check_packed(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, capacity)
    assert used <= least * 1.05 + 2


def test_open_bins_close_the_fullest_and_prefer_the_tightest():
    bins = op3_packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert bins.place(3) == (1, 7)  # the tightest bin, now full and closed
    assert bins.place(5) == (2, 0)
    assert bins.place(9) == (3, 0)  # two bins are open: the fullest (bin 0) closes first
    assert bins.place(5) == (2, 5)


def test_packing_edges(spark):
    rows = op3_packing.pack(edge_docs(spark)).collect()
    assert sum(r["length"] for r in rows) == sum(len(plain_ids(r[1])) for r in edge_rows())
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert op3_packing.pack(no_docs(spark)).collect() == []


def test_matrices_give_documents_back(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = op4_matrices.pack_matrices(docs, block_ids=200_000).collect()
    parts = defaultdict(dict)
    for r in rows:
        ids = np.frombuffer(r["input_ids"], "<u2")
        assert len(ids) == 2048 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_ids"] <= 2048
        assert r["position_resets"] == r["cu_seqlens"][:-1] and not ids[r["n_ids"] :].any()
        for k, (d, p) in enumerate(zip(r["doc_ids"], r["pieces"], strict=True)):
            parts[d][p] = (r["starts"][k], ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]])
    for d in docs.collect():
        own = [parts[d["doc_id"]][p] for p in sorted(parts[d["doc_id"]])]
        assert np.concatenate([x for _, x in own]).tolist() == plain_ids(d["text"])
        assert [s for s, _ in own] == np.cumsum([0, *[len(x) for _, x in own]])[:-1].tolist()
    assert len(rows) <= sum(r["n_ids"] for r in rows) / 2048 * 1.05 + 2


def test_best_fit_decreasing_matches_a_plain_search():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 400)
    rooms, plain = [], []
    for k in np.argsort(-lengths, kind="stable"):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= lengths[k]]
        if fits:
            b = min(fits)[1]
        else:
            rooms.append(100)
            plain.append([])
            b = len(rooms) - 1
        rooms[b] -= lengths[k]
        plain[b].append(k)
    got = op4_matrices.best_fit_decreasing(lengths, 100)
    assert sorted(k for b in got for k in b) == list(range(400))
    assert all(lengths[b].sum() <= 100 for b in got)
    assert sorted(lengths[b].sum() for b in got) == sorted(lengths[b].sum() for b in plain)


def test_matrices_edges(spark, tmp_path):
    packed = op4_matrices.pack_matrices(edge_docs(spark), id_bytes=4)
    assert sum(r["n_ids"] for r in packed.collect()) == sum(len(plain_ids(r[1])) for r in edge_rows())
    assert op4_matrices.pack_matrices(no_docs(spark)).collect() == []
    op4_matrices.write_matrices(packed, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == packed.count()
