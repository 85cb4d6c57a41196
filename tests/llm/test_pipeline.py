import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from cipherlake.llm import catalog, op1_lines, op6_decontamination
from tests.llm.fixtures import documents, edge_docs, no_docs, prose
from tests.llm.test_packing import check_packed
from tests.llm.test_pairs import plain_set, roots


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What each stage keeps of the documents table, as {id: text}, and the last stage's rows."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path_factory.mktemp("stage") / name)
        before = docs.columns
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == before
        assert docs.where("n_chars != length(text)").count() == 0
        out.append({r["doc_id"]: r["text"] for r in docs.collect()})
    return out, corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    assert entry_point.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES) == list(range(1, 14))
    assert set(catalog.QUERIES) <= set(entry_point.queries())


def test_quality_keeps_good_documents(spark, sf_dir, stages):
    kept = set(stages[0][0])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    good, bad = (set(labels[labels["quality"] == q]["doc_id"]) for q in (1, 0))
    assert len(good & kept) >= 0.95 * len(good) and len(bad & kept) <= 0.4 * len(bad)


def test_line_dedup_leaves_no_repeated_block(stages):
    before, after = stages[0][0], stages[0][1]
    seen = {}
    for i in sorted(before):
        _, lines, words, seeds = op1_lines.profile_of(before[i], 20)
        left = (after.get(i) or "").split("\n")
        lines_before = before[i].split("\n")
        at = 0
        for x in left if i in after else []:
            at = lines_before.index(x, at) + 1  # a subsequence
        if i in after:
            assert not any(s in seen for s in op1_lines.profile_of(after[i], 20)[3] if s in seeds)
        else:
            assert any(s in seen for s in seeds)
        if all(s not in seen for s in seeds):
            assert after[i] == before[i]
        for s in seeds:
            seen.setdefault(s, i)


def test_one_document_of_each_near_duplicate_group_stays(stages):
    before, after = stages[0][1], stages[0][2]
    sets, ids = {i: plain_set(t) for i, t in before.items()}, sorted(before)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and (c := len(sets[a] & sets[b])) * 100 >= 75 * (len(sets[a]) + len(sets[b]) - c)]
    top = roots(links, ids)
    assert set(after) == {i for i in ids if top[i] == i} and all(after[i] == before[i] for i in after)


def test_one_row_of_each_group_stays_with_null_and_repeated_ids(spark, sf_dir):
    same, near, other, third, fourth = prose(1, 200), prose(1, 200) + " more", prose(2, 200), prose(3, 200), prose(4, 200)
    rows = [(None, same), (None, same), (None, near), (-7, other), (-7, other), (-7, third), (3, third + " more"), (5, other + " more"), (5, fourth), (None, fourth + " more"), (None, prose(5, 200)), (6, None), (7, "")]
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), sf_dir).collect()]
    nulls = [t for i, t in got if i is None]
    assert len(nulls) == 2 and prose(5, 200) in nulls and (same in nulls or near in nulls)
    assert sorted((r for r in got if r[0] is not None), key=str) == sorted([(-7, other), (-7, third), (5, fourth), (6, None), (7, "")], key=str)


def test_documents_with_benchmark_passages_go(spark, sf_dir, stages):
    before, after = stages[0][2], stages[0][3]
    items = [[w for w in map(op6_decontamination.plain, r["text"].split()) if w] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    number = {w: k + 1 for k, w in enumerate(sorted({w for x in items for w in x}))}
    want = set()
    for i, text in before.items():
        ids = np.array([number.get(w, 0) for w in map(op6_decontamination.plain, text.split()) if w], np.int64)
        if any(op6_decontamination.local_alignment(ids, np.array([number[w] for w in x]))[0] / (2 * len(x)) >= 0.5 for x in items if len(x) >= 4 and len(ids)):
            want.add(i)
    assert set(before) - set(after) == want


def test_what_is_left_is_packed(stages):
    used, least = check_packed(stages[1], stages[0][3], 2048)
    assert used <= least * 1.1 + 4


def test_run_is_the_stages_one_after_another(spark, sf_dir, stages):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages[1])


def test_stages_on_edges(spark, sf_dir, tmp_path):
    for n, docs in enumerate((edge_docs(spark), no_docs(spark))):
        columns, rows = docs.columns, docs.count()
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{n}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}{name}"))
            assert docs.columns == columns and docs.count() <= rows
            if k and n == 0:
                assert docs.where(F.col("text").contains("你好")).count() <= 1
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
