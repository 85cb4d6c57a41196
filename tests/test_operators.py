"""Invariants and small cases of the operators after the scan."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cipherlake.functions import paths as P
from cipherlake.operators import context_score as CS
from cipherlake.operators import dependencies as DP
from cipherlake.operators import embedding as E
from cipherlake.operators import evaluate as EV
from cipherlake.operators import flow as FW
from cipherlake.operators import policy as PO
from cipherlake.operators import profile as PR
from cipherlake.operators import report as RP
from cipherlake.operators import risk as RK
from cipherlake.operators import training as TR
from cipherlake.operators.ordering import global_index
from cipherlake.plans import catalog
from cipherlake.plans import jobs as J
from cipherlake.plans import queries as Q
from cipherlake.session import checkpoint
from cipherlake.sources import corpus as C
from cipherlake.sources import results as RS


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    return checkpoint(Q.l0(spark, sf_dir))


def test_scores_stay_in_bounds(found):
    lo, hi = found.agg(F.min("confidence"), F.max("confidence")).first()
    assert 0.2 <= lo and hi <= 1.0
    lo, hi = CS.score_findings(found).agg(F.min("confidence"), F.max("confidence")).first()
    assert 0.0 <= lo and hi <= 1.0
    assert 0 <= RK.overall_risk(RK.with_risk(found, Q.found_at(), Q.as_of())).first()["overall_risk"] <= 100


def test_empty_input_has_risk_zero(found):
    none = RK.with_risk(found.limit(0), Q.found_at(), Q.as_of())
    assert RK.overall_risk(none).first()["overall_risk"] == 0.0
    assert RK.risk_recommendations(none).first()["recommendation"] == RK.LOW_ADVICE
    assert PO.exit_status(found.limit(0)).first()[0] == 0 and PO.exit_status(found).first()[0] == 1


def test_suppression_never_adds_rows(spark, found):
    base = spark.createDataFrame([("l0-key-sizes", "", 0, ""), ("l0-tls-ssl", "", 2, ""), ("l0-hash-algorithms", "x", 0, "2020-01-01T00:00:00Z"), ("", "", 0, "")],
                                 "rule_id string, file string, line int, expires string")
    kept = PO.apply_baseline(found, base, Q.as_of())
    ids = {r[0] for r in kept.select("finding_id").collect()}
    assert ids == {r[0] for r in found.filter((F.col("rule_id") != "l0-key-sizes") & ~((F.col("rule_id") == "l0-tls-ssl") & (F.col("line") == 2))).select("finding_id").collect()}


def test_baseline_forms(spark):
    docs = spark.createDataFrame([('{"suppressions": [{"rule_id": "a"}]}',), ('[{"rule_id": "b", "line": 3}]',), ("oops",)], "value string")
    assert {(r["rule_id"], r["line"]) for r in RS.parse_baseline(docs).collect()} == {("a", None), ("b", 3)}


def test_top_k_is_sorted_and_a_subset(found):
    top = PO.prioritize(found, 20)
    rows = top.collect()
    assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (-r["severity_order"], -r["confidence"], -r["criticality"], r["line"], r["finding_id"]))
    assert top.join(found, "finding_id", "left_anti").count() == 0


def test_global_index_equals_a_plain_sort(spark, found):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    rows = global_index(df, "g", "k").orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(5000))
    assert [(r["g"], r["k"]) for r in rows] == sorted((r["g"], r["k"]) for r in rows)


def test_batches_are_full_and_responses_join_by_position(found):
    b = EV.assign_batches(found.limit(23), 5)
    sizes = sorted(r["count"] for r in b.groupBy("batch_id").count().collect())
    assert sizes == [3, 5, 5, 5, 5]


def test_evaluations_are_not_sent_through_the_driver(spark):
    """Matches made of a small table look small to Spark, however many they are; a broadcast gathers all of them."""
    made = checkpoint(spark.range(10).select(F.explode(F.sequence(F.lit(0), F.lit(999))).alias("i"), "id")
                      .select((F.col("id") * 1000 + F.col("i")).alias("seq")).select("seq", F.concat(F.lit("f"), "seq").alias("finding_id"), F.concat(F.lit("finding_"), "seq").alias("fallback_id")))
    ev = made.filter("seq % 2 = 0").select(F.when(F.col("seq") % 4 == 0, F.col("finding_id")).otherwise(F.col("fallback_id")).alias("finding_id"),
                                           (F.col("seq") % 3 == 0).alias("is_valid"), F.lit(0.5).alias("confidence"), F.lit("low").alias("severity"))
    out = EV.join_evaluations(made, ev)
    rows = {r["seq"]: r for r in out.collect()}
    assert len(rows) == 10_000 and all(r["has_ai_evaluation"] == (k % 2 == 0) and r["ai_is_valid"] == (k % 3 == 0 if k % 2 == 0 else None) for k, r in rows.items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["j3_stratified_split", "j14_labelled_coverage"])
def test_labelled_queries_broadcast_no_evaluations(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [key" not in plan and "BroadcastHashJoin [finding_id" not in plan and "SortMergeJoin [key" in plan


def test_response_statuses(spark):
    rows = [(1, 2, 'x [{"is_valid": true}, {"is_valid": false}] y'), (2, 1, '[{"is_valid": true}, {"is_valid": true}]'), (3, 3, '[{"is_valid": true}]'), (4, 1, "no")]
    got = {r["batch_id"]: (r["status"], len(r["items"] or [])) for r in RS.parse_responses(spark.createDataFrame(rows, "batch_id int, expected int, response string")).collect()}
    assert got == {1: ("ok", 2), 2: ("truncated", 1), 3: ("incomplete", 0), 4: ("unreadable", 0)}


def test_flow_blocks_equal_all_pairs(spark):
    """Nearby pairs through line blocks and distant ones through words equal brute force."""
    src = [("f", i * 13 % 400, f"word{i % 7} = request.x", "user-input", "high") for i in range(60)]
    snk = [("f", i * 17 % 400, i, f"word{i % 5} gen", "crypto-key-material") for i in range(50)]
    s = spark.createDataFrame(src, "path string, line int, text string, source_id string, taint_level string")
    k = spark.createDataFrame(snk, "path string, sink_line int, sink_col int, sink_text string, sink_type string")
    got = {(r["source_line"], r["sink_line"], r["sink_col"]) for r in FW.trace_flows(s, k).collect()}
    words = lambda t: {w for w in t.split() if len(w) > 2 and not set(w) & set("(){}[]<>")}
    want = {(a[1], b[1], b[2]) for a in src for b in snk if abs(a[1] - b[1]) <= 50 or words(a[2]) & words(b[3])}
    assert got == want


def test_language_fold_in_walk_order(spark):
    rows = [("r", "r/go.mod"), ("r", "r/cmd/a.go"), ("r", "r/pkg/b.go"), ("r", "r/z.go")]
    got = {r["language"]: r["confidence"] for r in PR.project_languages(spark.createDataFrame(rows, "repo string, path string")).collect()}
    acc = None
    for c in (0.8, 0.95, 0.8, 0.7):  # cmd/a.go, go.mod, pkg/b.go, z.go
        acc = c if acc is None else (acc + c) / 2
    assert abs(got["go"] - acc) < 1e-9


def test_vectors_are_normalised(found):
    v = E.embed(found.limit(50)).select("vector", F.size("vector").alias("n"), F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("len")).collect()
    assert all(r["n"] == 256 and abs(r["len"] - 1) < 1e-9 for r in v)


def test_cosine_edge_cases(spark):
    df = spark.sql("select array(1D, 0D) a, array(1D, 0D) b, array(0D, 0D) z, array(1D) s")
    r = df.select(E.cosine(F.col("a"), F.col("b")), E.cosine(F.col("a"), F.col("z")), E.cosine(F.col("a"), F.col("s"))).first()
    assert tuple(r) == (1.0, 0.0, 0.0)


def test_sarif_rows_are_valid_json(found):
    row = json.loads(RP.sarif_json(found.limit(5)).first()["result"])
    assert {"ruleId", "ruleIndex", "level", "locations", "partialFingerprints"} <= set(row)


def test_sinks(found, tmp_path):
    RP.write_json(found, str(tmp_path / "j"), "repo")
    RP.write_csv(found, str(tmp_path / "c"))
    RP.write_parquet(found, str(tmp_path / "p"), "repo")
    s = found.sparkSession
    n = found.count()
    assert s.read.json(str(tmp_path / "j")).count() == n and s.read.parquet(str(tmp_path / "p")).count() == n
    assert s.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "c")).count() == n


def test_file_source(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.go").write_text("k := rsa.GenerateKey(r, 1024)\n")
    (tmp_path / "src" / "b.bin").write_bytes(b"\x00\x01\x02")
    (tmp_path / "src" / "big.txt").write_text("x" * 2000)
    f = C.read_files(spark, str(tmp_path), max_size=1000)
    assert {r[0].rsplit("/", 1)[1]: r[1] for r in f.select("path", C.looks_binary(F.col("content"))).collect()} == {"a.go": False, "b.bin": True}
    text = C.decode_text(C.drop_binary(f)).select("path", F.lit("t").alias("repo"), "content")
    out = J.layered_scan(C.file_context(text))
    assert "go-rsa-keygen" in {r["rule_id"] for r in out["findings"].collect()}


def test_files_beyond_a_value_are_listed_and_sniffed(spark, tmp_path):
    """Sparse files of over 2 GiB, which no value holds, and the same rows whether heads or whole files are read."""
    (tmp_path / "sub").mkdir()
    for name, start, size in (("a b%20.go", b"package main\n" * 100, None), ("zero", b"x\x00", None),
                              ("sub/text", b"line of text\n" * 100, (2 << 30) + 10), ("sub/binary", b"x" * 1023, (2 << 30) + 10), ("sub/late", b"x" * 1024, (2 << 30) + 10)):
        with open(tmp_path / name, "wb") as f:
            f.write(start)
            f.truncate(size)
    rows = {r["name"]: (r["length"], r["binary"]) for r in Q.QUERIES["a1_corpus_scan"](spark, str(tmp_path)).collect()}
    big = (2 << 30) + 10
    assert rows == {"a b%20.go": (1300, False), "zero": (2, True), "text": (big, False), "binary": (big, True), "late": (big, False)}
    shorter = [C.file_heads(spark, str(tmp_path), n).filter("length < 10000").select("path", "length", "modified", "head") for n in (10, 1 << 20)]
    assert sorted(map(tuple, shorter[0].collect())) == sorted(map(tuple, shorter[1].collect()))


def test_layered_stages_add_up(spark, sf_dir):
    out = J.layered_findings(C.file_context(C.code_files(spark, sf_dir), "layered"))
    assert out["all"].count() == sum(out[s].count() for s in ("L0", "L1", "L2"))
    assert out["L2"].count() > 0


def test_documentation_gives_no_base_findings(spark, sf_dir):
    out = J.base_scan(C.file_context(C.code_files(spark, sf_dir), "base"))["findings"]
    assert out.filter(P.is_documentation(F.col("path"))).count() == 0 and out.count() > 0


def test_audit_and_line_reports(spark):
    rows = [("r", "audit", '{"vulnerabilities": {"p": {"severity": "high", "title": "t", "cves": ["C-1"]}}}'), ("r", "lines", '{"type":"vuln","vuln":{"id":"G-1","details":"d"}}\n{broken\n')]
    got = {(r["vuln_id"], r["severity"]) for r in DP.ingest(spark.createDataFrame(rows, "repo string, format string, report string"), ["repo"]).collect()}
    assert got == {("npm-p", "high"), ("G-1", "unknown")}


def test_training_run_saves_and_reloads(spark, found, tmp_path):
    seq = checkpoint(EV.with_sequence(found))
    ev = seq.select(F.col("finding_id"), (F.col("severity") != "low").alias("is_valid"), (F.col("line") % 10 / 10.0).alias("confidence"), "severity")
    out = J.training_run(seq, ev, str(tmp_path / "m"), trees=3, folds=2)
    assert out["results"][0]["accuracy"] > 0.8
    enc, models = TR.load(spark, str(tmp_path / "m"), ["validity", "confidence", "severity"])
    feats = TR.training_features(found.limit(20))
    assert models["validity"].transform(TR.encode(feats, enc)).count() == 20
    m = {r["label"]: r for r in TR.class_metrics(out["results"][2]["confusion"]).collect()}
    assert all(0 <= r["f1"] <= 1 for r in m.values())
    assert TR.feature_importance(out["results"][1]["model"], spark).count() == 29


def test_stream_scan_equals_batch(spark, sf_dir, tmp_path):
    from cipherlake.streaming import stream as ST
    C.code_files(spark, sf_dir).write.parquet(str(tmp_path / "in"))
    stream = ST.stream_table(spark, str(tmp_path / "in"), "repo string, path string, content string", max_files=2)
    ST.scan_each_batch(C.file_context(stream), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    a = spark.read.parquet(str(tmp_path / "out")).select("finding_id").distinct().count()
    assert a == Q.l0(spark, sf_dir).count()


def test_stream_dedupe_over_several_batches(spark, tmp_path):
    """Repeats within the delay go, repeats after it come again, and late rows go, by the watermark of the batch before."""
    from cipherlake.streaming import stream as ST

    batches = [[("10:00", "a"), ("10:05", "b")], [("12:00", "c"), ("10:30", "a")], [("12:20", "e"), ("12:25", "c")], [("10:10", "late"), ("12:30", "a")]]
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(batches):
        made = spark.createDataFrame([(f"2024-01-01 {t}:00", p, 1, "r") for t, p in rows], "ts string, path string, line long, rule_id string").withColumn("ts", F.col("ts").cast("timestamp"))
        made.coalesce(1).write.parquet(str(tmp_path / f"made{k}"))
        part = next((tmp_path / f"made{k}").glob("*.parquet"))
        (tmp_path / "in" / f"{k}.parquet").write_bytes(part.read_bytes())
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = ST.dedupe(ST.stream_table(spark, str(tmp_path / "in"), "ts timestamp, path string, line long, rule_id string", max_files=1), "ts")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r["path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "a", "b", "c", "e"]
