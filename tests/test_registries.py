"""Similar findings, sinks, event windows with late rows, report parsing and the SQL table function against plain versions."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cipherlake.functions import table_functions as TF
from cipherlake.operators import dependencies as DP
from cipherlake.operators import rules as RU
from cipherlake.operators import scan as S
from cipherlake.operators import similar as SM
from cipherlake.sources import corpus as C
from cipherlake.sources import sinks as SK
from cipherlake.streaming import stream as ST


def vectors(n_groups=60, members=12, width=48, seed=5):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(n_groups):
        centre = rng.normal(size=width)
        rows += [centre + rng.normal(size=width) * s for s in rng.uniform(0.02, 0.4, members)]
    rows += [rows[0]] * 30 + [rows[1] * 3]
    return [r.tolist() for r in rows]


@pytest.mark.parametrize("tile", [2000, 7])
def test_near_duplicates_against_all_pairs(spark, tile):
    rows = vectors()
    odd = [None, [0.0] * 48, [float("nan")] * 48, [1.0] * 47, [None] * 48]
    df = spark.createDataFrame(list(enumerate(rows)) + [(10_000 + k, v) for k, v in enumerate(odd)] + [(None, rows[5])], "id long, v array<double>")
    got = {(r["left_id"], r["right_id"]): r["similarity"] for r in SM.near_duplicates(df, "id", "v", 0.95, tile=tile).collect()}
    unit = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    near = unit @ unit.T
    first = {tuple(r): k for k, r in reversed(list(enumerate(rows)))}
    want = {(i, j) for i, j in zip(*np.nonzero(near >= 0.95)) if i < j and first[tuple(rows[i])] == i and first[tuple(rows[j])] == j}
    assert set(got) <= want and len(got) >= 0.95 * len(want) > 100
    assert all(abs(s - near[p]) < 1e-9 for p, s in got.items())
    assert SM.near_duplicates(df.limit(0), "id", "v").collect() == []


def test_a_hot_bucket_is_dealt_to_tiles(spark):
    """Thousands of vectors of one bucket: no task gets more than two tiles of them."""
    rng = np.random.default_rng(1)
    rows = [(k, (np.ones(16) + rng.normal(size=16) * 1e-3).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = SM.near_duplicates(df, "id", "v", bands=2, signs=4, tile=40)
    assert got.count() == 300 * 299 // 2


def test_sinks_replace_their_own_partitions(spark, tmp_path):
    rows = [("a", "1", 0.5), ("a", "2", None), ("b", "3", 0.7)]
    df, target = spark.createDataFrame(rows, "repo string, id string, confidence double"), str(tmp_path / "t")
    SK.write_training(df, target)
    SK.write_training(df.filter("repo = 'a' AND id = '1'"), target)
    SK.write_training(spark.createDataFrame([("c", "4", 0.1)], df.schema), target)
    got = sorted((r["repo"], r["document"]["id"]) for r in spark.read.parquet(target).collect())
    assert got == [("a", "1"), ("b", "3"), ("c", "4")]


_T0 = dt.datetime(2024, 3, 1, 10, 0)


def _feed(spark, folder, batches):
    """One file per micro-batch, in order."""
    for k, minutes in enumerate(batches):
        rows = [(_T0 + dt.timedelta(minutes=m), p, 0.5, 1.0) for p, m in minutes]
        part = spark.createDataFrame(rows, "ts timestamp, path string, risk double, risk_weight double").coalesce(1)
        part.write.parquet(f"{folder}/{k}")
        for f in os.listdir(f"{folder}/{k}"):
            os.utime(f"{folder}/{k}/{f}", (1_700_000_000 + k, 1_700_000_000 + k))


def _run(spark, folder, out, make):
    stream = ST.stream_table(spark, f"{folder}/*", "ts timestamp, path string, risk double, risk_weight double", max_files=1)
    df = make(stream)
    df.writeStream.format("parquet").outputMode("append").option("path", f"{out}/d").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/d")


# (path, minutes after the start); rows are late when they are an hour behind the latest row of the batches before the last
_BATCHES = [[("p", 0), ("p", 20), ("q", 5)], [("p", 70), ("p", 45)], [("p", 40), ("q", 200)], [("p", 150), ("q", 215)], [("p", 30), ("q", 900)], [("q", 1000)]]


def test_sessions_of_a_stream_with_late_rows(spark, tmp_path):
    """Late rows within the hour join and melt sessions (45 and 40 close the gap between 20 and 70); the row of minute 30
    comes a batch after the watermark has passed 140 and is left out."""
    _feed(spark, tmp_path / "in", _BATCHES)
    out = _run(spark, tmp_path / "in", tmp_path / "out", lambda s: ST.risk_sessions(s, "ts", "30 minutes"))
    minutes = lambda t: int((t - _T0).total_seconds() // 60)
    got = sorted((r["path"], minutes(r["window_start"]), minutes(r["window_end"]), r["n_findings"]) for r in out.collect())
    assert got == [("p", 0, 100, 5), ("p", 150, 180, 1), ("q", 5, 35, 1), ("q", 200, 245, 2), ("q", 900, 930, 1)]


def test_sliding_windows_of_a_stream_with_late_rows(spark, tmp_path):
    """Two hours every hour: a row counts in both windows that hold it while the watermark hasn't passed them."""
    _feed(spark, tmp_path / "in", _BATCHES)
    out = _run(spark, tmp_path / "in", tmp_path / "out", lambda s: ST.risk_windows(s, "ts", "2 hours", "1 hour"))
    hours = lambda t: int((t - _T0).total_seconds() // 3600)
    got = sorted((hours(r["window_start"]), r["n_findings"]) for r in out.collect())
    # minute 30 comes late: its windows are [-60, 60), closed at 140, and [0, 120), closed too
    kept = [m for rows in _BATCHES for p, m in rows if (p, m) != ("p", 30)]
    want = [(h, sum(h * 60 <= m < h * 60 + 120 for m in kept)) for h in range(-1, 20)]
    assert got == [(h, n) for h, n in want if n and (h + 2) * 60 <= 1000 - 60]


def test_batch_and_stream_sessions_agree_without_late_rows(spark, tmp_path):
    _feed(spark, tmp_path / "in", [[("p", m) for m in range(0, 600, 7)], [("p", 2000)], [("p", 5000)]])
    rows = spark.read.parquet(f"{tmp_path}/in/*")
    stream = _run(spark, tmp_path / "in", tmp_path / "out", lambda s: ST.risk_sessions(s, "ts"))
    batch = ST.risk_sessions(rows, "ts").where(F.col("window_end") < F.lit(_T0 + dt.timedelta(minutes=4900)))
    assert sorted(map(str, stream.collect())) == sorted(map(str, batch.collect()))


def test_reports_are_read_once_and_not_exchanged(spark):
    """One pass for all formats; no exchange carries a report."""
    rows = [("r1", "npm", "audit", '{"vulnerabilities": {"a": {"severity": "high", "title": "t", "cves": null}, "b": {"severity": "low", "title": "u", "cves": ["C"]}}}'),
            ("r1", "go", "lines", '{"type": "vuln", "vuln": {"id": "G-1", "details": "d"}}\nbroken\n{"type": "x"}'), ("r2", "npm", "audit", "no json"), ("r2", "npm", "other", "x"), ("r3", "npm", "audit", None)]
    reports = spark.createDataFrame(rows, "repo string, ecosystem string, format string, report string")
    got = sorted((r["repo"], r["vuln_id"], r["severity"], tuple(r["cves"])) for r in DP.ingest(reports, ["repo"]).collect())
    assert got == [("r1", "G-1", "unknown", ()), ("r1", "npm-a", "high", ()), ("r1", "npm-b", "low", ("C",))]
    present = spark.createDataFrame([("r1", True, False), ("r2", True, True)], "repo string, npm boolean, go boolean")
    found = DP.scan_project(reports, present, ["repo"])
    assert sorted(r["vuln_id"] for r in found.collect()) == ["npm-a", "npm-b"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("report" not in x.split("Arguments")[0] for x in plan.split("\n") if "Exchange" in x)


def test_table_function_has_the_positions_of_the_scan(spark, sf_dir):
    """Built-in expressions only, and the same matches as the scan's first stage."""
    files = C.file_context(C.code_files(spark, sf_dir)).where("path LIKE '%1%'")
    TF.register(spark)
    files.createOrReplaceTempView("scanned_files")
    out = spark.sql("SELECT f.path, h.rule_id, h.line, h.`column` AS col, h.pos, h.match_text FROM scanned_files f, LATERAL scan_text(f.content, f.path, f.language) h")
    want = S.l0_candidates(files).select("path", "rule_id", "line", "col", "pos", "match_text")
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in want.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert spark.sql("SELECT * FROM scan_text(CAST(NULL AS STRING), 'a', 'go')").collect() == []


def test_table_function_looks_for_guards_first(spark):
    """As in the scan, a rule is tried only on texts that hold one of its literals."""
    rules = [RU.Rule("guarded", "md5", "low", guards=["sha"]), RU.Rule("free", "md5", "low")]
    try:
        TF.register(spark, rules)
        got = spark.sql("SELECT t, h.rule_id FROM VALUES ('md5'), ('SHA md5') AS x(t), LATERAL scan_text(t, 'a', 'go') h").collect()
    finally:
        TF.register(spark)
    assert sorted(tuple(r) for r in got) == [("SHA md5", "free"), ("SHA md5", "guarded"), ("md5", "free")]


def test_rule_tables_of_any_size_are_scanned(spark):
    """Twenty thousand rules stay a table; few become part of the plan; matches are the same."""
    many = spark.range(20_000).select(F.format_string("r%05d", "id").alias("rule_id"), F.format_string("word%05d\\b", "id").alias("pattern"))
    rules = RU.rules_table(spark, [RU.Rule("none", "never-there", "low")])
    table = many.select(*[F.col(c.name) if c.name in ("rule_id", "pattern") else F.array(F.format_string("word%05d", F.substring("rule_id", 2, 9).cast("int"))).alias("guards") if c.name == "guards"
                          else F.lit(None).cast(c.dataType).alias(c.name) for c in rules.schema]).withColumn("languages", F.array().cast("array<string>"))
    files = spark.createDataFrame([("r/a.go", "r", "go", "x word00007 word19999\nword00007x word00007")], "path string, repo string, language string, content string")
    got = sorted((r["rule_id"], r["pos"], r["line"]) for r in S.scan_rules(files, table).collect())
    assert got == [("r00007", 2, 1), ("r00007", 33, 2), ("r19999", 12, 1)]
    few = table.where("rule_id IN ('r00007', 'r19999')").withColumn("severity", F.lit("low"))
    assert sorted((r["rule_id"], r["pos"], r["line"]) for r in S.scan_rules(files, few).collect()) == got
