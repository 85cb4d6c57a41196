"""Registered queries: registries, rule files, similar findings, event windows, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherlake.operators import classify as CL
from cipherlake.operators import dependencies as DP
from cipherlake.operators import enhanced as EN
from cipherlake.operators import migrate as MG
from cipherlake.operators import rules as RU
from cipherlake.operators import scan as S
from cipherlake.operators import similar as SM
from cipherlake.plans import checks as K
from cipherlake.plans import queries as Q
from cipherlake.plans.queries import _L0_COLS, MORE_RULES, SECRET_RULES, _l0_cols, base, files, l0, n64, query, r6, read
from cipherlake.plans.queries_features import _EV, _event_findings, _drain
from cipherlake.plans.queries_findings import _EVAL, evaluated
from cipherlake.session import checkpoint, scratch
from cipherlake.sources import corpus as C
from cipherlake.sources import results as RS
from cipherlake.sources import sinks as SK
from cipherlake.streaming import stream as ST

# --- scans --------------------------------------------------------------------------------


@query("c1_files_given_twice", f"SELECT {_L0_COLS} FROM l0 UNION ALL SELECT {_L0_COLS} FROM l0")
def _(s, d):
    """Every file comes twice; each copy has findings with positions of its own."""
    f = files(s, d)
    return _l0_cols(S.l0_scan(f.unionByName(f)))


@query("a11_rule_files", "SELECT path, rule_id, pos, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, match_text FROM (SELECT path, rule_id, pos, line, col, match_text FROM secrets "
       + " ".join(f"UNION ALL BY NAME SELECT path, rule_id, pos, line, col, match_text FROM ({K.matches('doc_plain', [r], 'base')})" for r in MORE_RULES) + ")")
def _(s, d):
    """Rules from files of two folders, kept as a table because they are more than the plan takes as literals."""
    folder = scratch(s)
    for name, rules in (("first", SECRET_RULES), ("second", MORE_RULES)):
        RU.rules_table(s, rules).write.json(f"{folder}/{name}")
    rules = RU.load_rules(s, [f"{folder}/first", f"{folder}/second"])
    f = C.document_files(s, d).withColumn("language", F.lit(""))
    return S.scan_rules(f, rules, unroll=1).select("path", "rule_id", "pos", n64("line"), n64("col"), "match_text")


_DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i] * {1}[i]))"
K.CTE["vector_copies"] = """SELECT x.vec_id + 1000000 * k AS vec_id, list_transform(range(1, 65), lambda i: CAST(x.embedding[i] AS DOUBLE) + k * 0.15e0 * CAST(y.embedding[i] AS DOUBLE)) AS v
 FROM embeddings x, range(0, 3) t(k), embeddings y WHERE y.vec_id = x.vec_id + 1 OR (y.vec_id = x.vec_id AND k = 0 AND x.vec_id % 10 = 0)"""
K.CTE["vector_once"] = f"SELECT min(vec_id) AS vec_id, v, sqrt({_DOT.format('v', 'v')}) AS n FROM vector_copies GROUP BY v"


@query("d14_near_duplicates", f"SELECT x.vec_id AS left_id, y.vec_id AS right_id, round({_DOT.format('x.v', 'y.v')} / (x.n * y.n), 5) AS similarity FROM vector_once x JOIN vector_once y ON x.vec_id < y.vec_id WHERE {_DOT.format('x.v', 'y.v')} / (x.n * y.n) >= 0.95e0")
def _(s, d):
    """Vectors, and copies of each with a part of the next vector added; one in ten comes twice."""
    e = read(s, d, "embeddings")
    x, y = (e.select(F.col("vec_id").alias(f"{n}_id"), F.col("embedding").cast("array<double>").alias(n)) for n in "xy")
    both = x.join(y, F.col("y_id") == F.col("x_id") + 1).select("x_id", "x", "y").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    mixed = F.zip_with("x", "y", lambda a, b: a + F.col("k") * 0.15 * b)
    copies = both.select((F.col("x_id") + 1000000 * F.col("k")).alias("vec_id"), mixed.alias("v")).unionByName(x.filter("x_id % 10 = 0").select(F.col("x_id").alias("vec_id"), F.col("x").alias("v")))
    return SM.near_duplicates(copies, "vec_id", "v", bands=32).select("left_id", "right_id", F.round("similarity", 5).alias("similarity"))


# --- registries ---------------------------------------------------------------------------


@query("x3_severity_rules", "SELECT finding_id, CASE WHEN contains(lower(algorithm), 'sha1') THEN 'low' WHEN crypto_type = 'asymmetric' THEN 'critical' ELSE 'medium' END AS severity FROM base")
def _(s, d):
    """Two registered severity rules instead of the built-in ones, tried in the order of their names."""
    b = base(s, d).select("finding_id", "context", "algorithm", F.lit("").alias("severity"), "crypto_type", F.lit(0).alias("key_size"))
    rules = {"b_type": lambda f: F.when(f["crypto_type"] == "asymmetric", "critical"), "a_name": lambda f: F.when(F.lower(f["algorithm"]).contains("sha1"), "low").otherwise("")}
    return CL.basic_classify(b, rules).select("finding_id", "severity")


@query("x5_report_formats", """SELECT repo, vuln_id, package, title, severity, cve FROM vulnerabilities UNION ALL SELECT 'repo' || CAST(p_partkey % 20 AS VARCHAR), 'X-' || CAST(p_partkey AS VARCHAR) || CASE i WHEN 1 THEN '-a' ELSE '-b' END, 'p' || CAST(p_size AS VARCHAR), p_brand, 'low', '' FROM part, range(1, 3) t(i) WHERE p_partkey % 5 = 0""")
def _(s, d):
    """A format of one entry per line and three fields, registered beside the built-in ones."""
    def fields(body):
        lines = F.filter(F.split(body, "\n"), lambda t: t.contains("|"))
        part = lambda t, k: F.get(F.split(t, r"\|"), F.lit(k))
        return F.transform(lines, lambda t: F.struct(part(t, 0).alias("vuln_id"), part(t, 1).alias("package"), part(t, 2).alias("title"), F.lit("low").alias("severity"), F.array().cast("array<string>").alias("cves")))

    k = F.col("p_partkey")
    entry = lambda x: F.concat(F.lit("X-"), k.cast("string"), F.lit(x), F.lit("|p"), F.col("p_size").cast("string"), F.lit("|"), F.col("p_brand"))
    more = read(s, d, "part").filter(k % 5 == 0).select(F.concat(F.lit("repo"), (k % 20).cast("string")).alias("repo"), F.lit("any").alias("ecosystem"), F.lit("fields").alias("format"),
                                                        F.concat(entry("-a"), F.lit("\nno entry\n"), entry("-b")).alias("report"))
    out = DP.ingest(Q.dependency_reports(s, d).unionByName(more), ["repo"], parsers={**DP.PARSERS, "fields": fields})
    return out.select("repo", "vuln_id", "package", "title", "severity", F.array_join("cves", ",").alias("cve"))


@query("x6_custom_templates", """SELECT finding_id, CASE WHEN patch_language = 'python' AND template_name = 'generic' THEN 'replace ' || algorithm || ' in ' || path ELSE template_name END AS patch FROM patch_rows""")
def _(s, d):
    """A template of the caller takes findings of one language; the others keep theirs (here by name)."""
    own = MG.default_templates(s).select("name", F.col("name").alias("template"))
    own = own.unionByName(s.createDataFrame([("python_generic", "replace {{.Algorithm}} in {{.File}}")], "name string, template string"))
    return MG.render_patches(base(s, d), own).select("finding_id", "patch")


# --- event windows ------------------------------------------------------------------------


@query("t4_sliding_windows", f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) - to_days(CAST(i AS INTEGER)) AS window_start, round({K.OVERALL}, 6) AS overall_risk, CAST(count(*) AS BIGINT) AS n_findings FROM event_findings, range(0, 7) t(i) GROUP BY 1")
def _(s, d):
    """Risk over seven days, every day."""
    return ST.risk_windows(_event_findings(read(s, d, "events")), "ts", "7 days", "1 day").select("window_start", r6("overall_risk"), "n_findings")


K.CTE["event_sessions"] = """SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, line, rule_id) AS session
 FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, line, rule_id) AS gap FROM event_findings)"""
_SESSIONS = f"SELECT path, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, round({K.OVERALL}, 6) AS overall_risk, CAST(count(*) AS BIGINT) AS n_findings FROM event_sessions GROUP BY path, session"


@query("t4_session_windows", _SESSIONS)
def _(s, d):
    """Bursts of findings in a file."""
    return ST.risk_sessions(_event_findings(read(s, d, "events")), "ts").select("path", "window_start", "window_end", r6("overall_risk"), "n_findings")


@query("t4_stream_sessions", f"SELECT * FROM ({_SESSIONS}) WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def _(s, d):
    """The same from a stream; sessions that the watermark hasn't passed stay open."""
    ev = _event_findings(ST.stream_table(s, f"{d}/events.parque[t]", _EV))
    return _drain(ST.risk_sessions(ev, "ts").select("path", "window_start", "window_end", r6("overall_risk"), "n_findings"))


# --- sinks --------------------------------------------------------------------------------


@query("s8_training_documents", "SELECT repo, id, rule_id, file, CAST(line AS BIGINT) AS line, severity, confidence FROM result_rows")
def _(s, d):
    """Findings of all readable result documents, written twice: the second run replaces the first."""
    good, _bad = RS.split_corrupt(Q.result_docs(s, d))
    folder = scratch(s)
    for _ in range(2):
        SK.write_training(RS.parse_findings(good), folder)
    f = s.read.parquet(folder)
    return f.select("repo", "document.id", "document.rule_id", "document.file", n64("document.line", "line"), "document.severity", "document.confidence")


@query("s9_enhanced_documents", f"SELECT finding_id, enhanced_score, CAST(256 AS BIGINT) AS n_slots, CAST(50 AS BIGINT) AS n_features FROM ({Q.ORACLE['k9_d13_enhanced_score']})")
def _(s, d):
    """Enhanced findings as nested rows with their vectors, written by repository, half of them twice, and read back."""
    e = checkpoint(EN.enhance(l0(s, d), files(s, d)))
    folder = scratch(s)
    SK.write_enhanced(e, folder)
    SK.write_enhanced(e.filter("repo < 'repo2'"), folder)
    f = s.read.parquet(folder)
    return f.select("finding_id", F.round("scores.enhanced_score", 5).alias("enhanced_score"), F.size("embedding.vector").cast("bigint").alias("n_slots"), F.size("feature_vector").cast("bigint").alias("n_features"))


@query("s10_evaluation_runs", " UNION ALL ".join(f"""SELECT '{run}' AS run, (SELECT CAST(count(*) AS BIGINT) FROM ({_EVAL}) WHERE {cond}) AS n_rows, CAST(count(*) AS BIGINT) AS total_findings, CAST(count(*) FILTER (WHERE is_valid) AS BIGINT) AS valid_findings,
 round(avg(confidence), 6) AS average_confidence FROM ({_EVAL}) WHERE {cond}""" for run, cond in (("all", "TRUE"), ("valid", "is_valid"))))
def _(s, d):
    """Two evaluation runs with their summaries, one of them written again."""
    e, folder = checkpoint(evaluated(s, d)), scratch(s)
    for rows, run in ((e, "all"), (e, "valid"), (e.filter("is_valid"), "valid")):
        SK.write_evaluation_run(rows, folder, run)
    rows = s.read.parquet(f"{folder}/evaluations").groupBy("run").agg(F.count("*").alias("n_rows"))
    summary = s.read.json(f"{folder}/summary")
    return rows.join(summary, "run").select("run", "n_rows", "total_findings", "valid_findings", r6("average_confidence"))


_LONG = 30  # times that a file is repeated
K.CTE["long_files"] = f"SELECT repo, path, language, repeat(content || ';' || chr(10), {_LONG}) AS content FROM base_files"
K.CTE["long_base"] = K.matches("long_files", K.BASE_RULES, "base", f"NOT {K.DOC}")


@query("c2_long_files", "SELECT path, rule_id, CAST(pos AS BIGINT) AS pos, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, match_text, context FROM long_base")
def _(s, d):
    """Files of many matches, cut into blocks of pieces: every position and context, across block ends too."""
    f = Q.base_files(s, d).withColumn("content", F.repeat(F.concat("content", F.lit(";\n")), F.lit(_LONG)))
    return S.rule_scan(f, block=50).select("path", "rule_id", "pos", n64("line"), n64("col"), "match_text", "context")
