"""Registered queries: every operator over the whole given tables, with reference SQL where SQL can
state the same thing.  Each callable takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.functions import paths as P
from cipherlake.functions import severity as SV
from cipherlake.operators import classify as CL
from cipherlake.operators import context_score as CS
from cipherlake.operators import policy as PO
from cipherlake.operators import profile as PR
from cipherlake.operators import risk as RK
from cipherlake.operators import rules as RU
from cipherlake.operators import scan as S
from cipherlake.plans import checks as K
from cipherlake.plans.checks import (BASE, CATEGORY, CONFIG, CRITICALITY, DOC, DOC_LOOSE, EXCLUDED, EXT, GENERATED, KNOWN_TEXT,
                                     LIB_ANY, LIB_IMPL, LIB_NAME, REL, SEV_ORDER, SKIP, SUMMARY_W, TEST, TEST_STRICT,
                                     VENDORED, language)
from cipherlake.sources import corpus as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = K.sql(oracle)
        return fn
    return add


# --- shared inputs ------------------------------------------------------------

def read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def files(s, d):
    return C.file_context(C.code_files(s, d))


def base_files(s, d):
    return C.file_context(C.code_files(s, d), "base")


def listing(s, d):
    """Paths only: the content expression is pruned away."""
    return C.code_files(s, d).select("repo", "path")


def l0(s, d):
    return S.l0_scan(files(s, d))


def base(s, d):
    return S.rule_scan(base_files(s, d))


def adjusted(s, d):
    return S.adjust_for_library(S.dedupe_findings(base(s, d)))


def scored(s, d):
    return CS.score_findings(l0(s, d))




def as_of():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def found_at():
    """Findings are dated five hours per line before the reference time."""
    return as_of() - F.make_dt_interval(F.lit(0), F.col("line") * 5)


def risk(s, d):
    return RK.with_risk(l0(s, d), found_at(), as_of())


def r6(c, name=None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def n64(c, name=None):
    return F.col(c).cast("bigint").alias(name or c)


_POS = ("path", "rule_id", "pos", "line", "col", "match_text", "context")

# --- A: sources -----------------------------------------------------------------


@query("a1_corpus_scan")
def _(s, d):
    f = C.file_heads(s, d)
    return f.select(P.base_name(F.col("path")).alias("name"), "length", C.looks_binary(F.col("head")).alias("binary"))


@query("a2_table_corpus", "SELECT repo, path, CAST(length(content) AS BIGINT) AS n_chars, CAST(strlen(content) AS BIGINT) AS n_bytes FROM document_files")
def _(s, d):
    return C.document_files(s, d).select("repo", "path", F.length("content").cast("bigint").alias("n_chars"),
                                         F.octet_length("content").cast("bigint").alias("n_bytes"))


@query("a3_ignore_base", f"SELECT path, {K.ignored('base')} AS ignored FROM code_files")
def _(s, d):
    return listing(s, d).select("path", P.is_ignored(F.col("path")).alias("ignored"))


@query("a4_ignore_layered", f"SELECT path, {K.ignored('layered')} AS ignored FROM code_files")
def _(s, d):
    return listing(s, d).select("path", P.is_ignored(F.col("path"), variant="layered").alias("ignored"))


@query("a5_size_filter", """SELECT repo, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(strlen(content)) AS BIGINT) AS n_bytes
FROM mixed_files WHERE strlen(content) <= 20000 AND NOT """ + K.BINARY_NAME + " GROUP BY repo")
def _(s, d):
    f = C.select_files(C.mixed_files(s, d), patterns=["*.never"], max_size=20000)
    return f.groupBy("repo").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("content")).alias("n_bytes"))


@query("a6_binary_names", f"SELECT path, {K.BINARY_EXT} AS by_extension, {K.BINARY_NAME} AS by_name FROM code_files")
def _(s, d):
    p = F.col("path")
    return listing(s, d).select("path", P.is_binary_extension(p).alias("by_extension"), P.is_binary_name(p).alias("by_name"))


@query("a7_known_text", f"SELECT path, {KNOWN_TEXT} AS known_text FROM code_files")
def _(s, d):
    return listing(s, d).select("path", P.is_known_text(F.col("path")).alias("known_text"))


@query("a8_binary_sniff", """SELECT path, contains(content, chr(0)) OR (strlen(content) > 0 AND
 length(regexp_replace(substr(content, 1, 1024), '[^\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) / least(strlen(content), 1024) > 0.3) AS binary FROM document_files""")
def _(s, d):
    return C.document_files(s, d).select("path", C.looks_binary(F.col("content").cast("binary")).alias("binary"))


@query("a9_profile_exclusion", f"SELECT path, {EXCLUDED} AS excluded FROM (SELECT *, {REL} AS rel FROM code_files)")
def _(s, d):
    return PR.excluded_files(listing(s, d)).select("path", "excluded")


_EVIDENCE = " UNION ALL ".join(f"SELECT repo, path, rel, {K.q(lang)} AS language, {K.evidence(lang)} AS evidence FROM kept_files"
                               for lang in sorted(V.LANGUAGE_EVIDENCE))
K.CTE["kept_files"] = f"SELECT * FROM (SELECT repo, path, {REL} AS rel FROM code_files) WHERE NOT {EXCLUDED}"
K.CTE["evidence_rows"] = f"SELECT * FROM ({_EVIDENCE}) WHERE evidence > 0"
K.CTE["project_languages"] = """
SELECT repo, language, CAST(len(es) AS BIGINT) AS n_files, list_reduce(es, lambda a, b: (a + b) / 2e0) AS confidence
FROM (SELECT repo, language, list(evidence ORDER BY string_split(path, '/')) AS es FROM evidence_rows GROUP BY repo, language)"""
_pat_rows = [(p, "high") for p in V.IGNORE_HIGH] + [(p, "moderate") for p in V.IGNORE_MODERATE]
_lang_rows = [(k, p) for k, ps in V.IGNORE_BY_LANGUAGE.items() for p in ps]
K.CTE["ignore_patterns"] = f"""
SELECT DISTINCT repo, pattern FROM (
  SELECT repo, pattern FROM (SELECT repo, sum(n_files) AS total FROM project_languages GROUP BY repo) t
  CROSS JOIN (VALUES {', '.join(K.inlist(r) for r in _pat_rows)}) p(pattern, level) WHERE level = 'high' OR total < 1000
  UNION ALL SELECT repo, pattern FROM project_languages l JOIN (VALUES {', '.join(K.inlist(r) for r in _lang_rows)}) p(lang, pattern) ON l.language = p.lang)"""


@query("a10_ignore_patterns", "SELECT repo, pattern FROM ignore_patterns")
def _(s, d):
    return PR.ignore_patterns(PR.project_languages(listing(s, d)), small_project=V.MODERATE_MAX_FILES)


@query("a10_profile_filter", f"""SELECT path FROM (SELECT repo, path, {REL} AS rel FROM code_files) f WHERE NOT EXISTS (
  SELECT 1 FROM ignore_patterns p WHERE p.repo = f.repo AND (regexp_matches(f.rel, '^' || replace(replace(replace(p.pattern, '.', '\\.'), '+', '\\+'), '*', '[^/]*') || '$')
   OR contains(f.rel, CASE WHEN p.pattern LIKE '%*' THEN p.pattern[:-2] ELSE p.pattern END)))""")
def _(s, d):
    f = listing(s, d)
    return PR.filter_by_profile(f.select("path", "repo"), PR.ignore_patterns(PR.project_languages(f), small_project=V.MODERATE_MAX_FILES)).select("path")


def user_rules(s, d):
    """A user's rule table with one row per part, some of them faulty."""
    k = F.col("p_partkey")
    cut = lambda n, v: F.when(k % n == 0, F.lit("")).otherwise(v)
    return read(s, d, "part").select(
        cut(11, F.concat(F.lit("u"), k.cast("string"))).alias("rule_id"), F.when(k % 5 == 0, "structural").otherwise("regex").alias("kind"),
        cut(7, F.col("p_name")).alias("pattern"), cut(13, F.col("p_type")).alias("message"),
        F.when(k % 17 == 0, "").when(k % 19 == 0, "urgent").when(k % 2 == 0, "high").otherwise("info").alias("severity"),
        F.lower("p_type").alias("crypto_type"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("go"), F.lower("p_brand"))).alias("languages"))


K.CTE["user_rules"] = """
SELECT CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'u' || CAST(p_partkey AS VARCHAR) END AS rule_id,
  CASE WHEN p_partkey % 5 = 0 THEN 'structural' ELSE 'regex' END AS kind, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS pattern,
  CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_type END AS message,
  CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN 'urgent' WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'info' END AS severity,
  lower(p_type) AS crypto_type, CASE WHEN p_partkey % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['go', lower(p_brand)] END AS languages FROM part"""


@query("a11_a12_rule_selection", """SELECT rule_id, CAST(count(*) AS BIGINT) AS n FROM base
WHERE rule_id NOT IN (SELECT 'weak-hash-' || CASE WHEN l_returnflag = 'R' THEN 'md5' ELSE 'sha1' END FROM lineitem WHERE l_returnflag = 'R') GROUP BY rule_id""")
def _(s, d):
    off = read(s, d, "lineitem").filter(F.col("l_returnflag") == "R").select(F.lit("weak-hash-md5").alias("rule_id"))
    on = RU.select_rules(RU.rules_table(s), disabled_ids=off).select("rule_id")
    return base(s, d).join(F.broadcast(on), "rule_id", "left_semi").groupBy("rule_id").agg(F.count("*").alias("n"))


@query("a13_rule_validation", """
SELECT rule_id, problem FROM (SELECT rule_id, unnest([CASE WHEN rule_id = '' THEN 'missing id' END, CASE WHEN pattern = '' THEN 'missing pattern' END,
  CASE WHEN message = '' THEN 'missing message' END, CASE WHEN severity = '' THEN 'missing severity' END,
  CASE WHEN severity <> '' AND severity NOT IN ('critical', 'high', 'medium', 'low', 'info') THEN 'invalid severity' END,
  CASE WHEN kind = 'structural' AND len(languages) < 1 THEN 'missing language' END]) AS problem FROM user_rules) WHERE problem IS NOT NULL""")
def _(s, d):
    return RU.validate_rules(user_rules(s, d))


def result_docs(s, d):
    """Stored result documents, one per part, in the shapes that occur."""
    k = F.col("p_partkey")
    item = F.format_string('{"id": "f%d", "rule_id": "r%d", "file": "src/%d.c", "line": %d, "severity": "%s", "confidence": %s, "algorithm": "RSA"}',
                           k, k % 9, k, F.col("p_size"), F.when(k % 2 == 0, "high").otherwise("info"), F.when(k % 3 == 0, "0.9").otherwise("0.25"))
    two = F.concat(F.lit("["), item, F.lit(", "), F.replace(item, F.lit('"id": "f'), F.lit('"id": "g')), F.lit("]"))
    body = (F.when(k % 7 == 0, F.lit('{"crypto_findings": null}')).when(k % 7 == 1, F.concat(F.lit('{"findings": '), two, F.lit("}")))
            .when(k % 7 == 2, F.concat(F.lit('{"results": '), two, F.lit("}"))).when(k % 7 == 3, F.concat(F.lit('{"crypto_findings": '), two, F.lit("}")))
            .when(k % 7 == 4, F.lit('{"crypto_findings": [{"id": ')).otherwise(two))
    return read(s, d, "part").select(F.concat(F.lit("repo"), (k % 20).cast("string")).alias("repo"), body.alias("value"))


K.CTE["result_rows"] = """
SELECT 'repo' || CAST(p_partkey % 20 AS VARCHAR) AS repo, p || CAST(p_partkey AS VARCHAR) AS id, 'r' || CAST(p_partkey % 9 AS VARCHAR) AS rule_id,
  'src/' || CAST(p_partkey AS VARCHAR) || '.c' AS file, p_size AS line, CASE WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'info' END AS severity,
  CASE WHEN p_partkey % 3 = 0 THEN 0.9e0 ELSE 0.25e0 END AS confidence
FROM part, (VALUES ('f'), ('g')) t(p) WHERE p_partkey % 7 NOT IN (0, 4)"""


@query("a14_findings_json", "SELECT repo, id, rule_id, file, CAST(line AS BIGINT) AS line, severity, confidence FROM result_rows")
def _(s, d):
    from cipherlake.sources import results as RS
    good, _bad = RS.split_corrupt(result_docs(s, d))
    return RS.parse_findings(good).select("repo", "id", "rule_id", "file", n64("line"), "severity", "confidence")


@query("a15_corrupt_documents", """SELECT 'repo' || CAST(p_partkey % 20 AS VARCHAR) AS repo, CAST(count(*) AS BIGINT) AS n_errors
FROM part WHERE p_partkey % 7 = 4 GROUP BY ALL""")
def _(s, d):
    from cipherlake.sources import results as RS
    return RS.split_corrupt(result_docs(s, d))[1].groupBy("repo").agg(F.count("*").alias("n_errors"))


def baseline(s, d):
    """Baseline documents in both forms, with whole-rule, file and line entries, some expired."""
    from cipherlake.sources import results as RS
    k = F.col("p_partkey")
    rule = F.when(k % 4 == 0, "l0-key-sizes").when(k % 4 == 1, "l0-hash-algorithms").when(k % 4 == 2, "l0-tls-ssl").otherwise("weak-hash-md5")
    file = F.concat(F.lit("f"), k.cast("string"), F.when(k % 3 == 0, ".go").otherwise(".c"))
    line = F.when(k % 5 == 0, F.lit(2)).otherwise(F.lit(0))
    exp = (F.when(k % 6 == 0, "2023-01-01T00:00:00Z").when(k % 6 == 1, "not a date").when(k % 6 == 2, "2030-01-01T00:00:00Z").when(k % 6 == 3, "2023-01-01")
           .when(k % 6 == 4, "2024-02-01T01:30:00.25+02:00").otherwise(""))
    entry = F.format_string('[{"rule_id": "%s", "file": "%s", "line": %d, "expires": "%s"}]', rule, file, line, exp)
    doc = F.when(k % 2 == 0, F.concat(F.lit('{"suppressions": '), entry, F.lit("}"))).otherwise(entry)
    return RS.parse_baseline(read(s, d, "part").select(doc.alias("value")))


K.CTE["baseline_entries"] = """
SELECT CASE p_partkey % 4 WHEN 0 THEN 'l0-key-sizes' WHEN 1 THEN 'l0-hash-algorithms' WHEN 2 THEN 'l0-tls-ssl' ELSE 'weak-hash-md5' END AS rule_id,
  'f' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN '.go' ELSE '.c' END AS file,
  CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END AS line,
  CASE p_partkey % 6 WHEN 0 THEN '2023-01-01T00:00:00Z' WHEN 1 THEN 'not a date' WHEN 2 THEN '2030-01-01T00:00:00Z' WHEN 3 THEN '2023-01-01'
  WHEN 4 THEN '2024-02-01T01:30:00.25+02:00' ELSE '' END AS expires FROM part"""


@query("a16_baseline_source", "SELECT rule_id, file, CAST(line AS BIGINT) AS line, expires FROM baseline_entries")
def _(s, d):
    return baseline(s, d).select("rule_id", "file", n64("line"), "expires")


def dependency_reports(s, d):
    k = F.col("p_partkey")
    sev = F.when(k % 4 == 0, "critical").when(k % 4 == 1, "high").when(k % 4 == 2, "moderate").otherwise("low")
    audit = F.format_string('{"vulnerabilities": {"pkg%d": {"severity": "%s", "title": "%s", "cves": ["CVE-%d"]}}}', k % 50, sev, F.col("p_name"), k)
    lines = F.format_string('{"type": "config"}\n{"type": "vuln", "vuln": {"id": "GO-%d", "details": "%s"}}\nnot json\n', k, F.col("p_name"))
    return read(s, d, "part").select(
        F.concat(F.lit("repo"), F.when(k % 3 == 0, 0).otherwise(k % 20).cast("string")).alias("repo"),
        F.when(k % 2 == 0, "npm").otherwise("go").alias("ecosystem"), F.when(k % 2 == 0, "audit").otherwise("lines").alias("format"),
        F.when(k % 2 == 0, audit).otherwise(lines).alias("report"))


K.CTE["vulnerabilities"] = """
SELECT 'repo' || CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE CAST(p_partkey % 20 AS VARCHAR) END AS repo,
  CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'go' END AS ecosystem,
  CASE WHEN p_partkey % 2 = 0 THEN 'npm-pkg' || CAST(p_partkey % 50 AS VARCHAR) ELSE 'GO-' || CAST(p_partkey AS VARCHAR) END AS vuln_id,
  CASE WHEN p_partkey % 2 = 0 THEN 'pkg' || CAST(p_partkey % 50 AS VARCHAR) ELSE '' END AS package, p_name AS title,
  CASE WHEN p_partkey % 2 = 1 THEN 'unknown' ELSE CASE p_partkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'moderate' ELSE 'low' END END AS severity,
  CASE WHEN p_partkey % 2 = 0 THEN 'CVE-' || CAST(p_partkey AS VARCHAR) ELSE '' END AS cve FROM part"""


@query("a17_dependency_reports", "SELECT repo, vuln_id, package, title, severity, cve FROM vulnerabilities")
def _(s, d):
    from cipherlake.operators import dependencies as DP
    return DP.ingest(dependency_reports(s, d), ["repo"]).select("repo", "vuln_id", "package", "title", "severity", F.array_join("cves", ",").alias("cve"))


_eco = ", ".join(f"bool_or({BASE} IN {K.inlist(m)}) AS {k}" for k, m in V.ECOSYSTEM_MARKERS.items())
K.CTE["ecosystems"] = f"SELECT repo, {_eco} FROM code_files GROUP BY repo"


@query("a18_ecosystems", "SELECT * FROM ecosystems")
def _(s, d):
    return PR.ecosystems(listing(s, d))


@query("a19_evaluations", """SELECT 'f' || CAST(p_partkey AS VARCHAR) AS finding_id, p_partkey % 2 = 1 AS is_valid,
CASE WHEN p_partkey % 3 = 0 THEN 0.9e0 ELSE 0.4e0 END AS confidence FROM part""")
def _(s, d):
    from cipherlake.sources import results as RS
    k = F.col("p_partkey")
    e = F.format_string('{"finding_id": "f%d", "%s": %s, "confidence": %s}', k, F.when(k % 3 == 0, "is_valid").otherwise("is_valid_finding"),
                        F.when(k % 2 == 1, "true").otherwise("false"), F.when(k % 3 == 0, "0.9").otherwise("0.4"))
    doc = F.when(k % 5 == 0, F.concat(F.lit("["), e, F.lit("]"))).otherwise(F.concat(F.lit('{"evaluations": ['), e, F.lit("]}")))
    return RS.parse_evaluations(read(s, d, "part").select(doc.alias("value"))).select("finding_id", "is_valid", "confidence")


def responses(s, d):
    """Evaluator responses, one per conversation turn, with prose around the array."""
    n = F.col("turn") % 4
    items = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(
        F.lit('{"is_valid_finding": '), F.when(i % 2 == 1, "true").otherwise("false"), F.lit(', "confidence": 0.5, "severity": "high"}')))
    text = F.when(n == 0, F.lit("no array here")).otherwise(F.concat(F.lit("Result:\n["), F.array_join(items, ",\n"), F.lit("]\nDone.")))
    return read(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("batch_id"),
                                              (F.col("conv_id") % 3 + 1).alias("expected"), text.alias("response"))


_RESP = """SELECT conv_id * 1000 + turn AS batch_id, conv_id % 3 + 1 AS expected, turn % 4 AS n FROM conversations"""


@query("a20_parse_responses", f"""SELECT batch_id, CASE WHEN n = 0 THEN 'unreadable' WHEN n < expected THEN 'incomplete' WHEN n > expected THEN 'truncated' ELSE 'ok' END AS status,
CAST(CASE WHEN n = 0 OR n < expected THEN 0 ELSE least(n, expected) END AS BIGINT) AS n_items FROM ({_RESP})""")
def _(s, d):
    from cipherlake.sources import results as RS
    return RS.parse_responses(responses(s, d)).select("batch_id", "status", F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"))


@query("a21_latest_objects", "SELECT event_id FROM events ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 10")
def _(s, d):
    e = read(s, d, "events").select(F.col("event_id").cast("string").alias("path"), F.col("ts").alias("modified"))
    return C.latest_objects(e).select(F.col("path").cast("bigint").alias("event_id"))


@query("a22_inline_suppressions", "SELECT path, CAST(line AS BIGINT) AS line, rule_id, scope FROM marks")
def _(s, d):
    return C.inline_suppressions(files(s, d)).select("path", n64("line"), "rule_id", "scope")


@query("a23_incremental", """SELECT path FROM code_files f WHERE NOT EXISTS (
  SELECT 1 FROM code_files o WHERE o.repo = 'repo0' AND o.path = f.path AND sha256(o.content) = sha256(f.content))""")
def _(s, d):
    f = C.code_files(s, d)
    done = f.filter(F.col("repo") == "repo0").select("path", F.sha2(F.col("content"), 256).alias("content_hash"))
    return C.not_yet_scanned(f, done).select("path")


K.CTE["unsuppressed"] = """
SELECT * FROM l0_scored f WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.path = f.path AND (m.rule_id = '*' OR m.rule_id = f.rule_id)
  AND (m.scope = 'file' OR (m.scope = 'line' AND f.line = m.line) OR (m.scope = 'block' AND f.line BETWEEN m.line AND m.line + 10)))"""


@query("a24_fleet_scan", f"""SELECT repo, finding_id, round(confidence, 6) AS confidence, CAST(rank AS BIGINT) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {K.PRIORITY_KEYS}) AS rank FROM unsuppressed WHERE confidence >= 0.3e0 AND ({SKIP}) IS NULL) WHERE rank <= 1000""")
def _(s, d):
    from cipherlake.plans import jobs as J
    return J.fleet_scan(files(s, d), enable_l1=False).select("repo", "finding_id", r6("confidence"), n64("rank"))


@query("a24_fleet_scan_all_layers")
def _(s, d):
    from cipherlake.plans import jobs as J
    return J.fleet_scan(files(s, d), reuse=True).select("repo", "finding_id", "stage", r6("confidence"), n64("rank"))


# --- B: derived columns ------------------------------------------------------------

@query("b1_path_parts", f"SELECT path, {EXT} AS extension, {BASE} AS base_name, CAST(len(string_split(path, '/')) AS BIGINT) AS depth, {REL} AS rel FROM code_files")
def _(s, d):
    p = F.col("path")
    return listing(s, d).select("path", P.extension(p).alias("extension"), P.base_name(p).alias("base_name"),
                                P.depth(p).cast("bigint").alias("depth"), PR.relative_path(p).alias("rel"))


_LANGS = list(V.LANGUAGE_TABLES)


@query("b2_languages", f"SELECT path, {', '.join(f'{language(v)} AS lang_{v}' for v in _LANGS)} FROM code_files")
def _(s, d):
    return listing(s, d).select("path", *[P.language(F.col("path"), v).alias(f"lang_{v}") for v in _LANGS])


@query("b3_b9_file_kinds", f"""SELECT path, {VENDORED} AS vendored, {GENERATED} AS generated, {TEST} AS test, {TEST_STRICT} AS test_strict,
 {DOC} AS doc, {DOC_LOOSE} AS doc_loose, {CONFIG} AS config, {CATEGORY} AS category FROM code_files""")
def _(s, d):
    p = F.col("path")
    return listing(s, d).select("path", P.is_vendored(p).alias("vendored"), P.is_generated(p).alias("generated"), P.is_test(p).alias("test"),
                                P.is_test_strict(p).alias("test_strict"), P.is_documentation(p).alias("doc"),
                                P.is_documentation_loose(p).alias("doc_loose"), P.is_config(p).alias("config"), P.file_category(p).alias("category"))


@query("b10_skip_gate", f"SELECT path, coalesce({SKIP}, 'scanned') AS reason FROM code_files")
def _(s, d):
    return listing(s, d).select("path", F.coalesce(P.skip_reason(F.col("path")), F.lit("scanned")).alias("reason"))


@query("b11_b12_library_context", f"SELECT path, {LIB_IMPL} AS implementation, {LIB_ANY} AS any_library, coalesce({LIB_NAME}, '') AS library FROM code_files")
def _(s, d):
    p = F.col("path")
    return listing(s, d).select("path", P.is_library_implementation(p).alias("implementation"), P.is_crypto_library(p).alias("any_library"),
                                F.coalesce(P.library_name(p), F.lit("")).alias("library"))


@query("b13_b15_positions", "SELECT path, rule_id, pos, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, context, finding_id FROM l0_mixed")
def _(s, d):
    f = S.l0_scan(C.file_context(C.mixed_files(s, d)))
    return f.select("path", "rule_id", "pos", n64("line"), n64("col"), "context", "finding_id")


@query("b16_b19_finding_attributes", "SELECT finding_id, message, severity, CAST(priority AS BIGINT) AS priority, algorithm FROM l0")
def _(s, d):
    return l0(s, d).select("finding_id", "message", "severity", n64("priority"), "algorithm")


_DELIM = V.TOKEN_DELIMITERS
K.CTE["token_rows"] = f"""
SELECT finding_id, len(ts) AS n, unnest(ts) AS token FROM (SELECT finding_id, list_append(list_transform(list_filter(
  regexp_split_to_array(context, {K.q(_DELIM)}), lambda t: strlen(t) BETWEEN 1 AND 49), lambda t: lower(t)), '__LANG_' || {language('features')} || '__') AS ts FROM l0)"""


@query("b20_tokens", "SELECT token, CAST(count(*) AS BIGINT) AS n FROM token_rows GROUP BY token")
def _(s, d):
    from cipherlake.operators import embedding as E
    return (l0(s, d).select(F.explode(E.tokens(F.col("context"), F.col("path"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")))


_WORDS = "list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: strlen(w) > 2 AND NOT regexp_matches(w, '[(){}\\[\\]<>]'))"


@query("b21_variable_words", f"SELECT path, CAST(line AS BIGINT) AS line, array_to_string({_WORDS}, ' ') AS words FROM file_lines")
def _(s, d):
    from cipherlake.operators import flow as FW
    return S.lines(files(s, d)).select("path", n64("line"), F.array_join(FW.words(F.col("text")), " ").alias("words"))


@query("b22_b23_encodings", f"""SELECT finding_id, {K.cases([(f'lower(algorithm) IN {K.inlist(n)}', K.num(v)) for n, v in V.FEATURE_ALGORITHM], '3e0')} AS algorithm_value,
 {K.table(V.FEATURE_SEVERITY, 'severity', 1.0)} AS severity_value, {K.table(V.FEATURE_CRYPTO_TYPE, 'crypto_type', 2.0)} AS type_value, CAST({CRITICALITY} AS BIGINT) AS criticality FROM base""")
def _(s, d):
    from cipherlake.operators import enhanced as EN
    return base(s, d).select("finding_id", EN.algorithm_value(F.col("algorithm")).alias("algorithm_value"), SV.feature_value(F.col("severity")).alias("severity_value"),
                             EN.crypto_type_value(F.col("crypto_type")).alias("type_value"), SV.criticality(F.col("algorithm")).cast("bigint").alias("criticality"))


@query("b24_b26_metadata", """SELECT finding_id, match_text AS pattern_text, CAST(12 AS BIGINT) AS n_entries, ml_prediction FROM l0_scored""")
def _(s, d):
    from cipherlake.operators import embedded as EM
    m = CS.score_metadata(scored(s, d))
    return m.select("finding_id", EM.pattern_text(F.col("metadata")).alias("pattern_text"), F.size("metadata").cast("bigint").alias("n_entries"),
                    F.col("metadata")["ml_prediction"].alias("ml_prediction"))


_FT = K.has("lower(path)", V.FLEET_TEST_PARTS)
_FL = K.has("lower(path)", V.FLEET_LIBRARY_PARTS)
_CTX = f"CASE WHEN {_FT} THEN 'test' WHEN {_FL} THEN 'library' ELSE 'application' END"
_LOW = f"CASE WHEN {K.has('lower(path)', V.FLEET_LOW_LEVEL_PARTS)} THEN 'low_level' ELSE 'high_level' END"
K.CTE["fleet"] = f"""SELECT *, {_CTX} AS context_type, {_LOW} AS level, regexp_extract(path, '([^.]*)$', 1) AS file_type,
 CASE WHEN confidence >= 0.8e0 THEN 'high' WHEN confidence >= 0.5e0 THEN 'medium' ELSE 'low' END AS band FROM l0"""


@query("b25_fleet_context", "SELECT finding_id, context_type, level, file_type, band FROM fleet")
def _(s, d):
    from cipherlake.operators import fleet as FL
    return FL.context_features(l0(s, d)).select("finding_id", "context_type", F.col("implementation_level").alias("level"), "file_type", F.col("confidence_band").alias("band"))


@query("b27_b30_classification_parts", f"""SELECT finding_id, cls_type, {K.PARAM['key_size']} AS key_size, {K.PARAM['curve']} AS curve,
 {K.PARAM['iterations']} AS iterations, {K.PARAM['hash_algorithm']} AS hash_algorithm, CAST(cls_key_size AS BIGINT) AS cls_key_size, cls_quantum_vulnerable, cls_deprecated FROM l0_classified""")
def _(s, d):
    c = CL.classify(l0(s, d))
    return c.select("finding_id", "cls_type", *[F.coalesce(F.element_at("cls_parameters", n), F.lit("")).alias(n) for n in V.PARAMETER_PATTERNS],
                    n64("cls_key_size"), "cls_quantum_vulnerable", "cls_deprecated")


_BALG = K.cases([(K.has("lower(context)", w), K.q(n)) for n, w in V.BASIC_ALGORITHMS.items()], "''")
K.CTE["blanked"] = """SELECT finding_id, context, CASE WHEN line % 2 = 0 THEN '' ELSE algorithm END AS algorithm, CASE WHEN line % 3 = 0 THEN '' ELSE severity END AS severity,
 CASE WHEN line % 5 = 0 THEN '' ELSE crypto_type END AS crypto_type, CASE WHEN line % 4 = 0 THEN 64 WHEN line % 4 = 1 THEN 192 ELSE 0 END AS key_size FROM base"""


@query("b31_basic_classifier", f"""SELECT finding_id, algorithm, CASE WHEN severity = '' THEN
  CASE WHEN {K.has('lower(algorithm)', ['md5', 'sha1'])} THEN 'high' WHEN {K.has('lower(algorithm)', ['des', 'rc4'])} THEN 'critical' ELSE 'medium' END ELSE severity END AS severity,
  CASE WHEN crypto_type = '' THEN {K.cases([(K.has('lower(algorithm)', w), K.q(n)) for w, n in V.BASIC_TYPE_PARTS], "'unknown'")} ELSE crypto_type END AS crypto_type,
  round((CASE WHEN algorithm <> '' THEN 0.4e0 ELSE 0e0 END) + (CASE WHEN key_size > 0 THEN 0.3e0 ELSE 0e0 END) + (CASE WHEN context <> '' THEN 0.3e0 ELSE 0e0 END), 6) AS basic_confidence
 FROM (SELECT * REPLACE (CASE WHEN algorithm = '' THEN {_BALG} ELSE algorithm END AS algorithm) FROM blanked)""")
def _(s, d):
    ln = F.col("line")
    blank = lambda n, c: F.when(ln % n == 0, "").otherwise(F.col(c))
    b = base(s, d).select("finding_id", "context", blank(2, "algorithm").alias("algorithm"), blank(3, "severity").alias("severity"),
                          blank(5, "crypto_type").alias("crypto_type"), F.when(ln % 4 == 0, 64).when(ln % 4 == 1, 192).otherwise(0).alias("key_size"))
    return CL.basic_classify(b).select("finding_id", "algorithm", "severity", "crypto_type", r6("basic_confidence"))


@query("b32_severity_scales", f"""SELECT finding_id, {SUMMARY_W} AS summary_weight, {K.SEV_RISK} AS risk_value, {K.table(V.ML_SEVERITY_FACTOR, 'severity', 1.0)} AS ml_factor,
 CAST({SEV_ORDER} AS BIGINT) AS priority, {K.table(V.FEATURE_SEVERITY, 'severity', 1.0)} AS feature_value, {K.table(V.CALCULATOR_TYPE_WEIGHT, 'lower(crypto_type)', 0.0)} AS type_weight FROM base""")
def _(s, d):
    sev = F.col("severity")
    return base(s, d).select("finding_id", SV.summary_weight(sev).alias("summary_weight"), SV.risk_value(sev).alias("risk_value"), SV.ml_factor(sev).alias("ml_factor"),
                             SV.priority(sev).cast("bigint").alias("priority"), SV.feature_value(sev).alias("feature_value"),
                             SV.calculator_type_weight(F.col("crypto_type")).alias("type_weight"))


@query("b33_rule_attributes", "SELECT finding_id, r.name AS rule_name, r.pq_replacement FROM base b JOIN base_rules r USING (rule_id)")
def _(s, d):
    rules = RU.rules_table(s).select("rule_id", F.col("name").alias("rule_name"), "pq_replacement")
    return RU.attributes(base(s, d), rules, ["rule_name", "pq_replacement"]).select("finding_id", "rule_name", "pq_replacement")


@query("b34_model_input", f"SELECT finding_id, algorithm, severity, round(confidence, 6) AS confidence, {language('scan')} AS language, rule_id, CAST(line AS DOUBLE) AS line, path AS file, match_text AS pattern FROM l0")
def _(s, d):
    from cipherlake.operators import embedded as EM
    return EM.model_input(l0(s, d)).select("finding_id", "algorithm", "severity", r6("confidence"), "language", "rule_id", "line", "file", "pattern")


# --- C: patterns -----------------------------------------------------------------------

_L0_COLS = "finding_id, path, rule_id, pos, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, match_text, severity, crypto_type, algorithm, round(confidence, 6) AS confidence"


def _l0_cols(df):
    return df.select("finding_id", "path", "rule_id", "pos", n64("line"), n64("col"), "match_text", "severity", "crypto_type", "algorithm", r6("confidence"))


@query("c1_l0_scan", f"SELECT {_L0_COLS} FROM l0")
def _(s, d):
    return _l0_cols(l0(s, d))


@query("c1_l0_scan_whole_texts", f"SELECT {_L0_COLS} FROM l0_mixed")
def _(s, d):
    return _l0_cols(S.l0_scan(C.file_context(C.mixed_files(s, d))))


@query("c2_rule_scan", f"SELECT {_L0_COLS} FROM base")
def _(s, d):
    return _l0_cols(base(s, d))


SECRET_RULES = [
    RU.Rule("secret-token", r'token = "[0-9a-f]{40}"', "high", "secret", "TOKEN", guards=["token = "], message="Token in text"),
    RU.Rule("address-ipv4", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "low", "address", "IPV4", message="Address in text"),
    RU.Rule("address-mail", r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "medium", "address", "MAIL", guards=["@"], message="Mail address in text"),
    RU.Rule("digits-16", r"\b\d{16}\b", "medium", "secret", "DIGITS", message="Sixteen digits in text"),
    RU.Rule("licence-word", r"(?i)\blicen[sc]e\b", "info", "licence", "LICENCE", guards=["licen"], message="Licence word in text"),
]
K.CTE["doc_plain"] = "SELECT *, '' AS language FROM document_files"
K.CTE["secret_rules"] = K.rule_values(SECRET_RULES)
K.CTE["secrets"] = f"SELECT m.*, r.severity FROM ({K.matches('doc_plain', SECRET_RULES, 'base')}) m JOIN secret_rules r USING (rule_id)"


# two more rules under one id, and one under an id of the list above: all are kept, each with its own positions
MORE_RULES = [RU.Rule("common-word", r"\bthe\b", "info", "word", "WORD", message="First word"), RU.Rule("common-word", r"\bof\b", "low", "word", "WORD", message="Second word"),
              RU.Rule("digits-16", r"\b\d{4}\b", "low", "secret", "DIGITS", message="Four digits in text")]


@query("u3_rule_union", "SELECT path, rule_id, message, pos, CAST(line AS BIGINT) AS line, match_text FROM (SELECT m.*, r.message FROM secrets m JOIN secret_rules r USING (rule_id) "
       + " ".join(f"UNION ALL BY NAME SELECT *, {K.q(r.message)} AS message FROM ({K.matches('doc_plain', [r], 'base')})" for r in MORE_RULES) + ")")
def _(s, d):
    table = RU.combine_rules(RU.rules_table(s, SECRET_RULES), RU.rules_table(s, MORE_RULES))
    f = C.document_files(s, d).withColumn("language", F.lit(""))
    return S.rule_scan(f, RU.rules_from_table(table)).select("path", "rule_id", "message", "pos", n64("line"), "match_text")


@query("c2_x1_user_rules_on_prose", "SELECT path, rule_id, pos, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, match_text, context, severity FROM secrets")
def _(s, d):
    f = C.document_files(s, d).withColumn("language", F.lit(""))
    return S.rule_scan(f, SECRET_RULES).select("path", "rule_id", "pos", n64("line"), n64("col"), "match_text", "context", "severity")


_APPLY = " UNION ALL ".join(f"SELECT {K.q(r.rule_id)} AS rule_id, count(*) FILTER (WHERE {K.applies(r, 'base')} AND NOT {DOC}) AS n_base,"
                            f" count(*) FILTER (WHERE {K.applies(r, 'l0')}) AS n_l0 FROM base_files" for r in K.BASE_RULES)


@query("c3_c4_applicability", f"SELECT rule_id, CAST(n_base AS BIGINT) AS n_base, CAST(n_l0 AS BIGINT) AS n_l0 FROM ({_APPLY})")
def _(s, d):
    f = base_files(s, d).select("path", "language")
    doc, lang = P.is_documentation(F.col("path")), F.col("language")
    rules = RU.default_rules()
    # files are counted per (language, documentation) first, so rules meet a handful of rows
    groups = f.groupBy("language", doc.alias("doc")).agg(F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), (RU.applies_to(r, lang, "base") & ~F.col("doc")).alias("b"),
                              RU.applies_to(r, lang, "l0").alias("l")) for r in rules])
    return (groups.select("n", F.inline(rows)).groupBy("rule_id")
            .agg(F.sum(F.when(F.col("b"), F.col("n")).otherwise(0)).alias("n_base"), F.sum(F.when(F.col("l"), F.col("n")).otherwise(0)).alias("n_l0")))


@query("c5_structural_rules", "SELECT path, rule_id, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, match_text, severity FROM structural")
def _(s, d):
    return S.structural_scan(files(s, d), RU.structural_rules()).select("path", "rule_id", n64("line"), n64("col"), "match_text", "severity")


_CALLS = ["GenerateKey", "getInstance", "createHash", "EVP_sha1"]


@query("c6_function_calls", f"SELECT path, CAST(line AS BIGINT) AS line, regexp_extract(text, '\\b({'|'.join(_CALLS)})\\s*\\(', 1) AS name FROM file_lines WHERE regexp_matches(text, '\\b({'|'.join(_CALLS)})\\s*\\(')")
def _(s, d):
    return S.find_calls(files(s, d), _CALLS).select("path", n64("line"), "name")


@query("c7_imports", r"""SELECT path, CAST(line AS BIGINT) AS line, regexp_extract(text, '(crypto|openssl|hashlib|rsa)', 1) AS name FROM file_lines
WHERE regexp_matches(text, '^\s*(import|from|#include|use|require|using)\b') AND regexp_matches(text, 'crypto|openssl|hashlib|rsa')""")
def _(s, d):
    return S.find_imports(files(s, d), ["crypto", "openssl", "hashlib", "rsa"]).select("path", n64("line"), "name")


_PREDS = {"sample_data": K.haslow("context", V.SAMPLE_DATA_WORDS), "hardware": K.haslow("context", V.HARDWARE_WORDS),
          "falcon_hardware": f"contains(lower(context), 'falcon') AND {K.haslow('context', V.FALCON_HARDWARE_WORDS)}",
          "kubernetes": K.haslow("context", V.KUBERNETES_WORDS), "test_context": K.haslow("context", V.TEST_CONTEXT_WORDS),
          "utility_hash": f"algorithm IN ('MD5', 'SHA1') AND {K.haslow('context', V.UTILITY_HASH_WORDS)}"}


@query("c16_c20_context_predicates", f"SELECT finding_id, {', '.join(f'{e} AS {n}' for n, e in _PREDS.items())} FROM l0")
def _(s, d):
    c = F.col("context")
    return l0(s, d).select("finding_id", S.is_sample_data(c).alias("sample_data"), S.is_hardware(c).alias("hardware"), S.is_falcon_hardware(c).alias("falcon_hardware"),
                           S.is_kubernetes(c).alias("kubernetes"), S.is_test_context(c).alias("test_context"), S.is_utility_hash(c, F.col("algorithm")).alias("utility_hash"))


@query("c21_min_confidence", "SELECT finding_id FROM l0 WHERE confidence >= 0.5e0")
def _(s, d):
    return PO.min_confidence(l0(s, d), 0.5).select("finding_id")


@query("c22_context_aware_rules", f"SELECT rule_id, CAST(count(*) AS BIGINT) AS n FROM base WHERE rule_id IN {K.inlist(V.CONTEXT_AWARE_RULES)} GROUP BY rule_id")
def _(s, d):
    return base(s, d).filter(F.col("rule_id").isin(V.CONTEXT_AWARE_RULES)).groupBy("rule_id").agg(F.count("*").alias("n"))


LIKELY = f"""CASE WHEN confidence >= 0.8e0 THEN TRUE WHEN algorithm IN ('MD5', 'SHA1', 'RSA-1024', 'RSA-512') THEN TRUE WHEN stage = 'L2' THEN TRUE
 WHEN {TEST_STRICT} THEN confidence >= 0.9e0 WHEN {VENDORED} THEN confidence >= 0.95e0 ELSE confidence >= 0.7e0 END"""


@query("c23_likely_true", f"SELECT finding_id, {LIKELY} AS likely FROM l0_scored")
def _(s, d):
    from cipherlake.operators import stage_metrics as SM
    return scored(s, d).select("finding_id", SM.likely_true(F.col("confidence"), F.col("algorithm"), F.col("stage"), F.col("path")).alias("likely"))


@query("c25_l0_gate", "SELECT path FROM code_files WHERE path IN (SELECT path FROM l0)")
def _(s, d):
    return listing(s, d).join(l0(s, d).select("path").distinct(), "path", "left_semi").select("path")


@query("c26_severity_threshold", f"SELECT finding_id, severity FROM base WHERE {SEV_ORDER} >= 2")
def _(s, d):
    return PO.min_severity(base(s, d), "medium").select("finding_id", "severity")
