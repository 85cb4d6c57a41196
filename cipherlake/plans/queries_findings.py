"""Registered queries over findings: joins, aggregates, windows, ranking, reports, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.functions import paths as P
from cipherlake.functions.text import dimension
from cipherlake.operators import classify as CL
from cipherlake.operators import context_score as CS
from cipherlake.operators import dependencies as DP
from cipherlake.operators import evaluate as EV
from cipherlake.operators import fleet as FL
from cipherlake.operators import flow as FW
from cipherlake.operators import migrate as MG
from cipherlake.operators import policy as PO
from cipherlake.operators import profile as PR
from cipherlake.operators import report as RP
from cipherlake.operators import risk as RK
from cipherlake.operators import rules as RU
from cipherlake.operators import scan as S
from cipherlake.operators import stage_metrics as SM
from cipherlake.operators import structural as ST
from cipherlake.plans import checks as K
from cipherlake.plans import queries as Q
from cipherlake.plans.checks import BASE, LIB_NAME, OVERALL, REL, SUMMARY_W, language
from cipherlake.plans.queries import adjusted, as_of, base, base_files, files, found_at, l0, listing, n64, query, r6, read, risk, scored
from cipherlake.session import checkpoint
from cipherlake.sources import corpus as C
from cipherlake.sources import results as RS

# --- structural and flow stages ---------------------------------------------------

_L1 = ST._l1_rules()
_L1R = [RU.Rule(f"h{i}", r["regex"], "info", languages=[r["language"]]) for i, r in enumerate(_L1, 1)]
_attr = ", ".join(K.inlist([f"h{i}", r["rule_id"], r["algorithm"], r["category"], r.get("severity", ""), float(r.get("confidence", 0.0)),
                            r.get("sized", False), r.get("code_only", False), r["intent"]]) for i, r in enumerate(_L1, 1))
K.CTE["lay_files"] = f"SELECT *, {language('layered')} AS language FROM code_files"
K.CTE["l0_lay"] = K.l0_from("lay_files")
K.CTE["l1"] = f"""
SELECT *, {K.ID} AS finding_id, 'L1' AS stage FROM (
 SELECT path, repo, language, rule_id, pos, line, col, match_text, context, algorithm, crypto_type, intent,
  CASE WHEN sev <> '' THEN sev WHEN size IN ('512', '1024') THEN 'critical' WHEN size = '2048' THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN conf > 0e0 THEN conf WHEN contains(match_text, '(') AND contains(match_text, ')') THEN 0.7e0 + 0.2e0 ELSE 0.7e0 END AS confidence,
  CASE WHEN intent = 'detect_weak_rsa_generation' AND size <> '' THEN 'RSA key generation with key size ' || size || ' bits: use 2048 bits or more, or move to ML-KEM'
       WHEN intent = 'detect_weak_rsa_generation' THEN 'RSA key generation: consider a post-quantum scheme'
       WHEN intent = 'detect_weak_hash_usage' THEN algorithm || ' hash usage: cryptographically broken' ELSE algorithm || ' key generation: vulnerable to quantum attacks' END AS message,
  coalesce(TRY_CAST(size AS INTEGER), 0) AS key_size
 FROM (SELECT m.* EXCLUDE (rule_id), a.rule_id, a.category AS crypto_type, a.sev, a.conf, a.code_only, a.intent,
   CASE WHEN a.sized THEN regexp_extract(match_text, '(\\d+)$', 1) ELSE '' END AS size,
   CASE WHEN a.algorithm <> '' THEN a.algorithm WHEN regexp_extract(match_text, {K.q(V.L1_JAVA_PATTERN)}, 1) = 'EC' THEN 'ECDSA'
        ELSE regexp_extract(match_text, {K.q(V.L1_JAVA_PATTERN)}, 1) END AS algorithm
  FROM ({K.matches('lay_files', _L1R, 'l0')}) m
  JOIN (VALUES {_attr}) a(hit, rule_id, algorithm, category, sev, conf, sized, code_only, intent) ON m.rule_id = a.hit)
 WHERE path IN (SELECT path FROM l0_lay) AND NOT (code_only AND (contains(lower(match_text), '//') OR contains(lower(match_text), '/*'))))"""


def lay_files(s, d):
    return C.file_context(C.code_files(s, d), "layered")


def l1(s, d):
    f = lay_files(s, d)
    return ST.l1_scan(f, S.l0_scan(f))


@query("c8_c12_l1_findings", """SELECT finding_id, path, rule_id, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, algorithm, severity, round(confidence, 6) AS confidence,
 message, CAST(key_size AS BIGINT) AS key_size FROM l1""")
def _(s, d):
    return l1(s, d).select("finding_id", "path", "rule_id", n64("line"), n64("col"), "algorithm", "severity", r6("confidence"), "message", n64("key_size"))


def _tags(patterns, a, b, isnum=False):
    return " UNION ALL ".join(f"SELECT path, line, text, {K.q(i)} AS {a}, {K.lit(v)} AS {b} FROM file_lines WHERE {K.rx('text', p)}" for i, p, v in patterns)


K.CTE["taint_sources"] = _tags(V.TAINT_SOURCES, "source_id", "taint_level")


@query("c13_taint_sources", "SELECT path, CAST(line AS BIGINT) AS line, source_id, taint_level FROM taint_sources")
def _(s, d):
    return FW.taint_sources(files(s, d)).select("path", n64("line"), "source_id", "taint_level")


@query("c14_taint_sinks", f"""SELECT path, CAST(line AS BIGINT) AS line, sink FROM (SELECT path, line, sink_id AS sink FROM ({_tags(V.TAINT_SINKS, 'sink_id', 'sink_severity')})
 UNION ALL SELECT path, line, {K.table(V.SINK_TYPES, 'crypto_type', V.SINK_TYPE_DEFAULT)} FROM l1)""")
def _(s, d):
    a = FW.taint_sinks_text(files(s, d)).select("path", n64("line"), F.col("sink_id").alias("sink"))
    return a.unionByName(FW.taint_sinks(l1(s, d)).select("path", F.col("sink_line").cast("bigint").alias("line"), F.col("sink_type").alias("sink")))


K.CTE["sanitizer_rows"] = _tags(V.SANITIZERS, "sanitizer_id", "effectiveness")


@query("c15_sanitizers", "SELECT path, CAST(line AS BIGINT) AS line, sanitizer_id, effectiveness FROM sanitizer_rows")
def _(s, d):
    return FW.sanitizers(files(s, d)).select("path", n64("line"), "sanitizer_id", "effectiveness")


K.CTE["gate"] = "SELECT path, count(*) FILTER (WHERE severity IN ('critical', 'high') AND confidence > 0.8e0) AS n_strong FROM l1 GROUP BY path HAVING n_strong >= 2"


@query("c24_l2_gate", "SELECT path, CAST(n_strong AS BIGINT) AS n_strong FROM gate")
def _(s, d):
    return ST.high_confidence_files(l1(s, d)).select("path", "n_strong")


_W = lambda t: f"list_filter(string_split(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' '), lambda w: strlen(w) > 2 AND NOT regexp_matches(w, '[(){{}}\\[\\]<>]'))"
K.CTE["flows"] = f"""
SELECT *, source_id || '_to_' || sink_type AS flow_type, least(1e0, 0.6e0 + CASE WHEN dist <= 10 THEN 0.3e0 WHEN dist <= 25 THEN 0.2e0 ELSE 0e0 END
   + CASE WHEN shared THEN 0.2e0 ELSE 0e0 END) AS confidence
FROM (SELECT s.path, s.line AS source_line, s.text AS source_text, s.source_id, s.taint_level, k.line AS sink_line, k.col AS sink_col, k.match_text AS sink_text,
   {K.table(V.SINK_TYPES, 'k.crypto_type', V.SINK_TYPE_DEFAULT)} AS sink_type, abs(s.line - k.line) AS dist, list_has_any({_W('s.text')}, {_W('k.match_text')}) AS shared
  FROM taint_sources s JOIN l1 k ON s.path = k.path) WHERE dist <= 50 OR shared"""


def flows(s, d):
    f = lay_files(s, d)
    return FW.trace_flows(FW.taint_sources(f), FW.taint_sinks(l1(s, d)))


@query("d2_taint_flows", "SELECT path, CAST(source_line AS BIGINT) AS source_line, source_id, CAST(sink_line AS BIGINT) AS sink_line, CAST(sink_col AS BIGINT) AS sink_col, flow_type, round(confidence, 6) AS confidence FROM flows")
def _(s, d):
    return flows(s, d).select("path", n64("source_line"), "source_id", n64("sink_line"), n64("sink_col"), "flow_type", r6("confidence"))


K.CTE["violations"] = f"""SELECT f.*, r.rule_id, r.severity FROM flows f JOIN (VALUES {', '.join(K.inlist(r) for r in V.FLOW_RULES)}) r(rule_id, src, snk, severity)
 ON contains(f.flow_type, r.src) AND contains(f.flow_type, r.snk)"""


@query("d3_k12_flow_violations", "SELECT path, rule_id, severity, CAST(source_line AS BIGINT) AS source_line, CAST(sink_line AS BIGINT) AS sink_line, CAST(sink_col AS BIGINT) AS col, round(confidence, 6) AS confidence FROM violations")
def _(s, d):
    return FW.flow_violations(flows(s, d)).select("path", "rule_id", "severity", n64("source_line"), n64("sink_line"), n64("col"), r6("confidence"))


@query("c15_sanitized_flows", """SELECT path, CAST(source_line AS BIGINT) AS source_line, CAST(sink_line AS BIGINT) AS sink_line, source_id, CAST(sink_col AS BIGINT) AS sink_col, sink_type,
 round(confidence * (1e0 - coalesce((SELECT max(effectiveness) FROM sanitizer_rows z WHERE z.path = f.path AND z.line BETWEEN least(source_line, sink_line) AND greatest(source_line, sink_line)), 0e0)), 6) AS confidence FROM flows f""")
def _(s, d):
    out = FW.sanitized_confidence(flows(s, d), FW.sanitizers(lay_files(s, d)))
    return out.select("path", n64("source_line"), n64("sink_line"), "source_id", n64("sink_col"), "sink_type", r6("confidence"))


K.CTE["islands"] = """
SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY line, col, rule_id, finding_id) AS island FROM (
 SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY path ORDER BY line, col, rule_id, finding_id) > 10 THEN 1 ELSE 0 END AS starts FROM l0)"""


@query("g1_hotspots", """
SELECT path, CAST(island AS BIGINT) AS island, CAST(min(line) AS BIGINT) AS line, CAST(arg_min(col, line * 100000 + col) AS BIGINT) AS col, CAST(max(line) AS BIGINT) AS last_line,
 CAST(count(*) AS BIGINT) AS n_findings, (SELECT crypto_type FROM islands j WHERE j.path = i.path AND j.island = i.island GROUP BY crypto_type ORDER BY count(*) DESC, crypto_type LIMIT 1) AS hotspot_type,
 round(avg(confidence), 6) AS confidence FROM islands i GROUP BY path, island""")
def _(s, d):
    return ST.hotspots(l0(s, d)).select("path", n64("island"), n64("line"), n64("col"), n64("last_line"), n64("n_findings"), "hotspot_type", r6("confidence"))


@query("u1_e12_e13_stages", """SELECT stage, CAST(count(*) AS BIGINT) AS n_files FROM (SELECT path, max(o) AS o, CASE max(o) WHEN 2 THEN 'L2_DataFlow' WHEN 1 THEN 'L1_AST' ELSE 'L0_Regex' END AS stage
 FROM (SELECT path, 0 AS o FROM l0_lay UNION ALL SELECT path, 1 FROM l1 UNION ALL SELECT path, 2 FROM violations) GROUP BY path) GROUP BY stage""")
def _(s, d):
    f = lay_files(s, d)
    a = S.l0_scan(f).select("path", "stage")
    b = l1(s, d).select("path", "stage")
    c = FW.flow_violations(flows(s, d)).select("path", "stage")
    return SM.highest_stage(a.unionByName(b).unionByName(c))


@query("e13_file_confidence", "SELECT f.path, round(coalesce(avg(l.confidence), 0e0), 6) AS mean_confidence, CAST(count(l.path) AS BIGINT) AS n_findings FROM files f LEFT JOIN l0 l ON f.path = l.path GROUP BY f.path")
def _(s, d):
    return SM.file_confidence(listing(s, d), l0(s, d)).select("path", r6("mean_confidence"), "n_findings")


# --- joins ---------------------------------------------------------------------------

@query("d1_rules_as_table", "SELECT path, rule_id, pos FROM base")
def _(s, d):
    f = base_files(s, d).filter(~P.is_documentation(F.col("path")))
    return S.rule_scan_table(f, RU.rules_table(s, RU.default_rules())).select("path", "rule_id", "pos")


@query("d4_baseline", """SELECT finding_id FROM l0 f WHERE NOT EXISTS (SELECT 1 FROM baseline_entries b WHERE b.rule_id = f.rule_id
 AND coalesce(CASE WHEN regexp_full_match(b.expires, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})')
  THEN TRY_CAST(b.expires AS TIMESTAMPTZ) >= TIMESTAMPTZ '2024-02-01 00:00:00+00' END, TRUE)
 AND (b.file = '' OR ends_with(f.path, b.file)) AND (b.line <= 0 OR b.line = f.line))""")
def _(s, d):
    return PO.apply_baseline(l0(s, d), Q.baseline(s, d), as_of()).select("finding_id")


@query("d5_inline_suppression", "SELECT finding_id FROM unsuppressed")
def _(s, d):
    f = files(s, d)
    return PO.apply_inline_suppressions(CS.score_findings(S.l0_scan(f)), C.inline_suppressions(f)).select("finding_id")


_vul = ", ".join(K.inlist([r["algorithm"], ",".join(r["cves"]), r["break_year"]]) for r in V.VULNERABILITIES)
_mig = ", ".join(K.inlist([r["algorithm"], ", ".join(r["recommended"]), r["timeline"], r["effort"]]) for r in V.MIGRATIONS)
_perf = ", ".join(K.inlist([r["replacement"], r["keygen_slowdown"]]) for r in V.PERFORMANCE)


@query("d6_d8_lookups", f"""SELECT finding_id, coalesce(v.cves, '') AS cves, coalesce(v.break_year, '') AS break_year, coalesce(m.rec, '') AS recommended_text, coalesce(m.timeline, '') AS timeline,
 coalesce(p.slow, '') AS keygen_slowdown FROM l0_classified c LEFT JOIN (VALUES {_vul}) v(a, cves, break_year) ON upper(cls_algorithm) = v.a
 LEFT JOIN (VALUES {_mig}) m(a, rec, timeline, effort) ON upper(cls_algorithm) = m.a LEFT JOIN (VALUES {_perf}) p(r, slow) ON string_split(m.rec, ', ')[1] = p.r""")
def _(s, d):
    out = CL.with_migration(CL.with_vulnerability(CL.classify(l0(s, d))))
    e = lambda c: F.coalesce(c, F.lit(""))
    return out.select("finding_id", e(F.array_join("cves", ",")).alias("cves"), e(F.col("break_year")).alias("break_year"), e(F.col("recommended_text")).alias("recommended_text"),
                      e(F.col("timeline")).alias("timeline"), e(F.col("keygen_slowdown")).alias("keygen_slowdown"))


K.CTE["seq"] = "SELECT *, row_number() OVER (ORDER BY path, line, col, rule_id, finding_id) - 1 AS seq FROM l0"
K.CTE["labelled"] = """SELECT *, CASE WHEN seq % 3 < 2 THEN line % 2 = 0 END AS ai_is_valid, CASE WHEN seq % 3 < 2 THEN 0.25e0 * (line % 4 + 1) END AS ai_confidence,
 CASE WHEN seq % 3 < 2 THEN severity END AS ai_severity, seq % 3 < 2 AS has_ai_evaluation FROM seq"""


def evaluations(seq):
    """Evaluations of two thirds of the findings, half of them under the sequential id."""
    return seq.filter(F.col("seq") % 3 < 2).select(F.when(F.col("seq") % 3 == 0, F.col("finding_id")).otherwise(F.col("fallback_id")).alias("finding_id"),
                                                   (F.col("line") % 2 == 0).alias("is_valid"), (0.25 * (F.col("line") % 4 + 1)).alias("confidence"), "severity")


def stored_l0(s, d):
    """Findings that several passes read, written once to the checkpoint folder."""
    return checkpoint(l0(s, d))


def labelled(s, d):
    seq = EV.with_sequence(stored_l0(s, d))
    return EV.join_evaluations(seq, evaluations(seq))


@query("d9_g9_join_evaluations", "SELECT finding_id, seq, coalesce(ai_is_valid, FALSE) AS ai_is_valid, coalesce(ai_confidence, -1e0) AS ai_confidence, has_ai_evaluation FROM labelled")
def _(s, d):
    return labelled(s, d).select("finding_id", "seq", F.coalesce("ai_is_valid", F.lit(False)).alias("ai_is_valid"), F.coalesce("ai_confidence", F.lit(-1.0)).alias("ai_confidence"), "has_ai_evaluation")


K.CTE["batches"] = "SELECT *, seq // 5 AS batch_id, seq % 5 AS position FROM seq"


def batch_responses(batched):
    """A response per batch: full, too long, too short or unreadable by batch number."""
    b = F.col("batch_id")
    n = F.col("expected") + F.when(b % 4 == 1, 1).when(b % 4 == 2, -1).otherwise(0)
    items = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.format_string('{"is_valid": %s, "confidence": 0.5}', F.when((b + i) % 2 == 0, "true").otherwise("false")))
    text = F.when(b % 4 == 3, "sorry").otherwise(F.concat(F.lit("Here: ["), F.array_join(items, ","), F.lit("] done")))
    return batched.groupBy("batch_id").agg(F.count("*").alias("expected")).select("batch_id", "expected", text.alias("response"))


_BSQL = "SELECT b.*, count(*) OVER (PARTITION BY batch_id) AS expected FROM batches b"


@query("d11_join_responses", f"""SELECT finding_id, batch_id, CAST(position AS BIGINT) AS position, (batch_id + position + 1) % 2 = 0 AS is_valid FROM ({_BSQL}) WHERE batch_id % 4 IN (0, 1)
 OR (batch_id % 4 = 2 AND expected = 1)""")
def _(s, d):
    b = EV.assign_batches(stored_l0(s, d), 5)
    return EV.join_responses(b, RS.parse_responses(batch_responses(b))).select("finding_id", "batch_id", n64("position"), "is_valid")


@query("g4_batches_and_retries", f"SELECT finding_id, batch_id, CAST(position // 2 AS BIGINT) AS part, CAST(position % 2 AS BIGINT) AS new_position FROM ({_BSQL}) WHERE batch_id % 4 = 3 OR (batch_id % 4 = 2 AND expected > 1)")
def _(s, d):
    b = EV.assign_batches(stored_l0(s, d), 5)
    return EV.resubmission_plan(b, RS.parse_responses(batch_responses(b)), 5).select("finding_id", "batch_id", n64("part"), n64("new_position"))


_alt = K.table(V.PQ_ALTERNATIVES, "upper(algorithm)", V.PQ_ALTERNATIVE_DEFAULT)
_strat = K.cases([(f"upper(algorithm) = {K.q(a)} AND patch_language = {K.q(lang)}", K.q(t)) for (a, lang), t in V.MIGRATION_STRATEGIES.items()],
                 "'Migrate ' || algorithm || ' to post-quantum alternative'")
_tn = """CASE WHEN patch_language || '_' || crypto_type || '_' || lower(algorithm) IN ('go_asymmetric_rsa', 'go_signature_ecdsa') THEN patch_language || '_' || crypto_type || '_' || lower(algorithm)
 WHEN patch_language = 'go' THEN 'go_generic' ELSE 'generic' END"""
K.CTE["patch_rows"] = f"SELECT *, {_alt} AS pq_alternative, {_strat} AS migration_strategy, {_tn} AS template_name FROM (SELECT *, {language('patch')} AS patch_language FROM base)"


@query("d10_d12_alternatives", "SELECT finding_id, patch_language, pq_alternative, migration_strategy, template_name FROM patch_rows")
def _(s, d):
    out = MG.choose_template(MG.with_alternative(base(s, d)), MG.default_templates(s))
    return out.select("finding_id", "patch_language", "pq_alternative", "migration_strategy", "template_name")


@query("k16_patches", """SELECT finding_id, '--- ' || path || chr(10) || '+++ ' || path || chr(10) || '@@ line ' || line || ', column ' || col || ' @@' || chr(10) ||
 CASE template_name WHEN 'go_asymmetric_rsa' THEN '- ' || algorithm || ' key pair' || chr(10) || '+ ' || pq_alternative || ' key encapsulation, hybrid first'
  WHEN 'go_signature_ecdsa' THEN '- ' || algorithm || ' signature' || chr(10) || '+ ' || pq_alternative || ' signature, hybrid first'
  WHEN 'go_generic' THEN '- ' || algorithm || ' (' || crypto_type || ')' || chr(10) || '+ ' || pq_alternative
  ELSE '- ' || algorithm || ' in ' || patch_language || chr(10) || '+ ' || pq_alternative END || chr(10) || '# ' || migration_strategy || chr(10) AS patch FROM patch_rows""")
def _(s, d):
    return MG.render_patches(base(s, d), MG.default_templates(s)).select("finding_id", "patch")


@query("k17_template_validation", """SELECT name, unfilled, unfilled = '' AS valid FROM (SELECT 't' || CAST(p_partkey AS VARCHAR) AS name,
 CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Nowhere' ELSE 'Brand,Owner' END AS unfilled FROM part)""")
def _(s, d):
    k = F.col("p_partkey")
    t = read(s, d, "part").select(F.concat(F.lit("t"), k.cast("string")).alias("name"), F.when(k % 3 == 0, "{{.File}}: {{.Line}}").when(k % 3 == 1, "{{.Nowhere}} {{.File}}")
                                  .otherwise("{{.Owner}} {{.Brand}} {{.Line}}").alias("template"))
    return MG.validate_templates(t).select("name", F.array_join("unfilled", ",").alias("unfilled"), "valid")


@query("k15_migration_plan", f"""SELECT finding_id, m.rec AS recommended_text, m.timeline, m.effort FROM base b JOIN (VALUES {_mig}) m(a, rec, timeline, effort) ON upper(b.algorithm) = m.a""")
def _(s, d):
    return MG.migration_plan(base(s, d)).select("finding_id", "recommended_text", "timeline", "effort")


K.CTE["expected"] = "SELECT DISTINCT path, rule_id, CASE WHEN line % 2 = 0 THEN severity ELSE 'medium' END AS severity FROM base WHERE line % 3 < 2 QUALIFY row_number() OVER (PARTITION BY path, rule_id ORDER BY line, col) = 1 UNION ALL SELECT path, 'rule-that-never-fires', 'high' FROM code_files WHERE repo = 'repo1'"


@query("d15_expectations", """SELECT coalesce(a.path, e.path) AS path, coalesce(a.rule_id, e.rule_id) AS rule_id,
 CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'unexpected' WHEN a.severity <> e.severity THEN 'wrong_severity' ELSE 'matched' END AS status
 FROM (SELECT DISTINCT path, rule_id, severity FROM base) a FULL JOIN expected e ON a.path = e.path AND a.rule_id = e.rule_id""")
def _(s, d):
    b = base(s, d)
    first = b.filter(F.col("line") % 3 < 2).groupBy("path", "rule_id").agg(F.min_by(F.when(F.col("line") % 2 == 0, F.col("severity")).otherwise("medium"), F.struct("line", "col")).alias("severity"))
    never = listing(s, d).filter(F.col("repo") == "repo1").select("path", F.lit("rule-that-never-fires").alias("rule_id"), F.lit("high").alias("severity"))
    return SM.compare_expectations(PO.with_priority(b), first.unionByName(never)).select("path", "rule_id", "status")


@query("d16_dependency_advisories", """SELECT 'pkg' || CAST(l_partkey AS VARCHAR) AS package, CAST(l_linenumber AS VARCHAR) AS version, 'A' || CAST(p_partkey AS VARCHAR) AS vuln_id, CAST(count(*) AS BIGINT) AS n
 FROM lineitem JOIN part ON l_partkey = p_partkey AND (p_size % 3 = 0 OR CAST(p_size % 7 AS VARCHAR) = CAST(l_linenumber AS VARCHAR)) GROUP BY ALL""")
def _(s, d):
    deps = read(s, d, "lineitem").select(F.concat(F.lit("pkg"), F.col("l_partkey").cast("string")).alias("package"), F.col("l_linenumber").cast("string").alias("version"))
    k, z = F.col("p_partkey").cast("string"), F.col("p_size")
    adv = read(s, d, "part").select(F.concat(F.lit("pkg"), k).alias("package"), F.when(z % 3 == 0, "").otherwise((z % 7).cast("string")).alias("version"),
                                    F.concat(F.lit("A"), k).alias("vuln_id"), F.lit("high").alias("severity"), F.col("p_name").alias("title"))
    return DP.match_advisories(deps, adv).groupBy("package", "version", "vuln_id").agg(F.count("*").alias("n"))


# --- aggregates -------------------------------------------------------------------------

@query("e1_counts", """SELECT 'total' AS dimension, '' AS value, CAST(count(*) AS BIGINT) AS n_findings FROM l0 UNION ALL SELECT 'severity', severity, count(*) FROM l0 GROUP BY severity
 UNION ALL SELECT 'crypto_type', crypto_type, count(*) FROM l0 GROUP BY crypto_type""")
def _(s, d):
    return RP.counts_by(l0(s, d), "severity", "crypto_type")


K.CTE["sev_counts"] = "SELECT severity, count(*) AS n FROM l0 GROUP BY severity"


@query("e1_e2_scan_summary", f"""SELECT (SELECT count(*) FROM code_files) AS total_files, CAST(sum(n) AS BIGINT) AS total_findings, round(sum(n * {SUMMARY_W}) / sum({SUMMARY_W}), 6) AS risk_score,
 CAST(count(*) AS BIGINT) AS n_severities FROM sev_counts""")
def _(s, d):
    return RP.scan_summary(listing(s, d), l0(s, d)).select("total_files", n64("total_findings"), r6("risk_score"), F.size("by_severity").cast("bigint").alias("n_severities"))


_CW = f"{SUMMARY_W} * {K.table(V.CALCULATOR_TYPE_WEIGHT, 'lower(crypto_type)', 0.0)}"


@query("e3_calculator_risk", f"SELECT coalesce(sum({_CW}) / nullif(sum({_CW}), 0e0), 0e0) AS risk_score FROM base")
def _(s, d):
    return RK.calculator_risk(base(s, d))


@query("e4_overall_risk", f"SELECT repo, round({OVERALL}, 6) AS overall_risk, CAST(count(*) AS BIGINT) AS n_findings FROM risk GROUP BY repo")
def _(s, d):
    return RK.overall_risk(risk(s, d), "repo").select("repo", r6("overall_risk"), "n_findings")


_cat = f"CASE WHEN lower(crypto_type) IN {K.inlist(V.RISK_CATEGORIES)} THEN lower(crypto_type) ELSE 'library' END"


@query("e5_risk_by_category", f"""SELECT c.category, round(coalesce(r.score, 0e0), 6) AS risk_score, CAST(coalesce(r.n, 0) AS BIGINT) AS n_findings FROM (VALUES {', '.join('(' + K.q(x) + ')' for x in V.RISK_CATEGORIES)}) c(category)
 LEFT JOIN (SELECT {_cat} AS category, {OVERALL} AS score, count(*) AS n FROM risk GROUP BY 1) r USING (category)""")
def _(s, d):
    return RK.risk_by_category(risk(s, d)).select("category", r6("risk_score"), "n_findings")


_TREND = f"SELECT line * 5 // 24 AS batch, {OVERALL} AS overall_risk, count(*) AS n FROM risk GROUP BY 1"


@query("e6_g8_risk_trend", f"SELECT CAST(batch AS BIGINT) AS batch, round(overall_risk, 6) AS overall_risk, CAST(n AS BIGINT) AS n_findings, round(overall_risk - lag(overall_risk) OVER (ORDER BY batch), 6) AS delta FROM ({_TREND})")
def _(s, d):
    t = RK.risk_trend(risk(s, d).withColumn("batch", F.floor(F.col("line") * 5 / 24).cast("bigint")), "batch")
    return t.select("batch", r6("overall_risk"), "n_findings", r6("delta"))


@query("e7_recommendations", f"""SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS seq, t AS recommendation FROM (
 SELECT k, t FROM (VALUES {', '.join(f"({i}, {K.q(a)}, {K.q(t)})" for i, (a, t) in enumerate(RK.ADVICE.items()))}) v(k, a, t) WHERE a IN (SELECT algorithm FROM risk)
 UNION ALL SELECT 9, CASE WHEN o > 80 THEN {K.q(RK.RISK_ADVICE[0][1])} WHEN o > 60 THEN {K.q(RK.RISK_ADVICE[1][1])} WHEN o > 40 THEN {K.q(RK.RISK_ADVICE[2][1])} END FROM (SELECT {OVERALL} AS o FROM risk) WHERE o > 40)""")
def _(s, d):
    return RK.risk_recommendations(risk(s, d)).select(n64("seq"), "recommendation")


@query("e8_heat_map", "SELECT path, CAST((line - 1) // 50 AS BIGINT) AS line_block, round(max(risk) * 100, 6) AS max_risk, round(avg(risk) * 100, 6) AS avg_risk, CAST(count(*) AS BIGINT) AS n_findings FROM risk GROUP BY ALL")
def _(s, d):
    return RK.heat_map_rollup(risk(s, d)).select("path", "line_block", r6("max_risk"), r6("avg_risk"), "n_findings")


_BAND = K.cases([(f"confidence >= {K.num(f)}", K.q(n)) for n, f in V.CONFIDENCE_BANDS[:-1]], "'very_low'")


@query("e9_confidence_distribution", f"""SELECT b.band, CAST(count(l.finding_id) AS BIGINT) AS n_findings FROM (VALUES {', '.join('(' + K.q(n) + ')' for n, _f in V.CONFIDENCE_BANDS)}) b(band)
 LEFT JOIN l0_scored l ON b.band = {_BAND} GROUP BY b.band""")
def _(s, d):
    return CS.confidence_distribution(scored(s, d))


@query("e10_classification_summary", """SELECT CAST(count(*) AS BIGINT) AS total_findings, CAST(count(*) FILTER (WHERE cls_quantum_vulnerable) AS BIGINT) AS quantum_vulnerable,
 CAST(count(*) FILTER (WHERE cls_deprecated) AS BIGINT) AS deprecated, CAST(count(*) FILTER (WHERE cls_severity IN ('critical', 'high')) AS BIGINT) AS high_severity FROM l0_classified""")
def _(s, d):
    return CL.classification_summary(CL.classify(l0(s, d)))


@query("e11_vulnerability_summary", """SELECT k || '_' || sv AS metric, CAST((SELECT count(*) FROM base WHERE severity = sv AND k = 'crypto') + (SELECT count(*) FROM vulnerabilities WHERE severity = sv AND k = 'dep') AS BIGINT) AS n
 FROM (VALUES ('crypto'), ('dep')) a(k), (VALUES ('critical'), ('high'), ('medium'), ('low')) b(sv)""")
def _(s, d):
    return DP.vulnerability_summary(base(s, d), DP.ingest(Q.dependency_reports(s, d), ["repo"]))


@query("p4_dependency_scan", """SELECT v.repo, vuln_id, severity FROM vulnerabilities v JOIN ecosystems e ON v.repo = e.repo WHERE (ecosystem = 'npm' AND e.npm) OR (ecosystem = 'go' AND e.go)""")
def _(s, d):
    return DP.scan_project(Q.dependency_reports(s, d), PR.ecosystems(listing(s, d)), ["repo"]).select("repo", "vuln_id", "severity")


@query("e14_performance", """SELECT coalesce(event_type, 'overall') AS category, CAST(count(*) AS BIGINT) AS calls, round(sum(value), 4) AS total_seconds, min(value) AS min_seconds, max(value) AS max_seconds, round(avg(value), 6) AS avg_seconds
 FROM events GROUP BY ROLLUP (event_type)""")
def _(s, d):
    runs = read(s, d, "events").select(F.col("event_type").alias("category"), F.col("value").alias("seconds"))
    return SM.performance(runs).select("category", "calls", F.round("total_seconds", 4).alias("total_seconds"), "min_seconds", "max_seconds", r6("avg_seconds"))


def stage_runs(s, d):
    u = F.col("user_id")
    return read(s, d, "events").select(F.when(u % 3 == 0, "L0").when(u % 3 == 1, "L1").otherwise("L2").alias("stage"), F.col("value").alias("seconds"), (u % 5).alias("n_findings"))


K.CTE["stage_perf"] = """SELECT CASE user_id % 3 WHEN 0 THEN 'L0' WHEN 1 THEN 'L1' ELSE 'L2' END AS stage, count(*) AS calls, sum(value) AS total_seconds, sum(user_id % 5) AS n_findings FROM events GROUP BY 1"""


@query("e15_stage_performance", "SELECT stage, CAST(calls AS BIGINT) AS calls, round(total_seconds, 4) AS total_seconds, CAST(n_findings AS BIGINT) AS n_findings, round(n_findings / calls, 6) AS findings_per_call FROM stage_perf")
def _(s, d):
    return SM.stage_performance(stage_runs(s, d)).select("stage", "calls", F.round("total_seconds", 4).alias("total_seconds"), "n_findings", r6("findings_per_call"))


@query("e37_bottlenecks", """SELECT 'slowest_stage' AS kind, arg_max(stage, total_seconds / calls) AS name, round(max(total_seconds / calls), 6) AS value FROM stage_perf
 UNION ALL SELECT 'error_rate', 'group' || CAST(user_id % 10 AS VARCHAR), round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) FROM events GROUP BY 2 HAVING count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.1""")
def _(s, d):
    g = F.concat(F.lit("group"), (F.col("user_id") % 10).cast("string"))
    err = read(s, d, "events").groupBy(g.alias("category")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return SM.bottlenecks(SM.stage_performance(stage_runs(s, d)), err).select("kind", "name", r6("value"))


K.CTE["accuracy"] = f"""SELECT category, tp, fp, tp / (tp + fp) AS p, CASE WHEN tp > 0 THEN 1e0 ELSE 0e0 END AS r, c FROM (
 SELECT {K.CATEGORY} AS category, count(*) FILTER (WHERE likely) AS tp, count(*) FILTER (WHERE NOT likely) AS fp, avg(confidence) AS c FROM (SELECT *, {Q.LIKELY} AS likely FROM l0_scored) GROUP BY 1)"""


@query("e16_heuristic_accuracy", "SELECT category, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(p, 6) AS precision, r AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(c, 6) AS mean_confidence FROM accuracy")
def _(s, d):
    return SM.heuristic_accuracy(scored(s, d)).select("category", "tp", "fp", r6("precision"), "recall", r6("f1"), r6("mean_confidence"))


@query("e16_labelled_accuracy", """SELECT lang, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM (
 SELECT lang, count(*) FILTER (WHERE h AND q) AS tp, count(*) FILTER (WHERE h AND NOT q) AS fp, count(*) FILTER (WHERE NOT h AND q) AS fn, count(*) FILTER (WHERE NOT h AND NOT q) AS tn FROM (
 SELECT lang, quality = 0 AS q, concat_ws('/', source, lang, 'd' || CAST(doc_id AS VARCHAR) || '.dat') IN (SELECT path FROM secrets) AS h FROM documents JOIN labels USING (doc_id)) GROUP BY lang)""")
def _(s, d):
    f = C.document_files(s, d).withColumn("language", F.lit(""))
    docs = read(s, d, "documents").select("doc_id", "source", "lang").join(read(s, d, "labels"), "doc_id")
    lab = docs.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".dat"))).alias("path"), "lang", (F.col("quality") == 0).alias("is_positive"))
    return SM.labelled_accuracy(S.rule_scan(f, Q.SECRET_RULES), lab, "lang").select("lang", "tp", "fp", "fn", "tn", r6("precision"), r6("recall"))


@query("e17_benchmark_advice", """SELECT scope, advice FROM (SELECT 'overall' AS scope, 'raise parallelism' AS advice FROM events HAVING avg(value) > 5
 UNION ALL SELECT stage, 'optimise: over half of the time' FROM stage_perf WHERE total_seconds > (SELECT sum(value) / 2 FROM events)
 UNION ALL SELECT stage, 'review rules: few findings' FROM stage_perf WHERE n_findings / calls < 0.1
 UNION ALL SELECT category, 'tune rules: low precision' FROM accuracy WHERE p < 0.8 UNION ALL SELECT category, 'add rules: low recall' FROM accuracy WHERE r < 0.6)""")
def _(s, d):
    runs = read(s, d, "events").select(F.col("event_type").alias("category"), F.col("value").alias("seconds"))
    return SM.recommendations(SM.performance(runs), SM.stage_performance(stage_runs(s, d)), SM.heuristic_accuracy(scored(s, d)))


@query("e46_benchmark_report")
def _(s, d):
    runs = read(s, d, "events").select(F.col("event_type").alias("category"), F.col("value").alias("seconds"))
    return SM.benchmark_report(SM.performance(runs), SM.stage_performance(stage_runs(s, d)), SM.heuristic_accuracy(scored(s, d))).select("section", "name", "metric", r6("value"))


@query("f11_top_performers", "SELECT event_type AS category, round(count(*) / avg(value), 4) AS score FROM events GROUP BY 1 ORDER BY score DESC, category LIMIT 3")
def _(s, d):
    runs = read(s, d, "events").select(F.col("event_type").alias("category"), F.col("value").alias("seconds"))
    return SM.top_performers(SM.performance(runs), 3).select("category", F.round("score", 4).alias("score"))


@query("e18_rule_statistics", """SELECT dimension, value, CAST(count(*) AS BIGINT) AS n_rules FROM (SELECT 'total' AS dimension, 'rules' AS value FROM user_rules UNION ALL SELECT 'kind', kind FROM user_rules
 UNION ALL SELECT 'severity', severity FROM user_rules UNION ALL SELECT 'crypto_type', crypto_type FROM user_rules UNION ALL SELECT 'language', unnest(languages) FROM user_rules) GROUP BY ALL""")
def _(s, d):
    return RU.rule_statistics(Q.user_rules(s, d))


@query("e18_rule_hits", "SELECT r.rule_id, CAST(count(b.rule_id) AS BIGINT) AS n_findings FROM base_rules r LEFT JOIN base b USING (rule_id) GROUP BY r.rule_id")
def _(s, d):
    return RU.rule_hit_statistics(base(s, d), RU.rules_table(s, RU.default_rules())).select("rule_id", "n_findings")


@query("e19_project_languages", "SELECT repo, language, n_files, round(confidence, 6) AS confidence FROM project_languages")
def _(s, d):
    return PR.project_languages(listing(s, d)).select("repo", "language", "n_files", r6("confidence"))


@query("e20_package_managers", f"SELECT DISTINCT repo, package_manager FROM (SELECT repo, {K.table(V.PACKAGE_MANAGERS_FULL, BASE, None)} AS package_manager FROM code_files) WHERE package_manager IS NOT NULL")
def _(s, d):
    return PR.package_managers(listing(s, d), full_map=True)


@query("e21_source_directories", f"""SELECT DISTINCT repo, string_split(rel, '/')[1] AS directory FROM (SELECT repo, {REL} AS rel FROM code_files) WHERE contains(rel, '/') AND string_split(rel, '/')[1] IN {K.inlist(V.SOURCE_DIRECTORIES)}
 UNION ALL SELECT repo, '.' FROM (SELECT repo, {REL} AS rel FROM code_files) GROUP BY repo HAVING count(*) FILTER (WHERE contains(rel, '/') AND string_split(rel, '/')[1] IN {K.inlist(V.SOURCE_DIRECTORIES)}) = 0""")
def _(s, d):
    return PR.source_directories(listing(s, d))


@query("e22_primary_language", f"""SELECT repo, language AS primary_language, CAST(n AS BIGINT) AS n_files FROM (SELECT repo, {language('primary')} AS language, count(*) AS n FROM code_files GROUP BY ALL) WHERE language <> ''
 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, language) = 1""")
def _(s, d):
    return PR.primary_language(listing(s, d))


@query("e23_repository_statistics", """SELECT repo, CAST(count(*) AS BIGINT) AS total_findings, CAST(count(*) FILTER (WHERE band = 'high') AS BIGINT) AS high_confidence, CAST(count(*) FILTER (WHERE context_type = 'test') AS BIGINT) AS test_findings,
 CAST(count(*) FILTER (WHERE context_type = 'library') AS BIGINT) AS library_findings, CAST(count(*) FILTER (WHERE level = 'low_level') AS BIGINT) AS low_level_findings, round(avg(confidence), 6) AS mean_confidence,
 round(quantile_cont(confidence, 0.5), 6) AS median_confidence, round(coalesce(stddev_samp(confidence), 0e0), 6) AS std_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM fleet GROUP BY repo""")
def _(s, d):
    return FL.repository_statistics(l0(s, d)).select("repo", "total_findings", "high_confidence", "test_findings", "library_findings", "low_level_findings", r6("mean_confidence"),
                                                     r6("median_confidence"), r6("std_confidence"), "min_confidence", "max_confidence")


_DIST = " UNION ALL ".join(f"SELECT repo, '{c}' AS dimension, {c} AS value FROM l0" for c in ("severity", "algorithm", "language", "crypto_type"))


@query("e23_distributions", f"SELECT repo, dimension, value, CAST(count(*) AS BIGINT) AS n_findings FROM ({_DIST}) GROUP BY ALL")
def _(s, d):
    return FL.repository_distributions(l0(s, d))


@query("e24_global_statistics", """SELECT CAST(count(*) AS BIGINT) AS total_findings, round(avg(confidence), 6) AS mean_confidence, round(quantile_cont(confidence, 0.5), 6) AS median_confidence, round(stddev_samp(confidence), 6) AS std_confidence,
 (SELECT count(DISTINCT repo) FROM code_files) AS total_repositories, round(count(*) / (SELECT count(DISTINCT repo) FROM code_files), 6) AS avg_findings_per_repo FROM l0 WHERE confidence > 0""")
def _(s, d):
    return FL.global_statistics(l0(s, d), listing(s, d)).select("total_findings", r6("mean_confidence"), r6("median_confidence"), r6("std_confidence"), "total_repositories", r6("avg_findings_per_repo"))


@query("e24_combined_distributions", f"SELECT dimension, value, CAST(count(*) AS BIGINT) AS n_findings FROM ({_DIST}) GROUP BY dimension, value")
def _(s, d):
    return FL.combined_distributions(FL.repository_distributions(l0(s, d))).select("dimension", "value", n64("n_findings"))


@query("e25_training_suitability", """SELECT CAST(count(*) AS BIGINT) AS training_samples, CAST(count(*) FILTER (WHERE band = 'high') AS BIGINT) AS high_quality_samples, CAST(count(DISTINCT algorithm) AS BIGINT) AS diverse_algorithms,
 CAST(count(DISTINCT language) AS BIGINT) AS diverse_languages, round(count(*) FILTER (WHERE context_type = 'test') / count(*), 6) AS test_ratio, round(count(*) FILTER (WHERE band = 'low') / count(*), 6) AS low_ratio,
 concat_ws('; ', CASE WHEN count(*) < 1000 THEN 'scan more repositories' END, CASE WHEN count(*) FILTER (WHERE band = 'high') < 100 THEN 'collect more high-confidence samples' END,
 CASE WHEN count(DISTINCT algorithm) < 20 THEN 'scan more diverse libraries' END, CASE WHEN count(*) FILTER (WHERE context_type = 'test') / count(*) > 0.5 THEN 'balance test findings' END) AS advice FROM fleet""")
def _(s, d):
    return FL.training_suitability(l0(s, d)).select("training_samples", "high_quality_samples", "diverse_algorithms", "diverse_languages", r6("test_ratio"), r6("low_ratio"), "advice")


@query("e26_combined_statistics", "SELECT f.repo, CAST(count(l.repo) AS BIGINT) AS n_findings FROM (SELECT DISTINCT repo FROM code_files UNION SELECT DISTINCT repo FROM document_files) f LEFT JOIN l0 l ON f.repo = l.repo GROUP BY f.repo")
def _(s, d):
    repos = listing(s, d).select("repo").unionByName(C.document_files(s, d).select("repo"))
    return FL.combined_statistics(l0(s, d), repos)


_EVAL = "SELECT is_valid, confidence, severity, priority, tokens, cost FROM (SELECT line % 2 = 0 AS is_valid, confidence, severity, CASE WHEN line % 3 = 0 THEN 'high' ELSE 'low' END AS priority, batch_id, (batch_id + 100) // count(*) OVER (PARTITION BY batch_id) AS tokens, (70e0 * 0.15e0 / 1000000e0 + (batch_id + 30) * 0.6e0 / 1000000e0) / count(*) OVER (PARTITION BY batch_id) AS cost FROM batches)"


def evaluated(s, d):
    b = EV.assign_batches(stored_l0(s, d), 5).select("finding_id", "batch_id", (F.col("line") % 2 == 0).alias("is_valid"), "confidence", "severity", F.when(F.col("line") % 3 == 0, "high").otherwise("low").alias("priority"))
    usage = b.select("batch_id").distinct().select("batch_id", (F.col("batch_id") + 100).alias("total_tokens"), F.lit(70).alias("prompt_tokens"), (F.col("batch_id") + 30).alias("completion_tokens"))
    return EV.share_costs(b, usage)


@query("e27_e30_evaluation_summary", f"""SELECT CAST(count(*) AS BIGINT) AS total_findings, CAST(count(*) FILTER (WHERE is_valid) AS BIGINT) AS valid_findings, CAST(count(*) FILTER (WHERE NOT is_valid) AS BIGINT) AS false_positives,
 CAST(sum(tokens) AS BIGINT) AS total_tokens, round(sum(cost), 6) AS total_cost, round(avg(confidence), 6) AS average_confidence FROM ({_EVAL})""")
def _(s, d):
    return EV.evaluation_summary(evaluated(s, d)).select("total_findings", "valid_findings", "false_positives", "total_tokens", r6("total_cost"), r6("average_confidence"))


@query("e28_valid_counts", f"""SELECT 'severity' AS dimension, upper(severity[1]) || lower(severity[2:]) AS value, CAST(count(*) AS BIGINT) AS n_valid FROM ({_EVAL}) WHERE is_valid GROUP BY ALL
 UNION ALL SELECT 'priority', upper(priority[1]) || lower(priority[2:]), count(*) FROM ({_EVAL}) WHERE is_valid GROUP BY ALL""")
def _(s, d):
    return EV.valid_counts(evaluated(s, d))


@query("e29_cost_estimate", f"""SELECT model, t AS total_tokens, CAST(floor(t * 0.7e0) AS BIGINT) AS input_tokens, CAST(floor(t * 0.3e0) AS BIGINT) AS output_tokens, round(floor(t * 0.7e0) * i / 1000000e0 + floor(t * 0.3e0) * o / 1000000e0, 6) AS cost
 FROM (SELECT CAST(count(*) * 300 AS BIGINT) AS t FROM l0), (VALUES {', '.join(f'({K.q(m)}, {K.num(i)}, {K.num(o)})' for m, (i, o) in V.MODEL_PRICES.items())}) p(model, i, o)""")
def _(s, d):
    return EV.cost_estimate(l0(s, d)).select("model", "total_tokens", "input_tokens", "output_tokens", r6("cost"))


@query("e38_suite_score", """SELECT e.path, e.category, CAST(coalesce(p.n, 0) AS BIGINT) AS n_findings, CASE WHEN e.category = 'false_positive' THEN coalesce(p.n, 0) = 0
  WHEN e.category = 'configuration' THEN coalesce(p.n > 0 AND p.info AND list_has_any(p.rules, ['tls-config-kconfig', 'tls-cipher-config']), FALSE)
  ELSE coalesce(p.n > 0 AND p.top = 4 AND list_has_any(p.rules, ['go-rsa-keygen', 'weak-hash-md5', 'weak-rsa-keylength']), FALSE) END AS passed
 FROM (SELECT path, CASE WHEN path LIKE '%.md' THEN 'false_positive' WHEN path LIKE '%.kconfig' THEN 'configuration' ELSE 'application_vulnerability' END AS category FROM code_files) e
 LEFT JOIN (SELECT path, count(*) AS n, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS top, bool_or(severity = 'info') AS info, list(DISTINCT rule_id) AS rules FROM base GROUP BY path) p ON e.path = p.path""")
def _(s, d):
    p = F.col("path")
    cat = F.when(p.endswith(".md"), "false_positive").when(p.endswith(".kconfig"), "configuration").otherwise("application_vulnerability")
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    exp = listing(s, d).select("path", cat.alias("category"), F.lit("critical").alias("expected_severity")).withColumn(
        "expected_rules", F.when(F.col("category") == "configuration", arr("tls-config-kconfig", "tls-cipher-config")).otherwise(arr("go-rsa-keygen", "weak-hash-md5", "weak-rsa-keylength")))
    return SM.suite_score(base(s, d), exp).select("path", "category", "n_findings", "passed")


@query("e39_exit_status", "SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS exit_status FROM secrets")
def _(s, d):
    f = C.document_files(s, d).withColumn("language", F.lit(""))
    return PO.exit_status(S.rule_scan(f, Q.SECRET_RULES))


@query("e40_errors", f"SELECT path, 'too large' AS error FROM mixed_files WHERE strlen(content) > 20000 UNION ALL SELECT path, 'binary' FROM mixed_files WHERE strlen(content) <= 20000 AND {K.BINARY_EXT}")
def _(s, d):
    return C.read_failures(C.mixed_files(s, d), max_size=20000)


@query("e41_progress", """SELECT CAST(count(*) AS BIGINT) AS done, CAST(20000 AS BIGINT) AS expected, round(count(*) * 100e0 / 20000, 6) AS percent, round(count(*) / 10e0, 6) AS per_minute, round((20000 - count(*)) / (count(*) / 10e0), 6) AS minutes_left FROM events""")
def _(s, d):
    e = read(s, d, "events").select("event_id")
    return EV.progress(e, 20000, 10.0).select("done", "expected", r6("percent"), r6("per_minute"), r6("minutes_left"))


@query("e42_risk_band", f"SELECT repo, CASE WHEN o > 70 THEN 'High' WHEN o > 40 THEN 'Medium' ELSE 'Low' END AS band FROM (SELECT repo, {OVERALL} AS o FROM risk GROUP BY repo)")
def _(s, d):
    return RK.overall_risk(risk(s, d), "repo").select("repo", RK.risk_band(F.col("overall_risk")).alias("band"))


@query("e45_run_summary", "SELECT (SELECT count(*) FROM code_files) AS n_files, (SELECT count(*) FROM l0) AS findings_before, (SELECT count(*) FROM l0 WHERE confidence >= 0.5e0) AS findings_after, 0.5e0 AS min_confidence")
def _(s, d):
    f = l0(s, d)
    return RP.run_summary(listing(s, d), f, PO.min_confidence(f, 0.5), 0.5)


# --- windows, ranking, sets ----------------------------------------------------------------

@query("f1_dedupe_keys", "SELECT path, rule_id, CAST(count(*) AS BIGINT) AS n_lines FROM l0 GROUP BY ALL")
def _(s, d):
    return l0(s, d).groupBy("path", "rule_id").agg(F.count("*").alias("n_lines"))


@query("f2_k5_dedupe_and_library", "SELECT path, rule_id, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, severity, message, crypto_library_context FROM library_adjusted")
def _(s, d):
    f = base_files(s, d)
    twice = S.rule_scan(f)
    out = S.adjust_for_library(S.dedupe_findings(twice.unionByName(twice)))
    return out.select("path", "rule_id", n64("line"), n64("col"), "severity", "message", "crypto_library_context")


@query("f3_g3_sarif_rules", """SELECT rule_id, CAST(row_number() OVER (ORDER BY path, line, col, rule_id) - 1 AS BIGINT) AS rule_index, message AS short_text, message || ' (' || severity || ')' AS full_text,
 CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS default_level FROM (SELECT * FROM l0 QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY path, line, col, finding_id) = 1)""")
def _(s, d):
    return RP.sarif_rules(l0(s, d)).select("rule_id", n64("rule_index"), "short_text", "full_text", "default_level")


K.CTE["sarif_rule_index"] = "SELECT rule_id, row_number() OVER (ORDER BY path, line, col, rule_id) - 1 AS rule_index FROM (SELECT * FROM l0 QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY path, line, col, finding_id) = 1)"


@query("s2_s4_sarif_results", """SELECT l.rule_id, CAST(i.rule_index AS BIGINT) AS rule_index, message, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level,
 path AS uri, CAST(line AS BIGINT) AS start_line, CAST(col AS BIGINT) AS start_column, path || ':' || CAST(line AS VARCHAR) AS fingerprint FROM l0 l JOIN sarif_rule_index i ON l.rule_id = i.rule_id""")
def _(s, d):
    return RP.sarif_results(l0(s, d)).select("rule_id", n64("rule_index"), "message", "level", "uri", n64("start_line"), n64("start_column"), "fingerprint")


@query("s1_s2_sarif_json")
def _(s, d):
    return RP.sarif_json(l0(s, d))


@query("s3_rule_help", """SELECT b.finding_id, 'Suggestion: ' || suggestion || CASE WHEN r.pq_replacement LIKE 'ML-KEM%' THEN chr(10) || chr(10) || 'References:' || chr(10) || '- https://csrc.nist.gov/pubs/fips/203/final' || chr(10)
 WHEN r.pq_replacement LIKE 'ML-DSA%' THEN chr(10) || chr(10) || 'References:' || chr(10) || '- https://csrc.nist.gov/pubs/fips/204/final' || chr(10) ELSE '' END AS help_text FROM (SELECT finding_id, rule_id FROM base) b JOIN base_rules r USING (rule_id)""")
def _(s, d):
    helps = RP.rule_help(RU.rules_table(s, RU.default_rules()))
    return base(s, d).select("finding_id", "rule_id").join(F.broadcast(helps), "rule_id").select("finding_id", "help_text")


@query("s5_csv_rows", 'SELECT path AS "File", CAST(line AS BIGINT) AS "Line", severity AS "Severity", message AS "Message", crypto_type AS "Type", algorithm AS "Algorithm", CAST(0 AS BIGINT) AS "KeySize", suggestion AS "Suggestion" FROM base')
def _(s, d):
    out = RP.csv_rows(base(s, d))
    return out.withColumns({"Line": F.col("Line").cast("bigint"), "KeySize": F.col("KeySize").cast("bigint")})


@query("s6_executive_summary", f"""SELECT 'risk_level' AS item, CASE WHEN r > 0.7 THEN 'High' WHEN r > 0.3 THEN 'Medium' ELSE 'Low' END AS value FROM (SELECT sum(n * {SUMMARY_W}) / sum({SUMMARY_W}) AS r FROM sev_counts)
 UNION ALL SELECT 'total_files', CAST(count(*) AS VARCHAR) FROM code_files UNION ALL SELECT 'total_findings', CAST(count(*) AS VARCHAR) FROM l0 UNION ALL SELECT severity, CAST(n AS VARCHAR) FROM sev_counts
 UNION ALL SELECT DISTINCT 'recommendation', 'Address critical and high findings now' FROM sev_counts WHERE severity IN ('critical', 'high')
 UNION ALL SELECT 'recommendation', 'Remediate medium findings in the next sprint' FROM sev_counts WHERE severity = 'medium' UNION ALL SELECT 'recommendation', 'Plan low findings for a later update' FROM sev_counts WHERE severity = 'low'""")
def _(s, d):
    return RP.executive_summary(listing(s, d), l0(s, d)).filter(F.col("item") != "risk_score")


@query("s11_published_schema", "SELECT finding_id AS id, path AS file, CAST(line AS BIGINT) AS line, severity, NOT cls_quantum_vulnerable AS quantum_safe FROM l0_classified")
def _(s, d):
    return RP.published_schema(CL.classify(l0(s, d))).select("id", "file", n64("line"), "severity", "quantum_safe")


@query("s11_published_summary", "SELECT CAST(count(*) AS BIGINT) AS total_findings, CAST(count(*) FILTER (WHERE severity IN ('critical', 'high')) AS BIGINT) AS high_severity, CAST(count(*) FILTER (WHERE cls_quantum_vulnerable) AS BIGINT) AS quantum_vulnerable FROM l0_classified")
def _(s, d):
    return RP.published_summary(CL.classify(l0(s, d)))


@query("s7_u4_combined_results", "SELECT path, rule_id, severity FROM base UNION ALL SELECT path, rule_id, severity FROM secrets")
def _(s, d):
    f = C.document_files(s, d).withColumn("language", F.lit(""))
    return FL.union_repositories([base(s, d).drop("language"), S.rule_scan(f, Q.SECRET_RULES)]).select("path", "rule_id", "severity")


@query("f5_top_by_confidence", "SELECT finding_id, round(confidence, 6) AS confidence FROM l0_scored ORDER BY l0_scored.confidence DESC, finding_id LIMIT 100")
def _(s, d):
    return PO.top_by_confidence(scored(s, d), 100).select("finding_id", r6("confidence"))


@query("f4_global_order", "SELECT finding_id, CAST(row_number() OVER (ORDER BY round(confidence, 6) DESC, finding_id) - 1 AS BIGINT) AS rank FROM l0_scored")
def _(s, d):
    return PO.ranked_by_confidence(scored(s, d).withColumn("confidence", F.round("confidence", 6))).select("finding_id", "rank")


@query("f6_prioritized_top_k", f"SELECT finding_id, severity FROM base ORDER BY {K.PRIORITY_KEYS} LIMIT 50")
def _(s, d):
    return PO.prioritize(base(s, d), 50).select("finding_id", "severity")


@query("f7_evaluation_selection", f"SELECT finding_id FROM l0 WHERE confidence >= 0.6e0 ORDER BY {K.PRIORITY_KEYS} LIMIT 200")
def _(s, d):
    return PO.filter_for_evaluation(l0(s, d), 0.6, 200).select("finding_id")


@query("f8_g2_top_per_repository", f"SELECT repo, finding_id, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {K.PRIORITY_KEYS}) AS rank FROM l0) WHERE rank <= 25")
def _(s, d):
    return PO.top_per_group(l0(s, d), "repo", 25).select("repo", "finding_id", n64("rank"))


@query("f10_top_algorithms", """SELECT repo, algorithm, CAST(n AS BIGINT) AS n, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, algorithm) AS rank FROM (
 SELECT repo, algorithm, count(*) AS n FROM l0 GROUP BY ALL UNION ALL SELECT '*', algorithm, count(*) FROM l0 GROUP BY algorithm)) WHERE rank <= CASE WHEN repo = '*' THEN 20 ELSE 10 END""")
def _(s, d):
    return FL.top_algorithms(l0(s, d)).select("repo", "algorithm", n64("n"), n64("rank"))


@query("f12_fingerprints", "SELECT path, CAST(line AS BIGINT) AS line, rule_id FROM l0 QUALIFY row_number() OVER (PARTITION BY path, line ORDER BY col, rule_id, finding_id) = 1")
def _(s, d):
    return PO.fingerprint_dedupe(l0(s, d)).select("path", n64("line"), "rule_id")


@query("g5_sticky_library_mode", f"SELECT path, coalesce(string_split(path, '/') >= (SELECT min(string_split(path, '/')) FROM code_files WHERE ({LIB_NAME}) IS NOT NULL), FALSE) AS library_mode FROM code_files")
def _(s, d):
    return CS.sticky_library_mode(listing(s, d)).select("path", "library_mode")


@query("g6_repository_rankings", """SELECT ranking, CAST(rank AS BIGINT) AS rank, repo FROM (SELECT ranking, repo, row_number() OVER (PARTITION BY ranking ORDER BY score DESC, repo) AS rank FROM (
 SELECT 'by_total_findings' AS ranking, repo, CAST(count(*) AS DOUBLE) AS score FROM fleet GROUP BY repo UNION ALL SELECT 'by_high_confidence', repo, count(*) FILTER (WHERE band = 'high') FROM fleet GROUP BY repo
 UNION ALL SELECT 'by_avg_confidence', repo, round(avg(confidence), 9) FROM fleet GROUP BY repo)) WHERE rank <= 10""")
def _(s, d):
    st = FL.repository_statistics(l0(s, d)).withColumn("mean_confidence", F.round("mean_confidence", 9))
    return FL.repository_rankings(st).select("ranking", n64("rank"), "repo")


@query("g7_running_confidence", "SELECT finding_id, round(avg(confidence) OVER (PARTITION BY path ORDER BY line, col, rule_id, finding_id ROWS UNBOUNDED PRECEDING), 6) AS running_confidence FROM l0")
def _(s, d):
    return SM.running_mean_confidence(l0(s, d)).select("finding_id", r6("running_confidence"))


@query("u2_union_of_detectors", "SELECT path, rule_id, CAST(line AS BIGINT) AS line, stage FROM base UNION ALL SELECT path, rule_id, CAST(line AS BIGINT), stage FROM structural")
def _(s, d):
    a = base(s, d).select("path", "rule_id", n64("line"), "stage")
    return a.unionByName(S.structural_scan(files(s, d), RU.structural_rules()).select("path", "rule_id", n64("line"), "stage"))


@query("u5_language_gaps", f"SELECT DISTINCT language FROM (SELECT {language('scan')} AS language FROM code_files) WHERE language NOT IN {K.inlist(sorted({x for r in K.BASE_RULES for x in r.languages}))}")
def _(s, d):
    return RU.language_gap(files(s, d).select("language"), RU.rules_table(s, RU.default_rules()))


@query("u6_rules_in_both_scans", "SELECT DISTINCT rule_id FROM base INTERSECT SELECT DISTINCT rule_id FROM l0")
def _(s, d):
    return base(s, d).select("rule_id").distinct().intersect(l0(s, d).select("rule_id").distinct())


# --- scores ---------------------------------------------------------------------------------

@query("k1_l0_confidence", "SELECT finding_id, round(confidence, 6) AS confidence FROM l0_mixed")
def _(s, d):
    return S.l0_scan(C.file_context(C.mixed_files(s, d))).select("finding_id", r6("confidence"))


@query("k2_classification", """SELECT path, rule_id, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, cls_algorithm, cls_type, cls_severity, round(cls_confidence, 6) AS cls_confidence, CAST(cls_key_size AS BIGINT) AS cls_key_size FROM base_classified""")
def _(s, d):
    return CL.classify(adjusted(s, d)).select("path", "rule_id", n64("line"), n64("col"), "cls_algorithm", "cls_type", "cls_severity", r6("cls_confidence"), n64("cls_key_size"))


@query("k3_context_score", "SELECT finding_id, severity, round(confidence, 6) AS confidence, ml_prediction FROM l0_scored")
def _(s, d):
    return scored(s, d).select("finding_id", "severity", r6("confidence"), "ml_prediction")


@query("k3_context_features", f"SELECT finding_id, {', '.join(f'round({f}, 6) AS {n}' for n, f in K.ML_FEATURES.items())} FROM (SELECT *, {LIB_NAME} IS NOT NULL AS library_mode, {K.TEST} AS is_test, {K.VENDORED} AS is_vendored FROM l0)")
def _(s, d):
    return scored(s, d).select("finding_id", *[r6(f"feature_{n}", n) for n in K.ML_FEATURES])


@query("k4_relaxed_severity", "SELECT severity, CAST(count(*) AS BIGINT) AS n FROM l0_scored GROUP BY severity")
def _(s, d):
    return scored(s, d).groupBy("severity").agg(F.count("*").alias("n"))


@query("k6_finding_risk", "SELECT finding_id, round(risk, 6) AS risk, algorithm_risk, context_risk, temporal_risk FROM (SELECT finding_id, risk, algorithm_risk, round(context_risk, 6) AS context_risk, round(temporal_risk, 6) AS temporal_risk FROM risk)")
def _(s, d):
    return risk(s, d).select("finding_id", r6("risk"), RK.algorithm_risk(F.col("algorithm")).alias("algorithm_risk"), r6(RK.context_risk(F.col("context")), "context_risk"),
                             r6(RK.temporal_risk(found_at(), F.col("crypto_type"), as_of()), "temporal_risk"))


@query("k7_calculator_confidence", f"""SELECT finding_id, round(least(1e0, greatest(0e0, {SUMMARY_W} * 0.3e0 + {K.table(V.CALCULATOR_TYPE_WEIGHT, 'lower(crypto_type)', 0.0)} * 0.3e0
 + CASE WHEN context = '' THEN 0.5e0 WHEN strlen(context) > 200 THEN 1e0 WHEN strlen(context) > 100 THEN 0.8e0 WHEN strlen(context) > 50 THEN 0.6e0 ELSE 0.4e0 END * 0.2e0
 + CASE WHEN algorithm = '' THEN 0.5e0 WHEN key_size > 0 THEN 1e0 WHEN {K.has('lower(algorithm)', ['aes', 'rsa', 'ecdsa', 'sha'])} THEN 0.9e0 ELSE 0.7e0 END * 0.2e0)), 6) AS confidence FROM l1""")
def _(s, d):
    return l1(s, d).select("finding_id", r6(RK.calculator_confidence(), "confidence"))
