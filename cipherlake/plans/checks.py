"""Reference SQL for the registered queries (DuckDB dialect), written from the definitions.

Intermediate results are named common table expressions; ``sql(text)`` adds the ones a
statement uses.  Word lists and tables come from the fixed values.
"""

from __future__ import annotations

import re

from cipherlake import fixed_values as V
from cipherlake.functions.text import alternation
from cipherlake.operators import rules as RU
from cipherlake.sources.corpus import MARKERS, SNIPPETS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def num(x) -> str:
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def lit(x) -> str:
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, str):
        return q(x)
    return num(x) if isinstance(x, float) else str(x)


def lst(xs) -> str:
    return "[" + ", ".join(lit(x) for x in xs) + "]"


def inlist(xs) -> str:
    return "(" + ", ".join(lit(x) for x in xs) + ")"


def rx(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def has(expr: str, words) -> str:
    return rx(expr, alternation(words))


def haslow(expr: str, words) -> str:
    """Words with capitals cannot match lower-cased text."""
    return has(f"lower({expr})", [w for w in words if w == w.lower()])


def cases(pairs, default) -> str:
    body = " ".join(f"WHEN {c} THEN {v}" for c, v in pairs)
    return f"CASE {body} ELSE {default} END"


def table(mapping: dict, expr: str, default) -> str:
    return cases([(f"{expr} = {lit(k)}", lit(v)) for k, v in mapping.items()], lit(default) if default is not None else "NULL")


def step(cond: str, delta: float) -> str:
    return f"CASE WHEN {cond} THEN {num(delta)} ELSE 0e0 END"


BASE = "regexp_extract(path, '([^/]*)$', 1)"
EXT = "lower(regexp_extract(path, '\\.([^./]*)$', 1))"


def language(variant: str, path: str = "path") -> str:
    mapping, unknown = V.LANGUAGE_TABLES[variant]
    ext = (f"regexp_extract({path}, '\\.([^.]*)$', 1)" if variant == "wrapper"
           else f"lower(regexp_extract({path}, '\\.([^./]*)$', 1))")
    return table(mapping, ext, unknown)


def tail(expr: str, suffixes) -> str:
    return rx(expr, "(?:" + alternation(suffixes) + ")$")


VENDORED, GENERATED, TEST = has("path", V.VENDOR_PARTS), has("lower(path)", V.GENERATED_PARTS), has("path", V.TEST_PARTS)
TEST_STRICT = cases([(has("lower(path)", V.STRONG_TEST_PARTS), "TRUE"),
                     ("contains(lower(path), 'test')", f"NOT {tail('lower(path)', V.C_TEST_SUFFIXES)}")], "FALSE")
CONFIG = tail("lower(path)", V.CONFIG_SUFFIXES)
DOC = (f"({EXT} IN {inlist(V.DOC_EXTENSIONS)} OR {rx(f'lower({BASE})', '^(?:' + '|'.join(V.DOC_PREFIXES) + ')')}"
       f" OR {has('path', V.DOC_DIRECTORIES)})")
DOC_LOOSE = has("lower(path)", V.DOC_PARTS)
CATEGORY = cases([(TEST_STRICT, "'test_files'"), (VENDORED, "'vendor_files'"), (CONFIG, "'config_files'"),
                  (DOC_LOOSE, "'doc_files'")], "'source_files'")
BINARY_EXT = f"{EXT} IN {inlist(V.BINARY_EXTENSIONS)}"
BINARY_NAME = f"({BINARY_EXT} OR {has(f'lower({BASE})', V.BINARY_NAME_WORDS)})"
KNOWN_TEXT = f"({EXT} IN {inlist(V.TEXT_EXTENSIONS)} OR lower({BASE}) IN {inlist(V.TEXT_FILENAMES)})"
SKIP = cases([(f"NOT {has('lower(path)', V.SKIP_EXCEPTIONS)} AND ({VENDORED} OR {GENERATED})", "'third_party'"),
              (f"{tail('lower(path)', V.IRRELEVANT_SUFFIXES)} OR {has('path', V.IRRELEVANT_PARTS)}", "'irrelevant'")], "NULL")
LIB_IMPL = haslow("path", V.LIBRARY_IMPLEMENTATION_PARTS)
LIB_ANY = has("lower(path)", V.LIBRARY_PARTS)
LIB_NAME = cases([(has("lower(path)", p), q(n)) for n, p in V.LIBRARY_NAMES.items()], "NULL")


def glob(p: str) -> str:
    return "^" + "".join("[^/]*" if c == "*" else alternation([c]) for c in p) + "$"


def ignored(variant: str) -> str:
    stems = [(p[:-1] if p.endswith("*") else p) if variant == "base" else p.strip("*") for p in V.DEFAULT_IGNORE_PATTERNS]
    return f"({rx('path', '|'.join(glob(p) for p in V.DEFAULT_IGNORE_PATTERNS))} OR {has('path', stems)})"


REL = "regexp_replace(path, '^[^/]*/', '')"
EXCLUDED = (f"({rx('rel', '^(?:' + alternation(V.PROFILE_EXCLUSIONS) + ')')} OR rel IN"
            f" {inlist([p.removesuffix('/') for p in V.PROFILE_EXCLUSIONS])} OR"
            f" lower(regexp_extract(rel, '\\.([^./]*)$', 1)) IN {inlist(V.BINARY_EXTENSIONS)})")


def evidence(lang: str) -> str:
    files, exts, dirs, conf = V.LANGUAGE_EVIDENCE[lang]
    name = "regexp_extract(rel, '([^/]*)$', 1)"
    by_name = " OR ".join([f"{name} IN {inlist([f for f in files if '*' not in f])}"] + [rx(name, glob(f)) for f in files if "*" in f])
    base = cases([(f"({by_name})", num(conf)), (f"regexp_extract(rel, '(\\.[^./]*)$', 1) IN {inlist(exts)}",
                                                num(V.EXTENSION_ONLY_CONFIDENCE))], "0e0")
    return f"({base}" + "".join(f" + {step(f'starts_with(rel, {q(d)})', V.DIRECTORY_BONUS)}" for d in [x + "/" for x in dirs]) + ")"


ALG_IN = lambda t: cases([(f"contains(lower({t}), {q(a)})", q(a.upper())) for a in V.L0_ALGORITHM_ORDER], "'UNKNOWN'")


def clamp(expr: str, lo: float, hi: float) -> str:
    return f"greatest({num(lo)}, least({num(hi)}, {expr}))"


def l0_confidence() -> str:
    alg = ALG_IN("context")
    k8s = f"({haslow('context', V.KUBERNETES_WORDS)} OR {haslow('path', V.KUBERNETES_WORDS)})"
    parts = ["0.3e0", cases([("priority = 1", "0.3e0"), ("priority = 2", "0.2e0")], "0.1e0"),
             step("contains(context, '(') AND contains(context, ')')", 0.2),
             step("contains(context, '//') OR contains(context, '/*')", -0.3),
             step(haslow("context", V.SAMPLE_DATA_WORDS), -0.4), step(haslow("context", V.HARDWARE_WORDS), -0.3),
             step(f"contains(lower(context), 'falcon') AND {haslow('context', V.FALCON_HARDWARE_WORDS)}", -0.5),
             step(f"{k8s} AND {haslow('context', V.KUBERNETES_PKI_WORDS)} AND {alg} IN ('RSA', 'ECDSA')", -0.2),
             step(f"{k8s} AND {haslow('context', V.KUBERNETES_HASH_WORDS)} AND {alg} IN ('MD5', 'SHA1')", -0.4),
             step(f"{k8s} AND {haslow('context', V.KUBERNETES_TOKEN_WORDS)}", -0.1),
             step(haslow("context", V.TEST_CONTEXT_WORDS), -0.2),
             step(f"{alg} IN ('MD5', 'SHA1') AND {haslow('context', V.UTILITY_HASH_WORDS)}", -0.3)]
    return clamp(" + ".join(parts), 0.1, 1.0)


def applies(rule, variant: str) -> str:
    if not rule.languages or (variant == "l0" and "*" in rule.languages):
        return "TRUE"
    same = f"lower(language) IN {inlist([x.lower() for x in rule.languages])}"
    return same if variant == "l0" else f"({same} OR language = '')"


def matches(source: str, rules, variant: str, where: str = "TRUE") -> str:
    """All matches by whole-text arithmetic: the offset of match i is the length of the first i
    pieces and of the i-1 matches before it."""
    branches = [f"SELECT path, repo, language, content, {q(r.rule_id)} AS rule_id, {q(r.pattern)} AS pat FROM {source}"
                f" WHERE {where} AND {applies(r, variant)} AND {rx('content', r.pattern)}" for r in rules]
    extract = cases([(f"rule_id = {q(r.rule_id)}", f"regexp_extract_all(content, {q(r.pattern)})") for r in rules], "[]")
    split = cases([(f"rule_id = {q(r.rule_id)}", f"regexp_split_to_array(content, {q(r.pattern)})") for r in rules], "[]")
    return f"""
SELECT path, repo, language, rule_id, pos, match_text,
       CAST(length(prefix) - length(replace(prefix, chr(10), '')) + 1 AS INTEGER) AS line,
       CAST(strlen(regexp_extract(prefix, '([^\\n]*)$', 1)) + 1 AS INTEGER) AS col,
       substr(content, greatest(pos - 50, 0) + 1, pos - greatest(pos - 50, 0) + length(match_text) + 50) AS context
FROM (SELECT *, substr(content, 1, pos) AS prefix FROM (
  SELECT path, repo, language, content, rule_id, ms[i] AS match_text,
         CAST(list_sum(list_transform(ps[1:i], lambda x: length(x)))
              + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT path, repo, language, content, rule_id, {extract} AS ms, {split} AS ps FROM ({' UNION ALL '.join(branches)})))))"""


def rule_values(rules) -> str:
    rows = ", ".join("(" + ", ".join(lit(x) for x in (r.rule_id, r.message, r.severity, r.crypto_type, r.algorithm, r.priority,
                                                       r.suggestion, r.pq_replacement, r.name)) + ")" for r in rules)
    return (f"SELECT * FROM (VALUES {rows}) t(rule_id, message, severity, crypto_type, rule_algorithm, priority,"
            f" suggestion, pq_replacement, name)")


ID = "sha256(concat_ws('|', path, CAST(line AS VARCHAR), CAST(col AS VARCHAR), rule_id, message))"
L0, BASE_RULES, STRUCT_RULES = RU.l0_rules(), RU.default_rules(), RU.structural_rules()

_n = len(SNIPPETS)
_repo = "'repo' || CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE CAST(p_partkey % 20 AS VARCHAR) END"
_body = lst(["\n".join(s[2]) for s in SNIPPETS])
CTE: dict[str, str] = {}

CTE["code_files"] = f"""
SELECT repo, repo || mids[k] || 'f' || CAST(p_partkey AS VARCHAR) || sufs[k] AS path,
       '// ' || p_type || ' ' || p_name || chr(10) || body[k] || repeat(chr(10) || 'value = ' || p_name, p_size)
       || chr(10) || body[o] || chr(10) AS content
FROM (SELECT *, {_repo} AS repo, p_partkey % {_n} + 1 AS k, (p_partkey + p_size) % {_n} + 1 AS o,
             {lst([s[0] for s in SNIPPETS])} AS mids, {lst([s[1] for s in SNIPPETS])} AS sufs, {_body} AS body FROM part)
UNION ALL
SELECT {_repo}, {_repo} || '/p' || CAST(p_partkey AS VARCHAR) || '/' || {lst(MARKERS)}[p_partkey % {len(MARKERS)} + 1],
       'name: ' || p_name || chr(10) FROM part WHERE p_size <= 3"""
CTE["mixed_files"] = f"""
SELECT source AS repo, source || '/src/d' || CAST(doc_id AS VARCHAR) || {lst([s[1] for s in SNIPPETS])}[doc_id % {_n} + 1] AS path,
       {_body}[doc_id % {_n} + 1] || chr(10) || text || ' ' || {_body}[(doc_id + 5) % {_n} + 1] AS content FROM documents"""
CTE["document_files"] = """
SELECT source AS repo, concat_ws('/', source, lang, 'd' || CAST(doc_id AS VARCHAR) || '.dat') AS path, text AS content FROM documents"""
CTE["page_files"] = """
SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS repo,
       regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/p' || CAST(page_id AS VARCHAR) || '.html' AS path, html AS content FROM pages"""
CTE["files"] = f"SELECT *, {language('scan')} AS language, {TEST} AS is_test, {VENDORED} AS is_vendored FROM code_files"
CTE["base_files"] = f"SELECT *, {language('base')} AS language FROM code_files"
CTE["mixed"] = f"SELECT *, {language('scan')} AS language FROM mixed_files"
CTE["l0_rules"] = rule_values(L0)
CTE["base_rules"] = rule_values(BASE_RULES)
CTE["struct_rules"] = rule_values(STRUCT_RULES)


def l0_from(source: str) -> str:
    return f"""
SELECT *, {ID} AS finding_id, 'L0' AS stage FROM (
  SELECT m.*, r.message, r.severity, r.crypto_type, r.priority, r.suggestion, {ALG_IN('match_text')} AS algorithm,
         {l0_confidence()} AS confidence
  FROM ({matches(source, L0, 'l0')}) m JOIN l0_rules r USING (rule_id))
WHERE confidence >= 0.2e0
QUALIFY row_number() OVER (PARTITION BY path, line, rule_id ORDER BY pos) = 1"""


CTE["l0"] = l0_from("files")
CTE["l0_mixed"] = l0_from("mixed")
CTE["base"] = f"""
SELECT *, {ID} AS finding_id, 'base' AS stage, 0.5e0 AS confidence FROM (
  SELECT m.*, r.message, r.severity, r.crypto_type, r.priority, r.suggestion, r.rule_algorithm AS algorithm
  FROM ({matches('base_files', BASE_RULES, 'base', f'NOT {DOC}')}) m JOIN base_rules r USING (rule_id))"""
CTE["file_lines"] = """
SELECT path, repo, language, CAST(i AS INTEGER) AS line, ls[i] AS text
FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, repo, language, string_split(content, chr(10)) AS ls FROM files))"""
CTE["structural"] = f"""
SELECT *, {ID} AS finding_id, 0.7e0 AS confidence, 'structural' AS stage FROM (
  SELECT h.*, r.message, r.severity, r.crypto_type, r.rule_algorithm AS algorithm, r.suggestion, r.priority FROM (
    {' UNION ALL '.join(f'''SELECT path, repo, language, {q(r.rule_id)} AS rule_id, CAST(0 AS BIGINT) AS pos, line,
      CAST(strlen(text) - strlen(regexp_replace(text, '^\\s+', '')) + 1 AS INTEGER) AS col, trim(text) AS match_text, text AS context
      FROM file_lines WHERE language = {q(r.languages[0])} AND {rx('text', r.pattern)}''' for r in STRUCT_RULES)}) h
  JOIN struct_rules r USING (rule_id))"""

_broken, _relaxed = f"upper(algorithm) IN {inlist(V.BROKEN_ALGORITHMS)}", f"upper(algorithm) IN {inlist(V.LIBRARY_RELAXED_ALGORITHMS)}"
_kind = f"""CASE WHEN NOT ({LIB_IMPL} OR {LIB_ANY}) THEN 'none' WHEN {_broken} THEN 'broken' WHEN {_relaxed} THEN 'relaxed'
            WHEN crypto_type IN ('symmetric', 'asymmetric') THEN 'general' ELSE 'none' END"""
CTE["base_unique"] = """
SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY path, line, col, rule_id, message ORDER BY confidence DESC, pos) = 1"""
CTE["library_adjusted"] = f"""
SELECT * EXCLUDE (severity, message, kind),
  CASE WHEN kind = 'relaxed' THEN CASE severity WHEN 'critical' THEN 'medium' WHEN 'high' THEN 'low' WHEN 'medium' THEN 'info' ELSE severity END
       WHEN kind = 'general' THEN CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'info' ELSE severity END
       ELSE severity END AS severity,
  CASE kind WHEN 'broken' THEN algorithm || ' inside a cryptography library: schedule its removal.'
            WHEN 'relaxed' THEN algorithm || ' inside a cryptography library: watch for quantum-resistant replacements.'
            WHEN 'general' THEN 'Part of a cryptography library: check it against current standards.' ELSE message END AS message,
  kind <> 'none' AS crypto_library_context
FROM (SELECT *, {_kind} AS kind FROM base_unique)"""

# classification
_known = lambda i: [(f"upper(cls_algorithm) = {q(n)}", lit(p[i])) for n, p in V.ALGORITHM_PATTERNS.items()]
_order = sorted(V.ALGORITHM_PATTERNS.items(), key=lambda kv: (-kv[1][1], kv[0]))
BEST = f"CASE WHEN algorithm <> '' THEN algorithm ELSE {cases([(rx('lower(context)', '|'.join(p[0])), q(n)) for n, p in _order], q(''))} END"
CTYPE = cases(_known(2) + [(rx("lower(context)", p), q(n)) for p, n in V.CRYPTO_TYPE_PATTERNS], "'unknown'")
PARAM = {n: f"regexp_extract(context, {q(p)}, 1)" for n, p in V.PARAMETER_PATTERNS.items()}
N_PARAM = " + ".join(f"(CASE WHEN {e} <> '' THEN 1 ELSE 0 END)" for e in PARAM.values())
_quality = ", ".join(f"CASE WHEN {rx('lower(context)', p)} THEN {num(w)} ELSE 0e0 END" for p, w in V.CONTEXT_QUALITY_PATTERNS.items())
_path_q = cases([(has("lower(path)", ["crypto", "security"]), "0.9e0"), (has("lower(path)", ["test", "example"]), "0.4e0"),
                 (has("lower(path)", ["vendor", "node_modules"]), "0.2e0")], "0.6e0")
_msg_q = cases([("message = ''", "0.3e0"), (has("lower(message)", V.MESSAGE_TERMS), "0.7e0")], "0.5e0")
_threat = lambda lv: inlist([r["algorithm"] for r in V.VULNERABILITIES if lv in (r["quantum_threat"], r["classical_threat"])])


def classified(source: str) -> str:
    a = "upper(cls_algorithm)"
    return f"""
SELECT *, {cases([(f"{a} IN {_threat('critical')}", "'critical'"), (f"{a} IN {_threat('high')}", "'high'"),
                  (f"{a} IN ('MD5', 'SHA1', 'DES', 'RC4')", "'critical'"), (f"{a} = 'RSA' AND cls_key_size > 0 AND cls_key_size < 2048", "'critical'"),
                  (f"{a} = 'RSA'", "'high'"), (f"{a} IN ('ECDSA', 'ECDH', 'DSA')", "'high'"),
                  (f"{a} = 'AES' AND cls_key_size > 0 AND cls_key_size < 128", "'high'"), (f"{a} = 'AES'", "'info'")], "'medium'")} AS cls_severity,
  {cases([(c, 'FALSE' if v == 'TRUE' else 'TRUE') for c, v in _known(4)], has(a, V.QUANTUM_VULNERABLE_PARTS))} AS cls_quantum_vulnerable,
  {cases(_known(3), has(a, V.DEPRECATED_PARTS))} AS cls_deprecated
FROM (SELECT *, {CTYPE} AS cls_type, coalesce(TRY_CAST({PARAM['key_size']} AS INTEGER), 0) AS cls_key_size, {N_PARAM} AS n_params,
  ({cases(_known(1), '0.5e0')} * 0.3e0
   + CASE WHEN context = '' THEN 0.3e0 ELSE greatest(0.5e0, {_quality}) END * 0.25e0
   + {_path_q} * 0.2e0 + least(1e0, ({N_PARAM}) / 4e0) * 0.15e0 + {_msg_q} * 0.1e0) AS cls_confidence
FROM (SELECT *, {BEST} AS cls_algorithm FROM {source}))"""


CTE["base_classified"] = classified("library_adjusted")
CTE["l0_classified"] = classified("l0")

# context score
_call = "contains(context, '(') AND contains(context, ')')"
_weak = " + ".join(f"CAST(contains(lower(context), {q(w)}) AS INTEGER)" for w in V.WEAK_TEST_WORDS)
_hits = lambda words: "(" + " + ".join(f"CAST(contains(lower(context), {q(w)}) AS DOUBLE)" for w in words if w == w.lower()) + ")"
_impl = f"{_hits(V.HIGH_IMPLEMENTATION_WORDS)} * 0.15e0 + {_hits(V.MEDIUM_IMPLEMENTATION_WORDS)} * 0.08e0" + "".join(
    f" + CASE WHEN {tail('lower(path)', sfx)} THEN {_hits(words)} * 0.1e0 ELSE 0e0 END" for sfx, words in V.LANGUAGE_IMPLEMENTATION_WORDS)
ML_FEATURES = {
    "function_call_context": cases([(f"{_call} AND {has('context', V.CALL_WORDS)}", "1e0"), (_call, "0.7e0")], "0e0"),
    "crypto_library_context": cases([(f"library_mode OR {haslow('context', V.LIBRARY_WORDS)}", "1e0")], "0e0"),
    "library_implementation_context": cases([("library_mode", f"least(1e0, {_impl})")], "0e0"),
    "variable_assignment": cases([(has("context", V.ASSIGNMENT_WORDS), "0.8e0")], "0e0"),
    "import_context": cases([(haslow("context", V.IMPORT_WORDS), "0.9e0")], "0e0"),
    "comment_proximity": cases([(has("context", V.COMMENT_MARKS), "1e0"), (haslow("context", V.DOCUMENT_WORDS), "0.5e0")], "0e0"),
    "test_file_context": cases([
        (f"is_test AND {has('lower(path)', V.DETECTION_TEST_PARTS)}", "0e0"), ("is_test", "0.3e0"),
        (haslow("context", V.STRONG_TEST_WORDS), "0.8e0"), (f"({_weak}) >= 2", "0.4e0"),
        (f"({_weak}) = 1 AND {haslow('context', V.IMPLEMENTATION_WORDS)}", "0e0"), (f"({_weak}) = 1", "0.2e0")], "0e0"),
    "vendor_code_context": cases([("is_vendored", "1e0"), (f"library_mode AND {haslow('context', V.LIBRARY_CODE_WORDS)}", "0.8e0"),
                                  ("library_mode", "0e0"), (haslow("context", V.VENDOR_WORDS), "0.8e0")], "0e0"),
}
_reput = ", ".join(f"CASE WHEN contains(lower(context), {q(k)}) THEN {num(v)} ELSE 0e0 END" for k, v in V.LIBRARY_REPUTATION.items() if v > 0.5)


def scored(source: str) -> str:
    total = "0.5e0" + "".join(f" + {f} * {num(V.FEATURE_WEIGHTS[n])}" for n, f in ML_FEATURES.items())
    return f"""
SELECT * EXCLUDE (severity, confidence, ml),
  CASE WHEN ml > 0.1e0 AND ml < 0.3e0 AND severity = 'critical' THEN 'high' WHEN ml > 0.1e0 AND ml < 0.3e0 AND severity = 'high' THEN 'medium'
       ELSE severity END AS severity, ml AS confidence,
  {cases([(f'ml >= {num(f)}', q(n + '_confidence')) for n, f in V.CONFIDENCE_BANDS[:-1]], "'very_low_confidence'")} AS ml_prediction
FROM (SELECT *, {clamp(f"({total}) * {table(V.ML_ALGORITHM_WEIGHT, 'algorithm', 1.0)} * {table(V.ML_SEVERITY_FACTOR, 'severity', 1.0)}"
                       f" * greatest(0.5e0, {_reput}) + {table(V.STAGE_BOOST, 'stage', 0.0)}", 0.0, 1.0)} AS ml
FROM (SELECT *, {LIB_NAME} IS NOT NULL AS library_mode, {TEST} AS is_test, {VENDORED} AS is_vendored FROM {source}))"""


CTE["l0_scored"] = scored("l0")

# risk: findings are dated five hours per line before the reference time
_by_len = sorted(V.ALGORITHM_RISK, key=lambda k: (-len(k), k))
ALG_RISK = (f"coalesce({table(V.ALGORITHM_RISK, 'upper(algorithm)', None)}, "
            + cases([(f"contains(upper(algorithm), {q(k)})", num(V.ALGORITHM_RISK[k])) for k in _by_len], "0.5e0") + ")")
SEV_RISK = table(V.RISK_VALUE, "lower(severity)", 0.5)
CTX_RISK = clamp(f"0.5e0 + {step(haslow('context', V.PRODUCTION_WORDS), 0.2)} + {step(haslow('context', V.TEST_RISK_WORDS), -0.3)}"
                 f" + {step(haslow('context', V.KEY_WORDS), 0.3)}", 0.0, 1.0)
TIME_RISK = clamp("0.5e0 + CASE WHEN line * 18000 < 86400 THEN 0.2e0 WHEN line * 18000 < 604800 THEN 0.1e0 ELSE 0e0 END"
                  f" + {step(f'lower(crypto_type) IN {inlist(V.URGENT_TYPES)}', 0.3)}", 0.0, 1.0)
CTE["risk"] = f"""
SELECT *, ({ALG_RISK} * 0.3e0 + {SEV_RISK} * 0.25e0 + confidence * 0.2e0 + {CTX_RISK} * 0.15e0 + {TIME_RISK} * 0.1e0) AS risk,
       {SEV_RISK} AS risk_weight, {ALG_RISK} AS algorithm_risk, {CTX_RISK} AS context_risk, {TIME_RISK} AS temporal_risk FROM l0"""
OVERALL = "least(100e0, coalesce(sum(risk * risk_weight) / nullif(sum(risk_weight), 0e0), 0e0) * 100e0 * (1e0 - exp(-count(risk) / 10e0)))"
CRITICALITY = cases([(has("lower(algorithm)", w), str(s)) for w, s in V.CRITICALITY], str(V.CRITICALITY_DEFAULT))
SEV_ORDER = table(V.PRIORITY_ORDER, "lower(severity)", 0)
SUMMARY_W = table(V.SUMMARY_WEIGHT, "lower(severity)", 0.0)
PRIORITY_KEYS = f"{SEV_ORDER} DESC, confidence DESC, {CRITICALITY} DESC, line, finding_id"

# inline suppressions and baseline
CTE["marks"] = """
SELECT path, line, regexp_extract(text, 'suppress:([\\w*-]+)(?:\\s+(line|block|file))?', 1) AS rule_id,
       CASE WHEN regexp_extract(text, 'suppress:([\\w*-]+)(?:\\s+(line|block|file))?', 2) = '' THEN 'line'
            ELSE regexp_extract(text, 'suppress:([\\w*-]+)(?:\\s+(line|block|file))?', 2) END AS scope
FROM file_lines WHERE regexp_matches(text, 'suppress:([\\w*-]+)(?:\\s+(line|block|file))?')"""


def _resolve(text: str, done: list[str]) -> None:
    for name in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
        if name in CTE and name not in done and re.search(rf"\b(?:FROM|JOIN)\s+\(?{name}\b", text):
            _resolve(CTE[name], done)
            if name not in done:
                done.append(name)


def sql(text: str) -> str:
    """The statement with every common table expression it needs, in order of use."""
    names: list[str] = []
    _resolve(text, names)
    if not names:
        return text.strip()
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in names) + "\n" + text.strip()
