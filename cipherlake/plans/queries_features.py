"""Registered queries: text features, embeddings, embedded scores, models, jobs, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.operators import context_score as CS
from cipherlake.operators import embedded as EM
from cipherlake.operators import embedding as E
from cipherlake.operators import enhanced as EN
from cipherlake.operators import evaluate as EV
from cipherlake.operators import features as FT
from cipherlake.operators import risk as RK
from cipherlake.operators import scan as SC
from cipherlake.operators import training as TR
from cipherlake.plans import checks as K
from cipherlake.plans import jobs as J
from cipherlake.plans import queries as Q
from cipherlake.plans.checks import language
from cipherlake.plans.queries import as_of, files, l0, n64, query, r6, read, risk
from cipherlake.plans.queries_findings import evaluations, labelled, lay_files, stored_l0
from cipherlake.session import checkpoint, scratch
from cipherlake.sources import corpus as C
from cipherlake.streaming import stream as ST

# --- text features ---------------------------------------------------------------------


def _cnt(p: str) -> str:
    return f"CAST(len(regexp_extract_all(content, {K.q(p)})) AS BIGINT)"


def _lit_cnt(expr: str, w: str) -> str:
    return f"(length({expr}) - length(replace({expr}, {K.q(w)}, ''))) // {len(w)}"


_words = " + ".join(_lit_cnt("lower(content)", w) for w in V.CRYPTO_KEYWORDS)
_branch = " + ".join(_lit_cnt("content", w) for w in ("if ", "for ", "while ", "switch ", "case "))
K.CTE["text_features"] = f"""
SELECT path, feature_language, CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT) AS lines_of_code, {_cnt(r'\w+\s*\(')} AS function_calls,
 {_cnt(r'\b(var|let|const|int|string)\s+\w+')} AS variable_declarations, {_cnt(r'\b(import|include|require|use)\s+')} AS import_statements,
 {_cnt('(?i)(crypto|cipher|hash|encrypt|decrypt|rsa|aes|sha|md5)')} AS crypto_pattern_hits, CAST({_words} AS BIGINT) AS crypto_words, CAST(1 + {_branch} AS BIGINT) AS cyclomatic,
 {K.rx('content', '(?i)(for|while).*crypto')} AS has_crypto_loop, {K.rx('content', '(?i)if.*crypto')} AS has_crypto_conditional, {K.rx('content', '(?i)(try|catch).*crypto')} AS has_crypto_try,
 feature_language = 'go' AND contains(content, '*') AS has_pointers,
 CASE feature_language WHEN 'go' THEN contains(content, '[T') WHEN 'java' THEN contains(content, '<') AND contains(content, '>') ELSE FALSE END AS has_generics,
 CASE feature_language WHEN 'go' THEN contains(content, 'package crypto') WHEN 'java' THEN contains(content, 'package') AND contains(lower(content), 'crypto') ELSE FALSE END AS in_crypto_namespace
FROM (SELECT *, {language('features')} AS feature_language FROM SRC)"""
_TF = K.CTE.pop("text_features")
K.CTE["text_features"] = _TF.replace("SRC", "code_files")
K.CTE["text_features_mixed"] = _TF.replace("SRC", "mixed_files")
_FEATS = ["lines_of_code", "function_calls", "variable_declarations", "import_statements", "crypto_pattern_hits", "crypto_words", "cyclomatic", "has_crypto_loop",
          "has_crypto_conditional", "has_crypto_try", "has_pointers", "has_generics", "in_crypto_namespace"]


@query("e33_text_features", f"SELECT path, {', '.join(_FEATS)} FROM text_features_mixed")
def _(s, d):
    return FT.text_features(C.mixed_files(s, d)).select("path", *_FEATS)


_GROUP = f"CASE {language('features')} WHEN 'typescript' THEN 'javascript' WHEN 'cpp' THEN 'c' ELSE {language('features')} END"
_struct = ", ".join(K.cases([(f"language_group = {K.q(g)}", _cnt(t[w])) for g, t in FT.STRUCTURE.items()], "0") + f" AS {w}"
                    for w in ("functions", "variables", "classes"))
K.CTE["structure"] = f"SELECT path, language_group, {_struct}, {_cnt(r'\w+\s*\(')} AS calls FROM (SELECT *, {_GROUP} AS language_group FROM code_files) WHERE language_group IN {K.inlist(list(FT.STRUCTURE))}"


@query("e34_language_structure", "SELECT path, language_group, functions, variables, classes, calls FROM structure")
def _(s, d):
    return FT.language_structure(C.code_files(s, d)).select("path", "language_group", "functions", "variables", "classes", "calls")


@query("e43_crypto_roles", f"SELECT path, {', '.join(f'{_cnt(p)} AS {n}' for n, p in FT.ROLE_PATTERNS.items())} FROM code_files")
def _(s, d):
    return FT.role_features(C.code_files(s, d))


_BR = r"\b(?:if|for|while|switch|match|case|catch|except)\b|\?[^?:\n]*:"


@query("e35_complexity", f"SELECT path, {_cnt(_BR)} + 1 AS cyclomatic_complexity, {_cnt(r'\w+\s*\(')} * 1.5e0 AS halstead_complexity FROM mixed_files")
def _(s, d):
    return FT.complexity(C.mixed_files(s, d))


_NEAR = r"""(?im)^\s*(?:import|from|#include|use|require|using)\b[^\n]*(?:crypto|hashlib|ssl|rsa|security)"""
_NS = r"(?im)^\s*(?:package|namespace|module|mod)\s+[\w.]*crypto"
_ERR = r"\b(?:try|catch|except|rescue)\b|err\s*!=\s*nil|, err :?=|\)\?;"
K.CTE["context_flags"] = f"""SELECT path, {K.rx('content', _NS)} AS in_namespace, {K.rx('content', _NEAR)} AS near_crypto_imports, {K.has('content', ['//', '/*', '#'])} AS has_documentation,
 {K.rx('content', _ERR)} AS has_error_handling, contains(lower(path), 'security') OR contains(lower(path), 'crypto') AS in_security_context FROM code_files"""


@query("e44_context_flags", "SELECT path, in_namespace, near_crypto_imports, has_documentation, has_error_handling, in_security_context FROM context_flags")
def _(s, d):
    return FT.context_flags(C.code_files(s, d)).withColumnRenamed("in_crypto_namespace", "in_namespace")


@query("e33_page_features", "SELECT path, lines_of_code, crypto_words, import_statements FROM (SELECT * FROM (" + _TF.replace("SRC", "page_files") + "))")
def _(s, d):
    return FT.text_features(C.page_files(s, d)).select("path", "lines_of_code", "crypto_words", "import_statements")


# --- embeddings -------------------------------------------------------------------------

_TW = K.table(V.TOKEN_WEIGHTS, "token", None)
K.CTE["token_counts"] = f"SELECT finding_id, n, token, count(*) AS c, any_value({_TW}) AS w FROM token_rows GROUP BY finding_id, n, token"


@query("e31_term_frequencies", "SELECT finding_id, token, CAST(c AS BIGINT) AS n_token, round(c / n, 6) AS tf, round(c / n * coalesce(w, 1e0), 6) AS weighted_tf FROM token_counts")
def _(s, d):
    return E.term_frequencies(l0(s, d), C.paths_differ(Q.listing(s, d))).select("finding_id", "token", "n_token", r6("tf"), r6("weighted_tf"))


_ALGW = K.table(V.TOKEN_WEIGHTS, "lower(algorithm)", None)
K.CTE["crypto_scores"] = f"""SELECT l.finding_id, least(10e0, greatest(0e0, coalesce({_ALGW}, 0e0) * 1.5e0 + t.s * 0.1e0 + {K.table(V.FEATURE_SEVERITY, 'severity', 0.0)} * 0.3e0 + confidence * 2e0)) AS crypto_score
FROM l0 l JOIN (SELECT finding_id, sum(coalesce(w, 0e0) * c) AS s FROM token_counts GROUP BY finding_id) t USING (finding_id)"""


@query("k10_crypto_score", "SELECT finding_id, round(crypto_score, 5) AS crypto_score FROM crypto_scores")
def _(s, d):
    t = l0(s, d).withColumn("tokens", E.tokens(F.col("context"), F.col("path")))
    return t.select("finding_id", F.round(E.crypto_score(), 5).alias("crypto_score"))


_lang_rows = [(n, w, x) for n, ws in V.LANGUAGE_WORD_WEIGHTS.items() for w, x in ws.items() if w == w.lower()]
_ctx_tests = {"crypto_directory": "contains(lower(path), 'crypto')", "security_context": "contains(lower(path), 'security')", "test_file": "contains(lower(path), 'test')",
              "vendor_code": "contains(lower(path), 'vendor') OR contains(lower(path), 'node_modules')", "function_call": "contains(context, '(') AND contains(context, ')')",
              "import_statement": K.has("lower(context)", ["import", "include", "require"]), "comment": K.has("context", ["//", "/*", "#"]), "variable_assignment": "contains(context, '=')"}
K.CTE["feature_rows"] = f"""
SELECT finding_id, 'semantic' AS section, 'algorithm_weight' AS name, {_ALGW} AS value FROM l0 WHERE {_ALGW} IS NOT NULL
UNION ALL SELECT finding_id, 'semantic', 'severity_score', {K.table(V.FEATURE_SEVERITY, 'severity', None)} FROM l0
UNION ALL SELECT finding_id, 'semantic', 'confidence_score', confidence * 10e0 FROM l0
UNION ALL SELECT finding_id, 'language', 'language_detected', 1e0 FROM l0
UNION ALL SELECT finding_id, 'language', 'lang_' || w.lang || '_' || w.word, w.weight FROM (SELECT *, {language('features')} AS feature_language FROM l0) l
  JOIN (VALUES {', '.join(f'({K.q(a)}, {K.q(b)}, {K.num(c)})' for a, b, c in _lang_rows)}) w(lang, word, weight) ON l.feature_language = w.lang AND contains(lower(l.context), w.word)
UNION ALL SELECT finding_id, 'language', 'token_freq_' || token, c / n * w FROM token_counts WHERE w IS NOT NULL
{' '.join(f"UNION ALL SELECT finding_id, 'context', {K.q(n)}, {K.num(V.CONTEXT_FEATURE_WEIGHTS[n])} FROM l0 WHERE {t}" for n, t in _ctx_tests.items())}"""


@query("k11_feature_maps", "SELECT finding_id, section, name, round(value, 6) AS value FROM feature_rows")
def _(s, d):
    e = E.embed(l0(s, d))

    def tagged(section, col):
        return F.transform(F.map_entries(col), lambda x: F.struct(F.lit(section).alias("section"), x["key"].alias("name"), x["value"].alias("value")))

    parts = F.concat(tagged("semantic", "semantic"), tagged("language", "language_map"), tagged("context", "context_map"))
    return e.select("finding_id", F.inline(parts)).select("finding_id", "section", "name", r6("value"))


K.CTE["token_slots"] = """SELECT finding_id, slot, sum(wt) AS v FROM (SELECT finding_id, (CAST('0x' || substr(sha256(token), 1, 8) AS BIGINT) + 17 * i) % 102 AS slot, c / n * coalesce(w, 1e0) AS wt
 FROM token_counts, (VALUES (0), (1), (2)) t(i)) GROUP BY ALL"""
K.CTE["vector_values"] = "SELECT finding_id, v FROM token_slots UNION ALL SELECT finding_id, value FROM feature_rows"
K.CTE["vector_stats"] = """SELECT finding_id, sum(v) / sqrt(sum(v * v)) / 256 AS mean, 1e0 / 256 - pow(sum(v) / sqrt(sum(v * v)) / 256, 2) AS var, max(v) / sqrt(sum(v * v)) AS hi, least(min(v), 0e0) / sqrt(sum(v * v)) AS lo
 FROM vector_values GROUP BY finding_id"""


@query("e32_e36_embedding_vectors", "SELECT finding_id, round(mean, 5) AS mean, round(var, 5) AS variance, round(hi, 5) AS hi, round(lo, 5) AS lo FROM vector_stats")
def _(s, d):
    st = E.vector_statistics(F.col("vector"))
    r5 = lambda c, n: F.round(c, 5).alias(n)
    return E.embed(l0(s, d)).select("finding_id", r5(st["embedding_vector_mean"], "mean"), r5(st["embedding_vector_std"], "variance"), r5(st["embedding_vector_max"], "hi"), r5(st["embedding_vector_min"], "lo"))


@query("e32_token_section", "SELECT slot, round(sum(v), 4) AS total, CAST(count(*) AS BIGINT) AS n FROM token_slots GROUP BY slot")
def _(s, d):
    t = l0(s, d).withColumn("tokens", E.tokens(F.col("context"), F.col("path")))
    per = t.select("finding_id", F.inline(E.token_slots(F.col("tokens"), 102))).withColumnRenamed("w", "v")
    if not C.paths_differ(Q.listing(s, d)):  # else findings have different ids, and what is in the row is a finding's whole sum
        per = per.groupBy("finding_id", "p").agg(F.sum("v").alias("v"))
    return per.groupBy(F.col("p").cast("bigint").alias("slot")).agg(F.round(F.sum("v"), 4).alias("total"), F.count("*").alias("n"))


_COS = "list_sum(list_transform(range(1, 65), lambda i: CAST(a[i] AS DOUBLE) * CAST(b[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(a, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b, lambda x: CAST(x AS DOUBLE) * x))))"


@query("d14_vector_similarity", f"SELECT left_id, right_id, round({_COS}, 5) AS similarity FROM (SELECT x.vec_id AS left_id, y.vec_id AS right_id, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)")
def _(s, d):
    e = read(s, d, "embeddings")
    pairs = e.select(F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"))
    return E.pair_similarity(pairs, e, "vec_id", "embedding").select("left_id", "right_id", F.round("similarity", 5).alias("similarity"))


@query("d14_centroid_similarity", """SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a[i] AS DOUBLE) * b[i])) / (sqrt(list_sum(list_transform(a, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))), 5) AS similarity
 FROM (SELECT e.vec_id, e.embedding AS a, c.b FROM embeddings e JOIN (SELECT label, list(m ORDER BY i) AS b FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label) c USING (label))""")
def _(s, d):
    e = read(s, d, "embeddings")
    c = E.group_centroids(e, "label", "embedding")
    return e.join(c, "label").select("vec_id", F.round(E.cosine(F.col("embedding"), F.col("centroid")), 5).alias("similarity"))


@query("f9_top_features", "SELECT finding_id, name, round(value, 6) AS value FROM feature_rows WHERE section = 'language' QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY value DESC, name) <= 3")
def _(s, d):
    e = E.embed(l0(s, d)).select("finding_id", F.explode(E.top_features(F.col("language_map"), 3)).alias("name", "value"))
    return e.select("finding_id", "name", r6("value"))


_add = K.step
_LOWALG = K.cases([("lower(algorithm) IN ('md5', 'sha1', 'des', 'rc4')", "0.2e0"), ("lower(algorithm) IN ('rsa', 'ecdsa', 'ecdh')", "0.15e0"), ("lower(algorithm) IN ('aes', 'sha256')", "0.05e0")], "0e0")
_AST = K.clamp(f"confidence + {_add('crypto_words > 0', 0.2)} + {_add('in_crypto_namespace', 0.15)} + {_add('near_crypto_imports', 0.1)} + {_add('has_error_handling', 0.05)}"
               f" + {_add('has_documentation', 0.05)} + {_add('''contains(lower(path), 'test') AND NOT in_crypto_namespace''', -0.1)}", 0.0, 1.0)
_CTXB = K.clamp(f"confidence + {_add(K.TEST, -0.1)} + {_add(K.VENDORED, -0.05)} + {_LOWALG}", 0.0, 1.0)
_SEMX = f"""coalesce({_ALGW}, 0e0)"""


@query("k9_d13_enhanced_score", f"""SELECT finding_id, round(ast, 6) AS ast_boost, round(ctx, 6) AS context_boost, round({K.clamp('confidence * 0.4e0 + ast * 0.3e0 + emb * 0.2e0 + ctx * 0.1e0', 0.0, 1.0)}, 5) AS enhanced_score
 FROM (SELECT finding_id, confidence, {_AST} AS ast, {K.clamp('(confidence + crypto_score / 10e0) / 2e0', 0.0, 1.0)} AS emb, {_CTXB} AS ctx
 FROM (SELECT l.finding_id, l.path, l.confidence, l.algorithm, t.crypto_words, t.in_crypto_namespace, c.near_crypto_imports, c.has_error_handling, c.has_documentation, k.crypto_score
 FROM l0 l JOIN text_features t ON l.path = t.path JOIN context_flags c ON l.path = c.path JOIN crypto_scores k ON l.finding_id = k.finding_id))""")
def _(s, d):
    e = EN.enhance(l0(s, d), files(s, d))
    return e.select("finding_id", r6("ast_boost"), r6("context_boost"), F.round("enhanced_score", 5).alias("enhanced_score"))


@query("j13_j16_feature_vector")
def _(s, d):
    e = EN.enhance(l0(s, d), files(s, d)).withColumn("ml", EN.ml_features())
    return e.select("finding_id", F.size("feature_vector").alias("n_slots"), F.size("ml").alias("n_features"), r6(F.col("feature_vector")[1], "enhanced_score"),
                    r6(F.col("feature_vector")[30], "crypto_score"))


# --- embedded scores ---------------------------------------------------------------------

_code = lambda n, e: K.table({v: float(i) for i, v in enumerate(V.LABEL_CODES[n])}, e, 0.0)
_b = lambda c: f"CASE WHEN {c} THEN 1e0 ELSE 0e0 END"
_a, _s, _t, _g = _code("algorithm", "algorithm"), _code("severity", "severity"), _code("crypto_type", "crypto_type"), _code("language", language("scan"))
_fx = "CASE WHEN contains(path, '.') THEN regexp_extract(path, '([^.]*)$', 1) ELSE 'unknown' END"
SCORER = [_a, _s, "confidence", _t, _g, _code("rule_id", "rule_id"), "CAST(line AS DOUBLE)", _code("file_extension", _fx), "CAST(len(string_split(path, '/')) AS DOUBLE)",
          "CAST(strlen(path) AS DOUBLE)", _b("contains(lower(path), 'test')"), _b(K.has("lower(path)", ["crypto", "ssl", "tls", "hash"])), _b(r"regexp_matches(path, '\.(?:c|cpp|h|hpp)$')"),
          "CAST(strlen(match_text) AS DOUBLE)", _b("contains(match_text, '(')"), _b("contains(lower(match_text), 'import')"), _b(f"{_t} = 2"), _b(f"{_t} = 1"), _b(f"{_t} = 0"),
          _b(f"{_a} IN (4, 5, 6, 10)"), _b(f"{_a} IN (0, 1, 6, 7)"), _b(f"{_s} = 0"), _b(f"{_s} = 1"), _b(f"{_s} = 2"), _b(f"{_s} = 3"), _b(f"{_s} = 4"),
          _b(f"{_g} = 0"), _b(f"{_g} IN (1, 4, 5, 8)"), _b(f"{_g} IN (0, 5)")]
_dot = lambda ws, st=0.0: K.num(st) + "".join(f" + ({f}) * {K.num(w)}" for f, w in zip(SCORER, ws))
K.CTE["predictions"] = f"""SELECT finding_id, severity, confidence, 1e0 / (1e0 + exp(-({_dot(V.LR_COEFFICIENTS, V.LR_INTERCEPT)}))) AS score,
 CASE WHEN {_dot(V.CONFIDENCE_IMPORTANCES)} > 0.5e0 THEN 'medium' ELSE 'high' END AS confidence_class, CASE WHEN {_dot(V.SEVERITY_IMPORTANCES)} > 0.5e0 THEN 'medium' ELSE 'critical' END AS severity_class FROM l0"""


def predictions(s, d):
    return EM.embedded_predictions(EM.model_input(l0(s, d)))


@query("j8_j10_j17_embedded_scores", "SELECT finding_id, round(score, 6) AS score, confidence_class, severity_class FROM predictions")
def _(s, d):
    return predictions(s, d).select("finding_id", r6("ml_false_positive_score", "score"), F.col("ml_confidence_class").alias("confidence_class"), F.col("ml_predicted_severity").alias("severity_class"))


@query("k13_adjusted_confidence", """SELECT finding_id, round(CASE WHEN score < 0.3e0 THEN confidence * 0.5e0 WHEN score > 0.8e0 THEN least(1e0, confidence * 1.2e0) ELSE confidence END, 6) AS adjusted_confidence,
 CASE WHEN severity_class = 'critical' AND severity <> 'critical' THEN 'consider_upgrading_to_critical' ELSE '' END AS suggestion FROM predictions""")
def _(s, d):
    return EM.apply_predictions(predictions(s, d)).select("finding_id", r6("adjusted_confidence"), F.coalesce("ml_severity_suggestion", F.lit("")).alias("suggestion"))


TREE = {"feature": 0, "threshold": 0.5, "left": {"feature": 2, "threshold": 10.0, "left": {"value": 0.2}, "right": {"value": 0.4}}, "right": {"feature": 1, "threshold": 7.0, "left": {"value": 0.6}}}
STUMP = {"feature": 2, "threshold": 20.0, "left": {"value": 0.9}, "right": {"value": 0.1}}


@query("j11_j12_model_tables", """SELECT finding_id, round(t, 6) AS tree, round((t + z) / 2, 6) AS forest, round(1e0 / (1e0 + exp(-(0.1e0 + a * 0.5e0 + b * -0.2e0 + c * 0.01e0))), 6) AS linear, round(CASE WHEN t > 0 AND t < 1 THEN t ELSE 0.5e0 END, 6) AS fallback
 FROM (SELECT *, CASE WHEN a <= 0.5e0 THEN CASE WHEN c <= 10 THEN 0.2e0 ELSE 0.4e0 END WHEN b <= 7 THEN 0.6e0 ELSE 0.5e0 END AS t, CASE WHEN c <= 20 THEN 0.9e0 ELSE 0.1e0 END AS z
 FROM (SELECT finding_id, confidence AS a, """ + K.table(V.FEATURE_SEVERITY, "severity", 1.0) + """ AS b, CAST(line AS DOUBLE) AS c FROM l0))""")
def _(s, d):
    from cipherlake.functions.severity import feature_value
    f = l0(s, d).select("finding_id", F.array(F.col("confidence"), feature_value(F.col("severity")), F.col("line").cast("double")).alias("x"))
    x = F.col("x")
    t = EM.tree_score(TREE, x, 3)
    return f.select("finding_id", r6(t, "tree"), r6(EM.forest_score([TREE, STUMP], x, 3), "forest"), r6(EM.linear_score([0.5, -0.2, 0.01], 0.1, x), "linear"),
                    r6(EM.with_fallback(F.lit(0.0), t), "fallback"))


def _small_net():
    """A fixed network of two hidden units, as a function of a matrix."""
    import numpy as np

    w, b, v, c = np.array([[1.5, -0.5], [0.02, 0.25], [0.01, -0.03]]), np.array([0.1, -0.2]), np.array([0.8, -1.1]), 0.05
    return lambda rows: 1 / (1 + np.exp(-(np.maximum(rows @ w + b, 0) @ v + c)))


def registered_models():
    from cipherlake.operators import models as MD
    names = ["confidence", "severity_weight", "line"]
    return (MD.Registry().add("net", MD.batch_model("network", names, _small_net)).add("tree", MD.column_model("decision_tree", names, lambda x: EM.tree_score(TREE, x, 3)))
            .add("linear", MD.column_model("linear_regression", names, lambda x: EM.linear_score([0.5, -0.2, 0.01], 0.1, x)))
            .add("sure", MD.batch_model("constant", names, lambda: lambda rows: rows[:, 0] * 0 + 1)))


@query("x4_registered_models", """SELECT finding_id, round(net, 6) AS score_net, round(tree, 6) AS score_tree, round(linear, 6) AS score_linear, 1e0 AS score_sure, round(CASE WHEN net > 0 AND net < 1 THEN net ELSE tree END, 6) AS score, round(tree, 6) AS second
 FROM (SELECT finding_id, 1e0 / (1e0 + exp(-(0.8e0 * greatest(a * 1.5e0 + b * 0.02e0 + c * 0.01e0 + 0.1e0, 0e0) - 1.1e0 * greatest(a * -0.5e0 + b * 0.25e0 + c * -0.03e0 - 0.2e0, 0e0) + 0.05e0))) AS net,
 1e0 / (1e0 + exp(-(0.1e0 + a * 0.5e0 + b * -0.2e0 + c * 0.01e0))) AS linear, CASE WHEN a <= 0.5e0 THEN CASE WHEN c <= 10 THEN 0.2e0 ELSE 0.4e0 END WHEN b <= 7 THEN 0.6e0 ELSE 0.5e0 END AS tree
 FROM (SELECT finding_id, confidence AS a, """ + K.table(V.FEATURE_SEVERITY, "severity", 1.0) + """ AS b, CAST(line AS DOUBLE) AS c FROM l0))""")
def _(s, d):
    """A numpy model and compiled ones by name; the model that is always sure falls through to the next."""
    from cipherlake.functions.severity import feature_value
    f = l0(s, d).withColumn("severity_weight", feature_value(F.col("severity")))
    models = registered_models()
    out = models.score(models.score(f, ["net", "tree", "linear", "sure"]), ["sure", "tree"], prefix="again")
    return out.select("finding_id", *[r6(f"score_{n}") for n in ("net", "tree", "linear", "sure")], r6("score"), r6("again", "second"))


# --- models ----------------------------------------------------------------------------------

_J1 = {"algorithm": "algorithm", "severity": "severity", "confidence": "round(confidence, 6)", "crypto_type": "crypto_type", "language": "language", "rule_id": "rule_id",
       "line_number": "CAST(line AS BIGINT)", "file_extension": f"CASE WHEN contains({K.BASE}, '.') THEN regexp_extract({K.BASE}, '([^.]*)$', 1) ELSE 'unknown' END", "file_path_depth": "CAST(len(string_split(path, '/')) AS BIGINT)",
       "filename_length": f"CAST(length({K.BASE}) AS BIGINT)", "is_test_file": "contains(lower(path), 'test')", "is_crypto_library": K.has("lower(path)", ["crypto", "ssl", "tls", "hash"]),
       "is_low_level": r"regexp_matches(path, '\.(?:c|cpp|h|hpp)$')", "pattern_complexity": "CAST(length(match_text) AS BIGINT)", "has_function_call": "contains(match_text, '(')",
       "has_import_statement": "contains(lower(match_text), 'import')", **{f"is_{t}_{'crypto' if t != 'hash' else 'algorithm'}": f"crypto_type = '{t}'" for t in ("hash", "symmetric", "asymmetric")},
       "is_legacy_algorithm": "algorithm IN ('md5', 'sha1', 'des', 'rc4')", "is_modern_algorithm": "algorithm IN ('sha256', 'sha512', 'aes', 'chacha20')",
       **{f"is_{v}": f"severity = '{v}'" for v in ("critical", "high", "medium", "low", "info")},
       "is_c_cpp": "language IN ('c', 'cpp', 'c++')", "is_high_level_lang": "language IN ('python', 'java', 'javascript', 'go')", "is_systems_lang": "language IN ('c', 'cpp', 'rust', 'go')"}
_COUNTS = ("line_number", "file_path_depth", "filename_length", "pattern_complexity")
K.CTE["j1_features"] = f"SELECT finding_id, {', '.join(f'{e} AS {n}' for n, e in _J1.items())} FROM l0"


def training_features(s, d, findings=None):
    """Features with the matched text as the pattern, which findings of the first stage don't carry."""
    return TR.training_features((l0(s, d) if findings is None else findings).withColumn("pattern", F.col("match_text")))


@query("j1_j15_training_features", "SELECT * FROM j1_features")
def _(s, d):
    f = training_features(s, d)
    assert sorted(TR.feature_columns(f)) == sorted(_J1)
    return f.select("finding_id", *[n64(c) if c in _COUNTS else r6(c) if c == "confidence" else F.col(c) for c in _J1])


K.CTE["j2_labels"] = "\nUNION ALL ".join(f"SELECT '{c}' AS col, label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS code, CAST(n AS BIGINT) AS n FROM (SELECT {c} AS label, count(*) AS n FROM j1_features GROUP BY 1)" for c in TR.CATEGORICAL)


@query("j2_label_table", 'SELECT col AS "column", label, code, n FROM j2_labels')
def _(s, d):
    return TR.fit_encoder(training_features(s, d))


@query("j2_label_codes", "SELECT finding_id, " + ", ".join(f"CAST((SELECT code FROM j2_labels WHERE col = '{c}' AND label = f.{c}) AS DOUBLE) AS {c}_code" for c in TR.CATEGORICAL) + " FROM j1_features f")
def _(s, d):
    f = training_features(s, d)
    return TR.encode(f, TR.fit_encoder(f)).select("finding_id", *[f"{c}_code" for c in TR.CATEGORICAL])


@query("j2_unseen_labels", "SELECT finding_id, " + ", ".join(f"CAST(coalesce((SELECT code FROM (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT {c} AS label FROM j1_features WHERE line_number % 2 = 0)) t WHERE t.label = f.{c}), 0) AS DOUBLE) AS {c}_code" for c in TR.CATEGORICAL) + " FROM j1_features f")
def _(s, d):
    """Codes from half of the lines, joined without a broadcast; labels outside that half are 0."""
    from cipherlake.operators import encoding as EC
    f = checkpoint(training_features(s, d))
    labels = EC.fit_labels(f.filter("line_number % 2 = 0"), TR.CATEGORICAL)
    return EC.encode_labels(f, labels, TR.CATEGORICAL, broadcast_rows=-1).select("finding_id", *[f"{c}_code" for c in TR.CATEGORICAL])


K.CTE["j3_split"] = """SELECT finding_id, severity, row_number() OVER (PARTITION BY severity ORDER BY md5(finding_id || ':42'), finding_id) <= floor(count(*) OVER (PARTITION BY severity) * 0.2e0 + 0.5e0) AS is_test
 FROM labelled WHERE has_ai_evaluation"""


@query("j3_stratified_split", "SELECT finding_id, severity, is_test FROM j3_split")
def _(s, d):
    from cipherlake.operators import splitting as SP
    return SP.stratified(labelled(s, d).filter("has_ai_evaluation"), "severity", "finding_id").select("finding_id", "severity", "is_test")


@query("j3_split_shares", "SELECT severity, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE is_test) AS BIGINT) AS n_test, abs(count(*) FILTER (WHERE is_test) - count(*) * 0.2e0) < 1 AS within_one FROM j3_split GROUP BY severity")
def _(s, d):
    from cipherlake.operators import splitting as SP
    rows = SP.stratified(labelled(s, d).filter("has_ai_evaluation"), "severity", "finding_id").groupBy("severity").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))
    return rows.withColumn("within_one", F.abs(F.col("n_test") - F.col("n") * 0.2) < 1)


_P, _R, _N = "coalesce(tp / nullif(predicted, 0), 0)", "coalesce(tp / nullif(support, 0), 0)", "coalesce(2 * p * r / nullif(p + r, 0), 0)"


@query("j6_class_metrics", f"""SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round({_N}, 6) AS f1, support FROM (SELECT *, {_P} AS p, {_R} AS r FROM (
 SELECT label, CAST(sum(t) AS BIGINT) AS support, sum(g) AS predicted, sum(h) AS tp FROM (
  SELECT severity AS label, 1 AS t, 0 AS g, CAST(severity = severity_class AS INT) AS h FROM predictions UNION ALL SELECT severity_class, 0, 1, 0 FROM predictions) GROUP BY label))""")
def _(s, d):
    """Of the embedded severity scorer against the rules' severities."""
    pairs = predictions(s, d).select(F.col("severity").alias("label"), F.col("ml_predicted_severity").alias("prediction"))
    m = TR.class_metrics(TR.confusion(pairs))
    return m.select("label", r6("precision"), r6("recall"), r6("f1"), n64("support"))


@query("j14_labelled_coverage", "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE has_ai_evaluation) AS BIGINT) AS evaluated, round(count(*) FILTER (WHERE has_ai_evaluation) / count(*), 6) AS coverage FROM labelled")
def _(s, d):
    seq = EV.with_sequence(stored_l0(s, d))
    return EV.coverage(EV.join_evaluations(seq, evaluations(seq))).select("total", "evaluated", r6("coverage"))


def _encoded(s, d):
    seq = checkpoint(EV.with_sequence(stored_l0(s, d)))
    f = training_features(s, d, EV.join_evaluations(seq, evaluations(seq)))
    return checkpoint(TR.encode(f, TR.fit_encoder(f.filter("has_ai_evaluation"))))


@query("j3_j6_j7_validity_model")
def _(s, d):
    enc = _encoded(s, d)
    res = TR.train_validity_model(enc)
    return TR.predict(enc, res["model"]).groupBy("is_false_positive").agg(F.count("*").alias("n"), r6(F.avg("false_positive_confidence"), "certainty"))


@query("j4_j5_forest_models")
def _(s, d):
    enc = _encoded(s, d)
    a = TR.train_confidence_model(enc)
    b = TR.train_severity_model(enc)
    return TR.report_rows(s, [a, b])


# --- jobs ---------------------------------------------------------------------------------------

K.CTE["layered_rows"] = f"""
SELECT path, line, rule_id, context, severity, algorithm, stage FROM l0_lay UNION ALL SELECT path, line, rule_id, context, severity, algorithm, stage FROM l1
UNION ALL SELECT path, sink_line, rule_id, 'Flow: ' || source_text || ' -> ' || sink_text, severity, 'TAINT_ANALYSIS', 'L2' FROM violations WHERE path IN (SELECT path FROM gate)"""
K.CTE["layered_usable"] = f"SELECT *, 0e0 AS confidence FROM layered_rows WHERE ({K.SKIP}) IS NULL"
K.CTE["layered_scored"] = K.scored("layered_usable")


@query("p1_layered_scan", """SELECT stage, severity, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 6) AS mean_confidence FROM layered_scored f WHERE NOT EXISTS (
 SELECT 1 FROM marks m WHERE m.path = f.path AND (m.rule_id = '*' OR m.rule_id = f.rule_id) AND (m.scope = 'file' OR (m.scope = 'line' AND f.line = m.line)
 OR (m.scope = 'block' AND f.line BETWEEN m.line AND m.line + 10))) GROUP BY ALL""")
def _(s, d):
    out = J.layered_scan(lay_files(s, d), reuse=True)
    return out["findings"].groupBy("stage", "severity").agg(F.count("*").alias("n"), r6(F.avg("confidence"), "mean_confidence"))


K.CTE["all_unique"] = K.CTE["base_unique"].replace("FROM base", "FROM (FROM base UNION ALL BY NAME FROM structural)")
K.CTE["all_adjusted"] = K.CTE["library_adjusted"].replace("base_unique", "all_unique")
K.CTE["all_classified"] = K.classified("all_adjusted")


@query("p2_s12_base_scan", """SELECT rule_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE sev IN ('critical', 'high')) AS BIGINT) AS n_high FROM (SELECT rule_id, CASE WHEN rule_id IN """ + K.inlist(V.CONTEXT_AWARE_RULES) + """ THEN severity ELSE cls_severity END AS sev
 FROM all_classified WHERE NOT """ + K.ignored("base") + """ AND NOT """ + K.BINARY_NAME + """) GROUP BY rule_id""")
def _(s, d):
    out = J.base_scan(C.file_context(C.code_files(s, d), "base"))["findings"]
    return out.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin("critical", "high")).alias("n_high"))


K_P5 = f"""SELECT finding_id, round({K.clamp('confidence * 0.4e0 + ast * 0.3e0 + emb * 0.2e0 + ctx * 0.1e0', 0.0, 1.0)}, 6) AS enhanced_score, round(crypto_score, 6) AS crypto_score
 FROM (SELECT finding_id, confidence, crypto_score, {_AST} AS ast, {K.clamp('(confidence + crypto_score / 10e0) / 2e0', 0.0, 1.0)} AS emb, {_CTXB} AS ctx
 FROM (SELECT l.finding_id, l.path, l.confidence, l.algorithm, t.crypto_words, t.in_crypto_namespace, c.near_crypto_imports, c.has_error_handling, c.has_documentation, k.crypto_score
 FROM l0 l JOIN text_features t ON l.path = t.path JOIN context_flags c ON l.path = c.path JOIN crypto_scores k ON l.finding_id = k.finding_id))"""


@query("p3_combined_scan")
def _(s, d):
    return J.combined_scan(files(s, d), Q.dependency_reports(s, d), reuse=True)["vulnerability_summary"]


@query("p5_enhanced_findings", K_P5)
def _(s, d):
    return J.enhanced_findings(l0(s, d), files(s, d)).select("finding_id", r6("enhanced_score"), r6("crypto_score"))


@query("p6_scored_layered_scan")
def _(s, d):
    out = J.scored_layered_scan(lay_files(s, d), reuse=True)
    return out.groupBy("ml_predicted_severity").agg(F.count("*").alias("n"), r6(F.avg("adjusted_confidence"), "mean_confidence"))


@query("p8_fleet_analysis", "SELECT CAST(count(DISTINCT repo) AS BIGINT) AS repos_processed, CAST(count(DISTINCT repo) FILTER (WHERE p_partkey % 7 NOT IN (0, 4)) AS BIGINT) AS repos_with_findings, CAST(2 * count(*) FILTER (WHERE p_partkey % 7 NOT IN (0, 4)) AS BIGINT) AS total_findings FROM (SELECT *, p_partkey % 20 AS repo FROM part)")
def _(s, d):
    from cipherlake.sources import results as RS
    docs = Q.result_docs(s, d)
    good, _bad = RS.split_corrupt(docs)
    found = RS.parse_findings(good).withColumnsRenamed({"file": "path", "id": "finding_id"})
    return J.fleet_analysis(found.fillna("unknown", ["crypto_type", "language"]), docs)["totals"].select("repos_processed", "repos_with_findings", n64("total_findings"))


@query("p9_evaluation_run", f"SELECT CAST(count(*) AS BIGINT) AS n_selected, CAST(count(DISTINCT (seq // 20)) AS BIGINT) AS n_batches FROM (SELECT row_number() OVER () - 1 AS seq FROM (SELECT finding_id FROM l0 WHERE confidence >= 0.5e0 ORDER BY {K.PRIORITY_KEYS} LIMIT 1000))")
def _(s, d):
    out = J.evaluation_run(l0(s, d), 0.5, 1000, 20)["batches"]
    return out.agg(F.count("*").alias("n_selected"), F.count_distinct("batch_id").alias("n_batches"))


# --- streams: run to the end of the available input, then give the result ------------------------

def _drain(df, mode: str = "append"):
    """Run a streaming frame over what is there and read the result back."""
    out = scratch(df.sparkSession)
    (df.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data").option("checkpointLocation", f"{out}/log")
     .trigger(availableNow=True).start().awaitTermination())
    return df.sparkSession.read.schema(df.schema).parquet(f"{out}/data")


_DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
_EV = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _event_findings(ev):
    """Events as findings: a time, a severity and a confidence."""
    u = F.col("user_id")
    sev = F.when(u % 4 == 0, "critical").when(u % 4 == 1, "high").when(u % 4 == 2, "medium").otherwise("info")
    return ev.select("ts", F.concat(F.lit("repo/f"), u.cast("string")).alias("path"), (F.col("event_id") % 50).cast("int").alias("line"), F.concat(F.lit("r-"), F.col("event_type")).alias("rule_id"),
                     sev.alias("severity"), (F.col("event_id") % 100 / 100.0).alias("risk"), F.element_at(F.create_map(*[F.lit(x) for kv in V.RISK_VALUE.items() for x in kv]), sev).alias("risk_weight"))


K.CTE["event_findings"] = """SELECT ts, 'repo/f' || CAST(user_id AS VARCHAR) AS path, event_id % 50 AS line, 'r-' || event_type AS rule_id, (event_id % 100) / 100e0 AS risk,
 CASE user_id % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 0.6e0 ELSE 0.2e0 END AS risk_weight FROM events"""


@query("t1_stream_scan", """SELECT path, rule_id, CAST(count(DISTINCT line) AS BIGINT) AS n_lines FROM secrets GROUP BY ALL""")
def _(s, d):
    raw = ST.stream_table(s, f"{d}/documents.parque[t]", _DOC)
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".dat")))
    f = raw.select(path.alias("path"), F.col("source").alias("repo"), F.lit("").alias("language"), F.col("text").alias("content"))
    out = scratch(s)
    ST.scan_each_batch(f, f"{out}/data", f"{out}/log", lambda b: SC.l0_scan(b, Q.SECRET_RULES, min_confidence=0.0)).awaitTermination()
    return s.read.parquet(f"{out}/data").groupBy("path", "rule_id").agg(F.count_distinct("line").alias("n_lines"))


@query("t2_stream_suppression", "SELECT path, CAST(line AS BIGINT) AS line, rule_id FROM event_findings WHERE NOT (rule_id = 'r-click' AND line = 3) AND rule_id <> 'r-error'")
def _(s, d):
    ev = _event_findings(ST.stream_table(s, f"{d}/events.parque[t]", _EV))
    b = read(s, d, "events").filter(F.col("event_type") == "error").select(F.lit("r-error").alias("rule_id"), F.lit("").alias("file"), F.lit(0).alias("line"), F.lit("").alias("expires")).distinct()
    b = b.unionByName(read(s, d, "events").filter(F.col("event_type") == "click").select(F.lit("r-click").alias("rule_id"), F.lit("").alias("file"), F.lit(3).alias("line"), F.lit("").alias("expires")).distinct())
    out = scratch(s)
    ST.suppress_each_batch(ev, b, as_of(), f"{out}/data", f"{out}/log").awaitTermination()
    return s.read.parquet(f"{out}/data").select("path", n64("line"), "rule_id")


@query("t3_stream_dedupe", "SELECT DISTINCT path, CAST(line AS BIGINT) AS line, rule_id FROM event_findings")
def _(s, d):
    ev = _event_findings(ST.stream_table(s, f"{d}/events.parque[t]", _EV))
    return _drain(ST.dedupe(ev, "ts", "1 hour").select("path", n64("line"), "rule_id"))


@query("t4_risk_windows", f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, round({K.OVERALL}, 6) AS overall_risk, CAST(count(*) AS BIGINT) AS n_findings FROM event_findings GROUP BY 1")
def _(s, d):
    ev = _event_findings(read(s, d, "events"))
    return ST.risk_windows(ev, "ts", "1 day").select("window_start", r6("overall_risk"), "n_findings")


@query("t4_stream_risk_windows", f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, round({K.OVERALL}, 6) AS overall_risk, CAST(count(*) AS BIGINT) AS n_findings FROM event_findings GROUP BY 1 HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def _(s, d):
    ev = _event_findings(ST.stream_table(s, f"{d}/events.parque[t]", _EV))
    return _drain(ST.risk_windows(ev, "ts", "1 day").select("window_start", r6("overall_risk"), "n_findings"))


@query("t5_running_totals", "SELECT user_id % 2 = 0 AS is_valid, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean_confidence FROM events GROUP BY 1")
def _(s, d):
    ev = ST.stream_table(s, f"{d}/events.parque[t]", _EV).select((F.col("user_id") % 2 == 0).alias("is_valid"), F.col("value").alias("confidence"))
    out = scratch(s)
    ST.totals_each_batch(ev, f"{out}/data", f"{out}/log").awaitTermination()
    rows = s.read.parquet(f"{out}/data")
    return rows.filter(F.col("batch_id") == rows.agg(F.max("batch_id").alias("last")).scalar()).select("is_valid", "n", r6("mean_confidence"))


# --- SQL surface ---------------------------------------------------------------------------------

@query("x7_scan_text_function", "SELECT source, rule_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT repo AS source, rule_id FROM doc_hits) GROUP BY ALL")
def _(s, d):
    from cipherlake.functions import table_functions as TF
    TF.register(s)
    C.document_files(s, d).select("repo", F.concat(F.lit("cipher = aes.new(rsa) // "), F.col("content")).alias("content")).createOrReplaceTempView("cipherlake_texts")
    return s.sql("SELECT t.repo AS source, h.rule_id, count(*) AS n FROM cipherlake_texts t, LATERAL scan_text(t.content, 'a.go', 'go') h GROUP BY 1, 2")


from cipherlake.operators.rules import l0_rules  # noqa: E402

_X7 = [r for r in l0_rules() if not r.languages or "*" in r.languages or "go" in r.languages]
K.CTE["doc_hits"] = " UNION ALL ".join(f"SELECT repo, {K.q(r.rule_id)} AS rule_id, unnest(regexp_extract_all('cipher = aes.new(rsa) // ' || content, {K.q(r.pattern)})) AS m FROM document_files" for r in _X7)
Q.ORACLE["x7_scan_text_function"] = K.sql("SELECT source, rule_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT repo AS source, rule_id FROM doc_hits) GROUP BY ALL")


@query("x8_sql_risk_function", f"SELECT repo, round({K.OVERALL}, 6) AS overall_risk FROM risk GROUP BY repo")
def _(s, d):
    RK.register_sql_functions(s)
    risk(s, d).createOrReplaceTempView("cipherlake_risk")
    out = s.sql("SELECT repo, overall_risk_score(sum(risk * risk_weight), sum(risk_weight), count(*)) AS overall_risk FROM cipherlake_risk GROUP BY repo")
    return out.select("repo", r6("overall_risk"))


@query("x2_custom_context_feature", "SELECT finding_id, CASE WHEN contains(context, 'rand') THEN 1e0 ELSE 0e0 END AS feature_random_source FROM l0")
def _(s, d):
    feats = {**CS.FEATURES, "random_source": (0.05, lambda r: F.when(r["context"].contains("rand"), 1.0).otherwise(0.0))}
    return CS.score_findings(l0(s, d), features=feats).select("finding_id", "feature_random_source")
