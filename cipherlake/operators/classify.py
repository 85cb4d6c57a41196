"""Classification: algorithm, type, parameters, confidence, severity, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.functions.text import dimension, first_match, has_any, lookup

VULNERABILITY_DDL = ("algorithm string, cves array<string>, quantum_threat string, classical_threat string,"
                     " break_year string, deprecated_since string")
MIGRATION_DDL = "algorithm string, recommended array<string>, hybrid array<string>, timeline string, effort string"
PERFORMANCE_DDL = "replacement string, keygen_slowdown string, operation_slowdown string, size_increase string"


def vulnerability_table(spark: SparkSession) -> DataFrame:
    return dimension(spark, V.VULNERABILITIES, VULNERABILITY_DDL)


def migration_table(spark: SparkSession) -> DataFrame:
    return dimension(spark, V.MIGRATIONS, MIGRATION_DDL)


def performance_table(spark: SparkSession) -> DataFrame:
    return dimension(spark, V.PERFORMANCE, PERFORMANCE_DDL)


def best_algorithm(algorithm: Column, context: Column) -> Column:
    """The given algorithm, else the pattern of highest confidence (ties alphabetically)."""
    order = sorted(V.ALGORITHM_PATTERNS.items(), key=lambda kv: (-kv[1][1], kv[0]))
    low = F.lower(context)
    found = first_match([(low.rlike("|".join(p[0])), name) for name, p in order], "")
    return F.when(algorithm != "", algorithm).otherwise(found)


def crypto_type(algorithm: Column, context: Column) -> Column:
    """Type of a known algorithm, else the first operation word in the context."""
    up, low = F.upper(algorithm), F.lower(context)
    known = [(up == name, p[2]) for name, p in V.ALGORITHM_PATTERNS.items()]
    words = [(low.rlike(pattern), name) for pattern, name in V.CRYPTO_TYPE_PATTERNS]
    return first_match(known + words, "unknown")


def parameters(context: Column) -> Column:
    """Map of the parameters found: key size, curve, iterations, hash algorithm."""
    pairs = [x for name, pattern in V.PARAMETER_PATTERNS.items()
             for x in (F.lit(name), F.regexp_extract(context, pattern, 1))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v != "")


def key_size(params: Column, strict: bool = False) -> Column:
    """Key size as a number; ``strict`` accepts 2048 and 4096 only."""
    raw = F.coalesce(F.element_at(params, "key_size").try_cast("int"), F.lit(0))
    return F.when(raw.isin(2048, 4096), raw).otherwise(F.lit(0)) if strict else raw


def context_quality(context: Column) -> Column:
    low = F.lower(context)
    scores = [F.when(low.rlike(p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in V.CONTEXT_QUALITY_PATTERNS.items()]
    return F.when(context == "", F.lit(0.3)).otherwise(F.greatest(F.lit(0.5), *scores))


def path_quality(path: Column) -> Column:
    low = F.lower(path)
    return first_match([(has_any(low, ["crypto", "security"]), 0.9), (has_any(low, ["test", "example"]), 0.4),
                        (has_any(low, ["vendor", "node_modules"]), 0.2)], 0.6)


def message_quality(message: Column) -> Column:
    low = F.lower(message)
    return first_match([(message == "", 0.3), (has_any(low, V.MESSAGE_TERMS), 0.7)], 0.5)


def severity_of(algorithm: Column, size: Column) -> Column:
    """Vulnerability table first (critical threats, then high ones), then algorithm rules."""
    up = F.upper(algorithm)
    def threat(level):
        return [r["algorithm"] for r in V.VULNERABILITIES if level in (r["quantum_threat"], r["classical_threat"])]
    return first_match([
        (up.isin(threat("critical")), "critical"), (up.isin(threat("high")), "high"),
        (up.isin("MD5", "SHA1", "DES", "RC4"), "critical"),
        ((up == "RSA") & (size > 0) & (size < 2048), "critical"), (up == "RSA", "high"),
        (up.isin("ECDSA", "ECDH", "DSA"), "high"),
        ((up == "AES") & (size > 0) & (size < 128), "high"), (up == "AES", "info")], "medium")


def quantum_vulnerable(algorithm: Column) -> Column:
    up = F.upper(algorithm)
    known = [(up == name, not p[4]) for name, p in V.ALGORITHM_PATTERNS.items()]
    return first_match(known, has_any(up, V.QUANTUM_VULNERABLE_PARTS))


def deprecated(algorithm: Column) -> Column:
    up = F.upper(algorithm)
    known = [(up == name, p[3]) for name, p in V.ALGORITHM_PATTERNS.items()]
    return first_match(known, has_any(up, V.DEPRECATED_PARTS))


def classify(findings: DataFrame, strict_key_sizes: bool = False) -> DataFrame:
    """Add the classification columns (prefix ``cls_``)."""
    alg, ctx = F.col("cls_algorithm"), F.col("context")
    known = lookup({n: p[1] for n, p in V.ALGORITHM_PATTERNS.items()}, F.upper(alg), 0.5)
    w = V.CLASSIFIER_WEIGHTS
    parts = [known, context_quality(ctx), path_quality(F.col("path")),
             F.least(F.lit(1.0), F.size("cls_parameters") / 4.0), message_quality(F.col("message"))]
    total = parts[0] * w[0]
    for part, weight in zip(parts[1:], w[1:]):
        total = total + part * weight
    return (findings
            .withColumn("cls_algorithm", best_algorithm(F.col("algorithm"), ctx))
            .withColumns({"cls_type": crypto_type(alg, ctx), "cls_parameters": parameters(ctx)})
            .withColumns({"cls_key_size": key_size(F.col("cls_parameters"), strict_key_sizes),
                          "cls_confidence": total / sum(w)})
            .withColumns({"cls_severity": severity_of(alg, F.col("cls_key_size")),
                          "cls_quantum_vulnerable": quantum_vulnerable(alg), "cls_deprecated": deprecated(alg)}))


def apply_classification(findings: DataFrame) -> DataFrame:
    """Take over severity and confidence, except for rules that judge their own context."""
    own = F.col("rule_id").isin(V.CONTEXT_AWARE_RULES)
    out = classify(findings)
    return out.withColumns({
        "severity": F.when(own, F.col("severity")).otherwise(F.col("cls_severity")),
        "confidence": F.when(own, F.col("confidence")).otherwise(F.col("cls_confidence"))})


def with_vulnerability(findings: DataFrame, algorithm: str = "cls_algorithm") -> DataFrame:
    dim = vulnerability_table(findings.sparkSession).withColumnRenamed("algorithm", "_key")
    return findings.join(F.broadcast(dim), F.upper(algorithm) == F.col("_key"), "left").drop("_key")


def with_migration(findings: DataFrame, algorithm: str = "cls_algorithm") -> DataFrame:
    """Migration path, and the cost of its first recommendation."""
    spark = findings.sparkSession
    dim = migration_table(spark).withColumnRenamed("algorithm", "_key")
    perf = performance_table(spark)
    out = findings.join(F.broadcast(dim), F.upper(algorithm) == F.col("_key"), "left").drop("_key")
    out = out.join(F.broadcast(perf), F.get("recommended", F.lit(0)) == F.col("replacement"), "left").drop("replacement")
    return out.withColumn("recommended_text", F.array_join("recommended", ", "))


def classification_summary(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count("*").alias("total_findings"),
        F.count_if("cls_quantum_vulnerable").alias("quantum_vulnerable"),
        F.count_if("cls_deprecated").alias("deprecated"),
        F.count_if(F.col("cls_severity").isin("critical", "high")).alias("high_severity"))


def basic_algorithm(context: Column) -> Column:
    low = F.lower(context)
    return first_match([(has_any(low, words), name) for name, words in V.BASIC_ALGORITHMS.items()], "")


def _severity_by_algorithm(f: dict[str, Column]) -> Column:
    low = F.lower(f["algorithm"])
    return first_match([(has_any(low, ["md5", "sha1"]), "high"), (has_any(low, ["des", "rc4"]), "critical")], "medium")


def _severity_by_key_size(f: dict[str, Column]) -> Column:
    size = f["key_size"]
    return first_match([((size > 0) & (size < 128), "critical"), ((size > 0) & (size < 256), "high")], "medium")


def _severity_by_type(f: dict[str, Column]) -> Column:
    return lookup({"asymmetric": "high", "symmetric": "medium", "hash": "low"}, F.lower(f["crypto_type"]), "info")


# Severity rules by name, tried in alphabetical order; register more with ``register_severity_rule``.
SEVERITY_RULES = {"algorithm": _severity_by_algorithm, "crypto_type": _severity_by_type,
                  "key_size": _severity_by_key_size}


def register_severity_rule(name: str, rule) -> None:
    """``rule`` takes the finding's columns by name and returns a severity Column ('' or null = no say)."""
    SEVERITY_RULES[name] = rule


def basic_classify(findings: DataFrame, severity_rules: dict | None = None) -> DataFrame:
    """Fill algorithm, severity and type where they are empty; add the basic confidence."""
    rules = SEVERITY_RULES if severity_rules is None else severity_rules
    filled = findings.withColumn("algorithm", F.when(F.col("algorithm") == "", basic_algorithm(F.col("context")))
                                 .otherwise(F.col("algorithm")))
    cols = {c: F.col(c) for c in ("algorithm", "key_size", "crypto_type")}
    votes = [F.nullif(rules[name](cols), F.lit("")) for name in sorted(rules)]
    filled = filled.withColumn("severity", F.when(F.col("severity") == "", F.coalesce(*votes, F.lit("medium")))
                               .otherwise(F.col("severity")))
    low = F.lower("algorithm")
    kind = first_match([(has_any(low, words), name) for words, name in V.BASIC_TYPE_PARTS], "unknown")
    return filled.withColumns({
        "crypto_type": F.when(F.col("crypto_type") == "", kind).otherwise(F.col("crypto_type")),
        "basic_confidence": F.when(F.col("algorithm") != "", 0.4).otherwise(0.0)
        + F.when(F.col("key_size") > 0, 0.3).otherwise(0.0) + F.when(F.col("context") != "", 0.3).otherwise(0.0)})
