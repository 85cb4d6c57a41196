"""Structural stage (L1) and hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.functions.text import first_match, java_pattern
from cipherlake.operators.scan import cut_texts, match_positions, with_identity


def _l1_rules() -> list[dict]:
    """One entry per (language pattern, regular expression) with its finding attributes."""
    out = []
    for pid, lang, category, severity, intent in V.L1_PATTERNS:
        base = {"pattern_id": pid, "language": lang, "category": category, "intent": intent}
        if intent == "detect_weak_rsa_generation":
            out += [dict(base, rule_id=pid, algorithm="RSA", regex=p, sized=True) for p in V.L1_KEY_SIZE_PATTERNS]
        elif intent == "detect_quantum_vulnerable_keygen":
            out += [dict(base, rule_id=f"{pid}-{a.lower()}", algorithm=a, regex=p, severity="high", confidence=0.9)
                    for a, p in V.L1_KEYGEN_PATTERNS.items()]
        elif intent == "detect_weak_hash_usage":
            out += [dict(base, rule_id=f"{pid}-{a.lower()}", algorithm=a, regex=p, severity="critical",
                         confidence=0.95, code_only=True) for a, p in V.L1_HASH_PATTERNS.items()]
        else:
            out.append(dict(base, rule_id=pid, algorithm="", regex=V.L1_JAVA_PATTERN, severity="high",
                            confidence=0.9))
    return out


def key_size_severity(size: Column) -> Column:
    return first_match([(size.isin("512", "1024"), "critical"), (size == "2048", "medium")], "low")


def intent_message(intent: Column, algorithm: Column, size: Column) -> Column:
    """Message by intent; a key size is named when there is one."""
    sized = F.format_string("RSA key generation with key size %s bits: use 2048 bits or more, or move to ML-KEM", size)
    return first_match([
        ((intent == "detect_weak_rsa_generation") & (size != ""), sized),
        (intent == "detect_weak_rsa_generation", F.lit("RSA key generation: consider a post-quantum scheme")),
        (intent == "detect_weak_hash_usage", F.concat(algorithm, F.lit(" hash usage: cryptographically broken")))],
        F.concat(algorithm, F.lit(" key generation: vulnerable to quantum attacks")))


def l1_scan(files: DataFrame, l0_paths: DataFrame | None = None) -> DataFrame:
    """Structural findings of files that had a first-stage hit.  Patterns apply by language; the
    matched text gives the key size, the line and column are those of the match."""
    rules = _l1_rules()
    hits = []
    for i, r in enumerate(rules, 1):
        regex = java_pattern(r["regex"])
        hits.append((i, str(i), regex, F.col("language") == r["language"]))
    found = match_positions(cut_texts(files, hits)).withColumn("hit", F.col("ordinal"))
    if l0_paths is not None:  # the short rows meet the paths; the texts stay where they are
        found = found.join(l0_paths.select("path").distinct(), "path", "left_semi")
    pick = lambda key, default: F.element_at(F.array(*[F.lit(r.get(key, default)) for r in rules]), F.col("hit"))
    size_group = F.regexp_extract("match_text", r"(\d+)$", 1)
    java_alg = F.regexp_extract("match_text", V.L1_JAVA_PATTERN, 1)
    size = F.when(pick("sized", False), size_group).otherwise(F.lit(""))
    call = F.col("match_text").contains("(") & F.col("match_text").contains(")")
    out = found.withColumns({
        "key_size_text": size, "intent": pick("intent", ""), "pattern_id": pick("pattern_id", ""),
        "algorithm": F.when(pick("algorithm", "") != "", pick("algorithm", "")).otherwise(
            F.when(java_alg == "EC", F.lit("ECDSA")).otherwise(java_alg)),
        "crypto_type": pick("category", ""), "code_only": pick("code_only", False),
        "given_severity": pick("severity", ""), "given_confidence": pick("confidence", 0.0),
        "rule_id": pick("rule_id", "")})
    low = F.lower("match_text")
    out = out.filter(~(F.col("code_only") & (low.contains("//") | low.contains("/*"))))
    out = out.withColumns({
        "severity": F.when(F.col("given_severity") != "", F.col("given_severity")).otherwise(key_size_severity(F.col("key_size_text"))),
        "confidence": F.when(F.col("given_confidence") > 0, F.col("given_confidence"))
        .otherwise(F.lit(0.7) + F.when(call, F.lit(0.2)).otherwise(F.lit(0.0))),
        "message": intent_message(F.col("intent"), F.col("algorithm"), F.col("key_size_text")),
        "key_size": F.coalesce(F.col("key_size_text").try_cast("int"), F.lit(0)), "stage": F.lit("L1"),
        "suggestion": F.lit(""), "priority": F.lit(1)})
    return with_identity(out.drop("hit", "ordinal", "block", "idx", "code_only", "given_severity", "given_confidence",
                                  "key_size_text"))


def hotspots(findings: DataFrame, gap: int = V.HOTSPOT_LINES) -> DataFrame:
    """Runs of findings at most ``gap`` lines apart within a file: where a run starts, its most
    common type (ties alphabetically) and its mean confidence.  A window per file; the size limit
    on scanned files bounds it."""
    w = Window.partitionBy("path").orderBy("line", "col", "rule_id", "finding_id")
    starts = F.when(F.col("line") - F.lag("line").over(w) > gap, 1).otherwise(0)
    run = findings.withColumn("starts", starts).withColumn("island", F.sum("starts").over(w))
    by_type = run.groupBy("path", "island", "crypto_type").agg(
        F.count("*").alias("n"), F.min(F.struct("line", "col")).alias("first"), F.max("line").alias("last_line"),
        F.sum("confidence").alias("conf_sum"))
    return (by_type.groupBy("path", "island").agg(
        F.min("first").alias("first"), F.max("last_line").alias("last_line"), F.sum("n").alias("n_findings"),
        F.min_by("crypto_type", F.struct(-F.col("n"), F.col("crypto_type"))).alias("hotspot_type"),
        F.sum("conf_sum").alias("conf_sum"))
        .select("path", "island", F.col("first.line").alias("line"), F.col("first.col").alias("col"), "last_line",
                "n_findings", "hotspot_type", (F.col("conf_sum") / F.col("n_findings")).alias("confidence")))


def high_confidence_files(l1: DataFrame, floor: float = 0.8, at_least: int = 2) -> DataFrame:
    """Files that pass the gate to the flow stage."""
    strong = F.col("severity").isin("critical", "high") & (F.col("confidence") > floor)
    return l1.groupBy("path").agg(F.count_if(strong).alias("n_strong")).filter(F.col("n_strong") >= at_least)
