"""Summaries and report rows (tables, not layout)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.functions.text import first_match
from cipherlake.operators import risk as RK


def counts_by(findings: DataFrame, *dims: str) -> DataFrame:
    """Counts per value of every dimension and the total, in one pass (grouping sets)."""
    rows = F.array(F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value")),
                   *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])
    return findings.select(F.inline(rows)).groupBy("dimension", "value").agg(F.count("*").alias("n_findings"))


def scan_summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files, findings, counts as maps, risk score.  Aggregates twice, so only one row
    per severity and type is ever collected into a map."""
    per = counts_by(findings, "severity", "crypto_type")
    as_map = lambda d: F.map_from_entries(F.array_sort(F.collect_list(
        F.when(F.col("dimension") == d, F.struct("value", "n_findings")))))
    maps = per.agg(as_map("severity").alias("by_severity"), as_map("crypto_type").alias("by_type"))
    score = RK.summary_risk(findings)
    n_files = files.agg(F.count("*").alias("total_files"))
    return maps.withColumns({
        "total_files": n_files.scalar(), "total_findings": score.select("total_findings").scalar(),
        "risk_score": score.select("risk_score").scalar()})


def sarif_level(severity: Column, variant: str = "cli") -> Column:
    low = F.lower(severity)
    return first_match([(low.isin("critical", "high"), "error"), (low == "medium", "warning"),
                        (low.isin("low", "info"), "note")], "note" if variant == "cli" else "warning")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Rules in order of first appearance (path, line, column, rule).  The first finding of a rule is
    found by partial aggregation; the index runs over one row per rule."""
    first = findings.groupBy("rule_id").agg(
        F.min_by(F.struct("message", "severity", "suggestion"), F.struct("path", "line", "col", "finding_id")).alias("f"),
        F.min(F.struct("path", "line", "col", "rule_id")).alias("seq"))
    w = Window.orderBy("seq")  # one row per rule
    return first.select("rule_id", (F.row_number().over(w) - 1).alias("rule_index"), F.col("f.message").alias("short_text"),
                        F.format_string("%s (%s)", "f.message", "f.severity").alias("full_text"),
                        sarif_level(F.col("f.severity"), "report").alias("default_level"),
                        F.concat(F.lit("Suggestion: "), "f.suggestion").alias("help_text"))


def sarif_results(findings: DataFrame, variant: str = "cli") -> DataFrame:
    """Result rows with rule index, level and fingerprint."""
    rules = sarif_rules(findings).select("rule_id", "rule_index")
    return findings.join(rules, "rule_id").select(
        "rule_id", "rule_index", "message", sarif_level(F.col("severity"), variant).alias("level"),
        F.col("path").alias("uri"), F.col("line").alias("start_line"), F.col("col").alias("start_column"),
        "algorithm", "crypto_type", "confidence", "suggestion",
        F.concat_ws(":", "path", F.col("line").cast("string")).alias("fingerprint"))


def sarif_json(findings: DataFrame, tool_name: str = "cipherlake", variant: str = "cli") -> DataFrame:
    """One SARIF result object per row as JSON text, and the partition (repository) it belongs to.
    Rows stay rows, so a repository of any size is written in parallel as JSON lines."""
    res = sarif_results(findings, variant)
    obj = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"),
        F.struct(F.col("message").alias("text")).alias("message"), "level",
        F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation"),
                                  F.struct(F.col("start_line").alias("startLine"),
                                           F.col("start_column").alias("startColumn")).alias("region"))
                         .alias("physicalLocation"))).alias("locations"),
        F.struct("algorithm", F.col("crypto_type").alias("cryptoType"), "confidence", "suggestion").alias("properties"),
        F.struct(F.col("fingerprint").alias("primaryLocationLineHash")).alias("partialFingerprints"))
    return res.select(F.split("uri", "/")[0].alias("repo"), F.lit(tool_name).alias("tool"), F.to_json(obj).alias("result"))


def rule_help(rules: DataFrame) -> DataFrame:
    """Help text of a rule: suggestion and references."""
    refs = F.array_join(F.transform("references", lambda r: F.concat(F.lit("- "), r, F.lit("\n"))), "")
    return rules.select("rule_id", F.concat(F.lit("Suggestion: "), "suggestion", F.when(
        F.size("references") > 0, F.concat(F.lit("\n\nReferences:\n"), refs)).otherwise("")).alias("help_text"))


def csv_rows(findings: DataFrame) -> DataFrame:
    size = F.col("key_size") if "key_size" in findings.columns else F.lit(0)
    return findings.select(F.col("path").alias("File"), F.col("line").alias("Line"), F.col("severity").alias("Severity"),
                           F.col("message").alias("Message"), F.col("crypto_type").alias("Type"),
                           F.col("algorithm").alias("Algorithm"), size.alias("KeySize"), F.col("suggestion").alias("Suggestion"))


def executive_summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Rows of the executive summary: level, totals, severities and advice."""
    by_sev = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")]
    one = findings.agg(F.count("*").alias("total"), *by_sev).withColumns({
        "files": files.agg(F.count("*").alias("n")).scalar(),
        "score": RK.summary_risk(findings).select("risk_score").scalar()})
    level = first_match([(F.col("score") > 0.7, "High"), (F.col("score") > 0.3, "Medium")], "Low")
    item = lambda k, v: F.struct(F.lit(k).alias("item"), v.cast("string").alias("value"))
    advice = F.array_compact(F.array(
        F.when(F.col("total") == 0, item("recommendation", F.lit("No issues found"))),
        F.when((F.col("critical") > 0) | (F.col("high") > 0), item("recommendation", F.lit("Address critical and high findings now"))),
        F.when(F.col("medium") > 0, item("recommendation", F.lit("Remediate medium findings in the next sprint"))),
        F.when(F.col("low") > 0, item("recommendation", F.lit("Plan low findings for a later update")))))
    facts = F.array(item("risk_level", level), item("risk_score", F.format_string("%.2f", "score")),
                    item("total_files", F.col("files")), item("total_findings", F.col("total")))
    sevs = F.filter(F.array(*[item(s, F.col(s)) for s in ("critical", "high", "medium", "low", "info")]),
                    lambda x: x["value"] != "0")
    return one.select(F.inline(F.concat(facts, sevs, advice)))


def published_schema(classified: DataFrame) -> DataFrame:
    """The public result schema with the quantum-safe flag."""
    return classified.select(F.col("finding_id").alias("id"), F.col("path").alias("file"), "line",
                             F.col("col").alias("column"), "message", "severity", "confidence", "crypto_type",
                             (~F.col("cls_quantum_vulnerable")).alias("quantum_safe"), "suggestion")


def published_summary(classified: DataFrame) -> DataFrame:
    return classified.agg(F.count("*").alias("total_findings"),
                          F.count_if(F.col("severity").isin("critical", "high")).alias("high_severity"),
                          F.count_if("cls_quantum_vulnerable").alias("quantum_vulnerable"))


def run_summary(files: DataFrame, before: DataFrame, after: DataFrame, floor: float) -> DataFrame:
    """Files, findings before and after the policy, threshold."""
    return files.agg(F.count("*").alias("n_files")).withColumns({
        "findings_before": before.agg(F.count("*").alias("n")).scalar(),
        "findings_after": after.agg(F.count("*").alias("n")).scalar(), "min_confidence": F.lit(floor)})


def write_json(df: DataFrame, target: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).json(target)


def write_csv(df: DataFrame, target: str) -> None:
    csv_rows(df).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(target)


def write_parquet(df: DataFrame, target: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)


def write_evaluation(evaluations: DataFrame, summary: DataFrame, target: str) -> None:
    write_parquet(evaluations, f"{target}/evaluations")
    write_json(summary, f"{target}/summary")
