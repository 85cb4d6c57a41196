"""Policy: thresholds, suppression, dedupe, ranking and exit status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.functions import severity as S
from cipherlake.operators.ordering import global_index

RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
# copies of an entry that covers all lines of a rule, so that one rule's findings meet it in many tasks
SALTS = 32


def min_confidence(findings: DataFrame, floor: float) -> DataFrame:
    return findings.filter(F.col("confidence") >= floor)


def min_severity(findings: DataFrame, level: str = "medium") -> DataFrame:
    return findings.filter(S.at_least(F.col("severity"), level))


def baseline_active(baseline: DataFrame, as_of: Column) -> DataFrame:
    """Entries that can still suppress: a rule id, and no expiry before ``as_of``.
    An expiry that isn't a full RFC 3339 time (a date alone, say) counts as none."""
    given = F.coalesce("expires", F.lit(""))
    expires = F.when(given.rlike(RFC3339), given.try_cast("timestamp"))
    return (baseline.filter(F.coalesce("rule_id", F.lit("")) != "")
            .filter(F.coalesce(as_of.cast("timestamp") <= expires, F.lit(True)))
            .select(F.col("rule_id").alias("b_rule"), F.coalesce("file", F.lit("")).alias("b_file"),
                    F.coalesce("line", F.lit(0)).alias("b_line")).distinct())


def apply_baseline(findings: DataFrame, baseline: DataFrame, as_of: Column) -> DataFrame:
    """Drop findings a baseline entry covers: same rule, path suffix if given, line if given.

    All joins are equi joins on more than the rule: on (rule, line) or (rule, salt) for entries of a whole rule; on
    (rule, suffix) for entries with a file, where a path gives one suffix for each length that entries have.  The
    places covered by files, (rule, path, line), then leave the findings in one anti join.  Batch input only; a stream
    applies it to each batch."""
    active = baseline_active(baseline, as_of)
    whole = active.filter(F.col("b_file") == "")
    every = whole.filter("b_line <= 0").select("b_rule", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("b_salt")).distinct()
    at_line = whole.filter("b_line > 0").select("b_rule", "b_line")
    out = findings.join(at_line, (F.col("rule_id") == F.col("b_rule")) & (F.col("line") == F.col("b_line")), "left_anti")
    out = out.join(every, (F.col("rule_id") == F.col("b_rule")) & (F.pmod(F.xxhash64("path", "line"), F.lit(SALTS)) == F.col("b_salt")), "left_anti")
    local = active.filter(F.col("b_file") != "")
    lengths = local.select(F.length("b_file").alias("n")).distinct().agg(F.collect_list("n").alias("ns"))  # at most the longest path
    places = out.select("rule_id", "path", "line").distinct().withColumn("_ns", lengths.scalar())
    suffix = F.transform(F.filter("_ns", lambda n: n <= F.length("path")), lambda n: F.right(F.col("path"), n))
    ends = places.select("rule_id", "path", "line", F.explode(suffix).alias("_end"))
    line_ok = (F.col("b_line") <= 0) | (F.col("b_line") == F.col("line"))
    covered = ends.join(local, (F.col("rule_id") == F.col("b_rule")) & (F.col("_end") == F.col("b_file")) & line_ok, "left_semi")
    return out.join(covered.select("rule_id", "path", "line").distinct(), ["rule_id", "path", "line"], "left_anti").select(*findings.columns)


def apply_inline_suppressions(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Drop findings an inline marker covers: its rule or ``*``, on the line, within ten lines,
    or anywhere in the file.  Equi join on path; Catalyst picks the strategy."""
    s = suppressions.select(F.col("path").alias("s_path"), F.col("line").alias("s_line"),
                            F.col("rule_id").alias("s_rule"), F.col("scope").alias("s_scope"))
    cond = ((F.col("path") == F.col("s_path"))
            & ((F.col("s_rule") == "*") | (F.col("s_rule") == F.col("rule_id")))
            & ((F.col("s_scope") == "file") | ((F.col("s_scope") == "line") & (F.col("line") == F.col("s_line")))
               | ((F.col("s_scope") == "block") & F.col("line").between(F.col("s_line"), F.col("s_line") + 10))))
    return findings.join(s, cond, "left_anti")


def suppression_ids(suppressions: DataFrame) -> DataFrame:
    """Rule ids suppressed per file (a file holds few markers, and file size is bounded)."""
    return suppressions.groupBy("path").agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))


def priority_order() -> list[Column]:
    return [F.desc("severity_order"), F.desc("confidence"), F.desc("criticality"), F.asc("line"), F.asc("finding_id")]


def with_priority(findings: DataFrame) -> DataFrame:
    return findings.withColumns({"severity_order": S.priority(F.col("severity")),
                                 "criticality": S.criticality(F.col("algorithm"))})


def prioritize(findings: DataFrame, limit: int) -> DataFrame:
    """Top findings by severity, confidence, criticality and line.  Each task keeps ``limit`` rows
    (TakeOrderedAndProject), so nothing is sorted globally."""
    return with_priority(findings).orderBy(*priority_order()).limit(limit)


def top_by_confidence(findings: DataFrame, limit: int = 0) -> DataFrame:
    """Highest confidence first; 0 keeps all."""
    ordered = findings.orderBy(F.desc("confidence"), "finding_id")
    return ordered.limit(limit) if limit else ordered


def ranked_by_confidence(findings: DataFrame) -> DataFrame:
    """All findings with their 0-based rank by confidence, highest first; no task sees them all."""
    return global_index(findings.withColumn("_down", -F.col("confidence")), "_down", "finding_id", name="rank").drop("_down")


def top_per_group(findings: DataFrame, group: str, limit: int) -> DataFrame:
    """Prioritised top findings of every group.  The rank filter is pushed below the shuffle
    (window group limit), so a hot group sends at most ``limit`` rows per task."""
    w = Window.partitionBy(group).orderBy(*priority_order())
    return (with_priority(findings).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit))


def filter_for_evaluation(findings: DataFrame, floor: float, limit: int) -> DataFrame:
    return prioritize(min_confidence(findings, floor), limit)


def scan_policy(findings: DataFrame, baseline: DataFrame | None, as_of: Column, policy: str = "scan",
                floor: float = 0.3, limit: int = 0) -> DataFrame:
    """``scan``: threshold, top-k, baseline.  ``layered``: threshold, baseline, sort, top-k."""
    kept = min_confidence(findings, floor)
    if policy == "scan":
        kept = prioritize(kept, limit) if limit else kept
        return apply_baseline(kept, baseline, as_of) if baseline is not None else kept
    if baseline is not None:
        kept = apply_baseline(kept, baseline, as_of)
    return top_by_confidence(kept, limit) if limit else kept


def fingerprint_dedupe(findings: DataFrame) -> DataFrame:
    """One finding per file and line, the first by column and rule (partial aggregation first)."""
    rest = [c for c in findings.columns if c not in ("path", "line")]
    return (findings.groupBy("path", "line")
            .agg(F.min_by(F.struct(*rest), F.struct("col", "rule_id", "finding_id")).alias("first"))
            .select("path", "line", "first.*"))


def exit_status(findings: DataFrame) -> DataFrame:
    """1 when there is any finding, else 0."""
    return findings.agg(F.when(F.count("*") > 0, F.lit(1)).otherwise(F.lit(0)).alias("exit_status"))
