"""Stage, performance and accuracy metrics of scan runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.functions import paths as P
from cipherlake.functions.text import first_match

STAGE_NAMES = {0: "L0_Regex", 1: "L1_AST", 2: "L2_DataFlow"}


def stage_order(stage: Column) -> Column:
    return first_match([(stage == "L2", 2), (stage == "L1", 1)], 0)


def stage_name(order: Column) -> Column:
    return first_match([(order == k, v) for k, v in STAGE_NAMES.items()], "Unknown")


def highest_stage(findings: DataFrame) -> DataFrame:
    """Files by the highest stage that ran on them."""
    per = findings.groupBy("path").agg(F.max(stage_order(F.col("stage"))).alias("s"))
    return per.groupBy("s").agg(F.count("*").alias("n_files")).select(stage_name(F.col("s")).alias("stage"), "n_files")


def file_confidence(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Mean confidence of every scanned file, 0 without findings."""
    per = findings.groupBy("path").agg(F.avg("confidence").alias("c"), F.count("*").alias("n"))
    return files.select("path").join(per, "path", "left").select(
        "path", F.coalesce("c", F.lit(0.0)).alias("mean_confidence"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n_findings"))


def performance(runs: DataFrame) -> DataFrame:
    """Calls and seconds per category and overall.  ``runs`` has one row per file: category, seconds."""
    return (runs.rollup("category").agg(
        F.count("*").alias("calls"), F.sum("seconds").alias("total_seconds"), F.min("seconds").alias("min_seconds"),
        F.max("seconds").alias("max_seconds"), F.avg("seconds").alias("avg_seconds"), F.grouping("category").alias("g"))
        .select(F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.col("category")).alias("category"),
                "calls", "total_seconds", "min_seconds", "max_seconds", "avg_seconds"))


def stage_performance(stage_runs: DataFrame) -> DataFrame:
    """Calls, seconds and findings per stage (stage, seconds, n_findings per row)."""
    return stage_runs.groupBy("stage").agg(
        F.count("*").alias("calls"), F.sum("seconds").alias("total_seconds"), F.sum("n_findings").alias("n_findings"),
        (F.sum("n_findings") / F.count("*")).alias("findings_per_call"))


def likely_true(confidence: Column, algorithm: Column, stage: Column, path: Column) -> Column:
    """Heuristic for a true finding when there is no ground truth."""
    return first_match([
        (confidence >= 0.8, True), (algorithm.isin("MD5", "SHA1", "RSA-1024", "RSA-512"), True), (stage == "L2", True),
        (P.is_test_strict(path), confidence >= 0.9), (P.is_vendored(path), confidence >= 0.95)], confidence >= 0.7)


def _ratios(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 from the counts tp, fp and fn."""
    ratio = lambda a, b: F.coalesce(a / F.nullif(a + b, F.lit(0)), F.lit(0.0))
    p, r = F.col("precision"), F.col("recall")
    return df.withColumns({"precision": ratio(F.col("tp"), F.col("fp")), "recall": ratio(F.col("tp"), F.col("fn"))}) \
        .withColumn("f1", F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)))


def heuristic_accuracy(findings: DataFrame) -> DataFrame:
    """Accuracy per file category from the heuristic; no false negatives are known."""
    ok = likely_true(F.col("confidence"), F.col("algorithm"), F.col("stage"), F.col("path"))
    agg = (findings.withColumns({"category": P.file_category(F.col("path")), "ok": ok}).groupBy("category").agg(
        F.count_if("ok").alias("tp"), F.count_if(~F.col("ok")).alias("fp"), F.lit(0).cast("bigint").alias("fn"),
        F.avg("confidence").alias("mean_confidence")))
    return _ratios(agg)


def labelled_accuracy(findings: DataFrame, labels: DataFrame, group: str) -> DataFrame:
    """Accuracy against ground truth: ``labels`` has path, is_positive and the group column.  A
    positive file without a finding is a false negative."""
    hit = findings.select("path").distinct().withColumn("hit", F.lit(True))
    j = labels.join(hit, "path", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    agg = j.groupBy(group).agg(
        F.count_if(F.col("hit") & F.col("is_positive")).alias("tp"), F.count_if(F.col("hit") & ~F.col("is_positive")).alias("fp"),
        F.count_if(~F.col("hit") & F.col("is_positive")).alias("fn"), F.count_if(~F.col("hit") & ~F.col("is_positive")).alias("tn"))
    return _ratios(agg)


def recommendations(perf: DataFrame, stages: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Advice from thresholds on the (small) metric tables."""
    overall = perf.filter(F.col("category") == "overall")
    total = overall.select("total_seconds")
    a = overall.filter(F.col("avg_seconds") > 5).select(F.lit("overall").alias("scope"), F.lit("raise parallelism").alias("advice"))
    b = stages.filter(F.col("total_seconds") > total.scalar() / 2).select(F.col("stage").alias("scope"), F.lit("optimise: over half of the time").alias("advice"))
    c = stages.filter(F.col("findings_per_call") < 0.1).select(F.col("stage").alias("scope"), F.lit("review rules: few findings").alias("advice"))
    d = accuracy.filter(F.col("precision") < 0.8).select(F.col("category").alias("scope"), F.lit("tune rules: low precision").alias("advice"))
    e = accuracy.filter(F.col("recall") < 0.6).select(F.col("category").alias("scope"), F.lit("add rules: low recall").alias("advice"))
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e)


def top_performers(perf: DataFrame, k: int) -> DataFrame:
    """Categories by files per mean second."""
    score = F.coalesce(F.col("calls") / F.nullif("avg_seconds", F.lit(0.0)), F.lit(0.0))
    return (perf.filter(F.col("category") != "overall").select("category", score.alias("score"))
            .orderBy(F.desc("score"), "category").limit(k))


def bottlenecks(stages: DataFrame, errors: DataFrame) -> DataFrame:
    """Slowest stage by mean seconds, and categories with over 10 % errors (category, calls, errors)."""
    slow = stages.agg(F.max_by("stage", F.struct(F.col("total_seconds") / F.col("calls"), F.col("stage"))).alias("name"),
                      F.max(F.col("total_seconds") / F.col("calls")).alias("value"))
    slow = slow.filter(F.col("value") > 0).select(F.lit("slowest_stage").alias("kind"), "name", "value")
    rate = F.col("errors") / F.col("calls")
    bad = errors.filter((F.col("calls") > 0) & (rate > 0.1)).select(F.lit("error_rate").alias("kind"),
                                                                    F.col("category").alias("name"), rate.alias("value"))
    return slow.unionByName(bad)


def benchmark_report(perf: DataFrame, stages: DataFrame, accuracy: DataFrame) -> DataFrame:
    """All metric tables as rows with a section column."""
    def melt(df, section, key, cols):
        return df.select(F.lit(section).alias("section"), F.col(key).alias("name"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])))
    return (melt(perf, "performance", "category", ["calls", "total_seconds", "avg_seconds"])
            .unionByName(melt(stages, "stage", "stage", ["calls", "total_seconds", "n_findings", "findings_per_call"]))
            .unionByName(melt(accuracy, "accuracy", "category", ["tp", "fp", "precision", "recall", "f1"])))


def compare_expectations(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected against found rules per file: matched, missing, unexpected, wrong severity."""
    a = actual.groupBy("path", "rule_id").agg(F.max_by("severity", "severity_order").alias("found_severity"))
    j = a.join(expected.withColumnRenamed("severity", "expected_severity"), ["path", "rule_id"], "full_outer")
    return j.withColumn("status", first_match([
        (F.col("found_severity").isNull(), "missing"), (F.col("expected_severity").isNull(), "unexpected"),
        (F.col("found_severity") != F.col("expected_severity"), "wrong_severity")], "matched"))


def suite_score(findings: DataFrame, expectations: DataFrame) -> DataFrame:
    """Pass or fail per expected file: category rules, maximum severity, at least one expected rule."""
    order = F.expr("array_position(array('info','low','medium','high','critical'), severity)")
    per = findings.groupBy("path").agg(
        F.count("*").alias("n"), F.max_by("severity", order).alias("max_severity"),
        F.max(F.when(F.col("severity") == "info", True).otherwise(False)).alias("has_info"),
        F.collect_set("rule_id").alias("rules"))  # at most one entry per rule of the table
    j = expectations.join(per, "path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    relaxed = F.col("category").isin("protocol_implementation", "test_context", "configuration")
    sev_ok = F.when(relaxed, F.col("has_info")).otherwise(F.col("max_severity") == F.col("expected_severity"))
    ok = F.when(F.col("category") == "false_positive", F.col("n") == 0).otherwise(
        (F.col("n") > 0) & F.coalesce(sev_ok, F.lit(False)) & F.coalesce(F.arrays_overlap("rules", "expected_rules"), F.lit(False)))
    return j.select("path", "category", F.col("n").cast("bigint").alias("n_findings"), "max_severity", ok.alias("passed"))


def running_mean_confidence(findings: DataFrame) -> DataFrame:
    """Running mean of confidence within a file, in position order (a file is bounded by size)."""
    w = Window.partitionBy("path").orderBy("line", "col", "rule_id", "finding_id").rowsBetween(Window.unboundedPreceding, 0)
    return findings.withColumn("running_confidence", F.avg("confidence").over(w))
