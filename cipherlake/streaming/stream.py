"""Streaming forms of the scan, suppression, dedupe and risk trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.operators import risk as RK
from cipherlake.operators import scan as S
from cipherlake.operators.policy import apply_baseline


def stream_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New files of a directory, each read once (the source checkpoint remembers them)."""
    raw = (spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
           .option("maxFilesPerTrigger", max_files).load(path))
    return raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("modificationTime").alias("modified"),
                      F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def stream_table(spark: SparkSession, path: str, ddl: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", max_files).parquet(path)


def scan_each_batch(files: DataFrame, target: str, checkpoint: str, transform=S.l0_scan, **trigger):
    """Continuous scan: every micro-batch goes through the batch scan and is written to a folder of
    its own, so a retried batch replaces its output instead of adding to it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def suppress_each_batch(findings: DataFrame, baseline: DataFrame, as_of: Column, target: str, checkpoint: str):
    """Baseline suppression of a stream of findings, batch by batch against the static baseline."""
    return scan_each_batch(findings, target, checkpoint, lambda batch: apply_baseline(batch, baseline, as_of))


def dedupe(stream: DataFrame, event_time: str, delay: str = "1 hour", keys: list[str] | None = None) -> DataFrame:
    """One finding per key within the watermark; state older than it is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys or ["path", "line", "rule_id"])


def risk_windows(scored: DataFrame, event_time: str, length: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Overall risk per event-time window (risk and risk_weight columns); late rows count up to the
    watermark.  Works on batch and streaming input alike."""
    win = F.window(event_time, length, slide) if slide else F.window(event_time, length)
    df = scored.withWatermark(event_time, delay) if scored.isStreaming else scored
    return df.groupBy(win.alias("w")).agg(RK.overall_risk_expr().alias("overall_risk"), F.count("*").alias("n_findings")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "overall_risk", "n_findings")


def risk_sessions(scored: DataFrame, event_time: str, gap: str = "30 minutes", key: str = "path", delay: str = "1 hour") -> DataFrame:
    """Overall risk per burst of findings: a session of a key ends when nothing follows for ``gap``.  A late row within the
    delay joins its session or melts two into one.  Works on batch and streaming input alike."""
    df = scored.withWatermark(event_time, delay) if scored.isStreaming else scored
    return df.groupBy(F.session_window(event_time, gap).alias("w"), key).agg(RK.overall_risk_expr().alias("overall_risk"), F.count("*").alias("n_findings")) \
        .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "overall_risk", "n_findings")


def running_totals(evaluations: DataFrame) -> DataFrame:
    """Running counts of an evaluation run, for complete or update mode."""
    return evaluations.groupBy("is_valid").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))


def totals_each_batch(evaluations: DataFrame, target: str, checkpoint: str):
    """Running totals, written anew after each batch to a folder of its own; the highest batch_id is the latest."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (running_totals(evaluations).writeStream.outputMode("complete").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
