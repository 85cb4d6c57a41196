"""Flow stage (L2): taint sources, sinks, sanitizers and flow rules."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.functions.text import java_pattern, lookup
from cipherlake.operators.scan import lines, with_identity


def words(text: Column) -> Column:
    """Words of a line that look like variables: over two bytes, no brackets."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "),
                    lambda w: (F.octet_length(w) > 2) & ~w.rlike(r"[(){}\[\]<>]"))


def _tagged_lines(files: DataFrame, patterns: list[tuple[str, str, object]], name: str, value: str) -> DataFrame:
    tags = [F.when(F.col("text").rlike(java_pattern(p)), F.struct(F.lit(i).alias(name), F.lit(v).alias(value)))
            for i, p, v in patterns]
    # only files in which a pattern can match at all are cut into lines
    some = functools.reduce(lambda x, y: x | y, [F.col("content").rlike("(?m)" + java_pattern(p)) for _, p, _ in patterns])
    return lines(files.filter(some)).select("path", "line", "text", F.explode(F.array_compact(F.array(*tags))).alias("t")) \
        .select("path", "line", "text", f"t.{name}", f"t.{value}")


def taint_sources(files: DataFrame) -> DataFrame:
    """Lines where outside data enters, by kind and level."""
    return _tagged_lines(files, V.TAINT_SOURCES, "source_id", "taint_level")


def taint_sinks_text(files: DataFrame) -> DataFrame:
    """Declared sink patterns found on lines."""
    return _tagged_lines(files, V.TAINT_SINKS, "sink_id", "sink_severity")


def sanitizers(files: DataFrame) -> DataFrame:
    return _tagged_lines(files, V.SANITIZERS, "sanitizer_id", "effectiveness")


def taint_sinks(l1: DataFrame) -> DataFrame:
    """Structural findings as sinks; the matched text stands for the sink's line."""
    return l1.select("path", F.col("line").alias("sink_line"), F.col("col").alias("sink_col"),
                     F.col("match_text").alias("sink_text"),
                     lookup(V.SINK_TYPES, F.col("crypto_type"), V.SINK_TYPE_DEFAULT).alias("sink_type"))


def trace_flows(sources: DataFrame, sinks: DataFrame, max_lines: int = V.FLOW_MAX_LINES) -> DataFrame:
    """Source-sink pairs of one file that are close or share a word.

    The pairs are found by two equi joins instead of one pairing of everything in a file: nearby
    lines meet through line blocks (each source looks at its own and the two neighbouring blocks),
    distant ones through a shared word.  Both results are disjoint."""
    src = sources.select("path", F.col("line").alias("source_line"), F.col("text").alias("source_text"), "source_id",
                         "taint_level").withColumn("source_words", words(F.col("source_text")))
    snk = sinks.withColumn("sink_words", words(F.col("sink_text")))
    distance = F.abs(F.col("source_line") - F.col("sink_line"))
    block = lambda c: F.floor(F.col(c) / (max_lines + 1)).cast("bigint")
    near = (src.withColumn("block", F.explode(F.array(block("source_line") - 1, block("source_line"), block("source_line") + 1)))
            .join(snk.withColumn("block", block("sink_line")), ["path", "block"])
            .filter(distance <= max_lines).drop("block"))
    far = (src.withColumn("word", F.explode(F.array_distinct("source_words")))
           .join(snk.withColumn("word", F.explode(F.array_distinct("sink_words"))), ["path", "word"])
           .filter(distance > max_lines).drop("word"))
    keys = ["path", "source_line", "source_id", "sink_line", "sink_col", "sink_type", "source_text", "sink_text",
            "taint_level"]
    # a distant pair that shares several words is one flow; sinks of equal text stay apart by position
    far = far.dropDuplicates(keys)
    both = near.select(*keys, "source_words", "sink_words").unionByName(far.select(*keys, "source_words", "sink_words"))
    shared = F.arrays_overlap("source_words", "sink_words")
    conf = F.lit(0.6) + F.when(distance <= 10, 0.3).when(distance <= 25, 0.2).otherwise(0.0) + F.when(shared, 0.2).otherwise(0.0)
    return both.select(*keys, F.concat("source_id", F.lit("_to_"), "sink_type").alias("flow_type"),
                       F.least(F.lit(1.0), conf).alias("confidence"))


def sanitized_confidence(flows: DataFrame, sanitizer_lines: DataFrame) -> DataFrame:
    """Option: lower a flow's confidence by the best sanitizer between its ends.

    Sanitizers are reduced to one value per line before the join."""
    best = sanitizer_lines.groupBy("path", F.col("line").alias("s_line")).agg(F.max("effectiveness").alias("eff"))
    lo, hi = F.least("source_line", "sink_line"), F.greatest("source_line", "sink_line")
    pairs = flows.select("path", lo.alias("lo"), hi.alias("hi")).distinct()
    between = (pairs.join(best, (pairs["path"] == best["path"]) & F.col("s_line").between(F.col("lo"), F.col("hi")))
               .groupBy(pairs["path"], "lo", "hi").agg(F.max("eff").alias("eff")))
    out = flows.withColumns({"lo": lo, "hi": hi}).join(between, ["path", "lo", "hi"], "left")
    return out.withColumn("confidence", F.col("confidence") * (1 - F.coalesce("eff", F.lit(0.0)))).drop("lo", "hi", "eff")


def flow_violations(flows: DataFrame) -> DataFrame:
    """Flows that a rule forbids, as findings.  The few rules are tried inside the row."""
    kind = F.col("flow_type")
    rules = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("source_type"), F.lit(k).alias("rule_sink"),
                               F.lit(sev).alias("severity")) for i, s, k, sev in V.FLOW_RULES])
    broken = F.filter(rules, lambda r: kind.contains(r["source_type"]) & kind.contains(r["rule_sink"]))
    hit = flows.select("*", F.inline(broken))
    return with_identity(hit.select(
        "path", F.split("path", "/")[0].alias("repo"), "rule_id", F.col("sink_line").alias("line"),
        F.col("sink_col").alias("col"), F.lit(0).cast("bigint").alias("pos"),
        F.concat(F.col("source_type"), F.lit(" reaches "), F.col("rule_sink"), F.lit(" from line "),
                 F.col("source_line").cast("string")).alias("message"),
        "severity", "confidence", F.lit("data_flow").alias("crypto_type"), F.lit("TAINT_ANALYSIS").alias("algorithm"),
        F.concat(F.lit("Flow: "), "source_text", F.lit(" -> "), "sink_text").alias("context"),
        F.lit("").alias("suggestion"), F.col("flow_type").alias("match_text"), F.lit("L2").alias("stage"),
        "flow_type", "taint_level", "source_line", "sink_line"))
