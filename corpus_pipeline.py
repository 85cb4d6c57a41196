"""Training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of the documents they got, without the ones that go; the last returns the
packed pieces. Columns that the table may have besides doc_id and text are carried through untouched, except n_chars,
which follows the text. Empty tables pass through all stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.llm import op1_lines, op2_quality, op3_packing, op5_jaccard, op6_decontamination
from cipherlake.llm.common import cut, fold, table
from cipherlake.session import scratch

QUALITY_AT_LEAST = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels outside the held-out fold, doesn't reject."""
    metadata = ("n_chars",) if "n_chars" in docs.columns else ()
    model = op2_quality.fit(docs, table(spark, sf_dir, "labels"), ~fold(F.col("doc_id"), 3, 1), metadata_cols=metadata)
    return docs.where(op2_quality.score(model, F.col("text"), *[F.col(c) for c in metadata]) >= QUALITY_AT_LEAST)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier document has; documents of which nothing remains go."""
    columns = docs.columns
    out = op1_lines.dedup(docs, prefix="_line_dedup_").where((F.size("_line_dedup_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("_line_dedup_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document, the first in the order of row_key(): the smallest id, null last, and
    of equal ids the smallest hash of the text. Rows equal in id (null or not) and text are one document, of which one
    stays. A row goes for its own text only, never for the text of another row with its id."""
    own = op1_lines.row_key(F.col("doc_id"), F.col("text"))
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    # the row's key as a string of the same order
    key = F.concat(own["missing"].cast("int").cast("string"), digits(own["id"].bitwiseXOR(F.lit(-(1 << 63)))), digits(own["hash"].bitwiseXOR(F.lit(-(1 << 63)))))
    keyed = docs.withColumn("_near_key", key)
    found = op5_jaccard.classes(keyed.select("_near_key", "text"), id_col="_near_key").groupBy("_near_key").agg(F.min("component_id").alias("first"), F.count("*").alias("copies"))
    marks = cut(found.withColumn("_near_first", F.col("first") == F.col("_near_key")).where(~F.col("_near_first") | (F.col("copies") > 1)).select("_near_key", "_near_first"))
    alone = keyed.join(marks, "_near_key", "left_anti")
    copies = keyed.join(marks.where("_near_first"), "_near_key", "left_semi").dropDuplicates(["_near_key"])
    return alone.unionByName(copies).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    indexes = op6_decontamination.fit(docs, table(spark, sf_dir, "benchmark"))
    return docs.where(F.size(op6_decontamination.leaks(indexes, F.col("text"))) == 0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequence and offset."""
    return op3_packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality), ("line_dedup", line_dedup), ("ngram_jaccard", near_duplicates), ("decontamination", decontaminate), ("packing", packing)]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each keeps is stored in the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
