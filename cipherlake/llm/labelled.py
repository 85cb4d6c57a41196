"""Bounded samples of labelled documents for the classifiers of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label_col: str, allowed: Column, per_label: int, max_chars: int,
           id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> tuple[DataFrame, float]:
    """At most `per_label` labelled documents of either label, and the share of label 1 among all allowed labels.

    Only ids of `allowed` rows are taken, in the order of a hash of the id. Conflicting labels of an id count as their
    largest; null ids and labels are left out. Training (never scoring) leaves out texts of over `max_chars` characters.
    The chosen ids are 2 * per_label rows at most, so they are broadcast and the texts stay where they are."""
    known = (labels.where(allowed & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label")))
    share = known.agg(F.avg("label")).first()[0]
    order = F.xxhash64("doc_id", F.lit(label_col))
    chosen = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(per_label) for k in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)
    texts = texts.where(F.length("text") <= max_chars)
    found = texts.join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")
    return found.groupBy("doc_id").agg(F.max("label").alias("label"), *[F.min(c).alias(c) for c in ("text", *extra)]), share
