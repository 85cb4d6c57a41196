"""Connected components of a graph given as pairs of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.common import cut, release


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node of each component, for the nodes that have links.

    Every round hangs each node's larger neighbours, then its smaller ones, on the smallest node of the neighbourhood,
    until nothing changes; the number of rounds grows with the logarithm of the longest chain. Both steps are grouped
    minima and joins, so a node with very many neighbours isn't gathered in one task's memory. Each round is stored in
    the shared folder. Links with a null end and links of a node with itself are left out."""
    edges = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    edges = cut(edges)
    mark = None
    while True:
        edges = _round(edges)
        release(edges.sparkSession)  # rounds are many and small
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u")
    return cut(small.select("u", F.col("m").alias("v")).unionAll(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
