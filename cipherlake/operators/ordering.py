"""Row numbers and medians over whole tables without sending a table or a group through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.session import checkpoint

_WITHIN = 33  # low bits of a generated id count the rows of a partition


def global_index(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """0-based position of every row in the order of the given columns (which must be unique).

    The rows are dealt to ranges by Spark's own sampling, sorted and counted inside their range and stored once; each
    range then starts after the rows of the ranges before it.  The starts are one row per partition."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    stored = checkpoint(ranged)
    stored = stored.withColumns({"_part": F.shiftright("_id", _WITHIN), "_local": F.col("_id").bitwiseAND(F.lit((1 << _WITHIN) - 1))})
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return (stored.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_local")).cast("bigint"))
            .drop("_id", "_part", "_local", "_start"))


def exact_medians(counted: DataFrame, group: str, value: str, count: str = "n", ranges: int = 4096, limit: int = 50_000) -> DataFrame:
    """(group, median) from the counts of each group's distinct values: the middle value, or the mean of the middle two.

    An order statistic without a sort of the group: the values between its least and greatest are counted in equal
    ranges, and the search goes on inside the range that holds the middle, until that range has at most ``limit`` distinct
    values, which alone are put in order.  Counts are partial aggregates, so neither a hot group nor one of very many
    values is gathered in a task.  Null values are left out; a group without others has no row."""
    rows = counted.where(F.col(value).isNotNull() & (F.col(count) > 0)).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), F.col(count).cast("bigint").alias("n"))
    sizes = rows.groupBy("g").agg(F.sum("n").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("held"))
    ranks = F.array_distinct(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)))
    state = checkpoint(sizes.select("g", F.explode(ranks).alias("rank"), F.lit(0).cast("bigint").alias("below"), "low", "high", "held"))
    while state.where(F.col("held") > limit).limit(1).count():
        wide = state.where(F.col("held") > limit)
        place = F.least(F.lit(ranges - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * ranges))
        inside = rows.join(wide.drop("held"), _same_group(rows, wide)).drop(wide["g"]).where(F.col("v").between(F.col("low"), F.col("high")))
        parts = inside.groupBy("g", "rank", "below", place.alias("part")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("held"))
        so_far = F.col("below") + F.sum("n").over(Window.partitionBy("g", "rank").orderBy("part"))
        parts = parts.withColumn("upto", so_far).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        narrow = parts.select("g", "rank", (F.col("upto") - F.col("n")).alias("below"), "low", "high", "held")
        state = checkpoint(state.where(F.col("held") <= limit).unionByName(narrow))
    inside = rows.join(state, _same_group(rows, state)).drop(state["g"]).where(F.col("v").between(F.col("low"), F.col("high")))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("g", "rank").orderBy("v"))
    found = inside.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return found.groupBy("g").agg(F.avg("v").alias("median")).withColumnRenamed("g", group)


def _same_group(left: DataFrame, right: DataFrame) -> Column:
    return left["g"].eqNullSafe(right["g"])
