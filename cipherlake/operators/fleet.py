"""Analytics over the findings of many repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.functions.text import first_match, has_any
from cipherlake.operators.ordering import exact_medians
from cipherlake.session import checkpoint


def context_features(findings: DataFrame) -> DataFrame:
    """Where a finding stands: test, library or application, and code level."""
    low = F.lower("path")
    test, lib = has_any(low, V.FLEET_TEST_PARTS), has_any(low, V.FLEET_LIBRARY_PARTS)
    return findings.withColumns({
        "context_type": first_match([(test, "test"), (lib, "library")], "application"),
        "implementation_level": first_match([(has_any(low, V.FLEET_LOW_LEVEL_PARTS), "low_level")], "high_level"),
        "file_type": F.element_at(F.split("path", "\\."), -1),
        "confidence_band": first_match([(F.col("confidence") >= 0.8, "high"), (F.col("confidence") >= 0.5, "medium")], "low")})


def _spread(total: Column, mean: Column, squares: Column) -> Column:
    """Sample standard deviation from weighted sums; 0 for a single value."""
    return F.when(total > 1, F.sqrt(F.greatest(squares - total * mean * mean, F.lit(0.0)) / (total - 1))).otherwise(F.lit(0.0))


def repository_statistics(findings: DataFrame) -> DataFrame:
    """Per repository: totals, bands, contexts and confidence statistics.

    One pass over the findings counts each repository's distinct confidences; all else, also the exact median, comes from
    these counts, which are stored once.  A hot repository is aggregated where its rows are."""
    f = context_features(findings)
    kinds = {**{f"{v}_confidence": ("confidence_band", v) for v in ("high", "medium", "low")}, **{f"{v}_findings": ("context_type", v) for v in ("test", "library", "application")},
             **{f"{v}_findings": ("implementation_level", v) for v in ("low_level", "high_level")}}
    counted = checkpoint(f.groupBy("repo", "confidence").agg(F.count("*").alias("n"), *[F.count_if(F.col(c) == v).alias(name) for name, (c, v) in kinds.items()]))
    c, n = F.col("confidence"), F.when(F.col("confidence").isNotNull(), F.col("n"))
    sums = counted.groupBy("repo").agg(F.sum("n").alias("total_findings"), *[F.sum(k).alias(k) for k in kinds], F.sum(n).alias("_n"), F.sum(c * n).alias("_sum"), F.sum(c * c * n).alias("_squares"),
                                       F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))
    mean = F.col("_sum") / F.nullif("_n", F.lit(0))
    out = sums.withColumns({"mean_confidence": mean, "std_confidence": F.coalesce(_spread(F.col("_n"), mean, F.col("_squares")), F.lit(0.0))})
    medians = exact_medians(counted, "repo", "confidence").withColumnRenamed("repo", "_repo")
    return out.join(medians, out["repo"].eqNullSafe(medians["_repo"]), "left").select(
        "repo", "total_findings", *kinds, "mean_confidence", F.col("median").alias("median_confidence"), "std_confidence", "min_confidence", "max_confidence")


def repository_distributions(findings: DataFrame) -> DataFrame:
    """Counts per repository, dimension and value."""
    dims = ["severity", "algorithm", "language", "crypto_type"]
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])
    return (findings.select("repo", F.inline(rows)).groupBy("repo", "dimension", "value")
            .agg(F.count("*").alias("n_findings")))


def combined_distributions(per_repo: DataFrame) -> DataFrame:
    """All repositories together, from the per-repository counts."""
    return per_repo.groupBy("dimension", "value").agg(F.sum("n_findings").alias("n_findings"))


def global_statistics(findings: DataFrame, repositories: DataFrame) -> DataFrame:
    """Totals, mean per repository, and statistics of confidences above zero, from one count per distinct confidence."""
    counted = checkpoint(findings.groupBy("confidence").agg(F.count("*").alias("n")))
    c, n = F.col("confidence"), F.when(F.col("confidence") > 0, F.col("n"))
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_findings"), F.sum(n).alias("_n"), F.sum(c * n).alias("_sum"), F.sum(c * c * n).alias("_squares"),
                       F.min(F.when(c > 0, c)).alias("min_confidence"), F.max(F.when(c > 0, c)).alias("max_confidence"))
    mean = F.col("_sum") / F.nullif("_n", F.lit(0))
    one = sums.withColumns({"mean_confidence": mean, "std_confidence": F.coalesce(_spread(F.col("_n"), mean, F.col("_squares")), F.lit(0.0))}).drop("_n", "_sum", "_squares")
    median = exact_medians(counted.where(c > 0).withColumn("all", F.lit(0)), "all", "confidence").select("median")
    total = repositories.select("repo").distinct().agg(F.count("*").alias("n"))
    return one.withColumns({"median_confidence": median.scalar(), "total_repositories": total.scalar()}).withColumn(
        "avg_findings_per_repo", F.coalesce(F.col("total_findings") / F.nullif("total_repositories", F.lit(0)), F.lit(0.0)))


def training_suitability(findings: DataFrame, approximate: bool = False) -> DataFrame:
    """How fit the findings are for training, with advice."""
    f = context_features(findings)
    n = F.nullif(F.count("*"), F.lit(0))
    ratio = lambda cond: F.coalesce(F.count_if(cond) / n, F.lit(0.0))
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    one = f.agg(
        F.count("*").alias("training_samples"), F.count_if(F.col("confidence_band") == "high").alias("high_quality_samples"),
        distinct("algorithm").alias("diverse_algorithms"), distinct("language").alias("diverse_languages"),
        ratio(F.col("context_type") == "test").alias("test_ratio"), ratio(F.col("context_type") == "library").alias("library_ratio"),
        ratio(F.col("context_type") == "application").alias("application_ratio"),
        ratio(F.col("confidence_band") == "high").alias("high_ratio"), ratio(F.col("confidence_band") == "medium").alias("medium_ratio"),
        ratio(F.col("confidence_band") == "low").alias("low_ratio"))
    advice = F.array_compact(F.array(
        F.when(F.col("training_samples") < 1000, F.lit("scan more repositories")),
        F.when(F.col("high_quality_samples") < 100, F.lit("collect more high-confidence samples")),
        F.when(F.col("diverse_algorithms") < 20, F.lit("scan more diverse libraries")),
        F.when(F.col("test_ratio") > 0.5, F.lit("balance test findings"))))
    return one.withColumn("advice", F.array_join(advice, "; "))


def repository_rankings(stats: DataFrame, k: int = 10) -> DataFrame:
    """Top repositories by findings, by high-confidence findings and by mean confidence.
    Three top-k selections; no global sort."""
    out = None
    for name, col in (("by_total_findings", "total_findings"), ("by_high_confidence", "high_confidence"),
                      ("by_avg_confidence", "mean_confidence")):
        top = stats.orderBy(F.desc(col), "repo").limit(k)
        w = Window.orderBy(F.desc(col), "repo")  # over the k rows only
        part = top.select(F.lit(name).alias("ranking"), F.row_number().over(w).alias("rank"), "repo",
                          F.col(col).cast("double").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def top_algorithms(findings: DataFrame, per_repo: int = 10, overall: int = 20) -> DataFrame:
    counts = findings.groupBy("repo", "algorithm").agg(F.count("*").alias("n"))
    w = Window.partitionBy("repo").orderBy(F.desc("n"), "algorithm")
    local = (counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_repo)
             .select("repo", "rank", "algorithm", "n"))
    total = counts.groupBy("algorithm").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "algorithm").limit(overall)
    g = Window.orderBy(F.desc("n"), "algorithm")  # over at most 20 rows
    return local.unionByName(total.select(F.lit("*").alias("repo"), F.row_number().over(g).alias("rank"), "algorithm", "n"))


def combined_statistics(findings: DataFrame, repositories: DataFrame) -> DataFrame:
    """Repositories processed, with findings, and findings of each (zero included)."""
    per = findings.groupBy("repo").agg(F.count("*").alias("n_findings"))
    return repositories.select("repo").distinct().join(per, "repo", "left").select(
        "repo", F.coalesce("n_findings", F.lit(0).cast("bigint")).alias("n_findings"))


def combined_totals(per_repo: DataFrame) -> DataFrame:
    return per_repo.agg(F.count("*").alias("repos_processed"), F.count_if(F.col("n_findings") > 0).alias("repos_with_findings"),
                        F.sum("n_findings").alias("total_findings"))


def union_repositories(parts: list[DataFrame]) -> DataFrame:
    """Findings of several repositories with differing columns as one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
