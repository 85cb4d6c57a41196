"""Risk scores, heat map, trend and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.functions import severity as S
from cipherlake.functions.text import clamp, dimension, first_match, has_any


def algorithm_risk(algorithm: Column) -> Column:
    """Exact name, else the longest table name contained in it (ties alphabetically), else 0.5."""
    up = F.upper(algorithm)
    by_length = sorted(V.ALGORITHM_RISK, key=lambda k: (-len(k), k))
    part = first_match([(up.contains(k), V.ALGORITHM_RISK[k]) for k in by_length], 0.5)
    exact = F.element_at(F.create_map(*[F.lit(x) for kv in V.ALGORITHM_RISK.items() for x in kv]), up)
    return F.coalesce(exact, part)


def context_risk(context: Column) -> Column:
    low = F.lower(context)
    step = lambda words, delta: F.when(has_any(low, words), F.lit(delta)).otherwise(F.lit(0.0))
    return clamp(F.lit(0.5) + step(V.PRODUCTION_WORDS, 0.2) + step(V.TEST_RISK_WORDS, -0.3) + step(V.KEY_WORDS, 0.3),
                 0.0, 1.0)


def temporal_risk(found_at: Column, crypto_type: Column, as_of: Column) -> Column:
    """Newer findings and urgent types weigh more; the clock is a parameter."""
    age = as_of.cast("timestamp").cast("double") - found_at.cast("timestamp").cast("double")
    recent = first_match([(age < 24 * 3600, 0.2), (age < 7 * 24 * 3600, 0.1)], 0.0)
    urgent = F.when(F.lower(crypto_type).isin(V.URGENT_TYPES), F.lit(0.3)).otherwise(F.lit(0.0))
    return clamp(F.lit(0.5) + recent + urgent, 0.0, 1.0)


def finding_risk(found_at: Column, as_of: Column) -> Column:
    w = V.RISK_FACTORS
    total = (algorithm_risk(F.col("algorithm")) * w["algorithm"] + S.risk_value(F.col("severity")) * w["severity"]
             + F.col("confidence") * w["confidence"] + context_risk(F.col("context")) * w["context"]
             + temporal_risk(found_at, F.col("crypto_type"), as_of) * w["temporal"])
    return total / sum(w.values())


def with_risk(findings: DataFrame, found_at: Column, as_of: Column) -> DataFrame:
    return findings.withColumns({"risk": finding_risk(found_at, as_of), "risk_weight": S.risk_value(F.col("severity"))})


def overall_risk_expr(risk: Column = None, weight: Column = None) -> Column:
    """Aggregate expression: weighted mean, 0-100, damped for few findings; empty is 0."""
    risk = F.col("risk") if risk is None else risk
    weight = F.col("risk_weight") if weight is None else weight
    # least() skips nulls, so the empty group is told apart before it
    mean = F.sum(risk * weight) / F.nullif(F.sum(weight), F.lit(0.0))
    score = F.coalesce(mean, F.lit(0.0)) * 100 * (1.0 - F.exp(-F.count(risk) / 10.0))
    return F.least(F.lit(100.0), score)


def overall_risk(scored: DataFrame, *group: str) -> DataFrame:
    agg = [overall_risk_expr().alias("overall_risk"), F.count("*").alias("n_findings")]
    return scored.groupBy(*group).agg(*agg) if group else scored.agg(*agg)


def risk_by_category(scored: DataFrame) -> DataFrame:
    """Six fixed categories, everything else counts as library, empty ones are 0."""
    low = F.lower("crypto_type")
    cat = F.when(low.isin(V.RISK_CATEGORIES), low).otherwise(F.lit("library"))
    got = scored.withColumn("category", cat).groupBy("category").agg(
        overall_risk_expr().alias("risk_score"), F.count("*").alias("n_findings"))
    dims = dimension(scored.sparkSession, [{"category": c} for c in V.RISK_CATEGORIES], "category string")
    return (dims.join(F.broadcast(got), "category", "left")
            .select("category", F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
                    F.coalesce("n_findings", F.lit(0).cast("bigint")).alias("n_findings")))


def risk_trend(scored: DataFrame, batch: str) -> DataFrame:
    """Overall risk per historical batch, with the change against the one before."""
    per = scored.groupBy(batch).agg(overall_risk_expr().alias("overall_risk"), F.count("*").alias("n_findings"))
    w = Window.orderBy(batch)  # one row per batch: small by construction
    return per.withColumn("delta", F.col("overall_risk") - F.lag("overall_risk").over(w))


def heat_map(scored: DataFrame) -> DataFrame:
    return scored.select("path", "line", (F.col("risk") * 100).alias("risk_score"), "crypto_type", "algorithm",
                         "severity", F.col("message").alias("description"))


def heat_map_rollup(scored: DataFrame, bucket_lines: int = 50) -> DataFrame:
    """Mean and maximum risk per file and block of lines."""
    block = F.floor((F.col("line") - 1) / bucket_lines).cast("bigint")
    return (scored.withColumn("line_block", block).groupBy("path", "line_block")
            .agg((F.max("risk") * 100).alias("max_risk"), (F.avg("risk") * 100).alias("avg_risk"),
                 F.count("*").alias("n_findings")))


ADVICE = {"RSA": "Move RSA to ML-KEM or a hybrid scheme", "ECDSA": "Replace ECDSA signatures by ML-DSA",
          "MD5": "Replace MD5 by SHA-256 or SHA-3 at once", "SHA1": "Move SHA-1 to SHA-256 or newer"}
RISK_ADVICE = [(80, "High risk: plan the migration now and use hybrid schemes"),
               (60, "Medium-high risk: set a timeline and test post-quantum schemes"),
               (40, "Medium risk: start to evaluate post-quantum schemes")]
LOW_ADVICE = "Low risk: keep monitoring"


def risk_recommendations(scored: DataFrame) -> DataFrame:
    """Ordered advice from algorithm counts and the overall risk."""
    one = scored.agg(overall_risk_expr().alias("overall"),
                     *[F.count_if(F.col("algorithm") == a).alias(a) for a in ADVICE])
    items = [F.when(F.col(a) > 0, F.lit(text)) for a, text in ADVICE.items()]
    items.append(first_match([(F.col("overall") > t, text) for t, text in RISK_ADVICE]))
    found = F.array_compact(F.array(*items))
    out = F.when(F.size(found) == 0, F.array(F.lit(LOW_ADVICE))).otherwise(found)
    return one.select(F.posexplode(out).alias("seq", "recommendation"))


def summary_risk(findings: DataFrame) -> DataFrame:
    """Weighted count over the weights of the distinct severities (can exceed 1)."""
    per = findings.groupBy("severity").agg(F.count("*").alias("n"))
    w = S.summary_weight(F.col("severity"))
    return per.agg(F.coalesce(F.sum(F.col("n") * w) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0)).alias("risk_score"),
                   F.coalesce(F.sum("n"), F.lit(0)).alias("total_findings"))


def calculator_risk(findings: DataFrame) -> DataFrame:
    """A sum divided by itself: 1 when anything weighs, else 0."""
    w = S.summary_weight(F.col("severity")) * S.calculator_type_weight(F.col("crypto_type"))
    return findings.agg(F.coalesce(F.sum(w) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0)).alias("risk_score"))


def calculator_confidence() -> Column:
    ctx_len = F.octet_length("context")
    ctx = first_match([(F.col("context") == "", 0.5), (ctx_len > 200, 1.0), (ctx_len > 100, 0.8), (ctx_len > 50, 0.6)], 0.4)
    alg = first_match([(F.col("algorithm") == "", 0.5), (F.col("key_size") > 0, 1.0),
                       (has_any(F.lower("algorithm"), ["aes", "rsa", "ecdsa", "sha"]), 0.9)], 0.7)
    total = (S.summary_weight(F.col("severity")) * 0.3 + S.calculator_type_weight(F.col("crypto_type")) * 0.3
             + ctx * 0.2 + alg * 0.2)
    return clamp(total, 0.0, 1.0)


def risk_band(score: Column) -> Column:
    """Band shown on a pull request."""
    return first_match([(score > 70, "High"), (score > 40, "Medium")], "Low")


def register_sql_functions(spark: SparkSession) -> None:
    """``overall_risk_score(weighted_sum, weight_sum, n)`` as a SQL function; it stays in Catalyst."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION overall_risk_score(weighted DOUBLE, weights DOUBLE, n BIGINT)
                 RETURNS DOUBLE
                 RETURN least(100.0D, coalesce(weighted / nullif(weights, 0.0D), 0.0D) * 100 * (1.0D - exp(-n / 10.0D)))""")
