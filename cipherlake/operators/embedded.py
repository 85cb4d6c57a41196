"""Scoring with fixed coefficients and with model tables, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.functions import paths as P
from cipherlake.functions.text import first_match, has_any, lookup


def model_input(findings: DataFrame) -> DataFrame:
    """The eleven fields a scorer sees."""
    pattern = F.col("pattern") if "pattern" in findings.columns else F.col("match_text")
    return findings.select("finding_id", "algorithm", "severity", "confidence", "crypto_type",
                           P.language(F.col("path"), "scan").alias("language"), "rule_id", F.col("line").cast("double").alias("line"),
                           F.col("path").alias("file"), F.coalesce(pattern, F.lit("")).alias("pattern"), "message", "context")


def pattern_text(metadata: Column) -> Column:
    return F.coalesce(F.element_at(metadata, "pattern"), F.element_at(metadata, "match_text"), F.lit(""))


def label_code(name: str, value: Column) -> Column:
    return lookup({v: float(i) for i, v in enumerate(V.LABEL_CODES[name])}, value, 0.0)


def _b(cond: Column) -> Column:
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def scorer_features() -> list[Column]:
    """The first 29 features of the embedded scorers, duplicate codes as defined there."""
    file, pattern, low = F.col("file"), F.col("pattern"), F.lower("file")
    alg, sev, typ, lang = (label_code(n, F.col(n)) for n in ("algorithm", "severity", "crypto_type", "language"))
    ext = F.when(file.contains("."), F.element_at(F.split(file, "\\."), -1)).otherwise(F.lit("unknown"))
    c_like = file.rlike(r"\.(?:c|cpp|h|hpp)$")
    return [alg, sev, F.col("confidence"), typ, lang, label_code("rule_id", F.col("rule_id")), F.col("line"),
            label_code("file_extension", ext), F.size(F.split(file, "/")).cast("double"), F.octet_length(file).cast("double"),
            _b(low.contains("test")), _b(has_any(low, ["crypto", "ssl", "tls", "hash"])), _b(c_like),
            F.octet_length(pattern).cast("double"), _b(pattern.contains("(")), _b(F.lower(pattern).contains("import")),
            _b(typ == 2), _b(typ == 1), _b(typ == 0), _b(alg.isin(4.0, 5.0, 6.0, 10.0)), _b(alg.isin(0.0, 1.0, 6.0, 7.0)),
            _b(sev == 0), _b(sev == 1), _b(sev == 2), _b(sev == 3), _b(sev == 4),
            _b(lang == 0), _b(lang.isin(1.0, 4.0, 5.0, 8.0)), _b(lang.isin(0.0, 5.0))]


def _dot(features: list[Column], weights: list[float], start: float = 0.0) -> Column:
    total = F.lit(start)
    for x, w in zip(features, weights):
        total = total + x * F.lit(w)
    return total


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logistic_score(features: list[Column]) -> Column:
    return sigmoid(_dot(features, V.LR_COEFFICIENTS, V.LR_INTERCEPT))


def importance_class(features: list[Column], importances: list[float], classes: list[str]) -> Column:
    return F.when(_dot(features, importances) > 0.5, F.lit(classes[-1])).otherwise(F.lit(classes[0]))


def embedded_predictions(inputs: DataFrame) -> DataFrame:
    """Validity score and the two class predictions for every input row."""
    f = scorer_features()
    return inputs.withColumns({
        "ml_false_positive_score": logistic_score(f), "ml_confidence_class": importance_class(f, V.CONFIDENCE_IMPORTANCES, V.CONFIDENCE_CLASSES),
        "ml_predicted_severity": importance_class(f, V.SEVERITY_IMPORTANCES, V.SEVERITY_CLASSES)}) \
        .withColumn("ml_is_likely_valid", F.col("ml_false_positive_score") > 0.5)


def apply_predictions(predicted: DataFrame) -> DataFrame:
    """Halve the confidence below 0.3, raise it by a fifth (at most 1) above 0.8; note severity advice."""
    s, conf, sev, guess = F.col("ml_false_positive_score"), F.col("confidence"), F.col("severity"), F.col("ml_predicted_severity")
    return predicted.withColumns({
        "adjusted_confidence": first_match([(s < 0.3, conf * 0.5), (s > 0.8, F.least(F.lit(1.0), conf * 1.2))], conf),
        "ml_adjustment": first_match([(s < 0.3, "confidence_reduced_likely_fp"), (s > 0.8, "confidence_boosted_likely_valid")]),
        "ml_severity_suggestion": first_match([((guess == "critical") & (sev != "critical"), "consider_upgrading_to_critical"),
                                               ((guess == "info") & (sev == "high"), "consider_downgrading_from_high")])})


def tree_score(tree: dict | None, features: Column, n_features: int) -> Column:
    """A decision tree as nested CASE.  Nodes: {"value": v} or {"feature": i, "threshold": t,
    "left": node, "right": node}; a missing branch or feature gives 0.5."""
    if tree is None:
        return F.lit(0.5)
    if "value" in tree:
        return F.lit(float(tree["value"]))
    i = tree["feature"]
    if i >= n_features:
        return F.lit(0.5)
    return (F.when(features[i] <= F.lit(float(tree["threshold"])), tree_score(tree.get("left"), features, n_features))
            .otherwise(tree_score(tree.get("right"), features, n_features)))


def forest_score(trees: list[dict], features: Column, n_features: int) -> Column:
    if not trees:
        return F.lit(0.5)
    total = F.lit(0.0)
    for t in trees:
        total = total + tree_score(t, features, n_features)
    return total / len(trees)


def linear_score(weights: list[float], bias: float, features: Column) -> Column:
    """Linear model through a sigmoid; 0.5 when the feature count differs."""
    terms = [features[i] for i in range(len(weights))]
    return F.when(F.size(features) != len(weights), F.lit(0.5)).otherwise(sigmoid(_dot(terms, weights, bias)))


def with_fallback(*scores: Column) -> Column:
    """The first score strictly between 0 and 1, else 0.5."""
    return F.coalesce(*[F.when((s > 0) & (s < 1), s) for s in scores], F.lit(0.5))
