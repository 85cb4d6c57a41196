"""Context score: eight weighted context features, algorithm, severity and library factors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.functions import paths as P
from cipherlake.functions.text import clamp, first_match, has_any, has_any_lower, lookup

# A feature takes the row's columns (context, path, is_test, is_vendored, library_mode) by name.
Feature = Callable[[dict[str, Column]], Column]


def f_function_call(r):
    ctx = r["context"]
    call = ctx.contains("(") & ctx.contains(")")
    return first_match([(call & has_any(ctx, V.CALL_WORDS), 1.0), (call, 0.7)], 0.0)


def f_crypto_library(r):
    return first_match([(r["library_mode"] | has_any_lower(r["context"], V.LIBRARY_WORDS), 1.0)], 0.0)


def f_library_implementation(r):
    low, path = F.lower(r["context"]), F.lower(r["path"])
    hits = lambda words: sum((low.contains(w).cast("double") for w in words if w == w.lower()), F.lit(0.0))
    score = hits(V.HIGH_IMPLEMENTATION_WORDS) * 0.15 + hits(V.MEDIUM_IMPLEMENTATION_WORDS) * 0.08
    for suffixes, words in V.LANGUAGE_IMPLEMENTATION_WORDS:
        mine = F.lit(False)
        for s in suffixes:
            mine = mine | path.endswith(s)
        score = score + F.when(mine, hits(words) * 0.1).otherwise(0.0)
    return F.when(r["library_mode"], F.least(F.lit(1.0), score)).otherwise(0.0)


def f_assignment(r):
    return first_match([(has_any(r["context"], V.ASSIGNMENT_WORDS), 0.8)], 0.0)


def f_import(r):
    return first_match([(has_any_lower(r["context"], V.IMPORT_WORDS), 0.9)], 0.0)


def f_comment(r):
    ctx = r["context"]
    return first_match([(has_any(ctx, V.COMMENT_MARKS), 1.0), (has_any_lower(ctx, V.DOCUMENT_WORDS), 0.5)], 0.0)


def f_test_file(r):
    low = F.lower(r["context"])
    weak = sum((low.contains(w).cast("int") for w in V.WEAK_TEST_WORDS), F.lit(0))
    own_tests = has_any(F.lower(r["path"]), V.DETECTION_TEST_PARTS)
    return first_match([
        (r["is_test"] & own_tests, 0.0), (r["is_test"], 0.3), (has_any(low, V.STRONG_TEST_WORDS), 0.8),
        (weak >= 2, 0.4), ((weak == 1) & has_any(low, V.IMPLEMENTATION_WORDS), 0.0), (weak == 1, 0.2)], 0.0)


def f_vendor_code(r):
    low = F.lower(r["context"])
    return first_match([(r["is_vendored"], 1.0), (r["library_mode"] & has_any(low, V.LIBRARY_CODE_WORDS), 0.8),
                        (r["library_mode"], 0.0), (has_any(low, V.VENDOR_WORDS), 0.8)], 0.0)


# name -> (weight, feature); extend with ``register_feature``
FEATURES: dict[str, tuple[float, Feature]] = {
    "function_call_context": (V.FEATURE_WEIGHTS["function_call_context"], f_function_call),
    "crypto_library_context": (V.FEATURE_WEIGHTS["crypto_library_context"], f_crypto_library),
    "library_implementation_context": (V.FEATURE_WEIGHTS["library_implementation_context"], f_library_implementation),
    "variable_assignment": (V.FEATURE_WEIGHTS["variable_assignment"], f_assignment),
    "import_context": (V.FEATURE_WEIGHTS["import_context"], f_import),
    "comment_proximity": (V.FEATURE_WEIGHTS["comment_proximity"], f_comment),
    "test_file_context": (V.FEATURE_WEIGHTS["test_file_context"], f_test_file),
    "vendor_code_context": (V.FEATURE_WEIGHTS["vendor_code_context"], f_vendor_code),
}


def register_feature(name: str, weight: float, feature: Feature) -> None:
    FEATURES[name] = (weight, feature)


def library_reputation(context: Column) -> Column:
    low = F.lower(context)
    scores = [F.when(low.contains(k), F.lit(v)).otherwise(F.lit(0.0)) for k, v in V.LIBRARY_REPUTATION.items()
              if v > V.LIBRARY_REPUTATION_FLOOR]
    return F.greatest(F.lit(V.LIBRARY_REPUTATION_FLOOR), *scores)


def band(confidence: Column, suffix: str = "") -> Column:
    return first_match([(confidence >= floor, name + suffix) for name, floor in V.CONFIDENCE_BANDS[:-1]],
                       V.CONFIDENCE_BANDS[-1][0] + suffix)


def relax_severity(severity: Column, confidence: Column) -> Column:
    """Low confidence takes one step off critical and high findings."""
    low = (confidence > 0.1) & (confidence < 0.3)
    return first_match([(low & (severity == "critical"), "high"), (low & (severity == "high"), "medium")], severity)


def sticky_library_mode(files: DataFrame) -> DataFrame:
    """Library mode that, once a library path is met in walk order, stays on for later files.
    Equal to a running maximum, but needs only the first library path: one small aggregate."""
    order = F.split("path", "/")
    first = files.filter(P.library_name(F.col("path")).isNotNull()).agg(F.min(order).alias("first_library"))
    return files.withColumn("library_mode", F.coalesce(order >= first.scalar(), F.lit(False)))


def score_findings(findings: DataFrame, features: dict[str, tuple[float, Feature]] | None = None,
                   vendor_weight: float | None = None, library_mode: bool | None = None) -> DataFrame:
    """Replace confidence and severity by the context score.  Library mode follows the file's
    own path unless the caller fixes it or brings a ``library_mode`` column."""
    features = dict(FEATURES if features is None else features)
    if vendor_weight is not None:
        features["vendor_code_context"] = (vendor_weight, features["vendor_code_context"][1])
    if library_mode is not None:
        findings = findings.withColumn("library_mode", F.lit(library_mode))
    elif "library_mode" not in findings.columns:
        findings = findings.withColumn("library_mode", P.library_name(F.col("path")).isNotNull())
    path = F.col("path")
    if "is_test" not in findings.columns:
        findings = findings.withColumns({"is_test": P.is_test(path), "is_vendored": P.is_vendored(path)})
    row = {c: F.col(c) for c in findings.columns}
    scored = findings.withColumns({f"feature_{n}": f(row) for n, (_, f) in features.items()})
    total = F.lit(0.5)
    for n, (weight, _) in features.items():
        total = total + F.col(f"feature_{n}") * weight
    total = (total * lookup(V.ML_ALGORITHM_WEIGHT, F.col("algorithm"), 1.0)
             * lookup(V.ML_SEVERITY_FACTOR, F.col("severity"), 1.0) * library_reputation(F.col("context"))
             + lookup(V.STAGE_BOOST, F.col("stage"), 0.0))
    return (scored.withColumn("ml_confidence", clamp(total, 0.0, 1.0))
            .withColumns({"severity": relax_severity(F.col("severity"), F.col("ml_confidence")),
                          "confidence": F.col("ml_confidence"),
                          "ml_prediction": band(F.col("ml_confidence"), "_confidence")}))


def score_metadata(scored: DataFrame) -> DataFrame:
    """The score as text entries merged into a metadata map."""
    pairs = [F.lit("ml_confidence"), F.format_string("%.3f", "ml_confidence"), F.lit("ml_prediction"), F.col("ml_prediction")]
    for n in FEATURES:
        pairs += [F.lit(f"ml_feature_{n}"), F.format_string("%.3f", F.col(f"feature_{n}"))]
    base = F.create_map(F.lit("stage"), F.col("stage"), F.lit("match_text"), F.col("match_text"))
    return scored.withColumn("metadata", F.map_concat(base, F.create_map(*pairs)))


def confidence_distribution(findings: DataFrame) -> DataFrame:
    """Count per band, bands without findings included; one pass, no group shuffle of rows."""
    b = band(F.col("confidence"))
    counts = findings.agg(*[F.count_if(b == n).alias(n) for n, _ in V.CONFIDENCE_BANDS])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("band"), F.col(n).alias("n_findings"))
                                            for n, _ in V.CONFIDENCE_BANDS])))
