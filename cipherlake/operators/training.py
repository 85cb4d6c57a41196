"""Supervised models on findings: features, encoding, training, metrics, prediction."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.functions import paths as P
from cipherlake.functions.text import first_match, has_any
from cipherlake.operators import encoding, splitting
from cipherlake.session import checkpoint

CATEGORICAL = ["algorithm", "severity", "crypto_type", "language", "rule_id", "file_extension"]
NUMERIC = ["confidence", "line_number", "file_path_depth", "filename_length", "pattern_complexity"]
FLAGS = ["is_test_file", "is_crypto_library", "is_low_level", "has_function_call", "has_import_statement", "is_hash_algorithm",
         "is_symmetric_crypto", "is_asymmetric_crypto", "is_legacy_algorithm", "is_modern_algorithm", "is_critical", "is_high",
         "is_medium", "is_low", "is_info", "is_c_cpp", "is_high_level_lang", "is_systems_lang"]
LABELS = ["finding_id", "ai_is_valid", "ai_confidence", "ai_severity", "has_ai_evaluation"]


def file_extension(path: Column, whole_path: bool = False) -> Column:
    """What follows the last dot of the base name, ``unknown`` without one; with ``whole_path`` of the whole path, where
    a file without a dot is its own extension."""
    if whole_path:
        return F.element_at(F.split(path, "\\."), -1)
    name = P.base_name(path)
    return F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise(F.lit(encoding.UNKNOWN))


def training_features(findings: DataFrame, extension_of_path: bool = False) -> DataFrame:
    """The 29 features of a finding, plus its id and any label columns."""
    path, low = F.col("path"), F.lower("path")
    pattern = F.coalesce(F.col("pattern"), F.lit("")) if "pattern" in findings.columns else F.lit("")
    lang, sev, typ, alg = F.col("language"), F.col("severity"), F.col("crypto_type"), F.col("algorithm")
    cols = {
        "algorithm": alg, "severity": sev, "confidence": F.col("confidence"), "crypto_type": typ, "language": lang,
        "rule_id": F.col("rule_id"), "line_number": F.col("line"),
        "file_extension": file_extension(path, extension_of_path), "file_path_depth": P.depth(path),
        "filename_length": F.length(P.base_name(path)),
        "is_test_file": low.contains("test"), "is_crypto_library": has_any(low, ["crypto", "ssl", "tls", "hash"]),
        "is_low_level": path.rlike(r"\.(?:c|cpp|h|hpp)$"), "pattern_complexity": F.length(pattern),
        "has_function_call": pattern.contains("("), "has_import_statement": F.lower(pattern).contains("import"),
        "is_hash_algorithm": typ == "hash", "is_symmetric_crypto": typ == "symmetric", "is_asymmetric_crypto": typ == "asymmetric",
        "is_legacy_algorithm": alg.isin("md5", "sha1", "des", "rc4"), "is_modern_algorithm": alg.isin("sha256", "sha512", "aes", "chacha20"),
        **{f"is_{s}": sev == s for s in ("critical", "high", "medium", "low", "info")},
        "is_c_cpp": lang.isin("c", "cpp", "c++"), "is_high_level_lang": lang.isin("python", "java", "javascript", "go"),
        "is_systems_lang": lang.isin("c", "cpp", "rust", "go")}
    labels = [c for c in LABELS if c in findings.columns]
    return findings.select(*labels, *[c.alias(n) for n, c in cols.items()])


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in LABELS]


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=[f"{c}_code" for c in CATEGORICAL] + NUMERIC + FLAGS, outputCol="features", handleInvalid="keep")


def fit_encoder(df: DataFrame) -> DataFrame:
    """The label table of the six categorical features."""
    return encoding.fit_labels(df, CATEGORICAL)


def _clean(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(encoding.UNKNOWN)) for c in CATEGORICAL}
                          | {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMERIC + FLAGS})


def encode(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Codes of the categorical features by the label table (an unseen label is 0), missing numbers as 0, and the
    feature vector."""
    return _assembler().transform(encoding.encode_labels(_clean(df), labels, CATEGORICAL))


def split(df: DataFrame, label: str = "label", test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; of each label the test part has its share, rounded to whole rows."""
    marked = splitting.stratified(df, label, "finding_id", test_share, seed, "_is_test")
    return tuple(marked.filter(c).drop("_is_test") for c in (~F.col("_is_test"), F.col("_is_test")))


def confidence_band(c: Column) -> Column:
    """(0, .5] low, (.5, .8] medium, (.8, 1] high; anything else is null and dropped."""
    return first_match([((c > 0) & (c <= 0.5), "low"), ((c > 0.5) & (c <= 0.8), "medium"), ((c > 0.8) & (c <= 1.0), "high")])


def _fit(name: str, df: DataFrame, estimator, evaluator, folds: int, seed: int = 42) -> dict:
    df = checkpoint(df)  # the fits read it many times
    train, test = split(df, seed=seed)
    model = estimator.fit(train)
    pred = model.transform(test)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=ParamGridBuilder().build(), evaluator=evaluator, numFolds=folds,
                        seed=seed, parallelism=2).fit(df)
    accuracy = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    return {"name": name, "model": model, "accuracy": accuracy.evaluate(pred), "score": evaluator.evaluate(pred),
            "cv_mean": float(cv.avgMetrics[0]), "cv_std": float(cv.stdMetrics[0]) if cv.stdMetrics else 0.0,
            "training_samples": train.count(), "test_samples": test.count(), "confusion": confusion(pred)}


def train_validity_model(encoded: DataFrame, folds: int = 5) -> dict:
    """Logistic regression: is an evaluated finding valid?"""
    df = encoded.filter("has_ai_evaluation").withColumn("label", F.col("ai_is_valid").cast("double"))
    return _fit("validity", df, LogisticRegression(maxIter=1000), BinaryClassificationEvaluator(labelCol="label"), folds)


def _forest(encoded: DataFrame, target: Column, name: str, trees: int, folds: int) -> dict:
    df = encoded.filter("has_ai_evaluation").withColumn("target", target).filter(F.col("target").isNotNull())
    classes = encoding.fit_labels(df, ["target"])
    ev = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    coded = encoding.encode_labels(df, classes, ["target"]).withColumnRenamed("target_code", "label")
    out = _fit(name, coded, RandomForestClassifier(numTrees=trees, seed=42), ev, folds)
    return {**out, "labels": [r["label"] for r in classes.orderBy("code").collect()]}  # the classes of a forest: a handful


def train_confidence_model(encoded: DataFrame, trees: int = 100, folds: int = 5) -> dict:
    return _forest(encoded, confidence_band(F.col("ai_confidence")), "confidence", trees, folds)


def train_severity_model(encoded: DataFrame, trees: int = 100) -> dict:
    classes = encoded.filter("has_ai_evaluation").select(F.count_distinct("ai_severity")).first()[0]
    return _forest(encoded, F.col("ai_severity"), "severity", trees, max(2, min(5, classes)))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def class_metrics(confusion_counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class, from the small confusion table."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    by_true = confusion_counts.groupBy("label").agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_pred = confusion_counts.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    j = by_true.join(by_pred, "label", "full_outer").fillna(0)
    p = F.coalesce(F.col("tp") / F.nullif("predicted", F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("tp") / F.nullif("support", F.lit(0)), F.lit(0.0))
    return j.select("label", p.alias("precision"), r.alias("recall"),
                    F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"), "support")


def feature_importance(model, spark) -> DataFrame:
    values = model.coefficients if hasattr(model, "coefficients") else model.featureImportances
    names = [f"{c}_code" for c in CATEGORICAL] + NUMERIC + FLAGS
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values.toArray())], "feature string, importance double")


def report_rows(spark, results: list[dict]) -> DataFrame:
    keys = ["accuracy", "score", "cv_mean", "cv_std", "training_samples", "test_samples"]
    return spark.createDataFrame([(r["name"], k, float(r[k])) for r in results for k in keys], "model string, metric string, value double")


def predict(encoded: DataFrame, validity, confidence: dict | None = None, severity: dict | None = None) -> DataFrame:
    """Batch prediction: false-positive flag and its certainty, confidence level, severity."""
    from pyspark.ml.functions import vector_to_array

    out = validity.transform(encoded)
    p = vector_to_array("probability")
    out = out.withColumns({"is_false_positive": p[0] > 0.5, "false_positive_confidence": F.greatest(p[0], p[1])})
    out = out.drop("rawPrediction", "probability", "prediction")
    for res, name in ((confidence, "confidence_level"), (severity, "adjusted_severity")):
        if res is not None:
            labels = F.array(*[F.lit(x) for x in res["labels"]])
            out = res["model"].transform(out).withColumn(name, F.element_at(labels, F.col("prediction").cast("int") + 1)) \
                .drop("rawPrediction", "probability", "prediction")
    return out


def save(encoder: DataFrame, results: list[dict], report: DataFrame, target: str) -> None:
    encoder.write.mode("overwrite").parquet(f"{target}/encoder")
    for r in results:
        PipelineModel([r["model"]]).write().overwrite().save(f"{target}/{r['name']}")
    report.write.mode("overwrite").parquet(f"{target}/report")


def load(spark: SparkSession, target: str, names: list[str]) -> tuple[DataFrame, dict[str, PipelineModel]]:
    return spark.read.parquet(f"{target}/encoder"), {n: PipelineModel.load(f"{target}/{n}") for n in names}
