"""Sources of stored results: findings, baselines, evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING_DDL = ("id string, rule_id string, file string, line int, `column` int, message string, severity string,"
               " confidence double, crypto_type string, algorithm string, key_size int, language string, context string,"
               " suggestion string, pattern string, references array<string>, metadata map<string,string>, timestamp string")
ENVELOPE_DDL = (f"findings array<struct<{FINDING_DDL.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' array', ':array').replace(' map', ':map')}>>")
EVALUATION_FIELDS = ("finding_id:string,is_valid_finding:boolean,is_valid:boolean,confidence:double,severity:string,"
                     "priority:string,reasoning:string")
_F = ENVELOPE_DDL[len("findings "):]
OBJECT_DDL = f"crypto_findings {_F}, findings {_F}, results {_F}"


def _is_array(body: Column) -> Column:
    return F.ltrim(body).startswith("[")


def parse_findings(docs: DataFrame, body: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Findings from whole JSON documents of any of the four shapes: a bare array, or an object with
    ``crypto_findings``, ``findings`` or ``results``.  A null list gives no rows."""
    keys = keys or ["repo"]
    text = F.col(body)
    obj = F.from_json(F.when(~_is_array(text), text), OBJECT_DDL, {"mode": "PERMISSIVE"})
    arr = F.from_json(F.when(_is_array(text), text), _F, {"mode": "PERMISSIVE"})
    parsed = docs.select(*keys, obj.alias("o"), arr.alias("a"))
    items = F.coalesce("a", "o.crypto_findings", "o.findings", "o.results")
    return parsed.select(*keys, F.explode(items).alias("f")).filter(F.col("f").isNotNull()).select(*keys, "f.*")


def split_corrupt(docs: DataFrame, body: str = "value") -> tuple[DataFrame, DataFrame]:
    """Readable documents, and the others as an errors table."""
    ok = F.try_parse_json(F.col(body)).isNotNull()
    return docs.filter(ok), docs.filter(~ok).withColumn("error", F.lit("not valid JSON"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result documents of a directory; the file name gives the repository."""
    raw = spark.read.option("wholetext", True).text(path)
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(_scan_results)?\.json$", "")
    return raw.select(name.alias("repo"), "value")


BASELINE_ITEM = "array<struct<rule_id:string,file:string,line:int,expires:string>>"


def parse_baseline(docs: DataFrame, body: str = "value") -> DataFrame:
    """Baseline entries from either form: an object with ``suppressions`` or a bare array.
    A document that cannot be read gives no entries, so nothing is suppressed."""
    text = F.col(body)
    obj = F.from_json(F.when(~_is_array(text), text), f"suppressions {BASELINE_ITEM}", {"mode": "PERMISSIVE"})["suppressions"]
    arr = F.from_json(F.when(_is_array(text), text), BASELINE_ITEM, {"mode": "PERMISSIVE"})
    return docs.select(F.explode(F.coalesce(obj, arr)).alias("e")).filter(F.col("e").isNotNull()).select("e.*")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return parse_baseline(spark.read.option("wholetext", True).text(path))


def parse_evaluations(docs: DataFrame, body: str = "value") -> DataFrame:
    """Evaluations from a list or an object; either name of the validity flag."""
    item = f"array<struct<{EVALUATION_FIELDS}>>"
    text = F.col(body)
    obj = F.from_json(F.when(~_is_array(text), text), f"evaluations {item}", {"mode": "PERMISSIVE"})["evaluations"]
    arr = F.from_json(F.when(_is_array(text), text), item, {"mode": "PERMISSIVE"})
    rows = docs.select(F.explode(F.coalesce(obj, arr)).alias("e")).filter(F.col("e").isNotNull()).select("e.*")
    return rows.withColumn("is_valid", F.coalesce("is_valid_finding", "is_valid", F.lit(False))).drop("is_valid_finding")


def parse_responses(batches: DataFrame, body: str = "response") -> DataFrame:
    """Responses of an evaluator, one row per batch (batch_id, expected, response).

    The array is the text from the first ``[`` to the last ``]``.  Status: ``ok``, ``truncated``
    (too many items, the surplus is cut), ``incomplete`` (too few, the batch must be sent again)
    or ``unreadable``."""
    item = f"array<struct<{EVALUATION_FIELDS}>>"
    span = F.regexp_extract(F.col(body), r"(?s)\[.*\]", 0)
    items = F.from_json(F.nullif(span, F.lit("")), item, {"mode": "PERMISSIVE"})
    parsed = batches.withColumn("items", items)
    n = F.coalesce(F.size("items"), F.lit(-1))
    status = (F.when(n <= 0, F.lit("unreadable")).when(n < F.col("expected"), F.lit("incomplete"))
              .when(n > F.col("expected"), F.lit("truncated")).otherwise(F.lit("ok")))
    kept = F.when(status.isin("ok", "truncated"), F.slice("items", F.lit(1), F.col("expected").cast("int")))
    return parsed.select(*[c for c in batches.columns if c != body], status.alias("status"), kept.alias("items"))
