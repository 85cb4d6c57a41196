"""Migration: alternatives, strategies, template choice and patch text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.functions import paths as P
from cipherlake.functions.text import dimension

TEMPLATE_DDL = "name string, template string"


def default_templates(spark: SparkSession) -> DataFrame:
    """Built-in templates; add rows of your own with ``unionByName``.  Placeholders: {{.Name}}."""
    head = "--- {{.File}}\n+++ {{.File}}\n@@ line {{.Line}}, column {{.Column}} @@\n"
    rows = [
        {"name": "go_asymmetric_rsa", "template": head + "- {{.Algorithm}} key pair\n+ {{.PQAlternative}} key encapsulation, hybrid first\n# {{.MigrationStrategy}}\n"},
        {"name": "go_signature_ecdsa", "template": head + "- {{.Algorithm}} signature\n+ {{.PQAlternative}} signature, hybrid first\n# {{.MigrationStrategy}}\n"},
        {"name": "go_generic", "template": head + "- {{.Algorithm}} ({{.CryptoType}})\n+ {{.PQAlternative}}\n# {{.MigrationStrategy}}\n"},
        {"name": "generic", "template": head + "- {{.Algorithm}} in {{.Language}}\n+ {{.PQAlternative}}\n# {{.MigrationStrategy}}\n"},
    ]
    return dimension(spark, rows, TEMPLATE_DDL)


def load_templates(spark: SparkSession, path: str) -> DataFrame:
    """Templates from files; both suffixes of ``name.patch.tpl`` are cut."""
    raw = spark.read.option("wholetext", True).text(path)
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(\.patch)?\.tpl$", "")
    return raw.select(name.alias("name"), F.col("value").alias("template"))


def with_alternative(findings: DataFrame) -> DataFrame:
    """Post-quantum alternative by algorithm and strategy by (algorithm, language), with defaults."""
    spark = findings.sparkSession
    alt = dimension(spark, [{"a_key": k, "alternative": v} for k, v in V.PQ_ALTERNATIVES.items()], "a_key string, alternative string")
    strat = dimension(spark, [{"s_alg": a, "s_lang": lang, "strategy": t} for (a, lang), t in V.MIGRATION_STRATEGIES.items()],
                      "s_alg string, s_lang string, strategy string")
    up = F.upper("algorithm")
    df = findings.withColumn("patch_language", P.language(F.col("path"), "patch"))
    df = df.join(F.broadcast(alt), up == F.col("a_key"), "left")
    df = df.join(F.broadcast(strat), (up == F.col("s_alg")) & (F.col("patch_language") == F.col("s_lang")), "left")
    return df.withColumns({
        "pq_alternative": F.coalesce("alternative", F.lit(V.PQ_ALTERNATIVE_DEFAULT)),
        "migration_strategy": F.coalesce("strategy", F.format_string("Migrate %s to post-quantum alternative", "algorithm")),
    }).drop("a_key", "alternative", "s_alg", "s_lang", "strategy")


def choose_template(findings: DataFrame, templates: DataFrame) -> DataFrame:
    """First existing template of language_type_algorithm, language_type, language_generic, generic.

    The names are a small dimension: they are read into one array and the first candidate in it
    wins, so findings are neither exploded nor shuffled."""
    lang, kind, alg = F.col("patch_language"), F.col("crypto_type"), F.lower("algorithm")
    cands = F.array(F.concat_ws("_", lang, kind, alg), F.concat_ws("_", lang, kind), F.concat(lang, F.lit("_generic")), F.lit("generic"))
    names = templates.agg(F.collect_set("name").alias("names")).scalar()
    known = findings.withColumn("_names", names)
    chosen = F.get(F.filter(cands, lambda c: F.array_contains(F.col("_names"), c)), F.lit(0))
    return known.withColumn("template_name", chosen).drop("_names")


VARIABLES = {"File": "path", "Language": "patch_language", "Algorithm": "algorithm", "CryptoType": "crypto_type", "Line": "line",
             "Column": "col", "PQAlternative": "pq_alternative", "MigrationStrategy": "migration_strategy"}


def render_patches(findings: DataFrame, templates: DataFrame, variables: dict[str, str] | None = None) -> DataFrame:
    """One patch text per finding that has a template."""
    df = choose_template(with_alternative(findings), templates)
    df = df.join(templates.withColumnRenamed("name", "template_name"), "template_name")
    text = F.col("template")
    for name, col in VARIABLES.items():
        text = F.replace(text, F.lit("{{." + name + "}}"), F.col(col).cast("string"))
    for name, value in (variables or {}).items():
        text = F.replace(text, F.lit("{{." + name + "}}"), F.lit(value))
    return df.withColumn("patch", text).withColumn(
        "description", F.format_string("Patch for %s, written in %s", "algorithm", "patch_language")).drop("template")


def validate_templates(templates: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Placeholders of each template that nothing fills."""
    known = list(VARIABLES) if known is None else known
    found = F.regexp_extract_all("template", F.lit(r"\{\{\s*\.?(\w*)[^}]*\}\}"), F.lit(1))
    missing = F.array_except(found, F.array(*[F.lit(k) for k in known]))
    return templates.select("name", F.array_sort(missing).alias("unfilled"), (F.size(missing) == 0).alias("valid"))


def migration_plan(findings: DataFrame) -> DataFrame:
    """Recommended schemes, hybrids, timeline and effort of every finding that has a path."""
    from cipherlake.operators.classify import with_migration

    out = with_migration(findings, "algorithm").filter(F.col("recommended").isNotNull())
    return out.select("finding_id", "path", "line", "algorithm", "recommended_text", F.array_join("hybrid", ", ").alias("hybrid_text"),
                      "timeline", "effort", F.coalesce("keygen_slowdown", F.lit("")).alias("keygen_slowdown"))
