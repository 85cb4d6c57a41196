"""Rule tables: loading, selection, validation and statistics."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake import fixed_rules as R
from cipherlake import fixed_values as V
from cipherlake.functions.text import dimension

RULE_DDL = ("rule_id string, kind string, name string, pattern string, message string, severity string,"
            " crypto_type string, algorithm string, pq_replacement string, suggestion string,"
            " languages array<string>, priority int, enabled boolean, guards array<string>,"
            " tags map<string,string>, references array<string>")


@dataclass
class Rule:
    """One row of the rule table; also what the scan is built from at plan time."""

    rule_id: str
    pattern: str
    severity: str
    crypto_type: str = ""
    algorithm: str = ""
    kind: str = "regex"
    name: str = ""
    message: str = ""
    pq_replacement: str = ""
    suggestion: str = ""
    languages: list[str] = field(default_factory=list)
    priority: int = 3
    enabled: bool = True
    guards: list[str] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    references: list[str] = field(default_factory=list)


def _advice(severity: str, replacement: str) -> str:
    if replacement:
        return f"Plan a move to {replacement} or a hybrid of both."
    return {"critical": "Replace it now.", "high": "Replace it soon.", "medium": "Review and upgrade it.",
            "low": "Consider a longer digest."}.get(severity, "Review it when planning a migration.")


_PRIORITY = {"critical": 1, "high": 1, "medium": 2, "low": 2}
_REFERENCE = {"ML-KEM": "https://csrc.nist.gov/pubs/fips/203/final",
              "ML-DSA": "https://csrc.nist.gov/pubs/fips/204/final"}


def default_rules() -> list[Rule]:
    """The regular-expression rules."""
    out = []
    for rid, title, sev, ctype, alg, repl, langs, guards, pattern, tags in R.REGEX_RULES:
        refs = [url for key, url in _REFERENCE.items() if repl.startswith(key)]
        out.append(Rule(rule_id=rid, pattern=pattern, severity=sev, crypto_type=ctype, algorithm=alg,
                        name=title, message=f"{title} found. {_advice(sev, repl)}", pq_replacement=repl,
                        suggestion=_advice(sev, repl), languages=list(langs),
                        priority=_PRIORITY.get(sev, 3), guards=list(guards), tags=dict(tags),
                        references=refs))
    return out


def fast_rules() -> list[Rule]:
    """The built-in first-stage patterns; severity follows from the priority."""
    severity = {1: "medium", 2: "low", 3: "info"}
    return [Rule(rule_id=rid, kind="l0", pattern="(?i)" + pattern, severity=severity[prio],
                 crypto_type=category, name=rid, message=message, languages=list(langs), priority=prio,
                 guards=list(guards))
            for rid, category, prio, langs, guards, pattern, message in R.FAST_PATTERNS]


def structural_rules() -> list[Rule]:
    return [Rule(rule_id=rid, kind="structural", pattern=pattern, severity=sev, crypto_type=ctype,
                 algorithm=alg, name=title, message=f"{title} found. {_advice(sev, '')}",
                 suggestion=_advice(sev, ""), languages=[lang], tags=dict(tags))
            for rid, title, lang, sev, ctype, alg, pattern, tags in R.STRUCTURAL_RULES]


def l0_rules() -> list[Rule]:
    return fast_rules() + default_rules()


def rules_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The rule table as a small inline dimension (tens of rows, built on the driver)."""
    rules = default_rules() + structural_rules() if rules is None else rules
    return dimension(spark, [asdict(r) for r in rules], RULE_DDL)


def load_rules(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rules from JSON-lines files or directories; later paths add to earlier ones."""
    return (spark.read.schema(RULE_DDL).json(paths)
            .withColumn("enabled", F.coalesce("enabled", F.lit(True)))
            .filter("enabled"))


def combine_rules(*tables: DataFrame) -> DataFrame:
    """Rules of several sources as one table.  All are kept, also where they share an id: the scan tells rules apart
    by their place, and their findings by message."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


RULES_IN_PLAN = 1_000


def rules_from_table(table: DataFrame) -> list[Rule]:
    """Bring a rule table to the driver to build a scan from it.  A rule table is written by hand, so its size is
    checked instead of assumed; ``scan.scan_rules`` takes tables of any size."""
    rows = table.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a rule table of more than 10,000 rows isn't unrolled; scan.scan_rules and scan.rule_scan_table take it as a table")
    names = Rule.__dataclass_fields__
    out = []
    for row in rows:
        values = {k: v for k, v in row.asDict(recursive=True).items() if k in names and v is not None}
        rule = Rule(**values)
        rule.priority = values.get("priority") or _PRIORITY.get(rule.severity.lower(), 3)
        out.append(rule)
    return out


def select_rules(rules: DataFrame, enabled_ids: DataFrame | None = None,
                 disabled_ids: DataFrame | None = None) -> DataFrame:
    """A disabled id always wins; with no enabled list every other rule stays."""
    out = rules
    if disabled_ids is not None:
        out = out.join(disabled_ids.select("rule_id").distinct(), "rule_id", "left_anti")
    if enabled_ids is not None:
        out = out.join(enabled_ids.select("rule_id").distinct(), "rule_id", "left_semi")
    return out


def compiles(pattern: Column) -> Column:
    """Whether a pattern is a regular expression in the dialect the scan uses."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def validate_rules(rules: DataFrame, check_compile: bool = True) -> DataFrame:
    """One row per problem of a rule."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    checks = [
        F.when(blank("rule_id"), F.lit("missing id")),
        F.when(blank("pattern"), F.lit("missing pattern")),
        F.when(blank("message"), F.lit("missing message")),
        F.when(blank("severity"), F.lit("missing severity")),
        F.when(~blank("severity") & ~F.col("severity").isin(V.SEVERITIES), F.lit("invalid severity")),
        F.when((F.col("kind") == "structural") & (F.coalesce(F.size("languages"), F.lit(0)) < 1),
               F.lit("missing language")),
    ]
    if check_compile:
        fine = compiles(F.col("pattern"))
        checks.append(F.when(~blank("pattern") & ~fine, F.lit("pattern does not compile")))
        # positions are told by the text between matches, so a match must have characters
        checks.append(F.when(~blank("pattern") & fine & F.when(fine, F.rlike(F.lit(""), F.col("pattern"))), F.lit("pattern matches nothing")))
    return rules.select("rule_id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def rule_statistics(rules: DataFrame) -> DataFrame:
    """Counts by language, severity and type, and the total, in one pass."""
    dims = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("rules").alias("value")),
        F.struct(F.lit("kind").alias("dimension"), F.col("kind").alias("value")),
        F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("value")),
        F.struct(F.lit("crypto_type").alias("dimension"), F.col("crypto_type").alias("value")),
    )
    langs = F.transform(F.coalesce("languages", F.array().cast("array<string>")),
                        lambda x: F.struct(F.lit("language").alias("dimension"), x.alias("value")))
    return (rules.select(F.inline(F.concat(dims, langs)))
            .groupBy("dimension", "value").agg(F.count("*").alias("n_rules")))


def rule_hit_statistics(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule table with the number of findings and files each rule produced."""
    hits = findings.groupBy("rule_id").agg(F.count("*").alias("n_findings"),
                                           F.approx_count_distinct("path").alias("approx_files"))
    return rules.join(F.broadcast(hits), "rule_id", "left").fillna(0, ["n_findings", "approx_files"])


def attributes(findings: DataFrame, rules: DataFrame, cols: list[str]) -> DataFrame:
    """Look rule attributes up by id (Spark broadcasts the table where it is small)."""
    return findings.join(rules.select("rule_id", *cols), "rule_id", "left")


def language_gap(files_language: DataFrame, rules: DataFrame) -> DataFrame:
    """Languages present in the corpus for which no rule exists."""
    covered = rules.select(F.explode("languages").alias("language")).distinct()
    return (files_language.select("language").distinct()
            .join(F.broadcast(covered), "language", "left_anti"))


def applies_to(rule: Rule, language: Column, variant: str) -> Column:
    """Rule applicability by language.  First stage: an empty list, ``*`` or the same
    language.  Base: an unknown ('') file language also passes."""
    if not rule.languages:
        return F.lit(True)
    if variant == "l0" and "*" in rule.languages:
        return F.lit(True)
    names = [x.lower() for x in rule.languages]
    same = F.lower(language).isin(names)
    return same if variant == "l0" else (same | (language == ""))
