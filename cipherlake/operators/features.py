"""Text features of files: structure, crypto words by role, complexity, context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.functions import paths as P
from cipherlake.functions.text import count_literal, first_match, has_any, let, lookup

_KEYWORDS = "|".join(V.CRYPTO_KEYWORDS)
_IMPORT = r"(?m)^\s*(?:import|from|#include|use|require|using)\b"

# --- fixed values: line patterns per language --------------------------------
STRUCTURE = {
    "go": {"functions": r"(?m)^\s*func\b", "variables": r"\bvar\s+\w+|:=", "classes": r"(?m)^\s*type\s+\w+\s+struct\b",
           "pointers": r"\*\w", "generics": r"\[T\b", "lambdas": r"\bfunc\s*\("},
    "javascript": {"functions": r"\bfunction\b|=>", "variables": r"\b(?:var|let|const)\s+\w+", "classes": r"\bclass\s+\w+",
                   "pointers": r"$^", "generics": r"$^", "lambdas": r"=>"},
    "python": {"functions": r"(?m)^\s*def\s+\w+", "variables": r"(?m)^\s*\w+\s*=[^=]", "classes": r"(?m)^\s*class\s+\w+",
               "pointers": r"$^", "generics": r"$^", "lambdas": r"\blambda\b"},
    "c": {"functions": r"\w+\s+\w+\s*\([^;{]*\)\s*\{", "variables": r"\b(?:int|char|long|unsigned|static|const)\s+\**\w+",
          "classes": r"\b(?:struct|class)\s+\w+", "pointers": r"\*\s*\w", "generics": r"\btemplate\s*<", "lambdas": r"$^"},
    "java": {"functions": r"\b(?:public|private|protected)\s[^;={]*\(", "variables": r"\b\w+\s+\w+\s*=[^=]",
             "classes": r"\b(?:class|interface)\s+\w+", "pointers": r"$^", "generics": r"<\w+>", "lambdas": r"->"},
    "rust": {"functions": r"\bfn\s+\w+", "variables": r"\blet\s+", "classes": r"\b(?:struct|impl)\b", "pointers": r"&\w",
             "generics": r"<\w+>", "lambdas": r"\|\w*\|"},
}
ROLE_PATTERNS = {
    "crypto_calls": rf"(?i)\b\w*(?:{_KEYWORDS})\w*\s*\(",
    "crypto_variables": rf"(?i)\b\w*(?:{_KEYWORDS})\w*\s*:?=[^=]",
    "crypto_constants": rf"""(?i)["'][^"'\n]*(?:{_KEYWORDS})[^"'\n]*["']""",
    "crypto_methods": rf"(?im)^\s*(?:pub\s+)?(?:func|def|fn|function)\b[^\n]*(?:{_KEYWORDS})",
}

# Spellings that count the same matches in less time: a match ends with its bracket, so it may begin at the last character
# of its first word, and what can't hold the next character is not given back.
CALLS = r"\w\s*+\("
SPELLINGS = {STRUCTURE["c"]["functions"]: r"\w\s++\w++\s*+\((?:[^;{)]*+\))++\s*+\{"}


def text_features(files: DataFrame) -> DataFrame:
    """Structure counts of every file, all in one projection."""
    text, low, lang = F.col("content"), F.col("content_lower"), F.col("language")
    words = sum((count_literal(low, k) for k in V.CRYPTO_KEYWORDS), F.lit(0).cast("bigint"))
    branches = sum((count_literal(text, k) for k in ("if ", "for ", "while ", "switch ", "case ")), F.lit(1).cast("bigint"))
    cols = {
        "lines_of_code": (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint"),
        "function_calls": F.regexp_count(text, F.lit(CALLS)).cast("bigint"),
        "variable_declarations": F.regexp_count(text, F.lit(r"\b(var|let|const|int|string)\s+\w+")).cast("bigint"),
        "import_statements": F.regexp_count(text, F.lit(r"\b(import|include|require|use)\s+")).cast("bigint"),
        "crypto_pattern_hits": F.regexp_count(text, F.lit("(?i)(crypto|cipher|hash|encrypt|decrypt|rsa|aes|sha|md5)")).cast("bigint"),
        "crypto_words": words, "cyclomatic": branches,
        "has_crypto_loop": text.rlike("(?d)(?i)(for|while).*crypto"),
        "has_crypto_conditional": text.rlike("(?d)(?i)if.*crypto"),
        "has_crypto_try": text.rlike("(?d)(?i)(try|catch).*crypto"),
        "has_pointers": (lang == "go") & text.contains("*"),
        "has_generics": first_match([(lang == "go", text.contains("[T")), (lang == "java", text.contains("<") & text.contains(">"))], False),
        "in_crypto_namespace": first_match([(lang == "go", text.contains("package crypto")),
                                            (lang == "java", text.contains("package") & low.contains("crypto"))], False),
    }
    base = files.select("path", "repo", "content", P.language(F.col("path"), "features").alias("language"),
                        F.lower("content").alias("content_lower"))
    return base.select("path", "repo", "language", *[c.alias(n) for n, c in cols.items()])


def language_structure(files: DataFrame) -> DataFrame:
    """Counts by the file's own language tables.  The language is looked up once and the patterns stand in lambdas: the
    generated code of all of them is a method too long for the JVM to compile."""
    table, unknown = V.LANGUAGE_TABLES["features"]
    merged = {"typescript": "javascript", "cpp": "c"}
    group = lookup({ext: merged.get(name, name) for ext, name in table.items()}, P.extension(F.col("path")), unknown)
    base = files.select("path", group.alias("language_group"), "content").filter(F.col("language_group").isin(list(STRUCTURE)))
    count = lambda text, pattern: F.regexp_count(text, F.lit(SPELLINGS.get(pattern, pattern))).cast("bigint")
    by = lambda what: let(F.struct("language_group", "content"), lambda x: first_match(
        [(x["language_group"] == g, count(x["content"], t[what])) for g, t in STRUCTURE.items()], F.lit(0).cast("bigint")))
    return base.select("path", "language_group", *[by(what).alias(what) for what in ("functions", "variables", "classes", "pointers", "generics", "lambdas")],
                       count(F.col("content"), CALLS).alias("calls"), count(F.col("content"), _IMPORT).alias("imports"))


def role_features(files: DataFrame) -> DataFrame:
    """Crypto words by syntactic role: calls, variables, constants, functions."""
    return files.select("path", *[F.regexp_count("content", F.lit(p)).cast("bigint").alias(n) for n, p in ROLE_PATTERNS.items()])


def complexity(files: DataFrame) -> DataFrame:
    """Branch keywords plus one, and 1.5 times the calls."""
    branch = F.regexp_count("content", F.lit(r"\b(?:if|for|while|switch|match|case|catch|except)\b|\?[^?:\n]*:"))
    calls = F.regexp_count("content", F.lit(CALLS))
    return files.select("path", (branch + 1).cast("bigint").alias("cyclomatic_complexity"), (calls * 1.5).alias("halstead_complexity"))


def context_flags(files: DataFrame) -> DataFrame:
    """Context flags from lines: package, imports, documentation, error handling, path."""
    text = F.col("content")
    low = F.lower("path")
    return files.select(
        "path", text.rlike(r"(?im)^\s*(?:package|namespace|module|mod)\s+[\w.]*crypto").alias("in_crypto_namespace"),
        text.rlike(r"""(?im)^\s*(?:import|from|#include|use|require|using)\b[^\n]*(?:crypto|hashlib|ssl|rsa|security)""").alias("near_crypto_imports"),
        has_any(text, ["//", "/*", "#"]).alias("has_documentation"),
        text.rlike(r"\b(?:try|catch|except|rescue)\b|err\s*!=\s*nil|, err :?=|\)\?;").alias("has_error_handling"),
        (low.contains("security") | low.contains("crypto")).alias("in_security_context"))
