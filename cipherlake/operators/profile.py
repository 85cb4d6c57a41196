"""Project profile: languages, package managers, source directories, ignore patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake import fixed_values as V
from cipherlake.functions import paths as P
from cipherlake.functions.text import dimension

# Evidence further back weighs less than 2**-199 in total: far below the last bit of a confidence.
_HALVINGS = 200


def relative_path(path: Column) -> Column:
    """Path below the repository."""
    return F.regexp_replace(path, "^[^/]*/", "")


def language_confidence(rel: Column, lang: str) -> Column:
    files, exts, dirs, conf = V.LANGUAGE_EVIDENCE[lang]
    name = P.base_name(rel)
    plain = [f for f in files if "*" not in f]
    by_name = name.isin(plain)
    for f in files:
        if "*" in f:
            by_name = by_name | name.rlike(P.glob_pattern(f))
    ext = F.regexp_extract(rel, r"(\.[^./]*)$", 1)
    base = F.when(by_name, F.lit(conf)).when(ext.isin(exts), F.lit(V.EXTENSION_ONLY_CONFIDENCE)).otherwise(F.lit(0.0))
    for d in dirs:
        base = base + F.when(rel.startswith(d + "/"), F.lit(V.DIRECTORY_BONUS)).otherwise(F.lit(0.0))
    return base


def language_evidence(files: DataFrame) -> DataFrame:
    """One row per file and language it is evidence for (paths only)."""
    rel = relative_path(F.col("path"))
    items = F.array(*[F.struct(F.lit(lang).alias("language"), language_confidence(rel, lang).alias("evidence"))
                      for lang in sorted(V.LANGUAGE_EVIDENCE)])
    return (files.select("repo", "path", rel.alias("rel")).filter(~P.profile_excluded(F.col("rel")))
            .select("repo", "path", "rel", F.inline(F.filter(items, lambda e: e["evidence"] > 0))))


def project_languages(files: DataFrame) -> DataFrame:
    """Confidence per repository and language: the fold c := (c + new) / 2 over files in walk order.

    Unrolled, the newest file weighs 1/2, the one before 1/4 and so on, and the first one as much
    as the second.  Weights beyond 200 positions cannot change a double, so only the newest rows per
    group are ranked (window group limit keeps a hot repository from reaching one task); counts
    come from an ordinary aggregate."""
    ev = language_evidence(files).withColumn("walk", F.split("path", "/"))
    keys = ["repo", "language"]
    n = ev.groupBy(*keys).agg(F.count("*").alias("n_files"))
    w = Window.partitionBy(*keys).orderBy(F.desc("walk"))
    newest = ev.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= _HALVINGS)
    sums = newest.groupBy(*keys).agg(
        F.sum(F.col("evidence") * F.pow(F.lit(0.5), F.col("back"))).alias("folded"),
        F.max_by("evidence", "back").alias("oldest"), F.max("back").alias("depth"))
    out = sums.join(n, keys)
    # the first file of all carries its weight twice
    conf = F.col("folded") + F.when(F.col("n_files") == F.col("depth"),
                                    F.col("oldest") * F.pow(F.lit(0.5), F.col("depth"))).otherwise(F.lit(0.0))
    return out.select(*keys, "n_files", conf.alias("confidence"))


def package_managers(files: DataFrame, full_map: bool = False) -> DataFrame:
    table = V.PACKAGE_MANAGERS_FULL if full_map else V.PACKAGE_MANAGERS_REACHABLE
    manager = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), P.base_name(F.col("path")))
    return (files.select("repo", manager.alias("package_manager")).filter(F.col("package_manager").isNotNull())
            .distinct())


def source_directories(files: DataFrame) -> DataFrame:
    """Usual source directories present in each repository, '.' when there are none."""
    rel = relative_path(F.col("path"))
    top = F.when(rel.contains("/") & F.split(rel, "/")[0].isin(V.SOURCE_DIRECTORIES), F.split(rel, "/")[0])
    sets = files.groupBy("repo").agg(F.collect_set(top).alias("dirs"))  # at most eight values
    return sets.select("repo", F.explode(F.when(F.size("dirs") == 0, F.array(F.lit("."))).otherwise(F.col("dirs"))).alias("directory"))


def primary_language(files: DataFrame) -> DataFrame:
    counts = (files.select("repo", P.language(F.col("path"), "primary").alias("language")).filter(F.col("language") != "")
              .groupBy("repo", "language").agg(F.count("*").alias("n")))
    best = counts.groupBy("repo").agg(F.min_by(F.struct("language", "n"), F.struct(-F.col("n"), F.col("language"))).alias("b"))
    return (files.select("repo").distinct().join(best, "repo", "left")
            .select("repo", F.coalesce("b.language", F.lit("unknown")).alias("primary_language"),
                    F.coalesce("b.n", F.lit(0).cast("bigint")).alias("n_files")))


def ignore_patterns(languages: DataFrame, small_project: int | None = None) -> DataFrame:
    """Ignore patterns of every repository: always, and by language.  The moderate ones hold everywhere, or, with
    ``small_project``, only in repositories of fewer files."""
    spark = languages.sparkSession
    total = languages.groupBy("repo").agg(F.sum("n_files").alias("total"))
    fixed = dimension(spark, [{"pattern": p, "level": "high"} for p in V.IGNORE_HIGH]
                      + [{"pattern": p, "level": "moderate"} for p in V.IGNORE_MODERATE], "pattern string, level string")
    by_lang = dimension(spark, [{"language": k, "pattern": p} for k, ps in V.IGNORE_BY_LANGUAGE.items() for p in ps],
                        "language string, pattern string")
    general = (total.select("repo", "total", F.explode(F.array(F.lit("high"), F.lit("moderate"))).alias("level"))
               .filter((F.col("level") == "high") | (F.lit(True) if small_project is None else F.col("total") < small_project))
               .join(F.broadcast(fixed), "level").select("repo", "pattern"))
    special = languages.join(F.broadcast(by_lang), "language").select("repo", "pattern")
    return general.unionByName(special).distinct()


def filter_by_profile(rows: DataFrame, patterns: DataFrame, repo: Column | None = None) -> DataFrame:
    """Drop rows whose path an ignore pattern of their repository covers.  Patterns are a bounded set per
    repository, collected into one row each and joined on the repository.  Give it short rows (paths, findings), not
    texts: a repository may hold a third of all rows, which Spark's skewed join then splits."""
    rx = F.transform("ps", lambda p: F.concat(F.lit("^"), F.regexp_replace(
        F.regexp_replace(p, r"([\\.^$|?+()\[\]{}])", r"\\$1"), r"\*", "[^/]*"), F.lit("$")))
    stems = F.transform("ps", lambda p: F.regexp_replace(p, r"\*$", ""))
    per = (patterns.groupBy("repo").agg(F.collect_set("pattern").alias("ps"))
           .select("repo", F.array_join(rx, "|").alias("regex"), stems.alias("stems")))
    rel = relative_path(F.col("path"))
    keep = ~(F.coalesce(F.expr("regexp_replace(path, '^[^/]*/', '') rlike regex"), F.lit(False))
             | F.coalesce(F.exists("stems", lambda s: rel.contains(s)), F.lit(False)))
    own = per.withColumnRenamed("repo", "_repo")
    return rows.join(own, (F.col("repo") if repo is None else repo) == F.col("_repo"), "left").filter(keep).drop("_repo", "regex", "stems")


def ecosystems(files: DataFrame) -> DataFrame:
    """Dependency ecosystems each repository can be checked for."""
    name = P.base_name(F.col("path"))
    flags = [F.max(F.when(name.isin(m), F.lit(True)).otherwise(F.lit(False))).alias(k)
             for k, m in V.ECOSYSTEM_MARKERS.items()]
    return files.groupBy("repo").agg(*flags)


def excluded_files(files: DataFrame) -> DataFrame:
    rel = relative_path(F.col("path"))
    return files.select("repo", "path", P.profile_excluded(rel).alias("excluded"))
