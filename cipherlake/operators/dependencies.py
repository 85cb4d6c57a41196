"""Dependency reports: ingest, join with packages, combined counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.functions.text import dimension

AUDIT_DDL = "vulnerabilities map<string,struct<severity:string,title:string,cves:array<string>>>"
LINE_DDL = "type string, vuln struct<id:string,details:string>"


VULNERABILITY = "array<struct<vuln_id:string,package:string,title:string,severity:string,cves:array<string>>>"


def _no_cves() -> Column:
    return F.array().cast("array<string>")


def parse_audit(body: Column) -> Column:
    """Audit report: a JSON map from package to vulnerability, one entry per package."""
    entries = F.map_entries(F.from_json(body, AUDIT_DDL)["vulnerabilities"])
    return F.transform(entries, lambda e: F.struct(
        F.concat(F.lit("npm-"), e["key"]).alias("vuln_id"), e["key"].alias("package"), e["value"]["title"].alias("title"),
        e["value"]["severity"].alias("severity"), F.coalesce(e["value"]["cves"], _no_cves()).alias("cves")))


def parse_line_report(body: Column) -> Column:
    """Line-delimited JSON; only entries of type ``vuln`` count, unreadable lines are skipped."""
    entries = F.transform(F.split(body, "\n"), lambda t: F.from_json(t, LINE_DDL, {"mode": "PERMISSIVE"}))
    return F.transform(F.filter(entries, lambda e: e["type"] == "vuln"), lambda e: F.struct(
        e["vuln"]["id"].alias("vuln_id"), F.lit("").alias("package"), e["vuln"]["details"].alias("title"), F.lit("unknown").alias("severity"), _no_cves().alias("cves")))


# format -> parser of a report's text into an array of VULNERABILITY
PARSERS: dict[str, Callable[[Column], Column]] = {"audit": parse_audit, "lines": parse_line_report}


def register_parser(name: str, parser: Callable[[Column], Column]) -> None:
    PARSERS[name] = parser


def ingest(reports: DataFrame, keys: list[str], format_col: str = "format", body: str = "report", parsers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Vulnerabilities of reports in all registered formats, in one pass: a report is read once, parsed by its format in
    the row, and only its entries go on.  Reports of other formats and null reports have none."""
    parsed = F.lit(None).cast(VULNERABILITY)
    for name, parser in sorted((PARSERS if parsers is None else parsers).items()):
        parsed = F.when(F.col(format_col) == name, parser(F.col(body)).cast(VULNERABILITY)).otherwise(parsed)
    return reports.select(*keys, F.inline(parsed))


def match_advisories(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies hit by an advisory: same package, and same version when the advisory names one."""
    a = advisories.select(F.col("package").alias("a_package"), F.coalesce("version", F.lit("")).alias("a_version"),
                          "vuln_id", "severity", "title")
    cond = (F.col("package") == F.col("a_package")) & ((F.col("a_version") == "") | (F.col("a_version") == F.col("version")))
    return dependencies.join(a, cond).drop("a_package", "a_version")


def scan_project(reports: DataFrame, ecosystems: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of the reports whose ecosystem the repository has; other reports are skipped.

    Reports are parsed where they are read; their entries meet the ecosystems as short rows, against one row per
    repository and ecosystem, so that a hot repository's entries can be split."""
    names = [c for c in ecosystems.columns if c != "repo"]
    wide = ecosystems.select("repo", F.inline(F.array(*[F.struct(F.lit(c).alias("ecosystem"), F.col(c).alias("present")) for c in names])))
    own = list(dict.fromkeys([*keys, "repo", "ecosystem"]))
    found = ingest(reports.filter(F.col("ecosystem").isin(names)), own)
    return found.join(wide.filter("present").select("repo", "ecosystem"), ["repo", "ecosystem"], "left_semi").drop(*[c for c in ("repo", "ecosystem") if c not in keys])


def vulnerability_summary(findings: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """Counts for four severities of both kinds, zeros included."""
    levels = ["critical", "high", "medium", "low"]
    kinds = findings.select(F.lit("crypto").alias("kind"), F.lower("severity").alias("severity")).unionByName(
        vulnerabilities.select(F.lit("dep").alias("kind"), F.lower("severity").alias("severity")))
    counts = kinds.filter(F.col("severity").isin(levels)).groupBy("kind", "severity").agg(F.count("*").alias("n"))
    cells = dimension(findings.sparkSession, [{"kind": k, "severity": s} for k in ("crypto", "dep") for s in levels],
                      "kind string, severity string")
    return cells.join(F.broadcast(counts), ["kind", "severity"], "left").select(
        F.concat_ws("_", "kind", "severity").alias("metric"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
