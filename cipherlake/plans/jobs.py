"""Composite jobs: what a user calls.  Every job returns a dict of lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.functions import paths as P
from cipherlake.operators import classify as CL
from cipherlake.operators import context_score as CS
from cipherlake.operators import dependencies as DP
from cipherlake.operators import embedded as EM
from cipherlake.operators import enhanced as EN
from cipherlake.operators import evaluate as EV
from cipherlake.operators import fleet as FL
from cipherlake.operators import flow as FW
from cipherlake.operators import policy as PO
from cipherlake.operators import profile as PR
from cipherlake.operators import report as RP
from cipherlake.operators import scan as S
from cipherlake.operators import structural as ST
from cipherlake.operators import training as TR
from cipherlake.operators.rules import Rule, structural_rules
from cipherlake.session import checkpoint as cut
from cipherlake.sources import corpus as C
from cipherlake.sources import results as RS

FINDING_COLUMNS = ["path", "repo", "rule_id", "line", "col", "pos", "message", "severity", "confidence", "crypto_type",
                   "algorithm", "context", "suggestion", "match_text", "stage", "finding_id"]


def layered_findings(files: DataFrame, rules: list[Rule] | None = None, enable_l1: bool = True, enable_l2: bool = True,
                     l2_min_high_conf: int = 2, reuse: bool = False) -> dict[str, DataFrame]:
    """Three stages with their gates; ``files`` needs path, repo, language, content.

    ``reuse`` writes the first two stages to the checkpoint folder, so later stages read them back
    instead of scanning again."""
    keep = cut if reuse else (lambda df: df)
    marks = C.inline_suppressions(files)
    usable = files.filter(P.skip_reason(F.col("path")).isNull() & ~C.suppressed_as_a_whole(F.col("content")))
    l0 = keep(S.l0_scan(usable, rules).select(*FINDING_COLUMNS))
    out = {"suppressions": marks, "files": usable, "L0": l0}
    if enable_l1:
        out["L1"] = keep(ST.l1_scan(usable, l0).select(*FINDING_COLUMNS))
    if enable_l1 and enable_l2:
        gate = ST.high_confidence_files(out["L1"], at_least=l2_min_high_conf).select("path")
        sources = FW.taint_sources(usable).join(gate, "path", "left_semi")
        flows = FW.trace_flows(sources, FW.taint_sinks(out["L1"].join(gate, "path", "left_semi")))
        out["L2"] = FW.flow_violations(flows).select(*FINDING_COLUMNS)
    stages = [out[s] for s in ("L0", "L1", "L2") if s in out]
    union = stages[0]
    for s in stages[1:]:
        union = union.unionByName(s)
    out["all"] = union
    return out


def layered_scan(files: DataFrame, **options) -> dict[str, DataFrame]:
    """Stages, context score, inline suppressions."""
    out = layered_findings(files, **options)
    scored = CS.score_findings(out["all"])
    out["findings"] = PO.apply_inline_suppressions(scored, out["suppressions"])
    return out


def base_scan(files: DataFrame, rules: list[Rule] | None = None, structural: bool = True) -> dict[str, DataFrame]:
    """Rule scan and structural rules, dedupe, library severity, classification, summary."""
    chosen = C.select_files(files)
    found = S.rule_scan(chosen, rules).select(*FINDING_COLUMNS)
    if structural:
        found = found.unionByName(S.structural_scan(chosen, structural_rules()).select(*FINDING_COLUMNS))
    final = CL.apply_classification(S.adjust_for_library(S.dedupe_findings(found)))
    return {"findings": final, "summary": RP.scan_summary(chosen, final)}


def api_scan(files: DataFrame, rules: list[Rule] | None = None) -> dict[str, DataFrame]:
    out = base_scan(files, rules)
    return {"findings": RP.published_schema(out["findings"]), "summary": RP.published_summary(out["findings"]),
            "scan_summary": out["summary"]}


def combined_scan(files: DataFrame, reports: DataFrame, **options) -> dict[str, DataFrame]:
    """Project profile, layered scan without profile-ignored files, dependency findings, joint counts."""
    languages = PR.project_languages(files)
    patterns = PR.ignore_patterns(languages)
    scan = {k: v if k == "files" else PR.filter_by_profile(v, patterns, repo=F.split("path", "/")[0]) for k, v in layered_scan(files, **options).items()}
    vulns = DP.scan_project(reports, PR.ecosystems(files), ["repo"])
    return {**scan, "languages": languages, "package_managers": PR.package_managers(files), "vulnerabilities": vulns,
            "vulnerability_summary": DP.vulnerability_summary(scan["findings"], vulns)}


def enhanced_findings(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Features, embedding, score and vector of every finding, best first."""
    return EN.enhance(findings, files).orderBy(F.desc("enhanced_score"), "finding_id")


def scored_layered_scan(files: DataFrame, **options) -> DataFrame:
    """Layered scan whose confidence the embedded models adjust."""
    findings = layered_scan(files, **options)["findings"]
    return EM.apply_predictions(EM.embedded_predictions(EM.model_input(findings)))


def fleet_scan(files: DataFrame, floor: float = 0.3, per_repo: int = 1000, **options) -> DataFrame:
    """The same scan for every repository in one job, at most ``per_repo`` findings of each."""
    found = PO.min_confidence(layered_scan(files, **options)["findings"], floor)
    return PO.top_per_group(found, "repo", per_repo)


def fleet_analysis(findings: DataFrame, repositories: DataFrame) -> dict[str, DataFrame]:
    stats = FL.repository_statistics(findings)
    per = FL.combined_statistics(findings, repositories)
    return {"repositories": stats, "rankings": FL.repository_rankings(stats), "global": FL.global_statistics(findings, repositories),
            "suitability": FL.training_suitability(findings), "combined": per, "totals": FL.combined_totals(per),
            "top_algorithms": FL.top_algorithms(findings)}


def fleet_analysis_from_files(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Stored result documents to fleet analytics; unreadable ones go to ``errors``."""
    docs = RS.read_results(spark, path)
    good, bad = RS.split_corrupt(docs)
    found = RS.parse_findings(good).withColumnsRenamed({"file": "path", "id": "finding_id"})
    found = found.fillna("unknown", ["algorithm", "severity", "crypto_type", "language"]).fillna(0.0, ["confidence"])
    return {**fleet_analysis(found, docs), "findings": found, "errors": bad}


def evaluation_run(findings: DataFrame, floor: float, limit: int, batch_size: int, responses: DataFrame | None = None) -> dict[str, DataFrame]:
    """Selection, cost estimate and batches; with responses (batch_id, response) also the join back."""
    chosen = cut(PO.filter_for_evaluation(findings, floor, limit))  # read by several outputs
    batched = EV.assign_batches(chosen, batch_size)
    out = {"selected": chosen, "costs": EV.cost_estimate(chosen), "batches": batched}
    if responses is not None:
        sizes = batched.groupBy("batch_id").agg(F.count("*").alias("expected"))
        parsed = RS.parse_responses(responses.join(sizes, "batch_id"))
        out["evaluations"] = EV.join_responses(batched, parsed)
        out["retry"] = EV.resubmission_plan(batched, parsed, batch_size)
    return out


def training_run(findings: DataFrame, evaluations: DataFrame, target: str | None = None, trees: int = 100, folds: int = 5) -> dict:
    """Labelled features, three models, metrics; saved when a target folder is given."""
    labelled = EV.join_evaluations(findings, evaluations)
    feats = TR.training_features(labelled)
    encoder = TR.fit_encoder(feats.filter("has_ai_evaluation"))
    encoded = cut(TR.encode(feats, encoder))
    results = [TR.train_validity_model(encoded, folds), TR.train_confidence_model(encoded, trees, folds),
               TR.train_severity_model(encoded, trees)]
    report = TR.report_rows(findings.sparkSession, results)
    if target:
        TR.save(encoder, results, report, target)
    return {"coverage": EV.coverage(labelled), "encoder": encoder, "encoded": encoded, "results": results, "report": report}
