"""Findings from invariant results and from the assembled graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.scalars import severity_rank, stable_id, title_of
from causeway.operators import assembly, invariants

# Which analyzer reads which invariants, and what it tells to inspect.
ANALYZERS = {
    "analyzer.context": ("context", ["context.required-continuity", "context.forbidden-propagation"], "Inspect context serialization, transport, and destination initialization."),
    "analyzer.identity": ("identity", ["identity.execution-isolation", "identity.workflow-correlatable"], "Inspect workflow, task, tenant, and idempotency identity creation."),
    "analyzer.retry-effect": ("retry_effect", ["effect.at-most-once", "effect.required-eventuality"], "Inspect retry trigger, effect durability, and idempotency enforcement."),
    "analyzer.transaction-ordering": ("transaction_ordering", ["ordering.read-after-visibility", "consistency.required-freshness"], "Inspect publication relative to commit and dependent read visibility."),
    "analyzer.observability": ("observability", ["observability.required-linkage"], "Inspect instrumentation and propagation at the implicated boundary."),
    "analyzer.resource-performance": ("resource_performance", ["resource.capacity-bounded", "performance.work-amplification"], "Inspect repeated operation families and resource wait spans."),
    "analyzer.privacy-contract": ("privacy", ["privacy.prohibited-capture", "contract.schema-compatible"], "Inspect capture allowlists and export policy."),
}
COLUMNS = ["case_id", "finding_id", "analyzer", "category", "classification", "title", "severity", "evidence_class", "confidence", "node_refs", "effect_refs"]


def analyzer_invariants(spark) -> DataFrame:
    """(analyzer, category, invariant, inspect): as many rows as there are invariants."""
    rows = [(a, category, i, point) for a, (category, ids, point) in ANALYZERS.items() for i in ids]
    return spark.createDataFrame(rows, "analyzer string, category string, invariant string, inspect string")


def inspection_points(rows: DataFrame) -> DataFrame:
    """Rows with ``category`` and what to inspect for it."""
    points = analyzer_invariants(rows.sparkSession).select("category", "inspect").distinct()
    return rows.join(F.broadcast(points), "category", "left")


def from_results(results: DataFrame) -> DataFrame:
    """A finding for every violated, contradicted or inconclusive result."""
    rows = results.where(F.col("status").isin("violated", "contradicted", "inconclusive")).join(F.broadcast(analyzer_invariants(results.sparkSession)), "invariant")
    severity = F.when((F.col("status") == "contradicted") & (F.col("severity") != "critical"), "high").otherwise(F.col("severity"))
    return rows.select(
        "case_id", stable_id("finding", F.col("analyzer"), F.col("result_id")).alias("finding_id"), "analyzer", "category", F.col("invariant").alias("classification"),
        title_of(F.col("invariant")).alias("title"), severity.alias("severity"), "evidence_class", "confidence", "node_refs", "effect_refs",
    )


def _finding(rows: DataFrame, analyzer: str, classification: str, title: str, severity: str, evidence: str, confidence: float, id_of) -> DataFrame:
    none = F.array().cast("array<string>")
    return rows.select(
        "case_id", id_of.alias("finding_id"), F.lit(analyzer).alias("analyzer"), F.lit(ANALYZERS[analyzer][0]).alias("category"), F.lit(classification).alias("classification"),
        F.lit(title).alias("title"), F.lit(severity).alias("severity"), F.lit(evidence).alias("evidence_class"), F.lit(confidence).alias("confidence"),
        *[F.col(c) if c in rows.columns else none.alias(c) for c in ("node_refs", "effect_refs")],
    )


def repeated_effects(effects: DataFrame, nodes: DataFrame) -> DataFrame:
    """Effects that became durable more than once, with the attempts that made them."""
    groups = assembly.effect_groups(effects).where("durable_count > 1").select("case_id", "logical_effect_key", "durable_count")
    made = effects.join(groups, ["case_id", "logical_effect_key"]).join(
        nodes.select("case_id", F.col("node_id").alias("producer_node_ref"), "task_attempt"), ["case_id", "producer_node_ref"], "left")
    return made.groupBy("case_id", "logical_effect_key", "durable_count").agg(
        F.sort_array(F.collect_set("task_attempt")).alias("attempts"), F.array_sort(F.collect_set("producer_node_ref")).alias("node_refs"),
        F.array_sort(F.collect_set("effect_id")).alias("effect_refs"),
    )


def retry_findings(effects: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = repeated_effects(effects, nodes)
    of = stable_id("finding.retry-duplicate", F.lit("analyzer.retry-effect"), F.col("logical_effect_key"))
    return _finding(rows, "analyzer.retry-effect", "retry.duplicate-durable-effect", "Retry repeated a durable effect", "high", "deterministic", 1.0, of)


def conflict_findings(constraints: DataFrame) -> DataFrame:
    """One finding for each case whose causal edges contradict its timestamps."""
    ends = constraints.where("temporal_kind = 'timestamp_conflict'").select("case_id", F.explode(F.array("source_ref", "target_ref")).alias("ref"))
    rows = ends.groupBy("case_id").agg(F.array_sort(F.collect_set("ref")).alias("node_refs"))
    of = stable_id("finding.transaction-conflict", F.lit("analyzer.transaction-ordering"), F.array_join("node_refs", ","))
    return _finding(rows, "analyzer.transaction-ordering", "ordering.causal-timestamp-conflict", "Causal order conflicts with recorded timestamps", "high", "contradicted", 1.0, of)


def reconstructed_findings(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cases in which links had to be rebuilt from identities."""
    lost = invariants.broken_links(relations, nodes).select("case_id", F.explode(F.array("source_ref", "target_ref")).alias("ref"))
    rows = lost.groupBy("case_id").agg(F.array_sort(F.collect_set("ref")).alias("node_refs"))
    of = stable_id("finding.recovered-link", F.lit("analyzer.observability"), F.array_join("node_refs", ","))
    return _finding(rows, "analyzer.observability", "observability.link-reconstructed", "Causal link required reconstruction", "medium", "deterministic", 0.95, of)


def unseen_findings(nodes: DataFrame) -> DataFrame:
    """Cases with nodes that no observation supports."""
    rows = nodes.where(F.size("observation_refs") == 0).groupBy("case_id").agg(F.array_sort(F.collect_list("node_id")).alias("node_refs"))
    of = stable_id("finding.missing-node-evidence", F.lit("analyzer.observability"), F.array_join("node_refs", ","))
    return _finding(rows, "analyzer.observability", "observability.node-without-source-evidence", "Execution node lacks source observations", "medium", "unknown", 1.0, of)


def deduplicate(findings: DataFrame) -> DataFrame:
    """One finding for each (classification, nodes, effects) of a case: the first by id."""
    order = Window.partitionBy("case_id", "classification", "node_refs", "effect_refs").orderBy("finding_id")
    return findings.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def by_severity(findings: DataFrame) -> DataFrame:
    """The order of a report: worst first. Sort only what is shown."""
    return findings.orderBy(severity_rank(F.col("severity")).desc(), F.col("finding_id").desc())


def analyze(t: dict, results: DataFrame) -> DataFrame:
    """All findings of all cases. ``t`` has the assembled graph under ``graph``."""
    relations = t["graph"]["relations"]
    parts = [
        from_results(results), retry_findings(t["effects"], t["nodes"]), conflict_findings(assembly.temporal_constraints(relations, t["nodes"])),
        reconstructed_findings(relations, t["nodes"]), unseen_findings(t["nodes"]),
    ]
    return deduplicate(reduce(DataFrame.unionByName, [p.select(COLUMNS) for p in parts]))


def analyzer_runs(findings: DataFrame) -> DataFrame:
    return findings.groupBy("case_id", "analyzer").agg(F.count("*").alias("findings"))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("case_id", "severity").agg(F.count("*").alias("n"))
