"""Queries for findings and comparisons, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators import assembly, compare, findings, invariants
from causeway.plans import core
from causeway.plans.core import BROKEN, DERIVED, EFFECT_GROUPS, ORACLE_SQL, TEMPORAL, graph, query, settled_graph
from causeway.plans.views import sql_id
from causeway.session import written

_TITLE = "array_to_string(list_transform(string_split(regexp_replace(invariant, '[._-]+', ' ', 'g'), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"
_SPECS = ", ".join(f"('{i}', '{a}', '{c}', '{invariants.INVARIANTS[i][1]}')" for a, (c, ids, _) in findings.ANALYZERS.items() for i in ids)
_results = lambda t: invariants.evaluate(settled_graph(t))
query("k01_findings_from_results", f"""SELECT case_id, {sql_id('finding', 'analyzer', sql_id('invariant-result', 'invariant', 'case_id'))} AS finding_id, analyzer, category, invariant AS classification, {_TITLE} AS title,
    CASE WHEN severity = 'critical' THEN 'critical' WHEN status = 'contradicted' THEN 'high' ELSE severity END AS severity FROM ({core.RUNTIME}) r JOIN (VALUES {_SPECS}) s(invariant, analyzer, category, severity) USING (invariant) WHERE status IN ('violated', 'contradicted', 'inconclusive')""", views=False)(
    lambda t: findings.from_results(_results(t)).select("case_id", "finding_id", "analyzer", "category", "classification", "title", "severity"))
query("d22_analyzer_results", f"SELECT analyzer, invariant, count(*) AS n FROM ({core.RUNTIME}) r JOIN (VALUES {_SPECS}) s(invariant, analyzer, category, severity) USING (invariant) GROUP BY ALL", views=False)(
    lambda t: _results(t).join(F.broadcast(findings.analyzer_invariants(t["nodes"].sparkSession)), "invariant").groupBy("analyzer", "invariant").agg(F.count("*").alias("n")))
query("k02_retry_repeated_effect", EFFECT_GROUPS + """, bad AS (SELECT case_id, logical_effect_key, durable_count FROM effect_groups WHERE durable_count > 1)
    SELECT b.case_id, b.logical_effect_key, durable_count, coalesce(string_agg(DISTINCT CAST(task_attempt AS VARCHAR), ',' ORDER BY lpad(CAST(task_attempt AS VARCHAR), 9, '0')) , '') AS attempts,
    string_agg(DISTINCT producer_node_ref, ',' ORDER BY producer_node_ref) AS node_refs, string_agg(DISTINCT effect_id, ',' ORDER BY effect_id) AS effect_refs
    FROM bad b JOIN effects e ON b.case_id = e.case_id AND b.logical_effect_key = e.logical_effect_key LEFT JOIN nodes n ON n.case_id = e.case_id AND n.node_id = e.producer_node_ref GROUP BY ALL""".replace(
    "string_agg(DISTINCT CAST(task_attempt AS VARCHAR), ',' ORDER BY lpad(CAST(task_attempt AS VARCHAR), 9, '0'))", "array_to_string(list_sort(list(DISTINCT task_attempt) FILTER (task_attempt IS NOT NULL)), ',')"))(
    lambda t: findings.repeated_effects(t["effects"], t["nodes"]).withColumn("attempts", F.col("attempts").cast("array<string>")))


def _refs(source: str) -> str:
    return f"SELECT case_id, string_agg(DISTINCT r, ',' ORDER BY r) AS node_refs FROM (SELECT case_id, unnest([source_ref, target_ref]) AS r FROM {source}) GROUP BY case_id"


_FINDING = "case_id", "finding_id", "classification", "severity", "node_refs"
query("k03_timestamp_conflict", DERIVED + TEMPORAL + f"""SELECT case_id, {sql_id('finding.transaction-conflict', "'analyzer.transaction-ordering'", 'node_refs')} AS finding_id, 'ordering.causal-timestamp-conflict' AS classification, 'high' AS severity, node_refs
    FROM ({_refs("temporal WHERE temporal_kind = 'timestamp_conflict'")})""".replace("SELECT case_id", " SELECT case_id", 1))(
    lambda t: findings.conflict_findings(assembly.temporal_constraints(graph(t)["graph"]["relations"], t["nodes"])).select(*_FINDING))
query("k04_link_reconstructed", DERIVED + BROKEN + f""" SELECT case_id, {sql_id('finding.recovered-link', "'analyzer.observability'", 'node_refs')} AS finding_id, 'observability.link-reconstructed' AS classification, 'medium' AS severity, node_refs FROM ({_refs("broken")})""")(
    lambda t: findings.reconstructed_findings(graph(t)["graph"]["relations"], t["nodes"]).select(*_FINDING))
query("k05_node_without_evidence", f""" SELECT case_id, {sql_id('finding.missing-node-evidence', "'analyzer.observability'", 'node_refs')} AS finding_id, 'observability.node-without-source-evidence' AS classification, 'medium' AS severity, node_refs
    FROM (SELECT case_id, string_agg(node_id, ',' ORDER BY node_id) AS node_refs FROM nodes WHERE len(observation_refs) = 0 GROUP BY case_id)""")(lambda t: findings.unseen_findings(t["nodes"]).select(*_FINDING))
_UNSEEN = lambda t: findings.unseen_findings(t["nodes"]).unionByName(findings.retry_findings(t["effects"], t["nodes"]))
_COUNTS = """SELECT case_id, 'medium' AS severity, 'analyzer.observability' AS analyzer, count(DISTINCT case_id) AS n FROM nodes WHERE len(observation_refs) = 0 GROUP BY case_id
    UNION ALL SELECT case_id, 'high', 'analyzer.retry-effect', count(*) FROM effect_groups WHERE durable_count > 1 GROUP BY case_id"""
query("e08_severity_summary", EFFECT_GROUPS + f" SELECT case_id, severity, n FROM ({_COUNTS})")(lambda t: findings.summary(_UNSEEN(t)))
query("k07_analyzer_runs", EFFECT_GROUPS + f" SELECT case_id, analyzer, n AS findings FROM ({_COUNTS})")(lambda t: findings.analyzer_runs(_UNSEEN(t)))
query("f05_deduplicated_findings", EFFECT_GROUPS + f" SELECT case_id, severity, n FROM ({_COUNTS})")(lambda t: findings.summary(findings.deduplicate(_UNSEEN(t).unionByName(_UNSEEN(t)))))
query("g02_findings_by_severity", EFFECT_GROUPS + f""" SELECT severity, n, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END) AS place FROM (SELECT severity, CAST(sum(n) AS BIGINT) AS n FROM ({_COUNTS}) GROUP BY severity)""")(
    lambda t: findings.summary(_UNSEEN(t)).groupBy("severity").agg(F.sum("n").alias("n")).select("severity", "n", F.expr(
        "row_number() over (order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end)").alias("place")))
query("k06_inspection_points", "SELECT category, inspect FROM (VALUES " + ", ".join(f"('{c}', '{p}')" for c, _, p in findings.ANALYZERS.values()) + ") v(category, inspect) WHERE EXISTS (SELECT 1 FROM events)", views=False)(
    lambda t: findings.analyzer_invariants(t["nodes"].sparkSession).select("category", "inspect").distinct().join(t["nodes"].limit(1).select(F.lit(1).alias("_one")), F.lit(True)).select("category", "inspect"))


def _report(t: dict) -> DataFrame:
    """All findings; the graph is read by four parts of it and written once."""
    whole = t | {"graph": {"relations": written(graph(t)["graph"]["relations"])}}
    return findings.analyze(whole, invariants.evaluate(whole))


query("k08_analysis_report")(_report)

# comparisons
_prepared = lambda t: compare.sides(t["pairs"], compare.prepare(t["nodes"], t["components"]))
_written = lambda t: compare.written_sides(t["pairs"], compare.prepare(t["nodes"], t["components"]))
_aligned = lambda t: compare.align(*_written(t))
SIDES = """, prep AS (SELECT n.case_id, node_id, n.role, n.kind AS node_kind, lower(trim(operation)) AS operation, coalesce(c.kind, 'unknown') AS component_kind, c.role AS component_role, logical_operation_id, task_name, stage, principal_id, status, task_attempt, start_us,
    (start_us - min(start_us) OVER (PARTITION BY n.case_id)) / 1000.0 AS offset_ms, greatest(0.0, (end_us - start_us) / 1000.0) AS duration_ms, tenant_id, idempotency_key, message_id, len(observation_refs) > 0 AS has_evidence
    FROM nodes n LEFT JOIN components c ON n.component_ref = c.component_id),
a AS (SELECT comparison_id, prep.* FROM pairs JOIN prep ON case_id = baseline_case), b AS (SELECT comparison_id, prep.* FROM pairs JOIN prep ON case_id = candidate_case)"""
ROLE = SIDES + """, ra AS (SELECT *, row_number() OVER (PARTITION BY comparison_id, role ORDER BY coalesce(task_attempt, 0), start_us, node_id) AS n FROM a),
rb AS (SELECT *, row_number() OVER (PARTITION BY comparison_id, role ORDER BY coalesce(task_attempt, 0), start_us, node_id) AS n FROM b),
zipped AS (SELECT ra.comparison_id, ra.node_id AS baseline_ref, rb.node_id AS candidate_ref FROM ra JOIN rb ON ra.comparison_id = rb.comparison_id AND ra.role = rb.role AND ra.n = rb.n)"""
query("l01_prepare", SIDES + " SELECT comparison_id, node_id, operation, component_kind, offset_ms, duration_ms FROM a UNION ALL SELECT comparison_id, node_id, operation, component_kind, offset_ms, duration_ms FROM b")(
    lambda t: _prepared(t)[0].unionByName(_prepared(t)[1]).select("comparison_id", "node_id", "operation", "component_kind", "offset_ms", "duration_ms"))
query("d14_role_ordinal_alignment", ROLE + " FROM zipped")(lambda t: compare.align_by_role(*_prepared(t)))
query("d15_similarity_join", SIDES + """, s AS (SELECT a.comparison_id, a.node_id AS baseline_ref, b.node_id AS candidate_ref, ((CASE WHEN a.node_kind = b.node_kind THEN 4.0 ELSE 0 END) + (CASE WHEN a.operation = b.operation THEN 6.0 ELSE 0 END)
    + (CASE WHEN a.component_kind = b.component_kind THEN 3.0 ELSE 0 END) + (CASE WHEN a.logical_operation_id = b.logical_operation_id THEN 2.0 ELSE 0 END) + (CASE WHEN a.component_role = b.component_role THEN 1.5 ELSE 0 END)
    + (CASE WHEN a.task_name = b.task_name THEN 2.0 ELSE 0 END) + (CASE WHEN a.stage = b.stage THEN 1.0 ELSE 0 END))::DOUBLE / 19.5 AS score FROM a JOIN b ON a.comparison_id = b.comparison_id)
    SELECT comparison_id, count(*) AS n, round(sum(score), 6) AS total FROM s WHERE score >= 0.55 GROUP BY comparison_id""")(
    lambda t: compare.similar_pairs(*_prepared(t)).groupBy("comparison_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total")))
query("l02_alignment")(_aligned)
query("l03_alignment_record", ROLE + f" SELECT comparison_id, {sql_id('alignment', 'baseline_ref', 'candidate_ref')} AS alignment_id, baseline_ref, candidate_ref, 1.0::DOUBLE AS confidence FROM zipped")(
    lambda t: _aligned(t).where("score = 1 and status = 'aligned'").select("comparison_id", "alignment_id", "baseline_ref", "candidate_ref", "confidence"))


def _role_rows(t):
    left, right = _prepared(t)
    by_role = compare.align_by_role(left, right).select("*", F.lit("aligned").alias("status"), compare.stable_id("alignment", F.col("baseline_ref"), F.col("candidate_ref")).alias("alignment_id"))
    return compare.aligned_nodes(by_role, left, right)


_ALN = sql_id("alignment", "z.baseline_ref", "z.candidate_ref")
_BOTH = ROLE + """, x AS (SELECT z.comparison_id, a.case_id AS a_case, b.case_id AS b_case, z.baseline_ref, z.candidate_ref, {aln} AS alignment_id, least(a.offset_ms, b.offset_ms) AS rank_ms, a.status AS a_status, b.status AS b_status, a.tenant_id AS a_tenant, b.tenant_id AS b_tenant, a.principal_id AS a_principal, b.principal_id AS b_principal,
    a.idempotency_key AS a_key, b.idempotency_key AS b_key, a.task_attempt AS a_attempt, b.task_attempt AS b_attempt, a.message_id AS a_message, b.message_id AS b_message, a.duration_ms AS a_ms, b.duration_ms AS b_ms,
    a.has_evidence AS a_seen, b.has_evidence AS b_seen FROM zipped z JOIN a ON a.comparison_id = z.comparison_id AND a.node_id = z.baseline_ref JOIN b ON b.comparison_id = z.comparison_id AND b.node_id = z.candidate_ref)""".replace("{aln}", _ALN)


def _divergence_query(name: str, function, dimension: str, classification: str, where: str, severity: str, consequence: str, consequential: str = "TRUE", ctes: str = "", source: str = "x") -> None:
    query(name, _BOTH + ctes + f""" SELECT comparison_id, {sql_id('divergence', 'alignment_id', "'" + classification + "'")} AS divergence_id, '{dimension}' AS dimension, '{classification}' AS classification, {severity} AS severity,
        {consequence} AS consequence, {consequential} AS consequential, baseline_ref AS baseline_refs, candidate_ref AS candidate_refs, rank_ms FROM {source} WHERE {where}""")(lambda t: function(t, _role_rows(t)))


_divergence_query("l06_status_changed", lambda t, r: compare.status_changed(r), "error", "status.changed", "a_status <> b_status", "CASE WHEN b_status IN ('ok', 'committed', 'completed') THEN 'medium' ELSE 'high' END", "'outcome_relevant'")
_CHANGES = """, ch AS (SELECT *, a_tenant IS DISTINCT FROM b_tenant AS tenant, a_principal IS DISTINCT FROM b_principal OR a_key IS DISTINCT FROM b_key OR a_attempt IS DISTINCT FROM b_attempt OR (a_message IS DISTINCT FROM b_message AND (a_message IS NULL OR b_message IS NULL)) AS other FROM x)"""
_divergence_query("l08_identity_changed", lambda t, r: compare.identity_changed(r), "identity", "identity.changed", "tenant OR other", "CASE WHEN tenant THEN 'high' ELSE 'medium' END",
                  "CASE WHEN tenant THEN 'outcome_relevant' ELSE 'semantic' END", ctes=_CHANGES, source="ch")
_divergence_query("l09_duration_regression", lambda t, r: compare.duration_changed(r), "timing", "timing.duration-regression", "abs(b_ms - a_ms) >= 25 AND greatest(a_ms, b_ms) / greatest(1.0, least(a_ms, b_ms)) >= 1.5", "'medium'", "'semantic'")
_divergence_query("l10_evidence_coverage", lambda t, r: compare.evidence_changed(r), "evidence", "evidence.node-coverage-changed", "a_seen <> b_seen", "'low'", "'observational'", "FALSE")
_CTX = """, cx AS (SELECT x.*, ca.namespace || '.' || ca.field_name AS ka, cb.namespace || '.' || cb.field_name AS kb, ca.value AS va, cb.value AS vb FROM x LEFT JOIN contexts ca ON ca.case_id = a_case AND ca.observed_at_node_ref = baseline_ref LEFT JOIN contexts cb ON cb.case_id = b_case AND cb.observed_at_node_ref = candidate_ref)"""
_divergence_query("l07_context_changed", lambda t, r: compare.context_changed(r, t["contexts"]), "context", "context.changed", "ka IS DISTINCT FROM kb OR va IS DISTINCT FROM vb",
                  "CASE WHEN ka IS NOT NULL THEN 'high' ELSE 'medium' END", "CASE WHEN ka IS NOT NULL THEN 'outcome_relevant' ELSE 'semantic' END", ctes=_CTX, source="cx")
query("d17_context_differences", _BOTH + _CTX + """ SELECT comparison_id, baseline_ref, candidate_ref, CASE WHEN ka IS DISTINCT FROM kb THEN coalesce(ka, '') ELSE '' END AS missing, CASE WHEN ka IS DISTINCT FROM kb THEN coalesce(kb, '') ELSE '' END AS added,
    CASE WHEN ka = kb AND va <> vb THEN ka ELSE '' END AS mutated FROM cx""")(lambda t: compare.context_differences(_role_rows(t), t["contexts"]).select("comparison_id", "baseline_ref", "candidate_ref", "missing", "added", "mutated"))
COUNTS = """, k AS (SELECT case_id, logical_effect_key, count(*) FILTER (durability IN ('committed', 'durable')) AS n, string_agg(effect_id, ',' ORDER BY effect_id) AS ids FROM effects GROUP BY ALL),
    ka AS (SELECT comparison_id, k.* FROM pairs JOIN k ON case_id = baseline_case), kb AS (SELECT comparison_id, k.* FROM pairs JOIN k ON case_id = candidate_case),
    both_k AS (SELECT coalesce(ka.comparison_id, kb.comparison_id) AS comparison_id, coalesce(ka.logical_effect_key, kb.logical_effect_key) AS logical_effect_key, coalesce(ka.n, 0) AS a_n, coalesce(kb.n, 0) AS b_n,
        coalesce(ka.ids, '') AS a_ids, coalesce(kb.ids, '') AS b_ids FROM ka FULL JOIN kb ON ka.comparison_id = kb.comparison_id AND ka.logical_effect_key = kb.logical_effect_key)"""
query("d16_effect_count_differences", COUNTS + " SELECT * FROM both_k WHERE a_n <> b_n")(lambda t: compare.effect_counts(t["pairs"], t["effects"]))
query("l11_effect_count_changed", SIDES + COUNTS + f""" SELECT comparison_id, {sql_id('divergence.effect', 'logical_effect_key', 'a_n', 'b_n')} AS divergence_id, CASE WHEN b_n > 1 THEN 'critical' ELSE 'high' END AS severity,
    coalesce((SELECT min(offset_ms) FROM b JOIN effects e ON e.case_id = b.case_id AND e.producer_node_ref = b.node_id WHERE b.comparison_id = x.comparison_id AND e.logical_effect_key = x.logical_effect_key), 0.0) AS rank_ms FROM both_k x WHERE a_n <> b_n""")(
    lambda t: compare.effect_changed(t["pairs"], t["effects"], _prepared(t)[1]).select("comparison_id", "divergence_id", "severity", "rank_ms"))
query("l04_structural_divergence")(lambda t: (lambda left, right: compare.structural(compare.align(left, right), left, right))(*_written(t)))
query("l05_ambiguous_alignment")(lambda t: compare.ambiguous(_aligned(t)))
query("l12_divergences")(lambda t: compare.compare(t["pairs"], t)["divergences"])
query("f07_first_meaningful_divergence")(lambda t: compare.compare(t["pairs"], t)["first"])
query("l13_semantic_comparison")(lambda t: compare.compare(t["pairs"], t)["summary"])
query("e09_comparison_summary", SIDES + """ SELECT comparison_id, (SELECT count(*) FROM a WHERE a.comparison_id = p.comparison_id) AS baseline_nodes, (SELECT count(*) FROM b WHERE b.comparison_id = p.comparison_id) AS candidate_nodes FROM pairs p""")(
    lambda t: compare.alignment_counts(_aligned(t)).select("comparison_id", (F.col("aligned_nodes") + F.col("ambiguous_nodes") + F.col("baseline_only_nodes")).alias("baseline_nodes"),
                                                             (F.col("aligned_nodes") + F.col("candidate_only_nodes")).alias("candidate_nodes")))
query("g03_divergences_in_order")(lambda t: compare.in_order(compare.compare(t["pairs"], t)["divergences"]))
