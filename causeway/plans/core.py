"""Queries for assembly and invariants over the canonical views, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.operators import assembly, invariants
from causeway.plans.views import SQL_VIEWS, sql_id, tables
from causeway.session import checkpointed

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text joined by commas, a missing one as the empty text."""
    is_array = {f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    return df.select(*[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) if c in is_array else F.col(c) for c in df.columns])


def query(name: str, sql: str | None = None, views: bool = True, of=tables):
    """Register fn(tables) as a query; ``sql`` follows the views, ``of`` makes the tables."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: flat(fn(of(spark, sf_dir)))
        if sql is not None:
            ORACLE_SQL[name] = (SQL_VIEWS if views else "") + sql
        return fn

    return add


def graph(t: dict) -> dict:
    return t | {"graph": {"relations": assembly.all_relations(t["nodes"], t["effects"], t["relations"])}}


def settled_graph(t: dict) -> dict:
    """The tables with their graph, for all invariants: what several of them read is written first."""
    return graph(invariants.settled(t))


_REL = "case_id, relation_id, kind, source_ref, target_ref, derivation"
PARENT = f""", holders AS (SELECT case_id, span_id, arg_max(node_id, (start_us, node_id)) AS source_ref FROM nodes WHERE span_id <> '' GROUP BY ALL),
parent_rel AS (SELECT c.case_id, {sql_id('relation.parent-span', 'source_ref', 'node_id')} AS relation_id, 'parent_of' AS kind, source_ref, node_id AS target_ref, 'source_native' AS derivation
    FROM nodes c JOIN holders h ON c.case_id = h.case_id AND c.parent_span_id = h.span_id)"""
MESSAGE = f""", publishers AS (SELECT DISTINCT ON (case_id, message_id) case_id, message_id, node_id AS source_ref FROM nodes WHERE kind = 'message_publish' ORDER BY case_id, message_id, start_us, node_id),
message_rel AS (SELECT n.case_id, {sql_id('relation.message', 'n.message_id', 'source_ref', 'node_id')} AS relation_id, 'delivers' AS kind, source_ref, node_id AS target_ref, 'deterministic' AS derivation
    FROM nodes n JOIN publishers p ON n.case_id = p.case_id AND n.message_id = p.message_id WHERE n.kind IN ('message_delivery', 'message_consume', 'task_attempt'))"""
RETRY = f""", attempts AS (SELECT case_id, task_id, node_id, task_attempt, lag(node_id) OVER w AS source_ref, lag(task_attempt) OVER w AS before FROM nodes
    WINDOW w AS (PARTITION BY case_id, task_id ORDER BY coalesce(task_attempt, 1000000000), start_us, node_id)),
retry_rel AS (SELECT case_id, {sql_id('relation.retry', 'task_id', 'source_ref', 'node_id')} AS relation_id, 'retries' AS kind, source_ref, node_id AS target_ref, 'deterministic' AS derivation
    FROM attempts WHERE task_attempt > before)"""
REPEAT = f""", repeat_rel AS (SELECT case_id, {sql_id('relation.repeated-effect', 'logical_effect_key', 'source_ref', 'effect_id')} AS relation_id, 'repeats_effect' AS kind, source_ref, effect_id AS target_ref,
    'deterministic' AS derivation FROM (SELECT *, min(effect_id) OVER (PARTITION BY case_id, logical_effect_key) AS source_ref FROM effects) WHERE source_ref <> effect_id)"""
DERIVED = PARENT + MESSAGE + RETRY + REPEAT + f""", derived AS (SELECT {_REL} FROM (FROM parent_rel UNION ALL FROM message_rel UNION ALL FROM retry_rel UNION ALL FROM repeat_rel) d
    WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.case_id = d.case_id AND r.kind = d.kind AND r.source_ref = d.source_ref AND r.target_ref = d.target_ref)),
every_rel AS (SELECT {_REL}, FALSE AS derived FROM relations UNION ALL SELECT {_REL}, TRUE FROM derived)"""
_STACK = " UNION ALL ".join(f"SELECT case_id, node_id, '{k}' AS kind, {c} AS identity_value FROM nodes" for k, c in assembly.IDENTITY_KINDS.items())
GROUPS = f""", id_groups AS (SELECT case_id, kind, identity_value, string_agg(node_id, ',' ORDER BY node_id) AS member_node_refs, {sql_id('identity-group', 'kind', 'identity_value')} AS group_id
    FROM ({_STACK}) WHERE identity_value <> '' GROUP BY case_id, kind, identity_value HAVING count(*) >= 2)"""
EFFECT_GROUPS = f""", effect_groups AS (SELECT case_id, logical_effect_key, list_sort(list(effect_id)) AS member_effect_refs, count(*) FILTER (durability IN ('committed', 'durable')) AS durable_count,
    coalesce(list_sort(list(DISTINCT idempotency_key) FILTER (idempotency_key <> '')), []) AS idempotency_keys, min(coalesce(maximum_durable_count, 1)) AS maximum,
    {sql_id('effect-group', 'logical_effect_key')} AS group_id FROM effects GROUP BY case_id, logical_effect_key)"""
FLOWS = f""", seen AS (SELECT c.case_id, namespace || '.' || field_name AS qualified_name, context_id, observed_at_node_ref, value, propagation_contract,
    lag(context_id) OVER w AS l_id, lag(observed_at_node_ref) OVER w AS l_node, lag(value) OVER w AS l_value
    FROM contexts c LEFT JOIN nodes n ON c.case_id = n.case_id AND c.observed_at_node_ref = n.node_id
    WINDOW w AS (PARTITION BY c.case_id, namespace, field_name ORDER BY coalesce(start_us, 9223372036854775807), context_id)),
flows AS (SELECT case_id, {sql_id('context-flow', 'qualified_name', 'l_id', 'context_id')} AS flow_id, qualified_name, l_id AS source_context_ref, context_id AS target_context_ref,
    l_node AS source_node_ref, observed_at_node_ref AS target_node_ref,
    CASE WHEN value = l_value THEN 'preserved' WHEN propagation_contract = 'regenerated' THEN 'regenerated' ELSE 'mutated' END AS status
    FROM seen WHERE l_node IS NOT NULL AND observed_at_node_ref IS NOT NULL)"""
TEMPORAL = f""", temporal AS (SELECT r.case_id, {sql_id('temporal-constraint', 'relation_id')} AS constraint_id, relation_id, source_ref, target_ref,
    CASE WHEN r.kind IN ({", ".join(f"'{k}'" for k in assembly.CAUSAL)}) AND t.start_us < s.start_us THEN 'timestamp_conflict' WHEN coalesce(s.end_us, s.start_us) <= t.start_us THEN 'happens_before'
         WHEN s.start_us <= t.start_us THEN 'overlaps' ELSE 'ordering_unknown' END AS temporal_kind,
    CASE WHEN derivation = 'heuristic' THEN 'heuristic' ELSE 'deterministic' END AS derivation
    FROM every_rel r JOIN nodes s ON r.case_id = s.case_id AND r.source_ref = s.node_id JOIN nodes t ON r.case_id = t.case_id AND r.target_ref = t.node_id)"""
_JOINED = lambda c: f"array_to_string({c}, ',') AS {c}"

query("d01_parent_span_edges", PARENT + f" SELECT {_REL} FROM parent_rel")(lambda t: assembly.parent_span_relations(t["nodes"]))
query("d02_message_delivery", MESSAGE + f" SELECT {_REL} FROM message_rel")(lambda t: assembly.message_relations(t["nodes"]))
query("f01_retry_lineage", RETRY + f" SELECT {_REL} FROM retry_rel")(lambda t: assembly.retry_relations(t["nodes"]))
query("d03_repeated_effects", REPEAT + f" SELECT {_REL} FROM repeat_rel")(lambda t: assembly.effect_relations(t["effects"]))
query("d04_existing_edge_suppression", DERIVED + f" SELECT {_REL} FROM derived")(lambda t: assembly.derived_relations(t["nodes"], t["effects"], t["relations"]))
query("h02_union_of_relations", DERIVED + " FROM every_rel")(lambda t: assembly.all_relations(t["nodes"], t["effects"], t["relations"]))
query("e01_identity_groups", GROUPS + " FROM id_groups")(lambda t: assembly.identity_groups(t["nodes"]))
query("e02_effect_groups", EFFECT_GROUPS + f" SELECT case_id, logical_effect_key, {_JOINED('member_effect_refs')}, durable_count, {_JOINED('idempotency_keys')}, maximum, group_id FROM effect_groups")(
    lambda t: assembly.effect_groups(t["effects"]))
query("f02_context_flows", FLOWS + " FROM flows")(lambda t: assembly.context_flows(t["contexts"], t["nodes"]))
query("i03_temporal_constraints", DERIVED + TEMPORAL + " FROM temporal")(lambda t: assembly.temporal_constraints(graph(t)["graph"]["relations"], t["nodes"]))
query("e03_graph_report", DERIVED + FLOWS + GROUPS + TEMPORAL + """ SELECT c.case_id, (SELECT count(*) FROM nodes x WHERE x.case_id = c.case_id) AS nodes,
    (SELECT count(*) FROM every_rel x WHERE x.case_id = c.case_id AND NOT derived) AS source_relations, (SELECT count(*) FROM every_rel x WHERE x.case_id = c.case_id AND derived) AS derived_relations,
    (SELECT count(*) FROM every_rel x WHERE x.case_id = c.case_id AND derivation = 'heuristic') AS heuristic_relations, (SELECT count(*) FROM flows x WHERE x.case_id = c.case_id) AS flows,
    (SELECT count(*) FROM id_groups x WHERE x.case_id = c.case_id) AS groups, (SELECT count(*) FROM temporal x WHERE x.case_id = c.case_id AND temporal_kind = 'timestamp_conflict') AS warnings
    FROM cases c""")(lambda t: assembly.assemble(t)["report"])
query("i04_graph_assembly", DERIVED + TEMPORAL + " SELECT case_id, temporal_kind, count(*) AS n FROM temporal GROUP BY ALL")(
    lambda t: assembly.assemble(t)["temporal_constraints"].groupBy("case_id", "temporal_kind").agg(F.count("*").alias("n")))
query("i05_timeline", """ SELECT n.case_id, node_id, coalesce(c.name, component_ref) AS lane, (start_us - min(start_us) OVER w) / 1000.0 AS offset_ms,
    greatest(0, coalesce(end_us, start_us) - start_us) / 1000.0 AS duration_ms, (max(coalesce(end_us, start_us)) OVER w - min(start_us) OVER w) / 1000.0 AS total_ms
    FROM nodes n LEFT JOIN components c ON n.component_ref = c.component_id WINDOW w AS (PARTITION BY n.case_id)""")(lambda t: assembly.timeline(t["nodes"], t["components"]))
query("d21_timeline_connectors", DERIVED + """ SELECT r.case_id, relation_id, r.kind, source_ref, target_ref FROM every_rel r
    JOIN nodes s ON r.case_id = s.case_id AND r.source_ref = s.node_id JOIN nodes t ON r.case_id = t.case_id AND r.target_ref = t.node_id""")(
    lambda t: assembly.timeline_connectors(graph(t)["graph"]["relations"], t["nodes"]))
query("i01_connected_components", DERIVED + """, linked AS (SELECT r.case_id, source_ref, target_ref FROM every_rel r JOIN nodes s ON s.case_id = r.case_id AND s.node_id = source_ref JOIN nodes t ON t.case_id = r.case_id AND t.node_id = target_ref),
    edges AS (SELECT case_id, source_ref AS a, target_ref AS b FROM linked UNION SELECT case_id, target_ref, source_ref FROM linked),
    reach(case_id, node_id, label) AS (SELECT case_id, node_id, node_id FROM nodes UNION SELECT e.case_id, e.b, r.label FROM reach r JOIN edges e ON r.case_id = e.case_id AND r.node_id = e.a)
    SELECT case_id, node_id, min(label) AS component FROM reach GROUP BY ALL""")(
    lambda t: assembly.components_of(t["nodes"], checkpointed(graph(t)["graph"]["relations"])))
ORACLE_SQL["i01_connected_components"] = ORACLE_SQL["i01_connected_components"].replace("WITH ev", "WITH RECURSIVE ev", 1)


def _around_first(t: dict) -> DataFrame:
    """Edges near the least node: one row comes to the driver."""
    center = t["nodes"].agg(F.min(F.struct("node_id", "case_id")).alias("c")).select("c.*").first()
    relations = checkpointed(graph(t)["graph"]["relations"])
    return assembly.neighborhood(relations, center["case_id"], center["node_id"], 2)[1].select("relation_id").distinct()


query("i02_neighborhood", DERIVED + """, center AS (SELECT arg_min(case_id, (node_id, case_id)) AS case_id, min(node_id) AS entity FROM nodes),
    near_rel AS (SELECT r.* FROM every_rel r JOIN center USING (case_id)), both_ways AS (SELECT source_ref AS a, target_ref AS b, relation_id FROM near_rel UNION ALL SELECT target_ref, source_ref, relation_id FROM near_rel),
    one AS (SELECT entity FROM center UNION SELECT b FROM both_ways JOIN center ON a = entity)
    SELECT DISTINCT relation_id FROM both_ways WHERE a IN (FROM one)""")(_around_first)

# the same by the names of an earlier round; tests hold these against brute force too
query("i08_components_of_all_relations")(lambda t: assembly.components_of(t["nodes"], checkpointed(graph(t)["graph"]["relations"])))
query("i09_neighborhood_of_all_relations")(_around_first)

# invariants: statuses and references
_IN = """, res AS (SELECT c.case_id, {status} AS status, {nodes} AS node_refs, {effects} AS effect_refs, {contexts} AS context_refs, {evidence} AS evidence_refs FROM cases c {join})
SELECT case_id, status, coalesce(node_refs, '') AS node_refs, coalesce(effect_refs, '') AS effect_refs, coalesce(context_refs, '') AS context_refs, coalesce(evidence_refs, '') AS evidence_refs FROM res"""


def _invariant(name: str, handler, ctes: str, join: str, status: str, nodes="''", effects="''", contexts="''", evidence="''") -> None:
    query(name, ctes + _IN.format(status=status, nodes=nodes, effects=effects, contexts=contexts, evidence=evidence, join=join))(lambda t: handler(graph(t)))


def _agg(where: str, ref: str = "node_id") -> str:
    return f"string_agg(DISTINCT {ref}, ',' ORDER BY {ref}) FILTER ({where})"


def _evidence(refs: str) -> str:
    """SQL of the evidence of nodes whose ids are in a comma-joined column."""
    return f"(SELECT string_agg(DISTINCT o, ',' ORDER BY o) FROM (SELECT unnest(observation_refs) AS o FROM nodes n WHERE n.case_id = c.case_id AND list_contains(string_split({refs}, ','), node_id)))"


_node_rule = lambda bad, applies="TRUE": f", f AS (SELECT case_id, {_agg(bad)} AS refs, bool_or({applies}) AS applies FROM nodes GROUP BY case_id)"
_LEFT = "LEFT JOIN f ON c.case_id = f.case_id"
_invariant("j01_context_required_continuity", invariants.context_required_continuity, """, s AS (SELECT *, first_value(context_id) OVER w AS source_id, first_value(value) OVER w AS source_value, first_value(origin_node_ref) OVER w AS origin
    FROM contexts WHERE propagation_contract IN ('required', 'translated') WINDOW w AS (PARTITION BY case_id, namespace, field_name ORDER BY CASE WHEN origin_node_ref = observed_at_node_ref THEN 0 ELSE 1 END, input_seq)),
    r AS (SELECT case_id, context_id, origin AS ref, FALSE AS bad FROM s UNION ALL SELECT case_id, context_id, observed_at_node_ref, TRUE FROM s WHERE context_id <> source_id AND value IS DISTINCT FROM source_value),
    f AS (SELECT case_id, bool_or(bad) AS bad, string_agg(DISTINCT ref, ',' ORDER BY ref) AS refs, string_agg(DISTINCT context_id, ',' ORDER BY context_id) AS ctx FROM r GROUP BY case_id)""",
    _LEFT, "CASE WHEN bad IS NULL THEN 'not_applicable' WHEN bad THEN 'violated' ELSE 'satisfied' END", "refs", contexts="ctx", evidence=f"CASE WHEN bad THEN {_evidence('refs')} END")
_leak = "observed_at_node_ref IS NOT NULL AND observed_at_node_ref IS DISTINCT FROM origin_node_ref"
_invariant("j02_context_forbidden_propagation", invariants.context_forbidden_propagation, f""", f AS (SELECT case_id, bool_or({_leak}) AS bad, {_agg(_leak, 'context_id')} AS leaks, {_agg('TRUE', 'context_id')} AS everything,
    {_agg(_leak, 'observed_at_node_ref')} AS places FROM contexts WHERE propagation_contract = 'forbidden' GROUP BY case_id)""",
    _LEFT, "CASE WHEN bad IS NULL THEN 'not_applicable' WHEN bad THEN 'violated' ELSE 'satisfied' END", "places", contexts="CASE WHEN bad THEN leaks ELSE everything END")
_invariant("j03_identity_execution_isolation", invariants.identity_execution_isolation, _node_rule("identity_collision") + """, m AS (SELECT DISTINCT case_id FROM (SELECT case_id, workflow_id FROM nodes WHERE workflow_id <> '' AND tenant_id <> ''
    GROUP BY ALL HAVING count(DISTINCT tenant_id) > 1))""", _LEFT + " LEFT JOIN m ON c.case_id = m.case_id", "CASE WHEN refs IS NOT NULL OR m.case_id IS NOT NULL THEN 'violated' ELSE 'satisfied' END", "refs", evidence=_evidence("refs"))
_invariant("j04_identity_workflow_correlatable", invariants.identity_workflow_correlatable, f", f AS (SELECT case_id, {_agg('workflow_id IS NULL')} AS missing, count(DISTINCT workflow_id) AS n, {_agg('TRUE')} AS everything FROM nodes GROUP BY case_id)",
    _LEFT, "CASE WHEN missing IS NOT NULL OR n > 1 AND category NOT IN ('observed_composite', 'comparison') THEN 'violated' ELSE 'satisfied' END",
    "CASE WHEN missing IS NOT NULL THEN missing WHEN n > 1 AND category NOT IN ('observed_composite', 'comparison') THEN everything END", evidence=_evidence("missing"))
_invariant("j05_effect_at_most_once", invariants.effect_at_most_once, EFFECT_GROUPS + """, bad AS (SELECT e.*, unnest(evidence_refs) AS ev FROM effects e JOIN effect_groups g USING (case_id, logical_effect_key) WHERE durable_count > maximum),
    f AS (SELECT case_id, string_agg(DISTINCT effect_id, ',' ORDER BY effect_id) AS e, string_agg(DISTINCT producer_node_ref, ',' ORDER BY producer_node_ref) AS p, string_agg(DISTINCT ev, ',' ORDER BY ev) AS v FROM bad GROUP BY case_id),
    any_effect AS (SELECT DISTINCT case_id FROM effects)""", _LEFT + " LEFT JOIN any_effect a ON c.case_id = a.case_id",
    "CASE WHEN a.case_id IS NULL THEN 'not_applicable' WHEN e IS NOT NULL THEN 'violated' ELSE 'satisfied' END", "p", "e", evidence="v")
_invariant("j06_effect_required_eventuality", invariants.effect_required_eventuality, """, k AS (SELECT case_id, logical_effect_key, bool_or(required) AS required, bool_or(durability IN ('committed', 'durable')) AS durable FROM effects GROUP BY ALL),
    f AS (SELECT case_id, bool_or(required) AS applies, bool_or(required AND NOT durable) AS bad FROM k GROUP BY case_id)""", _LEFT,
    "CASE WHEN applies IS NOT TRUE THEN 'not_applicable' WHEN bad THEN 'violated' ELSE 'satisfied' END")
LATEST = """, latest AS (SELECT r.case_id, r.node_id AS read_ref, r.start_us AS read_us, p.node_id AS producer_ref, p.end_us AS visible_us,
    row_number() OVER (PARTITION BY r.case_id, r.node_id ORDER BY p.start_us DESC, p.event_id) AS n
    FROM nodes r JOIN nodes p ON r.case_id = p.case_id AND r.kind = 'read' AND (p.kind = 'transaction' OR p.kind = 'write' AND p.start_us <= r.start_us))"""
query("d10_asof_producer", LATEST + " SELECT case_id, read_ref, read_us, producer_ref, visible_us FROM latest WHERE n = 1")(lambda t: invariants.latest_producers(t["nodes"]))
_invariant("j07_ordering_read_after_visibility", invariants.ordering_read_after_visibility, LATEST + """, f AS (SELECT case_id, string_agg(DISTINCT r, ',' ORDER BY r) AS refs FROM
    (SELECT case_id, unnest([read_ref, producer_ref]) AS r FROM latest WHERE n = 1 AND read_us < visible_us) GROUP BY case_id),
    k AS (SELECT case_id, bool_or(kind = 'read') AND bool_or(kind IN ('transaction', 'write')) AS applies FROM nodes GROUP BY case_id)""", _LEFT + " LEFT JOIN k ON c.case_id = k.case_id",
    "CASE WHEN applies IS NOT TRUE THEN 'not_applicable' WHEN refs IS NOT NULL THEN 'violated' ELSE 'satisfied' END", "refs", evidence=_evidence("refs"))
_invariant("j08_consistency_required_freshness", invariants.consistency_required_freshness, _node_rule("kind IN ('read', 'cache_read') AND status IN ('stale', 'stale_read')", "kind IN ('read', 'cache_read')"), _LEFT,
    "CASE WHEN applies IS NOT TRUE THEN 'not_applicable' WHEN refs IS NOT NULL THEN 'violated' ELSE 'satisfied' END", "refs", evidence=_evidence("refs"))
_invariant("j09_contract_schema_compatible", invariants.contract_schema_compatible, f", f AS (SELECT case_id, count(DISTINCT schema_version) AS n, {_agg('TRUE')} AS refs FROM nodes WHERE schema_version IS NOT NULL GROUP BY case_id)", _LEFT,
    "CASE WHEN n IS NULL THEN 'not_applicable' WHEN n > 1 THEN 'violated' ELSE 'satisfied' END", "CASE WHEN n > 1 THEN refs END", evidence=f"CASE WHEN n > 1 THEN {_evidence('refs')} END")
_invariant("j10_resource_capacity_bounded", invariants.resource_capacity_bounded, _node_rule("status = 'resource_exhausted'"), _LEFT, "CASE WHEN refs IS NOT NULL THEN 'violated' ELSE 'satisfied' END", "refs", evidence=_evidence("refs"))
WORK = """, work AS (SELECT case_id, kind, operation, count(*) AS n, max(maximum_amplification) AS maximum, bool_or(amplified) AS amplified, bool_and(coalesce(task_attempt, 0) <> 0) AS all_attempts,
    bool_or(amplified) OR (count(*) > max(maximum_amplification) AND NOT bool_and(coalesce(task_attempt, 0) <> 0)) AS bad FROM nodes GROUP BY ALL)"""
query("e06_work_groups", WORK + " FROM work")(lambda t: invariants.work_groups(t["nodes"]))
_invariant("j11_performance_work_amplification", invariants.performance_work_amplification, WORK + f", f AS (SELECT n.case_id, {_agg('TRUE')} AS refs FROM nodes n JOIN work w ON n.case_id = w.case_id AND n.kind = w.kind AND n.operation = w.operation AND w.bad GROUP BY n.case_id)",
    _LEFT, "CASE WHEN refs IS NOT NULL THEN 'violated' ELSE 'satisfied' END", "refs", evidence=_evidence("refs"))
BROKEN = f""", broken AS (SELECT {", ".join("r." + c for c in _REL.split(", "))} FROM every_rel r JOIN nodes s ON r.case_id = s.case_id AND r.source_ref = s.node_id JOIN nodes t ON r.case_id = t.case_id AND r.target_ref = t.node_id
    WHERE derived AND r.kind IN ('delivers', 'spawns') AND (s.trace_id IS DISTINCT FROM t.trace_id OR t.parent_span_id IS NULL OR t.parent_span_id = ''))"""
query("d13_broken_propagation", DERIVED + BROKEN + " FROM broken")(lambda t: invariants.broken_links(graph(t)["graph"]["relations"], t["nodes"]))
_invariant("j12_observability_required_linkage", invariants.observability_required_linkage, DERIVED + BROKEN + f""", l AS (SELECT case_id, string_agg(DISTINCT r, ',' ORDER BY r) AS refs FROM (SELECT case_id, unnest([source_ref, target_ref]) AS r FROM broken) GROUP BY case_id),
    a AS (SELECT case_id, string_agg(observation_id, ',' ORDER BY observation_id) AS refs FROM observations WHERE contradiction GROUP BY case_id),
    edges AS (SELECT DISTINCT r.case_id, r.source_ref AS a, r.target_ref AS b FROM every_rel r JOIN nodes s ON r.case_id = s.case_id AND r.source_ref = s.node_id JOIN nodes t ON r.case_id = t.case_id AND r.target_ref = t.node_id),
    both_ways AS (SELECT case_id, a, b FROM edges UNION SELECT case_id, b, a FROM edges), start AS (SELECT case_id, min(node_id) AS node_id, count(*) AS n, {_agg('TRUE')} AS everything FROM nodes GROUP BY case_id),
    reach AS (SELECT case_id, node_id FROM start UNION SELECT e.case_id, e.b FROM reach r JOIN both_ways e ON r.case_id = e.case_id AND r.node_id = e.a),
    parts AS (SELECT s.case_id, s.everything, (SELECT count(*) FROM reach r WHERE r.case_id = s.case_id) < s.n AS several FROM start s)""",
    "LEFT JOIN l ON c.case_id = l.case_id LEFT JOIN a ON c.case_id = a.case_id LEFT JOIN parts p ON c.case_id = p.case_id",
    "CASE WHEN a.refs IS NOT NULL THEN 'contradicted' WHEN l.refs IS NOT NULL THEN 'violated' WHEN several THEN 'inconclusive' ELSE 'satisfied' END",
    "CASE WHEN a.refs IS NOT NULL THEN NULL WHEN l.refs IS NOT NULL THEN l.refs WHEN several THEN everything END", evidence="a.refs")
ORACLE_SQL["j12_observability_required_linkage"] = ORACLE_SQL["j12_observability_required_linkage"].replace("WITH ev", "WITH RECURSIVE ev", 1)
_secret = "list_contains(sensitivity, 'credential') OR list_has_any(list_transform(attribute_keys, lambda x: lower(x)), [" + ", ".join(f"'{k}'" for k in invariants.SECRET_KEYS) + "])"
_invariant("j13_privacy_prohibited_capture", invariants.privacy_prohibited_capture, f", f AS (SELECT case_id, {_agg(_secret, 'observation_id')} AS refs FROM observations GROUP BY case_id)", _LEFT,
    "CASE WHEN refs IS NOT NULL THEN 'violated' ELSE 'satisfied' END", evidence="refs")
query("e04_workflow_tenants", """ SELECT case_id, workflow_id, string_agg(DISTINCT tenant_id, ',' ORDER BY tenant_id) AS tenants FROM nodes WHERE workflow_id <> '' GROUP BY case_id, workflow_id""")(lambda t: invariants.workflow_tenants(t["nodes"]))
query("e05_schema_versions", " SELECT case_id, string_agg(DISTINCT schema_version, ',' ORDER BY schema_version) AS versions FROM nodes WHERE schema_version IS NOT NULL GROUP BY case_id")(
    lambda t: t["nodes"].where("schema_version is not null").groupBy("case_id").agg(F.array_sort(F.collect_set("schema_version")).alias("versions")))
query("f03_first_of_role", """ SELECT case_id, role, node_id FROM nodes QUALIFY row_number() OVER (PARTITION BY case_id, role ORDER BY coalesce(task_attempt, 0), start_us, node_id) = 1""")(lambda t: invariants.first_of_role(t["nodes"]))


def _expected(t: dict) -> DataFrame:
    ten = F.explode(F.sequence(F.lit(0), F.lit(9)))
    return t["cases"].select("case_id", ten.alias("i")).select(
        "case_id", F.concat(F.lit("role."), "i").alias("source_role"), F.concat(F.lit("role."), (F.col("i") + 1) % 10).alias("target_role"), F.lit("invokes").alias("kind"))


query("d12_missing_expected_edges", """, roles AS (SELECT case_id, role, node_id FROM nodes QUALIFY row_number() OVER (PARTITION BY case_id, role ORDER BY coalesce(task_attempt, 0), start_us, node_id) = 1),
    expected AS (SELECT case_id, 'role.' || i AS s, 'role.' || (i + 1) % 10 AS t FROM cases, range(10) x(i))
    SELECT e.case_id, e.s AS source_role, e.t AS target_role, 'invokes' AS kind, a.node_id AS source_ref, b.node_id AS target_ref FROM expected e JOIN roles a ON e.case_id = a.case_id AND e.s = a.role JOIN roles b ON e.case_id = b.case_id AND e.t = b.role
    WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.case_id = e.case_id AND r.source_ref = a.node_id AND r.target_ref = b.node_id AND r.kind = 'invokes')""")(
    lambda t: invariants.missing_expected_edges(_expected(t), t["relations"], t["nodes"]).select("case_id", "source_role", "target_role", "kind", "source_ref", "target_ref"))
query("d11_missing_effects", """ SELECT DISTINCT case_id, logical_effect_key FROM effects e WHERE required AND NOT EXISTS
    (SELECT 1 FROM effects d WHERE d.case_id = e.case_id AND d.logical_effect_key = e.logical_effect_key AND d.durability IN ('committed', 'durable'))""")(
    lambda t: t["effects"].where("required").select("case_id", "logical_effect_key").distinct().join(t["effects"].where(F.col("durability").isin(assembly.DURABLE)), ["case_id", "logical_effect_key"], "left_anti"))
query("d07_evidence_of_nodes", """, r AS (SELECT case_id, node_id, unnest(observation_refs) AS o FROM nodes WHERE status <> 'ok')
    SELECT c.case_id, coalesce((SELECT string_agg(DISTINCT o, ',' ORDER BY o) FROM r WHERE r.case_id = c.case_id), '') AS evidence_refs FROM cases c""")(
    lambda t: invariants.evidence_of(t["cases"].join(t["nodes"].groupBy("case_id").agg(invariants.refs_if(F.col("status") != "ok", F.col("node_id")).alias("node_refs")), "case_id"), t["nodes"]).select("case_id", "evidence_refs"))
query("e21_entity_counts", " ".join(["", "UNION ALL".join(f" SELECT case_id, '{e}' AS entity, count(*) AS n FROM {e} GROUP BY case_id " for e in ("nodes", "relations", "contexts", "effects", "observations"))]))(
    lambda t: invariants.entity_counts(t))
query("c12_evidence_preflight", """, need AS (SELECT * FROM (VALUES ('context.required-continuity', 'contexts', 1), ('observability.required-linkage', 'relations', 1), ('effect.at-most-once', 'effects', 1), ('ordering.read-after-visibility', 'nodes', 2)) v(invariant, entity, least)),
    have AS (SELECT case_id, 'nodes' AS entity, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT case_id, 'relations', count(*) FROM relations GROUP BY ALL UNION ALL SELECT case_id, 'contexts', count(*) FROM contexts GROUP BY ALL UNION ALL SELECT case_id, 'effects', count(*) FROM effects GROUP BY ALL)
    SELECT c.case_id, invariant, string_agg(DISTINCT need.entity, ',' ORDER BY need.entity) AS missing FROM cases c CROSS JOIN need LEFT JOIN have h ON h.case_id = c.case_id AND h.entity = need.entity WHERE coalesce(n, 0) < least GROUP BY ALL""")(
    lambda t: invariants.missing_evidence(t, ["context.required-continuity", "effect.at-most-once", "ordering.read-after-visibility"]).unionByName(
        invariants.missing_evidence(t, ["observability.required-linkage"])))
_KEYS = dict(zip(invariants.INVARIANTS, (
    "j01_context_required_continuity", "j02_context_forbidden_propagation", "j03_identity_execution_isolation", "j04_identity_workflow_correlatable", "j05_effect_at_most_once", "j06_effect_required_eventuality",
    "j07_ordering_read_after_visibility", "j08_consistency_required_freshness", "j09_contract_schema_compatible", "j10_resource_capacity_bounded", "j11_performance_work_amplification",
    "j12_observability_required_linkage", "j13_privacy_prohibited_capture")))
_NEEDS = ", ".join(f"('{i}', '{entity}', {least})" for i, (_, _, needs) in invariants.INVARIANTS.items() for entity, least in needs.items())
_HAVE = " UNION ALL ".join(f"SELECT case_id, '{e}' AS entity, count(*) AS n FROM {e} GROUP BY case_id" for e in ("nodes", "relations", "contexts", "effects", "observations"))
#: Status of every invariant in every case, with the evidence preflight.
RUNTIME = f"""SELECT v.case_id, v.invariant, CASE WHEN l.case_id IS NULL THEN v.status ELSE 'inconclusive' END AS status
    FROM ({" UNION ALL ".join(f"SELECT case_id, '{i}' AS invariant, status FROM ({ORACLE_SQL[key]})" for i, key in _KEYS.items())}) v
    LEFT JOIN ({SQL_VIEWS}, need AS (SELECT * FROM (VALUES {_NEEDS}) x(invariant, entity, least)), have AS ({_HAVE})
        SELECT DISTINCT c.case_id, invariant FROM cases c CROSS JOIN need LEFT JOIN have h ON h.case_id = c.case_id AND h.entity = need.entity WHERE coalesce(n, 0) < least) l
    ON v.case_id = l.case_id AND v.invariant = l.invariant"""


query("j14_invariant_runtime", RUNTIME, views=False)(lambda t: invariants.evaluate(settled_graph(t)).select("case_id", "invariant", "status"))
query("e07_status_histogram", f"""SELECT case_id, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in invariants.STATUSES)} FROM ({RUNTIME}) GROUP BY case_id""", views=False)(
    lambda t: invariants.histogram(invariants.evaluate(settled_graph(t))))
query("j15_registry_selection", "SELECT x AS invariant, 'selected' AS status, count(*) AS cases FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(['effect.at-most-once', 'privacy.prohibited-capture']) AS x) GROUP BY x", views=False)(
    lambda t: invariants.evaluate(graph(t), ["privacy.prohibited-capture", "effect.at-most-once"]).groupBy("invariant").agg(F.lit("selected").alias("status"), F.count("*").alias("cases")))


def _failing(t: dict) -> DataFrame:
    """An evaluator that is planned well and fails in a task, on the first row of some case."""
    return invariants.resource_capacity_bounded(t).withColumn("status", F.when(F.col("case_id").isNotNull(), F.raise_error(F.concat(F.lit("ResourceError: no capacity of "), "case_id"))).otherwise(F.col("status")))


query("j18_isolated_runtime", f"""SELECT case_id, invariant, CASE WHEN status <> 'inconclusive' AND invariant = 'resource.capacity-bounded' THEN 'evaluation_error' ELSE status END AS status,
    status <> 'inconclusive' AND invariant = 'resource.capacity-bounded' AS told FROM ({RUNTIME})""", views=False)(
    lambda t: invariants.evaluate(settled_graph(t), handlers={"resource.capacity-bounded": _failing}, isolated=True).select(
        "case_id", "invariant", "status", F.coalesce(F.col("error").contains("no capacity of case."), F.lit(False)).alias("told")))


_EVEN = "CAST(substr(case_id, 6) AS INT) % 2 = 0"


def contracts(t: dict) -> dict:
    """The tables with contracts for every second case: expected effects, and edges between roles."""
    key = F.concat(F.lit("effect-key"), F.substring("task_id", 5, 1000)).alias("logical_effect_key")
    wanted = t["nodes"].where(f"event_id % 7 = 0 and {_EVEN}").groupBy("case_id", key).agg(F.bool_or(F.col("event_id") % 3 != 0).alias("required"))
    return t | {"expected_effects": wanted, "expected_edges": _expected(t).where(_EVEN)}


_invariant("j16_required_effects_of_contracts", lambda t: invariants.effect_required_eventuality(contracts(t)), f""", contract AS (SELECT case_id, 'effect-key' || substr(task_id, 5) AS logical_effect_key, bool_or(event_id % 3 <> 0) AS required
        FROM nodes WHERE event_id % 7 = 0 AND {_EVEN} GROUP BY ALL),
    wanted AS (SELECT case_id, logical_effect_key FROM contract WHERE required UNION SELECT case_id, logical_effect_key FROM effects WHERE required AND case_id NOT IN (SELECT case_id FROM contract)),
    f AS (SELECT case_id, TRUE AS applies FROM contract UNION SELECT case_id, TRUE FROM wanted),
    m AS (SELECT DISTINCT case_id FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM effects e WHERE e.case_id = w.case_id AND e.logical_effect_key = w.logical_effect_key AND e.durability IN ('committed', 'durable')))""",
    _LEFT + " LEFT JOIN m ON c.case_id = m.case_id", "CASE WHEN applies IS NOT TRUE THEN 'not_applicable' WHEN m.case_id IS NOT NULL THEN 'violated' ELSE 'satisfied' END")
query("j17_linkage_of_contracts", "")(lambda t: invariants.observability_required_linkage(graph(contracts(t))))
ORACLE_SQL["j17_linkage_of_contracts"] = ORACLE_SQL["j12_observability_required_linkage"].replace(", l AS (", f""", firsts AS (SELECT case_id, role, node_id FROM nodes QUALIFY row_number() OVER (PARTITION BY case_id, role ORDER BY coalesce(task_attempt, 0), start_us, node_id) = 1),
    gaps AS (SELECT case_id, source_ref, target_ref FROM broken UNION ALL SELECT e.case_id, x.node_id, y.node_id FROM (SELECT case_id, 'role.' || i AS s, 'role.' || (i + 1) % 10 AS t FROM cases, range(10) x(i) WHERE {_EVEN}) e
        JOIN firsts x ON e.case_id = x.case_id AND e.s = x.role JOIN firsts y ON e.case_id = y.case_id AND e.t = y.role
        WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.case_id = e.case_id AND r.source_ref = x.node_id AND r.target_ref = y.node_id AND r.kind = 'invokes')), l AS (""", 1).replace(
    "[source_ref, target_ref]) AS r FROM broken)", "[source_ref, target_ref]) AS r FROM gaps)", 1)
