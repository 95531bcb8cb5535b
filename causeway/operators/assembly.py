"""Graph assembly: derived relations, identity and effect groups, context flows, temporal constraints, timeline.

Every function takes and returns DataFrames keyed by ``case_id`` and works on all cases at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.scalars import stable_id, truthy
from causeway.operators.graph import components_within

RELATION = ["case_id", "relation_id", "kind", "source_ref", "target_ref", "derivation"]
# Kinds of relation that order their ends in time.
CAUSAL = ["parent_of", "invokes", "spawns", "schedules", "publishes", "delivers", "consumes", "retries", "contains", "writes_to", "reads_from"]
DURABLE = ["committed", "durable"]
IDENTITY_KINDS = {
    "trace": "trace_id", "workflow": "workflow_id", "logical_operation": "logical_operation_id", "task": "task_id",
    "message": "message_id", "transaction": "transaction_id", "tenant": "tenant_id", "idempotency_scope": "idempotency_key",
}


def _relation(rows: DataFrame, prefix: str, kind: str, derivation: str, *parts: str) -> DataFrame:
    return rows.select(
        "case_id", stable_id(prefix, *[F.col(p) for p in parts]).alias("relation_id"), F.lit(kind).alias("kind"),
        "source_ref", "target_ref", F.lit(derivation).alias("derivation"),
    )


def without_existing(derived: DataFrame, existing: DataFrame) -> DataFrame:
    """Derived relations that the source does not already hold."""
    return derived.join(existing.select("case_id", "kind", "source_ref", "target_ref").distinct(), ["case_id", "kind", "source_ref", "target_ref"], "left_anti").select(RELATION)


def parent_span_relations(nodes: DataFrame) -> DataFrame:
    """An edge from the holder of a span to each node that names it as parent; of equal spans the last node counts."""
    order = F.struct("start_us", "node_id")
    holders = nodes.where(truthy(F.col("span_id"))).groupBy("case_id", "span_id").agg(F.max(order)["node_id"].alias("source_ref"))
    children = nodes.where(truthy(F.col("parent_span_id"))).select("case_id", F.col("parent_span_id").alias("span_id"), F.col("node_id").alias("target_ref"))
    return _relation(children.join(holders, ["case_id", "span_id"]), "relation.parent-span", "parent_of", "source_native", "source_ref", "target_ref")


def message_relations(nodes: DataFrame) -> DataFrame:
    """From the first publisher of a message to each node that takes it in."""
    with_message = nodes.where(truthy(F.col("message_id")))
    first = F.min(F.struct("start_us", "node_id"))["node_id"].alias("source_ref")
    publishers = with_message.where(F.col("kind") == "message_publish").groupBy("case_id", "message_id").agg(first)
    takers = with_message.where(F.col("kind").isin("message_delivery", "message_consume", "task_attempt"))
    rows = takers.select("case_id", "message_id", F.col("node_id").alias("target_ref")).join(publishers, ["case_id", "message_id"])
    return _relation(rows, "relation.message", "delivers", "deterministic", "message_id", "source_ref", "target_ref")


def retry_relations(nodes: DataFrame) -> DataFrame:
    """Between neighbours of a task's attempts, in order, where the attempt grows."""
    order = Window.partitionBy("case_id", "task_id").orderBy(F.coalesce("task_attempt", F.lit(10**9)), "start_us", "node_id")
    rows = nodes.where(truthy(F.col("task_id"))).select(
        "case_id", "task_id", F.col("node_id").alias("target_ref"), "task_attempt",
        F.lag("node_id").over(order).alias("source_ref"), F.lag("task_attempt").over(order).alias("before"),
    )
    return _relation(rows.where(F.col("task_attempt") > F.col("before")), "relation.retry", "retries", "deterministic", "task_id", "source_ref", "target_ref")


def effect_relations(effects: DataFrame) -> DataFrame:
    """From the least effect of a logical key to every other one."""
    first = F.min("effect_id").over(Window.partitionBy("case_id", "logical_effect_key"))
    rows = effects.select("case_id", "logical_effect_key", first.alias("source_ref"), F.col("effect_id").alias("target_ref"))
    return _relation(rows.where("source_ref <> target_ref"), "relation.repeated-effect", "repeats_effect", "deterministic", "logical_effect_key", "source_ref", "target_ref")


def derived_relations(nodes: DataFrame, effects: DataFrame, relations: DataFrame) -> DataFrame:
    """All derived relations that are not in the source."""
    derived = parent_span_relations(nodes).unionByName(message_relations(nodes)).unionByName(retry_relations(nodes)).unionByName(effect_relations(effects))
    return without_existing(derived, relations)


def all_relations(nodes: DataFrame, effects: DataFrame, relations: DataFrame) -> DataFrame:
    return relations.select(*RELATION, F.lit(False).alias("derived")).unionByName(derived_relations(nodes, effects, relations).withColumn("derived", F.lit(True)))


def identity_groups(nodes: DataFrame, least: int = 2) -> DataFrame:
    """Nodes that share a value of one of eight identities: one pass, unpivoted."""
    stack = ", ".join(f"'{kind}', {column}" for kind, column in IDENTITY_KINDS.items())
    rows = nodes.selectExpr("case_id", "node_id", f"stack({len(IDENTITY_KINDS)}, {stack}) AS (kind, identity_value)").where(truthy(F.col("identity_value")))
    groups = rows.groupBy("case_id", "kind", "identity_value").agg(F.array_sort(F.collect_list("node_id")).alias("member_node_refs"))
    return groups.where(F.size("member_node_refs") >= least).withColumn("group_id", stable_id("identity-group", F.col("kind"), F.col("identity_value")))


def effect_groups(effects: DataFrame) -> DataFrame:
    return effects.groupBy("case_id", "logical_effect_key").agg(
        F.array_sort(F.collect_list("effect_id")).alias("member_effect_refs"), F.count_if(F.col("durability").isin(DURABLE)).alias("durable_count"),
        F.array_sort(F.collect_set(F.when(truthy(F.col("idempotency_key")), F.col("idempotency_key")))).alias("idempotency_keys"),
        F.min(F.coalesce("maximum_durable_count", F.lit(1))).alias("maximum"),
    ).withColumn("group_id", stable_id("effect-group", F.col("logical_effect_key")))


def context_flows(contexts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbouring observations of a context name: preserved, regenerated or mutated."""
    times = nodes.select("case_id", F.col("node_id").alias("observed_at_node_ref"), "start_us")
    name = F.concat("namespace", F.lit("."), "field_name")
    rows = contexts.withColumn("qualified_name", name).join(times, ["case_id", "observed_at_node_ref"], "left")
    order = Window.partitionBy("case_id", "qualified_name").orderBy(F.coalesce("start_us", F.lit(2**63 - 1)), "context_id")
    seen = rows.select("*", *[F.lag(c).over(order).alias(f"last_{c}") for c in ("context_id", "observed_at_node_ref", "value")])
    status = (
        F.when(F.col("last_value").eqNullSafe(F.col("value")), "preserved").when(F.col("propagation_contract") == "regenerated", "regenerated").otherwise("mutated")
    )
    return seen.where(truthy(F.col("observed_at_node_ref")) & truthy(F.col("last_observed_at_node_ref"))).select(
        "case_id", stable_id("context-flow", F.col("qualified_name"), F.col("last_context_id"), F.col("context_id")).alias("flow_id"), "qualified_name",
        F.col("last_context_id").alias("source_context_ref"), F.col("context_id").alias("target_context_ref"),
        F.col("last_observed_at_node_ref").alias("source_node_ref"), F.col("observed_at_node_ref").alias("target_node_ref"), status.alias("status"),
    )


def _with_ends(relations: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Relations between nodes, with columns of both ends as s_ and t_."""
    ends = lambda side, ref: nodes.select("case_id", F.col("node_id").alias(ref), *[F.col(c).alias(f"{side}_{c}") for c in columns])
    return relations.join(ends("s", "source_ref"), ["case_id", "source_ref"]).join(ends("t", "target_ref"), ["case_id", "target_ref"])


def temporal_constraints(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = _with_ends(relations, nodes, "start_us", "end_us")
    s, e, t = F.col("s_start_us"), F.coalesce("s_end_us", "s_start_us"), F.col("t_start_us")
    kind = (
        F.when(F.col("kind").isin(CAUSAL) & (t < s), "timestamp_conflict").when(e <= t, "happens_before").when(s <= t, "overlaps").otherwise("ordering_unknown")
    )
    return rows.select(
        "case_id", stable_id("temporal-constraint", F.col("relation_id")).alias("constraint_id"), "relation_id", "source_ref", "target_ref", kind.alias("temporal_kind"),
        F.when(F.col("derivation") == "heuristic", "heuristic").otherwise("deterministic").alias("derivation"),
    )


def components_of(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(case_id, node_id, component): the least node of each connected part of a case, over relations between nodes."""
    found = components_within(_with_ends(relations, nodes), "case_id", "source_ref", "target_ref").withColumnRenamed("node", "node_id")
    return nodes.select("case_id", "node_id").join(found, ["case_id", "node_id"], "left").withColumn("component", F.coalesce("component", "node_id"))


def neighborhood(relations: DataFrame, case_id: str, center: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """(entities within ``depth`` steps of a centre of a case, edges that touch those within ``depth`` - 1).

    Only the case's relations are walked, as other cases may hold the same ids. One semi-join a step; the frontier alone moves, and ends of any kind are passed.
    """
    relations = relations.where(F.col("case_id") == case_id)
    both = relations.select("source_ref", "target_ref", "relation_id")
    both = both.unionByName(both.select(F.col("target_ref").alias("source_ref"), F.col("source_ref").alias("target_ref"), "relation_id"))
    near = relations.sparkSession.createDataFrame([(center, 0)], "entity string, distance int")
    for step in range(1, depth + 1):
        new = both.join(near.select(F.col("entity").alias("source_ref")), "source_ref", "left_semi").select(F.col("target_ref").alias("entity"))
        near = near.unionByName(new.distinct().withColumn("distance", F.lit(step))).groupBy("entity").agg(F.min("distance").alias("distance"))
    inner = near.where(F.col("distance") < depth).select(F.col("entity").alias("source_ref"))
    edges = both.join(inner, "source_ref", "left_semi").select("relation_id").distinct()
    return near, relations.join(edges, "relation_id", "left_semi")


def timeline(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """An entry a node: offset from the case's origin, duration, lane; an unknown component is its own label."""
    case = Window.partitionBy("case_id")
    end = F.coalesce("end_us", "start_us")
    names = components.select(F.col("component_id").alias("component_ref"), F.col("name").alias("lane"))
    return nodes.join(names, "component_ref", "left").select(
        "case_id", "node_id", F.coalesce("lane", "component_ref").alias("lane"),
        ((F.col("start_us") - F.min("start_us").over(case)) / 1000.0).alias("offset_ms"), (F.greatest(F.lit(0), end - F.col("start_us")) / 1000.0).alias("duration_ms"),
        ((F.max(end).over(case) - F.min("start_us").over(case)) / 1000.0).alias("total_ms"),
    )


def timeline_connectors(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    return _with_ends(relations, nodes).select("case_id", "relation_id", "kind", "source_ref", "target_ref")


def graph_report(nodes: DataFrame, relations: DataFrame, flows: DataFrame, groups: DataFrame, constraints: DataFrame) -> DataFrame:
    """Counts of a case's graph. ``relations`` has ``derived``."""
    count = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    edges = relations.groupBy("case_id").agg(
        F.count_if(~F.col("derived")).alias("source_relations"), F.count_if("derived").alias("derived_relations"),
        F.count_if(F.col("derivation") == "heuristic").alias("heuristic_relations"),
    )
    conflicts = constraints.groupBy("case_id").agg(F.count_if(F.col("temporal_kind") == "timestamp_conflict").alias("warnings"))
    out = count(nodes, "nodes")
    for part in (edges, count(flows, "flows"), count(groups, "groups"), conflicts):
        out = out.join(part, "case_id", "left")
    return out.fillna(0)


def assemble(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The assembled graph of all cases, one lazy DataFrame a member."""
    relations = all_relations(t["nodes"], t["effects"], t["relations"])
    out = {
        "relations": relations, "identity_groups": identity_groups(t["nodes"]), "effect_groups": effect_groups(t["effects"]),
        "context_flows": context_flows(t["contexts"], t["nodes"]), "temporal_constraints": temporal_constraints(relations, t["nodes"]),
    }
    return out | {"report": graph_report(t["nodes"], relations, out["context_flows"], out["identity_groups"], out["temporal_constraints"])}
