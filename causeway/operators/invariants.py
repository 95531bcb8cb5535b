"""Thirteen multi-valued invariants over all cases, and the runtime that runs them.

A handler takes the tables (with the assembled graph under ``graph``) and gives at most
one row a case: case_id, status, node_refs, effect_refs, context_refs, evidence_refs.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.scalars import confidence, evidence_class, stable_id, truthy
from causeway.operators import apart, assembly
from causeway.operators.graph import components_within
from causeway.session import written

STATUSES = ["satisfied", "violated", "inconclusive", "contradicted", "not_applicable", "evaluation_error"]
REFS = ["node_refs", "effect_refs", "context_refs", "evidence_refs"]
#: Columns of nodes that the handlers and the assembly of relations read.
NODE_COLUMNS = [
    "case_id", "node_id", "event_id", "kind", "operation", "start_us", "end_us", "status", "trace_id", "span_id", "parent_span_id", "workflow_id", "task_id", "task_attempt",
    "message_id", "tenant_id", "observation_refs", "role", "schema_version", "amplified", "identity_collision", "maximum_amplification",
]
# Attribute names that must not be captured.
SECRET_KEYS = ["authorization", "cookie", "set-cookie", "password", "secret", "access_token", "refresh_token"]


def refs_if(condition: Column, ref: Column) -> Column:
    """Sorted distinct references of the rows where a condition holds."""
    return F.array_sort(F.collect_set(F.when(condition, ref)))


def _any(condition: Column, ref: Column) -> Column:
    """Whether :func:`refs_if` has any reference: an aggregate that holds none of them."""
    return F.coalesce(F.bool_or(condition & ref.isNotNull()), F.lit(False))


def _result(rows: DataFrame, status: Column, evidence_nodes: Column | None = None, **refs: Column) -> DataFrame:
    """``evidence_nodes`` are nodes whose observations are the evidence, looked up later."""
    none = F.array().cast("array<string>")
    later = [] if evidence_nodes is None else [evidence_nodes.alias("evidence_nodes")]
    return rows.select("case_id", status.alias("status"), *[refs.get(r, none).alias(r) for r in REFS], *later)


def _verdict(bad: Column, applies: Column | None = None) -> Column:
    out = F.when(bad, "violated").otherwise("satisfied")
    return out if applies is None else F.when(~applies, "not_applicable").otherwise(out)


def evidence_of(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``refs`` (case_id, node_refs, ...) with ``evidence_refs``: the observations of those nodes."""
    wanted = refs.select("case_id", F.explode("node_refs").alias("node_id"))
    seen = wanted.join(nodes.select("case_id", "node_id", F.explode("observation_refs").alias("ref")), ["case_id", "node_id"])
    found = seen.groupBy("case_id").agg(F.array_sort(F.collect_set("ref")).alias("found"))
    return refs.join(found, "case_id", "left").withColumn("evidence_refs", F.coalesce("found", F.array().cast("array<string>"))).drop("found")


def _seen(handler: Callable[[dict], DataFrame]) -> Callable[[dict], DataFrame]:
    """A handler whose rows name ``evidence_nodes``; ``handler.rows`` leaves the lookup to who looks up for several at once."""

    @wraps(handler)
    def run(t: dict) -> DataFrame:
        rows = handler(t)
        found = evidence_of(rows.select("case_id", F.col("evidence_nodes").alias("node_refs")), t["nodes"]).select("case_id", "evidence_refs")
        return rows.drop("evidence_refs", "evidence_nodes").join(found, "case_id", "left").select("case_id", "status", *REFS)

    run.rows = handler
    return run


@_seen
def context_required_continuity(t: dict) -> DataFrame:
    """Required or translated contexts keep the value of their source (the first at its origin, else the first)."""
    name = Window.partitionBy("case_id", "name").orderBy((~F.col("origin_node_ref").eqNullSafe(F.col("observed_at_node_ref"))).cast("int"), "input_seq")
    rows = t["contexts"].where(F.col("propagation_contract").isin("required", "translated"))
    rows = rows.withColumn("name", F.concat("namespace", F.lit("."), "field_name")).select(
        "*", F.first("context_id").over(name).alias("source_id"), F.first("value").over(name).alias("source_value"), F.first("origin_node_ref").over(name).alias("source_origin"),
    )
    bad = (F.col("context_id") != F.col("source_id")) & ~F.col("value").eqNullSafe(F.col("source_value"))
    found = rows.groupBy("case_id").agg(
        F.bool_or(bad).alias("bad"), F.array_sort(F.collect_set("context_id")).alias("contexts"),
        refs_if(bad & truthy(F.col("observed_at_node_ref")), F.col("observed_at_node_ref")).alias("mismatched"), F.array_sort(F.collect_set("source_origin")).alias("origins"),
    )
    nodes = F.array_sort(F.array_union("mismatched", "origins"))
    return _result(t["cases"].join(found, "case_id", "left"), _verdict(F.col("bad"), F.col("bad").isNotNull()), F.when(F.col("bad"), nodes), node_refs=nodes, context_refs=F.col("contexts"))


def context_forbidden_propagation(t: dict) -> DataFrame:
    leaked = truthy(F.col("observed_at_node_ref")) & ~F.col("observed_at_node_ref").eqNullSafe(F.col("origin_node_ref"))
    found = t["contexts"].where(F.col("propagation_contract") == "forbidden").groupBy("case_id").agg(
        F.bool_or(leaked).alias("bad"), refs_if(leaked, F.col("context_id")).alias("leaks"), F.array_sort(F.collect_set("context_id")).alias("all"),
        refs_if(leaked, F.col("observed_at_node_ref")).alias("places"),
    )
    rows = t["cases"].join(found, "case_id", "left")
    return _result(rows, _verdict(F.col("bad"), F.col("bad").isNotNull()), node_refs=F.col("places"), context_refs=F.when(F.col("bad"), F.col("leaks")).otherwise(F.col("all")))


def workflow_tenants(nodes: DataFrame) -> DataFrame:
    """Workflows with the tenants they carry."""
    rows = nodes.where(truthy(F.col("workflow_id")) & truthy(F.col("tenant_id")))
    return rows.groupBy("case_id", "workflow_id").agg(F.array_sort(F.collect_set("tenant_id")).alias("tenants"))


@_seen
def identity_execution_isolation(t: dict) -> DataFrame:
    carried = t["nodes"].where(truthy(F.col("workflow_id")) & truthy(F.col("tenant_id"))).groupBy("case_id", "workflow_id").agg(F.count_distinct("tenant_id").alias("tenants"))
    mixed = carried.groupBy("case_id").agg(F.bool_or(F.col("tenants") > 1).alias("mixed"))
    collides = F.col("identity_collision"), F.col("node_id")
    marked = t["nodes"].groupBy("case_id").agg(refs_if(*collides).alias("marked"), _any(*collides).alias("any"))
    rows = t["cases"].join(marked, "case_id", "left").join(mixed, "case_id", "left")
    bad = F.coalesce("mixed", F.lit(False)) | F.coalesce("any", F.lit(False))
    return _result(rows, _verdict(bad), F.col("marked"), node_refs=F.col("marked"))


@_seen
def identity_workflow_correlatable(t: dict) -> DataFrame:
    absent = ~truthy(F.col("workflow_id")) | F.col("workflow_id").isNull(), F.col("node_id")
    found = t["nodes"].groupBy("case_id").agg(
        refs_if(*absent).alias("missing"), _any(*absent).alias("lacks"),
        F.count_distinct(F.when(truthy(F.col("workflow_id")), F.col("workflow_id"))).alias("workflows"), F.array_sort(F.collect_set("node_id")).alias("all"),
    )
    rows = t["cases"].join(found, "case_id", "left")
    lacks = F.coalesce("lacks", F.lit(False))
    several = (F.col("workflows") > 1) & ~F.col("category").isin("observed_composite", "comparison")
    refs = F.when(lacks, F.col("missing")).when(several, F.col("all"))
    return _result(rows, _verdict(F.coalesce(lacks | several, F.lit(False))), F.when(lacks, F.col("missing")), node_refs=refs)


def effect_at_most_once(t: dict) -> DataFrame:
    """No logical effect is durable more often than the least maximum that its members declare."""
    groups = assembly.effect_groups(t["effects"]).withColumn("bad", F.col("durable_count") > F.col("maximum"))
    keys = groups.where("bad").select("case_id", "logical_effect_key")
    offending = t["effects"].join(keys, ["case_id", "logical_effect_key"], "left_semi").groupBy("case_id").agg(
        F.array_sort(F.collect_set("effect_id")).alias("members"), F.array_sort(F.collect_set("producer_node_ref")).alias("producers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence_refs")))).alias("evidence"),
    )
    rows = t["cases"].join(groups.groupBy("case_id").agg(F.bool_or("bad").alias("bad")), "case_id", "left").join(offending, "case_id", "left")
    return _result(rows, _verdict(F.col("bad"), F.col("bad").isNotNull()), node_refs=F.col("producers"), effect_refs=F.col("members"), evidence_refs=F.col("evidence"))


def effect_required_eventuality(t: dict) -> DataFrame:
    """Every effect that is required became durable.

    A case's contract, where it has one (table ``expected_effects``: case_id,
    logical_effect_key, required), says which; else the effects that are marked so.
    """
    key = ["case_id", "logical_effect_key"]
    wanted = t["effects"].where("required").select(*key).distinct()
    governed = wanted.select("case_id")
    if "expected_effects" in t:
        contract = t["expected_effects"]
        named = contract.select("case_id").distinct()
        wanted = contract.where("coalesce(required, true)").select(*key).unionByName(wanted.join(named, "case_id", "left_anti")).distinct()
        governed = governed.unionByName(named)
    durable = t["effects"].where(F.col("durability").isin(assembly.DURABLE)).select(*key)
    missing = wanted.join(durable, key, "left_anti").select("case_id").distinct().withColumn("bad", F.lit(True))
    rows = t["cases"].join(governed.distinct().withColumn("any", F.lit(True)), "case_id", "left").join(missing, "case_id", "left")
    return _result(rows, _verdict(F.coalesce("bad", F.lit(False)), F.coalesce("any", F.lit(False))))


def latest_producers(nodes: DataFrame) -> DataFrame:
    """As-of join: for each read the latest producer at or before it; a transaction counts at any time.

    Reads and producers share one window in the order of time, so no range join is needed.
    """
    rows = nodes.where(F.col("kind").isin("read", "transaction", "write")).withColumn("producer", F.col("kind") != "read")
    struct = F.struct("start_us", (-F.col("event_id")).alias("turn"), "node_id", F.coalesce("end_us", "start_us").alias("end_us"))
    order = Window.partitionBy("case_id").orderBy("start_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = F.greatest(
        F.max(F.when(F.col("producer"), struct)).over(order), F.max(F.when(F.col("kind") == "transaction", struct)).over(Window.partitionBy("case_id"))
    )
    seen = rows.withColumn("latest", both).where(~F.col("producer") & F.col("latest").isNotNull())
    return seen.select(
        "case_id", F.col("node_id").alias("read_ref"), F.col("start_us").alias("read_us"), F.col("latest.node_id").alias("producer_ref"), F.col("latest.end_us").alias("visible_us")
    )


@_seen
def ordering_read_after_visibility(t: dict) -> DataFrame:
    early = latest_producers(t["nodes"]).where("read_us < visible_us")
    bad = early.select("case_id", F.explode(F.array("read_ref", "producer_ref")).alias("ref")).groupBy("case_id").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    kinds = t["nodes"].groupBy("case_id").agg(F.bool_or(F.col("kind") == "read").alias("reads"), F.bool_or(F.col("kind").isin("transaction", "write")).alias("producers"))
    rows = t["cases"].join(kinds, "case_id", "left").join(bad, "case_id", "left")
    return _result(rows, _verdict(F.col("refs").isNotNull(), F.coalesce(F.col("reads") & F.col("producers"), F.lit(False))), F.col("refs"), node_refs=F.col("refs"))


def _by_node(t: dict, bad: Column, relevant: Column | None = None) -> DataFrame:
    found = t["nodes"].groupBy("case_id").agg(
        refs_if(bad, F.col("node_id")).alias("refs"), _any(bad, F.col("node_id")).alias("bad"), F.bool_or(F.lit(True) if relevant is None else relevant).alias("applies"))
    rows = t["cases"].join(found, "case_id", "left")
    applies = None if relevant is None else F.coalesce("applies", F.lit(False))
    return _result(rows, _verdict(F.coalesce("bad", F.lit(False)), applies), F.col("refs"), node_refs=F.col("refs"))


@_seen
def consistency_required_freshness(t: dict) -> DataFrame:
    stale = F.col("status").isin("stale", "stale_read") & F.col("kind").isin("read", "cache_read")
    return _by_node(t, stale, F.col("kind").isin("read", "cache_read"))


@_seen
def contract_schema_compatible(t: dict) -> DataFrame:
    found = t["nodes"].where(F.col("schema_version").isNotNull()).groupBy("case_id").agg(
        F.count_distinct("schema_version").alias("versions"), F.array_sort(F.collect_set("node_id")).alias("refs")
    )
    rows = t["cases"].join(found, "case_id", "left")
    bad = F.col("versions") > 1
    return _result(rows, _verdict(bad, F.col("versions").isNotNull()), F.when(bad, F.col("refs")), node_refs=F.when(bad, F.col("refs")))


@_seen
def resource_capacity_bounded(t: dict) -> DataFrame:
    return _by_node(t, F.col("status") == "resource_exhausted")


def work_groups(nodes: DataFrame) -> DataFrame:
    """Operations of a case by (kind, operation): count, bound, and whether they are amplified."""
    return nodes.groupBy("case_id", "kind", "operation").agg(
        F.count("*").alias("n"), F.max(F.coalesce("maximum_amplification", F.lit(1))).alias("maximum"), F.bool_or("amplified").alias("amplified"),
        F.bool_and(F.coalesce("task_attempt", F.lit(0)) != 0).alias("all_attempts"),
    ).withColumn("bad", F.col("amplified") | ((F.col("n") > F.col("maximum")) & ~F.col("all_attempts")))


@_seen
def performance_work_amplification(t: dict) -> DataFrame:
    bad = work_groups(t["nodes"]).where("bad and kind is not null and operation is not null").select("case_id", "kind", "operation")
    refs = t["nodes"].join(bad, ["case_id", "kind", "operation"], "left_semi").groupBy("case_id").agg(F.array_sort(F.collect_set("node_id")).alias("refs"))
    rows = t["cases"].join(bad.select("case_id").distinct().withColumn("bad", F.lit(True)), "case_id", "left").join(refs, "case_id", "left")
    return _result(rows, _verdict(F.coalesce("bad", F.lit(False))), F.col("refs"), node_refs=F.col("refs"))


def _rebuilt() -> Column:
    """Derived deliveries and spawns, which :func:`broken_links` looks at."""
    return F.col("derived") & F.col("kind").isin("delivers", "spawns")


def _lost() -> Column:
    return ~F.col("s_trace_id").eqNullSafe(F.col("t_trace_id")) | F.col("t_parent_span_id").isNull() | (F.col("t_parent_span_id") == "")


def broken_links(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Derived deliveries and spawns whose trace or parent span was lost on the way."""
    return assembly._with_ends(relations.where(_rebuilt()), nodes, "trace_id", "parent_span_id").where(_lost()).select(assembly.RELATION)


def first_of_role(nodes: DataFrame) -> DataFrame:
    """The first node of each role; a missing attempt counts as 0."""
    order = F.struct(F.coalesce("task_attempt", F.lit(0)), "start_us", "node_id")
    return nodes.where(truthy(F.col("role"))).groupBy("case_id", "role").agg(F.min_by("node_id", order).alias("node_id"))


def missing_expected_edges(expected: DataFrame, relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Expected edges (case_id, source_role, target_role, kind) that no source relation holds."""
    roles = first_of_role(nodes)
    end = lambda side: roles.select("case_id", F.col("role").alias(f"{side}_role"), F.col("node_id").alias(f"{side}_ref"))
    placed = expected.join(end("source"), ["case_id", "source_role"]).join(end("target"), ["case_id", "target_role"])
    return placed.join(relations, ["case_id", "source_ref", "target_ref", "kind"], "left_anti")


def observability_required_linkage(t: dict) -> DataFrame:
    """Contradiction outranks a missing link, which outranks a graph in several parts.

    Missing are links that had to be rebuilt, and edges that a case's contract (table
    ``expected_edges``: case_id, source_role, target_role, kind) expects between roles
    it has and that no recorded relation holds. The relations between nodes are written
    once, for the gaps and the parts. A case has as many parts as nodes, less what its
    connected ones are more than their components.
    """
    ends = ("case_id", "source_ref", "target_ref")
    edges = written(assembly._with_ends(t["graph"]["relations"], t["nodes"], "trace_id", "parent_span_id").select(*ends, (_rebuilt() & _lost()).alias("broken")))
    gaps = edges.where("broken").select(*ends)
    if "expected_edges" in t:
        gaps = gaps.unionByName(missing_expected_edges(t["expected_edges"], t["relations"], t["nodes"]).select(*ends))
    lost = gaps.select("case_id", F.explode(F.array("source_ref", "target_ref")).alias("ref"))
    lost = lost.groupBy("case_id").agg(F.array_sort(F.collect_set("ref")).alias("lost"))
    against = t["observations"].where("contradiction").groupBy("case_id").agg(F.array_sort(F.collect_set("observation_id")).alias("against"))
    joined = components_within(edges, "case_id", "source_ref", "target_ref", at_rest=True).groupBy("case_id").agg((F.count("*") - F.count_distinct("component")).alias("joined"))
    own = t["nodes"].groupBy("case_id").agg(F.count_distinct("node_id").alias("n"), F.array_sort(F.collect_set("node_id")).alias("all"))
    parts = own.join(joined, "case_id", "left").withColumn("parts", F.col("n") - F.coalesce("joined", F.lit(0)))
    rows = t["cases"].join(lost, "case_id", "left").join(against, "case_id", "left").join(parts, "case_id", "left")
    status = (
        F.when(F.col("against").isNotNull(), "contradicted").when(F.col("lost").isNotNull(), "violated").when(F.col("parts") > 1, "inconclusive").otherwise("satisfied")
    )
    refs = F.when(F.col("against").isNotNull(), F.lit(None)).when(F.col("lost").isNotNull(), F.col("lost")).when(F.col("parts") > 1, F.col("all"))
    return _result(rows, status, node_refs=refs, evidence_refs=F.col("against"))


def privacy_prohibited_capture(t: dict) -> DataFrame:
    secret = F.arrays_overlap(F.transform("attribute_keys", F.lower), F.array(*[F.lit(k) for k in SECRET_KEYS]))
    found = t["observations"].groupBy("case_id").agg(refs_if(F.array_contains("sensitivity", "credential") | secret, F.col("observation_id")).alias("refs"))
    rows = t["cases"].join(found, "case_id", "left")
    return _result(rows, _verdict(F.coalesce(F.size("refs") > 0, F.lit(False))), evidence_refs=F.col("refs"))


#: invariant id -> (handler, severity, kinds of evidence it needs and how much)
INVARIANTS: dict[str, tuple[Callable[[dict], DataFrame], str, dict[str, int]]] = {
    "context.required-continuity": (context_required_continuity, "high", {"contexts": 1}),
    "context.forbidden-propagation": (context_forbidden_propagation, "critical", {"contexts": 1}),
    "identity.execution-isolation": (identity_execution_isolation, "critical", {"nodes": 1}),
    "identity.workflow-correlatable": (identity_workflow_correlatable, "high", {"nodes": 1}),
    "effect.at-most-once": (effect_at_most_once, "critical", {"effects": 1}),
    "effect.required-eventuality": (effect_required_eventuality, "high", {"effects": 1}),
    "ordering.read-after-visibility": (ordering_read_after_visibility, "high", {"nodes": 2}),
    "consistency.required-freshness": (consistency_required_freshness, "medium", {"nodes": 1}),
    "contract.schema-compatible": (contract_schema_compatible, "high", {"nodes": 1}),
    "resource.capacity-bounded": (resource_capacity_bounded, "medium", {"nodes": 1}),
    "performance.work-amplification": (performance_work_amplification, "medium", {"nodes": 1}),
    "observability.required-linkage": (observability_required_linkage, "medium", {"nodes": 1, "relations": 1}),
    "privacy.prohibited-capture": (privacy_prohibited_capture, "critical", {"observations": 1}),
}


def select(ids: list[str] | None = None) -> list[str]:
    """The ids to run, in the order of the registry; an unknown one is an error."""
    if unknown := sorted(set(ids or ()) - set(INVARIANTS)):
        raise KeyError(f"unknown invariants: {', '.join(unknown)}")
    return [i for i in INVARIANTS if ids is None or i in ids]


def entity_counts(t: dict) -> DataFrame:
    """(case_id, entity, n) of every entity table."""
    names = ("nodes", "relations", "contexts", "effects", "observations")
    counts = [t[n].groupBy("case_id").agg(F.count("*").alias("n")).withColumn("entity", F.lit(n)) for n in names]
    return reduce(DataFrame.unionByName, counts).select("case_id", "entity", "n")


def missing_evidence(t: dict, ids: list[str] | None = None) -> DataFrame:
    """(case_id, invariant, missing): cases that lack evidence an invariant needs."""
    needs = [(i, entity, least) for i in select(ids) for entity, least in INVARIANTS[i][2].items()]
    wanted = t["cases"].sparkSession.createDataFrame(needs, "invariant string, entity string, least long")
    every = t["cases"].select("case_id", F.explode(F.array(*[F.lit(e) for e in sorted({n[1] for n in needs})])).alias("entity"))
    have = every.join(entity_counts(t), ["case_id", "entity"], "left").join(F.broadcast(wanted), "entity")  # a row a need
    return have.where(F.coalesce("n", F.lit(0)) < F.col("least")).groupBy("case_id", "invariant").agg(F.array_sort(F.collect_set("entity")).alias("missing"))


def settled(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that several invariants read, written once, side by side; for views that each of them would derive again."""
    narrow = t | {"nodes": t["nodes"].select(NODE_COLUMNS)}
    names = ("nodes", "relations", "contexts", "effects", "cases")
    with ThreadPoolExecutor(len(names)) as pool:
        return t | dict(zip(names, pool.map(lambda name: written(narrow[name]), names)))


def _with_evidence(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (case_id, invariant, evidence_nodes, ...) of all invariants with the observations of those nodes, by one look at the nodes."""
    wanted = rows.select("case_id", "invariant", F.explode("evidence_nodes").alias("node_id"))
    seen = wanted.join(nodes.select("case_id", "node_id", F.explode("observation_refs").alias("ref")), ["case_id", "node_id"])
    found = seen.groupBy("case_id", "invariant").agg(F.array_sort(F.collect_set("ref")).alias("found"))
    return rows.join(found, ["case_id", "invariant"], "left").withColumn("evidence_refs", F.coalesce("found", "evidence_refs")).drop("found", "evidence_nodes")


def _rows(handler: Callable[[dict], DataFrame], t: dict) -> DataFrame:
    """What a handler says, with the nodes whose observations are its evidence."""
    rows = getattr(handler, "rows", handler)(t)
    later = F.col("evidence_nodes") if "evidence_nodes" in rows.columns else F.lit(None).cast("array<string>")
    return rows.select("case_id", "status", *REFS, later.alias("evidence_nodes"))


def _planned(t: dict, handlers: dict[str, Callable[[dict], DataFrame]]) -> dict[str, apart.Outcome]:
    """Outcomes of handlers that are planned only; what fails in a task later fails the whole."""
    out = {}
    for i, handler in handlers.items():
        try:
            out[i] = apart.Outcome({"rows": _rows(handler, t)})
        except Exception as error:  # noqa: BLE001  told in the result, whatever it is
            out[i] = apart.Outcome(error=apart.told(error))
    return out


def evaluate(t: dict, ids: list[str] | None = None, handlers: dict[str, Callable[[dict], DataFrame]] | None = None, isolated: bool = False) -> DataFrame:
    """One row for each case and invariant; a case that lacks evidence is inconclusive.

    ``handlers`` replace those of the registry, by id. An evaluator that fails gives
    "evaluation_error" with the error's type and text for each case, and holds up no other:
    always while it is planned, and with ``isolated``, where each runs as a job of its own,
    in its tasks too.
    """
    chosen = {i: (handlers or {}).get(i, INVARIANTS[i][0]) for i in select(ids)}
    if unknown := sorted(set(handlers or ()) - set(INVARIANTS)):
        raise KeyError(f"handlers of unknown invariants: {', '.join(unknown)}")
    if isolated:
        spark = t["cases"].sparkSession
        outcomes = apart.run(spark, {i: lambda h=h: {"rows": _rows(h, t)} for i, h in chosen.items()})
    else:
        outcomes = _planned(t, chosen)
    results = [
        (_result(t["cases"], F.lit("evaluation_error"), F.lit(None).cast("array<string>")) if o.error else o.tables["rows"]).select(
            "case_id", F.lit(i).alias("invariant"), F.lit(INVARIANTS[i][1]).alias("severity"), "status", *REFS, "evidence_nodes", F.lit(o.error).cast("string").alias("error"))
        for i, o in outcomes.items()
    ]
    rows = _with_evidence(reduce(DataFrame.unionByName, results), t["nodes"]).join(missing_evidence(t, ids), ["case_id", "invariant"], "left")
    lacks, empty = F.col("missing").isNotNull(), F.array().cast("array<string>")
    status = F.when(lacks, "inconclusive").otherwise(F.col("status"))
    weak = (F.col("invariant") == "observability.required-linkage") & (status == "inconclusive") & ~lacks
    return rows.select(
        "case_id", "invariant", "severity", status.alias("status"), *[F.when(lacks | F.col(r).isNull(), empty).otherwise(F.col(r)).alias(r) for r in REFS],
        F.coalesce("missing", empty).alias("missing_evidence"), evidence_class(status).alias("evidence_class"),
        F.when(weak, 0.6).when(status == "evaluation_error", 0.0).otherwise(confidence(status)).alias("confidence"), stable_id("invariant-result", F.col("invariant"), F.col("case_id")).alias("result_id"),
        F.when(~lacks, F.col("error")).alias("error"),
    )


def histogram(results: DataFrame) -> DataFrame:
    """A case's results by status, 0 where there is none."""
    return results.groupBy("case_id").pivot("status", STATUSES).count().fillna(0)
