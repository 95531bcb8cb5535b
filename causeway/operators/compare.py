"""Semantic comparison of pairs of cases: alignment, divergences, first meaningful divergence.

``pairs`` (comparison_id, baseline_case, candidate_case) may hold any number of comparisons.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.scalars import duration_ms, normalize_operation, stable_id, truthy
from causeway.operators import assembly
from causeway.session import checkpointed, written

# What each equal part of a signature weighs. Together 19.5.
WEIGHTS = {"node_kind": 4.0, "operation": 6.0, "component_kind": 3.0, "component_role": 1.5, "logical_operation_id": 2.0, "task_name": 2.0, "stage": 1.0}
THRESHOLD, NEAR_TIE = 0.55, 0.03
DURATION_DELTA_MS, DURATION_RATIO = 25.0, 1.5
SEVERITY = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
_PARTS = list(WEIGHTS)


def prepare(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """Nodes with their semantic signature and offset from the origin of their case."""
    kinds = components.select(F.col("component_id").alias("component_ref"), F.col("kind").alias("component_kind"), F.col("role").alias("component_role"))
    origin = F.min("start_us").over(Window.partitionBy("case_id"))
    return nodes.join(kinds, "component_ref", "left").select(
        "case_id", "node_id", "role", F.col("kind").alias("node_kind"), normalize_operation(F.col("operation")).alias("operation"),
        F.coalesce("component_kind", F.lit("unknown")).alias("component_kind"), "component_role", "logical_operation_id", "task_name", "stage", "status", "task_attempt", "start_us",
        ((F.col("start_us") - origin) / 1000.0).alias("offset_ms"), duration_ms(F.col("start_us"), F.col("end_us")).alias("duration_ms"),
        "tenant_id", "principal_id", "idempotency_key", "message_id", (F.size("observation_refs") > 0).alias("has_evidence"),
    )


def sides(pairs: DataFrame, prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = pairs.select("comparison_id", F.col("baseline_case").alias("case_id")).join(prepared, "case_id")
    right = pairs.select("comparison_id", F.col("candidate_case").alias("case_id")).join(prepared, "case_id")
    return left, right


def written_sides(pairs: DataFrame, prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same two tables, for plans that read them often: nodes are prepared once and written once for both."""
    cases = pairs.select("comparison_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("baseline_case").alias("case_id")), F.struct(F.lit("b").alias("side"), F.col("candidate_case").alias("case_id")))).alias("c"))
    both = written(cases.select("comparison_id", "c.*").join(prepared, "case_id"))
    return both.where("side = 'a'").drop("side"), both.where("side = 'b'").drop("side")


def align_by_role(left: DataFrame, right: DataFrame) -> DataFrame:
    """The n-th node of a role on one side with the n-th on the other; a missing attempt counts as 0."""
    order = Window.partitionBy("comparison_id", "role").orderBy(F.coalesce("task_attempt", F.lit(0)), "start_us", "node_id")
    number = lambda df, name: df.where(truthy(F.col("role"))).select("comparison_id", "role", F.row_number().over(order).alias("n"), F.col("node_id").alias(name))
    return number(left, "baseline_ref").join(number(right, "candidate_ref"), ["comparison_id", "role", "n"]).select("comparison_id", "baseline_ref", "candidate_ref")


def score(same: dict[str, Column]) -> Column:
    total = reduce(lambda a, b: a + b, [F.when(same[p], WEIGHTS[p]).otherwise(0.0) for p in _PARTS])
    return total / sum(WEIGHTS.values())


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(comparison_id, baseline_ref, candidate_ref, score) of node pairs that reach the threshold.

    At the default threshold any such pair has the same operation, or the same node kind
    and component kind, so two equi-joins find all candidates.
    """
    if threshold < 0.55:
        raise ValueError("blocking on operation and on kinds is complete from a threshold of 0.55 on")
    a = left.select("comparison_id", F.col("node_id").alias("baseline_ref"), *[F.col(p).alias(f"a_{p}") for p in _PARTS])
    b = right.select("comparison_id", F.col("node_id").alias("candidate_ref"), *[F.col(p).alias(f"b_{p}") for p in _PARTS])
    same_operation = a.join(b, (a["comparison_id"] == b["comparison_id"]) & (a["a_operation"] == b["b_operation"]))
    same_kinds = a.join(b, (a["comparison_id"] == b["comparison_id"]) & (a["a_node_kind"] == b["b_node_kind"]) & (a["a_component_kind"] == b["b_component_kind"]))
    same_kinds = same_kinds.where(~F.col("a_operation").eqNullSafe(F.col("b_operation")))  # the others are in the first part
    own = lambda df: df.select(a["comparison_id"], "baseline_ref", "candidate_ref", *[c for p in _PARTS for c in (f"a_{p}", f"b_{p}")])
    equal = {p: F.coalesce(F.col(f"a_{p}") == F.col(f"b_{p}"), F.lit(False)) for p in _PARTS}
    rows = own(same_operation).unionByName(own(same_kinds)).withColumn("score", score(equal))
    return rows.where(F.col("score") >= threshold).select("comparison_id", "baseline_ref", "candidate_ref", "score")


def _classes(side: DataFrame, ref: str, name: str) -> DataFrame:
    """Nodes of one side grouped by signature: comparison_id, the parts, the members in order of their ids."""
    return side.groupBy("comparison_id", *_PARTS).agg(F.array_sort(F.collect_list(ref)).alias("members")).withColumn(name, F.element_at("members", 1))


def similar_classes(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes of the left side, of the right side, pairs of classes that reach the threshold).

    Nodes of one signature have the same score to everything, so pairs are made between
    signatures; a class goes by its least member.
    """
    a, b = _classes(left, "node_id", "a_class"), _classes(right, "node_id", "b_class")
    named = lambda c, name: c.select("comparison_id", F.col(name).alias("node_id"), *_PARTS)
    edges = similar_pairs(named(a, "a_class"), named(b, "b_class")).withColumnsRenamed({"baseline_ref": "a_class", "candidate_ref": "b_class"})
    return a.select("comparison_id", "a_class", "members"), b.select("comparison_id", "b_class", "members"), edges


def match(a: DataFrame, b: DataFrame, edges: DataFrame) -> DataFrame:
    """Greedy one-to-one matching of similar nodes, best first by (score, baseline, candidate), in rounds over all comparisons at once.

    ``a``, ``b`` and ``edges`` are those of :func:`similar_classes`. Taken in that order, a baseline node goes to its best free partner, unless another free
    one is within 0.03 of it: then it is ambiguous and its partners stay free. A round
    settles the next members of every class that nothing earlier can still change: no
    other class with an earlier claim reaches a partner near its best. If near partners are
    several, all its members up to the next claim are ambiguous; if it is one, the
    first member takes it. The claim that is first of all is always settled, so rounds end; each is cut by a checkpoint.
    """
    a, b, edges = (checkpointed(x) for x in (a, b, edges))
    free_a, free_b = (x.select("comparison_id", c, F.col("members").alias(m)) for x, c, m in ((a, "a_class", "am"), (b, "b_class", "bm")))
    done = None
    while True:
        live = edges.join(free_a, ["comparison_id", "a_class"]).join(free_b, ["comparison_id", "b_class"])
        claim = F.struct((-F.col("score")).alias("s"), F.element_at("am", 1).alias("l"), F.element_at("bm", 1).alias("r"))
        live = checkpointed(live.withColumn("claim", claim))
        if live.isEmpty():
            break
        of_a, of_b = Window.partitionBy("comparison_id", "a_class"), Window.partitionBy("comparison_id", "b_class")
        # the first two claims on a right class, so that each left class sees the first one of others
        first = F.array_sort(F.collect_list(F.struct("claim", "a_class")).over(of_b))
        others = live.withColumn("rival", F.get(F.transform(F.filter(first, lambda x: x["a_class"] != F.col("a_class")), lambda x: x["claim"]), 0))
        best = others.withColumn("best", F.min("claim").over(of_a)).withColumn("near", F.abs(-F.col("score") - F.col("best.s")) < NEAR_TIE)
        state = best.where("near").groupBy("comparison_id", "a_class").agg(
            F.first("am").alias("am"), F.first("best").alias("best"), F.min("rival").alias("rival"), F.sum(F.size("bm")).alias("n"),
            F.array_sort(F.flatten(F.collect_list("bm"))).alias("near"),
        )
        # members before the first rival's claim are settled now
        early = F.filter("am", lambda m: F.col("rival").isNull() | (F.struct(F.col("best.s").alias("s"), m.alias("l"), F.col("best.r").alias("r")) < F.col("rival")))
        settled = checkpointed(state.withColumn("early", early).where("size(early) > 0").select(
            "comparison_id", "a_class", "n", "near", (-F.col("best.s")).alias("score"), F.col("best.r").alias("taken"), F.when(F.col("n") > 1, F.col("early")).otherwise(F.slice("early", 1, 1)).alias("early")))
        rows = settled.select("comparison_id", F.explode("early").alias("baseline_ref"), "n", "near", "score", "taken").select(
            "comparison_id", "baseline_ref", F.when(F.col("n") == 1, F.col("taken")).alias("candidate_ref"), F.when(F.col("n") == 1, "aligned").otherwise("ambiguous").alias("status"),
            "score", F.when(F.col("n") > 1, F.array_join("near", ",")).otherwise("").alias("others"))
        done = rows if done is None else done.unionByName(rows)
        free_a = free_a.join(settled.select("comparison_id", "a_class", "early"), ["comparison_id", "a_class"], "left").withColumn("am", F.array_except("am", F.coalesce("early", F.array().cast("array<string>")))).where("size(am) > 0").drop("early")
        gone = settled.where("n = 1").join(edges, ["comparison_id", "a_class"]).select("comparison_id", "b_class", "taken").distinct()
        gone = gone.join(free_b, ["comparison_id", "b_class"]).where(F.array_contains("bm", F.col("taken"))).groupBy("comparison_id", "b_class").agg(F.collect_set("taken").alias("gone"))
        free_b = free_b.join(gone, ["comparison_id", "b_class"], "left").withColumn("bm", F.array_except("bm", F.coalesce("gone", F.array().cast("array<string>")))).where("size(bm) > 0").drop("gone")
        free_a, free_b = checkpointed(free_a), checkpointed(free_b)
    return done if done is not None else edges.sparkSession.createDataFrame([], _ALIGNMENT)


_ALIGNMENT = "comparison_id string, baseline_ref string, candidate_ref string, status string, score double, others string"


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """comparison_id, baseline_ref, candidate_ref, status, score, others: every node of both sides once.

    Nodes of equal role go first; only what is left is compared by signature, see :func:`match`.
    """
    by_role = written(align_by_role(left, right))
    rest = lambda df, ref: df.join(by_role.select("comparison_id", F.col(ref).alias("node_id")), ["comparison_id", "node_id"], "left_anti")
    by_signature = match(*similar_classes(rest(left, "baseline_ref"), rest(right, "candidate_ref")))
    found = by_role.select("*", F.lit("aligned").alias("status"), F.lit(1.0).alias("score"), F.lit("").alias("others")).unionByName(by_signature)
    lone = lambda df, ref, other, status: df.join(
        found.where(F.col(ref).isNotNull()).select("comparison_id", F.col(ref).alias("node_id")), ["comparison_id", "node_id"], "left_anti"
    ).select("comparison_id", F.col("node_id").alias(ref), F.lit(None).cast("string").alias(other), F.lit(status).alias("status"), F.lit(0.0).alias("score"), F.lit("").alias("others"))
    out = found.unionByName(lone(left, "baseline_ref", "candidate_ref", "baseline_only")).unionByName(lone(right, "candidate_ref", "baseline_ref", "candidate_only"))
    aligned = stable_id("alignment", F.col("baseline_ref"), F.col("candidate_ref"))
    name = (
        F.when(F.col("status") == "aligned", aligned).when(F.col("status") == "ambiguous", stable_id("alignment.ambiguous", F.col("baseline_ref"), F.col("others")))
        .when(F.col("status") == "baseline_only", stable_id("alignment.baseline-only", F.col("baseline_ref"))).otherwise(stable_id("alignment.candidate-only", F.col("candidate_ref")))
    )
    confidence = F.when(F.col("status") == "ambiguous", F.greatest(F.lit(0.0), F.col("score") - 0.2)).when(F.col("status") == "aligned", F.col("score")).otherwise(1.0)
    return out.withColumn("alignment_id", name).withColumn("confidence", confidence)


DIVERGENCE = ["comparison_id", "divergence_id", "dimension", "classification", "severity", "consequence", "consequential", "baseline_refs", "candidate_refs", "rank_ms"]


def _divergence(rows: DataFrame, dimension: str, classification: Column, severity: Column, consequence: Column, rank: Column, name: Column, consequential: bool = True) -> DataFrame:
    return rows.select(
        "comparison_id", name.alias("divergence_id"), F.lit(dimension).alias("dimension"), classification.alias("classification"), severity.alias("severity"),
        consequence.alias("consequence"), F.lit(consequential).alias("consequential"), F.coalesce("baseline_ref", F.lit("")).alias("baseline_refs"),
        F.coalesce("candidate_ref", F.lit("")).alias("candidate_refs"), rank.alias("rank_ms"),
    )


def aligned_nodes(alignments: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Aligned pairs with both nodes' columns as a_ and b_."""
    side = lambda df, p, ref: df.select("comparison_id", F.col("node_id").alias(ref), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in ("comparison_id", "node_id")])
    pairs = alignments.where("status = 'aligned'")
    return pairs.join(side(left, "a", "baseline_ref"), ["comparison_id", "baseline_ref"]).join(side(right, "b", "candidate_ref"), ["comparison_id", "candidate_ref"])


class Change(NamedTuple):
    """What makes an aligned pair a divergence, and of which kind."""

    dimension: str
    name: str
    when: Column
    severity: Column
    consequence: Column
    consequential: bool = True


def _per_pair(rows: DataFrame, *changes: Change) -> DataFrame:
    """Divergences of aligned pairs; all changes are tried in one pass over the pairs."""
    def found(c: Change) -> Column:
        parts = {"divergence_id": stable_id("divergence", F.col("alignment_id"), F.lit(c.name)), "dimension": F.lit(c.dimension), "classification": F.lit(c.name), "severity": c.severity,
                 "consequence": c.consequence, "consequential": F.lit(c.consequential)}
        return F.when(c.when, F.struct(*[v.alias(k) for k, v in parts.items()]))

    return rows.select("comparison_id", F.explode(F.array_compact(F.array(*map(found, changes)))).alias("c"), "baseline_ref", "candidate_ref", F.least("a_offset_ms", "b_offset_ms").alias("rank_ms")).select(
        "comparison_id", "c.*", F.coalesce("baseline_ref", F.lit("")).alias("baseline_refs"), F.coalesce("candidate_ref", F.lit("")).alias("candidate_refs"), "rank_ms")


def _status() -> Change:
    good = F.col("b_status").isin("ok", "committed", "completed")
    return Change("error", "status.changed", ~F.col("a_status").eqNullSafe(F.col("b_status")), F.when(good, "medium").otherwise("high"), F.lit("outcome_relevant"))


def status_changed(rows: DataFrame) -> DataFrame:
    return _per_pair(rows, _status())


def context_differences(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """Aligned pairs with the context names that are missing, added or changed on the candidate's side.

    Cases may share node ids, so contexts are looked up by case and node. Of a name observed twice at
    a node the last one counts: by input_seq, where there is one, else by context_id.
    """
    place = "input_seq" if "input_seq" in contexts.columns else "context_id"
    name = F.concat("namespace", F.lit("."), "field_name")
    last = contexts.where("observed_at_node_ref is not null").groupBy("case_id", F.col("observed_at_node_ref").alias("ref"), name.alias("k")).agg(F.max_by("value", place).alias("value"))
    of = last.where("k is not null").groupBy("case_id", "ref").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "value")))).alias("m"))
    side = lambda case, ref, m: of.select(F.col("case_id").alias(case), F.col("ref").alias(ref), F.col("m").alias(m))
    joined = rows.join(side("a_case_id", "baseline_ref", "ma"), ["a_case_id", "baseline_ref"], "left").join(side("b_case_id", "candidate_ref", "mb"), ["b_case_id", "candidate_ref"], "left")
    keys = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    both = F.array_intersect(keys("ma"), keys("mb"))
    return joined.select(
        *rows.columns, F.array_sort(F.array_except(keys("ma"), keys("mb"))).alias("missing"), F.array_sort(F.array_except(keys("mb"), keys("ma"))).alias("added"),
        F.array_sort(F.filter(both, lambda k: ~F.element_at("ma", k).eqNullSafe(F.element_at("mb", k)))).alias("mutated"),
    )


def _context() -> Change:
    """Over rows of :func:`context_differences`."""
    worse = (F.size("missing") > 0) | (F.size("mutated") > 0)
    return Change("context", "context.changed", worse | (F.size("added") > 0), F.when(worse, "high").otherwise("medium"), F.when(worse, "outcome_relevant").otherwise("semantic"))


def context_changed(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    return _per_pair(context_differences(rows, contexts), _context())


def identity_changes(rows: DataFrame) -> DataFrame:
    """Aligned pairs with the identities that differ; two message ids that are both there are noise."""
    def change(c: str) -> Column:
        differs = ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
        return F.when(differs & ~(truthy(F.col("a_message_id")) & truthy(F.col("b_message_id"))) if c == "message_id" else differs, F.lit(c))

    return rows.withColumn("changed", F.array_compact(F.array(*[change(c) for c in ("tenant_id", "principal_id", "idempotency_key", "task_attempt", "message_id")])))


def _identity() -> Change:
    """Over rows of :func:`identity_changes`."""
    tenant = F.array_contains("changed", "tenant_id")
    return Change("identity", "identity.changed", F.size("changed") > 0, F.when(tenant, "high").otherwise("medium"), F.when(tenant, "outcome_relevant").otherwise("semantic"))


def identity_changed(rows: DataFrame) -> DataFrame:
    return _per_pair(identity_changes(rows), _identity())


def _duration() -> Change:
    a, b = F.col("a_duration_ms"), F.col("b_duration_ms")
    slower = (F.abs(b - a) >= DURATION_DELTA_MS) & (F.greatest(a, b) / F.greatest(F.lit(1.0), F.least(a, b)) >= DURATION_RATIO)
    return Change("timing", "timing.duration-regression", slower, F.lit("medium"), F.lit("semantic"))


def duration_changed(rows: DataFrame) -> DataFrame:
    return _per_pair(rows, _duration())


def _evidence() -> Change:
    return Change("evidence", "evidence.node-coverage-changed", F.col("a_has_evidence") != F.col("b_has_evidence"), F.lit("low"), F.lit("observational"), False)


def evidence_changed(rows: DataFrame) -> DataFrame:
    return _per_pair(rows, _evidence())


def pair_changes(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """All divergences of aligned pairs, in one pass over the pairs and their contexts."""
    return _per_pair(identity_changes(context_differences(rows, contexts)), _status(), _context(), _identity(), _duration(), _evidence())


def structural(alignments: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    lone = alignments.where(F.col("status").isin("baseline_only", "candidate_only")).withColumn("node_id", F.coalesce("baseline_ref", "candidate_ref"))
    of_side = lambda df, status: df.select("comparison_id", F.lit(status).alias("status"), "node_id", "task_attempt", "offset_ms")
    rows = lone.join(of_side(left, "baseline_only").unionByName(of_side(right, "candidate_only")), ["comparison_id", "status", "node_id"])
    retry = F.coalesce(F.col("task_attempt") > 1, F.lit(False))
    name = F.when(F.col("status") == "candidate_only", "structure.additional-operation").otherwise("structure.missing-operation")
    return _divergence(rows, "structure", name, F.when(retry, "high").otherwise("medium"), F.when(retry, "outcome_relevant").otherwise("semantic"), F.col("offset_ms"), stable_id("divergence.structure", F.col("alignment_id")))


def ambiguous(alignments: DataFrame) -> DataFrame:
    rows = alignments.where("status = 'ambiguous'").withColumn("candidate_ref", F.col("others"))
    return _divergence(rows, "structure", F.lit("alignment.ambiguous"), F.lit("low"), F.lit("observational"), F.lit(None).cast("double"), stable_id("divergence.ambiguous", F.col("alignment_id")), False)


def effect_counts(pairs: DataFrame, effects: DataFrame) -> DataFrame:
    """Logical effects whose durable counts differ between the sides of a comparison: a full outer join."""
    counts = effects.groupBy("case_id", "logical_effect_key").agg(F.count_if(F.col("durability").isin(assembly.DURABLE)).alias("n"), F.array_sort(F.collect_list("effect_id")).alias("ids"))
    side = lambda case, p: pairs.select("comparison_id", F.col(case).alias("case_id")).join(counts, "case_id").select("comparison_id", "logical_effect_key", F.col("n").alias(f"{p}_n"), F.col("ids").alias(f"{p}_ids"))
    both = side("baseline_case", "a").join(side("candidate_case", "b"), ["comparison_id", "logical_effect_key"], "full_outer").fillna(0, ["a_n", "b_n"])
    return both.where("a_n <> b_n")


def effect_changed(pairs: DataFrame, effects: DataFrame, right: DataFrame) -> DataFrame:
    rows = effect_counts(pairs, effects)
    made = effects.select("case_id", "logical_effect_key", F.col("producer_node_ref").alias("node_id"))
    ranks = made.join(right.select("comparison_id", "case_id", "node_id", "offset_ms"), ["case_id", "node_id"]).groupBy("comparison_id", "logical_effect_key").agg(F.min("offset_ms").alias("rank"))
    rows = rows.join(ranks, ["comparison_id", "logical_effect_key"], "left").withColumns({"baseline_ref": F.array_join("a_ids", ","), "candidate_ref": F.array_join("b_ids", ",")})
    return _divergence(
        rows, "effect", F.lit("effect.durable-count-changed"), F.when(F.col("b_n") > 1, "critical").otherwise("high"), F.lit("outcome_relevant"), F.coalesce("rank", F.lit(0.0)),
        stable_id("divergence.effect", F.col("logical_effect_key"), F.col("a_n"), F.col("b_n")),
    )


def severity_order(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), severity)


def divergences(pairs: DataFrame, alignments: DataFrame, left: DataFrame, right: DataFrame, contexts: DataFrame, effects: DataFrame) -> DataFrame:
    """All divergences, the first of equals by (classification, refs)."""
    rows = aligned_nodes(alignments, left, right)
    parts = [structural(alignments, left, right), ambiguous(alignments), pair_changes(rows, contexts), effect_changed(pairs, effects, right)]
    order = Window.partitionBy("comparison_id", "classification", "baseline_refs", "candidate_refs").orderBy("divergence_id")
    return reduce(DataFrame.unionByName, parts).withColumn("_n", F.row_number().over(order)).where("_n = 1").select(DIVERGENCE)


def in_order(rows: DataFrame) -> DataFrame:
    """Divergences with their ``place`` in the report of their comparison: by time (null last), severity, id."""
    order = Window.partitionBy("comparison_id").orderBy(F.coalesce("rank_ms", F.lit(float("inf"))), severity_order(F.col("severity")), "divergence_id")
    return rows.withColumn("place", F.row_number().over(order))


def first_meaningful(rows: DataFrame) -> DataFrame:
    """Of each comparison the earliest consequential divergence that is semantic or outcome relevant."""
    key = F.struct(F.coalesce("rank_ms", F.lit(float("inf"))).alias("r"), severity_order(F.col("severity")).alias("s"), F.col("divergence_id").alias("d"))
    keep = F.col("consequential") & F.col("consequence").isin("semantic", "outcome_relevant")
    return rows.where(keep).groupBy("comparison_id").agg(F.min(key).alias("k")).select("comparison_id", F.col("k.d").alias("divergence_id"), F.col("k.r").alias("rank_ms"))


def alignment_counts(alignments: DataFrame) -> DataFrame:
    """Of each comparison the number of nodes by how they were aligned."""
    status = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_nodes")
    return alignments.groupBy("comparison_id").agg(*[status(s) for s in ("aligned", "baseline_only", "candidate_only", "ambiguous")])


def summary(alignments: DataFrame, rows: DataFrame) -> DataFrame:
    d = rows.groupBy("comparison_id").agg(F.count("*").alias("divergences"), F.count_if("consequential").alias("consequential"))
    return alignment_counts(alignments).join(d, "comparison_id", "left").fillna(0)


def compare(pairs: DataFrame, t: dict) -> dict[str, DataFrame]:
    """All comparisons at once: alignments, divergences, first and summary.

    Sides and alignments are written once, as every kind of divergence reads them; read from
    their plans, each read would run the matching's rounds and the preparation again.
    """
    left, right = written_sides(pairs, prepare(t["nodes"], t["components"]))
    alignments = written(align(left, right))
    rows = divergences(pairs, alignments, left, right, t["contexts"], t["effects"])
    return {"alignments": alignments, "divergences": rows, "first": first_meaningful(rows), "summary": summary(alignments, rows)}
