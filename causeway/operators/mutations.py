"""Bulk perturbations of canonical tables: what a fault would have left behind.

Each takes the tables and gives new ones; ``where`` picks the rows that the fault meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with(t: dict, **changed: DataFrame) -> dict:
    return t | changed


def drop_contexts(t: dict, where: Column) -> dict:
    return _with(t, contexts=t["contexts"].where(~F.coalesce(where, F.lit(False))))


def mutate_contexts(t: dict, where: Column, value: str) -> dict:
    return _with(t, contexts=t["contexts"].withColumn("value", F.when(where, F.lit(value)).otherwise(F.col("value"))))


def duplicate_effects(t: dict, where: Column, times: int) -> dict:
    """Each effect met stands ``times`` times, as retries would leave it."""
    extra = t["effects"].where(where).withColumn("_n", F.explode(F.sequence(F.lit(2), F.lit(times)))).withColumn("effect_id", F.concat("effect_id", F.lit(".retry."), "_n")).drop("_n")
    return _with(t, effects=t["effects"].unionByName(extra))


def omit_effects(t: dict, where: Column) -> dict:
    gone = t["effects"].where(where).select("case_id", "effect_id")
    edges = t["relations"]
    for end in ("source_ref", "target_ref"):
        edges = edges.join(gone.withColumnRenamed("effect_id", end), ["case_id", end], "left_anti")
    return _with(t, effects=t["effects"].where(~F.coalesce(where, F.lit(False))), relations=edges.select(t["relations"].columns))


def fail_nodes(t: dict, where: Column, status: str = "error") -> dict:
    """Fail after an effect, or exhaust a resource (status ``resource_exhausted``)."""
    return _with(t, nodes=t["nodes"].withColumn("status", F.when(where, status).otherwise(F.col("status"))))


def collapse_identity(t: dict, where: Column, column: str, value: str) -> dict:
    return _with(t, nodes=t["nodes"].withColumn(column, F.when(where, value).otherwise(F.col(column))).withColumn("identity_collision", F.col("identity_collision") | where))


def shift_nodes(t: dict, where: Column, ms: int) -> dict:
    """A delay, or a skewed clock where times are not normalised."""
    moved = {c: F.col(c) + F.when(where, ms * 1000).otherwise(0) for c in ("start_us", "end_us")}
    return _with(t, nodes=t["nodes"].withColumns(moved))


def reorder(t: dict, where: Column) -> dict:
    """Targets of the relations met begin a millisecond before their source."""
    source = t["nodes"].select("case_id", F.col("node_id").alias("source_ref"), F.col("start_us").alias("new_us"))
    moved = t["relations"].where(where).join(source, ["case_id", "source_ref"]).groupBy("case_id", F.col("target_ref").alias("node_id")).agg((F.min("new_us") - 1000).alias("new_us"))
    rows = t["nodes"].join(moved, ["case_id", "node_id"], "left")
    shift = F.coalesce(F.col("new_us") - F.col("start_us"), F.lit(0))
    return _with(t, nodes=rows.withColumns({"end_us": F.col("end_us") + shift, "start_us": F.col("start_us") + shift}).drop("new_us").select(t["nodes"].columns))


def skew_schema(t: dict, where: Column, version: str) -> dict:
    return _with(t, nodes=t["nodes"].withColumn("schema_version", F.when(where, version).otherwise(F.col("schema_version"))))


def amplify(t: dict, where: Column, times: int) -> dict:
    extra = t["nodes"].where(where).withColumn("_n", F.explode(F.sequence(F.lit(2), F.lit(times)))).withColumns({"node_id": F.concat("node_id", F.lit(".copy."), "_n"), "amplified": F.lit(True)}).drop("_n")
    return _with(t, nodes=t["nodes"].unionByName(extra))


def break_trace(t: dict, where: Column) -> dict:
    """Edges met are lost and their targets begin a trace of their own."""
    gone = t["relations"].where(where)
    hit = gone.select("case_id", F.col("target_ref").alias("node_id")).distinct().withColumn("_hit", F.lit(True))
    rows = t["nodes"].join(hit, ["case_id", "node_id"], "left")
    nodes = rows.withColumns({
        "trace_id": F.when(F.col("_hit"), F.concat(F.lit("trace.broken."), "node_id")).otherwise(F.col("trace_id")), "parent_span_id": F.when(F.col("_hit").isNull(), F.col("parent_span_id"))})
    return _with(t, nodes=nodes.select(t["nodes"].columns), relations=t["relations"].where(~F.coalesce(where, F.lit(False))))


def drop_observations(t: dict, where: Column) -> dict:
    gone = t["observations"].where(where).select("case_id", F.explode(F.array("observation_id")).alias("_o")).groupBy("case_id").agg(F.collect_set("_o").alias("_gone"))
    rows = t["nodes"].join(gone, "case_id", "left")
    refs = F.when(F.col("_gone").isNull(), F.col("observation_refs")).otherwise(F.array_except("observation_refs", "_gone"))
    return _with(t, observations=t["observations"].where(~F.coalesce(where, F.lit(False))), nodes=rows.withColumn("observation_refs", refs).select(t["nodes"].columns))


def contradict(t: dict, where: Column) -> dict:
    return _with(t, observations=t["observations"].withColumn("contradiction", F.col("contradiction") | where))


def capture_secret(t: dict, where: Column, key: str = "authorization") -> dict:
    return _with(t, observations=t["observations"].withColumn("attribute_keys", F.when(where, F.array_append("attribute_keys", F.lit(key))).otherwise(F.col("attribute_keys"))))


#: Ways in which evidence gets worse: what is applied, to which share of rows (by a hash of the id).
PROFILES = {
    "complete": [], "sampled": [("drop_observations", "observation_id", 4)], "no_propagation": [("break_trace", "relation_id", 2)], "late_clock": [("shift_nodes", "node_id", 3)],
    "contradicting": [("contradict", "observation_id", 5)], "leaking": [("capture_secret", "observation_id", 5)], "sparse": [("drop_observations", "observation_id", 2)],
    "broken_and_sampled": [("break_trace", "relation_id", 2), ("drop_observations", "observation_id", 4)],
}


def profile(t: dict, name: str) -> dict:
    for step, id_col, n in PROFILES[name]:
        where = F.pmod(F.xxhash64(id_col), F.lit(n)) == 0
        t = shift_nodes(t, where, -5000) if step == "shift_nodes" else globals()[step](t, where)
    return t
