"""Field inventory of nested records: a walk over the leaves of JSON values, a level a round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.scalars import preview, sensitivity_labels
from causeway.operators.privacy import STRUCTURAL_KEYS, action_of, policy, rule_of
from causeway.session import checkpointed

# Containers whose children take the labels that the container's record declares, and keys whose values always do.
FLEXIBLE_CONTAINERS = ("attributes", "extensions", "inputs", "outputs", "collection_scope", "entity_refs")
SENSITIVE_VALUE_KEYS = (
    "value", "attributes", "inputs", "outputs", "captured_payload", "logical_effect_key", "idempotency_key", "source_native_id", "principal_id", "tenant_id", "session_id", "entity_refs",
)
# What a record may declare.
LABELS = (
    "public", "internal", "tenant_identifier", "user_identifier", "student_record", "credential", "free_text", "network_metadata", "query_text", "payload_derived",
)
_NONE = "array<string>"


def _both(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def _declared(node: Column) -> Column:
    """The known labels under ``sensitivity`` of an object, whether a list or a single one."""
    many, one = F.try_variant_get(node, "$.sensitivity", _NONE), F.try_variant_get(node, "$.sensitivity", "string")
    said = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast(_NONE))
    return F.array_sort(F.array_distinct(F.filter(said, lambda x: x.isin(*LABELS))))


def leaves(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, key, labels, type, value) of every scalar in a column of JSON text.

    A path begins with ``$``; places in lists are given. Labels go down the walk: a value has those
    of its key, of what it lies in, and ``user_identifier`` where it is an e-mail address. What an object
    declares under ``sensitivity`` goes to the children of flexible containers and to
    value keys alone; the list itself has none. Each round opens one level of all
    records, without a shuffle, and is cut by a checkpoint. Text that is no JSON, and null, have no
    leaves; nor have empty objects and lists.
    """
    opened = records.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.array().cast(_NONE).alias("inherited"), F.try_parse_json(json_col).alias("node"))
    parts, level = [], checkpointed(opened.where("node is not null"))
    while not level.isEmpty():
        start = F.substring(F.to_json("node"), 1, 1)
        level = level.withColumn("nested", start.isin("{", "["))
        text = F.try_variant_get("node", "$", "string")
        schema = F.schema_of_variant("node")
        is_text = schema == "STRING"
        kind = F.when(is_text, "str").when(schema == "BOOLEAN", "bool").when(schema == "VOID", "NoneType").when((schema == "BIGINT") | schema.endswith(",0)"), "int").otherwise("float")
        leaf = level.where("not nested")
        parts.append(leaf.select("id", "path", "key", _both(F.col("inherited"), sensitivity_labels(F.coalesce("key", F.lit("")), F.when(is_text, text))).alias("labels"), kind.alias("type"), text.alias("value")))
        inner = level.where("nested").select("id", "path", "key", _both(F.col("inherited"), sensitivity_labels(F.coalesce("key", F.lit("")), F.lit(None).cast("string"))).alias("labels"), "node",
                                             F.when(start == "{", _declared(F.col("node"))).alias("declared"))
        children = inner.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("node").outer()).toDF("pos", "child_key", "child"))
        of_object = F.col("child_key").isNotNull()
        takes = F.coalesce(F.col("key").isin(*FLEXIBLE_CONTAINERS), F.lit(False)) | F.col("child_key").isin(*SENSITIVE_VALUE_KEYS)
        labels = F.when(~of_object, F.col("labels")).when(F.col("child_key") == "sensitivity", F.array().cast(_NONE)).when(takes, _both(F.col("labels"), F.col("declared"))).otherwise(F.col("labels"))
        step = F.when(of_object, F.concat(F.lit("."), "child_key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = checkpointed(children.select("id", F.concat("path", step).alias("path"), F.coalesce("child_key", "key").alias("key"), labels.alias("inherited"), F.col("child").alias("node")))
    return reduce(DataFrame.unionByName, parts) if parts else opened.select("id", "path", "key", F.col("inherited").alias("labels"), F.lit("").alias("type"), F.lit("").alias("value")).limit(0)


def nested_inventory(records: DataFrame, id_col: str, json_col: str, policy_name: str) -> DataFrame:
    """One row a leaf: path, type, labels, matching rule, action, whether it is a reference, and a preview. Rules see places in lists as ``[*]``."""
    rules = policy(policy_name)
    rows = leaves(records, id_col, json_col)
    rule = rule_of(rules, F.regexp_replace("path", r"\[\d+\]", "[*]"), F.coalesce("key", F.lit("")), F.col("value"), F.col("labels"))
    rows = rows.withColumn("rule", rule)
    return rows.select("id", "path", "type", "labels", "rule", action_of(rules, F.col("rule")).alias("action"), F.coalesce(F.col("key").isin(*STRUCTURAL_KEYS), F.lit(False)).alias("structural"), preview(F.col("value")).alias("preview"))


def by_label_and_action(rows: DataFrame) -> DataFrame:
    """Counts of an inventory: (kind, name, n) by label and by proposed action."""
    labels = rows.select(F.lit("label").alias("kind"), F.explode("labels").alias("name"))
    return labels.unionByName(rows.select(F.lit("action").alias("kind"), F.col("action").alias("name"))).groupBy("kind", "name").agg(F.count("*").alias("n"))
