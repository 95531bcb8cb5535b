"""Stored cases: a folder of JSON and JSONL files for each, read as tables over all cases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.sources.traces import json_documents, json_lines

# Where the files of each table lie in a stored case, and their columns.
TABLES = {
    "relations": ("model/relations.jsonl", "relation_id string, kind string, source_ref string, target_ref string, derivation string, evidence_refs array<string>"),
    "contexts": ("model/contexts.jsonl", "context_id string, namespace string, field_name string, value string, propagation_contract string, origin_node_ref string, observed_at_node_ref string, sensitivity array<string>"),
    "nodes": (
        "model/nodes.jsonl",
        "node_id string, kind string, operation string, component_ref string, identities struct<trace_id:string,span_id:string,parent_span_id:string,workflow_id:string,task_id:string,task_attempt:int,"
        "message_id:string,transaction_id:string,tenant_id:string,idempotency_key:string>, timing struct<raw_timestamp:timestamp,normalized_timestamp:timestamp>, status string, observation_refs array<string>",
    ),
    "effects": ("evidence/effects.jsonl", "effect_id string, kind string, logical_effect_key string, producer_node_ref string, durability string, idempotency_key string, evidence_refs array<string>"),
    "observations": ("evidence/observations.jsonl", "observation_id string, kind string, captured_at timestamp, sensitivity array<string>"),
    "state_facts": ("evidence/state_facts.jsonl", "fact_id string, subject_ref string, property_name string, value string, observation_ref string"),
}
LAYERS = ("specification", "model", "evidence", "analysis", "docs", "schemas")
RESERVED = ("manifest.json", "integrity/content_index.json")


def case_of(path: Column) -> Column:
    """The name of a stored case in a file's path: the folder two levels up, without its suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[a-z]+)?/[^/]+/[^/]+$", 1)


def read_table(spark: SparkSession, root: str, name: str, suffix: str = "*") -> DataFrame:
    """One table of all cases under a root, with ``case_id`` and ``_corrupt`` for malformed lines.

    A case without the file has no rows there. One glob scan; columns that are not used are not read.
    """
    file, schema = TABLES[name]
    rows = json_lines(spark, f"{root}/{suffix}/{file}", schema)
    return rows.withColumn("case_id", case_of(F.col("_metadata.file_path")))


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """The catalogue: one row a case; an unreadable manifest has nulls only and is left out."""
    rows = json_documents(spark, f"{root}/*/manifest.json", "format string, format_version string, case_id string, title string, lifecycle string")
    return rows.where("case_id is not null")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(case, path, content) of every file, for the content index."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    part = F.regexp_extract("path", r"/([^/]+)/((?:" + "|".join(LAYERS) + r"|integrity)/.*|manifest\.json)$", 1)
    return rows.select(part.alias("case"), F.regexp_extract("path", r"/((?:" + "|".join(LAYERS) + r"|integrity)/.*|manifest\.json)$", 1).alias("path"), "content")


def artifact_problem(path: Column, layer: Column) -> Column:
    """Why a supplemental artifact may not be stored; null where it may."""
    return (
        F.when(~layer.isin(*LAYERS), "unknown layer").when(path.startswith("/") | path.contains("..") | path.contains("\\"), "unsafe path")
        .when(path.isin(*RESERVED), "reserved path").when(~path.startswith(F.concat(layer, F.lit("/"))), "outside its layer")
    )
