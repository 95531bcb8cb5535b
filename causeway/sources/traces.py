"""Trace and event sources: scans with explicit schemas, and their normalisation into canonical rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions import scalars as S

VALUE = "struct<stringValue string, intValue string, doubleValue double, boolValue boolean>"
ATTRIBUTES = f"array<struct<key string, value {VALUE}>>".replace("key string", "key:string").replace("value struct", "value:struct")
OTEL_SPAN = (
    "traceId string, spanId string, parentSpanId string, name string, kind string, startTimeUnixNano string, endTimeUnixNano string, "
    "status struct<code:string>, attributes array<struct<key:string, value:struct<stringValue:string, intValue:string, doubleValue:double, boolValue:boolean>>>"
)
EVENT = (
    "event_id string, timestamp string, component string, component_kind string, operation string, node_kind string, status string, parent_event_id string, "
    "identities map<string,string>, attributes map<string,string>"
)
SDK_EVENT = "event_id string, kind string, timestamp string, component string, operation string, context map<string,string>, parent_event_id string, attributes map<string,string>, sensitivity array<string>"


def json_lines(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """A JSONL scan with an explicit schema; a malformed line comes back in ``_corrupt`` and blank lines are skipped."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines counted from 1, blank ones too.

    A file may be read in many splits: lines are numbered within a split, and the lines of the splits before it in its file are added.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    earlier = F.coalesce(F.sum("count").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = read.groupBy("file", "block").count().select("file", "block", earlier.alias("before"))
    number = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return read.withColumn("number", number).join(before, ["file", "block"]).select("file", (F.col("before") + F.col("number")).alias("line"), "value")


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines of JSONL files that are neither blank nor a JSON object."""
    parsed = F.try_parse_json("value")
    good = parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT")
    return numbered_lines(spark, path).where(F.col("value").rlike(r"[^\x20\x09-\x0D]") & ~good)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def stream_counts(rows: DataFrame, by: str) -> DataFrame:
    """Records and malformed lines of each group."""
    return rows.groupBy(by).agg(F.count("*").alias("records"), F.count_if(F.col("_corrupt").isNotNull()).alias("malformed"))


def page(rows: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """A bounded page in the order of a key."""
    return rows.orderBy(key).offset(offset).limit(limit)


def attribute_map(attributes: Column) -> Column:
    """OTel's list of keys and typed values as a map of text; of equal keys the last wins."""
    v = lambda x: F.coalesce(x["value"]["stringValue"], x["value"]["intValue"], x["value"]["doubleValue"].cast("string"), x["value"]["boolValue"].cast("string"))
    entries = F.transform(attributes, lambda x: F.struct(x["key"].alias("key"), v(x).alias("value")))
    last = F.filter(entries, lambda x, i: F.coalesce(~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]), F.lit(True)))
    return F.map_from_entries(F.filter(last, lambda x: x["key"].isNotNull()))


def flatten_otel(documents: DataFrame) -> DataFrame:
    """Spans of nested exports: resourceSpans, then scopeSpans or their older name, then spans."""
    resources = documents.select(F.explode("resourceSpans").alias("r"))
    scopes = resources.select(F.explode(F.coalesce("r.scopeSpans", "r.instrumentationLibrarySpans")).alias("s"), F.col("r.resource.attributes").alias("resource"))
    return scopes.select(F.explode("s.spans").alias("span"), "resource").select("span.*", "resource")


def normalize_spans(spans: DataFrame) -> DataFrame:
    """One canonical node a span; spans without an id are left to :func:`span_diagnostics`.

    ``spans`` has traceId, spanId, parentSpanId, name, kind, startTimeUnixNano, endTimeUnixNano, status and ``attrs``, a map.
    """
    attrs = F.col("attrs")
    component = F.coalesce(F.nullif(attrs["service.name"], F.lit("")), F.lit("unknown"))
    return spans.where(S.truthy(F.col("spanId"))).select(
        S.stable_id("node.otel", F.col("traceId"), F.col("spanId")).alias("node_id"), F.col("traceId").alias("trace_id"), F.col("spanId").alias("span_id"), F.nullif("parentSpanId", F.lit("")).alias("parent_span_id"),
        F.col("name").alias("operation"), S.node_kind(F.col("name"), F.col("kind"), attrs).alias("kind"), S.stable_id("component", component).alias("component_ref"), component.alias("component"),
        S.component_kind(component, attrs).alias("component_kind"), S.parse_timestamp(F.col("startTimeUnixNano")).alias("start_time"), S.parse_timestamp(F.col("endTimeUnixNano")).alias("end_time"),
        S.span_status(F.col("status.code"), F.lit(None).cast("string")).alias("status"), S.identity(attrs, "workflow.id").alias("workflow_id"), S.identity(attrs, "tenant.id").alias("tenant_id"),
        S.identity(attrs, "task.id").alias("task_id"), F.expr("try_cast(coalesce(attrs['task.attempt'], attrs['task_attempt']) as int)").alias("task_attempt"),
        S.stable_id("observation.otel", F.col("traceId"), F.col("spanId")).alias("observation_ref"),
    )


def span_diagnostics(spans: DataFrame) -> DataFrame:
    """Spans that cannot be normalised, and why."""
    return spans.where(~S.truthy(F.col("spanId")) | F.col("spanId").isNull()).select("traceId", "name", F.lit("missing span id").alias("problem"))


def span_edges(nodes: DataFrame) -> DataFrame:
    """Edges from parent spans; across components each names the boundary after the pair's first edge."""
    parents = nodes.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("node_id").alias("source_ref"), F.col("component_ref").alias("source_component"))
    edges = nodes.join(parents, ["trace_id", "parent_span_id"]).select("source_ref", F.col("node_id").alias("target_ref"), "source_component", F.col("component_ref").alias("target_component"), S.boundary_kind(F.col("kind")).alias("boundary_kind"))
    first = F.first("boundary_kind").over(Window.partitionBy("source_component", "target_component").orderBy("source_ref", "target_ref"))
    crossing = F.col("source_component") != F.col("target_component")
    return edges.withColumn("first_kind", first).select(
        "source_ref", "target_ref", S.stable_id("relation.otel-parent", F.col("source_ref"), F.col("target_ref")).alias("relation_id"),
        F.when(crossing, S.stable_id("boundary", F.col("source_component"), F.col("target_component"))).alias("boundary_ref"), F.when(crossing, F.col("first_kind")).alias("boundary_kind"))


def normalize_events(events: DataFrame, order: str) -> DataFrame:
    """One canonical node a structured event."""
    return events.select(
        F.concat(F.lit("node."), "event_id").alias("node_id"), "event_id", "parent_event_id", F.coalesce(F.nullif("node_kind", F.lit("")), F.lit("operation")).alias("kind"), "operation",
        F.concat(F.lit("component."), S.clean_prefix(F.col("component"))).alias("component_ref"), "component", "component_kind", S.parse_timestamp(F.col("timestamp")).alias("start_time"),
        F.coalesce("status", F.lit("unknown")).alias("status"), order)


def first_components(nodes: DataFrame, order: str) -> DataFrame:
    """Components as their first event defines them."""
    return nodes.groupBy("component_ref").agg(F.min_by(F.struct("component", "component_kind"), F.col(order)).alias("c")).select("component_ref", "c.*")


def event_edges(nodes: DataFrame) -> DataFrame:
    parents = nodes.select(F.col("event_id").alias("parent_event_id"), F.col("node_id").alias("source_ref"))
    return nodes.join(parents, "parent_event_id").select("source_ref", F.col("node_id").alias("target_ref"), S.stable_id("relation.event-parent", F.col("source_ref"), F.col("node_id")).alias("relation_id"))


def discover(rows: DataFrame, selectors: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows that any selector (kind, value) meets; without selectors all rows. ``columns`` maps kinds to columns."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in columns.items()])
    if selectors.isEmpty():
        return rows
    numbered = rows.withColumn("_s", kinds)
    hits = numbered.select("*", F.explode("_s").alias("_k")).select(*rows.columns, F.col("_k.kind").alias("kind_"), F.col("_k.value").alias("value_"))
    found = hits.join(selectors.select(F.col("kind").alias("kind_"), F.col("value").alias("value_")).distinct(), ["kind_", "value_"], "left_semi")
    return found.select(rows.columns).distinct()


def collect(rows: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Raw records of the candidates; an empty set of candidates keeps all."""
    return rows if candidates.isEmpty() else rows.join(candidates.select(key), key, "left_semi")


def foreign_tenants(rows: DataFrame, scope: str, source: str = "source") -> DataFrame:
    """Sources that hold another tenant than the scope's; they fail, others go on."""
    return rows.where(F.col("tenant_id").isNotNull() & (F.col("tenant_id") != scope)).select(source, "tenant_id").distinct()


def within_scope(rows: DataFrame, scope: str, source: str = "source") -> DataFrame:
    return rows.join(foreign_tenants(rows, scope, source).select(source).distinct(), source, "left_anti")


def merge_first(fragments: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the first fragment's; ``collision`` where a later one differs."""
    rest = [c for c in fragments.columns if c not in (key, order)]
    mark = F.xxhash64(*rest)
    group = Window.partitionBy(key)
    rows = fragments.withColumn("_first", F.row_number().over(group.orderBy(order, mark))).withColumn("_kinds", F.min(mark).over(group) != F.max(mark).over(group))
    return rows.where("_first = 1").select(*fragments.columns, F.col("_kinds").alias("collision"))


def write_case(tables: dict[str, DataFrame], folder: str) -> None:
    """Export of a case's tables as JSON, a folder for each entity, partitioned by case."""
    for name, df in tables.items():
        df.write.partitionBy("case_id").json(f"{folder}/{name}")
