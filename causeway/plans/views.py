"""Canonical tables of executions, as views over the driver's tables; and the same in DuckDB SQL.

``tables(spark, sf_dir)`` gives one lazy DataFrame for each entity, keyed by ``case_id``.
Times are microseconds since the epoch in UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.session import read_table

DAY_US = 86_400_000_000


def _id(prefix: str, *parts) -> F.Column:
    return F.concat(F.lit(prefix), *[x for p in parts for x in (F.lit("."), p.cast("string"))])


def _every(n: int) -> F.Column:
    return F.col("event_id") % n == 0


def events(spark: SparkSession, sf_dir: str, tasks: int = 0) -> DataFrame:
    """With ``tasks``, dealt to them by case while the rows are narrow, and with the case's id."""
    e = read_table(spark, sf_dir, "events")
    rows = e.select(
        "event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("start_us"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    ).withColumn("day", F.floor(F.col("start_us") / DAY_US))
    return rows.withColumn("case_id", _id("case", F.col("user_id"))).repartition(tasks, "case_id") if tasks else rows


def _case(rows: DataFrame) -> tuple[F.Column, str]:
    """A case's id, and what its windows go by: dealt rows hold the id and stay in their task."""
    return (F.col("case_id"), "case_id") if "case_id" in rows.columns else (_id("case", F.col("user_id")), "user_id")


def nodes(spark: SparkSession, sf_dir: str, tasks: int = 0) -> DataFrame:
    rows = events(spark, sf_dir, tasks)
    case, of_case = _case(rows)
    order = ["start_us", "event_id"]
    in_trace = Window.partitionBy(of_case, "day").orderBy(*order)
    in_task = Window.partitionBy(of_case, "k").orderBy(*order)
    kind = F.col("event_type")
    kinds = (
        F.when(kind == "view", "read").when(kind == "click", "message_consume").when(kind == "signup", "transaction")
        .when(kind == "purchase", "write").when(kind == "error", "message_publish").otherwise("operation")
    )
    u, k, e = F.col("user_id"), F.col("k"), F.col("event_id")
    rows = rows.withColumn("kind", kinds)
    before = F.lag("event_id").over(in_trace)
    return rows.select(
        case.alias("case_id"), _id("node.event", e).alias("node_id"), "event_id", "kind", F.col("event_type").alias("operation"),
        _id("component", kind).alias("component_ref"), "start_us", (F.col("start_us") + F.round(F.col("value") * 1000).cast("long")).alias("end_us"),
        F.when(_every(89), "stale").when(_every(83), "resource_exhausted").when(kind == "error", "error").otherwise("ok").alias("status"),
        _id("trace", u, F.col("day")).alias("trace_id"), _id("span", e).alias("span_id"),
        F.when(~_every(11), _id("span", before)).alias("parent_span_id"),
        F.when(~_every(97), _id("workflow", u, F.floor(F.col("day") / 7))).alias("workflow_id"),
        _id("operation", u, kind).alias("logical_operation_id"), _id("task", u, k).alias("task_id"),
        F.when(~_every(13), F.row_number().over(in_task)).alias("task_attempt"),
        F.when(F.col("kind").startswith("message"), _id("message", u, k % 20)).alias("message_id"),
        F.when(kind.isin("signup", "purchase"), _id("transaction", u, F.col("day"))).alias("transaction_id"),
        F.when(_every(101), "tenant.x").otherwise(_id("tenant", u % 7)).alias("tenant_id"),
        F.when(kind == "purchase", _id("key", u, k)).alias("idempotency_key"),
        F.when(_every(17), F.array().cast("array<string>")).otherwise(F.array(_id("observation", e))).alias("observation_refs"),
        _id("role", k % 10).alias("role"), F.when(k % 25 == 0, (1 + (k / 25).cast("int") % 2).cast("string")).alias("schema_version"),
        _every(211).alias("amplified"), _every(503).alias("identity_collision"), F.lit(50).alias("maximum_amplification"),
        F.when(_every(103), "principal.x").otherwise(_id("principal", u % 5)).alias("principal_id"), F.when(~_every(23), _id("task-name", k % 6)).alias("task_name"), (k % 3).alias("stage"),
    )


def effects(spark: SparkSession, sf_dir: str, tasks: int = 0) -> DataFrame:
    rows = events(spark, sf_dir, tasks)
    u, k, e, kind = F.col("user_id"), F.col("k"), F.col("event_id"), F.col("event_type")
    return rows.where(kind.isin("purchase", "signup", "error")).select(
        _case(rows)[0].alias("case_id"), _id("effect", e).alias("effect_id"), _id("effect-key", u, k).alias("logical_effect_key"),
        _id("node.event", e).alias("producer_node_ref"),
        F.when(kind == "purchase", "durable").when(kind == "signup", "committed").otherwise("attempted").alias("durability"),
        F.when(kind == "purchase", _id("key", u, k)).alias("idempotency_key"), F.array(_id("observation", e)).alias("evidence_refs"),
        _every(5).alias("required"), (1 + k % 2).alias("maximum_durable_count"),
    )


def contexts(spark: SparkSession, sf_dir: str, tasks: int = 0) -> DataFrame:
    rows = events(spark, sf_dir, tasks)
    case, of_case = _case(rows)
    k, e = F.col("k"), F.col("event_id")
    first = F.first("event_id").over(Window.partitionBy(of_case).orderBy("start_us", "event_id"))
    return rows.select(
        case.alias("case_id"), _id("context", e).alias("context_id"), F.lit("session").alias("namespace"), F.col("event_type").alias("field_name"),
        (k % 4).cast("string").alias("value"),
        F.when(k % 4 == 0, "required").when(k % 4 == 1, "translated").when(k % 4 == 2, "forbidden").otherwise("regenerated").alias("propagation_contract"),
        _id("node.event", first).alias("origin_node_ref"), F.when(~_every(19), _id("node.event", e)).alias("observed_at_node_ref"), e.alias("input_seq"),
    )


def relations(spark: SparkSession, sf_dir: str, tasks: int = 0) -> DataFrame:
    """Every third pair of a case's consecutive nodes is recorded."""
    rows = events(spark, sf_dir, tasks)
    case, of_case = _case(rows)
    e = F.col("event_id")
    before = F.lag("event_id").over(Window.partitionBy(of_case).orderBy("start_us", "event_id"))
    rows = rows.withColumn("before", before).where(F.col("before").isNotNull() & _every(3))
    return rows.select(
        case.alias("case_id"), _id("relation.source", e).alias("relation_id"),
        F.when(_every(6), "parent_of").otherwise("invokes").alias("kind"), _id("node.event", F.col("before")).alias("source_ref"),
        _id("node.event", e).alias("target_ref"), F.lit("source_native").alias("derivation"),
    )


def observations(spark: SparkSession, sf_dir: str, tasks: int = 0) -> DataFrame:
    rows = events(spark, sf_dir, tasks)
    e = F.col("event_id")
    return rows.select(
        _case(rows)[0].alias("case_id"), _id("observation", e).alias("observation_id"), F.lit("event").alias("kind"), "start_us",
        F.array_compact(F.array(F.lit("props"), F.when(_every(307), "Authorization"))).alias("attribute_keys"),
        F.array_compact(F.array(F.when(_every(401), "credential"))).alias("sensitivity"), _every(601).alias("contradiction"),
    )


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each component of the system; as few as there are event types."""
    kinds = read_table(spark, sf_dir, "events").select("event_type").distinct()
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "database").when(F.col("event_type") == "error", "broker").otherwise("service")
    return kinds.select(_id("component", F.col("event_type")).alias("component_id"), F.initcap("event_type").alias("name"), kind.alias("kind"), F.when(kind == "service", "handler").otherwise("store").alias("role"))


def cases(spark: SparkSession, sf_dir: str, tasks: int = 0) -> DataFrame:
    users = read_table(spark, sf_dir, "events").select("user_id").distinct()
    rows = users.select(_id("case", F.col("user_id")).alias("case_id"), F.when(F.col("user_id") % 3 == 0, "comparison").otherwise("single").alias("category"))
    return rows.repartition(tasks, "case_id") if tasks else rows


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of every even user with the next."""
    users = read_table(spark, sf_dir, "events").select("user_id").distinct()
    other = users.select((F.col("user_id") - 1).alias("user_id"))
    both = users.where(F.col("user_id") % 2 == 0).join(other, "user_id")
    return both.select(
        _id("comparison", F.col("user_id")).alias("comparison_id"), _id("case", F.col("user_id")).alias("baseline_case"),
        _id("case", F.col("user_id") + 1).alias("candidate_case"),
    )


VIEWS = {f.__name__: f for f in (nodes, effects, contexts, relations, observations, components, cases, pairs)}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: view(spark, sf_dir) for name, view in VIEWS.items()}


def dealt_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The same tables, those of a case's own rows dealt by case at the start: what is keyed by case moves no row again.

    For readers that take whole cases: windows by case or finer, and :func:`causeway.sources.case_store.save_cases`."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return tables(spark, sf_dir) | {f.__name__: f(spark, sf_dir, tasks) for f in (nodes, effects, contexts, relations, observations, cases)}


#: The same views in DuckDB SQL, to be put before an oracle's own SELECT.
SQL_VIEWS = """WITH ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS start_us, CAST(json_extract_string(props, '$.k') AS INT) AS k,
    epoch_us(ts) // 86400000000 AS day FROM events),
nodes AS (SELECT 'case.' || user_id AS case_id, 'node.event.' || event_id AS node_id, event_id,
    CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'message_consume' WHEN 'signup' THEN 'transaction' WHEN 'purchase' THEN 'write'
         WHEN 'error' THEN 'message_publish' ELSE 'operation' END AS kind,
    event_type AS operation, 'component.' || event_type AS component_ref, start_us, start_us + CAST(round(value * 1000) AS BIGINT) AS end_us,
    CASE WHEN event_id % 89 = 0 THEN 'stale' WHEN event_id % 83 = 0 THEN 'resource_exhausted' WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
    'trace.' || user_id || '.' || day AS trace_id, 'span.' || event_id AS span_id,
    CASE WHEN event_id % 11 <> 0 THEN 'span.' || lag(event_id) OVER (PARTITION BY user_id, day ORDER BY start_us, event_id) END AS parent_span_id,
    CASE WHEN event_id % 97 <> 0 THEN 'workflow.' || user_id || '.' || day // 7 END AS workflow_id,
    'operation.' || user_id || '.' || event_type AS logical_operation_id, 'task.' || user_id || '.' || k AS task_id,
    CASE WHEN event_id % 13 <> 0 THEN row_number() OVER (PARTITION BY user_id, k ORDER BY start_us, event_id) END AS task_attempt,
    CASE WHEN event_type IN ('click', 'error') THEN 'message.' || user_id || '.' || k % 20 END AS message_id,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'transaction.' || user_id || '.' || day END AS transaction_id,
    CASE WHEN event_id % 101 = 0 THEN 'tenant.x' ELSE 'tenant.' || user_id % 7 END AS tenant_id,
    CASE WHEN event_type = 'purchase' THEN 'key.' || user_id || '.' || k END AS idempotency_key,
    CASE WHEN event_id % 17 = 0 THEN [] ELSE ['observation.' || event_id] END AS observation_refs, 'role.' || k % 10 AS role,
    CASE WHEN k % 25 = 0 THEN CAST(1 + (k // 25) % 2 AS VARCHAR) END AS schema_version, event_id % 211 = 0 AS amplified,
    event_id % 503 = 0 AS identity_collision, 50 AS maximum_amplification,
    CASE WHEN event_id % 103 = 0 THEN 'principal.x' ELSE 'principal.' || user_id % 5 END AS principal_id, CASE WHEN event_id % 23 <> 0 THEN 'task-name.' || k % 6 END AS task_name, k % 3 AS stage FROM ev),
effects AS (SELECT 'case.' || user_id AS case_id, 'effect.' || event_id AS effect_id, 'effect-key.' || user_id || '.' || k AS logical_effect_key,
    'node.event.' || event_id AS producer_node_ref, CASE event_type WHEN 'purchase' THEN 'durable' WHEN 'signup' THEN 'committed' ELSE 'attempted' END AS durability,
    CASE WHEN event_type = 'purchase' THEN 'key.' || user_id || '.' || k END AS idempotency_key, ['observation.' || event_id] AS evidence_refs,
    event_id % 5 = 0 AS required, 1 + k % 2 AS maximum_durable_count FROM ev WHERE event_type IN ('purchase', 'signup', 'error')),
contexts AS (SELECT 'case.' || user_id AS case_id, 'context.' || event_id AS context_id, 'session' AS namespace, event_type AS field_name,
    CAST(k % 4 AS VARCHAR) AS value, ['required', 'translated', 'forbidden', 'regenerated'][k % 4 + 1] AS propagation_contract,
    'node.event.' || first_value(event_id) OVER (PARTITION BY user_id ORDER BY start_us, event_id) AS origin_node_ref,
    CASE WHEN event_id % 19 <> 0 THEN 'node.event.' || event_id END AS observed_at_node_ref, event_id AS input_seq FROM ev),
relations AS (SELECT 'case.' || user_id AS case_id, 'relation.source.' || event_id AS relation_id, CASE WHEN event_id % 6 = 0 THEN 'parent_of' ELSE 'invokes' END AS kind,
    'node.event.' || before AS source_ref, 'node.event.' || event_id AS target_ref, 'source_native' AS derivation
    FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY start_us, event_id) AS before FROM ev) WHERE before IS NOT NULL AND event_id % 3 = 0),
observations AS (SELECT 'case.' || user_id AS case_id, 'observation.' || event_id AS observation_id, 'event' AS kind, start_us,
    CASE WHEN event_id % 307 = 0 THEN ['props', 'Authorization'] ELSE ['props'] END AS attribute_keys,
    CASE WHEN event_id % 401 = 0 THEN ['credential'] ELSE [] END AS sensitivity, event_id % 601 = 0 AS contradiction FROM ev),
components AS (SELECT 'component.' || event_type AS component_id, upper(event_type[1]) || event_type[2:] AS name,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'database' WHEN event_type = 'error' THEN 'broker' ELSE 'service' END AS kind,
    CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN 'store' ELSE 'handler' END AS role FROM (SELECT DISTINCT event_type FROM events)),
cases AS (SELECT 'case.' || user_id AS case_id, CASE WHEN user_id % 3 = 0 THEN 'comparison' ELSE 'single' END AS category FROM (SELECT DISTINCT user_id FROM events)),
pairs AS (SELECT 'comparison.' || a.user_id AS comparison_id, 'case.' || a.user_id AS baseline_case, 'case.' || b.user_id AS candidate_case
    FROM (SELECT DISTINCT user_id FROM events) a JOIN (SELECT DISTINCT user_id FROM events) b ON b.user_id = a.user_id + 1 WHERE a.user_id % 2 = 0)"""


def sql_id(prefix: str, *parts: str) -> str:
    """DuckDB SQL of a stable id."""
    joined = " || chr(31) || ".join(f"coalesce(CAST({p} AS VARCHAR), 'None')" for p in parts)
    return f"'{prefix}.' || left(sha256({joined}), 16)"
