"""Queries for privacy, coverage, integrity, sources, mutations and stream checks, each with its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway import plugins
from causeway.functions import scalars as S
from causeway.operators import assembly, coverage, gated_export, integrity, invariants, inventory, mutations, privacy
from causeway.plans.core import BROKEN, DERIVED, ORACLE_SQL, QUERIES, RUNTIME, flat, graph, query
from causeway.plans.views import SQL_VIEWS, dealt_tables, sql_id
from causeway.session import read_table, shared_folder
from causeway.sources import case_store, traces
from causeway.streaming import checks


def table_query(name: str, sql: str | None = None):
    """Register fn(read), where read(table) scans a driver's table."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: flat(fn(lambda table: read_table(spark, sf_dir, table)))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


# scalars
_HEX = "sha256(CAST({} AS VARCHAR))"
table_query("b01_stable_id", f"SELECT event_id, {sql_id('node', 'event_id', 'user_id')} AS id FROM events")(lambda r: r("events").select("event_id", S.stable_id("node", F.col("event_id"), F.col("user_id")).alias("id")))
table_query("b02_parse_timestamp", "SELECT event_id, epoch_us(ts) // 1000000 * 1000000 AS seconds_us, epoch_us(ts) // 1000 * 1000 AS millis_us, epoch_us(ts) AS nanos_us FROM events")(
    lambda r: r("events").select("event_id", *[F.unix_micros(S.parse_timestamp((F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / d) * m).cast("string"))).alias(n) for n, d, m in (("seconds_us", 1000000, 1), ("millis_us", 1000, 1), ("nanos_us", 1, 1000))]))
table_query("b03_effective_time", "SELECT event_id, epoch_us(CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 1 SECOND END) AS us FROM events")(
    lambda r: r("events").select("event_id", F.unix_micros(S.effective_time(F.when(F.col("event_id") % 2 == 0, F.col("ts")), F.col("ts") + F.expr("interval 1 second")).cast("timestamp")).alias("us")))
query("b04_qualified_name", " SELECT context_id, namespace || '.' || field_name AS name FROM contexts")(lambda t: t["contexts"].select("context_id", S.qualified_name(F.col("namespace"), F.col("field_name")).alias("name")))
table_query("b05_normalize_operation", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '\b[0-9a-f]{8,}\b', '<id>', 'g'), '\b[0-9]+\b', '<n>', 'g'), '\s+', ' ', 'g') AS operation FROM pages")(
    lambda r: r("pages").select("page_id", S.normalize_operation(F.col("url")).alias("operation")))
_attrs = lambda: F.create_map(F.lit("messaging.system"), F.when(F.col("event_type").isin("error", "click"), "queue"), F.lit("messaging.operation"), F.when(F.col("event_type") == "error", "publish").otherwise("receive"),
                      F.lit("db.system"), F.when(F.col("event_type") == "purchase", "postgres"), F.lit("task.id"), F.when(F.col("event_type") == "signup", "t"), F.lit("user.id"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")), F.lit("user_id"), F.lit("0"))
table_query("b06_node_kind", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'read' WHEN 'error' THEN 'message_publish' WHEN 'click' THEN 'message_consume' WHEN 'signup' THEN 'task_attempt' ELSE 'request' END AS kind FROM events")(
    lambda r: r("events").select("event_id", S.node_kind(F.col("event_type"), F.lit("SPAN_KIND_SERVER"), _attrs()).alias("kind")))
table_query("b07_component_kind", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'database' WHEN 'error' THEN 'broker' WHEN 'click' THEN 'broker' ELSE 'service' END AS kind FROM events")(
    lambda r: r("events").select("event_id", S.component_kind(F.col("event_type"), _attrs()).alias("kind")))
query("b08_boundary_kind", " SELECT node_id, CASE WHEN kind LIKE 'message%' THEN 'message' WHEN kind IN ('read', 'write', 'transaction') THEN 'storage' ELSE 'network' END AS boundary FROM nodes")(
    lambda t: t["nodes"].select("node_id", S.boundary_kind(F.col("kind")).alias("boundary")))
query("b09_span_status", " SELECT node_id, coalesce(nullif(lower(status), 'ok'), 'unknown') AS status FROM nodes")(lambda t: t["nodes"].select("node_id", S.span_status(F.lit(""), F.when(F.col("status") != "ok", F.upper("status"))).alias("status")))
table_query("b10_identity_aliases", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '0' END AS user FROM events")(lambda r: r("events").select("event_id", S.identity(_attrs(), "user.id").alias("user")))
table_query("b11_mapping_coercion", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")(lambda r: r("events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'string')").alias("k")))
query("b12_duration", " SELECT node_id, greatest(0.0, (end_us - start_us) / 1000.0) AS ms FROM nodes")(lambda t: t["nodes"].select("node_id", S.duration_ms(F.col("start_us"), F.col("end_us")).alias("ms")))
query("b13_offset", " SELECT node_id, (start_us - min(start_us) OVER (PARTITION BY case_id)) / 1000.0 AS ms FROM nodes")(lambda t: assembly.timeline(t["nodes"], t["components"]).select("node_id", F.col("offset_ms").alias("ms")))
table_query("b15_canonical_json", "SELECT event_id, '{\"a\":1,\"k\":' || json_extract_string(props, '$.k') || '}' || chr(10) AS canonical FROM events")(
    lambda r: r("events").select("event_id", S.canonical_json(F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a" : 1}'))).alias("canonical")))
table_query("b16_digest", "SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS digest FROM documents")(lambda r: r("documents").select("doc_id", S.digest(F.coalesce("text", F.lit(""))).alias("digest")))
table_query("b18_mask", "SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE left(c_name, 2) || repeat('*', least(length(c_name) - 4, 12)::INT) || right(c_name, 2) END AS masked FROM customer")(
    lambda r: r("customer").select("c_custkey", S.mask(F.col("c_name")).alias("masked")))
_SECRET = b"key of the registered queries"
_PADS = [bytes(b ^ x for b in _SECRET.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


def _sql_token(message: str, prefix: str) -> str:
    """DuckDB SQL of a token: HMAC-SHA-256 as two nested digests."""
    return f"'{prefix}_' || left(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode({message})))), 14)"


def _sql_summary(c: str) -> str:
    return f"'[redacted free text: ' || length({c}) || ' chars, sha256:' || left(sha256({c}), 12) || ']'"


_CUT = lambda c: f"left({c}, 64) || CASE WHEN length({c}) > 64 THEN '…' ELSE '' END"
table_query("b17_token", "SELECT c_custkey, " + _sql_token("""'user_identifier:"' || c_name || '"'""", "user") + " AS token FROM customer")(
    lambda r: r("customer").select("c_custkey", S.token(_SECRET, F.col("c_name"), F.array(F.lit("user_identifier"))).alias("token")))
table_query("b19_summarize", f"SELECT doc_id, {_sql_summary('text')} AS summary FROM documents")(lambda r: r("documents").select("doc_id", S.summarize(F.col("text")).alias("summary")))
table_query("b20_truncate", "SELECT doc_id, left(text, 20) || CASE WHEN length(text) > 20 THEN '…' ELSE '' END AS short FROM documents")(lambda r: r("documents").select("doc_id", S.truncate(F.col("text"), 20).alias("short")))
table_query("b21_preview", f"SELECT doc_id, coalesce({_CUT("replace(text, chr(10), ' ')")}, 'null') AS preview FROM documents")(lambda r: r("documents").select("doc_id", S.preview(F.col("text")).alias("preview")))
_SEV = lambda: F.element_at(F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low", "info")]), (F.col("event_id") % 5 + 1).cast("int"))
table_query("b22_severity_rank", "SELECT event_id, CAST(4 - event_id % 5 AS INT) AS rank FROM events")(lambda r: r("events").select("event_id", S.severity_rank(_SEV()).alias("rank")))
_ST = lambda: F.element_at(F.array(*[F.lit(s) for s in invariants.STATUSES]), (F.col("event_id") % 6 + 1).cast("int"))
table_query("b23_evidence_class", "SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'unknown' WHEN 3 THEN 'contradicted' ELSE 'deterministic' END AS class, CASE event_id % 6 WHEN 2 THEN 0.5 ELSE 1.0 END AS confidence FROM events")(
    lambda r: r("events").select("event_id", S.evidence_class(_ST()).alias("class"), S.confidence(_ST()).alias("confidence")))
table_query("b24_title", "SELECT event_id, 'Effect ' || upper(event_type[1]) || event_type[2:] AS title FROM events")(lambda r: r("events").select("event_id", S.title_of(F.concat(F.lit("invariant.effect."), "event_type")).alias("title")))
table_query("b25_trace_step", f"SELECT event_id, {sql_id('evaluation-step', chr(39) + 'effect' + chr(39), 'event_type', 'event_id')} AS step FROM events")(
    lambda r: r("events").select("event_id", S.stable_id("evaluation-step", F.lit("effect"), F.col("event_type"), F.col("event_id")).alias("step")))
table_query("b26_deep_link", "SELECT event_id, 'http://x/cases/' || user_id || CASE WHEN event_id % 2 = 0 THEN '?node=' || event_id ELSE '' END AS link FROM events")(
    lambda r: r("events").select("event_id", S.deep_link("http://x/", F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")), F.lit(None).cast("string")).alias("link")))
_VERSION = lambda: F.when(F.col("user_id") % 3 == 0, "1.0.0").when(F.col("user_id") % 3 == 1, "0.9.0").otherwise("0.1.0")
_manifests = lambda r: r("events").select("user_id").distinct().select(F.col("user_id").alias("case_id"), _VERSION().alias("version"))
_MANIFESTS = "SELECT DISTINCT user_id AS case_id, CASE user_id % 3 WHEN 0 THEN '1.0.0' WHEN 1 THEN '0.9.0' ELSE '0.1.0' END AS version FROM events"
table_query("b28_manifest_migration", f"SELECT case_id, '1.0.0' AS version, 'local' AS profile FROM ({_MANIFESTS}) WHERE version <> '0.1.0'")(lambda r: integrity.migrate(_manifests(r), {"profile": "local"})[0])
_OWNER = "CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id % 50 || '@x.org' ELSE 'u' || doc_id % 50 END"
_owner = lambda: F.concat(F.lit("u"), (F.col("doc_id") % 50).cast("string"), F.when(F.col("doc_id") % 3 == 0, "@x.org").otherwise(""))
table_query("b29_sensitivity_labels", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'credential' WHEN 1 THEN 'query_text' WHEN 2 THEN 'student_record' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 4 < 3 THEN ',' ELSE '' END || 'user_identifier' ELSE '' END AS labels FROM documents")(
    lambda r: r("documents").select("doc_id", S.sensitivity_labels(F.element_at(F.array(*[F.lit(k) for k in ("x.api_key", "sql", "grade-1", "ungraded")]), (F.col("doc_id") % 4 + 1).cast("int")), _owner()).alias("labels")))
table_query("b30_declared_labels", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'internal,user_identifier' ELSE 'user_identifier' END AS labels FROM documents")(
    lambda r: r("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, privacy.labels_of("email", F.col("text"), ("internal",))).otherwise(privacy.labels_of("email", F.col("text"))).alias("labels")))

# privacy over documents and customers
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_docs = lambda r: r("documents").select("doc_id", "text", "source", _owner().alias("owner"), F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("k"), "doc_id")).alias("api_key"))
_TOKEN = f"CASE WHEN doc_id % 3 = 0 THEN {_sql_token(chr(39) + 'user_identifier:' + chr(34) + chr(39) + ' || ' + _OWNER + ' || ' + chr(39) + chr(34) + chr(39), 'user')} ELSE {_OWNER} END"
_DIGEST = lambda v: f"'sha256:' || sha256(CAST(to_json({v}) AS VARCHAR) || chr(10))"
#: Every leaf of the records, with what the shareable policy says of it; no text of the test tables is an e-mail address as a whole.
_LEAVES = f"""WITH leaf AS (SELECT doc_id AS id, 'record.text' AS path, 'free_text' AS labels, 'free-text.summarize' AS rule, 'summarize' AS action, text AS value, {_sql_summary('text')} AS replacement FROM documents
    UNION ALL SELECT doc_id, 'record.source', '', NULL, 'retain', source, source FROM documents
    UNION ALL SELECT doc_id, 'record.owner', CASE WHEN doc_id % 3 = 0 THEN 'user_identifier' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN 'user.tokenize' END, CASE WHEN doc_id % 3 = 0 THEN 'tokenize' ELSE 'retain' END, {_OWNER}, {_TOKEN} FROM documents
    UNION ALL SELECT doc_id, 'record.api_key', 'credential', 'credential.remove', 'remove', CASE WHEN doc_id % 9 = 0 THEN 'k' || doc_id END, CASE WHEN doc_id % 9 = 0 THEN '[REDACTED]' END FROM documents) """
table_query("m01_field_inventory", _LEAVES + f"SELECT id, path, CASE WHEN value IS NULL THEN 'null' ELSE 'string' END AS type, labels, rule, action, FALSE AS structural, coalesce({_CUT("replace(value, chr(10), ' ')")}, 'null') AS preview FROM leaf")(
    lambda r: privacy.inventory(_docs(r), "doc_id", "shareable").drop("value"))
_nested = lambda r: _docs(r).select("doc_id", F.to_json(F.struct(
    F.struct(F.concat(F.lit("case."), "doc_id").alias("case_id"), F.array(F.lit("internal")).alias("sensitivity")).alias("case"),
    F.array(F.struct(F.concat(F.lit("n."), "doc_id").alias("node_id"), F.array(F.lit("internal"), F.lit("odd")).alias("sensitivity"), F.struct(F.col("owner").alias("principal_id")).alias("identities"),
                     F.struct(F.col("text").alias("note"), F.col("doc_id").alias("count")).alias("attributes"))).alias("nodes")), {"ignoreNullFields": "false"}).alias("record"))
_NESTED = f"""WITH leaf AS (SELECT doc_id AS id, unnest(['$.case.case_id', '$.case.sensitivity[0]', '$.nodes[0].node_id', '$.nodes[0].sensitivity[0]', '$.nodes[0].sensitivity[1]', '$.nodes[0].identities.principal_id', '$.nodes[0].attributes.note', '$.nodes[0].attributes.count']) AS path,
    unnest(['str', 'str', 'str', 'str', 'str', 'str', CASE WHEN text IS NULL THEN 'NoneType' ELSE 'str' END, 'int']) AS type, unnest(['', '', '', '', '', 'user_identifier', 'free_text,internal', 'internal']) AS labels,
    unnest([NULL, NULL, NULL, NULL, NULL, 'principal.tokenize', 'free-text.summarize', NULL]) AS rule, unnest(['retain', 'retain', 'retain', 'retain', 'retain', 'tokenize', 'summarize', 'retain']) AS action,
    unnest([TRUE, FALSE, TRUE, FALSE, FALSE, FALSE, FALSE, FALSE]) AS structural, unnest(['case.' || doc_id, 'internal', 'n.' || doc_id, 'internal', 'odd', {_OWNER}, text, doc_id::VARCHAR]) AS value FROM documents) """
table_query("m01_nested_inventory", _NESTED + f"SELECT id, path, type, labels, rule, action, structural, coalesce({_CUT("replace(value, chr(10), ' ')")}, 'null') AS preview FROM leaf")(
    lambda r: inventory.nested_inventory(_nested(r), "doc_id", "record", "shareable"))
table_query("e11_inventory_by_label_and_action", _NESTED + "SELECT 'label' AS kind, name, count(*) AS n FROM (SELECT unnest(string_split(labels, ',')) AS name FROM leaf WHERE labels <> '') GROUP BY name UNION ALL SELECT 'action', action, count(*) FROM leaf GROUP BY action")(
    lambda r: inventory.by_label_and_action(inventory.nested_inventory(_nested(r), "doc_id", "record", "shareable")))
table_query("m02_rule_matching", _LEAVES + "SELECT coalesce(rule, 'none') AS rule, action, count(*) AS n FROM leaf GROUP BY ALL")(
    lambda r: privacy.inventory(_docs(r), "doc_id", "shareable").groupBy(F.coalesce("rule", F.lit("none")).alias("rule"), "action").agg(F.count("*").alias("n")))
table_query("g05_first_rule_by_priority", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'b' ELSE 'c' END AS rule FROM documents")(lambda r: r("documents").select("doc_id", privacy.rule_of(
    [privacy.Rule("b", "mask", 1, value_pattern="^even"), privacy.Rule("c", "digest", 5), privacy.Rule("a", "retain", 5)], "record.x", "x", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"), F.array().cast("array<string>")).alias("rule")))
_REDACTED = f"SELECT doc_id, {_sql_summary('text')} AS text, source, {_TOKEN} AS owner, CASE WHEN doc_id % 9 = 0 THEN '[REDACTED]' END AS api_key FROM documents"
table_query("m03_redaction", _REDACTED)(lambda r: privacy.redact(_docs(r), "doc_id", "shareable", _SECRET))
table_query("m08_redaction_of_all_rows", _REDACTED)(lambda r: privacy.redact(_docs(r), "doc_id", "shareable", _SECRET))
table_query("m04_transformation_records", _LEAVES + f"""SELECT {sql_id('transform', 'id', 'path')} AS transformation_id, id, path, labels, action, rule AS rule_ref, 'string' AS original_type, {_DIGEST('value')} AS original_digest, replacement
    FROM leaf WHERE action <> 'retain' AND value IS NOT NULL""")(lambda r: privacy.transformations(_docs(r), "doc_id", "shareable", _SECRET))
table_query("e12_redaction_summary", _LEAVES + "SELECT action, count(*) AS n, count(DISTINCT CASE WHEN action = 'tokenize' THEN replacement END) AS tokens FROM leaf WHERE action <> 'retain' AND value IS NOT NULL GROUP BY action")(
    lambda r: privacy.redaction_summary(_docs(r), "doc_id", "shareable", _SECRET))
table_query("e11_inventory_by_label", _LEAVES + "SELECT labels AS label, count(*) AS n FROM leaf WHERE labels <> '' GROUP BY labels")(lambda r: privacy.by_label(_docs(r), "doc_id", "shareable"))
#: Records with a header that some of the policies' patterns meet.
_headed = lambda r: _docs(r).withColumn("header", F.element_at(F.array(
    F.concat(F.lit("Authorization: Bearer "), "source", "doc_id"), F.concat(F.lit("AKIA"), F.lpad(F.col("doc_id").cast("string"), 16, "0")), F.concat(F.lit("passwd : "), "doc_id"),
    F.concat(F.lit("-----BEGIN EC PRIVATE KEY-----"), "doc_id"), F.concat(F.lit("10.0.0."), F.col("doc_id") % 256), F.lit("plain"), F.lit(None).cast("string")), (F.col("doc_id") % 7 + 1).cast("int")))
_HEADED = f"""SELECT doc_id AS id, unnest(['record.text', 'record.source', 'record.owner', 'record.api_key', 'record.header']) AS path, unnest([text, source, {_OWNER}, CASE WHEN doc_id % 9 = 0 THEN 'k' || doc_id END,
    ['Authorization: Bearer ' || source || doc_id, 'AKIA' || lpad(doc_id::VARCHAR, 16, '0'), 'passwd : ' || doc_id, '-----BEGIN EC PRIVATE KEY-----' || doc_id, '10.0.0.' || doc_id % 256, 'plain', NULL][doc_id % 7 + 1]]) AS value FROM documents"""
_SQL_TEXT = lambda p: "'" + p.replace("'", "''") + "'"
_VIOL = " UNION ALL ".join(f"SELECT id, path, '{name}' AS pattern FROM ({_HEADED}) WHERE regexp_matches(value, {_SQL_TEXT(p)})" for name, p in (privacy.PROHIBITED["shareable"] | privacy.PERSONAL).items())
table_query("c08_prohibited_patterns", _VIOL)(lambda r: privacy.violations(_headed(r), "doc_id"))
table_query("c09_first_match_in_payload", f"""SELECT id, left(match, 64) || CASE WHEN length(match) > 64 THEN '…' ELSE '' END AS match
    FROM (SELECT doc_id AS id, regexp_extract(CAST(json_object('text', text) AS VARCHAR), '{_EMAIL}') AS match FROM documents) WHERE match <> ''""")(lambda r: privacy.first_matches(r("documents").select("doc_id", "text"), "doc_id", _EMAIL))
table_query("m06_clean_export", _REDACTED)(lambda r: privacy.export(_docs(r), "doc_id", "shareable", _SECRET)[0])
table_query("m05_policies", f"""SELECT 'internal' AS policy, doc_id, text, source, {_OWNER} AS owner, CASE WHEN doc_id % 9 = 0 THEN '[PROHIBITED]' END AS api_key FROM documents
    UNION ALL SELECT 'shareable', * FROM ({_REDACTED}) UNION ALL SELECT 'public', * FROM ({_REDACTED})""")(
    lambda r: reduce(DataFrame.unionByName, [privacy.redact(_docs(r), "doc_id", p, _SECRET).select(F.lit(p).alias("policy"), "*") for p in privacy.POLICIES]))

# coverage over nations, segments and orders
_expected = lambda r: coverage.expected_points(*[
    r("nation").join(r("customer").select("c_mktsegment").distinct(), F.lit(True)).select(F.lit(i).alias("seq"), F.lit("interaction").alias("dimension"), F.concat_ws("|", "n_name", "c_mktsegment").alias("key"), F.concat(F.lit(f"{f}."), "n_regionkey").alias("family"))
    for i, f in ((1, "draft"), (2, "family"))])
_witness = lambda r: r("customer").join(r("nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("c_acctbal > 9500 or n_regionkey = 7").select(
    F.lit("interaction").alias("dimension"), F.concat_ws("|", "n_name", F.when(F.col("c_custkey") % 50 == 0, "OTHER").otherwise(F.col("c_mktsegment"))).alias("key")).groupBy("dimension", "key").agg(F.count("*").alias("witnesses"))
_COV = """WITH expected AS (SELECT 2 AS seq, 'interaction' AS dimension, n_name || '|' || s AS key, 'family.' || n_regionkey AS family FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer)),
    witness AS (SELECT 'interaction' AS dimension, n_name || '|' || CASE WHEN c_custkey % 50 = 0 THEN 'OTHER' ELSE c_mktsegment END AS key, count(*) AS witnesses FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500 GROUP BY ALL),
    ledger AS (SELECT e.dimension, e.key, family, CASE WHEN witnesses IS NULL THEN 'uncovered' ELSE 'covered' END AS status, coalesce(witnesses, 0) AS witnesses FROM expected e LEFT JOIN witness w USING (dimension, key)
        UNION ALL SELECT dimension, key, NULL, 'supplemental', witnesses FROM witness w WHERE key NOT IN (SELECT key FROM expected)) """
_ledger = lambda r: coverage.ledger(_expected(r), _witness(r))
table_query("h03_expected_points", _COV + "FROM expected")(_expected)
table_query("n03_coverage_ledger", _COV + "FROM ledger")(_ledger)
table_query("h05_supplemental_witnesses", _COV + "SELECT dimension, key, witnesses FROM ledger WHERE status = 'supplemental'")(lambda r: _ledger(r).where("status = 'supplemental'").select("dimension", "key", "witnesses"))
table_query("n01_witnesses", _COV + "FROM witness")(_witness)
table_query("e13_completion", _COV + "SELECT dimension, count(*) AS points, count(*) FILTER (status = 'covered') AS covered, round(avg(CASE WHEN status = 'covered' THEN 1.0 ELSE 0.0 END), 6) AS share FROM ledger WHERE status <> 'supplemental' GROUP BY dimension")(lambda r: coverage.completion(_ledger(r)))
table_query("n04_recommendations", _COV + """, u AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY dimension, key) AS n FROM ledger WHERE status = 'uncovered'),
    f AS (SELECT family, count(*) AS uncovered, string_agg(key, ',' ORDER BY key) FILTER (n <= 12) AS points FROM u GROUP BY family) SELECT *, CAST(row_number() OVER (ORDER BY uncovered DESC, family) AS INT) AS rank FROM f""")(lambda r: coverage.recommend(_ledger(r)))
for _alias in ("f08_recommendation_rank", "g04_top_uncovered"):
    QUERIES[_alias], ORACLE_SQL[_alias] = QUERIES["n04_recommendations"], ORACLE_SQL["n04_recommendations"]
# coverage of a registry: families are market segments and regions, instances are customers, realisations are nations
_PROFILES = ["complete", "source_only", "destination_only", "missing_boundary", "broken_trace", "clock_skewed", "contradictory", "redacted"]
_FAULTS = ["context.drop", "effect.duplicate", "node.delay", "schema.skew"]
_words = lambda xs: F.array(*[F.lit(x) for x in xs])


def _families(r) -> DataFrame:
    rows = r("customer").join(r("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("s"), F.col("n_regionkey").cast("int").alias("k")).distinct()
    return rows.select(
        F.concat(F.lpad("k", 2, "0"), "s").alias("seq"), F.concat(F.lit("family."), F.lower("s"), F.lit("."), "k").alias("family"), F.concat(F.lit("topology."), F.lower("s")).alias("topology"),
        F.array(F.concat(F.lit("axis."), "k")).alias("axes"), F.array(F.concat(F.lit("invariant."), F.col("k") % 3), F.concat(F.lit("invariant.of."), F.lower("s"))).alias("invariants"),
        F.slice(_words(_PROFILES), F.lit(1), F.col("k") + 4).alias("profiles"), F.slice(_words(_FAULTS), F.lit(1), F.col("k") % 4 + 1).alias("faults"))


_customers_as_runs = lambda r: r("customer").join(r("nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("c_custkey % 3 = 0").select(
    F.col("c_custkey").alias("instance_id"), F.concat(F.lit("family."), F.lower("c_mktsegment"), F.lit("."), F.col("n_regionkey").cast("int")).alias("family"),
    F.element_at(_words(_PROFILES), (F.col("c_custkey") % 5 + 1).cast("int")).alias("profile"),
    F.when(F.col("c_custkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.element_at(_words(_FAULTS), (F.col("c_custkey") % 3 + 1).cast("int")), F.lit("fault.own"), F.lit("fault.own"))).alias("faults"), "n_name")
_outcomes = lambda r: r("orders").select(F.col("o_orderkey").alias("case_id"), F.lit("effect.at-most-once").alias("invariant"), F.when(F.col("o_orderstatus") == "F", "satisfied").otherwise("violated").alias("status"))
_seen = lambda r: coverage.scenario_witnesses(_customers_as_runs(r), _families(r), _customers_as_runs(r).select("instance_id", F.col("n_name").alias("realization")), _outcomes(r))
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_SCENARIO = f"""WITH fam AS (SELECT lpad(k::VARCHAR, 2, '0') || s AS seq, 'family.' || lower(s) || '.' || k AS family, 'topology.' || lower(s) AS topology, ['axis.' || k] AS axes, ['invariant.' || k % 3, 'invariant.of.' || lower(s)] AS invariants,
        {_LIST(_PROFILES)}[1:k + 4] AS profiles, {_LIST(_FAULTS)}[1:k % 4 + 1] AS faults FROM (SELECT DISTINCT c_mktsegment AS s, n_regionkey::INT AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)),
    inst AS (SELECT c_custkey AS instance_id, 'family.' || lower(c_mktsegment) || '.' || n_regionkey::INT AS family, {_LIST(_PROFILES)}[c_custkey % 5 + 1] AS profile, n_name,
        CASE WHEN c_custkey % 4 = 0 THEN [] ELSE [{_LIST(_FAULTS)}[c_custkey % 3 + 1], 'fault.own'] END AS faults FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0),
    named AS (SELECT seq, family, 1 AS a, 0 AS b, 0 AS c, 'family' AS dimension, family AS key FROM fam UNION ALL SELECT seq, family, 2, 0, 0, 'topology', topology FROM fam
        UNION ALL SELECT seq, family, 3, i, 0, 'universe_axis', axes[i] FROM fam, range(1, 9) x(i) WHERE i <= len(axes) UNION ALL SELECT seq, family, 4, i, 0, 'invariant', invariants[i] FROM fam, range(1, 9) x(i) WHERE i <= len(invariants)
        UNION ALL SELECT seq, family, 5, i, 0, 'observability', profiles[i] FROM fam, range(1, 9) x(i) WHERE i <= len(profiles)
        UNION ALL SELECT seq, family, 6, i, j, 'interaction', family || '|' || CASE WHEN j = 0 THEN 'baseline' ELSE faults[j] END || '|' || profiles[i] FROM fam, range(1, 9) x(i), range(0, 9) y(j) WHERE i <= len(profiles) AND j <= len(faults)
        UNION ALL SELECT seq, family, 7, i, 0, 'fault_operator', faults[i] FROM fam, range(1, 9) x(i) WHERE i <= len(faults)),
    expected AS (SELECT dimension, key, arg_max(family, (seq, a, b, c)) AS family, min((seq, a, b, c)) AS place FROM named GROUP BY dimension, key),
    seen AS (SELECT 'family' AS dimension, family AS key, instance_id FROM inst UNION SELECT 'topology', topology, instance_id FROM inst JOIN fam USING (family) UNION SELECT 'universe_axis', unnest(axes), instance_id FROM inst JOIN fam USING (family)
        UNION SELECT 'invariant', unnest(invariants), instance_id FROM inst JOIN fam USING (family) UNION SELECT 'observability', profile, instance_id FROM inst UNION SELECT 'fault_operator', unnest(faults), instance_id FROM inst
        UNION SELECT 'interaction', family || '|' || unnest(CASE WHEN len(faults) = 0 THEN ['baseline'] ELSE faults END) || '|' || profile, instance_id FROM inst UNION SELECT 'realization', n_name, instance_id FROM inst),
    witness AS (SELECT dimension, key, count(*) AS witnesses FROM seen GROUP BY ALL UNION ALL SELECT 'outcome', 'effect.at-most-once|' || CASE WHEN o_orderstatus = 'F' THEN 'satisfied' ELSE 'violated' END, count(*) FROM orders GROUP BY ALL) """
table_query("n01_scenario_witnesses", _SCENARIO + "FROM witness")(_seen)
table_query("n03_scenario_ledger", _SCENARIO + """SELECT dimension, key, family, CASE WHEN witnesses IS NULL THEN 'uncovered' ELSE 'covered' END AS status, coalesce(witnesses, 0) AS witnesses FROM expected LEFT JOIN witness USING (dimension, key)
    UNION ALL SELECT dimension, key, NULL, 'supplemental', witnesses FROM witness ANTI JOIN expected USING (dimension, key)""")(lambda r: coverage.ledger(coverage.family_points(_families(r)), _seen(r)))
table_query("n04_suggestions", _SCENARIO + """, m AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY place) AS n FROM expected ANTI JOIN witness USING (dimension, key)),
    f AS (SELECT family, count(*) AS uncovered, string_agg(dimension || ':' || key, ',' ORDER BY n) FILTER (n <= 12) AS points, arg_min(key, n) FILTER (dimension = 'interaction') AS first FROM m GROUP BY family)
    SELECT family, uncovered, points, nullif(split_part(first, '|', 2), 'baseline') AS fault, split_part(first, '|', 3) AS profile, CAST(row_number() OVER (ORDER BY uncovered DESC, family) AS INT) AS rank FROM f""")(
    lambda r: coverage.suggestions(coverage.family_points(_families(r)), _seen(r)))
_trials = lambda r: r("labels").join(r("documents").select("doc_id", "text"), "doc_id").select("doc_id", F.coalesce(F.col("text").rlike("!!|###|%%%"), F.lit(False)).alias("detected"))
table_query("n05_mutation_adequacy", "WITH t AS (SELECT regexp_matches(text, '!!|###|%%%') AS d FROM labels JOIN documents USING (doc_id)) SELECT count(*) FILTER (d) AS detected, count(*) FILTER (NOT d) AS survived, count(*) FILTER (d) / count(*) AS score FROM t")(lambda r: coverage.adequacy(_trials(r)))
QUERIES["e14_mutation_adequacy"], ORACLE_SQL["e14_mutation_adequacy"] = QUERIES["n05_mutation_adequacy"], ORACLE_SQL["n05_mutation_adequacy"]
_RULES = [("no_urgent_building", "excludes", "segment", ("BUILDING", "priority", "1-URGENT")), ("some_regions", "in", "region", (0, 1, 2, 3)), ("auto_high", "requires", "segment", ("AUTOMOBILE", "priority", "2-HIGH"))]
_domains = lambda r: {"segment": r("customer").select(F.col("c_mktsegment").alias("segment")).distinct(), "priority": r("orders").select(F.col("o_orderpriority").alias("priority")).distinct(), "region": r("region").select(F.col("r_regionkey").alias("region"))}
_GRID = """WITH grid AS (SELECT segment, priority, region, concat_ws(',', CASE WHEN segment = 'BUILDING' AND priority = '1-URGENT' THEN 'no_urgent_building' END, CASE WHEN region NOT IN (0, 1, 2, 3) THEN 'some_regions' END,
    CASE WHEN segment = 'AUTOMOBILE' AND priority <> '2-HIGH' THEN 'auto_high' END) AS broken FROM (SELECT DISTINCT c_mktsegment AS segment FROM customer), (SELECT DISTINCT o_orderpriority AS priority FROM orders), (SELECT r_regionkey AS region FROM region)) """
_grid = lambda r: coverage.grid(_domains(r), _RULES)
table_query("n06_parameter_grid", _GRID + "FROM grid")(_grid)
table_query("c11_admissibility", _GRID + "SELECT segment, priority, region FROM grid WHERE broken = ''")(lambda r: _grid(r).where("size(broken) = 0").drop("broken"))
table_query("n06_admissible_grid", _GRID + "SELECT segment, priority, region FROM grid WHERE broken = ''")(lambda r: coverage.admissible(_domains(r), _RULES))


def _drawn(n: int, seed: int, bits: int = 4) -> str:
    """SQL of the same draws; four bits a half are enough for the 125 combinations."""
    mask = (1 << bits) - 1
    rounds = f"p0 AS (SELECT i, i >> {bits} AS l, i & {mask} AS r FROM range({4**bits}) x(i))"
    for k, key in enumerate(coverage.round_keys(seed, bits)):
        rounds += f", m{k} AS (SELECT *, xor(r, {key}) * 40503 AS m FROM p{k}), p{k + 1} AS (SELECT i, r AS l, xor(l, ((xor(m, m >> 9) * 60493) >> 5) & {mask}) AS r FROM m{k})"
    return f""", {rounds}, numbered AS (SELECT *, ((dense_rank() OVER (ORDER BY segment) - 1) * 5 + dense_rank() OVER (ORDER BY priority) - 1) * 5 + dense_rank() OVER (ORDER BY region) - 1 AS number FROM grid)
    SELECT segment, priority, region, i AS draw FROM p4 JOIN numbered ON number = (l << {bits}) | r WHERE broken = '' ORDER BY i LIMIT {n}"""


table_query("n07_grid_sample", _GRID + _drawn(10, 7))(lambda r: coverage.sample(_domains(r), _RULES, 10, 7))
_instances = lambda r: _grid(r).where("size(broken) = 0").drop("broken").withColumn("id", F.concat_ws("/", "segment", "priority", "region"))
table_query("n08_parameter_pairs", _GRID + """, ok AS (FROM grid WHERE broken = '') SELECT DISTINCT 'priority' AS p1, priority AS v1, 'region' AS p2, CAST(region AS VARCHAR) AS v2 FROM ok UNION ALL SELECT DISTINCT 'priority', priority, 'segment', segment FROM ok
    UNION ALL SELECT DISTINCT 'region', CAST(region AS VARCHAR), 'segment', segment FROM ok""")(lambda r: coverage.parameter_pairs(_instances(r), "id"))
table_query("n09_instance_points", _GRID + "SELECT segment || '/' || priority || '/' || region AS id, 'priority=' || priority || ',region=' || region || ',segment=' || segment AS points FROM grid WHERE broken = ''")(lambda r: coverage.instance_points(_instances(r), "id"))
table_query("n10_instance_digest", _GRID + """SELECT segment || '/' || priority || '/' || region AS id, 'sha256:' || sha256('{"priority":"' || priority || '","region":' || region || ',"segment":"' || segment || '"}' || chr(10)) AS digest FROM grid WHERE broken = ''""")(
    lambda r: coverage.instance_digest(_instances(r), "id"))
table_query("c13_points_by_prefix", _GRID + "SELECT segment || '/' || priority || '/' || region AS id, 'region=' || region AS points FROM grid WHERE broken = ''")(
    lambda r: coverage.instance_points(_instances(r), "id").select("id", coverage.minimized(F.col("points"), ["region="]).alias("points")))
query("n02_outcome_witnesses", f""" SELECT 'outcome' AS dimension, 'resource.capacity-bounded|' || status AS key, count(*) AS witnesses FROM ({ORACLE_SQL['j10_resource_capacity_bounded']}) GROUP BY ALL""".lstrip(), views=False)(
    lambda t: coverage.outcome_witnesses(invariants.evaluate(graph(t), ["resource.capacity-bounded"])))
query("h04_set_differences", " SELECT DISTINCT case_id, 'role.' || i AS role FROM cases, range(10) x(i) WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.case_id = cases.case_id AND n.role = 'role.' || i)")(
    lambda t: t["cases"].select("case_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("role."), i))).alias("role")).join(t["nodes"].select("case_id", "role"), ["case_id", "role"], "left_anti"))

# integrity: documents as files
_files = lambda r: r("documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), "doc_id", "source")
_index = lambda r: integrity.content_index(_files(r))
_later = lambda r: integrity.content_index(_files(r).where("doc_id % 50 <> 0").withColumn("content", F.when(F.col("doc_id") % 33 == 0, F.concat("content", F.lit(b"x"))).otherwise(F.col("content"))).withColumn("path", F.when(F.col("doc_id") % 77 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path"))))
_IDX = """WITH idx AS (SELECT source || '/' || doc_id || '.txt' AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes, 'sha256:' || sha256(coalesce(text, '')) AS digest, source AS layer, 'text/plain' AS media_type FROM documents),
    later AS (SELECT source || '/' || doc_id || '.txt' || CASE WHEN doc_id % 77 = 0 THEN '.new' ELSE '' END AS path, CAST(strlen(text) + CASE WHEN doc_id % 33 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size_bytes,
    'sha256:' || sha256(text || CASE WHEN doc_id % 33 = 0 THEN 'x' ELSE '' END) AS digest FROM documents WHERE doc_id % 50 <> 0),
    diff AS (SELECT coalesce(i.path, l.path) AS path, i.digest AS a, l.digest AS b, l.size_bytes FROM idx i FULL JOIN later l ON i.path = l.path) """
table_query("a14_content_index", _IDX + "SELECT path, media_type, size_bytes, digest, layer FROM idx")(_index)
table_query("a15_media_type", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'application/json' WHEN 1 THEN 'application/x-ndjson' ELSE 'application/octet-stream' END AS media FROM documents")(
    lambda r: r("documents").select("doc_id", S.media_type(F.concat(F.lit("x."), F.when(F.col("doc_id") % 3 == 0, "json").when(F.col("doc_id") % 3 == 1, "jsonl").otherwise("bin"))).alias("media")))
table_query("a05_content_entries", _IDX + "SELECT path, digest FROM idx WHERE layer = 'src1'")(lambda r: _index(r).where("layer = 'src1'").select("path", "digest"))
table_query("d18_bundle_verification", _IDX + "SELECT path, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'unexpected' ELSE 'mismatched' END AS problem FROM diff WHERE a IS DISTINCT FROM b")(lambda r: integrity.verify(_index(r), _later(r)))
table_query("d19_directory_delta", _IDX + "SELECT path, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'deleted' ELSE 'modified' END AS change, coalesce(size_bytes, 0) AS size_bytes FROM diff WHERE a IS DISTINCT FROM b")(lambda r: integrity.delta(_index(r), _later(r)))
table_query("e20_delta_summary", _IDX + "SELECT CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'deleted' ELSE 'modified' END AS change, count(*) AS n, CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS payload_bytes FROM diff WHERE a IS DISTINCT FROM b GROUP BY ALL")(
    lambda r: integrity.delta_summary(integrity.delta(_index(r), _later(r))))
table_query("e19_index_digest", _IDX + "SELECT layer, 'sha256:' || sha256(string_agg(path || '|' || digest || '|' || size_bytes, chr(10) ORDER BY path || '|' || digest || '|' || size_bytes) || chr(10)) AS digest FROM idx GROUP BY layer")(lambda r: integrity.index_digest(_index(r), "layer"))
query("d20_referential_integrity", " SELECT case_id, ref, count(*) AS uses, 'ref' AS column FROM (SELECT e.case_id, unnest(evidence_refs) AS ref FROM effects e) x WHERE NOT EXISTS (SELECT 1 FROM observations o WHERE o.case_id = x.case_id AND o.observation_id = x.ref AND NOT contradiction) GROUP BY ALL")(
    lambda t: integrity.dangling(t["effects"].select("case_id", F.explode("evidence_refs").alias("ref")), "ref", t["observations"].where("not contradiction"), "observation_id").select("case_id", "ref", "uses", F.lit("ref").alias("column")))
query("c06_field_validity", " SELECT node_id AS id, 'attempt' AS rule FROM nodes WHERE task_attempt IS NULL UNION ALL SELECT node_id, 'workflow' FROM nodes WHERE workflow_id IS NULL")(
    lambda t: integrity.field_violations(t["nodes"], "node_id", {"id": integrity.valid_id(F.col("node_id")), "attempt": F.col("task_attempt") > 0, "workflow": integrity.valid_id(F.col("workflow_id"))}))
query("c07_end_before_start", " SELECT case_id, node_id FROM nodes WHERE end_us - 5000000 * CAST(event_id % 2 AS BIGINT) < start_us")(
    lambda t: integrity.reversed_times(t["nodes"].withColumn("end_us", F.col("end_us") - 5000000 * (F.col("event_id") % 2))))
_problems = lambda r: integrity.verify(_index(r), _later(r)).select(F.split("path", "/")[0].alias("layer"), "problem")
_PROB = ", prob AS (SELECT split_part(path, '/', 1) AS layer, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'unexpected' ELSE 'mismatched' END AS problem FROM diff WHERE a IS DISTINCT FROM b) "
_streams = lambda r: traces.stream_counts(r("documents").select("source", F.when(F.col("doc_id") % 91 == 0, "bad").alias("_corrupt")), "source").withColumnRenamed("source", "layer")
table_query("e18_stream_counts", "SELECT source AS layer, count(*) AS records, count(*) FILTER (doc_id % 91 = 0) AS malformed FROM documents GROUP BY source")(_streams)
table_query("o03_health", _IDX + _PROB + """, s AS (SELECT source AS layer, count(*) AS records, count(*) FILTER (doc_id % 91 = 0) AS malformed FROM documents GROUP BY source),
    p AS (SELECT layer, count(*) FILTER (problem = 'missing') AS missing, count(*) FILTER (problem = 'mismatched') AS mismatched, count(*) FILTER (problem = 'unexpected') AS unexpected FROM prob GROUP BY layer)
    SELECT s.layer, records, malformed, coalesce(missing, 0) AS missing, coalesce(mismatched, 0) AS mismatched, coalesce(unexpected, 0) AS unexpected, coalesce(missing, 0) = 0 AND malformed = 0 AS recoverable,
    concat_ws(',', CASE WHEN missing > 0 THEN 'restore missing files' END, CASE WHEN mismatched > 0 THEN 'verify the source of changed files' END, CASE WHEN malformed > 0 THEN 'repair malformed records' END) AS recommendations FROM s LEFT JOIN p USING (layer)""")(
    lambda r: integrity.health(_problems(r), _streams(r), "layer"))
table_query("o01_compatibility", f"SELECT case_id, version, CASE WHEN case_id % 10 = 0 THEN 'incompatible' WHEN version = '1.0.0' THEN 'compatible' WHEN version = '0.9.0' THEN 'migratable' ELSE 'unknown' END AS status FROM ({_MANIFESTS})")(
    lambda r: integrity.compatibility(_manifests(r), _manifests(r).where("case_id % 10 = 0")))
table_query("o02_migration_plan", f"SELECT case_id, version, CASE WHEN version = '0.9.0' THEN '1.0.0' END AS target FROM ({_MANIFESTS})")(lambda r: integrity.migration_plan(_manifests(r)).select("case_id", "version", "target"))
table_query("o04_validation_report", _IDX + _PROB + "SELECT problem, count(*) AS n, CASE WHEN problem = 'unexpected' THEN 'warning' ELSE 'error' END AS severity FROM prob GROUP BY problem")(
    lambda r: _problems(r).groupBy("problem").agg(F.count("*").alias("n")).withColumn("severity", F.when(F.col("problem") == "unexpected", "warning").otherwise("error")))
query("e10_case_summary", DERIVED + """ SELECT case_id, (SELECT count(*) FROM nodes n WHERE n.case_id = c.case_id) AS nodes, (SELECT count(*) FROM every_rel n WHERE n.case_id = c.case_id) AS relations, (SELECT count(*) FROM effects n WHERE n.case_id = c.case_id) AS effects FROM cases c""")(
    lambda t: t["cases"].select("case_id").join(t["nodes"].groupBy("case_id").agg(F.count("*").alias("nodes")), "case_id", "left").join(graph(t)["graph"]["relations"].groupBy("case_id").agg(F.count("*").alias("relations")), "case_id", "left")
    .join(t["effects"].groupBy("case_id").agg(F.count("*").alias("effects")), "case_id", "left").fillna(0))
query("e15_index_cardinalities", """ SELECT case_id, count(DISTINCT node_id) AS nodes, count(DISTINCT component_ref) AS components, count(DISTINCT operation) AS operations FROM nodes GROUP BY case_id""")(
    lambda t: t["nodes"].groupBy("case_id").agg(F.count_distinct("node_id").alias("nodes"), F.count_distinct("component_ref").alias("components"), F.count_distinct("operation").alias("operations")))
query("e16_inverted_index", " SELECT case_id, component_ref, string_agg(node_id, ',' ORDER BY node_id) AS nodes FROM nodes GROUP BY ALL")(lambda t: t["nodes"].groupBy("case_id", "component_ref").agg(F.array_sort(F.collect_list("node_id")).alias("nodes")))
table_query("e17_namespaces", "SELECT DISTINCT unnest(json_keys(props)) AS namespace FROM events")(lambda r: r("events").select(F.explode(F.json_object_keys("props")).alias("namespace")).distinct())
table_query("c10_safe_to_copy", _IDX + "SELECT path FROM idx WHERE path LIKE 'src1/%' OR path LIKE 'src2/%'")(lambda r: _index(r).where(privacy.safe_to_copy(F.col("path"), ("src1/", "src2/"))).select("path"))
query("c14_node_inspector", DERIVED + " SELECT relation_id FROM every_rel WHERE source_ref = 'node.event.100' OR target_ref = 'node.event.100'")(
    lambda t: graph(t)["graph"]["relations"].where("source_ref = 'node.event.100' or target_ref = 'node.event.100'").select("relation_id"))
query("b14_semantic_signature", " SELECT node_id, n.kind AS node_kind, lower(trim(operation)) AS operation, coalesce(c.kind, 'unknown') AS component_kind FROM nodes n LEFT JOIN components c ON component_ref = component_id")(
    lambda t: __import__("causeway.operators.compare", fromlist=["prepare"]).prepare(t["nodes"], t["components"]).select("node_id", "node_kind", "operation", "component_kind"))
query("d08_component_default", " SELECT node_id, coalesce(c.kind, 'unknown') AS kind FROM nodes n LEFT JOIN (FROM components WHERE kind <> 'broker') c ON component_ref = component_id")(
    lambda t: t["nodes"].select("node_id", "component_ref").join(F.broadcast(t["components"].where("kind <> 'broker'").select(F.col("component_id").alias("component_ref"), "kind")), "component_ref", "left").select("node_id", F.coalesce("kind", F.lit("unknown")).alias("kind")))
query("d09_context_map", " SELECT case_id, observed_at_node_ref AS node_id, string_agg(namespace || '.' || field_name || '=' || value, ',' ORDER BY namespace || '.' || field_name || '=' || value) AS context FROM contexts WHERE observed_at_node_ref IS NOT NULL GROUP BY ALL")(
    lambda t: t["contexts"].where("observed_at_node_ref is not null").groupBy("case_id", F.col("observed_at_node_ref").alias("node_id")).agg(F.array_sort(F.collect_list(F.concat("namespace", F.lit("."), "field_name", F.lit("="), "value"))).alias("context")))
query("f04_context_source", """ SELECT case_id, field_name, arg_min(context_id, (CASE WHEN origin_node_ref = observed_at_node_ref THEN 0 ELSE 1 END, input_seq)) AS source FROM contexts GROUP BY ALL""")(
    lambda t: t["contexts"].groupBy("case_id", "field_name").agg(F.min_by("context_id", F.struct((~F.col("origin_node_ref").eqNullSafe(F.col("observed_at_node_ref"))).cast("int"), "input_seq")).alias("source")))
query("f06_first_divergence_kept", " SELECT case_id, logical_effect_key, min(effect_id) AS effect_id FROM effects GROUP BY ALL")(
    lambda t: t["effects"].groupBy("case_id", "logical_effect_key").agg(F.min("effect_id").alias("effect_id")))

# sources: events as spans and structured events
_spans = lambda r: r("events").select(
    F.concat(F.lit("t"), "user_id").alias("traceId"), F.when(F.col("event_id") % 40 != 0, F.concat(F.lit("s"), "event_id")).otherwise("").alias("spanId"), F.concat(F.lit("s"), F.col("event_id") - 150).alias("parentSpanId"),
    F.col("event_type").alias("name"), F.lit("SERVER").alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string").alias("startTimeUnixNano"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + 5000000).cast("string").alias("endTimeUnixNano"),
    F.struct(F.when(F.col("event_type") == "error", "ERROR").alias("code")).alias("status"),
    traces.attribute_map(F.from_json(F.concat(F.lit('[{"key":"service.name","value":{"stringValue":"old"}},{"key":"service.name","value":{"stringValue":"'), "event_type", F.lit('"}},{"key":"workflow.id","value":{"intValue":"'), "user_id", F.lit('"}}]')),
                                          "array<struct<key:string, value:struct<stringValue:string, intValue:string, doubleValue:double, boolValue:boolean>>>")).alias("attrs"))
_SPAN = f"""WITH spans AS (SELECT *, {sql_id('node.otel', "'t' || user_id", "'s' || event_id")} AS node_id, 't' || user_id AS trace_id, 's' || event_id AS span_id, 's' || (event_id - 150) AS parent_span_id, {sql_id('component', 'event_type')} AS component_ref FROM events WHERE event_id % 40 <> 0) """
table_query("a08_otel_normalise", _SPAN + "SELECT node_id, trace_id, span_id, event_type AS component, epoch_us(ts) AS start_us, CASE WHEN event_type = 'error' THEN 'error' ELSE 'unknown' END AS status, CAST(user_id AS VARCHAR) AS workflow_id FROM spans")(
    lambda r: traces.normalize_spans(_spans(r)).select("node_id", "trace_id", "span_id", "component", F.unix_micros("start_time").alias("start_us"), "status", "workflow_id"))
table_query("a07_attribute_map", "SELECT 's' || event_id AS span, event_type AS service, CAST(user_id AS VARCHAR) AS workflow FROM events WHERE event_id % 40 <> 0")(lambda r: _spans(r).where("spanId <> ''").select(F.col("spanId").alias("span"), F.col("attrs")["service.name"].alias("service"), F.col("attrs")["workflow.id"].alias("workflow")))
table_query("a06_otel_diagnostics", "SELECT 't' || user_id AS \"traceId\", event_type AS name, 'missing span id' AS problem FROM events WHERE event_id % 40 = 0")(lambda r: traces.span_diagnostics(_spans(r)))
table_query("d05_span_edges", _SPAN + f"SELECT p.node_id AS source_ref, c.node_id AS target_ref, {sql_id('relation.otel-parent', 'p.node_id', 'c.node_id')} AS relation_id FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id")(
    lambda r: traces.span_edges(traces.normalize_spans(_spans(r))).select("source_ref", "target_ref", "relation_id"))
_structured = lambda r: r("events").select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("component"), F.concat(F.lit("kind."), F.col("event_id") % 3).alias("component_kind"), F.col("event_type").alias("operation"),
                                           F.lit("").alias("node_kind"), F.lit(None).cast("string").alias("status"), (F.col("event_id") - 1).cast("string").alias("parent_event_id"), F.col("event_id").alias("seq"))
_normal = lambda r: traces.normalize_events(_structured(r), "seq")
table_query("a10_event_normalise", "SELECT 'node.' || event_id AS node_id, 'operation' AS kind, 'component.' || event_type AS component_ref, epoch_us(ts) AS start_us, 'unknown' AS status FROM events")(lambda r: _normal(r).select("node_id", "kind", "component_ref", F.unix_micros("start_time").alias("start_us"), "status"))
table_query("a10_first_component", "SELECT 'component.' || event_type AS component_ref, event_type AS component, 'kind.' || arg_min(event_id, event_id) % 3 AS component_kind FROM events GROUP BY event_type")(lambda r: traces.first_components(_normal(r), "seq"))
table_query("d06_event_edges", f"SELECT 'node.' || p.event_id AS source_ref, 'node.' || c.event_id AS target_ref, {sql_id('relation.event-parent', chr(39) + 'node.' + chr(39) + ' || p.event_id', chr(39) + 'node.' + chr(39) + ' || c.event_id')} AS relation_id FROM events c JOIN events p ON c.event_id - 1 = p.event_id")(lambda r: traces.event_edges(_normal(r)))
_selectors = lambda r: r("events").where("event_id % 500 = 0").select(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("value"))
table_query("c01_selector_match", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_id % 500 = 0)")(lambda r: traces.discover(r("events").select("event_id", "user_id", "event_type"), _selectors(r), {"user": "user_id", "type": "event_type"}).select("event_id"))
table_query("c03_collect_candidates", "SELECT event_id, user_id FROM events WHERE event_id % 7 = 0")(lambda r: traces.collect(r("events").select("event_id", "user_id"), r("events").where("event_id % 7 = 0").select("event_id"), "event_id"))
_sourced = lambda r: r("events").select("event_id", F.concat(F.lit("src"), F.col("event_id") % 20).alias("source"), F.when(F.col("event_id") % 1000 == 3, "beta").otherwise("alpha").alias("tenant_id"))
table_query("c04_tenant_scope", "SELECT event_id FROM events WHERE event_id % 20 NOT IN (SELECT event_id % 20 FROM events WHERE event_id % 1000 = 3)")(lambda r: traces.within_scope(_sourced(r), "alpha").select("event_id"))
table_query("c05_time_range", "SELECT event_id FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 2 DAY FROM events) AND ts < (SELECT min(ts) + INTERVAL 5 DAY FROM events)")(
    lambda r: r("events").join(F.broadcast(r("events").agg(F.min("ts").alias("t0"))), F.lit(True)).where("ts >= t0 + interval 2 days and ts < t0 + interval 5 days").select("event_id"))
_fragments = lambda r: r("events").select("event_id", F.lit(1).alias("part"), "event_type").unionByName(r("events").where("event_id % 4 = 0").select("event_id", F.lit(2).alias("part"), F.when(F.col("event_id") % 8 == 0, "changed").otherwise(F.col("event_type")).alias("event_type")))
table_query("f09_first_wins_merge", "SELECT event_id, 1 AS part, event_type, event_id % 8 = 0 AS collision FROM events")(lambda r: traces.merge_first(_fragments(r), "event_id", "part"))
table_query("h01_union_of_fragments", "SELECT event_id, event_type FROM events UNION ALL SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'changed' ELSE event_type END FROM events WHERE event_id % 4 = 0")(lambda r: _fragments(r).drop("part"))
table_query("a04_bounded_page", "SELECT event_id FROM events ORDER BY event_id LIMIT 25 OFFSET 100")(lambda r: traces.page(r("events").select("event_id"), "event_id", 100, 25))


def _exported(t: dict) -> DataFrame:
    """Export of all cases; in every seventh some nodes carry a remark that no rule rewrites and the policy does not let out."""
    leaks = (F.regexp_extract("case_id", "[0-9]+$", 0).cast("long") % 7 == 0) & (F.col("event_id") % 5 == 0)
    nodes = t["nodes"].withColumn("remark", F.when(leaks, F.concat(F.lit("sent Bearer "), "span_id")).otherwise("none"))
    spark = t["nodes"].sparkSession
    got = gated_export.export(t | {"nodes": nodes}, f"{shared_folder(spark)}/export-{uuid.uuid4().hex}", "shareable", _SECRET, leave_out=True)
    verdicts = got["derived/invariants"].select(F.col("case_id").alias("exported_id"), "invariant", F.col("status").alias("verdict"))
    return got["report"].join(verdicts, "exported_id", "left")


query("m09_gated_export", f"""WITH v AS ({RUNTIME}), held AS (SELECT DISTINCT 'case.' || user_id AS case_id FROM events WHERE user_id % 7 = 0 AND event_id % 5 = 0),
    n AS (SELECT case_id, sum(n) AS records FROM ({SQL_VIEWS} SELECT case_id, 1 AS n FROM cases {" ".join(f"UNION ALL SELECT case_id, count(*) FROM {e} GROUP BY case_id" for e in ("nodes", "relations", "contexts", "effects", "observations"))}) GROUP BY case_id)
    SELECT n.case_id, 'case.shareable.' || replace(n.case_id, '.', '-') AS exported_id, CASE WHEN held.case_id IS NULL THEN 'exported' ELSE 'held back' END AS status,
        CASE WHEN held.case_id IS NULL THEN '' ELSE 'nodes.remark: bearer' END AS problems, CAST(records AS BIGINT) AS records, invariant, v.status AS verdict
    FROM n LEFT JOIN held ON n.case_id = held.case_id LEFT JOIN v ON v.case_id = n.case_id AND held.case_id IS NULL""", views=False)(_exported)


def _collected(t: dict) -> DataFrame:
    """Nodes of four sources in the scope of one tenant: two are sound, one holds other tenants, one fails in a task."""
    nodes, spark = t["nodes"].select("node_id", "trace_id", "operation", "tenant_id"), t["nodes"].sparkSession
    own = lambda op: nodes.where((F.col("operation") == op) & (F.col("tenant_id") == "tenant.1"))
    damaged = own("purchase").withColumn("trace_id", F.when(F.col("node_id").isNotNull(), F.raise_error(F.concat(F.lit("damaged record of "), "node_id"))).otherwise(F.col("trace_id")))
    rows = {"view": own("view"), "click": own("click"), "signup": nodes.where("operation = 'signup'"), "purchase": damaged}
    sources = [plugins.TableSource(name, df, "nodes", {"trace": "trace_id"}, "node_id") for name, df in rows.items()]
    got = plugins.collect_apart(spark, sources, spark.createDataFrame([], "kind string, value string"), "tenant.1")
    counts = got.tables["nodes"].groupBy(F.col("operation").alias("source_id")).agg(F.count("*").alias("records"), F.min("node_id").alias("first"))
    return plugins.status_table(spark, got).drop("error").join(counts, "source_id", "left").select("source_id", "status", F.coalesce("records", F.lit(0)).alias("records"), "first")


query("r02_collection", """, bad AS (SELECT operation, count(*) AS n FROM nodes WHERE (operation = 'signup' AND tenant_id <> 'tenant.1') OR (operation = 'purchase' AND tenant_id = 'tenant.1') GROUP BY ALL)
    SELECT s AS source_id, CASE WHEN b.n > 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN b.n > 0 THEN 0 ELSE count(node_id) END AS records, CASE WHEN b.n > 0 THEN NULL ELSE min(node_id) END AS first
    FROM (SELECT unnest(['view', 'click', 'signup', 'purchase']) AS s) LEFT JOIN nodes ON operation = s AND tenant_id = 'tenant.1' LEFT JOIN bad b ON b.operation = s GROUP BY s, b.n""")(_collected)


# stored cases
def _stored(spark, parts: list[DataFrame], form: str = "folders") -> str:
    root = f"{shared_folder(spark)}/cases-{uuid.uuid4().hex}"
    case_store.save_cases(parts, root, form=form)
    return root


_ENTITIES = {"nodes": "node_id", "relations": "relation_id", "contexts": "context_id", "observations": "observation_id", "effects": "effect_id"}


def _case_parts(t: dict) -> list[DataFrame]:
    """Cases as they are stored: their tables, and documents made of the rest."""
    system = F.broadcast(t["components"].agg(F.sort_array(F.collect_list(F.struct("component_id", "kind", "name", "role"))).alias("components")))  # of code-fixed size
    none = F.array().cast("array<string>")
    cases = t["cases"].select("case_id", "category", F.concat(F.lit("execution."), "case_id").alias("execution_id"))
    documents = {
        "manifest": cases.select("case_id", F.lit("case-folder").alias("format"), F.lit("1.0.0").alias("version")), "case": cases.select("case_id", "category"),
        "execution": cases.select("case_id", "execution_id"), "system": cases.select("case_id").join(system, F.lit(True)).select("*", none.alias("boundaries"), none.alias("resources")),
    }
    return [case_store.as_records(e, t[e], key) for e, key in _ENTITIES.items()] + [case_store.as_records(e, df) for e, df in documents.items()]


def _loaded(t: dict) -> DataFrame:
    spark = t["nodes"].sparkSession
    rows = case_store.load_cases(spark, _stored(spark, _case_parts(t), "archives"))
    said = lambda e, f: F.get_json_object(e, f"$.{f}").alias(f)
    return rows.select("case_id", said("case", "category"), said("execution", "execution_id"), said("manifest", "version"), *_ENTITIES, "state_facts", "components", "boundaries", "resources", "problems")


query("a01_load_case", f" SELECT case_id, category, 'execution.' || case_id AS execution_id, '1.0.0' AS version, {', '.join(f'(SELECT count(*) FROM {e} x WHERE x.case_id = c.case_id) AS {e}' for e in _ENTITIES)}, 0 AS state_facts, "
      "(SELECT count(*) FROM components) AS components, 0 AS boundaries, 0 AS resources, '' AS problems FROM cases c", of=dealt_tables)(_loaded)
_RELATION = "case_id, relation_id, kind, source_ref, target_ref, derivation"
query("a01_relations_read_back", f" SELECT {_RELATION} FROM relations")(lambda t: case_store.read_entity(t["nodes"].sparkSession, _stored(
    t["nodes"].sparkSession, [case_store.as_records("relations", t["relations"], "relation_id")]), "relations", "relation_id string, kind string, source_ref string, target_ref string, derivation string").select(*_RELATION.split(", ")))
_JSON = lambda **f: " || ',' || ".join(f"'\"{k}\":' || coalesce({v}, 'null')" for k, v in sorted(f.items()))
_TEXT = lambda c: f"'\"' || {c} || '\"'"
_FILE_SQL = {
    "model/relations.jsonl": ("relations", "relation_id", _JSON(**{c: _TEXT(c) for c in ("relation_id", "kind", "source_ref", "target_ref", "derivation")})),
    "evidence/effects.jsonl": ("effects", "effect_id", _JSON(**{c: _TEXT(c) for c in ("effect_id", "logical_effect_key", "producer_node_ref", "durability", "idempotency_key")},
                                                            evidence_refs=f"'[' || {_TEXT('evidence_refs[1]')} || ']'", required="required::VARCHAR", maximum_durable_count="maximum_durable_count::VARCHAR")),
    "model/contexts.jsonl": ("contexts", "context_id", _JSON(**{c: _TEXT(c) for c in ("context_id", "namespace", "field_name", "value", "propagation_contract", "origin_node_ref", "observed_at_node_ref")}, input_seq="input_seq::VARCHAR")),
}
query("a12_case_sink", " " + " UNION ALL ".join(f"SELECT case_id, '{path}' AS path, strlen(content)::BIGINT AS size_bytes, 'sha256:' || sha256(content) AS digest FROM (SELECT case_id, string_agg('{{' || {line} || '}}' || chr(10), '' ORDER BY {key}) AS content FROM {table} GROUP BY case_id)"
                                                for path, (table, key, line) in _FILE_SQL.items()))(
    lambda t: case_store.content_index(t["nodes"].sparkSession, _stored(t["nodes"].sparkSession, [case_store.as_records(e, t[e], _ENTITIES[e]) for e in ("relations", "effects", "contexts")])))
table_query("a16_catalogue", f"SELECT case_id, version FROM ({_MANIFESTS})")(lambda r: case_store.catalogue(r("events").sparkSession, _stored(
    r("events").sparkSession, [case_store.as_records("manifest", _manifests(r).select(F.col("case_id").cast("string").alias("case_id"), "version"))])).select(F.col("case_id").cast("long").alias("case_id"), "version"))


def _malformed(r) -> DataFrame:
    """Documents as JSONL files of their sources, with blank and damaged lines."""
    path = f"{shared_folder(r("events").sparkSession)}/lines-{uuid.uuid4().hex}"
    good = F.to_json(F.struct("doc_id", "text"))
    line = F.when(F.col("doc_id") % 13 == 0, "  ").when(F.col("doc_id") % 91 == 5, F.concat(F.lit("{"), "doc_id")).when(F.col("doc_id") % 97 == 6, F.col("doc_id").cast("string")).otherwise(good)
    rows = r("documents").where("doc_id is not null").select("source", "doc_id", line.alias("value"))
    rows.repartition("source").sortWithinPartitions("source", "doc_id", "value").drop("doc_id").write.partitionBy("source").text(path)
    return traces.malformed_lines(r("events").sparkSession, path).select(F.url_decode(F.regexp_extract("file", "/source=([^/]+)/", 1)).alias("source"), F.col("line").cast("long"), "value")


table_query("a03_malformed_lines", """SELECT source, line, value FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line,
    CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 91 = 5 THEN '{' || doc_id WHEN doc_id % 97 = 6 THEN doc_id::VARCHAR END AS value FROM documents) WHERE value IS NOT NULL""")(_malformed)
table_query("a17_point_lookup", "SELECT event_id, event_type FROM events WHERE user_id = 7")(lambda r: r("events").where("user_id = 7").select("event_id", "event_type"))
query("a21_bundle_inspect", " SELECT c.case_id, category, (SELECT count(*) FROM contexts n WHERE n.case_id = c.case_id) AS contexts FROM cases c")(lambda t: t["cases"].join(t["contexts"].groupBy("case_id").agg(F.count("*").alias("contexts")), "case_id", "left").fillna(0))
query("g01_deterministic_order", " SELECT case_id, node_id, row_number() OVER (PARTITION BY case_id ORDER BY start_us, node_id) AS place FROM nodes")(
    lambda t: t["nodes"].select("case_id", "node_id", F.row_number().over(Window.partitionBy("case_id").orderBy("start_us", "node_id")).cast("long").alias("place")))

# start and end pairing, sessions, windows: the batch twins of the stream checks
_ts = lambda r: r("events").withColumn("ts", F.col("ts").cast("timestamp"))
_starts = lambda r: _ts(r).where("event_id % 2 = 0").select("event_id", "ts", F.col("event_type").alias("operation"))
_ends = lambda r: _ts(r).where("event_id % 2 = 1").select((F.col("event_id") - 1).alias("parent_event_id"), "ts", F.lit("ok").alias("status"))
table_query("d23_start_end_pairs", """SELECT a.event_id, a.event_type AS operation, CASE WHEN b.event_id IS NOT NULL THEN 'ok' END AS status, (epoch_us(b.ts) - epoch_us(a.ts)) / 1000.0 AS duration_ms FROM events a
    LEFT JOIN events b ON b.event_id = a.event_id + 1 AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_id % 2 = 0""")(lambda r: checks.paired(_starts(r), _ends(r)).select("event_id", "operation", "status", "duration_ms"))
table_query("q02_start_end_timeout", """SELECT a.event_id, a.event_type AS operation, b.event_id IS NULL AS lost FROM events a
    LEFT JOIN events b ON b.event_id = a.event_id + 1 AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 MINUTE WHERE a.event_id % 2 = 0""")(lambda r: checks.with_timeout(_starts(r), _ends(r), "2 minutes").select("event_id", "operation", "lost"))
table_query("q01_deduplicated_log", "SELECT event_id FROM events")(lambda r: checks.deduplicated(_ts(r).unionByName(_ts(r).where("event_id % 3 = 0"))).select("event_id"))
query("q03_at_most_once_counts", " SELECT case_id, logical_effect_key, count(*) FILTER (durability IN ('committed', 'durable')) AS durable_count, min(maximum_durable_count) AS maximum, CASE WHEN count(*) FILTER (durability IN ('committed', 'durable')) > min(maximum_durable_count) THEN 'violated' ELSE 'satisfied' END AS status FROM effects GROUP BY ALL")(
    lambda t: checks.durable_counts(t["effects"]))
table_query("q04_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS first_us, count(*) AS n FROM s GROUP BY user_id, s""")(lambda r: checks.sessions(_ts(r)).select("user_id", F.unix_micros("first_ts").alias("first_us"), "n"))
table_query("q05_status_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS hour_us, event_type, count(*) AS n FROM events GROUP BY ALL")(lambda r: checks.status_counts(_ts(r)).select(F.unix_micros("hour").alias("hour_us"), "event_type", "n"))

# mutations
_mod = lambda column, n: F.regexp_extract(column, "[0-9]+$", 0).cast("long") % n == 0
query("p01_drop_context", " SELECT context_id FROM contexts WHERE input_seq % 7 <> 0")(lambda t: mutations.drop_contexts(t, F.col("input_seq") % 7 == 0)["contexts"].select("context_id"))
query("p02_mutate_context", " SELECT context_id, CASE WHEN input_seq % 7 = 0 THEN 'changed' ELSE value END AS value FROM contexts")(lambda t: mutations.mutate_contexts(t, F.col("input_seq") % 7 == 0, "changed")["contexts"].select("context_id", "value"))
query("p03_duplicate_effect", " SELECT effect_id FROM effects UNION ALL SELECT effect_id || '.retry.' || i FROM effects, (VALUES (2), (3)) v(i) WHERE required")(lambda t: mutations.duplicate_effects(t, F.col("required"), 3)["effects"].select("effect_id"))
query("p04_omit_effect", " SELECT effect_id FROM effects WHERE NOT required")(lambda t: mutations.omit_effects(t, F.col("required"))["effects"].select("effect_id"))
query("p05_fail_and_collapse", " SELECT node_id, CASE WHEN event_id % 7 = 0 THEN 'resource_exhausted' ELSE status END AS status, CASE WHEN event_id % 7 = 0 THEN 'tenant.y' ELSE tenant_id END AS tenant_id FROM nodes")(
    lambda t: mutations.collapse_identity(mutations.fail_nodes(t, F.col("event_id") % 7 == 0, "resource_exhausted"), F.col("event_id") % 7 == 0, "tenant_id", "tenant.y")["nodes"].select("node_id", "status", "tenant_id"))
query("p06_delay", " SELECT node_id, start_us + CASE WHEN event_id % 7 = 0 THEN 250000 ELSE 0 END AS start_us FROM nodes")(lambda t: mutations.shift_nodes(t, F.col("event_id") % 7 == 0, 250)["nodes"].select("node_id", "start_us"))
query("p07_reorder", """, m AS (SELECT target_ref, min(start_us) - 1000 AS new_us FROM relations r JOIN nodes n ON n.node_id = r.source_ref WHERE r.kind = 'invokes' GROUP BY target_ref)
    SELECT node_id, coalesce(new_us, start_us) AS start_us, end_us + coalesce(new_us, start_us) - start_us AS end_us FROM nodes LEFT JOIN m ON node_id = target_ref""")(lambda t: mutations.reorder(t, F.col("kind") == "invokes")["nodes"].select("node_id", "start_us", "end_us"))
query("p08_schema_skew", " SELECT node_id, CASE WHEN event_id % 7 = 0 THEN '9' ELSE schema_version END AS schema_version FROM nodes")(lambda t: mutations.skew_schema(t, F.col("event_id") % 7 == 0, "9")["nodes"].select("node_id", "schema_version"))
query("p09_amplify", " SELECT node_id, amplified FROM nodes UNION ALL SELECT node_id || '.copy.' || i, TRUE FROM nodes, (VALUES (2), (3)) v(i) WHERE event_id % 7 = 0")(lambda t: mutations.amplify(t, F.col("event_id") % 7 == 0, 3)["nodes"].select("node_id", "amplified"))
query("p10_break_trace", """, hit AS (SELECT DISTINCT target_ref FROM relations WHERE kind = 'invokes') SELECT node_id, CASE WHEN target_ref IS NOT NULL THEN 'trace.broken.' || node_id ELSE trace_id END AS trace_id, CASE WHEN target_ref IS NULL THEN parent_span_id END AS parent_span_id
    FROM nodes LEFT JOIN hit ON node_id = target_ref""")(lambda t: mutations.break_trace(t, F.col("kind") == "invokes")["nodes"].select("node_id", "trace_id", "parent_span_id"))
query("p11_drop_observation", " SELECT node_id, CASE WHEN event_id % 307 = 0 THEN '' ELSE array_to_string(observation_refs, ',') END AS observation_refs FROM nodes")(
    lambda t: mutations.drop_observations(t, F.array_contains("attribute_keys", "Authorization"))["nodes"].select("node_id", "observation_refs"))
query("p12_contradict_and_capture", " SELECT observation_id, TRUE AS contradiction, array_to_string(list_append(attribute_keys, 'authorization'), ',') AS attribute_keys FROM observations")(
    lambda t: mutations.capture_secret(mutations.contradict(t, F.lit(True)), F.lit(True))["observations"].select("observation_id", "contradiction", "attribute_keys"))
query("p13_profiles", " SELECT p AS profile, (SELECT count(*) FROM nodes) AS nodes FROM (VALUES ('complete'), ('late_clock')) v(p)")(
    lambda t: mutations.profile(t, "complete")["nodes"].agg(F.lit("complete").alias("profile"), F.count("*").alias("nodes")).unionByName(mutations.profile(t, "late_clock")["nodes"].agg(F.lit("late_clock").alias("profile"), F.count("*").alias("nodes"))))
