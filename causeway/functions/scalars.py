"""Scalar building blocks as Column expressions: ids, times, classification, masking, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def truthy(c: Column) -> Column:
    """Present and not the empty string."""
    return c.isNotNull() & (c != "")


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix.`` and the first 16 hex digits of the SHA-256 of the parts; a null part counts as "None"."""
    joined = F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(prefix + "."), F.substring(F.sha2(joined, 256), 1, 16))


def clean_prefix(prefix: Column) -> Column:
    """Lower case, with runs of anything but letters, digits, ``.``, ``_``, ``:`` and ``-`` as one hyphen."""
    return F.regexp_replace(F.lower(F.trim(prefix)), "[^a-z0-9._:-]+", "-")


def parse_timestamp(value: Column) -> Column:
    """ISO-8601 text, or an epoch number: over 1e13 nanoseconds, over 1e10 milliseconds, else seconds."""
    number = F.try_to_number(F.when(value.rlike("^-?[0-9]{1,30}$"), value), F.lit("S" + "9" * 30)).cast("decimal(38,0)")
    micros = (
        F.when(number > F.lit(10**13).cast("decimal(38,0)"), F.floor(number / 1000))
        .when(number > F.lit(10**10).cast("decimal(38,0)"), number * 1000)
        .otherwise(number * 1000000)
    )
    return F.coalesce(F.timestamp_micros(micros.cast("long")), F.try_to_timestamp(value))


def effective_time(normalized: Column, raw: Column) -> Column:
    return F.coalesce(normalized, raw)


def qualified_name(namespace: Column, field: Column) -> Column:
    return F.concat(namespace, F.lit("."), field)


def normalize_operation(value: Column) -> Column:
    """Lower case, hex runs of eight or more as ``<id>``, whole numbers as ``<n>``, single spaces."""
    text = F.regexp_replace(F.lower(F.trim(value)), r"\b[0-9a-f]{8,}\b", "<id>")
    return F.regexp_replace(F.regexp_replace(text, r"\b[0-9]+\b", "<n>"), r"\s+", " ")


def node_kind(name: Column, kind: Column, attrs: Column) -> Column:
    """Node kind of a span: the first rule that holds names it."""
    kind, name = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    has = lambda key: truthy(attrs[key])
    operation = F.lower(F.coalesce(attrs["messaging.operation"], F.lit("")))
    return (
        F.when(has("db.system"), F.when(name.rlike("insert|update|delete|write"), "write").otherwise("read"))
        .when(has("messaging.system") & (operation.isin("publish", "send") | kind.contains("producer")), "message_publish")
        .when(has("messaging.system") & (operation.isin("receive", "process", "deliver") | kind.contains("consumer")), "message_consume")
        .when(has("task.id"), "task_attempt")
        .when(kind.contains("client"), "remote_call")
        .when(kind.contains("server"), "request")
        .otherwise("operation")
    )


def component_kind(name: Column, attrs: Column) -> Column:
    text = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(truthy(attrs["db.system"]) | text.contains("database") | text.contains("postgres"), "database")
        .when(truthy(attrs["messaging.system"]) | text.contains("queue") | text.contains("broker"), "broker")
        .when(text.contains("worker"), "worker")
        .when(text.contains("web") | text.contains("frontend"), "frontend")
        .otherwise("service")
    )


def boundary_kind(kind: Column) -> Column:
    return (
        F.when(kind.isin("message_publish", "message_consume", "message_delivery", "task_attempt"), "message")
        .when(kind.isin("read", "write", "transaction"), "storage")
        .otherwise("network")
    )


def span_status(code: Column, plain: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(code, F.lit("")), F.nullif(plain, F.lit("")), F.lit("unknown")))


def identity(attrs: Column, name: str) -> Column:
    """An identity under its dotted or underscored name; empty counts as absent."""
    get = lambda key: F.nullif(attrs[key], F.lit(""))
    return F.coalesce(get(name), get(name.replace(".", "_")))


def duration_ms(start_us: Column, end_us: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.coalesce(end_us, start_us) - start_us) / 1000.0)


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and a final newline; equal values give equal text."""
    return F.concat(F.to_json(F.parse_json(text)), F.lit("\n"))


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 in hex, from two nested digests; the key's blocks are worked out once on the driver."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pads = [F.unhex(F.lit(bytes(b ^ x for b in block).hex())) for x in (0x36, 0x5C)]
    inner = F.unhex(F.sha2(F.concat(pads[0], message.cast("binary")), 256))
    return F.sha2(F.concat(pads[1], inner), 256)


def json_string(value: Column) -> Column:
    """A text as JSON."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def token(key: bytes, value: Column, labels: Column) -> Column:
    """The first word of the first label, and 14 hex digits: the same value under the same labels gives the same token."""
    first = F.coalesce(F.get(F.split(F.get(labels, 0), "_"), 0), F.lit("value"))
    return F.concat(first, F.lit("_"), F.substring(hmac_sha256(key, F.concat(F.array_join(labels, ","), F.lit(":"), json_string(value))), 1, 14))


def mask(value: Column) -> Column:
    """The first two and last two characters, up to twelve stars between; short values are all stars."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), F.least(n - 4, F.lit(12))), F.right(value, F.lit(2)))
    )


def summarize(value: Column) -> Column:
    return F.concat(F.lit("[redacted free text: "), F.length(value).cast("string"), F.lit(" chars, sha256:"), F.substring(F.sha2(value, 256), 1, 12), F.lit("]"))


def truncate(value: Column, n: int) -> Column:
    return F.concat(F.substring(value, 1, n), F.when(F.length(value) > n, "…").otherwise(""))


def preview(value: Column) -> Column:
    return F.coalesce(truncate(F.replace(value, F.lit("\n"), F.lit(" ")), 64), F.lit("null"))


SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def evidence_class(status: Column) -> Column:
    return F.when(status == "inconclusive", "unknown").when(status == "contradicted", "contradicted").otherwise("deterministic")


def confidence(status: Column) -> Column:
    return F.when(status == "inconclusive", 0.5).otherwise(1.0)


def title_of(invariant: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(invariant, r"^invariant\.", ""), r"[._-]+", " "))


def media_type(path: Column) -> Column:
    return (
        F.when(path.endswith(".jsonl"), "application/x-ndjson").when(path.endswith(".json"), "application/json")
        .when(path.endswith(".md"), "text/markdown").when(path.endswith(".txt"), "text/plain").otherwise("application/octet-stream")
    )


def deep_link(base: str, case_id: Column, node_id: Column, finding_id: Column) -> Column:
    query = F.concat_ws("&", F.concat(F.lit("node="), node_id), F.concat(F.lit("finding="), finding_id))
    return F.concat(F.lit(base.rstrip("/") + "/cases/"), case_id, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


# Which words in a key name mark its value as sensitive, and how.
SENSITIVE_KEYS = [
    ("credential", r"(?i)(^|[_.-])(authorization|cookie|password|passwd|secret|api[_-]?key|access[_-]?token|refresh[_-]?token)($|[_.-])"),
    ("student_record", r"(?i)(^|[_.-])(student|transcript|grade|course[_-]?history|advising[_-]?note)($|[_.-])"),
    ("user_identifier", r"(?i)(^|[_.-])(user[_-]?id|principal|email|phone)($|[_.-])"),
    ("tenant_identifier", r"(?i)(^|[_.-])(tenant|institution[_-]?id)($|[_.-])"),
    ("query_text", r"(?i)(^|[_.-])(query|sql)($|[_.-])"),
    ("free_text", r"(?i)(^|[_.-])(note|comment|description|message|body|text)($|[_.-])"),
]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
WHOLE_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"


def is_email(value: Column) -> Column:
    """The whole value is an e-mail address; most values are told apart by the missing sign."""
    return F.coalesce(value.contains("@") & value.rlike(WHOLE_EMAIL), F.lit(False))


def sensitivity_labels(key: Column, value: Column) -> Column:
    """Labels that a key's name, or a value that is an e-mail address, gives."""
    found = [F.when(key.rlike(pattern), label) for label, pattern in SENSITIVE_KEYS]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found, F.when(is_email(value), "user_identifier")))))
