"""Privacy: policies, field inventory, redaction and validation of records.

A policy is an ordered list of rules. What depends on the name of a column or struct field
is settled on the driver; what depends on a value, or on the key of a map, becomes Column
conditions, so a nested record is redacted in one projection.
"""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from causeway.functions.scalars import EMAIL, SENSITIVE_KEYS, digest, is_email, json_string, mask, preview, sensitivity_labels, stable_id, summarize, token, truncate

ACTIONS = ("retain", "tokenize", "digest", "mask", "truncate", "remove", "summarize", "reject")


@dataclass(frozen=True)
class Rule:
    """Applies where all that is given matches; the one of least priority that applies wins, ties by order."""

    rule_id: str
    action: str
    priority: int = 100
    path: str | None = None
    labels: tuple[str, ...] = ()
    key_pattern: str | None = None
    value_pattern: str | None = None
    max_length: int = 48


# The rules of the three policies.
_SHAREABLE = [
    Rule("credential.remove", "remove", 1, labels=("credential",)),
    Rule("secret-key.remove", "remove", 2, key_pattern=r"(?i)(authorization|cookie|password|passwd|secret|api[_-]?key|access[_-]?token|refresh[_-]?token)"),
    Rule("student.tokenize", "tokenize", 10, labels=("student_record",)),
    Rule("user.tokenize", "tokenize", 11, labels=("user_identifier",)),
    Rule("tenant.tokenize", "tokenize", 12, labels=("tenant_identifier",)),
    Rule("free-text.summarize", "summarize", 20, labels=("free_text",)),
    Rule("query.digest", "digest", 21, labels=("query_text",)),
    Rule("payload.digest", "digest", 22, labels=("payload_derived",)),
    Rule("principal.tokenize", "tokenize", 8, path="*.identities.principal_id"),
    Rule("tenant-identity.tokenize", "tokenize", 8, path="*.identities.tenant_id"),
    Rule("session.tokenize", "tokenize", 8, path="*.identities.session_id"),
    Rule("source-native.tokenize", "tokenize", 30, path="*.provenance.source_native_id"),
]
POLICIES: dict[str, list[Rule]] = {
    "internal": [Rule("credential.reject", "reject", 5, labels=("credential",))],
    "shareable": _SHAREABLE,
    "public": [*_SHAREABLE, Rule("network.mask", "mask", 15, labels=("network_metadata",)), Rule("internal.digest", "digest", 50, labels=("internal",))],
}
# Fields that hold references and stay as they are.
STRUCTURAL_KEYS = {
    "node_id", "relation_id", "context_id", "fact_id", "effect_id", "observation_id", "component_id", "boundary_id", "resource_id", "source_id", "case_id", "system_id",
    "source_ref", "target_ref", "component_ref", "producer_node_ref", "observation_ref", "origin_node_ref", "observed_at_node_ref", "transaction_ref",
}
# What each policy does not let into an export.
_NOT_SHAREABLE = {
    "bearer": r"(?i)bearer\s+[a-z0-9._~+/-]+=*",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "secret": r"(?i)(password|passwd|secret|api[_-]?key)\s*[=:]\s*[^\s,}\]]+",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}
PROHIBITED = {
    "internal": {"authorization": r"(?i)authorization:\s*bearer\s+\S+", "password": r"(?i)password\s*[=:]\s*\S+"},
    "shareable": _NOT_SHAREABLE,
    "public": _NOT_SHAREABLE,
}
#: What scans look for besides; no policy names these.
PERSONAL = {"email": EMAIL, "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"}


def policy(name: str) -> list[Rule]:
    if name not in POLICIES:
        raise KeyError(f"unknown policy: {name}")
    return sorted(POLICIES[name], key=lambda r: r.priority)


def leaves(df: DataFrame, id_col: str, path: str = "record") -> DataFrame:
    """(id, path, key, value): one row for each field of each record, values as text."""
    fields = [c for c in df.columns if c != id_col]
    rows = F.explode(F.array(*[F.struct(F.lit(f"{path}.{c}").alias("path"), F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in fields]))
    return df.select(F.col(id_col).alias("id"), rows.alias("f")).select("id", "f.*")


def labels_of(key: str | Column, value: Column, inherited: tuple[str, ...] = ()) -> Column:
    """Labels of a value: those of its key, those it inherits, and "user_identifier" where it is an e-mail address."""
    if isinstance(key, Column):
        return F.array_sort(F.array_union(sensitivity_labels(key, value), F.array(*[F.lit(x) for x in inherited]).cast("array<string>")))
    named = {label for label, pattern in SENSITIVE_KEYS if re.search(pattern, key)} | set(inherited)
    array = lambda names: F.array(*[F.lit(x) for x in sorted(names)]).cast("array<string>")
    return array(named) if "user_identifier" in named else F.when(is_email(value), array(named | {"user_identifier"})).otherwise(array(named))


def rule_of(rules: list[Rule], path: str | Column, key: str | Column, value: Column, labels: Column) -> Column:
    """The id of the first rule that applies, or null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        when = F.lit(True)
        if rule.path and isinstance(path, Column):
            when = when & path.rlike("^(?s:" + ".*".join(re.escape(x) for x in rule.path.split("*")) + ")\\z")
        elif rule.path and not fnmatch.fnmatchcase(path, rule.path):
            continue
        if rule.key_pattern and isinstance(key, Column):
            when = when & key.rlike(rule.key_pattern)
        elif rule.key_pattern and not re.search(rule.key_pattern, key):
            continue
        if rule.labels:
            when = when & F.arrays_overlap(labels, F.array(*[F.lit(x) for x in rule.labels]))
        if rule.value_pattern:
            when = when & F.coalesce(value.rlike(rule.value_pattern), F.lit(False))
        out = F.when(when, rule.rule_id).otherwise(out)
    return out


def _by_rule(rules: list[Rule], rule: Column, of) -> Column:
    out = F.lit(of(None))
    for r in rules:
        out = F.when(rule == r.rule_id, of(r)).otherwise(out)
    return out


def action_of(rules: list[Rule], rule: Column) -> Column:
    return _by_rule(rules, rule, lambda r: r.action if r else "retain")


def possible(rules: list[Rule], path: str, key: str, inherited: tuple[str, ...] = ()) -> list[Rule]:
    """The rules that may apply to a field of this name, up to the first that surely does. The name settles all labels
    but "user_identifier", which a value can bring."""
    sure = {label for label, pattern in SENSITIVE_KEYS if re.search(pattern, key)} | set(inherited)
    out = []
    for rule in rules:
        if (rule.path and not fnmatch.fnmatchcase(path, rule.path)) or (rule.key_pattern and not re.search(rule.key_pattern, key)):
            continue
        if rule.labels and not set(rule.labels) & (sure | {"user_identifier"}):
            continue
        out.append(rule)
        if not rule.value_pattern and (not rule.labels or set(rule.labels) & sure):
            break
    return out


def transformed(rules: list[Rule], rule: Column, value: Column, labels: Column, key: bytes) -> Column:
    """The value after the action of its rule, which is one of ``rules`` or null."""
    action, n = action_of(rules, rule), _by_rule(rules, rule, lambda r: r.max_length if r else 48)
    made = {
        "tokenize": lambda: token(key, value, labels), "digest": lambda: digest(F.concat(json_string(value), F.lit("\n"))), "mask": lambda: mask(value), "summarize": lambda: summarize(value),
        "truncate": lambda: F.concat(F.substr(value, F.lit(1), n), F.when(F.length(value) > n, "…").otherwise("")), "reject": lambda: F.lit("[PROHIBITED]"),
    }
    out = F.lit("[REDACTED]")
    for name in sorted({r.action for r in rules} & set(made)):
        out = F.when(action == name, made[name]()).otherwise(out)
    return F.when(value.isNull() | (action == "retain"), value).otherwise(out)


def inventory(df: DataFrame, id_col: str, policy_name: str) -> DataFrame:
    """One row a field and record: type, labels, matching rule, action and preview under a policy."""
    rules, fields = policy(policy_name), []
    for c, kind in df.dtypes:
        if c != id_col:
            value = F.col(c).cast("string")
            labels = labels_of(c, value)
            mine = possible(rules, f"record.{c}", c)
            rule = rule_of(mine, f"record.{c}", c, value, labels)
            fields.append(F.struct(
                F.lit(f"record.{c}").alias("path"), F.when(value.isNull(), "null").otherwise(kind).alias("type"), labels.alias("labels"), rule.alias("rule"),
                action_of(mine, rule).alias("action"), F.lit(c in STRUCTURAL_KEYS).alias("structural"), value.alias("value"),
            ))
    rows = df.select(F.col(id_col).alias("id"), F.explode(F.array(*fields)).alias("f")).select("id", "f.*")
    return rows.withColumn("preview", preview(F.col("value")))


def _rewritten(rules: list[Rule], value: Column, kind: T.DataType, path: str, key: str, inherited: tuple[str, ...], secret: bytes) -> Column:
    if isinstance(kind, T.StructType):
        parts = [_rewritten(rules, value[f.name], f.dataType, f"{path}.{f.name}", f.name, inherited, secret).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _rewritten(rules, x, kind.elementType, f"{path}[*]", key, inherited, secret))
    if isinstance(kind, T.MapType):  # keys are known at run time only; what a rule removes goes with its key
        rule = lambda k, v: rule_of(rules, F.concat(F.lit(f"{path}."), k), k, v.cast("string"), labels_of(k, v.cast("string"), inherited))
        kept = F.map_filter(value, lambda k, v: action_of(rules, rule(k, v)) != "remove")
        return F.transform_values(kept, lambda k, v: transformed(rules, rule(k, v), v.cast("string"), labels_of(k, v.cast("string"), inherited), secret))
    text = value.cast("string")
    if key in STRUCTURAL_KEYS:
        return text
    labels, mine = labels_of(key, text, inherited), possible(rules, path, key, inherited)
    return transformed(mine, rule_of(mine, path, key, text, labels), text, labels, secret) if mine else text


def redact(df: DataFrame, id_col: str, policy_name: str, secret: bytes, inherited: tuple[str, ...] = ()) -> DataFrame:
    """Records with every field rewritten by the policy, in one projection; leaves become text.

    Structs, arrays and maps are walked; ``inherited`` are labels declared for the whole
    record. References (``STRUCTURAL_KEYS``) stay as they are. ``secret`` keys the tokens.
    """
    rules = policy(policy_name)
    return df.select(F.col(id_col), *[_rewritten(rules, F.col(f.name), f.dataType, f"record.{f.name}", f.name, inherited, secret).alias(f.name) for f in df.schema if f.name != id_col])


def transformations(df: DataFrame, id_col: str, policy_name: str, secret: bytes) -> DataFrame:
    """One row for each field that the policy changes: its id, rule, labels, type, digest before, and replacement."""
    rules = policy(policy_name)
    rows = inventory(df, id_col, policy_name).where("action <> 'retain' and value is not null and not structural")
    return rows.select(
        stable_id("transform", F.col("id"), F.col("path")).alias("transformation_id"), "id", "path", "labels", "action", F.col("rule").alias("rule_ref"), F.col("type").alias("original_type"),
        digest(F.concat(json_string(F.col("value")), F.lit("\n"))).alias("original_digest"), transformed(rules, F.col("rule"), F.col("value"), F.col("labels"), secret).alias("replacement"),
    )


def redaction_summary(df: DataFrame, id_col: str, policy_name: str, secret: bytes) -> DataFrame:
    rows = transformations(df, id_col, policy_name, secret)
    return rows.groupBy("action").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("action") == "tokenize", F.col("replacement"))).alias("tokens"))


def violations(df: DataFrame, id_col: str, policy_name: str = "shareable", besides: dict[str, str] = PERSONAL) -> DataFrame:
    """(id, path, pattern): what a policy prohibits, and what is looked for besides, that fields still hold. One scan; all patterns are tried in place."""
    rows, patterns = leaves(df, id_col), PROHIBITED[policy_name] | besides
    found = F.array_compact(F.array(*[F.when(F.coalesce(F.col("value").rlike(p), F.lit(False)), F.lit(name)) for name, p in patterns.items()]))
    return rows.select("id", "path", F.explode(found).alias("pattern"))


def first_matches(df: DataFrame, id_col: str, pattern: str) -> DataFrame:
    """The first match of a pattern in each serialised record that has one, previewed."""
    text = F.to_json(F.struct(*[c for c in df.columns if c != id_col]))
    match = F.regexp_extract(text, f"({pattern})", 1)
    return df.select(F.col(id_col).alias("id"), preview(match).alias("match")).where("match <> ''")


def export(df: DataFrame, id_col: str, policy_name: str, secret: bytes) -> tuple[DataFrame, DataFrame]:
    """(records that are clean after redaction, ids of those that are not with what they still hold)."""
    clean = redact(df, id_col, policy_name, secret)
    bad = violations(clean, id_col, policy_name, {}).groupBy("id").agg(F.array_sort(F.collect_set("pattern")).alias("patterns"))
    return clean.join(bad.select(F.col("id").alias(id_col)), id_col, "left_anti"), bad


def by_label(df: DataFrame, id_col: str, policy_name: str) -> DataFrame:
    return inventory(df, id_col, policy_name).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def safe_to_copy(path: Column, prefixes: tuple[str, ...] = ("specification/", "model/", "docs/")) -> Column:
    return reduce(lambda a, b: a | b, [path.startswith(p) for p in prefixes])
