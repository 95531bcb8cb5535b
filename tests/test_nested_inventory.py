"""The walk over nested records against a plain recursive one."""

import json
import random
import re

from causeway.functions.scalars import SENSITIVE_KEYS
from causeway.operators import inventory


def walk(value, path, inherited, key=None):
    labels = set(inherited) | {label for label, pattern in SENSITIVE_KEYS if re.search(pattern, key or "")}
    if isinstance(value, str) and re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", value):
        labels.add("user_identifier")
    if isinstance(value, dict):
        said = value.get("sensitivity") or []
        declared = {x for x in (said if isinstance(said, list) else [said]) if x in inventory.LABELS}
        for k, child in value.items():
            takes = key in inventory.FLEXIBLE_CONTAINERS or k in inventory.SENSITIVE_VALUE_KEYS
            yield from walk(child, f"{path}.{k}", () if k == "sensitivity" else labels | declared if takes else labels, k)
    elif isinstance(value, list):
        for i, child in enumerate(value):
            yield from walk(child, f"{path}[{i}]", labels, key)
    else:
        yield path, tuple(sorted(labels)), type(value).__name__


def made(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        return rng.choice(["a@b.example", "x\ny", "", "é", 7, 10**12, 1.5, True, None])
    if rng.random() < 0.3:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    keys = rng.sample(["attributes", "value", "node_id", "api_key", "note", "inputs", "entity_refs", "x y", "tenant_id", "sql"], rng.randrange(5))
    out = {k: made(rng, depth - 1) for k in keys}
    if rng.random() < 0.5:
        out["sensitivity"] = rng.choice([["internal", "odd"], "credential", [], ["student_record"]])
    return out


def test_every_leaf_of_nested_records(spark):
    rng = random.Random(2)
    records = [{"r": made(rng, 5)} for _ in range(120)] + [7, "a@b.example", [], {}, [[["deep"]]]]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(900, None), (901, "{"), (902, "")]
    df = spark.createDataFrame(rows, "path long, labels string")  # columns with clashing names
    got = sorted((r.id, r.path, tuple(r.labels), r.type) for r in inventory.leaves(df, "path", "labels").collect())
    assert got == sorted((i, *leaf) for i, r in enumerate(records) for leaf in walk(r, "$", ()))
    assert inventory.nested_inventory(df.limit(0), "path", "labels", "public").count() == 0


def test_rules_see_places_in_lists_as_one(spark):
    record = {"nodes": [{"identities": {"principal_id": "p"}}, {"identities": {"session_id": "s"}, "attributes": {"password": "x"}}]}
    df = spark.createDataFrame([(1, json.dumps(record))], "id long, record string")
    got = {r.path: (r.rule, r.action) for r in inventory.nested_inventory(df, "id", "record", "shareable").collect()}
    assert got == {
        "$.nodes[0].identities.principal_id": ("principal.tokenize", "tokenize"), "$.nodes[1].identities.session_id": ("session.tokenize", "tokenize"),
        "$.nodes[1].attributes.password": ("credential.remove", "remove"),
    }
