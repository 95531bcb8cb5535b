"""Queries without SQL that do the whole job, against brute force over the smallest tables."""

import hashlib
import hmac
import re

import pyarrow.parquet as pq

from causeway import registry
from causeway.plans import records
from causeway.plans.core import graph
from causeway.plans.views import tables


def test_components_and_neighborhood_walk_all_relations(spark, sf_dir):
    t = tables(spark, sf_dir)
    nodes = sorted((r.case_id, r.node_id) for r in t["nodes"].select("case_id", "node_id").collect())
    rels = graph(t)["graph"]["relations"].select("case_id", "relation_id", "source_ref", "target_ref").collect()
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rels:
        a, b = (r.case_id, r.source_ref), (r.case_id, r.target_ref)
        if a in parent and b in parent:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = registry.QUERIES["i08_components_of_all_relations"](spark, sf_dir).collect()
    assert sorted((r.case_id, r.node_id, r.component) for r in got) == [(*n, find(n)[1]) for n in nodes]
    center = min(n for _, n in nodes)
    inner = {center} | {y for r in rels for x, y in ((r.source_ref, r.target_ref), (r.target_ref, r.source_ref)) if x == center}
    want = {r.relation_id for r in rels if inner & {r.source_ref, r.target_ref}}
    assert {r.relation_id for r in registry.QUERIES["i09_neighborhood_of_all_relations"](spark, sf_dir).collect()} == want
    recorded = t["relations"].where("kind = 'parent_of'")
    assert len(rels) > t["relations"].count() > recorded.count()  # the derived ones are walked


def test_redaction_covers_rows_with_addresses(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()

    def owner(i):
        name = f"u{i % 50}" + ("@x.org" if i % 3 == 0 else "")
        return name if i % 3 else "user_" + hmac.new(records._SECRET, f'user_identifier:"{name}"'.encode(), hashlib.sha256).hexdigest()[:14]

    def summary(text):
        return text and f"[redacted free text: {len(text)} chars, sha256:{hashlib.sha256(text.encode()).hexdigest()[:12]}]"

    want = sorted((r["doc_id"], summary(r["text"]) or "", r["source"] or "", owner(r["doc_id"])) for r in rows)
    assert any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r["text"] or "") for r in rows)
    got = registry.QUERIES["m08_redaction_of_all_rows"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.text or "", r.source or "", r.owner) for r in got) == want
