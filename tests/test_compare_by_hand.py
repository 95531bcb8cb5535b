"""Comparison and isolation of failures, held against plain Python on small cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from causeway.operators import assembly, compare, findings, invariants
from causeway.plans.core import graph
from causeway.plans.views import tables

NODE = (
    "case_id string, node_id string, role string, kind string, operation string, component_ref string, logical_operation_id string, task_name string, stage int, status string, "
    "task_attempt int, start_us long, end_us long, tenant_id string, principal_id string, idempotency_key string, message_id string, observation_refs array<string>"
)
RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}


def case(rng, name, n):
    pick = lambda *x: rng.choice(x)
    return [
        (name, f"{name}.n{i:02}", pick(None, None, "r1", "r2"), pick("read", "write"), pick("get", "put", "scan"), pick("c1", "c2"), pick("l1", "l2", None), pick("t1", None), pick(1, 2, None), pick("ok", "error"),
         pick(None, 1, 2), 1000 * rng.randrange(40), 1000 * rng.randrange(40, 200), pick("a", "b"), pick("p", "q"), pick("k", None), pick("m1", "m2", None), pick([], ["o"]))
        for i in range(n)
    ]


def tables_of(spark, shared=False):
    rng = random.Random(11)
    cases = {f"{side}{i}": case(rng, f"{side}{i}", 9) for i in range(12) for side in "ab"}
    own = (lambda n: "x") if shared else (lambda n: n)
    if shared:
        cases = {n: [(r[0], r[1].replace(n, "x"), *r[2:]) for r in rows] for n, rows in cases.items()}
    t = {
        "nodes": spark.createDataFrame([r for rows in cases.values() for r in rows], NODE),
        "components": spark.createDataFrame([("c1", "database", "store"), ("c2", "service", "handler")], "component_id string, kind string, role string"),
        "contexts": spark.createDataFrame([(n, f"{own(n)}.ctx", "s", "f", rng.choice("xy"), f"{own(n)}.n01") for n in cases], "case_id string, context_id string, namespace string, field_name string, value string, observed_at_node_ref string"),
        "effects": spark.createDataFrame([(n, f"{own(n)}.e{j}", "key", rng.choice(["durable", "attempted"]), f"{own(n)}.n0{j}") for n in cases for j in range(2)], "case_id string, effect_id string, logical_effect_key string, durability string, producer_node_ref string"),
    }
    pairs = spark.createDataFrame([(f"cmp{i}", f"a{i}", f"b{i}") for i in range(12)], "comparison_id string, baseline_case string, candidate_case string")
    return cases, pairs, t


@pytest.fixture(scope="module")
def made(spark):
    cases, pairs, t = tables_of(spark)
    out = compare.compare(pairs, t)
    return cases, {name: [r.asDict() for r in df.collect()] for name, df in out.items()}, [r.asDict() for r in compare.in_order(out["divergences"]).collect()]


def aligned_by_hand(left, right):
    kinds = {"c1": ("database", "store"), "c2": ("service", "handler")}
    name = [f.split()[0] for f in NODE.split(", ")]
    left, right = ([dict(zip(name, r)) for r in rows] for rows in (left, right))
    found, used = [], set()
    for role in ("r1", "r2"):
        sides = [sorted((n for n in rows if n["role"] == role), key=lambda n: (n["task_attempt"] or 0, n["start_us"], n["node_id"])) for rows in (left, right)]
        for a, b in zip(*sides):
            found.append((a["node_id"], b["node_id"], "aligned", 1.0, ""))
            used |= {a["node_id"], b["node_id"]}

    def score(a, b):
        same = lambda x, y: x is not None and x == y
        parts = [same(a["kind"], b["kind"]), same(a["operation"], b["operation"]), same(*(kinds[n["component_ref"]][0] for n in (a, b))), same(*(kinds[n["component_ref"]][1] for n in (a, b))),
                 *[same(a[c], b[c]) for c in ("logical_operation_id", "task_name", "stage")]]
        return sum(w for w, s in zip((4.0, 6.0, 3.0, 1.5, 2.0, 2.0, 1.0), parts) if s) / 19.5

    edges = sorted((-score(a, b), a["node_id"], b["node_id"]) for a in left for b in right if not {a["node_id"], b["node_id"]} & used and score(a, b) >= 0.55)
    done, taken = set(), set()
    for s, a, b in edges:
        if a in done or b in taken:
            continue
        near = sorted(y for x, l, y in edges if l == a and y not in taken and abs(x - s) < 0.03)
        done.add(a)
        if len(near) > 1:
            found.append((a, None, "ambiguous", -s, ",".join(near)))
        else:
            taken.add(b)
            found.append((a, b, "aligned", -s, ""))
    lefts, rights = {f[0] for f in found}, {f[1] for f in found}
    found += [(n["node_id"], None, "baseline_only", 0.0, "") for n in left if n["node_id"] not in lefts]
    found += [(None, n["node_id"], "candidate_only", 0.0, "") for n in right if n["node_id"] not in rights]
    return Counter((a, b, s, round(x, 6), o) for a, b, s, x, o in found)


def test_alignment_by_hand(made):
    cases, got, _ = made
    for i in range(12):
        rows = Counter((r["baseline_ref"], r["candidate_ref"], r["status"], round(r["score"], 6), r["others"]) for r in got["alignments"] if r["comparison_id"] == f"cmp{i}")
        assert rows == aligned_by_hand(cases[f"a{i}"], cases[f"b{i}"])
    assert {r["status"] for r in got["alignments"]} == {"aligned", "ambiguous", "baseline_only", "candidate_only"}


def test_cases_that_share_ids_compare_alike(spark, made):
    """All cases hold the same node, context and effect ids: the result is that of ids of their own."""
    _, pairs, t = tables_of(spark, shared=True)
    bare = lambda text: re.sub(r"[ab]\d+\.", "x.", text)
    rows = lambda found: Counter((d["comparison_id"], d["classification"], d["severity"], d["consequence"], bare(d["baseline_refs"]), bare(d["candidate_refs"]), d["rank_ms"]) for d in found)
    got = rows(r.asDict() for r in compare.compare(pairs, t)["divergences"].collect())
    assert got == rows(made[1]["divergences"]) and {c for _, c, *_ in got} >= {"context.changed", "effect.durable-count-changed", "structure.missing-operation"}


def test_contexts_of_shared_and_repeated_names(spark):
    node = lambda c: (c, "n", "r", "read", "get", "c1", None, None, None, "ok", None, 0, 5, None, None, None, None, [])
    cases = {"same": [("v", "1")], "lost": [], "other": [("v", "2")], "twice": [("v", "2"), ("v", "1")], "more": [("v", "1"), ("w", "1")]}
    t = {
        "nodes": spark.createDataFrame([node(c) for c in ("base", *cases)], NODE), "components": spark.createDataFrame([("c1", "database", "store")], "component_id string, kind string, role string"),
        "contexts": spark.createDataFrame([(c, f"ctx{i}", "s", name, value, "n") for c, seen in (("base", [("v", "1")]), *cases.items()) for i, (name, value) in enumerate(seen)],
                                          "case_id string, context_id string, namespace string, field_name string, value string, observed_at_node_ref string"),
        "effects": spark.createDataFrame([], "case_id string, effect_id string, logical_effect_key string, durability string, producer_node_ref string"),
    }
    pairs = spark.createDataFrame([(c, "base", c) for c in cases], "comparison_id string, baseline_case string, candidate_case string")
    got = {r.comparison_id: (r.classification, r.severity) for r in compare.compare(pairs, t)["divergences"].collect()}
    assert got == {"lost": ("context.changed", "high"), "other": ("context.changed", "high"), "more": ("context.changed", "medium")}


def test_neighbourhood_stays_in_its_case(spark):
    rows = [(c, f"{c}.{s}{t}", s, t) for c, edges in {"c1": ["ab", "bd", "de"], "c2": ["ax", "xd", "dz"]}.items() for s, t in edges]
    relations = spark.createDataFrame(rows, "case_id string, relation_id string, source_ref string, target_ref string")
    near, edges = assembly.neighborhood(relations, "c1", "a", 2)
    assert {(r.entity, r.distance) for r in near.collect()} == {("a", 0), ("b", 1), ("d", 2)} and {r.relation_id for r in edges.collect()} == {"c1.ab", "c1.bd"}


def greedy(edges):
    """The matching, one edge after the other."""
    done, taken, out = set(), set(), []
    for s, a, b in sorted(edges):
        if a in done or b in taken:
            continue
        near = sorted(y for x, l, y in edges if l == a and y not in taken and abs(x - s) < 0.03)
        done.add(a)
        taken |= {b} if len(near) == 1 else set()
        out.append((a, b, "aligned", round(-s, 6), "") if len(near) == 1 else (a, None, "ambiguous", round(-s, 6), ",".join(near)))
    return sorted(out, key=str)


def test_matching_in_rounds_equals_one_after_the_other(spark):
    """Scores drawn from few values, so that claims tie and cross; nodes are classes of their own."""
    rng = random.Random(5)
    edges = {c: [(-rng.choice([0.6, 0.62, 0.64, 0.7, 0.9]), f"l{i}", f"r{j}") for i in range(rng.randrange(1, 9)) for j in range(9) if rng.random() < rng.choice([0.15, 0.5])] for c in map(str, range(40))}
    members = lambda side, at: spark.createDataFrame([(c, n, [n]) for c, es in edges.items() for n in sorted({e[at] for e in es})], f"comparison_id string, {side} string, members array<string>")
    rows = spark.createDataFrame([(c, a, b, -s) for c, es in edges.items() for s, a, b in es], "comparison_id string, a_class string, b_class string, score double")
    found = defaultdict(list)
    for r in compare.match(members("a_class", 1), members("b_class", 2), rows).collect():
        found[r.comparison_id].append((r.baseline_ref, r.candidate_ref, r.status, round(r.score, 6), r.others))
    for c, es in edges.items():
        assert sorted(found[c], key=str) == greedy(es)


def test_structure_and_ambiguity_by_hand(made):
    cases, got, _ = made
    attempts = {r[1]: r[10] for rows in cases.values() for r in rows}
    want = Counter()
    for r in got["alignments"]:
        lone = r["baseline_ref"] or r["candidate_ref"]
        if r["status"] in ("baseline_only", "candidate_only"):
            later = (attempts[lone] or 0) > 1
            want[(r["comparison_id"], "structure.additional-operation" if r["status"] == "candidate_only" else "structure.missing-operation", "high" if later else "medium", lone)] += 1
        elif r["status"] == "ambiguous":
            want[(r["comparison_id"], "alignment.ambiguous", "low", r["baseline_ref"])] += 1
    got_rows = Counter((d["comparison_id"], d["classification"], d["severity"], d["baseline_refs"] or d["candidate_refs"]) for d in got["divergences"] if d["dimension"] == "structure")
    assert got_rows == want


def test_order_first_and_summary_by_hand(made):
    _, got, placed = made
    by = defaultdict(list)
    for d in got["divergences"]:
        by[d["comparison_id"]].append(d)
    key = lambda d: (float("inf") if d["rank_ms"] is None else d["rank_ms"], RANK[d["severity"]], d["divergence_id"])
    for name, rows in by.items():
        assert [d["divergence_id"] for d in sorted((p for p in placed if p["comparison_id"] == name), key=lambda p: p["place"])] == [d["divergence_id"] for d in sorted(rows, key=key)]
        keep = [d for d in rows if d["consequential"] and d["consequence"] in ("semantic", "outcome_relevant")]
        assert [f["divergence_id"] for f in got["first"] if f["comparison_id"] == name] == [min(keep, key=key)["divergence_id"]]
        total, = [s for s in got["summary"] if s["comparison_id"] == name]
        status = Counter(a["status"] for a in got["alignments"] if a["comparison_id"] == name)
        assert [total[f"{s}_nodes"] for s in ("aligned", "baseline_only", "candidate_only", "ambiguous")] == [status[s] for s in ("aligned", "baseline_only", "candidate_only", "ambiguous")]
        assert (total["divergences"], total["consequential"]) == (len(rows), sum(d["consequential"] for d in rows))
        assert len({(d["classification"], d["baseline_refs"], d["candidate_refs"]) for d in rows}) == len(rows)
    changed = [d for d in got["divergences"] if d["classification"] == "identity.changed"]
    assert changed and {d["severity"] for d in changed} == {"high", "medium"}


def test_a_failing_evaluator_holds_up_no_other(spark, sf_dir, monkeypatch):
    def broken(t):
        raise ValueError("no such thing")

    ids = ["resource.capacity-bounded", "contract.schema-compatible"]
    _, severity, needs = invariants.INVARIANTS[ids[0]]
    monkeypatch.setitem(invariants.INVARIANTS, ids[0], (broken, severity, needs))
    t = graph(tables(spark, sf_dir))
    rows = invariants.evaluate(t, ids).collect()
    n = t["cases"].count()
    assert Counter(r.status for r in rows if r.invariant == ids[0]) == {"evaluation_error": n} and {r.confidence for r in rows if r.invariant == ids[0]} == {0.0}
    assert sum(r.invariant == ids[1] for r in rows) == n and all(r.status != "evaluation_error" for r in rows if r.invariant == ids[1])


def test_severity_of_contradicted_and_inconclusive_results(spark):
    rows = [("c", i, s, st, f"r{k}", "x", 1.0, [], []) for k, (i, s, st) in enumerate([
        ("observability.required-linkage", "medium", "contradicted"), ("effect.at-most-once", "critical", "contradicted"), ("effect.required-eventuality", "high", "inconclusive"),
        ("resource.capacity-bounded", "medium", "violated"), ("contract.schema-compatible", "high", "satisfied")])]
    df = spark.createDataFrame(rows, "case_id string, invariant string, severity string, status string, result_id string, evidence_class string, confidence double, node_refs array<string>, effect_refs array<string>")
    got = {r.classification: r.severity for r in findings.from_results(df).collect()}
    assert got == {"observability.required-linkage": "high", "effect.at-most-once": "critical", "effect.required-eventuality": "high", "resource.capacity-bounded": "medium"}


def test_whole_report_is_the_union_of_its_parts(spark, sf_dir):
    t = graph(tables(spark, sf_dir))
    results = invariants.evaluate(t)
    report = findings.analyze(t, results).select("case_id", "classification", F.array_join("node_refs", ",").alias("n"), F.array_join("effect_refs", ",").alias("e"))
    got = Counter(tuple(r) for r in report.collect())
    assert max(got.values()) == 1
    parts = [findings.from_results(results), findings.retry_findings(t["effects"], t["nodes"]), findings.unseen_findings(t["nodes"]), findings.reconstructed_findings(t["graph"]["relations"], t["nodes"])]
    for part in parts:
        assert {(r.case_id, r.classification, ",".join(r.node_refs or []), ",".join(r.effect_refs or [])) for r in part.collect()} <= set(got)
