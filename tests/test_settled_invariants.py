"""The invariants' tables are derived once, their evidence is looked up once, and nothing changes by it."""

from pyspark.sql import functions as F

from causeway.operators import invariants
from causeway.plans.core import graph, settled_graph
from causeway.plans.views import tables


def test_no_view_is_derived_again(spark, sf_dir):
    plan = invariants.evaluate(settled_graph(tables(spark, sf_dir)))._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan


def test_evidence_of_all_invariants_comes_by_one_look(spark, sf_dir, monkeypatch):
    t = graph(tables(spark, sf_dir))
    ids = ["resource.capacity-bounded", "identity.workflow-correlatable", "effect.at-most-once"]
    own = {(r.case_id, i): (r.status, *(r[c] or [] for c in invariants.REFS)) for i in ids for r in invariants.INVARIANTS[i][0](t).collect()}
    monkeypatch.setattr(invariants, "evidence_of", None)
    rows = [r for r in invariants.evaluate(t, ids, isolated=True).collect() if not r.missing_evidence]
    assert rows and {(r.case_id, r.invariant): (r.status, *(r[c] for c in invariants.REFS)) for r in rows} == {k: own[k] for k in {(r.case_id, r.invariant) for r in rows}}
    assert any(r.evidence_refs for r in rows if r.invariant == ids[0])


def test_parts_count_a_repeated_node_once_and_lone_ones_each(spark):
    node = lambda n: ("c", n, "t", "s")
    nodes = spark.createDataFrame([node(n) for n in ("a", "b", "b", "d")], "case_id string, node_id string, trace_id string, parent_span_id string")
    edges = spark.createDataFrame([("c", "r", "invokes", "a", "b", "source_native", False), ("c", "q", "invokes", "b", "gone", "source_native", False)],
                                  "case_id string, relation_id string, kind string, source_ref string, target_ref string, derivation string, derived boolean")
    cases = spark.createDataFrame([("c", "single"), ("none", "single")], "case_id string, category string")
    seen = spark.createDataFrame([("c", "o", False)], "case_id string, observation_id string, contradiction boolean")
    t = {"nodes": nodes, "graph": {"relations": edges}, "relations": edges, "cases": cases, "observations": seen}
    got = {r.case_id: r for r in invariants.observability_required_linkage(t).collect()}
    assert (got["c"].status, got["c"].node_refs, got["none"].status) == ("inconclusive", ["a", "b", "d"], "satisfied")
    whole = t | {"nodes": nodes.where(F.col("node_id") != "d")}
    assert {r.status for r in invariants.observability_required_linkage(whole).collect()} == {"satisfied"}
