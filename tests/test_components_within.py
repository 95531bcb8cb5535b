"""Components of many graphs at once, with groups that are cut between chunks and tasks."""

import random

import pytest

from causeway.operators import graph


@pytest.mark.parametrize("chunk", [1, 40, 10**6])
def test_components_within_equal_union_find(spark, chunk):
    rng = random.Random(5)
    edges = [("big", f"n{i}", f"n{i + 1}") for i in range(300)] + [("big", "m1", "m2"), ("loop", "a", "a"), ("ü", "é", "z"), (None, "a", "b"), ("nulls", None, "b")]
    edges += [(f"g{g}", f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for g in range(60) for _ in range(9)]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for g, a, b in edges:
        if g is not None and a is not None and a != b:
            x, y = sorted((find((g, a)), find((g, b))), key=lambda k: k[1].encode())
            parent[y] = x
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        rows = graph.components_within(spark.createDataFrame(edges, "case_id string, src string, dst string"), "case_id", chunk=chunk).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert len(rows) == len(parent) and {(r.case_id, r.node): r.component for r in rows} == {k: find(k)[1] for k in parent}


def test_groups_within_a_chunk_go_through_no_round(spark, monkeypatch):
    seen = []
    kept = graph.contract_components
    monkeypatch.setattr(graph, "contract_components", lambda edges: (seen.extend(r.src.grp for r in edges.collect()), kept(edges))[1])
    edges = spark.createDataFrame([(f"g{i:02}", f"n{k}", f"n{k + 1}") for i in range(20) for k in range(5)], "case_id string, src string, dst string")
    assert graph.components_within(edges.coalesce(1), "case_id").count() == 120
    assert len(set(seen)) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
