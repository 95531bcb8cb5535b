"""Components and near links leave short plans behind, whatever the number of rounds."""

import random

import pytest

from causeway.llm.near import Banding, near_links
from causeway.llm.tables import text_key
from causeway.operators import graph
from pyspark.sql import functions as F


@pytest.mark.parametrize("few", [0, 60, 10**6])
@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_components_by_rounds_by_one_task_and_by_both(spark, few, kind):
    rng = random.Random(3)
    name = {"long": lambda n: n - 40, "string": lambda n: "é" * (n % 3) + str(n), "binary": lambda n: bytes([n % 256, n // 7 % 256, n // 256])}[kind]
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(80)] + [(300, k) for k in range(301, 320)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    least = {}
    for n in parent:
        r = find(n)
        key = lambda x: name(x).encode() if kind == "string" else name(x)
        least[r] = min(least.get(r, n), n, key=key)
    rows = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"src {kind}, dst {kind}")
    got = [(bytes(r.node), bytes(r.component)) if kind == "binary" else tuple(r) for r in graph.contract_components(rows, few=few).collect()]
    assert len(got) == len(parent) and set(got) == {(name(n), name(least[find(n)])) for n in parent}


def test_a_small_graph_goes_through_no_round(spark, monkeypatch):
    seen, kept = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: (seen.append(1), kept(df))[1])
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    assert {r.component for r in graph.contract_components(chain).collect()} == {0}
    assert len(seen) == 1  # before: two more for each round


def test_one_round_that_ends_all_still_names_the_least_node(spark):
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(40)], "src long, dst long")
    got = {r.node: r.component for r in graph.contract_components(pairs, few=0).collect()}
    assert got == {n: n - n % 2 for n in range(80)}  # one round leaves no edge, with what comes first in hashed order


def test_near_links_hand_on_a_table_at_rest(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:-1] + ["x"]), " ".join(reversed(words))]
    links = near_links(spark.createDataFrame([(t,) for t in texts], "text string"), text_key(F.col("text")), Banding())
    assert links.count() == 2
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # before: all rounds of the components, again in each plan that used the links
