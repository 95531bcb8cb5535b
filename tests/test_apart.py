"""Evaluators and sources that fail in a task hold up no other."""

import pytest
from pyspark.sql import functions as F

from causeway.operators import apart, invariants
from causeway.plans.core import graph
from causeway.plans.views import tables
from causeway.plugins import TableSource, collect_apart, status_table


def _in_task(df, column):
    """Rows of which a worker refuses some, by a Python function."""

    def refuse(x):
        if x is not None:
            raise ZeroDivisionError("refused in a task")
        return x

    return df.withColumn(column, F.udf(refuse, "string")(F.col(column)))


def test_an_evaluator_that_raises_in_a_task(spark, sf_dir):
    t = graph(tables(spark, sf_dir))
    ids = ["resource.capacity-bounded", "contract.schema-compatible", "identity.execution-isolation"]

    def unplanned(t):
        raise KeyError("no such table")

    handlers = {ids[0]: lambda t: _in_task(invariants.resource_capacity_bounded(t), "status"), ids[1]: unplanned}
    got = {(r.case_id, r.invariant): r for r in invariants.evaluate(t, ids, handlers, isolated=True).collect()}
    plain = {(r.case_id, r.invariant): r for r in invariants.evaluate(t, ids).collect()}
    assert set(got) == set(plain)
    for key, row in got.items():
        if key[1] == ids[2]:
            assert (row.status, row.node_refs, row.error) == (plain[key].status, plain[key].node_refs, None)
        else:
            assert row.status == "evaluation_error" and row.confidence == 0.0
            assert ("ZeroDivisionError: refused in a task" if key[1] == ids[0] else "no such table") in row.error


def test_isolated_and_plain_runs_say_the_same(spark, sf_dir):
    t = graph(tables(spark, sf_dir))
    ids = ["effect.at-most-once", "privacy.prohibited-capture"]
    rows = [sorted(map(tuple, invariants.evaluate(t, ids, isolated=how).select("case_id", "invariant", "status", "effect_refs", "evidence_refs", "result_id").collect())) for how in (True, False)]
    assert rows[0] == rows[1] and rows[0]


def test_unknown_handlers_are_refused(spark, sf_dir):
    with pytest.raises(KeyError):
        invariants.evaluate(tables(spark, sf_dir), ["effect.at-most-once"], {"no.such": invariants.effect_at_most_once})


def test_sources_apart(spark):
    rows = spark.createDataFrame([("n1", "t1", "alpha"), ("n2", "t1", None)], "node_id string, trace string, tenant_id string")
    foreign = spark.createDataFrame([("n3", "t1", "alpha"), ("n4", "t1", "beta")], rows.schema)
    none = spark.createDataFrame([], "kind string, value string")
    source = lambda name, df: TableSource(name, df, "nodes", {"trace": "trace"}, "node_id")
    got = collect_apart(spark, [source("a", rows), source("b", foreign), source("c", _in_task(rows, "trace")), source("d", rows.where("false"))], none, tenant="alpha")
    assert got.partial and sorted(r.node_id for r in got.tables["nodes"].collect()) == ["n1", "n2"]
    said = {r.source_id: (r.status, r.error) for r in status_table(spark, got).collect()}
    assert said["a"] == said["d"] == ("completed", None)
    assert said["b"][0] == said["c"][0] == "failed" and "another tenant" in said["b"][1] and "ZeroDivisionError: refused in a task" in said["c"][1]
    with pytest.raises(ValueError):
        collect_apart(spark, [source("a", rows), source("a", rows)], none)


def test_what_an_error_says():
    assert apart.told(ValueError("one\n\nTypeError: two\nthree")) == "ValueError: TypeError: two"
    assert apart.told(ValueError("")) == "ValueError: " and apart.told(KeyError("x" * 999), 20) == "KeyError: 'xxxxxxxxx"
